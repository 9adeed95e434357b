"""What the corpus operators share: white space, words, text columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: Words, as Java and Python read the class alike.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def ascii_lower(text: str) -> str:
    """A-Z to a-z, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def byte_words(text: str) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() cuts at SPACES exactly."""
    return text.encode("utf-8", "surrogatepass").split()


def words(text: str) -> list[str]:
    """Maximal runs of characters outside SPACES."""
    joined = b" ".join(byte_words(text)).decode("utf-8", "surrogatepass")
    return joined.split(" ") if joined else []


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of the written table ``counts`` whose ``column`` reaches the
    least value that at most ``most`` rows reach.  The value comes from the
    histogram of the column (a row per distinct count), so no task sorts all rows."""
    hist = sorted(((r[0], r[1]) for r in counts.groupBy(column).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for value, rows in hist:
        total += rows
        if total > most:
            break
        least = value
    return counts.where(F.col(column) >= least) if least is not None else counts.limit(0)


def tidy(run):
    """``run`` (batches to batches) that gives the memory of its task back when it
    ends, as Spark keeps idle workers and their heaps beside those of the next stage."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped
