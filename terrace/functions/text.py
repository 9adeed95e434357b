"""Column expressions for text: cleaning, keys, types, excerpts, citations, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode-aware regular expressions of Python see it.
_WS = r"[\s\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+$", "")


def clean_text(text: Column) -> Column:
    """Line ends unified, blanks collapsed, line-end hyphens joined, at most one empty line, stripped."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\0"), F.lit(""))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"-\n(?=[a-z])", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def entity_key(name: Column, ascii_only: bool = False) -> Column:
    """Lookup key of a name.  With ``ascii_only`` the caller vouches that no
    name needs compatibility normalisation, and no Python runs."""
    out = name if ascii_only else F.when(name.rlike(r"[^\x00-\x7f]"), _nfkc(name)).otherwise(name)
    out = strip(F.lower(out))
    out = F.regexp_replace(out, "^[ \\t\"'`“”‘’.,;:()\\[\\]{}]+|[ \\t\"'`“”‘’.,;:()\\[\\]{}]+$", "")
    out = F.regexp_replace(out, rf"(?U)^(the|a|an){_WS}+", "")
    return F.regexp_replace(out, rf"(?U){_WS}+", " ")


def norm_type(kind: Column) -> Column:
    out = F.regexp_replace(F.coalesce(kind, F.lit("")), "[^A-Za-z0-9]+", "_")
    return F.coalesce(F.nullif(F.upper(F.regexp_replace(out, "^_+|_+$", "")), F.lit("")), F.lit("OTHER"))


def excerpt(text: Column, name: Column, size: int) -> Column:
    """A window of ``size`` around the first mention of ``name``, whatever its case."""
    n = F.length(text)
    at = F.when(name.isNull(), -1).otherwise(F.instr(F.lower(text), F.lower(name)) - 1)
    start = F.when(at >= 0, F.greatest(F.lit(0), F.least(n - size, at - size // 3))).otherwise(F.lit(0))
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(size)), F.when(start + size < n, "…").otherwise("")
    )
    return F.when(n <= size, text).otherwise(cut)


def citations(answer: Column) -> Column:
    """Labels cited as [C1], [E2] ..., each once, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([CERS]\d+)\]"), F.lit(1)))


def digest(parts: Column) -> Column:
    """Hash of an array of strings, joined by the unit separator."""
    return F.sha1(F.array_join(parts, "\x1f"))


def description(texts: Column, chars: int = 800) -> Column:
    """Descriptions with a blank after each, cut."""
    return F.substring(F.concat_ws("", F.transform(texts, lambda t: F.concat(t, F.lit(" ")))), 1, chars)


def entity_text(name: Column, kind: Column, text: Column) -> Column:
    return F.concat(name, F.lit(" ("), kind, F.lit("): "), text)
