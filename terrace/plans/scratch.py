"""Shared intermediate tables and size-checked broadcasts.

Intermediate results that are read more than once are written as Parquet
under the folder that the session names in ``spark.checkpoint.dir``: every
executor can read it, so a lost executor costs no lineage.  A folder of our
own is used only where the setting is absent, as in local tests.  The shuffle
files of a write go with its end, a table with ``dropped`` or, where a lazy
result may still read it, with the end of the driver's process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its rows, that ``bounded_join`` broadcasts.
BROADCAST_BYTES = 48 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; fails on a cluster without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own
    if _own is None:
        _own = f"file://{tempfile.mkdtemp(prefix='terrace-')}"
    return _own


#: Our own folder in local mode; the session's settings are left alone.
_own: str | None = None
#: Tables that may still be read.
_tables: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that one Arrow batch holds, unless the session names another number.
BATCH_BYTES = 4 * 1024 * 1024


@contextlib.contextmanager
def _shuffles_released(spark: SparkSession):
    """Inside, the shuffle files of an action are deleted when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that rows with long texts do not add up
    to batches of hundreds of MB in the JVM and in each Python worker."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terrace/{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrace_path = path
    _tables[path] = spark
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._terrace_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _tables.pop(name, None)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_tables.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


def bounded_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join that broadcasts ``small`` only if count x ``row_bytes`` is within
    ``BROADCAST_BYTES``; beyond it Spark shuffles both sides.  ``small``
    should be a written table, as it is counted first."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_merge"), on, how)
