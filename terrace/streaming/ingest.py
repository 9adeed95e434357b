"""Files that arrive in a folder go into the graph, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terrace.engine import Engine


def watch(engine: Engine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A restarted stream repeats its last batch at most; contents that are known by then are skipped."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = engine.spark.readStream.format("binaryFile").schema(schema).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            engine.ingest(df.select("path", "length", "content"))

    out = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
