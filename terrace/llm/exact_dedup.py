"""Exact dedup: 128-bit content hash, smallest stable id, bytes compared.

Only (id, hash, length) rows are shuffled for all documents.  Texts move only
for hashes that occur twice or more, and there they are grouped by the bytes
themselves (map-side combined, so a huge group of copies sends one row per
task); a hash that covers two different byte strings is split by its text.

Defined cases: a null text is the empty text; a null id ranks after every
other id; rows that repeat both id and text count in ``group_size``, are all
marked kept if their id is, and ``deduplicated`` returns one of them.  An empty table
gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import SPACES, text_of
from terrace.plans.scratch import bounded_join, written


def content_hash(text: Column) -> Column:
    """128 bits of content."""
    return F.md5(text.cast("binary"))


def decisions(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    raw = text_of(docs)
    norm = F.translate(raw, SPACES, "")
    full = docs.select(docs["doc_id"].alias("doc_id"), norm.alias("norm"), F.length(raw).alias("points"))
    full = full.withColumn("h", hash_of(F.col("norm")))
    slim = written(full.select("doc_id", "h", "points", F.sha2("norm", 256).alias("text_sha256")))
    shared = written(slim.groupBy("h").count().where("count > 1").select("h"))
    members = bounded_join(full.select("h", "norm"), shared, "h", "left_semi", 64)
    collided = written(members.groupBy("h", "norm").count().groupBy("h").count().where("count > 1").select("h"))
    if collided.isEmpty():
        keyed = slim.withColumn("split", F.lit(None).cast("string"))
    else:
        keyed = bounded_join(full.withColumn("text_sha256", F.sha2("norm", 256)), collided.withColumn("split", F.lit(True)), "h", "left", 64)
        keyed = keyed.select("doc_id", "h", "points", "text_sha256", F.when(F.col("split"), F.col("norm")).alias("split"))
    rank = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = (
        bounded_join(keyed, shared, "h", "left_semi", 64)
        .groupBy("h", "split")
        .agg(F.min(rank)["doc_id"].alias("keep_id"), F.count("*").alias("group_size"), F.lit(True).alias("grouped"))
    )
    on = (keyed["h"] == groups["h"]) & keyed["split"].eqNullSafe(groups["split"])
    return keyed.join(groups, on, "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(~F.col("grouped"), F.lit(True)).alias("single"),
        "text_sha256",
    ).select("doc_id", "keep_id", "group_size", (F.col("single") | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns."""
    found = written(decisions(docs))
    gone = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), "text_sha256"))
    again = written(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias("__gone"), "text_sha256"))
    sha = F.sha2(F.translate(text_of(docs), SPACES, ""), 256)

    def on(frame: DataFrame, other: DataFrame) -> Column:
        return frame["doc_id"].eqNullSafe(other["__gone"]) & (F.sha2(F.translate(text_of(frame), SPACES, ""), 256) == other["text_sha256"])

    kept = bounded_join(docs, gone, on(docs, gone), "left_anti", 112)
    if again.isEmpty():
        return kept
    once = bounded_join(kept, again, on(kept, again), "left_anti", 112)
    more = bounded_join(kept, again, on(kept, again), "left_semi", 112)
    more = more.withColumn("__sha", F.sha2(F.translate(text_of(more), SPACES, ""), 256)).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
    return once.unionByName(more)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
