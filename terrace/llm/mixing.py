"""Mixing sources to target weights along a time-varying curriculum.

Targets come from the weights by closed-form water filling over the table of
sources.  Within a source, documents stand in hash order; their cumulative
sizes are summed in two levels (bucket sums, then inside a bucket), so no
task ever holds a source.  Each source has a weight schedule over training
time t in [0, 1]; its integral is the source's cumulative token demand
D(t) = target * ((1 - a) * t + a * t^2), and solving D(t) = cumulative words
gives a document its training position.  ``schedule`` range-sorts by it.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; documents of size 0 take 0 and have no position; equal hashes fall back to
id and size, and rows that repeat id, source and size stand side by side, each
with a place of its own; an empty table
gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.llm.common import text_of, word_count
from terrace.plans.scratch import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Slope of each source's weight schedule, repeating: falling, level, rising.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents meant for one bucket of the two-level sum.
BUCKET_ROWS = 2048


def _cycled(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int") + 1)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """A row per source: source, source_size, rank, target.  Its one-partition
    windows order the table of sources only."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", _cycled(weights, F.col("rank")).cast("double"))
    cap = most * F.col("source_size")
    fill = Window.orderBy(cap / F.col("weight"), F.col("rank"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    by = by.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = cap / F.col("weight") > F.col("level")
    # Beyond the first free source the level only falls, so the largest free one is the water level.
    by = by.withColumn("flat", F.max(F.when(free, F.col("level"))).over(every))
    target = F.when(free, F.col("flat") * F.col("weight")).otherwise(cap.cast("double"))
    return by.select("source", "source_size", "rank", target.alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, slopes=SLOPES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes (positions of
    each pass over the document), one row per input row."""
    sizes = written(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text_of(docs)).alias("size")))
    goal = written(targets(sizes, weights, share, most))
    hottest = sizes.groupBy("source").count().agg(F.max("count")).head()[0] or 1
    buckets = min(max(1, hottest // BUCKET_ROWS), 2**30)
    placed = sizes.withColumn("hash", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source"))))
    head = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("bucket", F.floor(head * F.lit(buckets).cast("long") / F.lit(2**32)))  # ascends with the hash
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("part").over(upto), F.lit(0))).drop("part")
    sums = sums.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, sums["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    sums = sums.withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = Window.partitionBy("source", "bucket").orderBy("hash", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = placed.join(sums, placed["source"].eqNullSafe(sums["s"]) & (placed["bucket"] == sums["b"]))
    words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = at.select("doc_id", "source", "size", "source_size", "rank", "target", (F.col("ahead") + F.col("before")).alias("start"), words.alias("words"), full.alias("full"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("full") * F.col("source_size") - F.col("start")))
    at = at.withColumn("part", rest).withColumn("taken", F.col("full") * F.col("size") + F.col("part"))
    slope = _cycled([float(a) for a in slopes], F.col("rank"))

    def when(done: Column) -> Column:
        """t with D(t) = done."""
        u = F.least(F.lit(1.0), done / F.greatest(F.col("target"), F.lit(1e-300)))
        b = 1 - F.col("slope")
        return F.when(F.col("slope") == 0, u).otherwise((F.sqrt(b * b + 4 * F.col("slope") * u) - b) / (2 * F.col("slope")))

    at = at.withColumn("slope", slope)
    n = F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)
    passes = F.when((F.col("taken") > 0), F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda p: when(p * F.col("source_size") + F.col("start") + F.when(p < F.col("full"), F.col("size")).otherwise(F.col("part")) / 2)))
    return at.withColumn("passes", passes).select("doc_id", "source", "size", "source_size", "target", "taken", "passes")


def schedule(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as it is taken: a
    part pass counts from half the document on.  Rows that share an id, or lack
    one, are told apart by source, size and number."""
    plan = mixed(docs, **how)
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    plan = plan.where(times > 0).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.slice("passes", F.lit(1), times).alias("__passes"))
    # Rows that repeat id, source and size are numbered on both sides: the k-th takes the k-th plan.
    same = Window.partitionBy("__id", "__source", "__size")
    plan = plan.withColumn("__nth", F.row_number().over(same.orderBy("__passes")))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs["doc_id"].alias("__id"), docs["source"].cast("string").alias("__source"), word_count(text_of(docs)).alias("__size"), F.xxhash64(text_of(docs)).alias("__text"))
    own = own.withColumn("__nth", F.row_number().over(same.orderBy("__text")))
    to = plan.withColumnsRenamed({"__id": "i", "__source": "s", "__size": "n", "__nth": "k"})
    on = own["__id"].eqNullSafe(to["i"]) & own["__source"].eqNullSafe(to["s"]) & (own["__size"] == to["n"]) & (own["__nth"] == to["k"])
    rows = own.join(to, on).select("__row", "__id", "__text", F.explode("__passes").alias("__at"))
    return rows.sort("__at", "__id", "__text").select([F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = plan.withColumn("position", F.round(F.col("passes")[0], 9)).sort("position", "doc_id")
    return plan.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "position")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', doc_id, source)) AS h
  FROM documents),
g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM s GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][rk % 3 + 1]::DOUBLE AS weight FROM g),
r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl
  FROM w),
f AS (SELECT *, max(lft / wl) FILTER (2 * source_size / weight > lft / wl) OVER () AS flat FROM r),
t AS (
  SELECT source, source_size, rk, CASE WHEN 2 * source_size / weight > lft / wl THEN flat * weight ELSE 2.0 * source_size END AS target
  FROM f),
c AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s),
p AS (
  SELECT c.*, source_size, rk, target, round(target)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS n_full
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, words - n_full * source_size - start)) AS part FROM p),
z AS (
  SELECT *, n_full * size + part AS taken, least(1.0::DOUBLE, (start + CASE WHEN n_full > 0 THEN size ELSE part END / 2.0::DOUBLE) / greatest(target, 1e-300)) AS u,
         [-0.5, 0.0, 0.5][rk % 3 + 1]::DOUBLE AS a
  FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 4) AS target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END, 9) END AS position
FROM z
"""
