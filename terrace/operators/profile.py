"""Column profiles of a table in one unpivot and two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.functions.cells import clean_cell, format6, number_cell, parse_values, shown, typed_cell

DISTINCT_CAP = 50_000
EXAMPLES = 8
KEY_SAMPLE = 2_000
CATEGORIES = 50
TOP = 5


def values(df: DataFrame, text_source: bool = False) -> DataFrame:
    """(position, kind, shown, number, n, first) of the distinct cells that
    are not empty.  Text is parsed and floats are formatted once per distinct value."""
    kinds = dict(df.dtypes)
    cell = lambda c: clean_cell(df[f"`{c}`"].cast("string")) if text_source else typed_cell(df[f"`{c}`"], kinds[c])
    made = [F.struct(F.lit(i).alias("position"), cell(c).alias("cell")) for i, c in enumerate(df.columns)]
    out = df.select(F.monotonically_increasing_id().alias("row"), F.explode(F.array(*made)).alias("x")).where("x.cell IS NOT NULL")
    if text_source:
        out = out.groupBy("x.position", "x.cell").agg(F.count("*").alias("n"), F.min("row").alias("first")).withColumn("cell", parse_values("cell"))
        return out.select("position", "cell.kind", "cell.shown", "cell.number", "n", "first")
    out = out.groupBy("x.position", "x.cell.kind", "x.cell.shown", "x.cell.number").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    return out.withColumn("shown", F.coalesce("shown", format6("number")))


def profile(df: DataFrame, text_source: bool = False) -> DataFrame:
    """One row per column.  Distinct counts are exact up to DISTINCT_CAP and
    reported capped beyond; frequencies are exact at any size.  Ties among top
    values go by value, examples and key samples by first occurrence."""
    n_rows = df.dropna("all").count()
    by_value = values(df, text_source).withColumn("total", F.col("number") * F.col("n"))
    kinds = ("boolean", "integer", "float", "datetime", "time", "duration", "text")
    stats = by_value.groupBy("position").agg(
        F.sum("n").alias("non_null"),
        F.count_distinct("shown").alias("found"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in kinds],
        F.min("number").alias("lo"),
        F.max("number").alias("hi"),
        (F.sum("total") / F.sum(F.when(F.col("kind").isin("integer", "float"), F.col("n")))).alias("mean"),
        F.min(F.when(F.col("kind").isin("datetime", "time"), F.col("shown"))).alias("t_lo"),
        F.max(F.when(F.col("kind").isin("datetime", "time"), F.col("shown"))).alias("t_hi"),
        (F.sum(F.length("shown") * F.col("n")) / F.sum("n")).alias("avg_len"),
        F.max(F.length("shown")).alias("longest"),
    )
    # A row filter on row_number is pushed below the shuffle as a group limit.
    ranked = by_value.groupBy("position", "shown").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max(F.col("kind").isin("text", "integer")).alias("keyish"))
    often = Window.partitionBy("position").orderBy(F.desc("n"), "shown")
    top = ranked.withColumn("r", F.row_number().over(often)).where(F.col("r") <= CATEGORIES)
    top = top.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("r", "shown", "n"))).alias("top"))
    early = Window.partitionBy("position").orderBy("first", "shown")
    seen = ranked.withColumn("r", F.row_number().over(early)).where(F.col("r") <= EXAMPLES).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("r", "shown"))).alias("seen"))
    keys = ranked.where("keyish").withColumn("r", F.row_number().over(early)).where(F.col("r") <= KEY_SAMPLE).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("r", "shown"))).alias("keys"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, name string")
    top = top.withColumn("most", F.col("top")[0]["n"])
    out = names.join(stats, "position", "left").join(top, "position", "left").join(seen, "position", "left").join(keys, "position", "left")
    total = F.coalesce("non_null", F.lit(0))
    best = F.greatest(*[F.col(f"n_{k}") for k in kinds])
    top_kind = F.coalesce(*[F.when(F.col(f"n_{k}") == best, F.lit(k)) for k in kinds])
    numeric = F.col("n_integer") + F.col("n_float")
    dtype = (
        F.when(total == 0, "empty")
        .when(best / total >= 0.9, F.when((top_kind == "integer") & (F.col("n_float") > 0), "float").otherwise(top_kind))
        .when(numeric / total >= 0.9, "float")
        .otherwise("mixed")
    )
    capped = F.coalesce(F.col("found"), F.lit(0)) > DISTINCT_CAP
    empty = F.array().cast("array<string>")
    is_number = dtype.isin("integer", "float") & F.col("lo").isNotNull()
    return out.select(
        "position",
        "name",
        dtype.alias("dtype"),
        total.alias("non_null"),
        (F.round(100.0 * (1 - total / n_rows), 1) if n_rows else F.lit(0.0)).alias("null_pct"),
        F.least(F.coalesce("found", F.lit(0)), F.lit(DISTINCT_CAP)).cast("long").alias("distinct"),
        capped.alias("distinct_capped"),
        ((total > 1) & F.when(capped, F.col("most") == 1).otherwise(F.col("found") == total)).alias("is_unique"),
        F.coalesce(F.transform("seen", lambda x: x["shown"]), empty).alias("examples"),
        F.when(F.col("most") > 1, F.transform(F.slice("top", 1, TOP), lambda x: F.format_string("%s (%d)", x["shown"], x["n"]))).otherwise(empty).alias("top_values"),
        F.when(~capped & F.col("found").between(1, CATEGORIES), F.transform("top", lambda x: x["shown"])).otherwise(empty).alias("categories"),
        F.when(dtype.isin("text", "integer") & (F.col("longest") <= 64), F.coalesce(F.transform("keys", lambda x: x["shown"]), empty)).otherwise(empty).alias("key_sample"),
        F.when(is_number, shown(number_cell(F.col("lo")))).otherwise(F.col("t_lo")).alias("min"),
        F.when(is_number, shown(number_cell(F.col("hi")))).otherwise(F.col("t_hi")).alias("max"),
        F.when(is_number, F.round("mean", 4)).alias("mean"),
        F.coalesce(F.round("avg_len", 1), F.lit(0.0)).alias("avg_len"),
    )


def without_artefacts(profiles: DataFrame) -> DataFrame:
    """Without empty auto-named columns at the end of the table."""
    real = ~((F.col("dtype") == "empty") & F.col("name").startswith("column_"))
    last = profiles.agg(F.max(F.when(real, F.col("position"))).alias("last"))
    return profiles.crossJoin(F.broadcast(last)).where(F.col("position") <= F.col("last")).drop("last")  # one row


def dtype_votes(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("dtype").count()
