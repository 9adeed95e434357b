"""The catalog of profiled datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import strip

#: What readers of the catalog do not see.
HIDDEN = ("embedding", "key_sample", "path")


def register(datasets: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """Rows for files (file_name, file_hash, path) whose hash is not known yet."""
    fresh = files.dropDuplicates(["file_hash"]).join(datasets.select("file_hash"), "file_hash", "left_anti")
    return fresh.select(
        F.concat(F.lit("ds_"), F.substring("file_hash", 1, 12)).alias("id"), "file_name", "file_hash", "path",
        F.regexp_replace("file_name", r"\.[^.]+$", "").alias("name"), F.lit("queued").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def with_columns(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Datasets with their columns as an array in order of position; hidden fields left out."""
    own = columns.drop(*HIDDEN)
    fields = [c for c in own.columns if c != "dataset_id"]
    packed = own.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("position", *[c for c in fields if c != "position"]))).alias("columns"))
    return datasets.drop(*HIDDEN).join(packed.withColumnRenamed("dataset_id", "id"), "id", "left").orderBy(F.desc("created_at"), "id")


def stats(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    one = datasets.agg(F.count("*").alias("datasets"), F.count_if(F.col("status") == "ready").alias("ready"))
    return one.crossJoin(columns.agg(F.count("*").alias("columns")))  # one row each


def replaced(columns: DataFrame, dataset_id: str, profiles: DataFrame) -> DataFrame:
    """The column table with those of one dataset replaced."""
    return columns.where(F.col("dataset_id") != dataset_id).unionByName(profiles.withColumn("dataset_id", F.lit(dataset_id)), allowMissingColumns=True)


def without(datasets: DataFrame, columns: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the datasets in ``gone`` (id)."""
    return datasets.join(gone, "id", "left_anti"), columns.join(gone.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti")


def drafted(columns: DataFrame, draft: DataFrame) -> DataFrame:
    """(position, description): a draft column (n, name, description) meets by name in any case, else by its place."""
    by_name = draft.groupBy(F.lower(strip(F.col("name"))).alias("k")).agg(F.min_by("description", "n").alias("named"))
    by_place = draft.select(F.col("n").alias("position"), F.col("description").alias("placed"))
    return columns.withColumn("k", F.lower(strip(F.col("name")))).join(by_name, "k", "left").join(by_place, "position", "left").select("position", F.coalesce("named", "placed", F.lit("")).alias("description"))


def described(columns: DataFrame, given: DataFrame) -> DataFrame:
    """Descriptions given by position replace the ones there."""
    new = given.select("position", F.nullif(strip(F.col("description")), F.lit("")).alias("given"))
    return columns.join(new, "position", "left").withColumn("description", F.coalesce("given", "description")).drop("given")


def dataset_text(name, description, columns):
    """What is embedded for a dataset; ``columns`` are lines of ``column_line``."""
    return F.substring(F.concat_ws("\n", name, description, F.array_join(columns, "\n")), 1, 6000)


def column_line(name, description):
    """A column with its note, if it has one."""
    return F.concat_ws(" - ", name, F.nullif(description, F.lit("")))


def column_text(dataset, name, dtype, description, categories, examples):
    """What is embedded for a column: its note and up to 30 categories, or else 5 examples."""
    some = F.when(F.size(categories) > 0, F.slice(categories, 1, 30)).otherwise(F.slice(examples, 1, 5))
    return F.substring(F.concat(dataset, F.lit(" / "), name, F.lit(" ("), dtype, F.lit("): "), F.coalesce(description, F.lit("")), F.lit(" e.g. "), F.array_join(some, ", ")), 1, 2000)
