"""Entities and relationships of extracted chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import entity_key, norm_type, strip

EXTRACTION = (
    "struct<entities:array<struct<name:string,type:string,description:string>>,"
    "relationships:array<struct<source:string,target:string,type:string,description:string,strength:int>>>"
)


def parsed(chunks: DataFrame) -> DataFrame:
    """``extraction`` from JSON text to a struct."""
    return chunks.withColumn("extraction", F.from_json("extraction", EXTRACTION))


def mentions(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, seq, key, name, type, description) in order of emission."""
    rows = chunks.select("doc_id", F.col("id").alias("chunk_id"), "index", F.posexplode("extraction.entities").alias("pos", "e"))
    return rows.select("doc_id", "chunk_id", F.struct("index", "pos").alias("seq"), entity_key(F.col("e.name")).alias("key"), strip(F.col("e.name")).alias("name"), norm_type(F.col("e.type")).alias("type"), strip(F.col("e.description")).alias("description")).where("key <> ''")


def first_distinct(text: Column, seq: Column, cap: int) -> Column:
    """Aggregate: distinct non-empty texts by first occurrence, capped."""
    kept = F.sort_array(F.collect_list(F.when((text != "") & text.isNotNull(), F.struct(seq.alias("s"), text.alias("t")))))
    return F.slice(F.array_distinct(F.transform(kept, lambda x: x["t"])), 1, cap)


def aggregate_entities(rows: DataFrame, by=("doc_id", "key"), cap: int = 8) -> DataFrame:
    """One row per key: name (most frequent, then longest, then first), type
    (most frequent, then first), descriptions, mention count (distinct
    chunks).  Names, types and descriptions are counted before they meet."""
    by = list(by)
    once = rows.groupBy(*by, "name").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    names = once.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("l"), "first", "name")))[0]["name"].alias("name"))
    kinds = rows.groupBy(*by, "type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    kinds = kinds.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "type")))[0]["type"].alias("type"))
    texts = rows.groupBy(*by, "description").agg(F.min("seq").alias("first")).groupBy(*by).agg(first_distinct(F.col("description"), F.col("first"), cap).alias("descriptions"))
    counts = rows.groupBy(*by).agg(F.count_distinct("chunk_id").alias("mention_count"))
    return names.join(kinds, by).join(texts, by).join(counts, by)


def relationships(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("doc_id", F.col("id").alias("chunk_id"), "index", F.posexplode("extraction.relationships").alias("pos", "r"))
    return rows.select(
        "doc_id", "chunk_id", F.struct("index", "pos").alias("seq"), entity_key(F.col("r.source")).alias("src"), entity_key(F.col("r.target")).alias("dst"),
        norm_type(F.col("r.type")).alias("type"), strip(F.col("r.description")).alias("description"), F.col("r.strength").alias("strength"),
    )


def valid_relationships(rels: DataFrame, entities: DataFrame, by=("doc_id",)) -> DataFrame:
    """Those whose ends were both extracted and differ."""
    by = list(by)
    known = entities.select(*by, "key").distinct()
    return (
        rels.where("src <> dst")
        .join(known.withColumnRenamed("key", "src"), [*by, "src"], "left_semi")
        .join(known.withColumnRenamed("key", "dst"), [*by, "dst"], "left_semi")
    )


def weight(strength: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), strength)) / F.lit(10.0)


def aggregate_relationships(rels: DataFrame, by=("doc_id",), cap: int = 8) -> DataFrame:
    """One row per (src, dst, type): summed weight, descriptions, chunk ids."""
    by = [*by, "src", "dst", "type"]
    texts = rels.groupBy(*by, "description").agg(F.min("seq").alias("first"), F.sum(weight(F.col("strength"))).alias("w"))
    chunks = rels.select(*by, "chunk_id").distinct().groupBy(*by).agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    return texts.groupBy(*by).agg(F.sum("w").alias("weight"), first_distinct(F.col("description"), F.col("first"), cap).alias("descriptions")).join(chunks, by)
