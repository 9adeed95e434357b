"""Projections, degrees, subgraphs and statistics of the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: parallel edges summed, missing weights 1."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every entity; 0 without an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    return entities.select("id").join(ends, "id", "left").select("id", F.coalesce("count", F.lit(0)).cast("long").alias("degree"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids`` (id), and whether both are (``internal``): two equi-joins, no OR."""
    src, dst = (ids.select(F.col("id").alias(c), F.lit(True).alias(f"in_{c}")).distinct() for c in ("src", "dst"))
    found = edges.join(src, "src", "left").join(dst, "dst", "left").where("in_src OR in_dst")
    return found.withColumn("internal", F.coalesce("in_src", F.lit(False)) & F.coalesce("in_dst", F.lit(False))).drop("in_src", "in_dst")


def most_connected(entities: DataFrame, edges: DataFrame, n: int = 2000) -> DataFrame:
    """The n entities of highest degree, ties by id."""
    return degrees(entities, edges).orderBy(F.desc("degree"), "id").limit(n)


def display(entities: DataFrame, edges: DataFrame, membership: DataFrame, n: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes with their community and the edges among them."""
    top = most_connected(entities, edges, n)
    return top.join(membership.select(F.col("entity_id").alias("id"), "community_id"), "id", "left"), induced(edges, top)


def graph_stats(documents: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row of counts; the tables' aggregates meet as single rows."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    comm = communities.agg(
        F.count("*").alias("communities"), F.count_if(F.col("parent_id").isNull()).alias("top_communities"), (F.coalesce(F.max("level"), F.lit(-1)) + 1).cast("long").alias("levels")
    )
    out = one(documents, "documents")
    for df in (one(chunks, "chunks"), one(entities, "entities"), one(edges, "relationships"), comm):
        out = out.crossJoin(df)  # one row each
    return out


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (node, community) of undirected edges (a, b, weight)."""
    m = membership
    inner = edges.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    total = edges.agg(F.sum("weight").alias("m"))
    within = inner.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight").join(m, "node").groupBy("community").agg(F.sum("weight").alias("d"))
    each = ends.join(within, "community", "left").crossJoin(F.broadcast(total))  # one row
    return each.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))
