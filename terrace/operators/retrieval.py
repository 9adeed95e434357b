"""Top-down retrieval over the community forest as one plan of joins and windows.

The sequential walk needs no state: whether a child is forced depends on its
siblings alone, first-in-first-out order is (depth, path of sibling ranks),
and both caps cut a prefix of that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.functions.text import excerpt
from terrace.plans.config import Config
from terrace.plans.scratch import dropped, written

#: Rows of leaves and relationships that are ranked at once.
LEAF_ROWS = 2**24


def top_level(scored: DataFrame, config: Config) -> DataFrame:
    """The best top communities of (id, parent_id, score, ...), with ``selected``
    and ``forced``: those at the threshold, or if none, the first few within the margin of the best."""
    tops = scored.where("parent_id IS NULL").orderBy(F.desc("score"), "id").limit(config.retrieval_top_k)
    every = Window.partitionBy()  # over top_k rows
    order = Window.orderBy(F.desc("score"), "id")
    out = tops.withColumn("best", F.max("score").over(every)).withColumn("rank", F.row_number().over(order))
    none = F.col("best") < config.retrieval_threshold
    close = (F.col("score") >= F.col("best") - config.retrieval_margin) & (F.col("rank") <= config.retrieval_min_top)
    return out.withColumn("selected", F.when(none, close).otherwise(F.col("score") >= config.retrieval_threshold)).withColumn("forced", none & close).drop("best")


def ranked_children(scored: DataFrame, config: Config) -> DataFrame:
    """Children with their rank among siblings and the forced flag."""
    order = Window.partitionBy("parent_id").orderBy(F.desc("score"), "id")
    kids = scored.where("parent_id IS NOT NULL").withColumn("rank", F.row_number().over(order))
    best = F.max("score").over(Window.partitionBy("parent_id"))
    return kids.withColumn("forced", (best < config.retrieval_threshold) & (F.col("rank") == 1))


def walk(scored: DataFrame, config: Config, max_depth: int = 12) -> DataFrame:
    """Every community that the walk would reach without caps, in order:
    (id, score, forced, accepted, depth, path, ord)."""
    seeds = top_level(scored, config).where("selected").withColumn("depth", F.lit(0)).withColumn("path", F.array(F.col("rank")))
    accepted = (F.col("score") >= config.retrieval_threshold) | F.col("forced")
    columns = ["id", "parent_id", "score", "forced", "depth", "path"]
    level = written(seeds.select(columns).withColumn("accepted", accepted))
    kids = written(ranked_children(scored, config).select("id", "parent_id", "score", "forced", "rank"))
    out = level
    for depth in range(1, max_depth + 1):
        above = level.where("accepted").select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = kids.join(above, "parent_id").select("id", "parent_id", "score", "forced", F.lit(depth).alias("depth"), F.concat("above", F.array("rank")).alias("path")).withColumn("accepted", accepted)
        level = written(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    # A visit cap bounds what is numbered: rows beyond it never count.
    first = out.orderBy("depth", "path").limit(config.retrieval_max_visits)
    return first.withColumn("ord", F.row_number().over(Window.orderBy("depth", "path")))


def within_budget(visits: DataFrame, charges: DataFrame, config: Config) -> DataFrame:
    """The visits before which the characters charged so far are under the
    budget.  charges: (id, chars) per accepted visit."""
    order = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = visits.join(charges, "id", "left").withColumn("spent", F.coalesce(F.sum(F.when(F.col("accepted"), F.coalesce("chars", F.lit(0)))).over(order), F.lit(0)))
    return spent.where(F.col("spent") < config.context_chars).drop("chars")


def leaf_entities(leaves: DataFrame, membership: DataFrame, scores: DataFrame, config: Config) -> DataFrame:
    """(community_id, entity_id, score, rank): the best entities of each leaf."""
    order = Window.partitionBy("community_id").orderBy(F.desc("score"), "entity_id")
    own = membership.join(leaves.select(F.col("id").alias("community_id")), "community_id", "left_semi").join(scores, "entity_id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.leaf_entities)


def leaf_relationships(picked: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """The best relationships at the picked entities of each leaf: inner ones
    first, then by weight.

    What is not inner and among the best k of a leaf is also among the best k of its end, so
    each entity brings k relationships and not all.  The leaves are ranked in blocks of
    ``LEAF_ROWS`` such rows, so that the shuffle of a block is the most that lies on disk."""
    k, edge = config.leaf_relationships, ["src", "dst", "type", "weight"]
    ids = written(picked.select("community_id", "entity_id").distinct())
    known = written(edges.select(*edge))
    best = [F.desc("weight"), "src", "dst", "type"]

    def top(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("entity_id").orderBy(*best)
        return written(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"))

    out_, in_ = top(known.select(F.col("src").alias("entity_id"), *edge)), top(known.where("src <> dst").select(F.col("dst").alias("entity_id"), *edge))
    both = top(out_.unionByName(in_))
    own = written(both.groupBy("entity_id").agg(F.collect_list(F.struct(*edge)).alias("edges")))
    dropped(out_, in_, both)
    inner = _inner(ids, known)
    blocks = max(1, -(-ids.count() * k // LEAF_ROWS))
    order = Window.partitionBy("community_id").orderBy(F.desc("internal"), *best)
    out = None
    for b in range(blocks):
        here = F.pmod(F.xxhash64("community_id"), F.lit(blocks)) == b
        rows = ids.where(here).join(own, "entity_id").select("community_id", "edges", F.lit(False).alias("internal"))
        rows = rows.unionByName(inner.where(here).select("community_id", F.array(F.struct(*edge)).alias("edges"), F.lit(True).alias("internal")))
        rows = rows.repartition("community_id").select("community_id", F.explode("edges").alias("e"), "internal").select("community_id", "e.*", "internal")
        rows = rows.groupBy("community_id", *edge).agg(F.max("internal").alias("internal"))
        part = written(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        out = part if out is None else out.unionByName(part)
    dropped(ids, own, inner, known)
    more = [c for c in edges.columns if c not in edge]
    return out.join(edges.drop("weight"), ["src", "dst", "type"]) if more else out


def _inner(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationships with both ends in a leaf.  Each entity looks through its relationships
    or through the leaf's members at which one ends, whichever are fewer."""
    ends = written(ids.withColumnRenamed("entity_id", "dst").join(edges.select("dst").distinct(), "dst", "left_semi"))
    size = ends.groupBy("community_id").agg(F.count("*").alias("size"))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    starts = written(ids.withColumnRenamed("entity_id", "src").join(size, "community_id").join(degree, "src"))
    by_edge = starts.where("degree <= size").select("community_id", "src").join(edges, "src").join(ends, ["community_id", "dst"], "left_semi")
    by_leaf = starts.where("degree > size").select("community_id", "src").join(ends, "community_id").join(edges, ["src", "dst"])
    out = written(by_edge.unionByName(by_leaf))
    dropped(ends, starts)
    return out


def chunk_relevance(mentions: DataFrame, picked: DataFrame) -> DataFrame:
    """(chunk_id, score, entity_ids): positive scores of the picked entities that a chunk mentions."""
    best = picked.groupBy("entity_id").agg(F.max("score").alias("score"))
    return mentions.select("chunk_id", "entity_id").distinct().join(best, "entity_id").groupBy("chunk_id").agg(F.sum(F.greatest(F.lit(0.0), "score")).alias("score"), F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))


def top_chunks(relevance: DataFrame, chunks: DataFrame, picked: DataFrame, entities: DataFrame, config: Config) -> DataFrame:
    """The best chunks with an excerpt around the best mentioned name that occurs in them."""
    best = relevance.orderBy(F.desc("score"), "chunk_id").limit(config.source_chunks)
    names = picked.groupBy("entity_id").agg(F.max("score").alias("s")).join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    each = best.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "index", "text"), "chunk_id").withColumn("entity_id", F.explode("entity_ids")).join(names, "entity_id")
    hit = F.when(F.instr(F.lower("text"), F.lower("name")) > 0, F.struct((-F.col("s")).alias("s"), "entity_id", "name"))
    out = each.groupBy("chunk_id", "doc_id", "index", "text", "score", "entity_ids").agg(F.min(hit)["name"].alias("name"))
    return out.withColumn("excerpt", excerpt(F.col("text"), F.col("name"), config.excerpt_chars)).drop("name", "text")


def cited_nodes(cited: DataFrame, items: DataFrame) -> DataFrame:
    """(answer_id, node_ids): the sorted distinct nodes behind the labels that an answer
    cites.  cited: (answer_id, label); items: (answer_id, label, node_ids).  Labels without an item count for nothing."""
    nodes = items.join(cited.select("answer_id", "label").distinct(), ["answer_id", "label"]).select("answer_id", F.explode("node_ids").alias("node"))
    return nodes.groupBy("answer_id").agg(F.sort_array(F.collect_set("node")).alias("node_ids"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


@dataclass
class Packed:
    """Greedy packing with skips over a few hundred collected rows."""

    budget: int

    def items(self, blocks):
        """blocks: (kind letter, node ids, title, text) in order of preference.  A block that does not fit is skipped, its number stays used."""
        used, numbers, out = 0, {}, []
        for kind, nodes, title, text in blocks:
            numbers[kind] = numbers.get(kind, 0) + 1
            block = f"[{kind}{numbers[kind]}] {text}"
            if used + len(block) <= self.budget:
                used += len(block)
                out.append({"label": f"{kind}{numbers[kind]}", "node_ids": nodes, "title": title, "text": block})
        return out


__all__ = ["Packed", "chunk_relevance", "cited_nodes", "leaf_entities", "leaf_relationships", "ranked_children", "top_chunks", "top_level", "verdict_counts", "walk", "within_budget"]
