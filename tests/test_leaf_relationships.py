"""The best relationships of leaves against all of them, ranked plainly."""

import random


def test_against_all_relationships(spark, monkeypatch):
    """Loops, several types, hubs, leaves of many sizes, more columns; several blocks of leaves."""
    from terrace.operators import retrieval
    from terrace.plans.config import Config

    monkeypatch.setattr(retrieval, "LEAF_ROWS", 400, raising=False)
    rng = random.Random(3)
    edges = {(min(rng.randrange(60), rng.randrange(60)), rng.randrange(60), rng.choice("AB")): (rng.randrange(5) / 2, f"d{i}") for i in range(700)}
    picked = {(c, rng.randrange(70)) for c in range(40) for _ in range(rng.randrange(1, 3 + c))}
    want = set()
    for leaf in range(40):
        own = {e for c, e in picked if c == leaf}
        found = sorted((not (s in own and d in own), -w, s, d, t, x) for (s, d, t), (w, x) in edges.items() if s in own or d in own)[:4]
        want |= {(leaf, s, d, t, -w, x, not outer, r) for r, (outer, w, s, d, t, x) in enumerate(found, 1)}
    e = spark.createDataFrame([(s, d, t, w, x) for (s, d, t), (w, x) in edges.items()], "src long, dst long, type string, weight double, note string")
    p = spark.createDataFrame(sorted(picked), "community_id long, entity_id long")
    out = retrieval.leaf_relationships(p, e, Config(leaf_relationships=4)).select("community_id", "src", "dst", "type", "weight", "note", "internal", "rank")
    assert {tuple(r) for r in out.collect()} == want


def test_no_row_per_incident_relationship(spark):
    """A hub in many leaves brings its best relationships to each, not all: 300 leaves x 3000 would be 900 000 rows."""
    from pyspark.sql import functions as F

    from terrace.operators.retrieval import leaf_relationships
    from terrace.plans.config import Config

    edges = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("T").alias("type"), F.col("id").cast("double").alias("weight"))
    picked = spark.range(300).select(F.col("id").alias("community_id"), F.lit(0).cast("long").alias("entity_id"))
    out = leaf_relationships(picked, edges, Config(leaf_relationships=2))
    assert out.count() == 600 and {r.dst for r in out.collect()} == {2999, 3000}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # ranked and written, no join over all ends is left
