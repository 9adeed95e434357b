"""Null, empty, repeated, tied and very long rows, empty tables and clashing columns."""

import hashlib
import re

from pyspark.sql import functions as F

from terrace.llm import exact_dedup, mixing, quality_rules

SCHEMA = "doc_id long, text string, source string, h string, n int, kept string, words string, __at double, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "k", "w", 0.5, "s") for r in rows], SCHEMA)


def rows():
    return [(1, None, "a"), (2, "", "a"), (None, " \n", None), (3, "x y", "b"), (3, "x y", "b"), (5, "x  y", "b"), (4, "x  y", None), (None, "z", "a"), (7, "word " * 200_000, "c")]


def decided(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    docs = frame(spark, rows()).repartition(3)
    want = decided(rows())
    assert sorted(map(tuple, exact_dedup.decisions(docs).collect()), key=repr) == want
    # Every text under one hash: the bytes tell them apart.
    one = exact_dedup.decisions(docs, lambda c: F.lit("same"))
    assert sorted(map(tuple, one.collect()), key=repr) == want
    assert exact_dedup.decisions(docs.limit(0)).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept.collect()) == [("4", "x  y"), ("7", "word"), ("None", " \n"), ("None", "z")]


def test_quality_rules(spark):
    docs = frame(spark, rows())
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judged(docs).collect()}
    assert {(1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (None, 0, 0, 0, True, False), (3, 2, 2, 0, True, False)} <= got
    assert (7, 200_000, 800_000, 200_000, True, False) in got
    assert quality_rules.judged(docs).count() == len(rows()) and quality_rules.judged(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = frame(spark, rows()).repartition(3)
    plan = mixing.mixed(docs).collect()
    assert len(plan) == len(rows())
    taken = {}
    for r in plan:
        assert 0 <= r.taken <= 2 * r["size"] and (r.taken > 0) == (r.passes is not None)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in plan)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.schedule(docs.limit(0)).count() == 0


def test_schedule_of_repeated_rows(spark):
    """Six equal rows among others: each goes by its own plan, again and again alike."""
    some = [(1, "a b c d", "s")] * 6 + [(1, "d c b a", "s"), (None, "p q r", "s"), (2, "x " * 50, "t")]
    docs = frame(spark, some).repartition(4)
    plan = mixing.mixed(docs).collect()
    want = sum(int(r.taken / max(r["size"], 1) + 0.5) for r in plan)
    first, again = ([(r.doc_id, r.text, r["__at"]) for r in mixing.schedule(x).collect()] for x in (docs, docs.repartition(2)))
    assert len(first) == want and first == again
    assert all(x[2] == 0.5 for x in first)
