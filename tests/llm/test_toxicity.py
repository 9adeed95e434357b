"""Toxicity: the automaton against plain scanning, folding, exceptions and held-out accuracy."""

import random

from pyspark.sql import functions as F

from terrace.llm import toxicity as T


def plain(words, entries):
    text = T.line(words)
    found = [(i, i + len(e) - 1, w) for e, w in entries for i in range(len(text)) if text.startswith(e, i)]
    best = {}
    for a, b, w in found:
        if w > 0 and not any(x < 0 and p <= a and b <= q for p, q, x in found):
            best[a] = max(w, best.get(a, 0))
    return sum(best.values())


def test_hits_against_scanning():
    rng = random.Random(1)
    entries = [(" ab", 2.0), (" abc ", 3.0), (" ba", 1.5), (" c ", 1.0), (" abca", -1.0), (" ba  c ", -1.0), (" cc  ab", -1.0)]
    lexicon = T.Lexicon(tuple(entries))
    a = lexicon.automaton()
    for _ in range(500):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 12))]
        assert T.hits(words, a) == plain(words, entries)


def test_folding():
    for w in ("1d10t", "IDIOT!!", "idiоt", "i​diot", "ＩＤＩＯＴ", "idiot###", "!d!ot"):
        assert T.folded(w).replace("!", "i") in ("idiot", "diot"), w
    assert T.folded("1050") == "1050"
    assert T.folded_words(None) == [] and T.folded_words(" ### ") == []


def test_prior_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you are an 1d10t , scum", 9), (1, "a trash can", 9), (None, None, 9), (3, "", 9), (4, "calm words " * 30, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    lexicon = T.trained(docs, labels)
    got = [(r.doc_id, r.score) for r in T.scored(docs, lexicon).collect()]
    low = min(s for _, s in got)
    assert [s > T.THRESHOLD for _, s in got] == [True, False, False, False, False] and got[2][1] == got[3][1] == low
    assert T.scored(docs.limit(0), lexicon).count() == 0


def test_every_entry_has_its_exceptions(spark):
    known = [f" q{i:03d}" for i in range(300)]
    sums = spark.createDataFrame([(f"{f}ly ", 30, 0, -3.0) for f in known] + [(f, 0, 30, 3.0) for f in known] + [(" other ", 30, 0, -3.0)], "f string, c long, t long, w double")
    assert sorted(T._exceptions(sums, known)) == [(f"{f}ly ", -1.0) for f in known]


def test_rare_terms_stay_with_many_labels(spark):
    """A term in 5 toxic texts is an entry beside 20 and beside 1,600 others."""
    rows = lambda n: [(i, "calm words of a day" if i % 2 else "some grotward here" + (" zyxgrub" if i < 10 else "")) for i in range(2 * n)]
    for n in (25, 1605):
        docs = spark.createDataFrame(rows(n), "doc_id long, text string")
        lexicon = T.trained(docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic")))
        assert any(e.startswith(" zyx") and w > 0 for e, w in lexicon.entries)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = T.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    c = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").agg(F.count("*").alias("count")).collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) >= 0.9
    assert c.get((0, 1), 0) / (c[0, 0] + c.get((0, 1), 0)) <= 0.02
