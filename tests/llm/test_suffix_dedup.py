"""Suffix-array dedup against every substring of every text."""

import hashlib
import random
from collections import Counter

import pytest

from terrace.llm import suffix_dedup


def brute(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, scale):
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(scale), text(2 * scale), text(8 * scale), "xy" * (3 * scale)]
    rows = [(None, None), (1, ""), (2, "short"), (3, "a" * (12 * scale)), (3, "ab" * (10 * scale))]
    for i in range(60):
        parts = [text(rng.randrange(0, 3 * scale))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(len(p))], text(rng.randrange(0, scale))]
        rows.append((10 + i, " ".join(parts)))
    whole = text(10 * scale)
    rows += [(100 + i, whole) for i in range(4)]
    for i in range(12):
        at = rng.randrange(len(whole))
        rows.append((200 + i, whole[:at] + "#" + whole[at + 1 :]))
    return rows


@pytest.mark.parametrize("seed,length,k,group,block", [(1, 200, 32, 2048, 2_000_000), (2, 40, 8, 2048, 3000), (3, 40, 8, 2, 2_000_000), (4, 40, 8, 1, 500)])
def test_every_substring(spark, seed, length, k, group, block):
    rows = corpus(random.Random(seed), length // 5)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, h int, doc string").repartition(4)
    got = suffix_dedup.removed(docs, length=length, k=k, group=group, block=block).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=repr)
    assert got == brute(rows, length)


@pytest.mark.parametrize("length", [5, 12, 40])
def test_factors(length):
    """Longest previous and next factors against every pair of suffixes."""
    rng = random.Random(length)
    for _ in range(6):
        base = "".join(rng.choice("ab") for _ in range(60)).encode()
        segments = [(rng.randrange(2), b"".join(base[rng.randrange(40) :][: rng.randrange(1, 25)] for _ in range(rng.randrange(1, 5)))) for _ in range(8)]
        starts, previous, following = suffix_dedup.factors(segments, length)
        assert starts.tolist() == [sum(len(b) for _, b in segments[:i]) for i in range(len(segments) + 1)]
        places = [(g, b[i:]) for g, b in segments for i in range(len(b))]
        cut = suffix_dedup.Suffixes([b for _, b in segments], length).ranks[-1][0]

        def common(x, y):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return min(n, cut)

        for i, (g, x) in enumerate(places):
            for got, others in ((previous[i], places[:i]), (following[i], places[i + 1 :])):
                want = max((common(x, y) for f, y in others if f == g), default=0)
                assert got == (want if want >= length else 0)


def test_nearest_smaller():
    rng = random.Random(1)
    import numpy as np

    values = np.array(rng.sample(range(500), 300))
    first = np.array([i - i % 40 for i in range(300)])
    want = [max((j for j in range(first[i], i) if values[j] < values[i]), default=-1) for i in range(300)]
    assert suffix_dedup.nearest_smaller(values, first).tolist() == want


def test_very_long_text(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, text), (2, "-" * 150 + text[1000:1500]), (3, text[200_000:200_150])]
    got = {r.doc_id: r for r in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(500, 1), (500, 1), (0, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removed(docs).count() == 0


def test_keep_first(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdef ") for _ in range(900))
    rows = [(i, f"{i}" * 30 + base + "-" * i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [bytes(r.kept) for r in suffix_dedup.removed(docs, keep_first=True).collect()]
    assert sum(base.encode()[300:600] in k for k in kept) == 1


def test_keep_first_of_equal_texts(spark):
    """Copies of a whole text, with equal and null ids: one row keeps it, and a passage of it in another text goes or stays once."""
    rng = random.Random(3)
    whole, other = ("".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(2))
    rows = [(None, whole), (4, whole), (4, whole), (9, whole), (None, other), (None, other), (1, "short"), (2, "short"), (3, "x" + whole[:500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.removed(docs, keep_first=True).collect()
    kept = [bytes(r.kept) for r in found]
    assert len(kept) == len(rows) and kept.count(b"short") == 2
    assert kept.count(other.encode()) == 1
    assert sum(whole[100:400].encode() in k for k in kept) == 1
    assert sum(whole[450:].encode() in k for k in kept) <= 1 and sum(whole[500:].encode() in k for k in kept) == 1
    assert sum(r.n_removed == 700 and r.n_spans == 1 for r in found) == 4


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, suffix_dedup.op9_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows, 200)
