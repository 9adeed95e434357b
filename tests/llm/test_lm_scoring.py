"""LM scoring: exact base score by brute force, the filter against true counts, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrace.llm import lm_scoring


def brute(rows):
    toks = {}
    train = Counter()
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        toks[d] = [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
        if zlib.crc32(str(d).encode()) % 5 != 1:
            train.update(toks[d])
    n, v = sum(train.values()), len(train)
    return {d: (zlib.crc32(str(d).encode()) % 5 == 1, len(x), sum(train[w] > 0 for w in x), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for d, x in toks.items()}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        h, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.op3_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tail_join_and_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b c A", "", None, "b  c\n\td", "é É x\x1cy", "a b c", "z", "q r s"] * 3)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, place int").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    check(lm_scoring.op3_lm_scoring(spark, str(tmp_path)).collect(), rows)
    model = lm_scoring.trained(docs.where(~lm_scoring.held_out(docs["doc_id"])), bits=1 << 16, head=1)
    found = lm_scoring.scored(docs, model)
    assert sorted(found.columns) == ["base_score", "doc_id", "n_known", "n_tokens", "place", "score"]
    want = brute(rows)
    assert all(r.base_score == pytest.approx(want[r.doc_id][4]) and r.n_known == want[r.doc_id][2] for r in found.collect())
    none = lm_scoring.trained(docs.limit(0), bits=1 << 16)
    assert none.n == none.v == 0
    assert {(r.base_score, r.score) for r in lm_scoring.scored(docs, none).collect()} == {(0.0, 0.0)}
    assert lm_scoring.scored(docs.limit(0), model).count() == 0


def test_filter_has_no_false_negative(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 3} w{i % 7}") for i in range(500)], "doc_id long, text string")
    model = lm_scoring.trained(docs, bits=1 << 16)
    count = Counter(t for r in docs.collect() for t in lm_scoring.tokens(r.text))
    keys = list(count)
    got = lm_scoring.levels(lm_scoring.byte_hashes(keys), model.filter_.value, model.shards)
    want = [1 + int(math.log(count[k]) / math.log(lm_scoring.BASE)) for k in keys]
    assert all(a >= b for a, b in zip(got.tolist(), want))
    assert np.mean(got == want) > 0.7


def brute_scores(train, rows):
    """Scores by plain counts: the quantised count is the mean of all counts of its level."""
    level = lambda c: int(math.floor(math.log(c) / math.log(lm_scoring.BASE)))
    means = {}
    for c in range(1, 20_000):
        means.setdefault(level(c), []).append(c)
    about = lambda c: sum(means[level(c)]) / len(means[level(c)]) if c else 0.0
    pairs_of = lambda t: list(zip([t[-1], *t[:-1]], t))
    one, two = Counter(), Counter()
    for text in train:
        t = lm_scoring.tokens(text or "")
        one.update(t)
        two.update(pairs_of(t))
    n, v, once = sum(one.values()), len(one), sum(c == 1 for c in two.values())
    left = lambda m: sum(c * m / (c + m) for c in one.values())
    low, high = 1e-3, 1e6
    while high / low > 1 + 1e-12:
        mid = math.sqrt(low * high)
        low, high = (mid, high) if left(mid) < once else (low, mid)
    out = {}
    for d, text in rows:
        total = 0.0
        for a, b in pairs_of(lm_scoring.tokens(text or "")):
            p = (about(one[b]) + 0.5) / (n + 0.5 * (v + 1))
            total += math.log10((min(about(two[a, b]), about(one[a])) + low * p) / (about(one[a]) + low))
        out[d] = total
    return out


def texts():
    rng = random.Random(8)
    return [(i, None if i == 7 else " ".join(f"v{int(rng.expovariate(0.003))}" for _ in range(rng.randrange(80)))) for i in range(400)]


def test_scores_by_plain_counts(spark):
    """With a filter so large that false positives are rare, every score is that of the counts."""
    rows = texts() + [(1000, "never seen before"), (1001, " ".join(f"v{i % 40}" for i in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm_scoring.trained(docs.where("doc_id < 300"), bits=1 << 27)
    want = brute_scores([t for d, t in rows if d < 300], rows)
    got = {r.doc_id: r.score for r in lm_scoring.scored(docs, model).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)


def test_the_filter_grows_with_the_input(spark):
    """A bound of 2^16 bits, far below the items: nothing is cut, and the levels found through
    shards are those of the filter in one piece."""
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    large, small = lm_scoring.trained(docs, bits=1 << 24), lm_scoring.trained(docs, bits=1 << 16)
    assert small.parts is not None and small.filter_ is None and small.shards > 64
    once = Counter(p for _, t in rows for p in lm_scoring.bigrams(lm_scoring.byte_hashes(lm_scoring.tokens(t or ""))).tolist())
    once = np.array([h for h, c in once.items() if c == 1], np.uint64)
    assert len(once) > 1000 and (lm_scoring.levels(once, large.filter_.value, large.shards) >= 1).all()
    # The same filter in one piece.
    filter_ = np.zeros(small.shards * 128, np.uint8)
    for r in small.parts.collect():
        filter_[r.shard * 128 : (r.shard + 1) * 128] = np.frombuffer(r.part, np.uint8)
    assert (lm_scoring.levels(once, filter_, small.shards) >= 1).all()
    got = lm_scoring.scored(docs, small).collect()
    assert len(got) == len(rows)
    for r in got:
        block = lm_scoring.Block(pa.array([dict(rows)[r.doc_id] or ""]))
        pairs, back = block.pairs()
        p = lm_scoring.log_probabilities(block, lm_scoring.levels(block.hashes, filter_, small.shards), lm_scoring.levels(pairs, filter_, small.shards)[back], small.weight, small.n, small.v)
        assert r.score == pytest.approx(p.sum(), rel=1e-9)


def test_split():
    rng = random.Random(3)
    alphabet = "aB\x1c\x85\xa0é İ \t\n\x0b\x0c\r"
    every = ["", " ", "a", " a", "a ", "A  a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    for some in (every, every[:2], every[2:3]):
        words, codes, sizes = lm_scoring.split(pa.array(["x", *some]).slice(1))
        got = np.split(words.take(pa.array(codes)).cast(pa.binary()).to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])
        assert [x.tolist() for x in got] == [lm_scoring.tokens(t) for t in some]
    parts = list(lm_scoring._blocks([pa.array(every[:100]), pa.array(every[100:])], 20))
    assert len(parts) > 10 and [t for p in parts for t in p.to_pylist()] == every


def test_weight():
    """Half of the tokens are left to the unigrams: one history of each count from 1 to 50."""
    c = np.arange(1.0, 51)
    m = lm_scoring.unigram_weight(c, np.ones(50), c.sum() / 2)
    assert (c * m / (c + m)).sum() == pytest.approx(c.sum() / 2)


def test_hashes_of_arrow_words():
    """Each word's hash is its own, wherever it stands; words that differ in one byte, a NUL or their length differ."""
    words = ["", *("x" * n for n in range(1, 200)), *("x" * n + "\0" for n in range(200)), *(f"{'é' * (i % 40)}{i}" for i in range(20_000)), *(str(i) for i in range(20_000))]
    words = list(dict.fromkeys(words))
    got = lm_scoring.hashes(pa.array(["before", *words, "after"]).slice(1, len(words)))
    assert len(np.unique(got)) == len(words)
    assert [lm_scoring.hashes(pa.array([w]))[0] for w in words[:500]] == got[:500].tolist()
    assert (lm_scoring.byte_hashes([w.encode() for w in words]) == got).all()
    bits = np.unpackbits(got[-20_000:].view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert (abs(bits - 0.5) < 0.02).all()
    assert len(lm_scoring.hashes(pa.array([], pa.string()))) == 0


def test_known_words():
    words = pa.array(["b", "a", "", "c", "b"])
    assert np.array_equal(lm_scoring.in_known(words, (pa.array(["a", "b", ""]), np.array([1.0, 2.0, 3.0]))), [2.0, 1.0, 3.0, np.nan, 2.0], equal_nan=True)
    assert np.isnan(lm_scoring.in_known(words, (pa.array([], pa.string()), np.array([])))).all()
