"""The n-gram Jaccard join against all pairs, compared one by one."""

import random
import re

import pytest

from terrace.llm import ngram_join


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(rng):
    """Families of copies at all distances, a passage that half of all texts hold, short and empty texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = ["", None, " \n\t", "one", "One", "one two", "two one", "a b c d", "a b c d e", "A B C d e", "a b c d e f"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
            if rng.random() < 0.5:
                w = [rng.choice(vocabulary) for _ in range(rng.randrange(20))] + passage + w[: rng.randrange(1, len(w))]
            texts += [" ".join(w)] * rng.choice([1, 1, 2])
    for _ in range(60):  # mostly the passage
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]))
    rng.shuffle(texts)
    return [(7 * i % 10_007, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,tile,hot,forests", [(1, 512, 16, 16), (2, 4, 3, 1), (3, 7, 1000, 1), (5, 30, 16, 1)])
def test_all_pairs(spark, seed, tile, hot, forests):
    rows = corpus(random.Random(seed))
    if seed == 2:
        rows += [rows[5], rows[6], (None, rows[7][1]), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, key int").repartition(5)
    got = sorted(map(tuple, ngram_join.joined(docs, tile, hot, forests=forests).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("tile,forests", [(512, 16), (40, 1)])
def test_family_of_near_misses(spark, tile, forests):
    """400 texts of one base, each with words of its own: every pair is just
    under the threshold but for three links.  What the tiles give stays far below all pairs."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for d in range(400):
        w = list(base)
        for at in rng.sample(range(8), 1):
            w[50 * at + 5 : 50 * at + 16] = [f"d{d}.{i}" for i in range(11)]
        w[rng.randrange(380) :][:12] = [f"e{d}.{i}" for i in range(12)]
        i = rng.randrange(380)
        w[i : i + 22] = [f"f{d}.{k}" for k in range(22)]
        rows.append((d, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " end") for i in (3, 77, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_join.joined(docs, tile, forests=forests).collect()), key=repr) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(2)
    words = [f"v{rng.randrange(50_000)}" for _ in range(200_000)]
    other = [w if rng.random() > 0.03 else "x" for w in words]
    rows = [(5, " ".join(words)), (2, " ".join(other)), (9, " ".join(words[:120_000])), (1, "short")]
    assert sorted(map(tuple, ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_one_of_each(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(d for d, n, c in brute(rows) if d == c)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == want
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_keeps_other_rows_of_an_id(spark):
    """Rows with a null id, and one id on two texts: only the linked row goes."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (None, base + " more"), (None, "quite another text of its own"), (None, None), (None, " "), (5, base + " again"), (5, "a clean text with the same id"), (6, "not linked at all to the others")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r for i, r in enumerate(rows) if i not in (1, 5)), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.op1_ngram_jaccard(spark, "/root/testdata/sf0.01").collect()), key=repr) == brute(rows)
