"""Line dedup against a plain one-process parse of the whole table."""

import random
from collections import defaultdict

import pytest

from terrace.llm import line_dedup as L


def brute(rows, leaf_lines=10**9):
    where = defaultdict(set)
    leaf_docs = defaultdict(set)
    for _, t in rows:
        for line in (t or "").split("\n"):
            m = tuple(L.masked(line))
            if len(m) >= L.MIN_TOKENS:
                where[m].add(t)
                leaf_docs[len(m), m[: L.DEPTH]].add(t)
    leaves = defaultdict(list)
    per_line = defaultdict(int)
    for t in {t for _, t in rows}:
        for line in (t or "").split("\n"):
            per_line[tuple(L.masked(line))] += 1
    for m in where:
        key = len(m), m[: L.DEPTH]
        if len(leaf_docs[key]) >= L.MIN_DOCS:
            leaves[key].append(m)
    gone = set()
    for lines in leaves.values():
        lines.sort(key=lambda m: (-per_line[m], " ".join(m)))
        found = defaultdict(set)
        made = L.templates([list(m) for m in lines])
        for m, k in zip(lines, made):
            found[k] |= where[m]
        gone |= {m for m, k in zip(lines, made) if len(found[k]) >= L.MIN_DOCS}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if tuple(L.masked(x)) not in gone]
        out.append((d, None if t is None else "\n".join(kept), 0 if t is None else len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_plain_parse(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split())
    rows = [(None, None), (1, ""), (2, "\n\n"), (2, "\n\n")]
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 6))]
        if i % 3 == 0:
            lines.append(f"order {i} was shipped to {word()} on 2024-01-{i % 28 + 1}")
        if i % 4 == 0:
            lines += ["Licensed under the Apache License"] * 2
        if i % 5 == 0:
            lines.append(f"Page generated by host{i} for user {word()} in {i} ms")
        rows.append((i + 5, "\n".join(lines)))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lines string").repartition(3)
    want = brute(rows)
    assert sum(r[3] for r in want) > 20
    assert sorted(map(tuple, L.deduplicated(docs).collect()), key=repr) == want
    assert L.deduplicated(docs.limit(0)).count() == 0


def test_split_leaves_keep_exact_repeats(spark):
    rows = [(i, f"a b c d{'xyz'[i % 3]} e f g h {w}\nLicensed under the Apache License") for i, w in enumerate("pqrstuvw")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.deduplicated(docs, leaf_lines=1).collect()}
    assert all("Licensed" not in t for t in got.values())


def test_large_leaves_keep_their_templates(spark):
    """1,500 fillings of two templates: one of short lines, one whose third token on vary."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, f"Page generated for {name()} on {name()} site\nthe first three of {name()} stay {name()} in line\nown {name()} {name()} {name()}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[3] for r in want) >= 3000
    assert sorted(map(tuple, L.deduplicated(docs).collect()), key=repr) == want
    small = rows[:200]
    assert sorted(map(tuple, L.deduplicated(spark.createDataFrame(small, docs.schema), leaf_lines=7).collect()), key=repr) == brute(small)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, L.deduplicated(docs).collect()), key=repr) == brute(rows)
