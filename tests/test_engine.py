"""The facade end to end with the offline model: ingest, communities, question, dataset, stream."""

import pytest

from terrace.engine import Engine
from terrace.operators.components import components
from terrace.providers import OfflineProvider


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("engine")
    (d / "in").mkdir()
    (d / "in/a.txt").write_text("Alice Smith met Bob Jones in Paris. " * 10 + "\n\nThe Louvre Museum is in Paris. Carol White works at Acme Corp. " * 20)
    (d / "in/b.md").write_text("Paris hosts the Louvre Museum. Alice Smith likes it. " * 5)
    (d / "in/c.txt").write_text("short")
    return Engine(spark, f"file://{d}/store", OfflineProvider()), d


def test_ingest_to_answer(engine, spark):
    e, d = engine
    from terrace.streaming.ingest import watch

    watch(e, f"file://{d}/in", f"file://{d}/state").awaitTermination()
    docs = {r.name: r for r in e.documents().collect()}
    assert docs["a.txt"].status == docs["b.md"].status == "done" and docs["c.txt"].status == "failed"
    edges = e.store.read("related").collect()
    assert edges and all(r.src != r.dst for r in edges) and len({(r.src, r.dst, r.type) for r in edges}) == len(edges)
    before = sorted((r.key, r.mention_count) for r in e.store.read("entities").collect())
    e.ingest(spark.read.format("binaryFile").load(f"file://{d}/in").select("path", "length", "content"))
    assert sorted((r.key, r.mention_count) for r in e.store.read("entities").collect()) == before  # known contents change nothing
    stats = e.rebuild_communities()
    leaves = e.store.read("entity_community").collect()
    assert len(leaves) == len(before) and stats["communities"] >= 1
    first = {r.id: r.summary for r in e.store.read("communities").collect()}
    e.rebuild_communities()
    assert {r.id: r.summary for r in e.store.read("communities").collect()} == first
    out = e.answer("Where is the Louvre Museum?")
    assert out["context"] and set(out["citations"]) <= {i["label"] for i in out["context"]} and out["trace"]
    with pytest.raises(ValueError):
        e.answer("?")


def test_dataset(engine):
    e, d = engine
    (d / "t.csv").write_text('id;name;when;;x;x\n007;Ann;2024-01-02;;1,5;true\n8;Bob;2024-01-03;;;\n;;;;;\n9;"C; D";2024-02-03 10:00;;2.5;false\n')
    ds = e.add_dataset(f"file://{d}/t.csv")
    assert e.add_dataset(f"file://{d}/t.csv") == ds
    e.describe_dataset(ds, "a small table of people", {0: "the key"})
    row = e.datasets().head()
    assert (row.status, row.row_count, row.column_count) == ("ready", 3, 6) and [c.name for c in row.columns] == ["id", "name", "when", "column_4", "x", "x_2"]
    assert [c.dtype for c in row.columns] == ["integer", "text", "datetime", "empty", "mixed", "boolean"] and row.columns[0].description == "the key"
    e.delete_dataset(ds)
    assert e.datasets().count() == 0


def test_guard(engine):
    e, _ = engine
    if not e.store.read("entities").isEmpty():
        with pytest.raises(ValueError):
            e.store.guard("another")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i % 10 != 9] + [(5, 5), (40, 41), (41, 40)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(30)} | {40: 40, 41: 40}
    assert components(edges.limit(0)).count() == 0


class Scripted(OfflineProvider):
    """Extractions by text, one merge of what it is shown."""

    def __init__(self, answers, fail=()):
        super().__init__()
        self.answers, self.fail = answers, fail

    def generate(self, text, task, *more):
        if task == "extraction":
            if any(x in text for x in self.fail):
                raise RuntimeError("down")
            return next((v for k, v in self.answers.items() if k in text), {"entities": [], "relationships": []})
        return super().generate(text, task, *more)


def _said(names, rels=()):
    return {"entities": [{"name": n, "type": "T", "description": n} for n in names], "relationships": [{"source": a, "target": b, "type": "R", "description": "", "strength": 5} for a, b in rels]}


def test_relationships_hold_within_a_document(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first document, long enough to be read")
    (tmp_path / "in/b.txt").write_text("second document, long enough to be read")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in").select("path", "length", "content")
    answers = {"first": _said(["Ann", "Bob"], [("Ann", "Bob"), ("Ann", "Cid")]), "second": _said(["Cid"], [("Ann", "Cid")])}
    e = Engine(spark, f"file://{tmp_path}/store", Scripted(answers))
    out = e.ingest(files)
    assert out["dropped_relationships"] == 2
    names = {r.id: r.name for r in e.store.read("entities").collect()}
    assert [(names[r.src], names[r.dst]) for r in e.store.read("related").collect()] == [("Ann", "Bob")]


def test_answers_survive_a_failure(spark, tmp_path):
    import dataclasses

    from terrace.plans.config import LOCAL

    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / f"in/{i}.txt").write_text(f"document number {i}, long enough to be read")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in").select("path", "length", "content")
    e = Engine(spark, f"file://{tmp_path}/store", Scripted({}, fail=("number 3",)), dataclasses.replace(LOCAL, extract_block=1))
    with pytest.raises(Exception):
        e.ingest(files)
    assert 0 <= e.store.answers().count() < 6
    e.provider = Scripted({})
    e.extract()
    assert e.store.answers().count() == 6 and e.store.read("chunks").where("extraction IS NULL").isEmpty()


def test_files_over_the_limit_fail(spark):
    from terrace.sources.documents import extracted

    files = spark.createDataFrame([("/a.txt", 5, bytearray(b"small")), ("/b.txt", 900, bytearray(b"x" * 900))], "path string, length long, content binary")
    got = {r.name: (r.text, r.error) for r in extracted(files, 1, 100).collect()}
    assert got == {"a.txt": ("small", None), "b.txt": (None, "more than 100 bytes")}


def test_integers_of_any_length(spark):
    from pyspark.sql import functions as F

    from terrace.functions.cells import parse_cell, parse_values

    df = spark.createDataFrame([("9" * n,) for n in (5, 4300, 4301, 9000)] + [("-" + "9" * 5000,)], "v string")
    kinds = [(r.a, r.b) for r in df.select(parse_values("v")["kind"].alias("a"), parse_cell(F.col("v"))["kind"].alias("b")).collect()]
    assert kinds == [("integer", "integer")] * 2 + [("float", "float")] * 3


def test_texts_of_moved_edges_come_last(spark):
    from terrace.operators import resolution

    entities = spark.createDataFrame([("a", "ka", "A", "T", ["x"], 3), ("b", "kb", "B", "T", ["y"], 1), ("c", "kc", "C", "T", ["z"], 1)], "id string, key string, name string, type string, descriptions array<string>, mention_count bigint")
    edges = spark.createDataFrame([("a", "c", "R", 1.0, ["z first"], ["1"]), ("b", "c", "R", 1.0, ["a second"], ["2"])], "src string, dst string, type string, weight double, descriptions array<string>, chunk_ids array<string>")
    moves = spark.createDataFrame([("b", "a")], "id string, survivor string")
    none = spark.createDataFrame([], "chunk_id string, entity_id string")
    out = resolution.apply_merges(moves, entities, edges, none, spark.createDataFrame([], "key string, entity_id string"))
    assert [tuple(r) for r in out[1].select("src", "dst", "weight", "descriptions").collect()] == [("a", "c", 2.0, ["z first", "a second"])]


def test_groups_by_size(spark):
    from terrace.operators.resolution import by_size

    groups = spark.createDataFrame([(["a", "b"],), (["c", "d", "e"],), (["a", "a2"],)], "members array<string>")
    assert [r.members for r in by_size(groups).collect()] == [["c", "d", "e"], ["a", "a2"], ["a", "b"]]


def test_packing_skips_what_does_not_fit():
    from terrace.operators.retrieval import Packed

    blocks = [("S", ["a"], "t", "x" * 10), ("C", ["b"], "t", "y" * 100), ("C", ["c"], "t", "z" * 5), ("E", [], "t", "w" * 10)]
    made = Packed(30).items(blocks)
    assert [(x["label"], len(x["text"])) for x in made] == [("S1", 15), ("C2", 10)]
    assert made[1]["node_ids"] == ["c"]
    assert Packed(0).items(blocks) == []
    assert Packed(30).items([]) == []


def test_nothing_cited(spark):
    from terrace.operators.retrieval import cited_nodes

    items = spark.createDataFrame([(1, "C1", ["b", "a"]), (1, "S1", ["a", "c"]), (2, "C1", ["z"])], "answer_id int, label string, node_ids array<string>")
    cited = spark.createDataFrame([(1, "S1"), (1, "C1"), (1, "C1"), (1, "E9"), (3, "C1")], "answer_id int, label string")
    assert [tuple(r) for r in cited_nodes(cited, items).collect()] == [(1, ["a", "b", "c"])]
    assert cited_nodes(cited.limit(0), items).count() == 0


def _line(spark, n, copies):
    """``n`` vectors in a plane and ``copies`` of one of them."""
    import math

    rows = [(f"v{i:03}", [math.cos(0.01 * i * i), math.sin(0.01 * i * i), 0.5]) for i in range(n)]
    return spark.createDataFrame(rows + [(f"w{i:03}", rows[0][1]) for i in range(copies)], "id string, embedding array<float>")


def test_neighbours_of_copies(spark):
    """A row among more copies than k, with lower ids, gets k of them and not k + 1."""
    from terrace.operators.resolution import neighbours

    v = _line(spark, 5, 12)
    got = neighbours(v, v, 5, 0.9).where("src = 'w009'").orderBy("dst").collect()
    assert [r.dst for r in got] == ["v000", "w000", "w001", "w002", "w003"]


def test_neighbours_hold_one_tile():
    """Many queries against many rows take the memory of a tile, not of all products."""
    import tracemalloc

    import numpy as np

    from terrace.operators.resolution import _Nearest

    q = np.random.default_rng(0).standard_normal((20_000, 8)).astype(np.float32)
    tracemalloc.start()
    best = _Nearest(np.arange(len(q)), q, 3, -1.0)
    for lo in range(0, 4096, 2048):
        best.add(np.arange(lo, lo + 2048), q[lo : lo + 2048])
    assert tracemalloc.get_traced_memory()[1] < 150e6  # all products of 20 000 x 2048 are 328 MB in double precision
    tracemalloc.stop()
    some = q[:50] / np.linalg.norm(q[:50], axis=1, keepdims=True)
    want = np.argsort(-(some @ (q[:4096] / np.linalg.norm(q[:4096], axis=1, keepdims=True)).T), axis=1)[:, :3]
    assert (best.near[:50] == want).all()


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The small tables, with a vector that occurs twelve times and ones near it."""
    import os

    import duckdb

    d = tmp_path_factory.mktemp("copies")
    for f in os.listdir("/root/testdata/sf0.001"):
        if f != "embeddings.parquet":
            os.symlink(f"/root/testdata/sf0.001/{f}", d / f)
    one = "list_transform(range(8), lambda j: CAST(CASE WHEN i % 3 = 0 THEN j + 1 ELSE sin(i * 1.7 + j * (i % 7)) END AS FLOAT))"
    duckdb.sql(f"COPY (SELECT i AS vec_id, {one} AS embedding, CAST(i % 4 AS INT) AS label FROM range(36) t(i)) TO '{d}/embeddings.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["candidate_groups"])
def test_copies_as_in_sql(name, copies, same_as_sql):
    from terrace.queries import ORACLE_SQL, QUERIES

    same_as_sql(QUERIES[name], ORACLE_SQL[name], copies)


def test_groups_of_copies_meet_few_others(spark, monkeypatch):
    """600 rows whose nearest five are the same: the join of groups makes a row a member, not one a pair of groups."""
    from pyspark.sql import functions as F

    from terrace.operators import resolution

    near = spark.range(600).withColumnRenamed("id", "src").crossJoin(spark.range(6).select(F.col("id").alias("dst"))).where("src <> dst")
    near = near.where("dst < 5 OR src < 5").withColumn("score", F.lit(1.0)).union(spark.createDataFrame([(1000, 1001, 0.5), (1001, 1000, 0.5), (1001, 1002, 0.4)], "src long, dst long, score double"))
    got = {tuple(r.members) for r in resolution.candidate_groups(near).collect()}
    assert got == {(0, 1, 2, 3, 4, i) for i in range(5, 600)} | {(1000, 1001, 1002)}
    met = []
    monkeypatch.setattr(resolution, "_meetings", lambda groups, f=resolution._meetings: met.append(f(groups)) or met[-1])
    resolution.candidate_groups(near)
    assert met[0].count() <= 600 * 6  # by first members: 595 * 595


@pytest.mark.parametrize("name", ["connected_merge_map", "leiden_communities", "node_merge"])
def test_workers_stay_small(name, spark, tmp_path):
    """The Python workers hold tiles of the products of 8000 vectors: 512 MB in double precision."""
    import threading
    import time

    import duckdb
    import psutil

    from terrace.queries import QUERIES

    one = "list_transform(range(8), lambda j: CAST(sin(i * 1.7 + j * (i % 97)) AS FLOAT))"
    duckdb.sql(f"COPY (SELECT i AS vec_id, {one} AS embedding, CAST(i % 4 AS INT) AS label FROM range(8000) t(i)) TO '{tmp_path}/embeddings.parquet'")
    most, over = [0.0], threading.Event()

    def watch():
        while not over.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        most[0] = max(most[0], p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert QUERIES[name](spark, str(tmp_path)).count() > 0
    finally:
        over.set()
        watcher.join()
    assert 0 < most[0] < 700


def alike(n, dim):
    """Vectors that all have cosines of some 0.5 with each other."""
    import numpy as np

    rng = np.random.default_rng(3)
    return (rng.normal(0, 1, dim) + rng.normal(0, 1, (n, dim))).astype(np.float32)


def test_pairs_of_long_vectors_are_scored_in_pieces():
    """13 000 pairs or more of 2048 x 2048 rows: 100 MB in double precision for each of their operands and sums."""
    import tracemalloc

    import numpy as np

    from terrace.operators import resolution

    x = alike(2048, 1024)
    tracemalloc.start()
    try:
        best = resolution._Nearest(np.arange(len(x)), x, 6, 0.33)
        best.add(np.arange(len(x)), x)
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert most < 150
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = np.argsort(-(unit[:50] @ unit.T), axis=1)[:, :6]
    assert (best.near[:50] == want).all()


@pytest.mark.parametrize("name", ["connected_merge_map", "node_merge"])
def test_workers_stay_small_with_long_vectors(name, spark, tmp_path):
    """3000 vectors of 1024 numbers (12 MB), all alike: a worker holds a block of them and pieces of their products."""
    import threading
    import time

    import numpy as np
    import psutil
    import pyarrow as pa
    import pyarrow.parquet as pq

    from terrace.queries import QUERIES

    x = alike(3000, 1024)
    lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 1024, dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(3000), "embedding": lists, "label": np.arange(3000, dtype=np.int32) % 4}), f"{tmp_path}/embeddings.parquet")
    most, over = [0.0], threading.Event()

    def watch():
        while not over.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        most[0] = max(most[0], p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        QUERIES[name](spark, str(tmp_path)).count()
    finally:
        over.set()
        watcher.join()
    assert 0 < most[0] < 350


@pytest.mark.parametrize("name", ["node_merge"])
def test_merges_write_the_vectors_once(name, spark, monkeypatch):
    """Beside the two tables of different vectors of ``neighbours``, no copy of the input is written."""
    from terrace import queries
    from terrace.operators import resolution

    made = []
    for module in (queries, resolution):
        monkeypatch.setattr(module, "written", lambda df, f=module.written: made.append("embedding" in df.columns) or f(df))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert sum(made) == 2
