"""Cells, keys, chunks and headers on hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.functions.cells import parse_cell, parse_values
from terrace.functions.text import clean_text, entity_key, excerpt, norm_type
from terrace.operators.chunking import packed, pieces
from terrace.sources.tables import header, sniffed

CELLS = {
    "007": ("integer", "7"), "1_000": ("integer", "1000"), "1,234.5": ("float", "1234.5"), "1,234": ("text", "1,234"), "1e5": ("integer", "100000"), "nan": ("float", "nan"),
    "TRUE": ("boolean", "True"), "2024/01/02": ("datetime", "2024-01-02"), "2024-01-02 03:04": ("datetime", "2024-01-02 03:04:00"), "2024-13-02": ("text", "2024-13-02"),
    "+5": ("integer", "5"), "-0": ("integer", "0"), ".5": ("float", "0.5"), "5.": ("integer", "5"), "abc": ("text", "abc"), "1__0": ("text", "1__0"), "1e-7": ("float", "1e-07"), "12345.65": ("float", "12345.6"),
}


def test_cells(spark):
    df = spark.createDataFrame([(v,) for v in CELLS], "v string")
    for r in df.select("v", parse_values("v").alias("a"), parse_cell(F.col("v")).alias("b")).collect():
        assert (r.a.kind, r.a.shown) == CELLS[r.v]
        assert r.b.kind == CELLS[r.v][0] and (r.b.shown or "%.6g" % r.b.number) == CELLS[r.v][1]
    assert spark.createDataFrame([("  ",), ("",), (None,)], "v string").select(parse_cell(F.col("v")).alias("c")).where("c IS NOT NULL").isEmpty()


def test_names_and_types(spark):
    names = {"The Foo": "foo", "foo.": "foo", "“Foo”": "foo", "Ｆｏｏ": "foo", "a b c": "b c", "": "", "a  an b": "an b"}
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", entity_key(F.col("n")).alias("k")).collect()}
    assert got == names
    kinds = {"a-b c": "A_B_C", "--": "OTHER", None: "OTHER"}
    assert {r.t: r.k for r in spark.createDataFrame([(t,) for t in kinds], "t string").select("t", norm_type(F.col("t")).alias("k")).collect()} == kinds


def test_clean_and_excerpt(spark):
    t = " a\r\nb\0c\t\t d inter-\nnational\n\n\n\nX  "
    row = spark.createDataFrame([(t,)], "t string").select(clean_text(F.col("t")).alias("c"), excerpt(F.lit("x" * 50 + "Name" + "y" * 50), F.lit("nAME"), 20).alias("e")).head()
    assert row.c == "a\nbc d international\n\nX"
    assert row.e == "…" + "x" * 6 + "Name" + "y" * 10 + "…"


def test_headers():
    assert header(["id", "", " id ", "name", "id", None]) == ["id", "column_2", "id_2", "name", "id_3", "column_6"]
    assert sniffed("a;b\n1;2\n".encode(), True) == ("utf-8", ";")
    assert sniffed("é".encode()[:1], False)[0] == "utf-8" and sniffed(b"\xff,\n", True)[0] == "iso-8859-1"


@pytest.mark.parametrize("seed", range(5))
def test_chunks(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "x" * 70]) for _ in range(400)).strip()
    size, overlap = 60, 15
    assert "".join(pieces(text, size)) == text and max(map(len, pieces(text, size))) <= size
    last = 0
    for at, body in packed(text, size, overlap):
        assert len(body) <= size + overlap and body == text[at:].lstrip()[: len(body)] and at >= last
        last = at
    assert list(packed("", size, overlap)) == []


def test_profile(spark):
    from terrace.operators.profile import profile, without_artefacts

    rows = [(str(i), "x" if i % 2 else "y", None, f"{i}.5" if i == 9 else str(i), "ab" if i > 7 else str(i)) for i in range(10)] + [(None,) * 5]
    p = {r.name: r for r in without_artefacts(profile(spark.createDataFrame(rows, "a string, b string, c string, d string, e string").withColumn("column_6", F.lit(None).cast("string")), True)).collect()}
    assert "column_6" not in p and p["a"].is_unique and p["a"].dtype == "integer" and p["a"].null_pct == 0.0
    assert p["b"].categories == ["x", "y"] and p["b"].top_values == ["x (5)", "y (5)"] and not p["b"].is_unique
    assert p["c"].dtype == "empty" and p["d"].dtype == "float" and p["e"].dtype == "mixed" and p["a"].mean == 4.5 and p["d"].max == "9.5"
