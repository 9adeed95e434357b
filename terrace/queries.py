"""The queries of the engine's own operators over the given tables, and their SQL.

The tables stand in for the graph: parts are entities, consecutive lines of
an order are relationships, customers in nations in regions a forest,
embeddings the vectors, documents the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.functions import text as T
from terrace.functions import vectors as V
from terrace.functions.cells import format6, parse_cell
from terrace.operators import catalog, chunking, communities, components, extraction, graph, profile, resolution, retrieval
from terrace.plans.config import Config
from terrace.plans.scratch import written
from terrace.sources.documents import extracted
from terrace.sources.tables import header

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(a: Column) -> Column:
    return F.array_join(a, "|")


# ------------------------------------------------------------------ text and cells

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '-\n([a-z])', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query("SELECT doc_id, CAST(length(c) AS BIGINT) AS n, sha256(c) AS sha FROM (SELECT doc_id, " + _CLEAN.format(x="text") + " AS c FROM documents)")
def clean_text(spark, d):
    c = T.clean_text(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("sha"))


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim('The ' || p_name || '.')), '^[ \t"''`.,;:()\[\]{}]+|[ \t"''`.,;:()\[\]{}]+$', '', 'g'), '^(the|a|an)\s+', ''), '\s+', ' ', 'g') AS k,
       coalesce(nullif(upper(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'OTHER') AS t FROM part""")
def entity_key_norm(spark, d):
    name = F.concat(F.lit("The "), "p_name", F.lit("."))
    return _t(spark, d, "part").select("p_partkey", T.entity_key(name).alias("k"), T.norm_type(F.col("p_type")).alias("t"))


@query("""SELECT * FROM (VALUES (0, 'id'), (1, 'column_2'), (2, 'id_2'), (3, 'name'), (4, 'id_3'), (5, 'column_6')) AS t(i, name)""")
def header_normalise(spark, d):
    return spark.createDataFrame(list(enumerate(header(["id", "", " id ", "name", "id", None]))), "i int, name string")


@query(r"""
SELECT event_id, CASE WHEN v IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^[0-9]+$') THEN 'integer' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'float' WHEN regexp_matches(v, '^\d{4}-') THEN 'datetime' ELSE 'text' END AS kind
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0' || event_id WHEN 1 THEN event_id || '.5' WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN 'true' ELSE event_type END AS v FROM events)""")
def parse_cells(spark, d):
    m = F.col("event_id") % 5
    v = F.when(m == 0, F.concat(F.lit("0"), "event_id")).when(m == 1, F.concat("event_id", F.lit(".5"))).when(m == 2, F.date_format("ts", "yyyy-MM-dd")).when(m == 3, "true").otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("event_id", parse_cell(v)["kind"].alias("kind"))


@query("SELECT p_partkey, printf('%.6g', p_retailprice / 7) AS shown FROM part")
def format_six(spark, d):
    return _t(spark, d, "part").select("p_partkey", format6(F.col("p_retailprice") / 7).alias("shown"))


# ------------------------------------------------------------------ profiles

_KINDS = {
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
}


def _cell_sql(c: str, kind: str) -> str:
    whole = f"({c} = floor({c}))"
    return {
        "i": f"'integer' AS kind, CAST({c} AS VARCHAR) AS shown, CAST({c} AS DOUBLE) AS x",
        "d": f"CASE WHEN {whole} THEN 'integer' ELSE 'float' END AS kind, CASE WHEN {whole} THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE printf('%.6g', {c}) END AS shown, {c} AS x",
        "s": f"'text' AS kind, nullif(trim({c}), '') AS shown, NULL::DOUBLE AS x",
        "t": f"'datetime' AS kind, CASE WHEN strftime({c}, '%H:%M:%S') = '00:00:00' THEN strftime({c}, '%Y-%m-%d') ELSE strftime({c}, '%Y-%m-%d %H:%M:%S') END AS shown, NULL::DOUBLE AS x",
    }[kind]


def _profile_sql(table: str) -> str:
    parts = [f"SELECT {i} AS position, '{c}' AS name, {_cell_sql(c, k)} FROM {table} WHERE {c} IS NOT NULL" for i, (c, k) in enumerate(x.split(":") for x in _KINDS[table].split())]
    number = "CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE printf('%.6g', {v}) END"
    return f"""
WITH c AS ({" UNION ALL ".join(parts)}),
v AS (SELECT position, shown, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, shown) AS k FROM v),
top AS (SELECT position, count(*) AS found, max(n) AS most, string_agg(CASE WHEN k <= 5 THEN shown || ' (' || n || ')' END, '|' ORDER BY k) AS top_values, string_agg(CASE WHEN k <= 50 THEN shown END, '|' ORDER BY k) AS cats FROM r GROUP BY position),
s AS (SELECT position, name, count(*) AS non_null, sum((kind = 'integer')::INT) AS ni, sum((kind = 'float')::INT) AS nf, max(kind) AS any_kind, min(x) AS lo, max(x) AS hi, avg(x) AS mean, min(shown) AS tlo, max(shown) AS thi FROM c GROUP BY position, name),
d AS (SELECT *, CASE WHEN ni + nf = 0 THEN any_kind WHEN nf = 0 THEN 'integer' WHEN ni >= 0.9 * non_null OR nf >= 0.9 * non_null OR ni + nf >= 0.9 * non_null THEN 'float' END AS dtype FROM s)
SELECT position, name, dtype, CAST(non_null AS BIGINT) AS non_null, CAST(least(found, 50000) AS BIGINT) AS "distinct", found > 50000 AS distinct_capped,
       non_null > 1 AND CASE WHEN found > 50000 THEN most = 1 ELSE found = non_null END AS is_unique,
       CASE WHEN most > 1 THEN top_values ELSE '' END AS top_values, CASE WHEN found <= 50 THEN cats ELSE '' END AS categories,
       CASE WHEN dtype IN ('integer', 'float') THEN {number.format(v="lo")} WHEN dtype = 'datetime' THEN tlo END AS "min",
       CASE WHEN dtype IN ('integer', 'float') THEN {number.format(v="hi")} WHEN dtype = 'datetime' THEN thi END AS "max",
       CASE WHEN dtype IN ('integer', 'float') THEN round(mean, 2) END AS mean
FROM d JOIN top USING (position)"""


def _profile(table: str):
    def f(spark, d):
        p = profile.profile(_t(spark, d, table))
        return p.select("position", "name", "dtype", "non_null", "distinct", "distinct_capped", "is_unique", _joined(F.col("top_values")).alias("top_values"), _joined(F.col("categories")).alias("categories"), "min", "max", F.round("mean", 2).alias("mean"))

    f.__name__ = f"profile_{table}"
    return query(_profile_sql(table))(f)


for _name in _KINDS:
    _profile(_name)


@query("""
SELECT dtype, count(*) AS n FROM (
  SELECT 'integer' AS dtype FROM range(4) UNION ALL SELECT 'text' FROM range(2) UNION ALL SELECT 'float' FROM range(1)) GROUP BY dtype""")
def dtype_vote(spark, d):
    p = _t(spark, d, "lineitem")
    mixed = F.when(F.col("l_linenumber") % 7 == 0, F.concat("l_linenumber", F.lit(".25"))).otherwise(F.col("l_linenumber").cast("string"))
    df = p.select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")], mixed.alias("m"))
    return profile.dtype_votes(profile.profile(df, text_source=True)).select("dtype", F.col("count").alias("n"))


# ------------------------------------------------------------------ extraction

_MENTION = """m AS (SELECT lower(p_name) AS key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) AS type, p_brand AS description, p_partkey % 97 AS chunk_id, p_partkey AS seq FROM part)"""


def _mentions(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select(T.entity_key(F.col("p_name")).alias("key"), name.alias("name"), T.norm_type(F.col("p_type")).alias("type"), F.col("p_brand").alias("description"), (F.col("p_partkey") % 97).alias("chunk_id"), F.col("p_partkey").alias("seq"))


@query(f"""
WITH {_MENTION},
n AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, length(name) DESC, min(seq)) AS r FROM m GROUP BY key, name),
t AS (SELECT key, type, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(seq)) AS r FROM m GROUP BY key, type),
d AS (SELECT key, description, row_number() OVER (PARTITION BY key ORDER BY min(seq)) AS r FROM m GROUP BY key, description)
SELECT m.key, any_value(n.name) AS name, any_value(t.type) AS type, (SELECT string_agg(description, '|' ORDER BY r) FROM d WHERE d.key = m.key AND r <= 8) AS descriptions, count(DISTINCT chunk_id) AS mention_count
FROM m JOIN n ON n.key = m.key AND n.r = 1 JOIN t ON t.key = m.key AND t.r = 1 GROUP BY m.key""")
def entity_aggregate(spark, d):
    e = extraction.aggregate_entities(_mentions(spark, d), ("key",))
    return e.select("key", "name", "type", _joined(F.col("descriptions")).alias("descriptions"), "mention_count")


_REL = """r AS (SELECT a.l_partkey % 200 AS src, b.l_partkey % 200 AS dst, a.l_returnflag AS type, b.l_linestatus AS description, CAST(a.l_quantity AS INT) - 20 AS strength, a.l_orderkey AS chunk_id, a.l_orderkey * 10 + a.l_linenumber AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1)"""


def _rels(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part, status = F.lead("l_partkey").over(order), F.lead("l_linestatus").over(order)
    rows = _t(spark, d, "lineitem").withColumn("next", part).withColumn("status", status).where("next IS NOT NULL")
    return rows.select(
        (F.col("l_partkey") % 200).alias("src"), (F.col("next") % 200).alias("dst"), F.col("l_returnflag").alias("type"), F.col("status").alias("description"),
        (F.col("l_quantity").cast("int") - 20).alias("strength"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


_ENDS = "(SELECT p_partkey % 200 AS k FROM part WHERE p_size > 5)"


def _known(spark, d):
    return _t(spark, d, "part").where("p_size > 5").select((F.col("p_partkey") % 200).alias("key"))


@query(f"""WITH {_REL} SELECT src, dst, type, round(sum(greatest(1, least(10, strength)) / 10.0::DOUBLE), 4) AS weight, count(DISTINCT chunk_id) AS n_chunks
FROM r WHERE src <> dst AND src IN {_ENDS} AND dst IN {_ENDS} GROUP BY ALL""")
def relationship_aggregate(spark, d):
    rels = extraction.valid_relationships(_rels(spark, d), _known(spark, d), ())
    out = extraction.aggregate_relationships(rels, ())
    return out.select("src", "dst", "type", F.round("weight", 4).alias("weight"), F.size("chunk_ids").cast("long").alias("n_chunks"))


@query(f"WITH {_REL} SELECT count(*) - count(*) FILTER (src <> dst AND src IN {_ENDS} AND dst IN {_ENDS}) AS n_dropped, count(*) AS n FROM r")
def dropped_relationships(spark, d):
    rels = _rels(spark, d)
    kept = extraction.valid_relationships(rels, _known(spark, d), ()).agg(F.count("*").alias("kept"))
    return rels.agg(F.count("*").alias("n")).crossJoin(kept).select((F.col("n") - F.col("kept")).alias("n_dropped"), "n")


def _edges(spark, d, where="true"):
    out = _rels(spark, d).where(where).where("src <> dst").groupBy("src", "dst", "type").agg(F.sum(extraction.weight(F.col("strength"))).alias("weight"), F.sort_array(F.collect_set("description")).alias("descriptions"))
    return out.withColumn("chunk_ids", F.array().cast("array<string>"))


_EDGES = "e AS (SELECT src, dst, type, sum(greatest(1, least(10, strength)) / 10.0::DOUBLE) AS weight FROM r WHERE src <> dst GROUP BY ALL)"


@query(f"""WITH {_REL} SELECT src, dst, type, round(sum(greatest(1, least(10, strength)) / 10.0::DOUBLE), 4) AS weight, count(DISTINCT description) AS n_descriptions FROM r WHERE src <> dst GROUP BY ALL""")
def edge_upsert(spark, d):
    out = resolution.upsert_edges(_edges(spark, d, "chunk_id % 3 <> 0"), _edges(spark, d, "chunk_id % 3 = 0"))
    return out.select("src", "dst", "type", F.round("weight", 4).alias("weight"), F.size("descriptions").cast("long").alias("n_descriptions"))


@query(f"""
WITH {_MENTION}, k AS (SELECT DISTINCT key FROM m), o AS (SELECT key, 'e:' || key AS id FROM k WHERE length(key) % 3 = 0), a AS (SELECT key, 'a:' || key AS id FROM k WHERE length(key) % 3 <> 1)
SELECT k.key, coalesce(o.id, a.id) AS id FROM k LEFT JOIN o USING (key) LEFT JOIN a USING (key) WHERE coalesce(o.id, a.id) IS NOT NULL""")
def alias_resolve(spark, d):
    keys = written(_mentions(spark, d).select("key").distinct())
    own = keys.where("length(key) % 3 = 0").select("key", F.concat(F.lit("e:"), "key").alias("id"))
    other = keys.where("length(key) % 3 <> 1").select("key", F.concat(F.lit("a:"), "key").alias("entity_id"))
    return resolution.resolve_keys(keys, own, other)


@query(f"""
WITH {_MENTION}, f AS (SELECT key, count(DISTINCT chunk_id) AS c FROM m GROUP BY key)
SELECT key, CASE WHEN length(key) % 2 = 0 THEN 'old' ELSE 'new' END AS kind, CASE WHEN length(key) % 2 = 0 THEN 100 + c ELSE c END AS mention_count FROM f""")
def entity_upsert(spark, d):
    found = written(extraction.aggregate_entities(_mentions(spark, d), ("key",)))
    old = found.where("length(key) % 2 = 0").select(F.concat(F.lit("old:"), "key").alias("id"), "key", "name", "type", F.array(F.lit("x")).alias("descriptions"), F.lit(100).cast("long").alias("mention_count"))
    none = spark.createDataFrame([], "key string, entity_id string")
    out = resolution.upsert_entities(old, found, resolution.resolve_keys(found, old, none))
    return out.select("key", F.when(F.col("id").startswith("old:"), "old").otherwise("new").alias("kind"), "mention_count")


# ------------------------------------------------------------------ graph


@query(f"WITH {_REL}, {_EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(weight), 4) AS weight FROM e GROUP BY ALL")
def undirected_projection(spark, d):
    return graph.undirected(_edges(spark, d)).select("a", "b", F.round("weight", 4).alias("weight"))


def _nodes(spark, d):
    return _t(spark, d, "part").select((F.col("p_partkey") % 250).alias("id")).distinct()


@query(f"""WITH {_REL}, {_EDGES}, n AS (SELECT DISTINCT p_partkey % 250 AS id FROM part), x AS (SELECT unnest([src, dst]) AS id FROM e)
SELECT n.id, count(x.id) AS degree FROM n LEFT JOIN x ON x.id = n.id GROUP BY n.id ORDER BY degree DESC, n.id LIMIT 50""")
def degree_topk(spark, d):
    return graph.most_connected(_nodes(spark, d), _edges(spark, d), 50)


@query(f"""WITH {_REL}, {_EDGES}, x AS (SELECT unnest([src, dst]) AS id FROM e), t AS (SELECT id FROM x GROUP BY id ORDER BY count(*) DESC, id LIMIT 40)
SELECT src, dst, type, round(weight, 4) AS weight FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""")
def graph_display(spark, d):
    edges = written(_edges(spark, d))
    none = spark.createDataFrame([], "entity_id bigint, community_id string")
    return graph.display(_nodes(spark, d), edges, none, 40)[1].select("src", "dst", "type", F.round("weight", 4).alias("weight"))


@query(f"""WITH {_REL}, {_EDGES}, l AS (SELECT src, dst, type, weight, src < 20 AS i, dst < 20 AS j FROM e WHERE src < 20 OR dst < 20),
k AS (SELECT *, row_number() OVER (ORDER BY (i AND j) DESC, round(weight, 4) DESC, src, dst, type) AS r FROM l)
SELECT src, dst, type, i AND j AS internal, round(weight, 4) AS weight FROM k WHERE r <= 12""")
def relationship_internal_topk(spark, d):
    picked = spark.range(20).select(F.lit("c").alias("community_id"), F.col("id").alias("entity_id"))
    edges = _edges(spark, d).withColumn("weight", F.round("weight", 4))
    return retrieval.leaf_relationships(picked, written(edges), Config()).select("src", "dst", "type", "internal", "weight")


@query(f"""WITH {_REL}, {_EDGES} SELECT src, dst, type, src < 20 AND dst < 20 AS internal FROM e WHERE src < 20 OR dst < 20""")
def incident_edges(spark, d):
    return graph.incident(_edges(spark, d), spark.range(20)).select("src", "dst", "type", "internal")


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS chunks, (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM lineitem) AS relationships,
(SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS communities, (SELECT count(*) FROM region) AS top_communities, CAST(2 AS BIGINT) AS levels""")
def graph_stats(spark, d):
    forest = _t(spark, d, "nation").select(F.col("n_regionkey").alias("parent_id"), F.lit(0).alias("level")).union(_t(spark, d, "region").select(F.lit(None).cast("int"), F.lit(1)))
    return graph.graph_stats(_t(spark, d, "documents"), _t(spark, d, "pages"), _t(spark, d, "part"), _t(spark, d, "lineitem"), forest)


@query("SELECT (SELECT count(*) FROM customer) AS datasets, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS ready, (SELECT count(*) FROM orders) AS columns")
def catalog_stats(spark, d):
    return catalog.stats(_t(spark, d, "customer").withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", "ready")), _t(spark, d, "orders"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY o_orderkey) AS cols FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def dataset_columns(spark, d):
    sets = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(0.0).alias("created_at"))
    cols = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("dataset_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("name"))
    return catalog.with_columns(sets, cols).select("id", F.array_join(F.transform("columns", lambda c: F.concat(c["position"], F.lit(":"), c["name"])), "|").alias("cols"))


@query("""SELECT n_nationkey AS position, CASE WHEN n_nationkey % 2 = 0 THEN 'by name ' || n_name WHEN n_nationkey < 10 THEN 'by place ' || n_nationkey ELSE '' END AS description FROM nation""")
def draft_match(spark, d):
    cols = _t(spark, d, "nation").select(F.col("n_nationkey").alias("position"), "n_name").withColumnRenamed("n_name", "name")
    named = cols.where("position % 2 = 0").select((F.col("position") + 1000).alias("n"), F.concat(F.lit("  "), F.lower("name")).alias("name"), F.concat(F.lit("by name "), "name").alias("description"))
    placed = cols.where("position % 2 = 1 AND position < 10").select(F.col("position").alias("n"), F.lit("?").alias("name"), F.concat(F.lit("by place "), "position").alias("description"))
    return catalog.drafted(cols, named.union(placed))


# ------------------------------------------------------------------ vectors and resolution

_COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_NEAR = f"""p AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM p) WHERE r <= 5 AND score >= 0.33)"""


@query(f"WITH {_NEAR} SELECT src, dst, round(score, 4) AS score FROM near")
def knn_candidates(spark, d):
    v = _vectors(spark, d)
    return resolution.neighbours(v, v, 5, 0.33).select("src", "dst", F.round("score", 4).alias("score"))


@query(f"""WITH {_NEAR}, g AS (SELECT DISTINCT list_sort(list_append(list(dst), src)) AS m FROM near GROUP BY src)
SELECT array_to_string(m, '|') AS members FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE len(h.m) > len(g.m) AND len(list_filter(g.m, lambda x: NOT list_contains(h.m, x))) = 0)""")
def candidate_groups(spark, d):
    v = _vectors(spark, d)
    return resolution.candidate_groups(resolution.neighbours(v, v, 5, 0.33)).select(F.array_join(F.col("members").cast("array<string>"), "|").alias("members"))


_MAP = f"""{_NEAR}, e AS (SELECT src AS a, dst AS b FROM near UNION SELECT dst, src FROM near),
reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
k AS (SELECT node, component, first_value(node) OVER (PARTITION BY component ORDER BY node * 7919 % 101 DESC, node) AS survivor FROM c)"""


def _moves(spark, d):
    v = _vectors(spark, d)
    pairs = resolution.neighbours(v, v, 5, 0.33).select("src", "dst")
    return written(resolution.merge_map(pairs, v.select("id", (F.col("id") * 7919 % 101).alias("mention_count"))))


@query(f"WITH RECURSIVE {_MAP} SELECT node AS id, survivor FROM k WHERE node <> survivor")
def connected_merge_map(spark, d):
    return _moves(spark, d)


@query(f"""WITH RECURSIVE {_MAP}, w AS (SELECT vec_id AS src, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS dst, label AS type, 0.5::DOUBLE AS weight FROM embeddings),
x AS (SELECT coalesce(a.survivor, w.src) AS src, coalesce(b.survivor, w.dst) AS dst, type, weight FROM w LEFT JOIN k a ON a.node = w.src LEFT JOIN k b ON b.node = w.dst)
SELECT src, dst, type, round(sum(weight), 4) AS weight FROM x WHERE src <> dst GROUP BY ALL""")
def node_merge(spark, d):
    v = _t(spark, d, "embeddings")
    n = v.count()
    none = F.array().cast("array<string>")
    edges = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") + 1) % n).alias("dst"), F.col("label").alias("type"), F.lit(0.5).alias("weight"), none.alias("descriptions"), none.alias("chunk_ids"))
    entities = v.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("key"), none.alias("descriptions"), F.lit(1).alias("mention_count"))
    mentions = v.select(F.lit("c").alias("chunk_id"), F.col("vec_id").alias("entity_id"))
    aliases = v.limit(0).select(F.lit("").alias("key"), F.col("vec_id").alias("entity_id"))
    out = resolution.apply_merges(_moves(spark, d), entities, edges, mentions, aliases)[1]
    return out.select("src", "dst", "type", F.round("weight", 4).alias("weight"))


@query("SELECT vec_id, round(list_dot_product(u, u), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE / sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[]))) AS u FROM embeddings)")
def unit_vectors(spark, d):
    u = V.unit(F.col("embedding"), 16)
    return _t(spark, d, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


# ------------------------------------------------------------------ communities


def _paths(spark, d):
    nations = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = _t(spark, d, "customer").join(nations, "c_nationkey")
    nation = F.when(F.col("n_regionkey") == 2, F.lit("all")).otherwise(F.col("c_nationkey").cast("string"))
    # Nations of region 2 form one community, so that its level collapses.
    return c.select(F.col("c_custkey").alias("entity_id"), F.array(F.concat(F.lit("n"), nation, F.lit("r"), "n_regionkey"), F.concat(F.lit("r"), "n_regionkey")).alias("path"))


_PATHS = """p AS (SELECT c_custkey AS e, 'n' || CASE WHEN n_regionkey = 2 THEN 'all' ELSE CAST(c_nationkey AS VARCHAR) END || 'r' || n_regionkey AS n, 'r' || n_regionkey AS r
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT n, r, count(*) AS size FROM p GROUP BY ALL), t AS (SELECT r, count(*) AS size FROM p GROUP BY r),
ids AS (SELECT r AS name, 'comm-' || substr(sha1(string_agg(CAST(e AS VARCHAR), chr(31) ORDER BY CAST(e AS VARCHAR))), 1, 16) AS id FROM p GROUP BY r
        UNION ALL SELECT n, 'comm-' || substr(sha1(string_agg(CAST(e AS VARCHAR), chr(31) ORDER BY CAST(e AS VARCHAR))), 1, 16) FROM p GROUP BY n),
alive AS (SELECT n, r, s.size FROM s JOIN t USING (r) WHERE s.size < t.size)"""


@query(f"""WITH {_PATHS}
SELECT i.id, 0 AS level, size, j.id AS parent_id, false AS is_top FROM alive JOIN ids i ON i.name = n JOIN ids j ON j.name = r
UNION ALL SELECT i.id, CASE WHEN r IN (SELECT r FROM alive) THEN 1 ELSE 0 END, size, NULL, true FROM t JOIN ids i ON i.name = r""")
def hierarchy_build(spark, d):
    return communities.hierarchy(_paths(spark, d))[0].select("id", "level", "size", "parent_id", "is_top")


@query(f"WITH {_PATHS} SELECT e AS entity_id, coalesce(i.id, j.id) AS community_id FROM p LEFT JOIN alive USING (n, r) LEFT JOIN ids i ON i.name = alive.n JOIN ids j ON j.name = p.r")
def hierarchy_leaves(spark, d):
    return communities.hierarchy(_paths(spark, d))[1]


@query(f"WITH {_PATHS} SELECT (SELECT count(*) FROM alive) + (SELECT count(*) FROM t) AS communities, (SELECT count(*) FROM t) AS top_level, CASE WHEN (SELECT count(*) FROM alive) > 0 THEN 2 ELSE 1 END AS levels")
def community_stats(spark, d):
    return communities.hierarchy(_paths(spark, d))[0].agg(F.count("*").alias("communities"), F.count_if("is_top").alias("top_level"), (F.max("level") + 1).alias("levels"))


@query(f"""WITH {_REL}, {_EDGES}, g AS (SELECT * FROM e WHERE src % 10 = dst % 10),
deg AS (SELECT id, count(*) AS k FROM (SELECT unnest([src, dst]) AS id FROM e) GROUP BY id),
x AS (SELECT i AS id, '- n' || i || ' (T): d' || i AS line FROM range(200) t(i)),
y AS (SELECT src % 10 AS c, string_agg('- n' || src || ' -[' || type || ']-> n' || dst || ': ', chr(31) ORDER BY '- n' || src || ' -[' || type || ']-> n' || dst || ': ') AS rels FROM g GROUP BY 1),
z AS (SELECT x.id % 10 AS c, string_agg(line, chr(31) ORDER BY line) AS ents, string_agg(line, chr(10) ORDER BY coalesce(k, 0) DESC, x.id) AS entity_text FROM x LEFT JOIN deg USING (id) GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS community_id, sha1('leaf' || chr(31) || ents || coalesce(chr(31) || rels, '')) AS content_hash, entity_text FROM z LEFT JOIN y USING (c)""")
def leaf_context(spark, d):
    ids = spark.range(200)  # all ends of the edges
    entities = ids.select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("T").alias("type"), F.concat(F.lit("d"), "id").alias("description"))
    leaves = ids.select(F.col("id").alias("entity_id"), (F.col("id") % 10).cast("string").alias("community_id"))
    edges = written(_edges(spark, d).withColumn("descriptions", F.array().cast("array<string>")))
    return communities.leaf_contexts(leaves, entities, edges).select("community_id", "content_hash", "entity_text")


@query("""WITH l AS (SELECT o_custkey AS c, o_orderpriority AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY c ORDER BY k) - 1 AS used, count(*) OVER (PARTITION BY c) AS n FROM l),
f AS (SELECT c, n, count(*) FILTER (used <= 60) AS fit, string_agg(CASE WHEN used <= 60 THEN line END, chr(10) ORDER BY k) AS t FROM u GROUP BY c, n)
SELECT c, concat_ws(chr(10), t, CASE WHEN fit < n THEN '... (' || (n - fit) || ' more omitted)' END) AS cut FROM f""")
def budget_lines(spark, d):
    lines = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("l"))
    return lines.select("c", communities.cut_lines(F.col("l"), 60).alias("cut"))


_UND = "u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM e GROUP BY ALL)"


@query(f"""WITH {_REL}, {_EDGES}, {_UND}, m AS (SELECT sum(w) AS m FROM u), i AS (SELECT a % 7 AS c, sum(w) AS w FROM u WHERE a % 7 = b % 7 GROUP BY 1), k AS (SELECT x % 7 AS c, sum(w) AS d FROM (SELECT a AS x, w FROM u UNION ALL SELECT b, w FROM u) GROUP BY 1)
SELECT round(sum(coalesce(i.w, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN i USING (c), m""")
def modularity(spark, d):
    und = written(graph.undirected(_edges(spark, d)))
    part = und.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node") % 7)
    return graph.modularity(und, part).select(F.round("modularity", 6).alias("modularity"))


def _similar(spark, d):
    v = written(_vectors(spark, d))
    near = resolution.neighbours(v, v, 5, 0.2)
    return v, written(near.select("src", "dst", F.lit("near").alias("type"), F.col("score").alias("weight")))


@query()
def leiden_communities(spark, d):
    v, edges = _similar(spark, d)
    return communities.detect(v.select("id"), edges).select("entity_id", _joined(F.col("path")).alias("path"))


# ------------------------------------------------------------------ retrieval

_LOW = Config(retrieval_threshold=0.25, retrieval_top_k=6, context_chars=400)


def _scored(spark, d):
    """Labels as leaves under three parents, scored against vector 0."""
    v = _t(spark, d, "embeddings").select("vec_id", "label", V.unit(F.col("embedding")).alias("u"))
    q = v.where("vec_id = 0").select(F.col("u").alias("q"))
    c = v.select(F.concat(F.lit("L"), "label").alias("id"), F.concat(F.lit("P"), F.col("label") % 3).alias("parent_id"), "u")
    c = c.union(c.select("parent_id", F.lit(None).cast("string"), "u"))
    mean = c.select("id", "parent_id", F.posexplode("u").alias("i", "x")).groupBy("id", "parent_id", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("id", "parent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return mean.crossJoin(F.broadcast(q)).select("id", "parent_id", F.round(V.cosine(F.col("m"), F.col("q")), 9).alias("score"))  # one query row


_SCORED = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
c AS (SELECT 'L' || label AS id, 'P' || (label % 3) AS parent_id, u FROM v UNION ALL SELECT 'P' || (label % 3), NULL, u FROM v),
x AS (SELECT id, parent_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM c),
a AS (SELECT id, parent_id, i, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT id, parent_id, list(x ORDER BY i) AS m FROM a GROUP BY ALL),
sc AS (SELECT id, parent_id, round(list_dot_product(m, q) / (sqrt(list_dot_product(m, m)) * sqrt(list_dot_product(q, q))), 9) AS score FROM m, q),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk, max(score) OVER () AS best FROM sc WHERE parent_id IS NULL),
sel AS (SELECT id, score, rk, CASE WHEN best < 0.25 THEN score >= best - 0.05 AND rk <= 2 ELSE score >= 0.25 END AS selected, best < 0.25 AND score >= best - 0.05 AND rk <= 2 AS forced FROM top WHERE rk <= 6),
kid AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, id) AS rk, max(score) OVER (PARTITION BY parent_id) AS best FROM sc WHERE parent_id IS NOT NULL)"""


@query(f"WITH {_SCORED} SELECT id, round(score, 4) AS score, selected, forced FROM sel")
def top_level_select(spark, d):
    return retrieval.top_level(_scored(spark, d), _LOW).select("id", F.round("score", 4).alias("score"), "selected", "forced")


@query(f"""WITH {_SCORED},
w AS (SELECT id, score, forced, 0 AS depth, [rk] AS path, score >= 0.25 OR forced AS accepted FROM sel WHERE selected),
w2 AS (SELECT kid.id, kid.score, kid.best < 0.25 AND kid.rk = 1 AS forced, 1 AS depth, list_append(w.path, kid.rk) AS path FROM kid JOIN w ON w.id = kid.parent_id WHERE w.accepted),
z AS (SELECT id, score, forced, accepted, depth, path FROM w UNION ALL SELECT id, score, forced, score >= 0.25 OR forced, depth, path FROM w2),
o AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS ord FROM z),
b AS (SELECT *, coalesce(sum(CASE WHEN accepted THEN 100 ELSE 0 END) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM o)
SELECT id, round(score, 4) AS score, forced, accepted, depth, CAST(ord AS BIGINT) AS ord FROM b WHERE spent < 400 AND ord <= 40""")
def bfs_traverse(spark, d):
    scored = written(_scored(spark, d))
    seen = retrieval.within_budget(retrieval.walk(scored, _LOW), scored.select("id", F.lit(100).alias("chars")), _LOW)
    return seen.select("id", F.round("score", 4).alias("score"), "forced", "accepted", "depth", F.col("ord").cast("long").alias("ord"))


@query(f"""WITH s AS (SELECT b.label, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s)
SELECT 'L' || label AS community_id, vec_id AS entity_id, k AS rank, round(score, 4) AS score FROM r WHERE k <= 8""")
def leaf_topn(spark, d):
    v = written(_t(spark, d, "embeddings"))
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scores = v.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("entity_id"), V.cosine(F.col("embedding"), F.col("q")).alias("score"))  # one query row
    member = v.select(F.col("vec_id").alias("entity_id"), F.concat(F.lit("L"), "label").alias("community_id"))
    out = retrieval.leaf_entities(member.select(F.col("community_id").alias("id")).distinct(), member, scores, Config())
    return out.select("community_id", "entity_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("""WITH v AS (SELECT o_orderkey AS id, o_orderkey AS ord, o_custkey % 3 <> 0 AS accepted, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS chars FROM orders),
s AS (SELECT id, coalesce(sum(CASE WHEN accepted THEN coalesce(chars, 0) END) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM v)
SELECT id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent < 5000""")
def context_budget(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    visits = orders.select("id", F.col("id").alias("ord"), (F.col("c") % 3 != 0).alias("accepted"))
    charges = orders.where("id % 5 <> 0").select("id", F.col("c").alias("chars"))
    return retrieval.within_budget(visits, charges, Config(context_chars=5000)).select("id", F.col("spent").cast("long").alias("spent"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS leaf, l_partkey AS e FROM lineitem),
y AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
ends AS (SELECT leaf, src, dst FROM y JOIN m ON e = src UNION ALL SELECT leaf, src, dst FROM y JOIN m ON e = dst),
t AS (SELECT leaf, src, dst, count(*) > 1 AS internal FROM ends GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY internal DESC, (src * 7 + dst) % 11 DESC, src, dst) AS k FROM t)
SELECT leaf AS community_id, src, dst, internal, CAST(k AS BIGINT) AS rank FROM r WHERE k <= 3""")
def leaf_relationships(spark, d):
    lines = _t(spark, d, "lineitem")
    picked = lines.select(F.col("l_orderkey").alias("community_id"), F.col("l_partkey").alias("entity_id")).distinct()
    edges = lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct().select("src", "dst", F.lit("SUPPLIED").alias("type"), ((F.col("src") * 7 + F.col("dst")) % 11).alias("weight"))
    return retrieval.leaf_relationships(picked, edges, Config(leaf_relationships=3)).select("community_id", "src", "dst", "internal", F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey % 50 AS entity_id FROM lineitem),
s AS (SELECT chunk_id, sum(greatest(0, entity_id - 25)) AS score FROM m GROUP BY chunk_id),
b AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 6)
SELECT chunk_id, CAST(score AS DOUBLE) AS score, 'order ' || chunk_id || ' has E' || (SELECT max(entity_id) FROM m WHERE m.chunk_id = b.chunk_id) AS excerpt FROM b""")
def source_chunks(spark, d):
    mentions = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % 50).alias("entity_id"))
    picked = spark.range(50).select(F.col("id").alias("entity_id"), (F.col("id") - 25.0).alias("score"))
    best = mentions.groupBy("chunk_id").agg(F.max("entity_id").alias("e"))
    chunks = best.select(F.col("chunk_id").alias("id"), F.lit("d").alias("doc_id"), F.lit(0).alias("index"), F.concat(F.lit("order "), "chunk_id", F.lit(" has E"), "e").alias("text"))
    entities = spark.range(50).select("id", F.concat(F.lit("e"), "id").alias("name"))
    out = retrieval.top_chunks(retrieval.chunk_relevance(mentions, picked), chunks, picked, entities, Config(source_chunks=6))
    return out.select("chunk_id", "score", "excerpt")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey % 50 AS entity_id FROM lineitem)
SELECT chunk_id, round(sum(greatest(0, (entity_id - 25) / 25.0::DOUBLE)), 4) AS score, string_agg(CAST(entity_id AS VARCHAR), '|' ORDER BY entity_id) AS entity_ids FROM m GROUP BY chunk_id""")
def chunk_relevance(spark, d):
    m = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % 50).alias("entity_id"))
    picked = spark.range(50).select(F.col("id").alias("entity_id"), ((F.col("id") - 25) / 25.0).alias("score"))
    return retrieval.chunk_relevance(m, picked).select("chunk_id", F.round("score", 4).alias("score"), F.array_join(F.col("entity_ids").cast("array<string>"), "|").alias("entity_ids"))


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n, instr(lower(text), 'the') - 1 AS p FROM documents), s AS (SELECT *, CASE WHEN p >= 0 THEN greatest(0, least(n - 300, p - 100)) ELSE 0 END AS st FROM t)
SELECT doc_id, CASE WHEN n <= 300 THEN text ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || substr(text, CAST(st + 1 AS BIGINT), 300) || CASE WHEN st + 300 < n THEN '…' ELSE '' END END AS excerpt FROM s""")
def excerpt(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), F.lit("The"), 300).alias("excerpt"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'C' || turn || '|E' || conv_id ELSE 'R' || turn || '|S1' END AS labels FROM conversations""")
def citations(spark, d):
    answer = F.when(F.col("turn") % 2 == 0, F.format_string("x [C%d] y [E%d] [C%d] [Q1] [E]", "turn", "conv_id", "turn")).otherwise(F.format_string("[R%d][S1] [ S2] [R%d]", "turn", "turn"))
    return _t(spark, d, "conversations").select("conv_id", "turn", _joined(T.citations(answer)).alias("labels"))


@query("""WITH l AS (SELECT conv_id, unnest(CASE WHEN turn % 2 = 0 THEN ['C' || turn, 'E' || conv_id] ELSE ['R' || turn, 'S1'] END) AS label FROM conversations),
i AS (SELECT DISTINCT conv_id, 'C' || turn AS label, CAST(turn AS BIGINT) AS a, CAST(conv_id AS BIGINT) AS b FROM conversations UNION SELECT conv_id, 'S1', -1, conv_id FROM conversations),
n AS (SELECT DISTINCT conv_id, unnest([a, b]) AS node FROM l JOIN i USING (conv_id, label))
SELECT conv_id AS answer_id, string_agg(CAST(node AS VARCHAR), '|' ORDER BY node) AS nodes FROM n GROUP BY conv_id""")
def cited_nodes(spark, d):
    talk = _t(spark, d, "conversations").withColumn("answer_id", F.col("conv_id"))
    answer = F.when(F.col("turn") % 2 == 0, F.format_string("x [C%d] y [E%d] [C%d] [Q1]", "turn", "conv_id", "turn")).otherwise(F.format_string("[R%d][S1] [ S2]", "turn"))
    cited = talk.select("answer_id", F.explode(T.citations(answer)).alias("label"))
    node = lambda x: F.array(F.lit(x) if isinstance(x, int) else F.col(x).cast("long"), F.col("conv_id").cast("long")).cast("array<bigint>")
    items = talk.select("answer_id", F.format_string("C%d", "turn").alias("label"), node("turn").alias("node_ids"))
    items = items.unionByName(talk.select("answer_id", F.lit("S1").alias("label"), node(-1).alias("node_ids"))).distinct()
    return retrieval.cited_nodes(cited, items).select("answer_id", F.array_join(F.col("node_ids").cast("array<string>"), "|").alias("nodes"))


@query("SELECT o_orderpriority AS verdict, count(*) AS n FROM orders GROUP BY o_orderpriority")
def verdict_counts(spark, d):
    return retrieval.verdict_counts(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("verdict")))


# ------------------------------------------------------------------ documents


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedupe_documents(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_FILES = "f AS (SELECT p_partkey, sha256(p_brand || p_type || p_size || p_name) AS h, p_brand || p_type || p_size || p_name AS n FROM part)"


def _files(spark, d):
    name = F.concat("p_brand", "p_type", "p_size", "p_name")
    return _t(spark, d, "part").select("p_partkey", F.concat(name, F.lit(".csv")).alias("file_name"), F.sha2(name, 256).alias("file_hash"), F.lit("/in").alias("path"))


@query(f"WITH {_FILES} SELECT DISTINCT 'ds_' || substr(h, 1, 12) AS id, n AS name, 'queued' AS status FROM f WHERE h NOT IN (SELECT h FROM f WHERE p_partkey % 5 = 0)")
def register_new(spark, d):
    """All parts as files, every fifth of which the catalog knows."""
    files = _files(spark, d)
    return catalog.register(files.where("p_partkey % 5 = 0"), files, 0.0).select("id", "name", "status")


_COLS = "c AS (SELECT CAST(l_orderkey AS VARCHAR) AS dataset_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS position, l_returnflag AS name, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


def _columns(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("dataset_id"), F.row_number().over(order).alias("position"), F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("bigint").alias("q"))


@query(f"WITH {_COLS} SELECT dataset_id, position, name FROM c WHERE CAST(dataset_id AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1%')")
def dataset_delete(spark, d):
    """Orders as datasets, lines as their columns; those of the first priority go with all columns."""
    sets = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    kept, columns = catalog.without(sets, _columns(spark, d), sets.where("o_orderpriority LIKE '1%'").select("id"))
    return columns.join(kept.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select("dataset_id", "position", "name")


@query(f"WITH {_COLS} SELECT dataset_id, count(*) AS n, sum(q) AS q FROM (SELECT dataset_id, q FROM c WHERE dataset_id <> '1' UNION ALL SELECT '1', p_size FROM part) GROUP BY 1")
def columns_replaced(spark, d):
    new = _t(spark, d, "part").select(F.col("p_partkey").cast("int").alias("position"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("q"))
    return catalog.replaced(_columns(spark, d), "1", new).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@query("""SELECT p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN 'given ' || p_size WHEN p_partkey % 3 = 1 THEN p_name ELSE NULL END AS description FROM part""")
def columns_described(spark, d):
    """A third of the parts gets a note, a third a blank one that leaves what is there, a third has none."""
    p = _t(spark, d, "part")
    own = p.select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 3 != 2, F.col("p_name")).alias("description"))
    given = p.select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" given "), "p_size")).otherwise(F.lit("  ")).alias("description"))
    return catalog.described(own, given).select("position", "description")


@query("""SELECT doc_id, substr(doc_id || chr(10) || coalesce(nullif(lang, ''), '') || chr(10) || 'a - ' || lang || chr(10) || 'b', 1, 6000) AS dataset,
  substr('ds / ' || doc_id || ' (text): ' || lang || ' e.g. ' || CASE WHEN doc_id % 2 = 0 THEN 'x, y' ELSE '1, 2, 3, 4, 5' END, 1, 2000) AS col FROM documents""")
def embedded_texts(spark, d):
    docs = _t(spark, d, "documents").withColumn("key", F.col("doc_id").cast("string"))
    lines = F.array(catalog.column_line(F.lit("a"), F.col("lang")), catalog.column_line(F.lit("b"), F.lit("")))
    some = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    col = catalog.column_text(F.lit("ds"), F.col("key"), F.lit("text"), F.col("lang"), some, F.array(*[F.lit(str(i)) for i in range(1, 8)]))
    return docs.select("doc_id", catalog.dataset_text(F.col("key"), F.col("lang"), lines).alias("dataset"), col.alias("col"))


@query()
def chunk_documents(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), T.clean_text(F.col("text")).alias("text"))
    return chunking.chunked(docs).select("id", "doc_id", "index", "start", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, true AS contiguous, true AS bounded, true AS placed FROM documents WHERE length(trim(" + _CLEAN.format(x="text") + ")) > 0")
def chunk_invariants(spark, d):
    docs = written(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), T.clean_text(F.col("text")).alias("text")))
    c = chunking.chunked(docs).join(docs.select(F.col("id").alias("doc_id"), F.col("text").alias("whole")), "doc_id")
    at = F.instr(F.substring(F.col("whole"), F.col("start") + 1, F.length("text") + 400), F.col("text")) > 0
    return c.groupBy("doc_id").agg((F.max("index") + 1 == F.count("*")).alias("contiguous"), (F.max(F.length("text")) <= 4400).alias("bounded"), F.bool_and(at).alias("placed"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS h FROM pages")
def html_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ").cast("binary")).alias("h"))


@query("SELECT sha256(text) AS hash, min(doc_id || '.txt') AS name FROM documents GROUP BY text")
def document_files(spark, d):
    """Texts as files with bytes of UTF-8, read by the document reader."""
    docs = _t(spark, d, "documents")
    files = docs.select(F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")).alias("path"), F.length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return extracted(files, min_chars=0).select("hash", "name")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS v FROM events GROUP BY event_type")
def stream_ingest_counts(spark, d):
    """The events table as a stream of files, counted in micro-batches that are kept in the shared folder."""
    import uuid

    from terrace.plans.scratch import shared_folder

    source = _t(spark, d, "events")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)

    def batch(df: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure writes its own folder again.
        df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query("SELECT label, CAST(min(vec_id) AS BIGINT) AS component FROM embeddings GROUP BY label")
def component_labels(spark, d):
    v = _t(spark, d, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    chain = v.select("vec_id", F.lag("vec_id").over(order).alias("before")).where("before IS NOT NULL")
    return components.components(chain).join(v.select(F.col("vec_id").alias("node"), "label"), "node").select("label", "component").distinct()
