"""Hierarchical communities: detection, hierarchy, contexts, summaries."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import digest
from terrace.operators.components import components
from terrace.operators.graph import degrees, undirected
from terrace.plans.scratch import written


def _leiden(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, two_m: float, gamma: float, seed: int, max_levels: int) -> list[np.ndarray]:
    """Levels (finest first) of one connected graph: local moves, refinement inside the found
    communities, aggregation of the refined parts, until nothing joins."""
    rng = np.random.default_rng(seed)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist()):
        links[a][b] = links[a].get(b, 0.0) + x
        links[b][a] = links[b].get(a, 0.0) + x
    mass = np.array([sum(v for v in d.values()) for d in links])
    where = np.arange(n)  # of each original node among the current ones
    levels: list[np.ndarray] = []
    start = np.arange(n)

    def moved(links, mass, comm, allowed=None):
        total = np.bincount(comm, mass, minlength=len(mass))
        size = np.bincount(comm, minlength=len(mass))
        queue = deque(rng.permutation(len(mass)))
        waiting = set(queue)
        while queue:
            i = queue.popleft()
            waiting.discard(i)
            if allowed is not None and size[comm[i]] > 1:
                continue
            own = comm[i]
            total[own] -= mass[i]
            size[own] -= 1
            near: dict[int, float] = {own: 0.0}
            for j, x in links[i].items():
                if j != i and (allowed is None or allowed[j] == allowed[i]):
                    near[comm[j]] = near.get(comm[j], 0.0) + x
            best, gain = own, near[own] - gamma * mass[i] * total[own] / two_m
            for c, x in sorted(near.items()):
                g = x - gamma * mass[i] * total[c] / two_m
                if g > gain + 1e-12:
                    best, gain = c, g
            comm[i] = best
            total[best] += mass[i]
            size[best] += 1
            if best != own and allowed is None:
                for j in links[i]:
                    if comm[j] != best and j not in waiting:
                        queue.append(j)
                        waiting.add(j)
        return comm

    for _ in range(max_levels):
        comm = moved(links, mass, start.copy())
        codes = np.unique(comm, return_inverse=True)[1]
        if levels and len(np.unique(codes[where])) == len(np.unique(levels[-1])):
            break
        levels.append(codes[where])
        if codes.max() + 1 == len(mass):
            break
        fine = np.unique(moved(links, mass, np.arange(len(mass)), codes), return_inverse=True)[1]
        if fine.max() + 1 == len(mass):
            fine = codes
        k = int(fine.max()) + 1
        new: list[dict[int, float]] = [{} for _ in range(k)]
        for i, d in enumerate(links):
            for j, x in d.items():
                a, b = int(fine[i]), int(fine[j])
                new[a][b] = new[a].get(b, 0.0) + x
        start = np.zeros(k, np.int64)
        start[fine] = codes
        first = {}
        for i, c in enumerate(start.tolist()):
            first.setdefault(c, i)
        start = np.array([first[c] for c in start.tolist()])
        mass = np.bincount(fine, mass, minlength=k)
        links, where = new, fine[where]
    # Nested levels: each is a union of the one before.
    out = [levels[0]]
    for level in levels[1:]:
        prev = out[-1]
        vote = pd.DataFrame({"p": prev, "l": level}).groupby("p").l.agg(lambda s: s.mode().iloc[0])
        out.append(vote.loc[prev].to_numpy())
    return out


def detect(entities: DataFrame, edges: DataFrame, gamma: float = 1.0, seed: int = 42, max_levels: int = 10) -> DataFrame:
    """(entity_id, path): communities of each entity, finest first, as strings.

    Moves between connected components never raise modularity, so components
    are solved apart with the total weight of the whole graph; entities without an edge
    are communities of their own."""
    und = written(undirected(edges))
    two_m = 2.0 * (und.agg(F.sum("weight")).head()[0] or 1.0)
    comp = components(und.select("a", "b"))
    rows = und.join(comp.withColumnRenamed("node", "a"), "a")
    id_type = dict(entities.dtypes)["id"]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b"])
        nodes, codes = np.unique(np.concatenate((frame.a.to_numpy(), frame.b.to_numpy())), return_inverse=True)
        n = len(frame)
        levels = _leiden(codes[:n], codes[n:], frame.weight.to_numpy(), len(nodes), two_m, gamma, seed, max_levels)
        names = []
        for level, part in enumerate(levels):
            least = pd.Series(nodes).groupby(part).min()
            names.append([f"{level}:{least[c]}" for c in part])
        return pd.DataFrame({"entity_id": nodes, "path": list(map(list, zip(*names)))})

    found = rows.groupBy("component").applyInPandas(solve, f"entity_id {id_type}, path array<string>")
    alone = entities.select(F.col("id").alias("entity_id")).join(found.select("entity_id"), "entity_id", "left_anti")
    return found.unionByName(alone.withColumn("path", F.array(F.concat(F.lit("0:"), F.col("entity_id").cast("string")))))


def hierarchy(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (entity_id, path) the communities (id, level, leiden_level, size,
    parent_id, is_top) and the leaf of each entity.  A community whose parent
    has the same members is dropped; as a parent holds its child, equal sizes tell."""
    rows = written(paths.select("entity_id", F.posexplode("path").alias("depth", "name")))
    sizes = rows.groupBy("depth", "name").agg(F.count("*").alias("size"), F.min("entity_id").alias("any"))
    up = rows.alias("c").join(rows.alias("p"), (F.col("c.entity_id") == F.col("p.entity_id")) & (F.col("p.depth") == F.col("c.depth") + 1)).select(F.col("c.depth").alias("depth"), F.col("c.name").alias("name"), F.col("p.name").alias("parent")).distinct()
    tree = sizes.join(up, ["depth", "name"], "left")
    parent = sizes.select((F.col("depth") - 1).alias("depth"), F.col("name").alias("parent"), F.col("size").alias("parent_size"))
    tree = written(tree.join(parent, ["depth", "parent"], "left").withColumn("alive", F.col("parent_size").isNull() | (F.col("parent_size") > F.col("size"))))
    alive = written(tree.where("alive").select("depth", "name", "size"))
    members = rows.join(alive, ["depth", "name"])
    # The survivor of a community is the first one alive on the way up; paths are short.
    per_entity = written(members.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("way")))
    ids = written(members.groupBy("depth", "name").agg(F.concat(F.lit("comm-"), F.substring(digest(F.sort_array(F.collect_list(F.col("entity_id").cast("string")))), 1, 16)).alias("id")))
    step = per_entity.select(F.posexplode("way").alias("i", "c"), "way").select(F.col("c.depth").alias("depth"), F.col("c.name").alias("name"), F.get("way", F.col("i") + 1).alias("p"), "i").groupBy("depth", "name").agg(F.any_value("p").alias("p"), F.max("i").alias("i"))
    names = ids.select(F.col("depth").alias("pd"), F.col("name").alias("pn"), F.col("id").alias("parent_id"))
    out = alive.join(ids, ["depth", "name"]).join(step, ["depth", "name"])
    out = out.join(names, (F.col("p.depth") == F.col("pd")) & (F.col("p.name") == F.col("pn")), "left")
    out = out.select("id", F.col("i").cast("int").alias("level"), F.col("depth").alias("leiden_level"), "size", "parent_id", F.col("parent_id").isNull().alias("is_top"))
    leaf = per_entity.select("entity_id", F.col("way")[0].alias("c")).join(ids, (F.col("c.depth") == ids["depth"]) & (F.col("c.name") == ids["name"])).select("entity_id", F.col("id").alias("community_id"))
    return out, leaf


def cut_lines(lines, budget: int):
    """Aggregated array of lines cut to a budget of characters at the first that overflows, with a note of what is left out."""
    fits = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda s, x: F.struct(
            F.when(s["open"] & (s["used"] + F.length(x) <= budget), s["used"] + F.length(x) + 1).otherwise(s["used"]).alias("used"),
            F.when(s["open"] & (s["used"] + F.length(x) <= budget), s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["open"] & (s["used"] + F.length(x) <= budget)).alias("open"),
        ),
        lambda s: s["n"],
    )
    note = F.when(fits < F.size(lines), F.array(F.format_string("... (%d more omitted)", F.size(lines) - fits))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(lines) == 0, "(none)").otherwise(F.array_join(F.concat(F.slice(lines, 1, F.greatest(fits, F.lit(0))), note), "\n"))


def leaf_contexts(leaves: DataFrame, entities: DataFrame, edges: DataFrame, budget: int = 12_000) -> DataFrame:
    """(community_id, content_hash, entity_text, relation_text).  leaves:
    entity_id, community_id; entities: id, name, type, description; edges: src, dst, type, weight, descriptions."""
    own = leaves.join(entities.withColumnRenamed("id", "entity_id"), "entity_id").join(degrees(entities, edges).withColumnRenamed("id", "entity_id"), "entity_id")
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), F.coalesce("description", F.lit("")))
    sorted_lines = lambda *by: F.transform(F.sort_array(F.collect_list(F.struct(*by, "line"))), lambda x: x["line"])
    ents = own.withColumn("line", line).groupBy("community_id").agg(sorted_lines((-F.col("degree")).alias("d"), F.col("entity_id")).alias("e"))
    a = leaves.select(F.col("entity_id").alias("src"), F.col("community_id"))
    b = leaves.select(F.col("entity_id").alias("dst"), F.col("community_id").alias("other"))
    names = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    inner = edges.join(a, "src").join(b, "dst").where("community_id = other").join(names("src"), "src").join(names("dst"), "dst")
    line = F.concat(F.lit("- "), "src_name", F.lit(" -["), "type", F.lit("]-> "), "dst_name", F.lit(": "), F.array_join("descriptions", " "))
    rels = inner.withColumn("line", line).groupBy("community_id").agg(sorted_lines((-F.col("weight")).alias("w"), F.col("src"), F.col("dst"), F.col("type")).alias("r"))
    none = F.array().cast("array<string>")
    both = ents.join(rels, "community_id", "left").withColumn("r", F.coalesce("r", none))
    return both.select(
        "community_id",
        digest(F.concat(F.array(F.lit("leaf")), F.array_sort("e"), F.array_sort("r"))).alias("content_hash"),
        cut_lines(F.col("e"), budget * 6 // 10).alias("entity_text"),
        cut_lines(F.col("r"), budget * 4 // 10).alias("relation_text"),
    )


def summarised(communities: DataFrame, contexts: DataFrame, singles: DataFrame, cache: DataFrame, provider, budget: int = 12_000) -> DataFrame:
    """(id, content_hash, title, summary), bottom up: leaves from contexts,
    singletons from their entity, parents from their children; hashes that the cache knows skip the model."""
    done = None
    top = communities.agg(F.max("level")).head()[0]
    schema = "id string, content_hash string, title string, summary string"
    for level in range((-1 if top is None else top) + 1):
        here = communities.where(F.col("level") == level)
        if level == 0:
            rows = here.join(contexts.withColumnRenamed("community_id", "id"), "id").join(singles.withColumnRenamed("community_id", "id"), "id", "left")
            rows = rows.select("id", "content_hash", F.concat(F.lit("Entities:\n"), "entity_text", F.lit("\nRelationships:\n"), "relation_text").alias("prompt"), F.col("single_name").alias("known_title"), F.col("single_text").alias("known_text"))
        else:
            kids = communities.select(F.col("id").alias("kid"), F.col("parent_id").alias("id"), "size").join(done.withColumnRenamed("id", "kid"), "kid")
            item = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "kid", F.concat(F.lit("- ["), "title", F.lit("] "), "summary").alias("line"))))
            rows = here.select("id").join(kids, "id").groupBy("id").agg(digest(F.concat(F.array(F.lit("parent")), F.sort_array(F.collect_list("content_hash")))).alias("content_hash"), cut_lines(F.transform(item, lambda x: x["line"]), budget).alias("prompt"))
            rows = rows.withColumn("known_title", F.lit(None).cast("string")).withColumn("known_text", F.lit(None).cast("string"))
        old = cache.dropDuplicates(["content_hash"]).select("content_hash", F.col("title").alias("old_title"), F.col("summary").alias("old_summary"))
        rows = rows.join(old, "content_hash", "left").select("id", "content_hash", "prompt", F.coalesce("known_title", "old_title").alias("title"), F.coalesce("known_text", "old_summary").alias("summary"))

        def ask(frames):
            for f in frames:
                for i in f.index[f.title.isna() | f.summary.isna()]:
                    f.loc[i, "title"], f.loc[i, "summary"] = provider.summary(f.prompt[i])
                yield f[["id", "content_hash", "title", "summary"]]

        made = written(rows.mapInPandas(ask, schema))  # a model's answer is never computed twice
        done = made if done is None else done.unionByName(made)
    return done if done is not None else communities.sparkSession.createDataFrame([], schema)
