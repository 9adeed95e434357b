"""N-gram Jaccard join by size-banded tiles of hashed bitmap signatures.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their shingle
sets.  Equal sets collapse to one node first.  Candidates come from the prefix
lemma, which loses no link: under one total order of the shingles, two linked
sets share a shingle among the first n - ceil(3n/4) + 1 of each.  The order
puts shingles that many sets hold last, so that a passage shared by a third
of all documents makes no huge group; any order is exact.

Sets that share a prefix shingle are compared inside size bands (a link needs
3/4 of the size, so it spans neighbouring bands at most), first by bitmaps:
|A & B| <= min(|A| - |a \\ b|, |B| - |b \\ a|) over the bits, which discards
pairs before the sorted arrays of the sets are intersected exactly.

Groups are never expanded to all pairs:

1. Stars.  Each member is checked against the first of its (shingle, band);
   the shingles of a group take their firsts by one of eight random orders, so
   that near copies which one first misses meet another.  The components of
   these links are contracted.
2. Tiles.  A shingle's group that still spans components is cut into tiles of
   TILE rows of one band.  Tile pairs of one component, or whose sizes cannot
   link, are skipped.  A tile pair gives spanning forests of the pairs that its
   bitmaps allow, at most FORESTS of them, and these are intersected.
3. Exact tiles.  A tile pair that had more candidates than its forests (a
   family of near misses) gets the sets of their members, intersects them in place
   and gives links only.

A pair that shares several shingles is met under the least of them, and under
others only where LEAST_KEYS of each member do not show it.

Every pair that shares a prefix shingle is then connected or ruled out.

Defined cases: a null, empty or wordless text has no shingles, links with
nothing and is its own component; a text of fewer than five words is one
shingle; a null id links its row but is nobody's component id unless all ids of the
component are null; repeated rows link; an empty table gives an empty result;
other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.llm.common import most_frequent, text_of, tidy
from terrace.llm.shingles import shingle_set
from terrace.operators.components import components
from terrace.plans.scratch import bounded_join, dropped, small_batches, written

#: Sets hold a shingle this often: it moves to the end of the order.
HOT_COUNT = 16
#: At most so many shingles are moved (8 bytes each are broadcast); the most frequent ones.
HOT_ROWS = 1_000_000
#: Share of the hash space whose shingles come first in the order.
REGION = np.uint64(int(0.33 * 2**64))
TILE = 512
#: Spanning forests of candidates that a tile pair gives before it is solved by exact sets.
FORESTS = 16
#: Members of a star that one task intersects with its first.
STAR = 64
#: Least keys of a member by which tiles tell that a pair meets elsewhere too.
LEAST_KEYS = 8
#: Tiles up to this many rows are compared pair by pair, larger ones row by row.
SMALL = 24
#: A place is the band of a set's size, then the task and row that read it.
BAND_SHIFT, TASK_SHIFT = 54, 30


def linked(a: int, b: int, both: int) -> bool:
    return 100 * both >= 75 * (a + b - both)


def need(n):
    """Least overlap that a set of n can link with."""
    return (3 * n + 3) // 4


def band(n: int) -> int:
    """Linked sets are of the same or of neighbouring bands."""
    return int(math.log(n) / math.log(4 / 3)) if n else 0


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the hashes, two to four a shingle, a power of two of them."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def bound(n: int, a: int, width: int, m: int, b: int, other: int) -> float:
    """The similarity that the bitmaps (as numbers of ``width`` and ``other``
    bits) of sets of n and m allow at most, 0 if that or the sizes rule a link out."""
    if 4 * min(n, m) < 3 * max(n, m):
        return 0.0
    while width > other:
        width >>= 1
        a = a >> width | a & (1 << width) - 1
    while other > width:
        other >>= 1
        b = b >> other | b & (1 << other) - 1
    most = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return most / max(n + m - most, 1) if 100 * most >= 75 * (n + m - most) else 0.0


def _folded(a: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps brought to ``size`` bytes."""
    return a if a.shape[-1] == size else np.bitwise_or.reduce(a.reshape(*a.shape[:-1], -1, size), axis=-2)


class Signatures:
    """Sets (sizes and bitmaps) of one tile, stacked by width of bitmap."""

    def __init__(self, ns: np.ndarray, bits: list[np.ndarray]) -> None:
        self.ns, self.bits = ns, bits
        widths = np.array([len(b) for b in bits])
        self.stacks = [(at, np.stack([bits[i] for i in at.tolist()])) for at in (np.flatnonzero(widths == w) for w in np.unique(widths))]

    def shares(self, i: int, among: np.ndarray) -> np.ndarray:
        """For set i with the sets of a mask: the bound of the similarity by bit counts, 0 where it or the sizes rule a link out."""
        n, own = int(self.ns[i]), self.bits[i]
        out = np.zeros(len(self.ns))
        for at, stack in self.stacks:
            ns = self.ns[at]
            fit = among[at] & (4 * np.minimum(n, ns) >= 3 * np.maximum(n, ns))
            if fit.any():
                size = min(len(own), stack.shape[1])
                a, b, ns = _folded(own, size), _folded(stack[fit], size), ns[fit]
                most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), ns - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                out[at[fit]] = np.where(100 * most >= 75 * (n + ns - most), most / np.maximum(n + ns - most, 1), 0.0)
        return out


class Forest:
    """Union-find over a few labels."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, c: int) -> int:
        p = self.parent
        while (up := p.setdefault(c, c)) != c:
            p[c] = c = p.setdefault(up, up)
        return c

    def joins(self, a: int, b: int) -> bool:
        """Whether a and b were apart; they are not any more."""
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _sets(docs: DataFrame) -> DataFrame:
    """place, doc_id, n, cls (128 bits of the set), md5 (of the text); for the first
    of a class in a task also low, the first hashes of the set: those of REGION, or more if
    the prefix needs them, and bits."""

    def run(batches):
        task, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                s = shingle_set(text)
                md5 = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                cls = xxhash.xxh3_128_digest(s.tobytes())
                low = bits = None
                if len(s) and cls not in seen:
                    if len(seen) < 1_000_000:  # beyond, a class may have more than one first
                        seen.add(cls)
                    p = len(s) - need(len(s)) + 1
                    low = s[: max(p, int(np.searchsorted(s, REGION)))].view(np.int64)
                    bits = bitmap(s)
                for a, v in zip(out, (band(len(s)) << BAND_SHIFT | task << TASK_SHIFT | row, doc_id, len(s), cls, md5, low, bits)):
                    a.append(v)
                row += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([pa.array(a, t) for a, t in zip(out, types)], names=["place", "doc_id", "n", "cls", "md5", "low", "bits"])

    return docs.select(docs["doc_id"].cast("long"), text_of(docs)).mapInArrow(tidy(run), "place long, doc_id long, n long, cls binary, md5 binary, low array<long>, bits binary")


def _prefixes(heads: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, place) for the prefix shingles of each set."""
    shared = heads.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        late = shared.value
        for batch in batches:
            keys, places = [], []
            for n, place, low in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2)):
                low = low.values.to_numpy()
                p = n - need(n) + 1
                inside = low.view(np.uint64) < REGION
                at = np.searchsorted(late, low)
                is_hot = (late[np.minimum(at, len(late) - 1)] == low) & inside if len(late) else np.zeros(len(low), bool)
                tier = np.where(is_hot, 1, np.where(inside, 0, 2))
                first = low[np.argsort(tier, kind="stable")[:p]]
                keys.append(first)
                places.append(np.full(len(first), place))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["key", "place"])

    return heads.select("place", "n", "low").mapInArrow(tidy(run), "key long, place long")


def _stars(prefixes: DataFrame) -> DataFrame:
    """Rows (a, b, null): first and member of a (key, band), and the firsts of
    neighbouring bands; rows (a, null, key): the members of keys of three or more.  Streams over sorted rows."""

    def run(batches):
        key = band = None
        first = 0
        held: list[int] = []
        count = 0
        for batch in batches:
            a_out, b_out, key_a, key_k = [], [], [], []
            ks, ps = (batch.column(i).to_numpy() for i in range(2))
            n = len(ks)
            start = np.concatenate(([True], ks[1:] != ks[:-1])) if n else np.zeros(0, bool)
            if n and ks[0] == key:
                start[0] = False
            # A row alone in its key, here and across the edges of the batch, makes nothing.
            alone = start.copy()
            alone[:-1] &= start[1:]
            if n:
                alone[-1] = False
            for k, p in zip(ks[~alone].tolist(), ps[~alone].tolist()):
                b = p >> BAND_SHIFT
                if k != key:
                    key, band, first, count, held = k, b, p, 1, [p]
                    continue
                count += 1
                if b != band:
                    if b == band + 1:
                        a_out.append(first)
                        b_out.append(p)
                    band, first = b, p
                else:
                    a_out.append(first)
                    b_out.append(p)
                if count < 3:
                    held.append(p)
                elif count == 3:
                    key_a += [*held, p]
                    key_k += [k] * 3
                else:
                    key_a.append(p)
                    key_k.append(k)
            if a_out or key_a:
                yield pa.record_batch(
                    [
                        pa.array([*a_out, *key_a], pa.int64()),
                        pa.array([*b_out, *[None] * len(key_a)], pa.int64()),
                        pa.array([*[None] * len(a_out), *key_k], pa.int64()),
                    ],
                    names=["a", "b", "key"],
                )

    # The random order is made behind the shuffle, which moves two numbers a row.
    order = F.xxhash64("place", F.pmod("key", F.lit(8)))
    ordered = prefixes.repartition("key").sortWithinPartitions("key", F.shiftright("place", BAND_SHIFT), order, "place")
    return ordered.select("key", "place").mapInArrow(tidy(run), "a long, b long, key long")


def _by_bits(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bound by bit counts lets pass."""
    side = lambda x: signatures.select(F.col("place").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            ok = []
            for n, m, p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                ok.append(bound(n, int.from_bytes(p, "little"), 8 * len(p), m, int.from_bytes(q, "little"), 8 * len(q)) > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(tidy(run), "a long, b long")


def _items(docs: DataFrame, signatures: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, items (the sorted set) of the wanted nodes (column place), read
    again from the texts; copies of a text may give a node more than once."""
    keys = written(signatures.select("place", "md5").join(wanted, "place", "left_semi").select("place", F.col("md5").alias("key")))
    texts = docs.select(text_of(docs).alias("text"))
    texts = bounded_join(texts.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary")))), keys, "key", "inner", 64)

    def run(batches):
        seen = set()
        for batch in batches:
            places, arrays = [], []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if place not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(place)
                    places.append(place)
                    arrays.append(shingle_set(text.as_py()).tobytes())
            yield pa.record_batch([pa.array(places, pa.int64()), pa.array(arrays, pa.binary())], names=["place", "items"])

    out = written(texts.select("place", "text").mapInArrow(tidy(run), "place long, items binary"))
    dropped(keys)
    return out


def _exact(docs: DataFrame, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The linked ones among the written pairs (a, b), by intersecting the
    sorted sets.  A first's set moves once for every STAR of its members."""
    items = _items(docs, signatures, pairs.select(F.col("a").alias("place")).union(pairs.select("b")).distinct())
    sizes = pairs.groupBy("a").agg(F.floor(F.count("*") / STAR + 1).alias("parts"))
    dealt = written(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    members = bounded_join(items.withColumnRenamed("place", "b"), dealt, "b", "inner", 48).select("a", "part", "b", "items")
    firsts = written(dealt.select("a", "part").distinct())
    centres = bounded_join(items.withColumnRenamed("place", "a"), firsts, "a", "inner", 40).select("a", "part", F.lit(None).cast("long").alias("b"), "items")
    ordered = centres.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def check(batches):
        first, s, last = None, None, None
        for batch in batches:
            out = ([], [])
            for a, part, b, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if b is None:
                    if first != (a, part):
                        first, s = (a, part), np.frombuffer(data.as_py(), np.uint64)
                        last = None
                elif b != last:
                    last, t = b, np.frombuffer(data.as_py(), np.uint64)
                    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                    if linked(len(s), len(t), both):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    found = written(ordered.mapInArrow(tidy(check), "a long, b long"))
    dropped(items, dealt, firsts)
    return found


def _tile_rows(groups: DataFrame, comp: DataFrame, signatures: DataFrame, tile: int) -> DataFrame:
    """key, t (the tile: 0, or band and number), a, comp, n of the keys that span components."""
    rows = groups.join(comp.withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("component", "a")).drop("component")
    rows = rows.join(signatures.select(F.col("place").alias("a"), "n"), "a")
    spans = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("key", "many")
    rows = written(rows.join(spans, "key"))
    few = rows.where(F.col("many") <= tile).withColumn("t", F.lit(0).cast("long"))
    own = F.shiftright("a", BAND_SHIFT)
    order = Window.partitionBy("key", own).orderBy("comp", "n", "a")
    many = rows.where(F.col("many") > tile).withColumn("t", F.shiftleft(own + 1, 32) + F.floor((F.row_number().over(order) - 1) / tile))
    out = written(few.unionByName(many).select("key", "t", "a", "comp", "n"))
    dropped(rows)
    return out


def _tile_pairs(rows: DataFrame) -> DataFrame:
    """(key, t, t2): tiles to compare, of one band or of neighbouring ones."""
    stats = rows.groupBy("key", "t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("many"))
    single = stats.where("t = 0").select("key", "t", F.col("t").alias("t2"))
    large = written(stats.where("t > 0"))
    other = large.select("key", *[F.col(c).alias(f"{c}2") for c in ("t", "lo", "hi", "least", "most", "many")])
    other = other.withColumn("band", F.explode(F.array(F.shiftright("t2", 32), F.shiftright("t2", 32) - 1)))
    # Sizes ascend with the bands, not inside one.
    fits = "t <= t2 AND (t < t2 OR many > 1) AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2) AND 4 * most >= 3 * least2 AND 4 * most2 >= 3 * least"
    return single.unionByName(large.withColumn("band", F.shiftright("t", 32)).join(other, ["key", "band"]).where(fits).select("key", "t", "t2"))


def _lesser(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (key, a, ...) with lesser, those of the least keys of a that are below the row's own."""
    return rows.join(keys, "a").withColumn("lesser", F.filter("keys", lambda x: x < F.col("key"))).drop("keys")


def _sided(rows: DataFrame, pairs: DataFrame, signatures: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of each tile pair, the first tile's before the second's, with bits and lesser keys."""
    one = rows.join(pairs, ["key", "t"]).withColumn("side", F.lit(0))
    two = rows.withColumnRenamed("t", "t2").join(pairs.where("t <> t2"), ["key", "t2"]).withColumn("side", F.lit(1))
    both = _lesser(one.unionByName(two).join(signatures.select(F.col("place").alias("a"), "n", "bits"), "a"), keys)
    return both.select("key", "t", "t2", "side", "a", "comp", "n", "bits", "lesser").repartition("key", "t", "t2").sortWithinPartitions("key", "t", "t2", "side", "a")


def _candidates(both: DataFrame, forests: int) -> DataFrame:
    """Pairs (a, b) of different components that the bitmaps of a tile pair
    allow, likeliest first: spanning forests over its components, each with
    fewer pairs than the tiles have rows.  A pair whose members are seen to share
    a lesser key is left to that; under the least one it is given.  Rows (a, null, key, t, t2, side) name the members of further pairs."""
    names = ["a", "b", "key", "t", "t2", "side"]

    def by_pairs(rows):
        sets = [(r[3], r[5], r[6], int.from_bytes(r[7], "little"), 8 * len(r[7])) for r in rows]
        lone = not sets[-1][0]
        for i, (side, comp, n, bits, width) in enumerate(sets):
            for j in range(i):
                side2, comp2, m, bits2, width2 = sets[j]
                if comp != comp2 and (lone or side != side2) and (share := bound(n, bits, width, m, bits2, width2)):
                    yield -share, j, i

    def by_rows(rows):
        _, _, _, side, _, comp, n, bits, _ = zip(*rows)
        side, comp = np.array(side), np.array(comp)
        sets = Signatures(np.array(n), [np.frombuffer(b, np.uint8) for b in bits])
        lone = not side.any()
        # A pair of two components has a member outside the tiles' largest one.
        code = np.unique(comp, return_inverse=True)[1]
        largest = code == np.argmax(np.bincount(code))
        index = np.arange(len(comp))
        for i in np.flatnonzero(~largest).tolist():
            others = comp != comp[i]
            if lone:
                others &= largest | (index > i)
            else:
                others &= (side != side[i]) & (largest | (side[i] == 0))
            if others.any():
                share = sets.shares(i, others)
                for j in np.flatnonzero(share > 0).tolist():
                    yield -share[j], i, j

    def solve(rows):
        if len(rows) < 2:
            return []
        place, comp = [r[4] for r in rows], [r[5] for r in rows]
        lesser: dict[int, set] = {}

        def under(i):
            if i not in lesser:
                lesser[i] = set(rows[i][8])
            return lesser[i]

        edges = sorted(x for x in (by_pairs if len(rows) <= SMALL else by_rows)(rows) if under(x[1]).isdisjoint(under(x[2])))
        out = []
        for _ in range(forests):
            if not edges:
                break
            tree, rest = Forest(), []
            for x in edges:
                i, j = x[1:]
                if tree.joins(comp[i], comp[j]):
                    out.append((min(place[i], place[j]), max(place[i], place[j]), None, None, None, None))
                else:
                    rest.append(x)
            edges = rest
        more = {i for x in edges for i in x[1:]}
        return out + [(place[i], None, *rows[i][:4]) for i in sorted(more)]

    def run(batches):
        current, held, found = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != current:
                    found += solve(held)
                    current, held = row[:3], []
                held.append(row)
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=names)
                found = []
        if found := solve(held):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=names)

    return both.mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))


def _exact_tiles(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join components, among rows (key, t, t2, side, a, comp,
    items, lesser), by intersecting the sets of a tile pair; a pair that is seen
    to share a lesser key is left to that.  The first tile's sets are held, those of the second stream by."""

    def run(batches):
        current, tree = None, Forest()
        held: list[tuple] = []  # a, comp, set, lesser keys
        links: tuple[list, list] = ([], [])

        def meets(a, comp, s, lesser, others):
            n, lesser = len(s), set(lesser)
            near = [x for x in others if 4 * min(n, len(x[2])) >= 3 * max(n, len(x[2])) and tree.root(x[1]) != tree.root(comp) and lesser.isdisjoint(x[3])]
            if not near:
                return
            ends = np.cumsum([len(x[2]) for x in near])
            items = np.concatenate([x[2] for x in near])
            hit = s[np.minimum(np.searchsorted(s, items), n - 1)] == items
            both = np.add.reduceat(hit, ends - [len(x[2]) for x in near], dtype=np.int64)
            for x, k in zip(near, both.tolist()):
                if linked(n, len(x[2]), k) and tree.joins(comp, x[1]):
                    links[0].append(x[0])
                    links[1].append(a)

        for batch in batches:
            for key, t, t2, side, a, comp, data, lesser in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), batch.column(7).to_pylist()):
                if (key, t, t2) != current:
                    current, tree, held = (key, t, t2), Forest(), []
                s = np.frombuffer(data.as_py(), np.uint64)
                if side or t == t2:
                    meets(a, comp, s, lesser, held)
                if not side:
                    held.append((a, comp, s, lesser))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in links], names=["a", "b"])
            links[0].clear()
            links[1].clear()

    ordered = rows.select("key", "t", "t2", "side", "a", "comp", "items", "lesser").repartition("key", "t", "t2").sortWithinPartitions("key", "t", "t2", "side", "a")
    return ordered.mapInArrow(tidy(run), "a long, b long")


def joined(docs: DataFrame, tile: int = TILE, hot_count: int = HOT_COUNT, hot_rows: int = HOT_ROWS, forests: int = FORESTS) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row."""
    return _labelled(docs, tile, hot_count, hot_rows, forests).drop("md5")


def _labelled(docs: DataFrame, tile: int = TILE, hot_count: int = HOT_COUNT, hot_rows: int = HOT_ROWS, forests: int = FORESTS) -> DataFrame:
    """``joined`` with the md5 of each row's text."""
    small_batches(docs.sparkSession)
    sets = written(_sets(docs))
    heads = sets.where("low IS NOT NULL")
    hot = heads.select(F.explode("low").alias("key")).where(F.col("key").between(0, int(REGION)))  # REGION < 2**63: not negative
    hot = written(hot.groupBy("key").count().where(F.col("count") >= hot_count))
    late = most_frequent(hot, "count", hot_rows).select("key").toArrow()
    late = np.sort(late.column(0).to_numpy()) if late.num_rows else np.empty(0, np.int64)
    stars = written(_stars(_prefixes(heads, late)))
    # Heads of one class are one node: the least place.
    classes = written(heads.groupBy("cls").agg(F.min("place").alias("node")))
    nodes = written(heads.select("place", "cls").join(classes, "cls").select("place", "node"))
    signatures = written(heads.select("place", "n", "md5", "bits").join(nodes.where("place = node").select("place"), "place"))
    rows = written(sets.select("doc_id", "n", "cls", "md5"))
    dropped(sets, hot)
    merged = nodes.where("place <> node").select(F.col("place").alias("a"), F.col("node").alias("b"))
    pairs = stars.where("b IS NOT NULL").select("a", "b").distinct()
    pairs = _renamed(_renamed(pairs, "a", nodes), "b", nodes).where("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    groups = written(_renamed(stars.where("key IS NOT NULL").select("a", "key"), "a", nodes).distinct())
    dropped(stars)
    passed = written(_by_bits(pairs, signatures))
    good = _exact(docs, passed, signatures)
    links = good.union(merged)
    comp = written(components(links))
    tiles = _tile_rows(groups, comp, signatures, tile)
    keys = written(tiles.groupBy("a").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("keys")))  # no more are gathered than a set's prefix
    found = written(_candidates(_sided(tiles.drop("n"), written(_tile_pairs(tiles)), signatures, keys), forests))
    more = written(found.where("b IS NOT NULL").select("a", "b").join(passed, ["a", "b"], "left_anti"))
    rest = found.where("b IS NULL").drop("b")
    dropped(pairs, passed, groups, tiles)
    if not more.isEmpty():
        comp = _contracted(comp, _exact(docs, more, signatures))
    if not rest.isEmpty():
        items = _items(docs, signatures, rest.select(F.col("a").alias("place")).distinct()).dropDuplicates(["place"]).withColumnRenamed("place", "a")
        rest = rest.join(comp.withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("component", "a"))
        comp = _contracted(comp, written(_exact_tiles(_lesser(rest, keys).join(items, "a"))))
    dropped(signatures, keys, found)
    # Least id of the component of each class, then of each row.
    of_class = classes.join(comp, "node", "left").select("cls", F.coalesce("component", "node").alias("comp"))
    ids = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = ids.join(of_class, "cls")
    least = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "component_id")
    out = rows.join(least.withColumnRenamed("cls", "k"), (F.col("n") > 0) & (F.col("cls") == F.col("k")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "md5")


def _contracted(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b): only the components that they join are labelled anew."""
    if links.isEmpty():
        return comp
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = written(comp.unionByName(ends.join(comp, "node", "left_anti").withColumn("component", F.col("node"))))
    to = lambda c: every.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined_ = written(components(links.join(to("a"), "a").join(to("b"), "b").select("ca", "cb")))
    return written(every.join(joined_.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _renamed(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """Places in ``column`` replaced by the node of their class."""
    to = nodes.withColumnsRenamed({"place": column, "node": "__node"})
    return rows.join(to, column).drop(column).withColumnRenamed("__node", column)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; wordless
    and unlinked rows all stay, of rows that repeat an id and a text one stays.
    A row goes by its id and text, as other rows of its id may be unlinked."""
    gone = _labelled(docs).where("n_shingles > 0 AND NOT doc_id <=> component_id").select(F.col("doc_id").alias("__gone"), F.col("md5").alias("__md5")).distinct()
    gone = written(gone)
    own = F.unhex(F.md5(text_of(docs).cast("binary")))
    kept = bounded_join(docs, gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (own == gone["__md5"]), "left_anti", 80)
    again = written(kept.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return kept
    on = kept["doc_id"].eqNullSafe(again["__again"])
    return bounded_join(kept, again, on, "left_anti", 48).unionByName(bounded_join(kept, again, on, "left_semi", 48).dropDuplicates(["doc_id", "text"]))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
