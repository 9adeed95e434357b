"""Suffix-array dedup by longest-previous-factor arrays over shared anchors.

A byte goes if a string of LENGTH bytes that covers it starts elsewhere too.
Only suffixes that can match are ever compared.  Each LENGTH-byte window has
an anchor, the K-byte substring in it with the least hash; equal windows have
equal anchors at equal offsets.  The windows that share an anchor occurrence
form one segment:

* an anchor that occurs once in the corpus has no match; its rows end there;
* equal segments are one, with their number: the factor at the start of a
  later copy is the segment, so only its digest moved;
* the different segments of an anchor are brought together, one copy of each,
  and their suffix array is built by prefix doubling.  In suffix order the
  previous and next smaller positions give the longest previous factor (LPF) of
  every window start, the previous and next larger ones its mirror, the
  longest next factor.  A window whose factor reaches LENGTH is repeated.

An anchor with more than GROUP different segments is split before its suffix
array is built: of the bytes of a window beside the anchor, equal windows share
the nearer half on the left or on the right, so segments are dealt by the digest
of either half (``_split``), again and again until a group is small or
all of its windows are equal; pieces that are equal as a whole become one.  No group is gathered whole in one task.

Both directions of the factors are used: all occurrences go, or with
``keep_first`` only those that have an earlier one, in the order of reading.

Defined cases: a null text is the empty text and, as any text under LENGTH
bytes, loses nothing; overlapping matches within one text count; rows that
repeat a text lose it all (at LENGTH bytes and over); ids are not used, so null or repeated ids do no
harm; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import text_of
from terrace.llm.shingles import mixed
from terrace.plans.scratch import bounded_join, dropped, small_batches, written

LENGTH = 200
K = 64
GROUP = 2048
#: Bytes of segments whose suffix array is built at once, if not one group has more.
BLOCK = 1_000_000
#: Bytes that one number holds when suffixes are first sorted.
PACK = 7
_P = np.uint64(0x5851F42D4C957F2D)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int):
    size = 1 << max(14, n.bit_length())
    if size not in _cache:
        made = _powers(_P, size), _powers(_P_INVERSE, size)
        if size > 1 << 22:  # one very long text does not stay in memory
            return made
        _cache.clear()
        _cache[size] = made
    return _cache[size]


def anchors(data: bytes, length: int = LENGTH, k: int = K):
    """(hash, position, first window, last window) of the anchors of a text, as arrays."""
    n = len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    up, down = _tables(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.frombuffer(data, np.uint8).astype(np.uint64) * up[:n])))
    h = mixed((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
    width = length - k + 1
    at = np.arange(len(h), dtype=np.int32)
    span = 1
    while span < width:  # leftmost least hash in windows of 1, 2, 4 ... width
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        span += step
    cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
    pos = at[cut[:-1]].astype(np.int64)
    return h[pos].view(np.int64), pos, cut[:-1], cut[1:] - 1


class Suffixes:
    """Order of the suffixes of segments laid end to end; a suffix ends with its segment."""

    def __init__(self, segments: list[bytes], length: int) -> None:
        sizes = np.array([len(b) for b in segments], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.starts[-1])
        self.room = np.repeat(self.starts[1:], sizes) - np.arange(n)
        data = np.concatenate((np.frombuffer(b"".join(segments), np.uint8), np.zeros(PACK, np.uint8))).astype(np.uint64)
        pack = np.minimum(self.room, PACK).astype(np.uint64)
        for i in range(PACK):
            pack |= np.where(self.room > i, data[i : n + i], np.uint64(0)) << np.uint64(8 * (PACK - i))
        self.pack = pack
        #: (span, rank of the prefixes of that many bytes), doubling up to ``length`` or more.
        self.ranks = [(PACK, np.unique(pack, return_inverse=True)[1].astype(np.int32))]
        while self.ranks[-1][0] < length:
            span, rank = self.ranks[-1]
            second = np.zeros(n, np.int64)
            second[: n - span] = rank[span:] + 1
            second[self.room <= span] = 0
            self.ranks.append((2 * span, np.unique(rank.astype(np.int64) * (n + 1) + second, return_inverse=True)[1].astype(np.int32)))

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at p and q, cut at the depth to which they are sorted."""
        out = np.zeros(len(p), np.int64)
        room = np.minimum(self.room[p], self.room[q])

        def step(span: int, same) -> None:
            at = np.flatnonzero(room - out >= span)
            at = at[same(p[at] + out[at], q[at] + out[at])]
            out[at] += span

        for span, rank in reversed(self.ranks):
            step(span, lambda x, y, rank=rank: rank[x] == rank[y])
        for span in (4, 2, 1):  # of fewer bytes than a number holds
            step(span, lambda x, y, cut=np.uint64(8 * (PACK + 1 - span)): self.pack[x] >> cut == self.pack[y] >> cut)
        return np.minimum(out, self.ranks[-1][0])


def nearest_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each i the last j < i with values[j] < values[i] and j >= first[i], else -1; by minima of doubling spans."""
    n = len(values)
    index = np.arange(n)
    least = [values]  # least[k][i]: the least of the 2**k values up to i
    longest = int((index - first).max(initial=0))
    while 1 << len(least) <= longest:
        half, below = 1 << (len(least) - 1), least[-1]
        least.append(np.concatenate((below[:half], np.minimum(below[half:], below[:-half]))))
    end = index.copy()
    for k in range(len(least) - 1, -1, -1):
        at = np.flatnonzero(end - (1 << k) >= first)
        at = at[least[k][end[at] - 1] > values[at]]
        end[at] -= 1 << k
    return np.where(end > first, end - 1, -1)


def factors(segments: list[tuple[int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments (group, bytes) laid end to end: the start of each, and for
    each position its longest previous and longest next factor: of the suffixes
    of the same group at earlier and at later positions the longest common
    prefix with this one.  Factors under ``length`` are given as 0, longer ones
    are cut at the depth to which ``Suffixes`` sorts."""
    s = Suffixes([b for _, b in segments], length)
    n = int(s.starts[-1])
    previous, following = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(s.room >= length)
    group = np.repeat(np.array([g for g, _ in segments], np.int64), np.diff(s.starts))[live]
    order = np.lexsort((live, s.ranks[-1][1][live], group))
    suffixes, group = live[order], group[order]
    # Smaller positions across a common prefix under ``length`` give no factor, so they are sought inside runs.
    near = np.zeros(len(suffixes) + 1, bool)
    near[1:-1] = (group[1:] == group[:-1]) & (s.common(suffixes[1:], suffixes[:-1]) >= length) if len(suffixes) else False
    inside = near[:-1] | near[1:]
    suffixes, begins = suffixes[inside], ~near[:-1][inside]
    if not len(suffixes):
        return s.starts, previous, following
    index = np.arange(len(suffixes))
    first = np.maximum.accumulate(np.where(begins, index, 0))
    ends = np.append(np.flatnonzero(begins)[1:], len(suffixes))
    last = ends[np.cumsum(begins) - 1] - 1
    for out, values in ((previous, suffixes), (following, -suffixes)):
        before = nearest_smaller(values, first)
        after = nearest_smaller(values[::-1], len(values) - 1 - last[::-1])[::-1]
        after = np.where(after >= 0, len(values) - 1 - after, -1)
        for other in (before, after):
            at = np.flatnonzero(other >= 0)
            out[suffixes[at]] = np.maximum(out[suffixes[at]], s.common(suffixes[at], suffixes[other[at]]))
    return s.starts, previous, following


def _anchor_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """h, c (digest of segment and offset), place (number of the row that was
    read), at (first window, windows beyond it and offset of the anchor, as one
    number); one per anchor occurrence.  A row with doc (digest of the text) names
    each place.  Of the copies of a text in one task two are read, which shows that it repeats."""
    width = length - k + 1

    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        seen: dict[bytes, int] = {}
        for batch in batches:
            parts, c, places, names = [], [], [], []
            for text in batch.column(0):
                data = text.as_py().encode("utf-8", "surrogatepass")
                row += 1
                if len(data) < length:
                    continue
                key = hashlib.md5(data).digest()
                if len(seen) < 1_000_000 or key in seen:
                    seen[key] = seen.get(key, 0) + 1
                    if seen[key] > 2:
                        continue
                h, pos, lo, hi = anchors(data, length, k)
                place = task << 33 | row
                parts.append((h, np.full(len(h), place), (lo * width + hi - lo) * width + pos - lo))
                c += [xxhash.xxh64_intdigest(data[a : b + length], p - a) for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist())]
                places.append(place)
                names.append(key)
            if parts:
                h, place, at = (np.concatenate(x) for x in zip(*parts))
                none, own = len(names), len(h)
                c = np.array(c, np.uint64).view(np.int64)
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate((h, np.zeros(none, np.int64))), mask=np.arange(own + none) >= own),
                        pa.array(np.concatenate((c, np.zeros(none, np.int64)))),
                        pa.array(np.concatenate((place, places))),
                        pa.array(np.concatenate((at, np.zeros(none, np.int64)))),
                        pa.array([*[None] * own, *names], pa.binary()),
                    ],
                    names=["h", "c", "place", "at", "doc"],
                )

    return docs.select(text_of(docs)).mapInArrow(run, "h long, c long, place long, at long, doc binary")


_COLUMNS = ("g", "h", "c", "place", "first", "base", "lead")
_PIECE = ", ".join(f"{x} long" for x in _COLUMNS) + ", bytes binary"


def _pieces(docs: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """The segments of ``wanted`` (h, c, place, at, doc) with their bytes, as
    rows of _PIECE: g (group) is the anchor, base the window at which bytes
    begin, lead the offset of the anchor in them.  A text and its segments meet
    by a shuffle at every size; of the copies of a text in one task one is read."""
    width = length - k + 1
    cuts = written(wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "place", "at")).alias("cuts")))  # no more than the text has anchors
    texts = docs.select(text_of(docs).cast("binary").alias("data"))
    texts = texts.where(F.length("data") >= length).withColumn("doc", F.unhex(F.md5("data")))

    def run(batches):
        seen = set()
        for batch in batches:
            out = tuple([] for _ in range(8))
            for key, data, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if key in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                data = data.as_py()
                for x in cuts.as_py():
                    rest, lead = divmod(x["at"], width)
                    lo, more = divmod(rest, width)
                    for column, v in zip(out, (x["h"], x["h"], x["c"], x["place"], x["at"], 0, lead, data[lo : lo + more + length])):
                        column.append(v)
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.binary())], names=[*_COLUMNS, "bytes"])

    return texts.join(cuts.hint("shuffle_merge"), "doc").select("doc", "data", "cuts").mapInArrow(run, _PIECE)


def _solved(pieces: DataFrame, length: int, keep_first: bool, block: int) -> DataFrame:
    """(h, c, a, b): the first and the last window of a segment (counted from its
    first) that match another segment of the group, by the factors of the group.
    The windows of a segment hold the same anchor, so what they cover is one range."""

    def run(batches):
        held: list[tuple] = []
        size, current, last = 0, None, None

        def solve():
            # Equal windows stand at equal offsets from their anchor, which the anchor's uniqueness in a window ensures.
            ids: dict[int, int] = {}
            starts, previous, following = factors([(ids.setdefault(x[0], len(ids)), x[4]) for x in held], length)
            hit = previous >= length if keep_first else np.maximum(previous, following) >= length
            out = ([], [], [], [])
            for i, (_, h, c, base, data) in enumerate(held):
                at = np.flatnonzero(hit[starts[i] : starts[i] + len(data)])
                if len(at):
                    for column, v in zip(out, (h, c, base + int(at[0]), base + int(at[-1]))):
                        column.append(v)
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["h", "c", "a", "b"])

        for batch in batches:
            for g, h, c, base, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (g, h, c) == last:
                    continue  # the same segment, from a copy of its text in another task
                last = g, h, c
                if size >= block and g != current:
                    yield solve()
                    held, size = [], 0
                data = data.as_py()
                held.append((g, h, c, base, data))
                size += len(data)
                current = g
        if held:
            yield solve()

    ordered = pieces.repartition("g").sortWithinPartitions("g", "place", "first", "h", "c")
    return ordered.select("g", "h", "c", "base", "bytes").mapInArrow(run, "h long, c long, a long, b long")


def _split(pieces: DataFrame, length: int, k: int, rest: int, half: int) -> DataFrame:
    """Pieces (with left, the bytes before the anchor that the windows of a
    group share; behind it they share length - k - rest - left) dealt by
    ``half`` more bytes on either side: each side keeps the windows that hold them."""
    names = [*_COLUMNS, "left", "bytes"]

    def run(batches):
        for batch in batches:
            out = tuple([] for _ in names)
            for g, h, c, place, first, base, lead, left, data in zip(*(batch.column(i).to_pylist() for i in range(9))):
                behind = lead + k + length - k - rest - left
                last = lead - (len(data) - length)  # offsets of the anchor in the piece's windows go down from lead to this
                for side, most, least, shared in ((1, left + rest, left + half, data[lead - left - half : lead - left]), (2, left + rest - half, left, data[behind : behind + half])):
                    begin, end = min(lead, most), max(last, least)
                    if begin < end:
                        continue
                    own = xxhash.xxh64_intdigest(shared, seed=g % 2**64 ^ side)
                    cut = lead - begin
                    for column, v in zip(out, ((own ^ 1 << 63) - (1 << 63), h, c, place, first, base + cut, begin, left + half * (side == 1), data[cut : cut + begin - end + length])):
                        column.append(v)
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:8]), pa.array(out[8], pa.binary())], names=names)

    return pieces.select(*names).mapInArrow(run, ", ".join(f"{x} long" for x in names[:8]) + ", bytes binary")


def _edge_matches(docs: DataFrame, wanted: DataFrame, length: int, k: int, keep_first: bool, group: int, block: int) -> DataFrame:
    """(h, c, a, b) as ``_solved``, for the written rows ``wanted`` (h, c, kinds, place, at, doc)."""
    out = written(_solved(_pieces(docs, wanted.where(F.col("kinds") <= group), length, k), length, keep_first, block))
    large = wanted.where(F.col("kinds") > group)
    rest = length - k
    pieces = None if large.isEmpty() else written(_pieces(docs, large, length, k).dropDuplicates(["g", "h", "c"]).withColumn("left", F.lit(0).cast("long")))
    while pieces is not None and rest and not pieces.isEmpty():  # at most log2(length) + 1 times
        half = -(-rest // 2)
        dealt = written(_split(pieces, length, k, rest, half))
        rest -= half
        # Pieces that are equal as a whole match as a whole, and one stands for them from here on.
        key = F.sha2("bytes", 256).alias("same")
        alike = written(dealt.groupBy("g", key).agg(F.count("*").alias("n"), F.min(F.struct("place", "first", "h", "c", "base")).alias("x")).where("n > 1"))
        marked_ = dealt.withColumn("same", key).join(alike, ["g", "same"], "left")
        is_first = F.struct("place", "first", "h", "c", "base") == F.col("x")
        marked_ = written(marked_.withColumn("copy", F.coalesce(~is_first, F.lit(False))).withColumn("again", F.col("n").isNotNull()).drop("x", "n", "same"))
        equal = marked_.where("copy" if keep_first else "again").select("h", "c", F.col("base").alias("a"), (F.col("base") + F.length("bytes") - length).alias("b"))
        out = out.unionByName(written(equal))
        dropped(dealt, alike)
        dealt = marked_.where("NOT copy").drop("copy", "again")
        sizes = written(dealt.groupBy("g").agg(F.count("*").alias("kinds"), F.min(F.struct("place", "first", "h", "c")).alias("x")).where("kinds > 1"))
        if rest:
            found = _solved(dealt.join(sizes.where(F.col("kinds") <= group).select("g"), "g", "left_semi"), length, keep_first, block)
        else:  # every window of a group holds the same bytes
            found = dealt.join(sizes.select("g", "x"), "g")
            if keep_first:
                found = found.where("NOT (place = x.place AND first = x.first AND h = x.h AND c = x.c)")
            found = found.select("h", "c", F.col("base").alias("a"), F.col("base").alias("b"))
        out = out.unionByName(written(found))
        dropped(pieces)
        pieces = written(dealt.join(sizes.where(F.col("kinds") > group).select("g"), "g", "left_semi"))
        dropped(marked_, sizes)
    return out.groupBy("h", "c").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def marked(docs: DataFrame, length: int = LENGTH, k: int = K, keep_first: bool = False, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """doc (128-bit digest of a text) and spans, the byte ranges [start, end) of it that repeat; texts without any are left out.

    With ``keep_first`` the first occurrence of each string in the order of
    reading stays; rows that repeat a whole text share its spans here, ``removed`` tells them apart."""
    small_batches(docs.sparkSession)
    width = length - k + 1
    rows = written(_anchor_rows(docs, length, k))
    names = written(rows.where("h IS NULL").select("place", "doc"))
    often = written(rows.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("total")).where("total > 1").select("h"))
    shared = bounded_join(rows.where("h IS NOT NULL").select("h", "c", "place", "at"), often, "h", "left_semi", 24)
    if keep_first:  # copies of a text are one text here
        own = names.join(names.groupBy("doc").agg(F.min("place").alias("own")), "doc").select("place", "own")
        shared = shared.join(own, "place").select("h", "c", F.col("own").alias("place"), "at").distinct()
    shared = written(shared)
    dropped(rows, often)
    kinds = written(shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("x")))
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(several, "h").select("h", "c", "kinds", "x.place", "x.at")
    wanted = written(bounded_join(wanted, names, "place", "inner", 64))
    edges = _edge_matches(docs, wanted, length, k, keep_first, group, block)
    lo, windows = F.expr(f"at DIV {width * width}"), F.expr(f"at DIV {width} % {width}")
    whole = shared.join(kinds.where("n > 1"), ["h", "c"])
    if keep_first:
        whole = whole.where("NOT (place = x.place AND at = x.at)")
    spans = whole.select("place", lo.alias("start"), (lo + windows + length).alias("stop"))
    if not keep_first:  # a repeated segment goes as a whole
        edges = edges.join(kinds.where("n = 1"), ["h", "c"], "left_semi")
    parts = shared.join(edges, ["h", "c"]).select("place", (lo + F.col("a")).alias("start"), (lo + F.col("b") + length).alias("stop"))
    # The spans of one text: no more than its bytes.
    spans = bounded_join(spans.unionByName(parts), names, "place", "inner", 64)
    out = written(spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")))
    dropped(shared, kinds, wanted, names)
    return out


def removed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, kept (binary, the bytes that stay), n_bytes, n_removed, n_spans; one row per input row."""
    spans = marked(docs, **how)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("data"))
    texts = texts.withColumn("doc", F.unhex(F.md5("data")))
    length, copy = how.get("length", LENGTH), F.lit(False)
    if how.get("keep_first"):
        # Of the rows of one text the least id keeps its first occurrences; in the others every window has occurred before.
        texts = written(texts.withColumn("row", F.monotonically_increasing_id()))
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        groups = texts.where(F.length("data") >= length).groupBy("doc").agg(F.min(rank)["row"].alias("first"), F.count("*").alias("n")).where("n > 1")
        groups = written(groups.select("doc", "first"))
        texts = bounded_join(texts, groups, "doc", "left", 80)
        copy = F.coalesce(F.col("row") != F.col("first"), F.lit(False))
    texts = texts.select("doc_id", "data", "doc", copy.alias("copy"))
    # By a shuffle at every size: the spans of the texts grow with them.
    wide = texts.join(spans.hint("shuffle_merge"), "doc", "left")

    def run(batches):
        for batch in batches:
            kept, size, gone, runs = [], [], [], []
            for data, spans, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                data, spans = data.as_py(), spans.as_py()
                if copy:
                    spans = [{"start": 0, "stop": len(data)}]
                parts, at, n = [], 0, 0
                stop = -1
                for s in spans or ():
                    if s["start"] > stop:
                        parts.append(data[at : s["start"]])
                        n += 1
                    stop = max(stop, s["stop"])
                    at = stop
                parts.append(data[at:])
                kept.append(b"".join(parts))
                size.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                runs.append(n)
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, runs))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return wide.select("doc_id", "data", "spans", "copy").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
