"""LM scoring with a log-frequency Bloom filter.

Unigram and bigram counts of the training texts are summed over all of them.
A count c is quantised to level q = 1 + floor(log_BASE(c)), and the
filter holds the items (n-gram, 1) ... (n-gram, q); a lookup probes levels upwards
until one is absent.  Every n-gram is held, from a count of 1, at every size: the
items are known from the counts of counts of the whole corpus, and the filter
has BITS, or as many times two as its items need to fill half of it.  A filter
of BITS is broadcast, in SHARDS parts (at half full an absent item is found with
probability 2 ** -PROBES).  A larger one stays a table of shards of
the same size, and is probed through a shuffle: blocks of texts send the
distinct hashes they need to the shards and get their levels back.

The probability of a token after its history is (c2 + m * p1) / (c1 + m), with
the quantised counts c2 of the pair and c1 of the history and an add-half unigram
estimate p1; a text's last token is its end, which is also the history of
its first word.  The weight m follows from all training counts: it is the one at which
the share of probability left to p1, mean over all training tokens, is the share of
pairs that occur once (the Good-Turing estimate of what is unseen).

The base score uses exact counts.  The HEAD most frequent tokens are summed
where the document is read, all others are joined by shuffle (both exact).

Defined cases: a null or empty text is the end token alone; a null id trains;
repeated rows are scored each; without training text N = V = 0 and every
probability is 1; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import most_frequent, text_of
from terrace.llm.shingles import mixed
from terrace.plans.scratch import dropped, small_batches, written

BASE = 1.5
#: Bits of a filter that is broadcast: 64 MB.
BITS = 1 << 29
SHARDS = 4096
PROBES = 4
#: Tokens whose base probability is broadcast: at most this many, of this many characters.
HEAD = 200_000
HEAD_CHARS = 32
#: Tokens that are hashed and probed at once; for counting, twice as many.
BLOCK = 500_000
#: Rows of pairs that a task sends at once.
SLICE = 100_000
#: The end of a text as a token; no word is empty.
END = b""
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: The low bytes of a number, by how many; words of more bytes than LONG are hashed one by one.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG = 64


def tokens(text: str) -> list[bytes]:
    """The tokens in UTF-8, A-Z lower-cased."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word in UTF-8, eight bytes of all words at a time."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(words.buffers()[2], np.uint8, len(data) - 8, ends[0])
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at, left = ends[:-1] - ends[0], np.diff(ends)
    out = mixed(left.astype(np.uint64) + _ONE)
    long = np.flatnonzero(left > LONG)
    out[long] = np.fromiter((xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(at[long].tolist(), left[long].tolist())), np.uint64, len(long))
    rest = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = at[rest], left[rest]
    while len(rest):
        out[rest] = mixed(out[rest] ^ (eights[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return out


def byte_hashes(tokens: list[bytes]) -> np.ndarray:
    return hashes(pa.array(tokens, pa.binary()))


def bigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of (history, token), the history of the first being the end."""
    return mixed(np.concatenate((h[-1:], h[:-1])) * _ONE + h * _TWO)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the end being the last of them, all
    tokens as places among these, and their number in each text; as ``tokens``."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = found.offsets.to_numpy()
    flat = found.values.slice(offsets[0], offsets[-1] - offsets[0])
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    sizes = np.diff(before[offsets - offsets[0]]) + 1
    coded = flat.filter(some).dictionary_encode()
    codes = np.full(int(sizes.sum()), len(coded.dictionary), np.int64)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, pa.array([END.decode()], pa.string())]), codes, sizes


class Block:
    """Some texts: their distinct tokens (words and hashes), the texts' tokens
    and histories as places among these, and the distinct pairs."""

    def __init__(self, texts: pa.Array) -> None:
        self.words, codes, sizes = split(texts)
        self._set(hashes(self.words), sizes, codes)

    def _set(self, hashes: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> None:
        self.hashes, self.sizes, self.codes = hashes, sizes, codes
        ends = np.cumsum(sizes)
        self.first = ends - sizes
        self.before = np.concatenate((codes[:1], codes[:-1]))
        self.before[self.first] = codes[ends - 1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs and the place of each token's pair among them."""
        n = len(self.hashes)
        pairs, back = np.unique(self.before * n + self.codes, return_inverse=True)
        return mixed(self.hashes[pairs // n] * _ONE + self.hashes[pairs % n] * _TWO), back

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs and their numbers."""
        n = len(self.hashes)
        pairs, many = np.unique(self.before * n + self.codes, return_counts=True)
        return mixed(self.hashes[pairs // n] * _ONE + self.hashes[pairs % n] * _TWO), many

    def packed(self) -> bytes:
        sizes = np.array([len(self.hashes), len(self.sizes)], np.int64)
        return sizes.tobytes() + self.hashes.tobytes() + self.sizes.tobytes() + zlib.compress(self.codes.astype(np.int32).tobytes(), 1)

    @staticmethod
    def unpacked(data: bytes) -> Block:
        """A block without its words."""
        n, texts = np.frombuffer(data, np.int64, 2).tolist()
        out = Block.__new__(Block)
        codes = np.frombuffer(zlib.decompress(data[16 + 8 * (n + texts) :]), np.int32).astype(np.int64)
        out._set(np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.int64, texts, 16 + 8 * n), codes)
        return out


def _blocks(columns, most: int):
    """Arrays of consecutive texts of about ``most`` tokens, a token being some six bytes."""
    held, size = [], 0
    for column in columns:
        begin = 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            if size and size + n > 6 * most:
                held.append(column.slice(begin, i - begin))
                yield pa.concat_arrays(held)
                held, size, begin = [], 0, i
            size += n + 1
        held.append(column.slice(begin))
    if size:
        yield pa.concat_arrays(held)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard by the high bits; ``shards`` is a power of two."""
    return h >> np.uint64(65 - shards.bit_length()) if shards > 1 else np.zeros(len(h), np.uint64)


def _spread(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of the double hashing of the items of one level."""
    return _first(h, level), _step(h, level)


def _first(h: np.ndarray, level: int) -> np.ndarray:
    return mixed(h ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64))


def _step(h: np.ndarray, level: int) -> np.ndarray:
    return mixed(h + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)) | np.uint64(1)


def levels(h: np.ndarray, filter_, shards: int) -> np.ndarray:
    """Quantised level of each n-gram: probes go up until a level is absent.
    ``filter_`` are the bytes of ``shards`` parts of a power of two of bits; hashes are
    probed in order, so that those of one part follow each other."""
    filter_ = np.frombuffer(filter_, np.uint8)
    inside = len(filter_) * 8 // shards
    order = np.argsort(h)
    h = h[order]
    begin, mask = _shard(h, shards) * np.uint64(inside), np.uint64(inside - 1)
    out = np.zeros(len(h), np.int64)
    alive = np.arange(len(h))

    def bits(a):
        at = begin + (a & mask)
        return filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)

    level = 0
    while len(alive):
        level += 1
        a = _first(h, level)
        # The first probe tells most of the absent ones; those left are probed to the end.
        there = np.flatnonzero(bits(a) & np.uint8(1))
        alive, h, begin, a = alive[there], h[there], begin[there], a[there]
        step = _step(h, level)
        found = np.ones(len(h), np.uint8)
        for _ in range(PROBES - 1):
            a += step
            found &= bits(a)
        there = np.flatnonzero(found)
        alive, h, begin = alive[there], h[there], begin[there]
        out[alive] = level
    back = np.empty_like(out)
    back[order] = out
    return back


def level_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(c) / math.log(BASE)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    filter_: object  # broadcast bytes, or none if the filter is a table
    parts: DataFrame | None  # shard, part of a filter that is not broadcast
    shards: int
    weight: float  # of the unigram estimate, in counts
    n: int
    v: int
    vocabulary: DataFrame  # token, c
    head: object  # broadcast (tokens, log10 of their base probabilities)


def _words(batches):
    """Rows (token, n), summed within a block."""
    for texts in _blocks((batch.column(0) for batch in batches), 2 * BLOCK):
        words, codes, _ = split(texts)
        yield pa.record_batch([words, pa.array(np.bincount(codes, minlength=len(words)))], names=["token", "n"])


def _pairs(batches):
    """Rows (hash, n) of the pairs, summed within a block."""
    for texts in _blocks((batch.column(0) for batch in batches), 2 * BLOCK):
        h, many = Block(texts).counts()
        for a in range(0, len(h), SLICE):
            yield pa.record_batch([pa.array(h[a : a + SLICE].view(np.int64)), pa.array(many[a : a + SLICE], pa.int64())], names=["hash", "n"])


def _summed(batches):
    """Rows (hash, c) of rows (hash, n) that come in order of the hash."""
    last, total = None, 0
    for batch in batches:
        h, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        keys, sums = h[first], np.add.reduceat(n, first)
        if last is not None:
            if keys[0] == last:
                sums[0] += total
            else:
                keys, sums = np.append(last, keys), np.append(total, sums)
        last, total = keys[-1], sums[-1]
        yield pa.record_batch([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["hash", "c"])
    if last is not None:
        yield pa.record_batch([pa.array([last], pa.int64()), pa.array([total], pa.int64())], names=["hash", "c"])


def _hashed(batches):
    """Rows (hash, c) of rows (token, c)."""
    for batch in batches:
        yield pa.record_batch([pa.array(hashes(batch.column(0)).view(np.int64)), batch.column(1)], names=["hash", "c"])


def unigram_weight(c: np.ndarray, many: np.ndarray, once: float) -> float:
    """The m with sum(many * c * m / (c + m)) = once: ``many`` histories have count c, ``once`` pairs occur once."""
    low, high = 1e-3, 1e6
    for _ in range(100):
        m = math.sqrt(low * high)
        if float((many * c * (m / (c + m))).sum()) < once:
            low = m
        else:
            high = m
    return math.sqrt(low * high)


def trained(docs: DataFrame, bits: int = BITS, head: int = HEAD) -> Model:
    """A model of all rows of ``docs``.  Pairs are dealt by hash and summed in
    its order; each file of their counts then holds few shards, whose parts are built
    where it is read and joined bit by bit."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_of(docs))
    vocabulary = written(texts.mapInArrow(_words, "token string, n long").groupBy("token").agg(F.sum("n").alias("c")))
    words = _histogram(vocabulary)
    n, v = int((words.c * words.many).sum()), int(words.many.sum())
    # The shards of a filter of any size are ranges of these.
    deal = F.shiftrightunsigned("hash", 65 - SHARDS.bit_length())
    ordered = texts.mapInArrow(_pairs, "hash long, n long").repartition(deal).sortWithinPartitions("hash")
    counts = written(ordered.mapInArrow(_summed, "hash long, c long"))
    hist = _histogram(counts)
    weight = unigram_weight(words.c.to_numpy(float), words.many.to_numpy(float), float(hist.many[hist.c == 1].sum())) if n else 1.0
    hist = pd.concat((hist, words))
    items = float((hist.many * level_of(hist.c.to_numpy(float))).sum()) if len(hist) else 0.0
    base = max(1, min(SHARDS, bits // 1024))
    shards = base
    while items * PROBES > bits * math.log(2) * (shards // base):
        shards *= 2
    inside = bits // base // 8

    def build(batches):
        current, part = None, None

        def row():
            return pa.record_batch([pa.array([current], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["shard", "part"])

        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            shard, level = _shard(h, shards).astype(np.int64), level_of(batch.column(1).to_numpy())
            at = []
            for j in range(1, int(level.max()) + 1) if len(h) else ():
                first, step = _spread(h[level >= j], j)
                at.append(np.concatenate([first + np.uint64(probe) * step & np.uint64(inside * 8 - 1) for probe in range(PROBES)]))
            own = np.concatenate([np.tile(shard[level >= j], PROBES) for j in range(1, len(at) + 1)]) if at else shard
            at = np.concatenate(at) if at else h
            order = np.argsort(own, kind="stable")
            own, at = own[order], at[order]
            kinds, ends = np.unique(own, return_counts=True)
            begin = 0
            for s, end in zip(kinds.tolist(), np.cumsum(ends).tolist()):
                if s != current:
                    if part is not None:
                        yield row()
                    current, part = s, np.zeros(inside, np.uint8)
                bit = at[begin:end]
                np.bitwise_or.at(part, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))
                begin = end
        if part is not None:
            yield row()

    shard = F.shiftrightunsigned("hash", 65 - shards.bit_length()) if shards > 1 else F.lit(0)
    hashed = vocabulary.mapInArrow(_hashed, "hash long, c long").repartition(shard).sortWithinPartitions("hash")
    parts = counts.mapInArrow(build, "shard long, part binary").unionByName(hashed.mapInArrow(build, "shard long, part binary"))
    shared = None
    if shards == base:
        filter_ = bytearray(bits // 8)  # ``bits`` in all, whatever the input
        whole = np.frombuffer(filter_, np.uint8)
        parts = written(parts)
        for r in parts.toLocalIterator():  # a file at a time
            whole[r.shard * inside : (r.shard + 1) * inside] |= np.frombuffer(r.part, np.uint8)
        dropped(parts)
        shared, parts = spark.sparkContext.broadcast(filter_), None
        del filter_, whole
    else:
        parts = written(parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_joined_parts, "shard long, part binary"))
    top = most_frequent(vocabulary.where(F.length("token") <= HEAD_CHARS), "c", head).toArrow().combine_chunks()
    known = pa.concat_arrays(top.column(0).chunks or [pa.array([], pa.string())]), np.log10((top.column(1).to_numpy() + 0.5) / (n + 0.5 * (v + 1)))
    dropped(counts)
    return Model(shared, parts, shards, weight, n, v, vocabulary, spark.sparkContext.broadcast(known))


def _histogram(counts: DataFrame) -> pd.DataFrame:
    """c and many: a row per distinct count."""
    return counts.groupBy("c").agg(F.count("*").alias("many")).toPandas()


def _joined_parts(batches):
    """One row per shard: its parts, which come together, joined bit by bit."""
    current, part = None, None
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = np.frombuffer(data.as_py(), np.uint8)
            if shard == current:
                part = part | data
                continue
            if part is not None:
                yield pa.record_batch([pa.array([current], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["shard", "part"])
            current, part = shard, data
    if part is not None:
        yield pa.record_batch([pa.array([current], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["shard", "part"])


def _by_shards(blocks: DataFrame, parts: DataFrame, shards: int, solve, schema: str) -> DataFrame:
    """``solve(number, block, levels)`` of each of the written ``blocks`` (block, data), with the levels
    of its tokens and pairs.  Each block sends its hashes to the shards; nothing larger than a block or a shard is held."""

    def hashes(block: Block):
        pairs, back = block.pairs()
        h = np.concatenate((block.hashes, pairs))
        return h, back, np.argsort(_shard(h, shards), kind="stable")

    def ask(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, _, order = hashes(Block.unpacked(data.as_py()))
                h = h[order]
                shard = _shard(h, shards)
                cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(h)]
                own = shard[cut[:-1]].astype(np.int64)
                yield pa.record_batch([pa.array(own), pa.array([number] * len(own), pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["shard", "block", "data"])

    def probe(batches):
        current, part = None, None
        for batch in batches:
            shard, block, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if shard[a] != current:
                    current, part = shard[a], None
                if block[a] < 0:
                    part = np.frombuffer(data[a].as_py(), np.uint8)
                    a += 1
                if a == b:
                    continue
                asked = [np.frombuffer(data[i].as_py(), np.uint64) for i in range(a, b)]
                ends = np.cumsum([len(x) for x in asked])
                u, back = np.unique(np.concatenate(asked), return_inverse=True)
                # A shard without items has no part.
                found = (np.zeros(len(u), np.uint8) if part is None else levels(u, part, 1).astype(np.uint8))[back]
                yield pa.record_batch([pa.array(shard[a:b]), pa.array(block[a:b]), pa.array([x.tobytes() for x in np.split(found, ends[:-1])], pa.binary())], names=["shard", "block", "data"])

    def gather(batches):
        number, data, got = None, None, []

        def solved():
            block = Block.unpacked(data)
            h, back, order = hashes(block)
            level = np.empty(len(h), np.int64)
            level[order] = np.frombuffer(b"".join(got), np.uint8)
            return solve(number, block, level[: len(block.hashes)], level[len(block.hashes) :][back])

        for batch in batches:
            for b, piece in zip(batch.column(1).to_pylist(), batch.column(2)):
                if b != number:
                    if number is not None:
                        yield solved()
                    number, data, got = b, piece.as_py(), []
                else:
                    got.append(piece.as_py())
        if number is not None:
            yield solved()

    kind = "shard long, block long, data binary"
    asked = blocks.select("block", "data").mapInArrow(ask, kind)
    filter_ = parts.select("shard", F.lit(-1).cast("long").alias("block"), F.col("part").alias("data"))
    found = asked.unionByName(filter_).repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(probe, kind)
    own = blocks.select(F.lit(-1).cast("long").alias("shard"), "block", "data")
    return found.unionByName(own).repartition("block").sortWithinPartitions("block", "shard").mapInArrow(gather, schema)


def _estimate(level: np.ndarray) -> np.ndarray:
    """Middle of the counts that share a level; 0 for none."""
    low = BASE ** (level - 1.0)
    return np.where(level > 0, np.maximum(low, (np.ceil(low) + np.ceil(low * BASE) - 1) / 2), 0.0)


def log_probabilities(block: Block, own: np.ndarray, two: np.ndarray, weight: float, n: int, v: int) -> np.ndarray:
    """log10 p of each token of a block, from the levels of its distinct tokens and of each token's pair."""
    c = _estimate(own)
    before, m = c[block.before], max(weight, 1e-12)
    p = (c[block.codes] + 0.5) / (n + 0.5 * (v + 1))
    return np.log10((np.minimum(_estimate(two), before) + m * p) / (before + m))


def in_known(words: pa.Array, known: tuple[pa.Array, np.ndarray]) -> np.ndarray:
    """The value of each word among ``known`` (words, values), NaN for others."""
    found = pc.index_in(words, value_set=known[0])
    return np.append(known[1], np.nan)[pc.fill_null(found, len(known[0])).to_numpy()]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but text, with n_tokens, n_known, base_score and score."""
    small_batches(docs.sparkSession)
    other = [c for c in docs.columns if c != "text"]
    spare = docs.select(*[docs[f"`{c}`"] for c in other])
    total = model.n + 0.5 * (model.v + 1)
    floor = math.log10(0.5 / total) if total else 0.0
    rows = docs.select(text_of(docs).alias("text"), F.struct(*[spare[f"`{c}`"] for c in other]).alias("rest"))
    rest_type = rows.schema["rest"].dataType.simpleString()
    filters, heads = model.filter_, model.head
    small = replace(model, filter_=None, parts=None, vocabulary=None, head=None)
    sharded = model.parts is not None
    names = ["place", "rest", "n", "known", "base", "score", "token", "block"]

    def run(batches):
        filter_, known = None if sharded else filters.value, heads.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in _blocks([batch.column(0)], BLOCK):
                block, own = Block(texts), len(texts)
                place = (task << 33) + row + np.arange(own)
                log_p = in_known(block.words, known)[block.codes]
                in_head = ~np.isnan(log_p)
                base = np.add.reduceat(np.where(in_head, log_p, 0.0), block.first)
                n_known = np.add.reduceat(in_head, block.first, dtype=np.int64)
                # The other tokens of each text, with their numbers.
                text = np.repeat(np.arange(own), block.sizes)[~in_head]
                tail, n = np.unique(text * len(block.words) + block.codes[~in_head], return_counts=True)
                score = np.full(own, np.nan) if sharded else np.zeros(own)
                if not sharded and small.n:
                    pairs, back = block.pairs()
                    p = log_probabilities(block, levels(block.hashes, filter_, small.shards), levels(pairs, filter_, small.shards)[back], small.weight, small.n, small.v)
                    score = np.add.reduceat(p, block.first)
                rest, none = batch.column(1).slice(at, own), len(tail)
                words = block.words.take(pa.array(tail % len(block.words)))
                more = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(none, kind)])
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate((place, place[tail // len(block.words)]))),
                        pa.concat_arrays([rest, pa.nulls(none, rest.type)]),
                        pa.array(np.concatenate((block.sizes, n))),
                        more(n_known, pa.int64()),
                        more(base, pa.float64()),
                        more(score, pa.float64()),
                        pa.concat_arrays([pa.nulls(own, pa.string()), words]),
                        more([block.packed() if sharded and i == 0 else None for i in range(own)], pa.binary()),
                    ],
                    names=names,
                )
                at += own
                row += own

    parts = written(rows.mapInArrow(run, f"place long, rest {rest_type}, n long, known long, base double, score double, token string, block binary"))
    tail = parts.where(F.col("token").isNotNull()).select("token", "place", "n").join(model.vocabulary, "token", "left")
    each = F.when(F.col("c").isNull(), F.lit(floor)).otherwise(F.log10((F.col("c") + 0.5) / F.lit(float(total or 1))))
    tail = tail.groupBy("place").agg(F.sum(F.col("n") * each).alias("more"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("also"))
    out = parts.where(F.col("token").isNull()).drop("block").join(tail, "place", "left")
    if sharded:

        def solve(number, block, own, two):
            p = log_probabilities(block, own, two, small.weight, small.n, small.v)
            return pa.record_batch([pa.array(number + np.arange(len(block.first))), pa.array(np.add.reduceat(p, block.first))], names=["place", "score"])

        blocks = parts.where(F.col("block").isNotNull()).select(F.col("place").alias("block"), F.col("block").alias("data"))
        out = out.drop("score").join(_by_shards(blocks, model.parts, model.shards, solve, "place long, score double"), "place")
    return out.select(
        *[F.col(f"rest.`{c}`").alias(c) for c in other],
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs.where(~held_out(docs["doc_id"])))
    found = scored(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
