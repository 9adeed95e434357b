"""Byte-level BPE with a hierarchical-bitmap rank queue.

A block of documents is split into pre-tokens, and the distinct ones that are
new to the worker and no token themselves are laid end to end in one array of
symbols with a linked list.  Every merge rank has a bucket of positions; a three-level bitmap over
the ranks finds the next rank that has a bucket by find-first-set.  All live
positions of the rank merge at once (in a run of overlapping positions every
other one, from the left), their new pairs enter the buckets of their own
ranks, and entries whose pair has changed since are skipped when met.  The
cost is linear in the bytes, so one pre-token of many megabytes is as cheap
per byte as many short ones.  A worker remembers the ids of at most PIECES
pre-tokens of PIECE_CHARS characters in all, then starts anew.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded alike; an empty table gives an empty result; only
the named columns are read.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import text_of
from terrace.plans.scratch import small_batches

#: Characters of text that share one queue; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: What a worker remembers between blocks, at most (and one block more).
PIECES = 200_000
PIECE_CHARS = 4_000_000
_NONE = np.int32(2**31 - 1)


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap."""

    def __init__(self, n_ranks: int) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            self._put(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for a, b, r in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
            self._put(r, positions[a:b])

    def _put(self, r: int, positions: np.ndarray) -> None:
        if r in self.buckets:
            self.buckets[r].append(positions)
            return
        self.buckets[r] = [positions]
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The first rank that has a bucket, with its positions in order, each once."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        j = (i << 6) + (self.mid[i] & -self.mid[i]).bit_length() - 1
        r = (j << 6) + (self.low[j] & -self.low[j]).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        parts = self.buckets.pop(r)
        return r, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class ByteBPE:
    """A rank file as encoder and decoder."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.n = max(self.bytes_of) + 1
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[order], _NONE)
        self.forget()

    def forget(self) -> None:
        """Drop what is known of earlier pre-tokens."""
        self.seen: dict[str, int] = {}
        self.chars = 0
        self.start, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, text: str):
        """The pre-tokens; those of a long text are never held all at once."""
        return self.pattern.findall(text) if len(text) < BLOCK_CHARS else (m.group() for m in self.pattern.finditer(text))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece starts among them."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(tok)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[starts[1:][lengths > 0] - 1] = -1
        prv[starts[:-1][lengths > 0]] = -1
        pair = np.full(n, _NONE, np.int32)
        at = np.flatnonzero(nxt >= 0).astype(np.int32)
        pair[at] = self.pair_ranks(tok[at], tok[at + 1])
        queue = RankQueue(self.n)
        at = np.flatnonzero(pair != _NONE).astype(np.int32)
        if len(at):
            queue.push(pair[at], at)
        while (found := queue.pop()) is not None:
            r, p = found
            p = p[pair[p] == r]  # stale entries have another pair by now
            if not len(p):
                continue
            q = nxt[p]
            if len(p) > 1 and (chained := p[1:] == q[:-1]).any():
                index = np.arange(len(p))
                first = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
                keep = (index - first) % 2 == 0
                p, q = p[keep], q[keep]
            after = nxt[q]
            tok[p] = r
            tok[q] = -1
            pair[q] = _NONE
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            left = prv[p]
            c = np.concatenate((left[left >= 0], p))
            right = nxt[c]
            new = np.full(len(c), _NONE, np.int32)
            inner = right >= 0
            new[inner] = self.pair_ranks(tok[c[inner]], tok[right[inner]])
            pair[c] = new
            live = new != _NONE
            if live.any():
                queue.push(new[live], c[live])
        alive = tok >= 0
        at = np.concatenate(([0], np.cumsum(alive)))[starts]
        return tok[alive], at

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > PIECES or self.chars > PIECE_CHARS:
            self.forget()
        seen, known = self.seen, len(self.seen)
        split = [np.fromiter((seen.setdefault(t, len(seen)) for t in self.find(text)), np.int32) for text in texts]
        pieces = [t.encode("utf-8", "surrogatepass") for t in islice(seen, known, None)]
        self.chars += sum(map(len, pieces))
        whole = np.fromiter((self.ranks.get(t, -1) for t in pieces), np.int32, len(pieces))
        merged = np.flatnonzero(whole < 0)
        ids, at = self.merge([pieces[i] for i in merged.tolist()])
        # The tokens that are whole pre-tokens stand behind the merged ids.
        start = np.empty(len(pieces), np.int64)
        count = np.ones(len(pieces), np.int64)
        start[merged], count[merged] = at[:-1], np.diff(at)
        single = np.flatnonzero(whole >= 0)
        start[single] = len(ids) + np.arange(len(single))
        self.start = np.concatenate((self.start, start + len(self.ids)))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, ids, whole[single])).astype(np.int32)
        out = []
        for own in split:
            n = self.count[own]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.start[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(path, pattern)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _encoded(docs: DataFrame, path: str, pattern: str, block_chars: int, back: bool) -> DataFrame:
    """doc_id and ids, and if ``back`` the bytes that the ids decode to, one row per input row."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path, pattern)
        keys, texts, size = [], [], 0

        def flush():
            found = bpe.encode_block(texts)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            columns = {"doc_id": pa.array(keys, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))}
            if back:
                columns["decoded"] = pa.array([bpe.decode(x.tolist()) for x in found], pa.binary())
            return pa.record_batch(list(columns.values()), names=list(columns))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if texts and size + len(text) > block_chars:
                    yield flush()
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return docs.select(docs["doc_id"].cast("long"), text_of(docs)).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * back)


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids array<int>, one row per input row."""
    return _encoded(docs, path, pattern, block_chars, False)


def round_trip(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``encode`` with the column decoded (binary), made of the ids in the same worker."""
    return _encoded(docs, path, pattern, block_chars, True)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The column ids replaced by the column decoded (binary)."""
    other = [c for c in encoded.columns if c != "ids"]
    schema = encoded.select(*other).withColumn("decoded", F.lit(b"")).schema
    fields = _arrow(schema)
    small_batches(encoded.sparkSession)

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            texts = pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in other), texts], names=fields.names)

    return encoded.select(*other, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids."""
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return round_trip(docs, path, pattern).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
