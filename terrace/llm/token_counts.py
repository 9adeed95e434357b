"""Token counts: pieces are counted once per distinct pre-token.

1. Every document is cut into pre-tokens (a run of spaces and the text up to
   the next space; no piece of the vocabulary crosses such a cut, which
   ``Pieces`` verifies), and the distinct pre-tokens of the corpus are
   gathered, summed within each task before the shuffle.
2. The library encodes each distinct pre-token once; only its count is kept.
3. Per-document frequencies meet these counts.  The HEAD most frequent
   pre-tokens, a fixed number, are broadcast and summed where the document
   is read; every other (document, pre-token) row is joined by shuffle.  Both
   ways are exact; the first one keeps the frequent words off the network.

Defined cases: a null or empty text has 0 tokens; a pre-token of any length is
one key; a null id is kept; repeated rows: rows that share an id are summed
by row, as a row number within the scan is part of the key; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import most_frequent, text_of
from terrace.plans.scratch import small_batches, written

#: Pre-tokens whose counts are broadcast: at most this many rows, whatever the input.
HEAD = 200_000
#: Longest pre-token of the head, so that its size in bytes is bounded too.
HEAD_CHARS = 32
#: Distinct pre-tokens that a task holds before it sends what it has.
HOLD = 400_000
LIMIT = 4096
_CUT = re.compile(r" ( *[^ ]*)").findall


def pre_tokens(text: str) -> list[str]:
    """Keys of the pre-tokens; the space that each begins with is left out."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    return _CUT(" " + text) if text[0] == " " or "  " in text else text.split(" ")


class Pieces:
    """The library, asked for one pre-token at a time."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        crossing = [p.piece for p in proto.pieces if "▁" in p.piece.lstrip("▁")]
        if crossing or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or any(p.type == 4 for p in proto.pieces):
            raise ValueError("pieces of this model can cross a cut between pre-tokens")
        self.space = len(self.model.encode("▁▁")) and 1

    def counts(self, keys: list[str]) -> list[int]:
        found = self.model.encode(keys, num_threads=1)
        return [len(x) if k else self.space for k, x in zip(keys, found)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _frequencies(batches):
    held: Counter = Counter()

    def send():
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(pre_tokens(text.as_py()))
            if len(held) >= HOLD:
                yield send()
                held.clear()
    if held:
        yield send()


def counted(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per input row."""
    spark = docs.sparkSession
    small_batches(spark)
    text = text_of(docs)
    vocabulary = docs.select(text.alias("text")).mapInArrow(_frequencies, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))

    def encode(batches):
        own = pieces(path)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(own.counts(b.column(0).to_pylist()), pa.int64())], names=["token", "n", "k"])

    vocabulary = written(vocabulary.mapInArrow(encode, "token string, n long, k long"))
    top = most_frequent(vocabulary.where(F.length("token") <= HEAD_CHARS), "n", head).select("token", "k")
    top = top.toArrow()  # at most HEAD rows of HEAD_CHARS characters
    shared = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))

    def split(batches):
        known = shared.value
        # The rows of one task are numbered, so rows that share an id stay apart; a retry writes them all anew.
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            first = []
            tail_row, tail_token, tail_n = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, total, place = text.as_py(), 0, task << 33 | row
                for token, n in Counter(pre_tokens(text)).items():
                    k = known.get(token)
                    if k is None:
                        tail_row.append(place)
                        tail_token.append(token)
                        tail_n.append(n)
                    else:
                        total += n * k
                first.append((place, doc_id, len(text.encode()), total))
                row += 1
            a, b, c, d = zip(*first) if first else ((), (), (), ())
            none = len(tail_row)
            yield pa.record_batch(
                [
                    pa.array([*a, *tail_row], pa.int64()),
                    pa.array([*b, *[None] * none], pa.int64()),
                    pa.array([*c, *[None] * none], pa.int64()),
                    pa.array([*d, *tail_n], pa.int64()),
                    pa.array([*[None] * len(a), *tail_token], pa.string()),
                ],
                names=["place", "doc_id", "n_bytes", "n", "token"],
            )

    # Written once: both branches below must see the same numbers of rows.
    parts = written(docs.select(docs["doc_id"].cast("long"), text).mapInArrow(split, "place long, doc_id long, n_bytes long, n long, token string"))
    tail = parts.where(F.col("token").isNotNull()).select("token", "place", "n").join(vocabulary.select("token", "k"), "token")
    tail = tail.groupBy("place").agg(F.sum(F.col("n") * F.col("k")).alias("more"))
    heads = parts.where(F.col("n_bytes").isNotNull())
    n_tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return heads.join(tail, "place", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
