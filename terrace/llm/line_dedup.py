"""Line dedup with a log-template tree of fixed depth.

A line's variable tokens (those with a digit, addresses, e-mails) become a
wildcard.  The tree sorts lines by token count and then by their first DEPTH
tokens into leaves.  Inside a leaf, distinct lines meet the leaf's templates
in a fixed order (most documents first): a line joins the most similar
template that agrees at SIMILARITY of its positions or more, and the positions that
differ become wildcards of it, else it starts a template.  Lines of
templates that occur in MIN_DOCS different texts or more are dropped from every text.

Only slim rows (text digest, line number, leaf, line digest) are kept for all
lines; line texts move only for leaves that MIN_DOCS texts share, once per
distinct line.  A leaf has one set of templates at every size: its lines
stream through one task in order, LEAF_LINES at once, and only the templates
are held.

Defined cases: a null text has no lines; blank lines and lines under
MIN_TOKENS tokens are never dropped; repeated lines of a text count once and
are all dropped; texts that are equal count as one text, so copies alone make
nothing recurrent; a null or repeated id is kept as it is; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import text_of, words
from terrace.plans.scratch import bounded_join, dropped, small_batches, written

MIN_DOCS = 4
MIN_TOKENS = 4
DEPTH = 3
SIMILARITY = 0.6
#: Lines of a leaf that are held at once; results do not depend on it.
LEAF_LINES = 1000
WILD = "<*>"
_VARIABLE = re.compile(r"\d|://|^www\.|.@.+\..")


def masked(line: str) -> list[str]:
    """Tokens with variable ones generalised."""
    out = words(line)
    return [WILD if _VARIABLE.search(t) else t for t in out] if _VARIABLE.search(line) else out


def _hash(tokens: list[str], n: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(f"{n} {' '.join(tokens)}".encode("utf-8", "surrogatepass")), "big", signed=True)


def _digest(tokens: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc (text digest), line, leaf, digest; one per line that can be dropped."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text in batch.column(0):
                text = text.as_py()
                key = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                for i, line in enumerate(text.split("\n")):
                    t = masked(line)
                    if len(t) >= MIN_TOKENS:
                        for column, x in zip(out, (key, i, _hash(t[:DEPTH], len(t)), _digest(t))):
                            column.append(x)
            types = (pa.binary(), pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types)], names=["doc", "line", "leaf", "digest"])

    return docs.select(text_of(docs)).mapInArrow(run, "doc binary, line int, leaf long, digest binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, tokens (joined by spaces) of the lines whose digest is wanted."""

    def run(batches):
        for batch in batches:
            digests, texts, seen = [], [], set()
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    t = masked(line)
                    if len(t) >= MIN_TOKENS and (d := _digest(t)) not in seen:
                        seen.add(d)
                        digests.append(d)
                        texts.append(" ".join(t))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(texts, pa.string())], names=["digest", "tokens"])

    return bounded_join(docs.select(text_of(docs)).mapInArrow(run, "digest binary, tokens string"), wanted, "digest", "left_semi", 64).dropDuplicates(["digest"])


class Leaf:
    """The templates of one leaf, which its lines (all of one token count) meet in order."""

    def __init__(self, size: int, similarity: float):
        self.codes: dict[str, int] = {WILD: 0}
        self.table = np.empty((size, 16), np.int32)  # a column per template
        self.n, self.size, self.similarity = 0, size, similarity

    def template(self, t: list[str]) -> int:
        codes = self.codes
        row = np.array([codes.setdefault(x, len(codes)) for x in t], np.int32)
        if self.n:
            known = self.table[:, : self.n]
            same = ((known == row[:, None]) | (known == 0)).sum(axis=0, dtype=np.int32)
            best = int(np.argmax(same))
            if same[best] / self.size >= self.similarity:
                merged = np.where(known[:, best] == row, row, 0)
                if (merged != 0).mean() >= self.similarity:  # a template never generalises beyond this
                    known[:, best] = merged
                    return best
        if self.n == self.table.shape[1]:
            self.table = np.concatenate((self.table, np.empty_like(self.table)), axis=1)
        self.table[:, self.n] = row
        self.n += 1
        return self.n - 1


def templates(lines: list[list[str]], similarity: float = SIMILARITY) -> list[int]:
    """Template of each line of one leaf (all of one token count), in order."""
    leaf = Leaf(len(lines[0]) if lines else 0, similarity)
    return [leaf.template(t) for t in lines]


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """doc (text digest) and lines, the sorted numbers of its lines that recur."""
    small_batches(docs.sparkSession)
    rows = written(_lines(docs).distinct())
    shared = rows.select("leaf", "doc").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    kinds = written(rows.join(shared, "leaf", "left_semi").groupBy("leaf", "digest").agg(F.count("*").alias("n")))
    texts = _texts(docs, written(kinds.select("digest").distinct()))
    ordered = kinds.join(texts, "digest").select("leaf", "n", "tokens", "digest").repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "tokens")

    def run(batches):
        current, leaves = None, {}
        out = ([], [])

        def batch_of(out):
            return pa.record_batch([pa.array(x, pa.binary()) for x in out], names=["digest", "template"])

        for batch in batches:
            for key, tokens, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != current:
                    current, leaves = key, {}
                t = tokens.split(" ")
                own = len(t), *t[:DEPTH]  # two leaves may share a hash by chance
                if own not in leaves:
                    leaves[own] = Leaf(len(t), SIMILARITY), []
                leaf, firsts = leaves[own]
                i = leaf.template(t)
                if i == len(firsts):
                    firsts.append(digest)
                out[0].append(digest)
                out[1].append(firsts[i])
                if len(out[0]) >= leaf_lines:
                    yield batch_of(out)
                    out = ([], [])
        yield batch_of(out)

    found = written(ordered.mapInArrow(run, "digest binary, template binary"))
    used = rows.join(found, "digest").select("template", "doc").distinct().groupBy("template").count().where(F.col("count") >= min_docs)
    gone = written(found.join(used.select("template"), "template", "left_semi").select("digest"))
    out = written(rows.join(gone, "digest", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("lines")))
    dropped(rows, kinds, found, gone)
    return out


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped; one row per input row."""
    found = recurring(docs, **how)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), docs["text"].isNull().alias("none"))
    wide = bounded_join(texts.withColumn("doc", F.unhex(F.md5(F.col("text").cast("binary")))), found, "doc", "left", 200)

    def run(batches):
        for batch in batches:
            kept, total, gone = [], [], []
            for text, none, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = text.split("\n")
                away = set(drop or ())
                kept.append(None if none else "\n".join(x for i, x in enumerate(lines) if i not in away))
                total.append(0 if none else len(lines))
                gone.append(len(away))
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return wide.select("doc_id", "text", "none", "lines").mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
