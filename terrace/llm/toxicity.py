"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded (lower case, accents of Latin letters kept, homoglyphs and
digit substitutions mapped to the letters that they imitate, soft hyphens and
zero-width characters dropped) and matched with one automaton that holds the
lexicon and its exception phrases.  Entries are beginnings of words or whole
words; an exception is a longer beginning, or a word and the next, that
shields the match it covers.  The weighted hits, normalised by length, go through a
logistic curve to a score.

Entries, weights, exceptions and curve are fitted on at most TRAIN_DOCS
labelled texts, in hash order of the text; a small list of English words is a prior that needs no labels.
The features of a text are counted in its task and summed before the shuffle.

Defined cases: a null or empty text, or one without a hit, gets the score of
no hits; null labels do not train; without both labels the prior alone is
used; rows that repeat an id are scored each; an empty table gives an empty result; other
columns are not read, and of ids none but a join key.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import text_of, tidy, words
from terrace.plans.scratch import bounded_join, small_batches, written

#: Labelled texts that are fitted on, at most.
TRAIN_DOCS = 60_000
#: Lengths of the word beginnings that can become entries.
STEMS = range(3, 9)
MIN_TOXIC = 4
#: Features that a task holds before it sends what it has.
HOLD = 100_000
#: An entry's texts are this much likelier toxic than all texts (log odds ratio, smoothed).
MIN_WEIGHT = 2.5
MOST_ENTRIES = 2000
THRESHOLD = 0.3
#: Prior entries.
PRIOR = "idiot moron stupid trash loser pathetic worthless disgusting scum clown"
PRIOR_WEIGHT = 4.0
#: Phrases of prior entries that are no insult.
EXCEPTION_PHRASES = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "pond scum", "idiot proof")
#: Characters that imitate letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
    "­": "", "​": "", "‌": "", "‍": "", "﻿": "",
}
_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
#: Marks that may trail or lead a word without being part of it.
_EDGES = ".,;:?\"'()[]{}*#%&|<>-_~`"


_MARKS = _EDGES + "!$@"
_ODD = re.compile("[" + "".join(chr(c) for c in _FOLD if c > 127) + "]")


def folded(word: str, odd: bool = True) -> str:
    """A word as it is matched.  Marks at its edges go before substitutions,
    so that trailing "!!" or "$$$" are no letters; a number stays a number.
    ``odd``: whether the text has characters beyond ASCII that imitate letters."""
    word = word.lower().strip(_MARKS)
    if word.isdigit() or word.isalpha() and (not odd or word.isascii()):
        return word
    return word.translate(_FOLD)


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    odd = _ODD.search(text) is not None
    # Most words are plain letters and need no folding.
    found = [w if w.isascii() and w.isalpha() else folded(w, odd) for w in words(text.lower())]
    return [w for w in found if w]


@dataclass(frozen=True)
class Lexicon:
    """Entries (text as laid out by ``line``, weight); negative ones are exceptions."""

    entries: tuple
    bias: float = -3.0
    gain: float = 2.0

    def automaton(self):
        out = ahocorasick.Automaton()
        for text, weight in self.entries:
            out.add_word(text, (len(text), weight))
        out.make_automaton()
        return out


def line(words: list[str]) -> str:
    """Words as the automaton reads them: each begins and ends with a space."""
    return " " + "  ".join(words) + " " if words else ""


def hits(words: list[str], automaton) -> float:
    """Weights of the lexicon's matches that no exception covers, longest first at each place."""
    if not words or not len(automaton):
        return 0.0
    found = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(line(words))]
    if not found:
        return 0.0
    shields = sorted((a, b) for a, b, w in found if w < 0)
    begins = [a for a, _ in shields]
    reach = list(accumulate((b for _, b in shields), max))
    best: dict[int, float] = {}
    for a, b, w in found:
        if w > 0:
            i = bisect_right(begins, a) - 1
            if i < 0 or reach[i] < b:
                best[a] = max(w, best.get(a, 0.0))
    return sum(best.values())


def normalised(total: float, n_words: int) -> float:
    """Hits damped by length: doubling a text of many words halves little."""
    return total / math.sqrt(1 + n_words / 400)


def _features(words: list[str]) -> set[str]:
    """Whole words (with both spaces) and beginnings (with the first)."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        for n in STEMS:
            if n >= len(w):
                break
            out.add(f" {w[:n]}")
    return out


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Lexicon:
    """A lexicon from the texts whose id has a label in ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    prior = tuple((f" {w} ", PRIOR_WEIGHT) for w in PRIOR.split())
    phrases = [(line(p.split()), -1.0) for p in EXCEPTION_PHRASES]
    labels = written(labels.select("doc_id", F.col("toxic").cast("int").alias("__toxic")).where("doc_id IS NOT NULL AND __toxic IN (0, 1)").dropDuplicates(["doc_id"]))
    pairs = bounded_join(docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")), labels, "doc_id", "inner", 48)
    # The share of hash values that gives about ``most`` texts.
    n = labels.count()
    if n > most:
        pairs = pairs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1e6 * most / n))
    sample = written(pairs.select("text", F.col("__toxic").alias("toxic")))
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon((*prior, *phrases))

    def count(batches):
        held: list[Counter] = [Counter(), Counter()]

        def send():
            keys = list(held[0].keys() | held[1].keys())
            return pa.record_batch([pa.array(keys, pa.string()), *(pa.array([h[k] for k in keys], pa.int64()) for h in held)], names=["f", "c", "t"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                held[label].update(_features(folded_words(text.as_py())))
                if len(held[0]) + len(held[1]) > HOLD:
                    yield send()
                    held[0].clear()
                    held[1].clear()
        yield send()

    weight = F.log((F.col("t") + 0.1) / (toxic + 0.2)) - F.log((F.col("c") + 0.1) / (clean + 0.2))
    sums = sample.mapInArrow(tidy(count), "f string, c long, t long").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    sums = written(sums.where((F.col("t") >= MIN_TOXIC) | (F.col("c") >= 20)).withColumn("w", weight))
    # Stems of real words explain many texts each: by toxic texts beyond what chance gives.
    gain = F.col("t") * F.col("w")
    top = sums.where((F.col("t") >= MIN_TOXIC) & (F.col("w") >= MIN_WEIGHT)).orderBy(F.desc(gain), F.length("f"), "f").limit(MOST_ENTRIES).toPandas()
    entries = _chosen(top)
    known = [f for f, _ in entries]
    shield = _exceptions(sums, known) if known else []
    entries += [e for e in prior if e[0] not in set(known)]
    lexicon = Lexicon(tuple(entries + shield + phrases))
    return _calibrated(sample, lexicon)


def _chosen(top: pd.DataFrame) -> list[tuple[str, float]]:
    """Entries by gain; one that only extends or begins a chosen one adds nothing."""
    out: list[tuple[str, float]] = []
    taken: list[str] = []
    for f, w in zip(top.f, top.w):
        if any(f.startswith(x) or x.startswith(f) for x in taken):
            continue
        taken.append(f)
        out.append((f, float(w)))
    return out


def _exceptions(sums: DataFrame, known: list[str]) -> list[tuple[str, float]]:
    """Longer beginnings and words under an entry that clean texts hold and toxic ones do not."""
    lengths = sorted({len(f) for f in known})
    starts = F.array_compact(F.array(*[F.when(F.length("f") > n, F.substring("f", 1, n)) for n in lengths]))
    entries = F.broadcast(sums.sparkSession.createDataFrame([(f,) for f in known], "start string"))  # MOST_ENTRIES rows at most
    under = sums.where("w < 0").select("f", "c", F.explode(starts).alias("start")).join(entries, "start").select("f", "c").distinct()
    found = under.orderBy(F.desc("c"), "f").toPandas()  # of the words of TRAIN_DOCS texts at most
    return [(f, -1.0) for f in found.f]


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The logistic curve of the normalised hits, by Newton steps on counts of rounded values."""

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            x = [round(min(normalised(hits(w, a), len(w)), 40.0), 1) for w in (folded_words(t.as_py()) for t in batch.column(0))]
            yield pa.record_batch([pa.array(x, pa.float64()), batch.column(1)], names=["x", "toxic"])

    rows = sample.mapInArrow(tidy(run), "x double, toxic int").groupBy("x", "toxic").count().toPandas()  # 401 values at most
    x, y, n = np.log1p(rows.x.to_numpy(float)), rows.toxic.to_numpy(float), rows["count"].to_numpy(float)
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.array([-3.0, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n * (y - p)) - 0.1 * (beta - np.array([-3.0, 2.0]))
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.entries, float(beta[0]), float(max(beta[1], 0.1)))


def score_of(text: str | None, lexicon: Lexicon, automaton) -> float:
    words = folded_words(text)
    z = lexicon.bias + lexicon.gain * math.log1p(normalised(hits(words, automaton), len(words)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score, one row per input row."""

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([score_of(t.as_py(), lexicon, a) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs)).mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with its own columns."""
    at = docs.columns.index("text")

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            yield batch.filter(pa.array([score_of(t.as_py(), lexicon, a) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def production_lexicon(spark, docs: DataFrame, sf_dir: str) -> Lexicon:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return trained(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs, production_lexicon(spark, docs, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
