"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression and a document is judged in a single
projection over the scan, without a shuffle or user function.  The words in
repeated 3-word windows come from one sorted array of (window hash, position)
longs per document; windows that meet in the sorted order are compared as
words, so a hash collision repeats nothing.

Defined cases: a null text is the empty text and fails the base rule; ratios
of an empty text are 0; repeated rows are judged alike; an empty table gives
an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import WORD, text_of


@dataclass(frozen=True)
class Rule:
    """A document is kept while low <= measure <= high."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The production table.
RULES = (
    Rule("mean_word_chars", 2, 14),
    Rule("symbol_ratio", high=0.3),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("mean_line_words", low=2),
)
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for on are with as be by this have from or an it not a at",
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es",
    "le la les de des et en un une du que qui dans pour est sur pas par au ce il elle",
    "el los las y del se un una por con no para es al lo como más su",
)
_STOPS = sorted(set(" ".join(STOP_WORDS).split()))


def _let(value: str, name: str, body: str) -> str:
    """SQL that names ``value`` once inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated_words() -> str:
    """Words inside 3-word windows that occur twice or more, over array ``words``."""
    same = "(words[{a}] = words[{b}] AND words[{a} + 1] = words[{b} + 1] AND words[{a} + 2] = words[{b} + 2])"
    at = "CAST(shiftrightunsigned(shiftleft(k[{i}], 64 - bits), 64 - bits) AS INT)"
    near = lambda i, j: _let(at.format(i=i), "a", _let(at.format(i=j), "b", same.format(a="a", b="b")))
    hit = (
        f"(i > 0 AND shiftright(k[i - 1], bits) = shiftright(x, bits) AND {near('i', 'i - 1')}) OR "
        f"(i < size(k) - 1 AND shiftright(k[i + 1], bits) = shiftright(x, bits) AND {near('i', 'i + 1')})"
    )
    starts = f"sort_array(transform(filter(k, (x, i) -> {hit}), x -> shiftrightunsigned(shiftleft(x, 64 - bits), 64 - bits)))"
    covered = _let(starts, "p", "aggregate(transform(p, (x, i) -> IF(i = size(p) - 1, 3L, least(3L, p[i + 1] - x))), 0L, (s, v) -> s + v)")
    keys = "sort_array(transform(sequence(0, n - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | i))"
    return f"CASE WHEN n < 4 THEN 0L ELSE {_let('CAST(ceil(log2(n + 1)) AS INT)', 'bits', _let(keys, 'k', covered))} END"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts behind the rules, one row per input row."""
    base = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    # Generate keeps the arrays as columns: inside a lambda they would be built again for each element.
    split = base.selectExpr(
        "doc_id",
        "text",
        r"inline(array(named_struct('words', regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), 'lines', filter(split(text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]'))))",
    )
    stops = ", ".join(f"'{w}'" for w in _STOPS)
    counted = split.selectExpr("doc_id", "text", "words", "lines", "size(words) AS n").selectExpr(
        "doc_id",
        "CAST(n AS BIGINT) AS n_words",
        "CAST(length(array_join(words, '')) AS BIGINT) AS word_chars",
        "CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        f"{_repeated_words()} AS n_repeat_words",
        f"CAST(size(filter(words, w -> lower(w) IN ({stops}))) AS BIGINT) AS n_stops",
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stops", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "mean_line_words": ratio("n_words", "n_lines"),
    })


def compiled(rules=RULES) -> Column:
    """One boolean expression for the whole table."""
    verdict = F.lit(True)
    for r in rules:
        if r.low != float("-inf"):
            verdict = verdict & (F.col(r.measure) >= r.low)
        if r.high != float("inf"):
            verdict = verdict & (F.col(r.measure) <= r.high)
    return verdict


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measures with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_SQL_STOPS = ", ".join(f"'{w}'" for w in _STOPS)
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_SQL_STOPS}))) AS n_stops
  FROM t LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.3
         AND n_stops / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_words / n_lines >= 2 AS kept
FROM f
"""
