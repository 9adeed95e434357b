"""Recursive splitting and greedy packing of documents into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a text is cut, coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SCHEMA = "id string, doc_id string, index int, text string, start int"


def pieces(text: str, size: int) -> list[str]:
    """Pieces of at most ``size``; an oversize one is cut again at the next finer separator, at last anywhere."""
    done: list[str] = []
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            if part or part is text:
                done.append(part)
        elif level == len(SEPARATORS):
            done += [part[at : at + size] for at in range(0, len(part), size)]
        else:
            sep = SEPARATORS[level]
            *front, last = part.split(sep)
            todo += [(x, level + 1) for x in reversed([*(x + sep for x in front), last]) if x]
    return done


def packed(text: str, size: int, overlap: int):
    """(start, text) of each chunk: pieces are filled up to ``size``, and the
    last pieces of a chunk, up to ``overlap`` characters, begin the next."""
    cuts = pieces(text, size)
    ends, at = [], 0
    for p in cuts:
        at += len(p)
        ends.append(at)
    starts = [0, *ends[:-1]]
    lo = 0
    for i in range(len(cuts)):
        if i > lo and ends[i] - starts[lo] > size:
            if body := text[starts[lo] : starts[i]].strip():
                yield starts[lo], body
            keep = i
            while keep > lo and starts[i] - starts[keep - 1] <= overlap:
                keep -= 1
            lo = keep
    if cuts and (body := text[starts[lo] :].strip()):
        yield starts[lo], body


def chunked(docs: DataFrame, size: int = 4000, overlap: int = 400) -> DataFrame:
    """(id, doc_id, index, text, start) of documents (id, text); a document at a time, no shuffle."""

    def run(frames):
        for f in frames:
            rows = [(f"{d}:{n}", str(d), n, body, at) for d, text in zip(f.id, f.text) if text for n, (at, body) in enumerate(packed(text, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "doc_id", "index", "text", "start"])

    return docs.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCHEMA)
