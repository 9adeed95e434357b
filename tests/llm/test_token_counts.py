"""Token counts against the library on whole texts."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from terrace.llm import token_counts

PATH = P.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(3)
    out = ["", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b   c ", "▁", "▁▁ a▁b", "a\n b\t\tc\n\n", "<s> </s> <unk> <0x0A>", "日本語 テキスト 🙂🙂", "\x00 \x01a"]
    for _ in range(300):
        alphabet = rng.choice(["ab  ", "the of and  ▁", "x \n\t", "日本 語🙂", "".join(map(chr, range(32, 127)))])
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))))
    return [*out, "a" * 20_000, "ab " * 20_000]


@pytest.mark.parametrize("head", [token_counts.HEAD, 5])
def test_same_as_library(spark, head):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(7, None, 2), (7, "a b", 2), (7, "a b", 2), (None, "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.counted(docs, PATH, 50, head).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 50))
    assert got == sorted(want, key=repr)
    assert token_counts.counted(docs.limit(0), PATH).count() == 0


def test_whole_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.op10_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(library.encode(t)) for i, t in docs.items()}
