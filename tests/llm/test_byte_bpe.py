"""Byte-level BPE against the public library, text by text, and an exact round trip."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from terrace.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    spaces = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "᠎", "​", " ", "　", "\x00", "\x0b", "\x0c", "\r\n", "﻿"]
    out = ["", " ", "a", "the the  the\n\n", "aaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|> x", "It's we'LL 12345 naïve 日本語 🙂🙂"]
    out += [f"a{s}b {s}{s} c{s}" for s in spaces]
    for _ in range(300):
        alphabet = rng.choice(["ab", "abc '", "the of and\n", "0123 ,.!", "äöüß éè", "日本語テ ", "🙂é́ \t", "".join(map(chr, range(32, 127)))])
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))))
    out += ["a" * 50_000, "ab" * 40_000, "".join(rng.choice("etaoinshr") for _ in range(60_000))]
    return out


def test_same_ids_as_library(library):
    every = texts()
    got = byte_bpe.tokenizer(PATH, P.PATTERN).encode_block(every)
    for text, ids in zip(every, got):
        assert ids.tolist() == library.encode_ordinary(text), text[:80]


def test_query_digests(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(100, None, "x"), (100, None, "x"), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, byte_bpe.digests(docs, PATH, P.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert byte_bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_blocks_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = byte_bpe.encode(docs, PATH, P.PATTERN)
    b = byte_bpe.encode(docs, PATH, P.PATTERN, block_chars=5000)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
