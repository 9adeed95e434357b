"""Every pipeline stage on its own input against brute force."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from terrace.llm import mixing, toxicity
from terrace.plans.scratch import written
from tests.llm.test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    lexicon = toxicity.production_lexicon(spark, docs, SF)
    a = lexicon.automaton()
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        after = out.collect()
        if name == "byte-level bpe":
            break
        assert out.columns == columns and out.dtypes == docs.dtypes
        ids = sorted(r.doc_id for r in after)
        if name == "toxicity":
            want = [r.doc_id for r in before if toxicity.score_of(r.text, lexicon, a) < toxicity.THRESHOLD]
            assert 0 < len(want) < len(before)
        elif name == "exact dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
            want = [min(g)[1] for g in groups.values()]
        elif name == "n-gram jaccard join":
            want = [d for d, _, c in near([(r.doc_id, r.text) for r in before]) if d == c]
        else:
            plan = {r.doc_id: r for r in mixing.mixed(docs).collect()}
            want = [d for d, r in plan.items() for _ in range(int(r.taken / max(r["size"], 1) + 0.5))]
            assert Counter(ids) == Counter(want)
            at = defaultdict(list)
            for d, r in plan.items():
                at[d] = list(r.passes or ())
            seen = Counter()
            order = []
            for r in after:
                order.append(at[r.doc_id][seen[r.doc_id]])
                seen[r.doc_id] += 1
        assert ids == sorted(want), name
        assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        docs, before = out, after
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before:
        i = library.encode_ordinary(r.text)
        want[r.doc_id, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, after)) == want


def test_order_follows_positions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {r.doc_id: r.passes for r in mixing.mixed(docs).collect()}
    seen, last = Counter(), -1.0
    for r in mixing.schedule(docs).collect():
        now = at[r.doc_id][seen[r.doc_id]]
        seen[r.doc_id] += 1
        assert now >= last
        last = now


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "a b c", "en", "s", 5), (4, "a  b c", None, "s", None), (5, "x " * 5000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Of the wordless rows one stays, which mixing leaves out; the others are taken once or twice.
    for some, ids in ((docs, {None, 4, 5}), (docs.limit(0), set())):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(stage(spark, some, SF))
            assert i == 4 or out.columns == docs.columns
            some = out
        assert {r.doc_id for r in out.collect()} <= ids and (out.count() > 0) == bool(ids)
    kept = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
