import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

from voxlake.llm import bpe


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, library, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_bpe(spark, d).collect()}
    assert got == {k: want(library, t) for k, t in texts.items()}


@pytest.mark.parametrize("block_words", [3, 1 << 20])
def test_odd_texts(spark, library, block_words, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_ROWS", 2 if block_words == 3 else 1000)
    texts = [
        None, "", " ", "\n\n  x", "I'll don't 's", "naïve café über 東京 😀👍🏽", "a b c\u0085", "12345 6.7e-8", "<|endoftext|>",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 300, "tab\tend  ", "   lead", "trail   \n ", "\x00\x01", "x" * 200 + " y", "same", "same",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    t = bpe.tokenizer(spark, block_words=block_words)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, t).collect()}
    assert got == {i: want(library, t) for i, t in enumerate(texts)}
    assert bpe.digests(df.limit(0), t).count() == 0


def test_checked_keeps_other_columns(spark):
    df = spark.createDataFrame([(None, None, "a", 7), (2, "naïve  x", None, 8), (2, "naïve  x", None, 8)], "doc_id long, text string, lang string, tokens int")
    rows = bpe.checked(df, bpe.tokenizer(spark)).collect()
    assert sorted((r.doc_id or 0, r.lang, r.n_tokens > 0, r.decoded) for r in rows) == [(0, "a", False, ""), (2, None, True, "naïve  x"), (2, None, True, "naïve  x")]
    assert all(len(r.tokens) == r.n_tokens for r in rows)


def test_plans_do_not_spell_the_rank_map(spark):
    """The map was a literal of the plan, whose text the driver wrote again and again: megabytes each time."""
    docs = spark.createDataFrame([(0, "some words")], "doc_id long, text string")
    plan = bpe.digests(docs, bpe.tokenizer(spark))._jdf.queryExecution().optimizedPlan()
    seen = [plan]
    for node in seen:
        inner = node.children()
        seen += [inner.apply(k) for k in range(inner.size())]
        assert len(node.simpleString(25)) < 300_000
