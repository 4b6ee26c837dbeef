from collections import Counter
import zlib

import numpy as np

from voxlake.llm import sharding

D = "/root/testdata/sf0.001"


def test_query_keeps_the_law(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = sharding.op3_sharding(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_matrix_has_exact_sums_and_the_hypergeometric_law():
    blocks, shards = [7, 0, 30, 13], [13, 13, 12, 12]
    mean = np.zeros((4, 4))
    for seed in range(400):
        m = sharding.communication_matrix(blocks, shards, seed)
        assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards and (m >= 0).all()
        mean += m / 400
    assert np.abs(mean - np.outer(blocks, shards) / 50).max() < 0.5


def test_large_draws_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(1)
    small = [sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)]
    monkeypatch.setattr(sharding, "LARGEST", 0)
    large = [sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)]
    assert abs(np.mean(small) - np.mean(large)) < 0.15 and abs(np.std(small) - np.std(large)) < 0.15
    n = 3_000_000_000
    assert abs(sharding.hypergeometric(rng, n, n, n) - n / 2) < 10 * n**0.5


def test_many_blocks_lanes_and_odd_rows(spark):
    rows = [(i if i % 3 else None, "same" if i % 2 else str(i), 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shuffle_rows(df, shards=7, rows_per_block=20).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    sizes = Counter(r._shard for r in got)
    assert sorted(sizes.values()) == [142] + [143] * 6 or max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r._slot for r in got if r._shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shuffle_rows(df.limit(0)).count() == 0
    few = sharding.shuffle_rows(df.limit(3)).collect()
    assert sorted(r._shard for r in few) == [0, 1, 2] and {r._slot for r in few} == {0}


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "_block", "_r", "_rank", "_lane", "_n", "_start", "_bounds", "_row", "_key", "_shard", "_slot"]
    rows = [(i, *(f"{c}{i}" for c in names[1:])) for i in range(50)] + [(None, *[None] * 11)] * 3
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = sharding.shuffle_rows(df, shards=4)
    assert got.columns == [*names, "__shard", "__slot"]
    found = got.collect()
    assert sorted((tuple(r)[:12] for r in found), key=str) == sorted(rows, key=str)
    slots = sorted((r[12], r[13]) for r in found)
    assert slots == [(s, k) for s in range(4) for k in range(13 + (s < 1))]
