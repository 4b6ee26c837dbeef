import re

import numpy as np
import pytest
import xxhash

from voxlake.llm import simhash


def brute_fp(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    ids = list(range(len(fps)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def near(rng, base, flips):
    for b in rng.choice(64, flips, replace=False):
        base ^= 1 << int(b)
    return base


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    fps = [brute_fp(t) for t in rows.text]
    want = {int(d): (f"{f:016x}", int(rows.doc_id.iloc[c])) for d, f, c in zip(rows.doc_id, fps, brute_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"largest": 8}, {"per_bucket": 1}, {"per_bucket": 1, "largest": 4}])
def test_classes_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for i in range(240):
        fps.append(near(rng, fps[int(rng.integers(len(fps)))], int(rng.integers(0, 7))))
    want = dict(zip(range(len(fps)), brute_components(fps)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component for r in df.join(simhash.near_classes(df, **sizes), "fp").collect()}
    assert got == want


@pytest.mark.parametrize("radius", range(7))
def test_within_counts_bits(radius):
    rng = np.random.default_rng(radius)
    fps = np.array([near(rng, 12345678901234567, int(rng.integers(0, 12))) for _ in range(64)], np.uint64)
    planes = np.ascontiguousarray(np.packbits(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, axis=1, bitorder="little")).view(np.uint64)
    q, w, lanes = simhash.within(planes, fps, np.arange(64), np.zeros(64, np.int64), radius)
    got = {(int(a), b) for a, lane in zip(q, lanes) for b in range(64) if int(lane) >> b & 1}
    assert got == {(i, j) for i in range(64) for j in range(64) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius}


def test_nulls_empties_and_extra_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "A b", 5), (5, "a  B", 5), (None, "x y z", 5), (7, "long " * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1)
    assert got[4] == got[5] == (f"{brute_fp('a b'):016x}", 4)
    assert got[None][1] is None and got[7][1] == 7
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
