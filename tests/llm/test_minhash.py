import re
from collections import Counter, defaultdict

import numpy as np

from voxlake.llm import minhash
from voxlake.llm.similar import _sets
from voxlake.llm.text import utf8

D = "/root/testdata/sf0.001"


def brute(rows):
    sets = []
    for i, (d, t) in enumerate(rows):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((i, d, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, _, s in sets:
        shared = Counter(j for x in s for j in holders[x])
        for x in s:
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][2]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, d, _ in sets:
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)), d == least.get(root(i))) for i, d, s in sets)


def run(spark, folder):
    return Counter(map(tuple, minhash.op12_minhash(spark, str(folder)).collect()))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    assert run(spark, D) == brute(rows)


def near_group(rng, n, words, edits):
    base = [f"w{rng.integers(0, 5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, edits):
            own[at] = f"x{rng.integers(0, 10**9)}"
        yield " ".join(own)


def test_groups_about_the_threshold_and_odd_rows(spark, tmp_path):
    """Groups of near copies some pairs of which are linked and some not, and rows of every odd kind."""
    rng = np.random.default_rng(3)
    texts = [t for e in (2, 5, 6, 7, 9, 12) for t in near_group(rng, 40, 110, e)]
    texts += ["", None, "  \t", "one", "ONE", "a b", "a  b ", "a b a b a b", "é ü", "É ü", "x " * 60_000, "x " * 60_001] + ["copy of a row"] * 30
    ids = [int(i) for i in rng.permutation(len(texts))]
    rows = [(None if i % 50 == 7 else ids[i], t, "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, set string, component_id int").write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, tmp_path) == brute([r[:2] for r in rows])


def test_blocks_and_clusters_of_any_size_find_the_same(spark):
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate(t for e in (6, 8) for t in near_group(rng, 60, 80, e))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = minhash.near_documents(docs, chunk=7, chunk_members=900)
    got = Counter((r.doc_id, r.n, r.component_id, r.doc_id == r.component_id) for r in small.collect())
    assert got == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert not run(spark, tmp_path)


def test_signatures_tell_the_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(4000)]
    for share in (0.5, 0.8, 0.9):
        apart = []
        for _ in range(20):
            both = int(400 * share)
            pick = rng.permutation(4000)[: 400 + 400 - both]
            a, b = ([" ".join(words[i] for i in part)] for part in (pick[:400], np.append(pick[:both], pick[400:])))
            h, first = _sets(*utf8(pa.array(a + b)), 1)
            sig = minhash.signatures(minhash.minima(h, first)).view(np.uint64)
            apart.append(int(minhash._differing(sig[0], sig[1])))
        true = both / (800 - both)
        assert abs(minhash.estimated(np.mean(apart)) - true) < 0.015
        assert max(abs(minhash.estimated(np.array(apart)) - true)) < 0.1
