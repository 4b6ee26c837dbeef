import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from voxlake.llm import similar


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """doc_id: the smallest id that links of 5-word Jaccard 0.8 or more reach."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def copies(seed=3):
    """Texts of random words, and copies of each whose 5-word Jaccard lies from about 0.7 to 0.95; a line that most hold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line, rows = " ".join(word() for _ in range(12)), []
    for n in (6, 12, 40, 90, 200, 400, 900):
        base = [word() for _ in range(n)]
        rows.append(line + " " + " ".join(base))
        for share in (0.005, 0.01, 0.02, 0.022, 0.03, 0.04):
            copy = list(base)
            for i in rng.sample(range(n), max(1, round(share * n))):
                copy[i] = word()
            rows.append(" ".join(copy) + (" " + line if rng.random() < 0.8 else ""))
        rows.append(" ".join(base[: round(0.83 * n)]))
        rows.append(" ".join(base).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("sizes", [{}, {"most": 1}, {"sample": 5}])
def test_components_equal_brute_force(spark, sizes):
    rows = copies()
    want = brute(rows)
    assert 10 < len(set(want.values())) < len(rows) - 15
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in similar.similar_documents(df, **sizes).collect()} == want


def test_stage_drops_copies_from_0_8_on(spark):
    """One copy at each similarity from 0.8 to 0.95 goes, one below stays, from the stage as the pipeline calls it."""
    rng = random.Random(1)
    rows, similarity = [], {}
    for k, cut in enumerate((5, 10, 15, 19, 22)):  # of 104 words: 100 shingles, of which the copy lacks the last ones
        base = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 104 - cut]))]
        similarity[2 * k + 1] = (100 - cut) / 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, df, "").collect()}
    assert got == {d for d, _ in rows if similarity.get(d, 0) < 0.8}


def test_query_rows_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()} == want


def test_nulls_blanks_and_extra_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "A b", 5), (5, "a  B", 5), (None, "x y z", 5), (7, "long " * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = similar.drop_similar(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7]
    assert similar.similar_documents(df.limit(0)).count() == 0


def test_bit_sliced_distances_equal_plain_ones():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 63, (150, similar.WIDE), dtype=np.uint64)
    for k in range(1, 150, 2):  # copies of the row before with up to 300 bits turned
        turned = np.zeros(512, np.uint8)
        turned[rng.choice(512, 2 * k, replace=False)] = 1
        sig[k] = sig[k - 1] ^ np.packbits(turned, bitorder="little").view(np.uint64)
    n = rng.integers(1, 200, 150)
    apart = np.array([[sum(int(a ^ b).bit_count() for a, b in zip(x, y)) for y in sig.tolist()] for x in sig[:40].tolist()])
    small = np.minimum(n[:40, None], n[None, :]) < similar.SMALL
    want = apart <= np.where(small, similar._most_apart((4, 5), True), similar._most_apart((4, 5), False))
    blocks = [(sig[:40], n[:40], sig, n), (sig[:3], n[:3], sig[:0], n[:0]), (sig[3:9], n[3:9], sig[5:70], n[5:70])]
    for pairs in (1, 1 << 15):
        got = list(similar._judge((4, 5), pairs)(blocks))
        assert (got[0] == want).all() and got[1].shape == (3, 0) and (got[2] == want[3:9, 5:70]).all()
    assert 40 < want.sum() < want.size


def test_small_sets_differ_in_no_more_bits_than_the_bound_says():
    """The chance that a bit differs, for all sets below SMALL with a similarity of 0.8 or more, by counting."""
    above = lambda n: [sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n for k in range(n + 2)]
    most = 0.0
    for both in range(1, similar.SMALL):
        for p in range(both // 4 + 1):
            for q in range(p, both // 4 - p + 1):
                n, m, share = both + p, both + q, 0.0
                for c in range(both + 1):
                    x, y = (above(e)[min(e + 1, max(0, size // 2 + 1 - c))] for e, size in ((p, n), (q, m)))
                    share += math.comb(both, c) / 2**both * (x * (1 - y) + y * (1 - x))
                most = max(most, share)
    assert most <= similar.SMALL_SHARE


def test_large_groups_send_forests(spark, monkeypatch):
    """Groups of near copies beyond a block's chunk: the pairs that left a task grew with the square of a group."""
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        for i in range(80):
            copy = list(base)
            for at in rng.sample(range(60), rng.choice((1, 2, 3))):
                copy[at] = f"v{rng.randrange(10**9)}"
            rows.append((1000 * g + i, " ".join(copy)))
    made = []
    whole = similar._links_within
    monkeypatch.setattr(similar, "_links_within", lambda *a: made.append(whole(*a)) or made[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(df, chunk=16, chunk_members=500).collect()}
    assert got == brute(rows)
    assert made and made[0].count() <= 10 * len(rows)
