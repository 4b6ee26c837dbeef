import re

import numpy as np

from voxlake.llm import decontaminate as dc


def least_edits(p, t):
    """Edits to turn p into some part of t."""
    row = np.zeros(len(t) + 1, int)
    for i, a in enumerate(p, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + np.array([a != b for b in t], int), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(t) + 1)) + np.arange(len(t) + 1)
    return int(row.min())


def normal(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), " ".join((t or "").split()))


def brute(docs, items, error=0.1, least=1):
    out = set()
    for d, t in docs:
        for i, p in items:
            p = normal(p)
            if len(p) >= least:
                k = max(0, min(int(len(p) * error), len(p) // dc.Q - 1))
                if (e := least_edits(p, normal(t))) <= k:
                    out.add((d, i, e, k))
    return out


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        k, at = rng.integers(3), int(rng.integers(len(s)))
        if k == 0:
            s[at] = "zé"[rng.integers(2)]
        elif k == 1:
            del s[at]
        else:
            s.insert(at, "q")
    return "".join(s)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioustrné"), rng.integers(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(int(rng.integers(2, 30)))) for i in range(30)] + [(30, "short"), (31, "ab" * 40), (32, "é7"), (33, "Short é secret"), (34, "x9 é8 z7"), (35, "short")]
    docs = []
    for d in range(160):
        i = int(rng.integers(36))
        p = edited(rng, items[i][1], int(rng.integers(0, 14)) if len(items[i][1]) > 15 else 0) if d % 4 else ""
        docs.append((d, f"{prose(int(rng.integers(0, 40)))} {p} {prose(int(rng.integers(0, 40)))}"))
    docs += [(200, items[3][1]), (201, "abab" * 300), (202, items[5][1].upper().replace(" ", " \n\t"))]
    got = {tuple(r) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 60


def test_blocks_give_the_same(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    whole = {tuple(r) for r in dc.leaks(docs, bench).collect()}
    assert whole == {tuple(r) for r in dc.leaks(docs, bench, block_chars=3000).collect()} and whole
    holds = {(r.doc_id, b.item_id) for r in docs.collect() for b in bench.collect() if normal(b.text) in normal(r.text)}
    assert holds <= {w[:2] for w in whole}


def test_odd_rows(spark):
    p = "the quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, p, 1), (4, p, 1), (4, p, 1), (5, "x" * 100_000 + p + "y" * 10, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, p, "a"), (2, None, "a"), (None, p, "a"), (None, p, "b"), (3, "", "a")], "item_id long, text string, doc_id string")
    assert sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in dc.leaks(docs, bench).collect()) == sorted((d, i, 0) for d in (0, 4, 4, 5) for i in (0, 1))
    assert dc.drop_leaks(docs, bench, block_chars=50).count() == 2
    assert dc.leaks(docs.limit(0), bench).count() == dc.leaks(docs, bench.limit(0)).count() == 0
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
