import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from voxlake.llm import merkle

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tampered string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r)
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(langs[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.n_chars)))
        trees.append((own, levels_of([leaf_of(r, r.n_chars) for r in own])))
    over = levels_of([levels[-1][0] for _, levels in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            proof = path(levels, i) + path(over, k)
            n = r.n_chars
            if r.doc_id is not None and n is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0:
                n += 1
            folded = leaf_of(r, n)
            for left, sibling in proof:
                folded = h(sibling, folded) if left else h(folded, sibling or "")
            siblings = h(*[s for _, s in proof if s])
            out.append((r.doc_id, levels[0][i], levels[-1][0], over[-1][0], siblings, folded, folded == over[-1][0]))
    return out


def run(spark, path):
    return sorted(map(tuple, merkle.op11_merkle(spark, path).collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert run(spark, D) == sorted(brute(rows), key=str)


def odd(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, "x", 1), (None, "a", None, "s", 3, "x", 1)]
    rows += [(5, "same", "en", "s", 4, None, 2)] * 7 + [(5, "other", "en", "s", (1 << 63) - 1, None, 2)]
    rows += [(i, "wörd " * (i % 5), "de" if i % 3 else "é", "", i, "y", 3) for i in range(140)]
    rows += [(9, "long " * 100_000, "zz", "s", 1, "y", 3), (7, "", "", "s", None, "y", 3)]
    folder = odd(spark, tmp_path / "odd", rows)
    got = run(spark, folder)
    want = sorted(brute(spark.read.parquet(f"{folder}/documents.parquet").collect()), key=str)
    assert got == want and {r[-1] for r in got} == {True, False}


def test_empty_table_and_single_rows(spark, tmp_path):
    assert run(spark, odd(spark, tmp_path / "none", [])) == []
    folder = odd(spark, tmp_path / "one", [(4, "t", "en", "s", 1, "", 0)])
    [row] = run(spark, folder)
    assert row[1] == row[2] == row[3] and row[4] == h()


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_passes_of_any_stride_make_the_same_tree(spark, stride):
    for n in (1, 2, 3, 5, 64, 65, 131):
        nodes = [h(str(i)) for i in range(n)]
        df = spark.createDataFrame([("k", i, n, x) for i, x in enumerate(nodes)], "tree string, idx long, n long, hash string")
        trees = merkle.build(df, stride=stride)
        levels = levels_of(nodes)
        assert trees.tops.first().hash == levels[-1][0]
        start = trees.tops.select("tree", F.expr("array()").cast(merkle.SUFFIX).alias("suffix"))
        got = {r.idx: [(int(p.left), p.hash) for p in r.proof] for r in merkle.push(trees, start).collect()}
        assert got == {i: path(levels, i) for i in range(n)}
