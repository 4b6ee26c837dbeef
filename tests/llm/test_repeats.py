import hashlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from voxlake.llm import suffix_array, suffix_trees

D = "/root/testdata/sf0.001"


def brute_words(docs, n=13):
    import re

    texts = [(LAST if d is None else d, d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for o, _, w in texts:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, o), o)
    out = []
    for o, d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < o:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


LAST = 1 << 62


def brute_bytes(docs, n=100):
    order = sorted(((LAST if d is None else d, d, (t or "").encode()) for d, t in docs), key=lambda x: x[0])
    seen, out = set(), []
    for _, d, b in order:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            k = b[i : i + n]
            if k in seen:
                gone[i : i + n] = True
            seen.add(k)
        g = gone[:-1]
        spans = int((g & ~np.append(False, g[:-1])[: len(g)]).sum())
        out.append((d, len(b), int(g.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("op,brute", [(suffix_trees.op1_substring_dedup, brute_words), (suffix_array.op9_suffix_array, brute_bytes)])
def test_query_equals_brute_force(spark, op, brute):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in op(spark, D).collect()) == Counter(brute(docs))


def odd_docs():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 5)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    docs = [(i, " ".join([word() for _ in range(int(rng.integers(0, 30)))] + [passage[rng.integers(4)][int(rng.integers(0, 60)) :]] + [word() for _ in range(int(rng.integers(0, 30)))])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \t\n"), (103, "a" * 1000), (104, "ab" * 700 + " " + "a" * 300), (105, "x " * 400), (106, "x\n" * 90), (None, docs[0][1]), (107, docs[0][1]), (108, docs[0][1] + " end")]
    return docs


@pytest.mark.parametrize("crowded", [200_000, 3])
def test_odd_rows(spark, crowded):
    docs = odd_docs()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, at int")
    got = suffix_trees.without_repeats(df, replace(suffix_trees.WORDS, crowded=crowded)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got) == Counter(brute_words(docs))
    got = suffix_array.without_repeats(df, replace(suffix_array.BYTES, crowded=crowded)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == Counter(brute_bytes(docs))
    if crowded == 3:
        assert suffix_array.without_repeats(df.limit(0)).count() == suffix_trees.without_repeats(df.limit(0)).count() == 0
        cut = suffix_array.cut_repeats(df)
        assert cut.columns == df.columns and cut.where("doc_id in (100, 101)").count() == 2 and cut.where("doc_id = 107").count() == 0


@pytest.mark.parametrize("in_memory", [1 << 22, 50])
def test_sorted_suffixes(in_memory):
    rng = np.random.default_rng(4)
    for sigma in (1, 2, 5, 200):
        texts = [bytes(rng.integers(0, sigma, int(rng.integers(1, 120))).astype(np.uint8)) for _ in range(12)]
        texts += [texts[0], texts[1] + texts[0], b"aaaa" * 20, b"abab" * 15]
        signs = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, 0) for t in texts]).astype(np.uint16)
        depth = 21
        pos, lcp = (np.concatenate(x) for x in zip(*suffix_array.sorted_suffixes(signs, depth, in_memory)))
        assert sorted(pos.tolist()) == np.flatnonzero(signs).tolist()
        stop = np.flatnonzero(signs == 0)
        suffix = [tuple(signs[p : stop[np.searchsorted(stop, p)]].tolist()) for p in pos]
        assert [s[:depth] for s in suffix] == sorted((s[:depth] for s in suffix), reverse=True)
        for a, b, n in zip(suffix, suffix[1:], lcp[1:]):
            real = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(n, depth) == min(real, depth) or (a == b and n >= real) or (real >= depth and n >= depth), (a, b, n)


@pytest.mark.parametrize("in_memory", [1, 3, 1000])
def test_groups(in_memory):
    contents = [t.encode() for _, t in odd_docs() if t]
    w = defaultdict(set)
    for i, c in enumerate(contents):
        x = c.split()
        for j in range(len(x) - 12):
            w[tuple(x[j : j + 13])].add((i, j))
    out = defaultdict(set)
    for i, j, k in zip(*suffix_trees.group_words(contents, in_memory=in_memory)):
        out[k].add((i, j))
    assert sorted(map(sorted, out.values())) == sorted(sorted(v) for v in w.values() if len(v) > 1)
    w = defaultdict(set)
    for i, c in enumerate(contents):
        for j in range(len(c) - 99):
            w[c[j : j + 100]].add((i, j))
    out = defaultdict(set)
    for i, j, k in zip(*suffix_array.group_bytes(contents, in_memory=in_memory * 1000)):
        out[k].add((i, j))
    assert sorted(map(sorted, out.values())) == sorted(sorted(v) for v in w.values() if len(v) > 1)


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2 ** 64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_contents_decide_and_not_their_hashes(spark):
    one, other = thue_morse(4096)
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.n_removed) for r in suffix_trees.without_repeats(docs).collect()) == [(1, 0), (2, 0)]
    got = suffix_array.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == Counter(brute_bytes(rows))


def test_a_line_repeated_in_one_document_and_others(spark):
    line = " ".join(f"w{i}" for i in range(16)) + "\n"
    rows = [(5, line * 40), (3, "x " + line * 30), (9, line * 3 + "y"), (3, "z " + line * 2), (4, line[5:] + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_trees.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got) == Counter(brute_words(rows))


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_anchor_depends_on_its_window_alone(monkeypatch, unit):
    """Grams whose hashes agree in their upper bits, or altogether, in pieces of any length."""
    import pyarrow as pa

    from voxlake.llm import repeats

    whole = repeats.hash_grams
    monkeypatch.setattr(repeats, "hash_grams", lambda v, k: np.uint64(7 << 60) | whole(v, k) & np.uint64(0x1FF))
    rng = np.random.default_rng(4)
    w = repeats.Windows(unit, 20, 4, True, None)
    window = "".join(rng.choice(list("abcdefgh "), 20)) if unit == "bytes" else " ".join(rng.choice(list("abcdefgh"), 20))
    other = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    found = set()
    for before in (0, 3, 57, 20_000):
        text = (other(before) + " " if before else "") + window + " " + other(before)
        rows = repeats.Rows.of(w, pa.array(["x y", text]))
        at = rows.offsets[1] + (len(text[: text.index(window)]) if unit == "bytes" else before)
        row, first, many, anchor, _ = repeats.runs(w, rows)
        k = int(np.flatnonzero((first <= at) & (at < first + many))[0])
        found.add(int(anchor[k] - at))
    assert len(found) == 1
