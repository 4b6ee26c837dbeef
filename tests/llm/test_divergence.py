import re
from collections import Counter, defaultdict

import numpy as np

from voxlake.llm import divergence

D = "/root/testdata/sf0.001"


def brute(rows, least=30, top=50):
    occ, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        occ[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(c[t] for c in counts for t in kept)
            return {t: 1 + 10**9 * (sum(c[t] for c in counts) + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares([occ[lang, s]]) for s in sources}
        q = shares([occ[lang, s] for s in sources])
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if occ[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", o.decode(), -v, k + 1) for k, (v, o) in enumerate(terms)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").select("lang", "source", "text").collect()
    assert sorted(map(tuple, divergence.op13_divergence(spark, D).collect())) == brute(rows)


def test_small_cells_single_rounds_and_odd_rows(spark):
    """Ties, groups without terms, languages of one to six sources or without a kept term, nulls and clashing columns."""
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "GAMMA", "délta", "Éta", "zeta-zeta", "x1y", "ß", "中文", "tie", "tied"]
    rows = [("en", f"s{rng.integers(0, 6)}", " ".join(rng.choice(words, rng.integers(0, 12)))) for _ in range(300)]
    rows += [("de", "only", "tie tied " * 3)] * 40 + [("fr", s, "Été") for s in "ab" for _ in range(20)] + [("xx", s, "rare") for s in "abc"]
    rows += [("en", "empty", ""), ("en", "null", None), (None, None, "beta"), ("", "", "beta"), ("en", "s1", "beta " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "lang string, source string, text string, slot int, term string")
    for sizes in ({}, {"cell_terms": 2, "per_pass": 1}, {"cell_entries": 5}):
        assert sorted(map(tuple, divergence.audit(docs, **sizes).collect())) == brute(rows)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_each_pair_meets_once(spark):
    from pyspark.sql import functions as F

    for groups in range(1, 9):
        m = groups - (groups + 1) % 2
        slots = spark.range(groups).crossJoin(spark.range(m).select(F.col("id").alias("r"))).withColumn("p", divergence.partner(F.col("id"), F.col("r"), F.lit(m)))
        met = Counter((min(r.id, r.p), max(r.id, r.p)) for r in slots.where(f"p < {groups}").collect())
        assert met == {(a, b): 2 for b in range(groups) for a in range(b)}


def test_shares_are_exact():
    rng = np.random.default_rng(7)
    for total in (7, 10**6, 8 * 10**15):
        count = rng.integers(0, total, 200)
        assert divergence._shares(count, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in count]
