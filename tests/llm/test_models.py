import zlib

import numpy as np

from voxlake.llm import quality, toxicity

D = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, D).collect()}
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    held = [(got[x.doc_id].predicted, x.toxic) for x in labels if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([a for a, b in held if b]) >= 0.5 and np.mean([a for a, b in held if not b]) <= 0.02


def test_machine_learns_pairs():
    """Two terms that are toxic only together, which no linear model can tell."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((int(a == b), np.array([1 if a else 2, 3 if b else 4])))
    grade = np.array([g for g, _ in rows])
    start = np.arange(0, 2 * len(rows) + 1, 2)
    model = toxicity.fit(grade, np.ones(len(rows)), start, np.concatenate([t for _, t in rows]), 4, epochs=30)
    term = np.array([1, 3, 1, 4, 2, 3, 2, 4])
    out = toxicity.sigmoid(model.logits(np.repeat(np.arange(4), 2), term, 4))
    assert (out > 0.9).tolist() == [True, False, False, True] and (out < 0.1).tolist() == [False, True, True, False]


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in quality.op6_quality(spark, D).collect()}
    held = [(got[x.doc_id], x.quality) for x in spark.read.parquet(f"{D}/labels.parquet").collect() if got[x.doc_id].held_out]
    assert np.mean([r.keep == bool(q) for r, q in held]) >= 0.9
    assert all(0 <= r.p_best <= r.p_good <= 1 and abs(r.expected_grade - r.p_best - r.p_good) < 1e-9 for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "the idiot " * 9000, 3), (4, "a b", 4), (4, "a b", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, None), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 4, 4]
    for f in (toxicity.toxicity, quality.quality):
        assert f(docs.limit(0), labels).count() == 0
        assert f(docs, labels.limit(0)).count() == 5
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == 5
