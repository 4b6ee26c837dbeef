"""Plans and results that hold at sizes beyond the other tests' tables."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import colour
from voxlake.operators import centroids, codebook, descent, ground, lineage, mixtures, sweep
from voxlake.plans import catalog, catalog_files, catalog_fits, catalog_meters, catalog_scans  # noqa: F401  the others add their queries
from voxlake.sources import corpora

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c243_rate_meter", "f07_entropy", "f08_tiling_energy", "f09_energy_per_cell", "f13_ground_fraction", "f23_frame_energy", "f56_funnel_ledger", "f57_telescoped_ratio", "f58_path_connectivity", "f78_rung_state"])
def test_measures_need_no_dense_histogram(spark, name):
    """An exploded side of an inner join was taken for small, and 256 rows a frame were gathered in the driver."""
    plan = catalog.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"explode\(.*\[idx#", plan)


def test_nearest_rows_join_few_boxes(spark):
    """Each probe met every row; now the boxes near it. Crowds at one place, ties and outliers lose nothing."""
    rng = np.random.default_rng(3)
    places = np.concatenate([rng.normal(size=(6000, 2)), np.repeat(rng.normal(size=(20, 2)), 100, axis=0), rng.integers(-3, 4, (1000, 2)), [[90.0, -70.0], [-1e6, 3.0]]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(places)]
    store = spark.createDataFrame(rows, "id long, a double, b double")
    probes = store.where("id % 100 = 0 or id >= 9000").withColumnRenamed("id", "probe")
    found = codebook.k_nearest(store, probes, ["a", "b"], "id", 5)
    got = {(r.probe, r.rank): (r.id, r.d2) for r in found.collect()}
    want = {}
    for i in [i for i in range(len(rows)) if i % 100 == 0 or i >= 9000]:
        d = (places[:, 0] - places[i, 0]) * (places[:, 0] - places[i, 0]) + (places[:, 1] - places[i, 1]) * (places[:, 1] - places[i, 1])
        for r, j in enumerate(np.lexsort((np.arange(len(d)), d))[:5], 1):
            want[i, r] = (j, d[j])
    assert got == want
    join = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(_box" in join


def test_few_rows_have_fewer_neighbours(spark):
    store = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, a double, b double")
    found = codebook.k_nearest(store, store.withColumnRenamed("id", "probe"), ["a", "b"], "id", 5).collect()
    assert sorted((r.probe, r.id, r.d2, r.rank) for r in found) == [(1, 1, 0.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 2), (2, 2, 0.0, 1)]


def beside_sql(spark, name, folder):
    """Rows of a query and of its SQL over folder's lineitem."""
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    return sorted(tuple(r[c] for c in columns) for r in df.collect()), sorted(want)


def lines(folder, n, source=D):
    duckdb.connect().execute(f"copy (select * from '{source}/lineitem.parquet' order by l_orderkey, l_partkey, l_suppkey, l_linenumber limit {n}) to '{folder}/lineitem.parquet' (format parquet)")


def test_a_capture_of_whole_frames_is_not_whole(spark, tmp_path):
    """36,000,000 cells leave a last capture of one whole frame; it was taken for a capture of its own."""
    lines(tmp_path, 4096 + 256)
    got, want = beside_sql(spark, "a04_cube_file_scan", tmp_path)
    assert len(got) == 4096 and got == want


def test_pooled_tensors_keep_their_fifth_digit(spark, tmp_path):
    lines(tmp_path, 60000, "/root/testdata/sf0.01")
    got, want = beside_sql(spark, "f45_tensor_pool", tmp_path)
    assert got == want


def test_cells_meet_their_book_once_a_frame(spark):
    """A book of 5 KB was copied to every cell. Frames of unequal size, ties, and the greedy way, beside plain loops."""
    rng = np.random.default_rng(4)
    leaves = [(t, k, *map(float, rng.integers(0, 4, 3))) for t in range(3) for k in range(128)]  # few values: many ties
    nodes = [(t, k, *map(float, rng.integers(0, 4, 3))) for t in range(3) for k in range(16)]
    halves = [(t, k, *map(float, rng.integers(0, 4, 3))) for t in range(3) for k in range(2)]
    cells = [(t, i // 16, i % 16, f"c{i}", *map(float, rng.random(3) * 4)) for t, n in enumerate((1, 256, 130)) for i in range(n)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"t int, {key} int, ll double, la double, lb double")
    df = spark.createDataFrame(cells, "t int, y int, x int, name string, ll double, la double, lb double")
    books = descent.books(frame(leaves, "leaf"), frame(nodes, "node"), ["t"])
    best, greedy = descent.exhaustive(df, books, ["t"]), descent.greedy(df, books, frame(halves, "node"), ["t"])
    table = lambda rows: {t: np.array([r[2:] for r in rows if r[0] == t]) for t in range(3)}
    at = {c[:3]: c for c in cells}
    all_leaves, all_nodes, all_halves = table(leaves), table(nodes), table(halves)
    least = lambda book, p: int(((book[:, 0] - p[0]) ** 2 + (book[:, 1] - p[1]) ** 2 + (book[:, 2] - p[2]) ** 2).argmin())
    for r in best.collect():
        assert r.name == at[r.t, r.y, r.x][3] and r.leaf == least(all_leaves[r.t], np.array(at[r.t, r.y, r.x][4:]))
    for r in greedy.collect():
        p = np.array(at[r.t, r.y, r.x][4:])
        n = 8 * (h := least(all_halves[r.t], p)) + least(all_nodes[r.t][8 * h : 8 * h + 8], p)
        assert r.leaf == 8 * n + least(all_leaves[r.t][8 * n : 8 * n + 8], p)
    assert best.count() == greedy.count() == len(cells)
    assert all("MapInArrow" in x._jdf.queryExecution().optimizedPlan().toString() for x in (best, greedy))


def test_short_rows_of_much_work_go_to_many_tasks(spark):
    few = spark.range(64).repartition(1)
    assert lineage.cut(lineage.spread(few, "id")).rdd.getNumPartitions() > 4


def test_chroma_is_clamped_as_by_plain_bisection(spark):
    rng = np.random.default_rng(5)
    colours = [tuple(map(float, c)) for c in np.column_stack([rng.random(60), rng.normal(0, 0.25, 60), rng.normal(0, 0.25, 60)])] + [(0.0, 0.0, 0.0), (1.0, 0.2, 0.1)]
    rows = spark.createDataFrame(colours, "ll double, la double, lb double")
    plan = ground.chroma_clamp(rows)
    assert "ArrowEvalPython" in plan._jdf.queryExecution().optimizedPlan().toString()

    def fits(light, a, b):
        lms = [(m[0] * light + m[1] * a + m[2] * b) ** 3 for m in colour.OKLAB_LMS_BACK]
        return all(-1e-6 <= sum(p * q for p, q in zip(row, lms)) <= 1 + 1e-6 for row in colour.OKLAB_RGB_BACK)

    for (light, a, b), got in zip(colours, plan.collect()):
        low = 0.0
        for k in range(1, 41):
            low = low + 0.5**k if fits(light, a * (low + 0.5**k), b * (low + 0.5**k)) else low
        low = 1.0 if fits(light, a, b) else low
        assert abs(got.la - a * low) < 1e-9 and abs(got.lb - b * low) < 1e-9


def test_soft_weights_are_no_fold_of_rows(spark):
    """64 distances a cell were interpreted folds."""
    df = catalog.QUERIES["n34_soft_assignment"](spark, D)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_fits_of_many_groups_are_no_interpreted_folds(spark):
    """64 steps were folds of expressions over each group's values; now they are taken for many groups at once, and groups of
    unlike size, of one value, and of two phases far apart keep their fits."""
    rng = np.random.default_rng(4)
    groups = {0: [0.5], 1: [0.25, 0.75], 2: [0.5] * 9, 3: [*rng.normal(0.1, 0.01, 300), *rng.normal(0.9, 0.01, 100)], 4: rng.integers(0, 9, 256) / 8, 5: [0.0, 0.0, 1.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "t int, s double")
    fitted = mixtures.fit(mixtures.counted(df, "s", ["t"]))
    assert "aggregate(" not in fitted._jdf.queryExecution().optimizedPlan().toString()
    got = {r.t: r.fit for r in fitted.collect()}
    assert got[0] is None
    for g in range(1, 6):
        v = np.sort(groups[g])
        n, half = len(v), len(v) // 2
        mf, mb, pb, sd = v[half:].mean(), v[:half].mean(), 0.5, max(1e-9, v.std())
        for _ in range(64):
            with np.errstate(all="ignore"):
                r = 1 / (1 + np.exp(-(np.log(pb / (1 - pb)) + ((v - mf) ** 2 - (v - mb) ** 2) / (2 * sd * sd))))
            if not 0 < r.sum() < n:
                break
            mf, mb, pb = ((1 - r) * v).sum() / (1 - r).sum(), (r * v).sum() / r.sum(), r.mean()
            sd = max(1e-9, np.sqrt((r * (v - mb) ** 2 + (1 - r) * (v - mf) ** 2).sum() / n))
        want = (mf, mb, pb, sd) if mf >= mb else (mb, mf, 1 - pb, sd)
        assert np.allclose(tuple(got[g]), want, atol=1e-6)


def test_three_rungs_deal_cells_once(spark):
    """Cells met their blocks' nodes by a join, and were packed by frame after it."""
    frames = spark.range(6).select(F.col("id").cast("int").alias("t"))
    leaf = frames.crossJoin(spark.range(128).select(F.col("id").cast("int").alias("leaf")))
    leaves = leaf.select("t", "leaf", (F.col("leaf") / 127).alias("ll"), F.lit(0.0).alias("la"), F.lit(0.0).alias("lb"))
    nodes16 = leaves.groupBy("t", F.shiftright("leaf", 3).alias("node")).agg(*[F.avg(c).alias(c) for c in ("ll", "la", "lb")])
    at = spark.range(6 * 256).select(*[F.expr(e).cast("int").alias(c) for c, e in (("t", "id div 256"), ("y", "id div 16 % 16"), ("x", "id % 16"))])
    cells = at.select("*", (F.expr("(y div 2 * 8 + x div 2) / 64")).alias("ll"), F.lit(0.0).alias("la"), F.lit(0.0).alias("lb"))
    placed = descent.three_rungs(cells, descent.books(leaves, nodes16, ["t"]))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # of books, and of layers with them: none of cells with blocks
    rows = placed.collect()
    assert len(rows) == 6 * 256 and {r.t for r in rows} == set(range(6))
    for r in rows:
        d = [(k / 127 - r.ll) ** 2 for k in range(128)]
        assert abs(r.d - (r.leaf / 127 - r.ll) ** 2) < 1e-12 and r.d <= min(d) + 2 / 127**2


def test_sweeps_are_shared(spark):
    """The objectives after one and after four sweeps took two passes over all blocks."""
    rng = np.random.default_rng(9)
    cells = [(t, y, x, *map(float, rng.random(3)), int(rng.integers(0, 12)), True) for t in range(4) for y in range(8) for x in range(4)]
    packed = sweep.most_used(sweep.blocks(spark.createDataFrame(cells, "t int, y int, x int, ll double, la double, lb double, code int, far boolean"), "code"))
    books = spark.createDataFrame([(0, [tuple(map(float, rng.random(3))) for _ in range(12)])], "t int, colours array<struct<ll:double,la:double,lb:double>>")
    both = {(r.by, r.bx): r for r in sweep.refine(packed, books, 4, (1,)).collect()}
    one, four = ({(r.by, r.bx): r for r in sweep.refine(packed, books, k).collect()} for k in (1, 4))
    assert len(both) == 2
    for k, r in both.items():
        assert r.before == one[k].before and abs(r.after1 - one[k].after) < 1e-12 and abs(r.after - four[k].after) < 1e-12 and r.codes == four[k].codes


def test_hausdorff_makes_no_rows_of_pairs(spark):
    """Each pair of places of a colour was a row of an aggregation that one task's memory held."""
    df = catalog.QUERIES["e21_hausdorff"](spark, D)
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
    got, want = beside_sql(spark, "e21_hausdorff", D)
    assert got == want and got


def test_epoch_quotas_join_nothing(spark):
    """Cells met their colour's quotas by a join, whose sorts grew with the table; now frames are dealt to bounded tasks."""
    plan = catalog.QUERIES["g12_epoch_quotas"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("InMemoryRelation")[0] and "RepartitionByExpression" in plan
    got, want = beside_sql(spark, "g12_epoch_quotas", D)
    assert got == want and got
    assert lineage.tasks(1 << 28) == 1 << 10 and lineage.tasks(0) == 32


def test_diffused_epochs_deal_frames(spark):
    """Targets were made anew for every cell; they are made at a group's first, and frames dealt to tasks by their number."""
    plan = catalog.QUERIES["g11_diffused_epochs"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [t" in plan and "CASE WHEN (_k" in plan


def test_lloyd_steps_are_taken_in_one_task(spark):
    """Each step was a join of all points and a written table; now a group's points are dealt once and no job runs before."""
    rng = np.random.default_rng(9)
    places = [(t, i, *np.round(rng.random(3), 2).tolist()) for t, n in ((0, 40), (1, 3), (2, 700)) for i in range(n)]
    points = spark.createDataFrame(places, "t int, i int, r double, g double, b double")
    found = centroids.lloyd(points, ["t"], ["r", "g", "b"], [F.col("g"), F.col("i")], 8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {r.t: [tuple(c) for c in r.centres] for r in found.collect()}
    for t, n in ((0, 40), (1, 3), (2, 700)):
        mine = sorted((g, i, r, b) for k, i, r, g, b in places if k == t)
        own = [(r, g, b) for g, _, r, b in mine]
        centres = [own[j * n // 8] for j in range(8)]
        for _ in range(8):
            near = [min(range(8), key=lambda j: (round(sum((a - c) ** 2 for a, c in zip(p, centres[j])), 9), j)) for p in own]
            held = [[p for p, k in zip(own, near) if k == j] for j in range(8)]
            centres = [tuple(round(sum(x) / len(h), 9) for x in zip(*h)) if h else c for h, c in zip(held, centres)]
        assert np.allclose(got[t], centres, atol=2e-9)


def test_samples_are_made_once(spark):
    """Filters pushed below the projections repeated a sample's expressions, its JSON and its parse in each of them."""
    pairs = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in ("source", "token", "target")], F.col("id").cast("int").alias("steps"))
    samples, _ = corpora.from_lines(corpora.to_lines(pairs), corpora.PAIR)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and plan.count("from_json(") == 1
    assert sorted(r.steps for r in samples.collect()) == [0, 1, 2]
