"""Cells and leaves that lie and travel packed by frame."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.functions import colour
from voxlake.operators import descent, lineage, packing, pairtree, solve, sweep
from voxlake.operators.pairtree import LAB
from voxlake.plans import catalog, catalog_files, catalog_scans, catalog_solve
from voxlake.plans.cube import cube

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def solved(spark):
    """The solve of the small table, with the rows of each table that it writes."""
    written = []

    def cut(df):
        written.append((out := lineage.cut(df)).count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(solve, "cut", cut)
        done = solve.solve(catalog_solve.keyed(cube(spark, D)))
    return done, written


def test_the_solve_writes_no_row_a_cell(solved):
    """Three tables of cells and one of leaves were written, some 250 bytes a cell, and cells were dealt for each."""
    done, written = solved
    frames = done.frames.count()
    assert frames == 24 and max(written) == frames
    assert done.cells.count() == 6000 and done.leaves.count() == 128 * frames == 8 * done.nodes16.count() == 8 * done.canonical.count()


def test_rows_are_packed_across_batches(spark):
    """Keys in no order over many small batches, nulls kept, arrays in step."""
    rng = np.random.default_rng(1)
    rows = [(int(t) // 2, int(t), i, None if i % 7 == 0 else i / 2) for i, t in enumerate(rng.integers(0, 9, 500))]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 16)
    try:
        got = packing.packed(spark.createDataFrame(rows, "capture long, t int, i int, v double"), ["capture", "t"], "t").collect()
    finally:
        spark.conf.set(batch, before)
    assert len(got) == len({r[1] for r in rows})
    assert sorted((r.capture, r.t, i, v) for r in got for i, v in zip(r.i, r.v, strict=True) if v is not None) == sorted(r for r in rows if r[3] is not None)
    assert sum(len(r.i) for r in got) == 500
    assert packing.packed(spark.createDataFrame([], "t int, i int"), ["t"], "t").count() == 0


def test_bytes_have_the_colours_of_the_expressions(spark):
    rng = np.random.default_rng(2)
    rgb = np.append(rng.integers(0, 1 << 24, 300), [0, (1 << 24) - 1])
    rows = spark.createDataFrame([(int(n),) for n in rgb], "n int")
    want = rows.select("n", *[c.alias(k) for c, k in zip(colour.oklab(tuple(F.shiftright("n", k).bitwiseAND(255) / 255 for k in (16, 8, 0))), "lab")]).collect()
    assert np.allclose(colour.oklab_of(np.array([r.n for r in want], np.int32)), [r[1:] for r in want], rtol=0, atol=1e-14)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_indices_take_one_deal_of_frames(solved):
    """Cells were dealt for the rungs, written, and dealt again for the dither."""
    plan = plan_of(solved[0].cells.select("t", "y", "x", "index"))
    assert plan.count("Join Inner") == 1 and plan.count("MapInArrow") == 1 and plan.count("collect_list(struct(") == 2
    assert "collect_list(struct(capture" in plan and "place" in plan


@pytest.mark.parametrize("names", [("best",), ("best", "greedy")])
def test_ways_of_descent_share_the_deal(solved, names):
    """Cells with their indices were dealt by frame once more for the exhaustive search, and again for the greedy one."""
    done = solved[0]
    ways = {"best": descent.all_leaves, "greedy": descent.by_means}
    rows = done.assigned(**{n: ways[n] for n in names})
    assert plan_of(rows).count("Join Inner") == 1 and plan_of(rows).count("MapInArrow") == 1
    books = descent.books(done.leaves, done.nodes16, ["t"])
    cells = done.cells.select("t", "y", "x", *LAB)
    alone = {"best": descent.exhaustive(cells, books, ["t"])}
    if "greedy" in names:
        alone["greedy"] = descent.greedy(cells, books, pairtree.nodes(done.frames, ["t"], 1, 1), ["t"])
    got = {(r.t, r.y, r.x): r for r in rows.collect()}
    assert len(got) == 6000
    for n in names:
        want = alone[n].collect()
        assert len(want) == 6000 and all((lambda g: g[n] == r.leaf and abs(g[f"{n}_d"] - r.d) < 1e-12)(got[r.t, r.y, r.x]) for r in want)


@pytest.mark.parametrize("name", ["e02_assign_roles", "e03_three_rungs", "e04_greedy_descent", "e05_exhaustive_leaf"])
def test_searches_of_leaves_deal_no_cells(spark, solved, monkeypatch, name):
    monkeypatch.setattr(catalog_solve, "solved", lambda cells: solved[0])
    plan = plan_of(catalog.QUERIES[name](spark, D))
    assert plan.count("collect_list(") == 2 and plan.count("MapInArrow") == 1


def test_far_blocks_are_refined_in_place(spark, monkeypatch):
    """Cells were dealt to blocks and joined to all cells again. Whole and part-filled blocks, far ones and others; all places
    stay, and only those of whole far blocks move."""
    rng = np.random.default_rng(3)
    cells = []
    for t, y, x in np.argwhere(np.ones((6, 8, 8), bool)).tolist():
        far = (t // 4 + y // 4 + x // 4) % 2 == 0
        cells.append((t, y, x, int(rng.integers(128, 160)), 0.99 if far or rng.random() < 0.5 else 0.5, *map(float, rng.random(3))))
    df = spark.createDataFrame(cells, "t int, y int, x int, index int, pull double, ll double, la double, lb double")

    def run(batches):
        for batch in [b for b in batches if b.num_rows]:
            place = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            yield pa.RecordBatch.from_arrays(sweep.arrays(place, dict(zip(("code", "pull", *LAB), batch.columns[3:]))), ["bt", "by", "bx", "cells"])

    cell = "struct<v:int,code:int,pull:double,ll:double,la:double,lb:double>"
    blocks = df.coalesce(1).mapInArrow(run, f"bt int, by int, bx int, cells array<{cell}>")
    table = spark.createDataFrame([(t, i, *map(int, rng.integers(0, 256, 3))) for t in range(6) for i in range(256)], "t int, idx int, r8 int, g8 int, b8 int")
    monkeypatch.setattr(catalog_scans, "solved", lambda cells: SimpleNamespace(blocks=blocks, table=table))
    found = catalog.QUERIES["j15_refine_far_blocks"](spark, D)
    assert "LeftOuter" not in plan_of(found)
    whole = sweep.most_used(sweep.blocks(df.withColumn("far", F.col("pull") >= 31 / 32), "index").where(F.forall("cells", lambda c: c["far"])))
    want = {c[:3]: c[3] for c in cells}
    moved = {(r.t, r.y, r.x): r.code for r in sweep.placed(sweep.refine(whole, catalog_scans.colour_books(None))).collect()}
    assert len(moved) == 2 * 64 and any(want[k] != v for k, v in moved.items())
    got = [((r.t, r.y, r.x), r["index"]) for r in found.collect()]
    assert len(got) == len(cells) and dict(got) == want | moved


def test_blocks_of_the_solve_are_its_cells(solved):
    rows = sweep.unpacked(solved[0].blocks).collect()
    assert len(rows) == 6000 and {tuple(r) for r in rows} == {tuple(r) for r in solved[0].cells.select("t", "y", "x", "index").collect()}
    assert "collect_list(struct(v" not in plan_of(solved[0].blocks)


def test_palettes_need_no_indices(spark, solved, monkeypatch):
    """The first frames' palettes were read beside all indices, which were made a second time."""
    monkeypatch.setattr(catalog_files, "solved", lambda cells: solved[0])
    found = catalog.QUERIES["a06_gif_palette"](spark, D)
    assert plan_of(found).count("collect_list(struct(capture") == 1
    assert [tuple(r) for r in found.collect()] == [(0, True)]  # the second capture's last frame is part-filled


def test_tables_of_traces_meet_frame_by_frame(spark, solved, monkeypatch):
    """Colours met one by one, and leaves their laws; now rows of frames carry both."""
    monkeypatch.setattr(catalog_files, "solved", lambda cells: solved[0])
    rows = catalog.QUERIES["a09_trace_tables"](spark, D)
    joins = [line for line in plan_of(rows).splitlines() if "Join" in line]
    assert sum("FullOuter" in line for line in joins) == 1 and not any("idx" in line for line in joins)
    assert sum("fitted" in line for line in joins) == 0 and dict(rows.dtypes) == dict.fromkeys(("t", "colours", "differ"), "bigint")
    assert sorted(tuple(r) for r in rows.collect()) == [(t, 256, 0) for t in range(24)]


def test_colours_that_traces_lack_or_change_differ(spark, solved, monkeypatch):
    """A frame that only one side has, a colour that one side lacks, and one that differs."""
    ours = [(t, i, i, 7, t) for t in range(3) for i in range(4)]
    theirs = [(0, t, i, i, 7 + (t == 1 and i == 2), t) for t in (1, 2, 3) for i in range(4) if (t, i) != (2, 3)]
    table = spark.createDataFrame(ours, "t int, idx int, r8 int, g8 int, b8 int")
    monkeypatch.setattr(catalog_files, "solved", lambda cells: SimpleNamespace(table=table))
    monkeypatch.setattr(catalog_files, "traces", lambda cells: None)
    monkeypatch.setattr(catalog_files.trace, "parse", lambda df: None)
    monkeypatch.setattr(catalog_files.trace, "tables", lambda df: spark.createDataFrame(theirs, "capture long, i int, idx int, r8 int, g8 int, b8 int"))
    got = sorted(tuple(r) for r in catalog.QUERIES["a09_trace_tables"](spark, D).collect())
    assert got == [(0, 4, 4), (1, 4, 1), (2, 4, 1), (3, 4, 4)]
