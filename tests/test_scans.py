"""Ordered scans, exchange sweeps and transport beside plain loops."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import lattice
from voxlake.operators import scans, sweep, transport
from voxlake.operators.pairtree import LAB

CENTRES = (0.125, 0.375, 0.625, 0.875)


def frame_rows(rng, frames, side, drop=()):
    return [(t, y, x, *map(float, rng.random(4))) for t in range(frames) for y in range(side) for x in range(side) if (t, y, x) not in drop]


def plain_diffusion(rows, side, most, nearest):
    out = {}
    for t in {r[0] for r in rows}:
        at = {(y, x): v for f, y, x, *v in rows if f == t}
        error = {k: np.zeros(3) for k in at}
        for y in range(side):
            for x in range(side):
                if (y, x) not in at:
                    continue
                e = error[y, x]
                want = np.array(at[y, x][:3]) + (e if most is None else np.clip(e, -most, most))
                level = [min(3, max(0, int(np.floor(w * 4 if nearest else w * 3 + 0.5)))) for w in want]
                out[t, y, x] = tuple(level)
                rest = (want - [CENTRES[v] for v in level]) * (1 - 0.7 * at[y, x][3])
                for k, share in (((y, x + 1), 7), ((y + 1, x - 1), 3), ((y + 1, x), 5), ((y + 1, x + 1), 1)):
                    if k in error:
                        error[k] = error[k] + rest * share / 16
    return out


@pytest.mark.parametrize("most,nearest", [(0.2, False), (None, True)])
def test_diffusion_equals_plain_loops(spark, most, nearest):
    rows = frame_rows(np.random.default_rng(1), 5, 8, drop={(4, 6, 7), (4, 7, 0), (4, 7, 1)})
    df = spark.createDataFrame(rows, "t int, y int, x int, r double, g double, b double, s double")
    got = {(r.t, r.y, r.x): (r.a, r.b, r.c) for r in scans.diffuse(df, 8, most, nearest, at_once=2).collect()}
    assert got == plain_diffusion(rows, 8, most, nearest)
    assert scans.diffuse(df.where("t < 0"), 8).count() == 0


def test_epochs_follow_quotas_and_depth(spark):
    rng = np.random.default_rng(2)
    rows = [(t, y, x, float(rng.integers(0, 4)) / 3, int(rng.integers(0, 3))) for t in range(16) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(rows, "t int, y int, x int, s double, code int")
    got = {(r.t, r.y, r.x): r.epoch for r in scans.thread_epochs(df, 16, ["code"]).collect()}
    chances = spark.createDataFrame([(t, n / 108) for t in range(16) for n in range(109)], "t int, s double")
    for t in range(16):
        for code in range(3):
            own = sorted(((-s, y, x) for f, y, x, s, c in rows if f == t and c == code))
            mean = -sum(o[0] for o in own) / len(own)
            p = chances.where(f"t = {t}").limit(1).select(*[c.alias(f"p{k}") for k, c in enumerate(lattice.epoch_probabilities(F.col("t"), F.lit(mean), 16))]).first()
            exact = [len(own) * v for v in p]
            quota = [int(v) for v in exact]
            for k in sorted(range(4), key=lambda k: (-round(exact[k] - quota[k], 9), k))[: len(own) - sum(quota)]:
                quota[k] += 1
            want = [e for e in sorted(range(4), key=lambda e: (-quota[e], e)) for _ in range(quota[e])]
            assert [got[t, y, x] for _, y, x in own] == want


def plain_epochs(rows, side):
    """(t, y, x, code, epoch) of rows(t, y, x, s, code), sorted; -1 where no target reaches."""
    groups = {}
    for t, y, x, s, code in rows:
        groups.setdefault((t, code), []).append((s is None, s is None or -s if s == s else -np.inf, y, x))
    out = []
    for (t, code), own in groups.items():
        known = [np.nan if v == -np.inf else -v for empty, v, _, _ in own if not empty]
        quota = {}
        if t is not None and known:
            mean, n = sum(known) / len(known), len(own)
            raw = [np.exp(-((t % side - c * (side - 1) / 8) ** 2) / (2 * ((2 - mean) * (side - 1) / 8) ** 2)) for c in (1, 3, 5, 7)]
            exact = [n * v / sum(raw) for v in raw]
            base = [0 if v != v else int(v) for v in exact]
            rest = [0 if v != v else round(v - b, 9) for v, b in zip(exact, base)]
            more = sorted(range(4), key=lambda e: (-rest[e], e))[: n - sum(base)]
            quota = {e: base[e] + (e in more) for e in range(4)}
        served = [e for e in sorted(quota, key=lambda e: (-quota[e], e)) for _ in range(quota[e])]
        for k, (_, _, y, x) in enumerate(sorted(own)):
            out.append((t, y, x, code, served[k] if k < len(served) else -1))
    return sorted(out, key=str)


@pytest.mark.parametrize("tasks", [None, 3])
def test_epochs_of_odd_cells(spark, tasks):
    """Depths that are null or NaN, null frames and codes, cells that come twice, groups of one cell, and no cell at all."""
    rng = np.random.default_rng(8)
    rows = [(t, y, x, float(rng.random()), int(rng.integers(0, 4))) for t in (0, 3, 17) for y in range(7) for x in range(7)]
    rows += [(3, 9, x, None, int(rng.integers(0, 4))) for x in range(5)] + rows[:30]
    rows += [(5, 0, x, None, 1) for x in range(6)] + [(6, 0, x, float("nan") if x % 2 else 0.3, 1) for x in range(7)] + [(7, 0, 0, float("nan"), 2), (7, 0, 1, None, 2)]
    rows += [(None, 0, x, 0.4, 1) for x in range(5)] + [(8, 0, x, 0.1 * x, None) for x in range(9)] + [(t, 0, 0, 0.7, 3) for t in range(9, 16)]
    df = spark.createDataFrame(rows, "t int, y int, x int, s double, code int")
    got = scans.thread_epochs(df, 16, ["code"], tasks=tasks)
    assert got.columns == ["t", "y", "x", "s", "code", "epoch"]
    assert sorted(((r.t, r.y, r.x, r.code, r.epoch) for r in got.collect()), key=str) == plain_epochs(rows, 16)
    assert scans.thread_epochs(df.where("y < 0"), 16, ["code"], tasks=tasks).count() == 0


def test_epochs_take_one_sort_and_no_array(spark):
    """Cells were sorted twice, and targets were arrays that interpreted functions made, sorted and folded for every cell."""
    df = spark.createDataFrame([(0, 0, 0, 0.5, 1)], "t int, y int, x int, s double, code int")
    plan = scans.thread_epochs(df, 16, ["code"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1
    assert "lambda" not in plan and "array" not in plan


def test_greedy_bins_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    groups = {k: [rng.integers(0, 5, 14).tolist() for _ in range(n)] for k, n in enumerate((1, 7, 300))}
    groups[3] = [[0] * 14] * 4
    df = spark.createDataFrame([(k, [(i, h) for i, h in enumerate(hs)]) for k, hs in groups.items()], "k int, hists array<struct<place:int,hist:array<int>>>")
    got = {(r.k, r.place): r.bin for r in scans.greedy_bins(df, ["k"]).collect()}
    for k, hists in groups.items():
        left = scans.scaled_target(len(hists))
        assert sum(left) == len(hists)
        for i, h in enumerate(hists):
            scores = [(a * b, j) for j, (a, b) in enumerate(zip(h, left))]
            best = max(scores)[1] if max(scores)[0] > 0 else max(zip(h, range(14)))[1]
            assert got[k, i] == best
            left[best] = max(0, left[best] - 1)


def test_carries_of_odd_lines(spark):
    lines = [[], [1.4], [0.5, 1.5, 2.5, 3.5], [3.9, 3.9, -2.0], [float(v) for v in np.random.default_rng(4).uniform(0, 3, 40)]]
    df = spark.createDataFrame([(v,) for v in lines], "v array<double>")
    rows = df.select("v", scans.carried(F.col("v"), 0.7, True).alias("one"), scans.both_ways(F.col("v"), 2).alias("two"), scans.both_ways(F.col("v"), 0).alias("none")).collect()
    clamp = lambda v: min(3, max(0, round(v)))

    def plain(values, share, after):
        e, out = 0.0, []
        for v in values:
            want = v + (e if after else e * share)
            out.append(clamp(want))
            e = (want - out[-1]) * (share if after else 1)
        return out

    for r in rows:
        assert r.one == plain(r.v, 0.7, True) and r.none == [clamp(v) for v in r.v]
        assert r.two == plain(r.v[::-1], 0.5, False)[::-1]


def plain_sweep(q, y, cand, k):
    place = lambda v: (v % 4 // 2, v // 4 % 4 // 2, v // 16 // 2)
    q = list(q)
    for _ in range(k):
        for v in range(64):
            e = cand[q] - y
            g = e[v] + e[[w for w in range(64) if place(w) == place(v)]].sum(0) / 8 + e.sum(0) / 64
            best, at = 0.0, q[v]
            for c in range(len(cand)):
                d = cand[c] - cand[q[v]]
                change = 2 * (g @ d) + (1 + 1 / 8 + 1 / 64) * (d @ d)
                if change < best:
                    best, at = change, c
            q[v] = at
    return q


def test_sweeps_equal_plain_loops_and_descend(spark):
    rng = np.random.default_rng(5)
    blocks, rows, books = 6, [], []
    for t in range(4):
        books.append((t, [tuple(map(float, c)) for c in rng.normal(0, 0.1, (256, 3))]))
    codes = {}
    for b in range(blocks):
        pool = rng.integers(0, 256, (1, 2, 8, 8, 12, 20)[b])
        for v in range(64):
            code = int(rng.choice(pool))
            x, y, t = v % 4 + 4 * b, v // 4 % 4, v // 16
            codes[t, y, x] = code
            rows.append((t, y, x, code, b % 2 == 0, *map(float, rng.normal(0, 0.1, 3))))
    rows.append((0, 0, 99, 1, True, 0.0, 0.0, 0.0))  # not a whole block
    schema = f"t int, y int, x int, code int, far boolean, {', '.join(f'{c} double' for c in LAB)}"
    packed = sweep.most_used(sweep.blocks(spark.createDataFrame(rows, schema), "code"))
    book = spark.createDataFrame(books, f"t int, colours array<struct<{','.join(f'{c}:double' for c in LAB)}>>")
    shown = {r.bx: r.codes for r in packed.select("bx", "codes").collect()}
    shades = np.array(books[0][1])
    for k in (0, 1, 4):
        found = sweep.refine(packed, book, k)
        assert found.count() == blocks
        got = {(r.t, r.y, r.x): r.code for r in sweep.placed(found).collect()}
        for r in found.collect():
            assert r.after <= r.before + 1e-12 and (k or r.after == r.before)
            at = [(v // 16, v // 4 % 4, v % 4 + 4 * r.bx) for v in range(64)]
            used = [codes[a] for a in at]
            top = sorted(set(used), key=lambda c: (-used.count(c), c))[:8]
            assert shown[r.bx] == [top[i % len(top)] for i in range(8)]
            y = np.array([next(row[5:] for row in rows if row[:3] == a) for a in at])
            start = [shown[r.bx].index(c) if c in shown[r.bx] else 0 for c in used]
            want = plain_sweep(start, y - y.mean(0), shades[shown[r.bx]] - y.mean(0), k)
            assert [got[a] for a in at] == [shown[r.bx][i] for i in want]


def test_plans_of_transport(spark):
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (2, 5), (5, 2), (4, 4), (6, 6), (3, 7)):
        for _ in range(10):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            wide = cost if n <= m else cost.T
            least = min(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), len(wide)))
            plan = {name: f(cost) for name, f in transport.PLANS.items()}
            for to in plan.values():
                used = [j for j in to if j >= 0]
                assert len(used) == len(set(used)) == min(n, m)
            assert sum(cost[i, j] for i, j in enumerate(plan["cheapest"]) if j >= 0) == least
            left, want = list(range(m)), []
            for i in range(min(n, m)):
                j = min(left, key=lambda j: (cost[i, j], j))
                left.remove(j)
                want.append(j)
            assert plan["greedy"][: len(want)].tolist() == want
    places = [(c, t, y, x) for c in range(2) for t in range(5) for y in range(4) for x in range(4) if rng.random() < 0.5]
    df = spark.createDataFrame(places, "c int, t int, y int, x int")
    rows = transport.plans(transport.paired(df, "c", 4), "c").collect()
    assert {r.t for r in rows} == {0, 1, 2} and len(rows) == 18  # no pair across captures
    for r in rows:
        assert r.matches == len(r.y) and abs(r.cost - sum(np.hypot(a - v, b - u) for a, b, v, u in zip(r.y, r.x, r.v, r.u))) < 1e-9
    cost = {(r.c, r.t, r.plan): r.cost for r in rows}
    assert all(cost[c, t, "cheapest"] <= v + 1e-9 for (c, t, _), v in cost.items())


def test_plans_of_many_pairs_are_made_together(spark):
    """Plans were made pair by pair; now those of one shape at once, with the same columns."""
    rng = np.random.default_rng(8)
    for n, m in ((1, 4), (4, 1), (5, 5), (7, 3)):
        cost = rng.integers(0, 6, (50, n, m)).astype(float)
        for name, one in transport.PLANS.items():
            assert (transport._AT_ONCE[name](cost) == np.array([one(c) for c in cost])).all()
    df = spark.createDataFrame([(c, t, y, x) for c in range(3) for t in range(8) for y in range(4) for x in range(4) if rng.random() < 0.4], "c int, t int, y int, x int")
    pairs = transport.paired(df, "c", 8)
    want = {(r.c, r.t, r.plan): (r.matches, r.cost) for r in transport.plans(pairs, "c").collect()}
    got = transport.costs(pairs, "c", ["greedy", "reduced", "cheapest"]).collect()
    assert len(want) == 3 * len(got)
    for r in got:
        for name in transport.PLANS:
            assert r.matches == want[r.c, r.t, name][0] and abs(r[name] - want[r.c, r.t, name][1]) < 1e-9


def test_connected_groups_of_odd_frames(spark):
    from voxlake.operators import groups

    rng = np.random.default_rng(7)
    spiral = np.zeros((9, 9), int)
    spiral[1, :8], spiral[1:8, 7], spiral[7, 1:8], spiral[3:8, 1], spiral[3, 1:6], spiral[3:6, 5] = 1, 1, 1, 1, 1, 1
    frames = {0: spiral, 1: rng.integers(0, 2, (9, 9)), 2: rng.integers(0, 5, (9, 9)), 3: np.full((9, 9), 4)}
    rows = [(t, y, x, int(f[y, x])) for t, f in frames.items() for y in range(9) for x in range(9) if (t, x) != (3, 4)] + [(5, 0, 0, None)]
    got = {(r.t, r.y, r.x): r.label for r in groups.connected(spark.createDataFrame(rows, "t int, y int, x int, c int"), "c", 9, at_once=2).collect()}
    colour = {r[:3]: r[3] for r in rows if r[3] is not None}
    seen = set()
    for start in sorted(colour):
        if start in seen:
            continue
        found, edge = {start}, [start]
        while edge:
            t, y, x = edge.pop()
            for k in ((t, y + 1, x), (t, y - 1, x), (t, y, x + 1), (t, y, x - 1)):
                if k not in found and colour.get(k) == colour[start]:
                    found.add(k)
                    edge.append(k)
        seen |= found
        assert {got[k] for k in found} == {start[1] * 9 + start[2]}
    assert set(got) == set(colour)
