"""The solve of captures beside the same laws in plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxlake.functions import colour
from voxlake.operators import descent, mixtures, pairtree, solve
from voxlake.operators.pairtree import COVARIANCE, LAB

BAYER = np.array(descent.BAYER)


def linear(c):
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def oklab(unit):
    lms = np.cbrt(np.array(colour.OKLAB_LMS) @ [linear(c) for c in unit])
    return np.array(colour.OKLAB_LAB) @ lms


def linear_rgb(lab):
    return np.array(colour.OKLAB_RGB_BACK) @ (np.array(colour.OKLAB_LMS_BACK) @ lab) ** 3


def to_byte(u):
    return int(min(255, max(0, round(u * 255))))


def srgb8(lab):
    return tuple(to_byte(c * 12.92 if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055) for c in np.clip(linear_rgb(lab), 0, 1))


def fits(lab):
    return all(-1e-6 <= c <= 1 + 1e-6 for c in linear_rgb(lab))


def displayed(lab):
    lab = np.array([min(1, max(0, lab[0])), lab[1], lab[2]])
    keep = 1.0
    if not fits(lab):
        keep, high = 0.0, 1.0
        for _ in range(40):
            mid = (keep + high) / 2
            keep, high = (mid, high) if fits(lab * [1, mid, mid]) else (keep, mid)
    return srgb8(lab * [1, keep, keep])


def em(xs):
    xs = np.sort(np.array(xs, float))
    half, n = len(xs) // 2, len(xs)
    if n < 2:
        return None
    f = (xs[half:].mean(), xs[:half].mean(), 0.5, max(1e-9, xs.std()))
    for _ in range(64):
        mf, mb, pb, sd = f
        r = 1 / (1 + np.exp(-(math.log(pb / (1 - pb)) + ((xs - mf) ** 2 - (xs - mb) ** 2) / (2 * sd * sd))))
        b = r.sum()
        if not 0 < b < n:
            break
        mb, mf = (r * xs).sum() / b, ((1 - r) * xs).sum() / (n - b)
        f = (mf, mb, b / n, max(1e-9, math.sqrt((r * (xs - mb) ** 2 + (1 - r) * (xs - mf) ** 2).sum() / n)))
    mf, mb, pb, sd = f
    return (mb, mf, 1 - pb, sd) if mf < mb else f


def two_phases(xs, f):
    xs = np.array(xs, float)
    norm = lambda m, s: -(((xs - m) / s) ** 2) / 2 - math.log(s) - math.log(2 * math.pi) / 2
    two = np.logaddexp(math.log(f[2]) + norm(f[1], f[3]), math.log(1 - f[2]) + norm(f[0], f[3])).sum()
    one = norm(xs.mean(), max(1e-9, xs.std())).sum()
    return bool(f[0] > f[1] and 4 * math.log(len(xs)) - 2 * two < 2 * math.log(len(xs)) - 2 * one)


def level_gain(series):
    noise = drift = 0.0
    for v in np.array(series).T if len(series) > 2 else []:
        e = np.diff(v) - np.diff(v).mean()
        if (e * e).mean() > 0:
            rho = (e[:-1] * e[1:]).sum() / (len(e) - 1) / (e * e).mean()
            noise, drift = noise + max(0, -rho), drift + max(0, 1 + 2 * min(0, rho))
    if noise == 0:
        return 1.0
    x = (drift / noise + math.sqrt((drift / noise) ** 2 + 4 * drift / noise)) / 2
    return x / (x + 1)


def smooth(series, gain):
    out = []
    for v in series:
        last = out[-1] if out else None
        out.append(last if v is None else np.array(v) if last is None else last + gain * (np.array(v) - last))
    return out


def jacobi(m):
    a, v = m.copy(), np.eye(3)
    for _ in range(50):
        p, q = max(((0, 1), (0, 2), (1, 2)), key=lambda k: (abs(a[k]), k))
        if abs(a[p, q]) < 1e-12:
            break
        th = math.pi / 4 if abs(a[p, p] - a[q, q]) < 1e-15 else 0.5 * math.atan(2 * a[p, q] / (a[p, p] - a[q, q]))
        j = np.eye(3)
        j[p, p] = j[q, q] = math.cos(th)
        j[p, q], j[q, p] = -math.sin(th), math.sin(th)
        a, v = j.T @ a @ j, v @ j
    order = sorted(range(3), key=lambda k: -a[k, k])
    dirs = []
    for k in order:
        d = v[:, k]
        lead = next((c for c in d[:2] if abs(c) > 1e-9), d[2])
        dirs.append(-d if lead < 0 else d)
    return [max(0, a[k, k]) for k in order], dirs


def tree(mean, variances, dirs):
    levels, variances = [[np.array(mean)]], list(variances)
    for _ in range(7):
        k = variances.index(max(variances))
        off = math.sqrt(variances[k]) * math.sqrt(2 / math.pi) * dirs[k]
        variances[k] *= 1 - 2 / math.pi
        levels.append([x for m in levels[-1] for x in (m - off, m + off)])
    return levels


def nearest(book, x):
    d = [((b - x) ** 2).sum() for b in book]
    return d.index(min(d)), min(d)


def plain_solve(cells, side):
    """(tables, indices, leaves) of {capture: {t: [(y, x, (r, g, b), s)]}}."""
    tables, indices, leaf_of = {}, {}, {}
    for frames in cells.values():
        ts = sorted(frames)
        depth = [s for t in ts for *_, s in frames[t]]
        whole = two_phases(depth, em(depth))
        own = [em([s for *_, s in frames[t]]) for t in ts]
        states = [[f[0], f[1], math.log(f[2] / (1 - f[2])), math.log(f[3])] for f in own]
        states = smooth(states, level_gain(states))
        raw, back, staged, share = [], [], {}, {}
        for t, z in zip(ts, states):
            mf, mb, pb, sd = z[0], z[1], 1 / (1 + math.exp(-z[2])), math.exp(z[3])
            tau = sd * sd / (mf - mb) if mf > mb else None
            cross = (mf + mb) / 2 + tau * math.log(pb / (1 - pb)) if tau else None
            lab = {(y, x): oklab([to_byte(c) / 255 for c in rgb]) for y, x, rgb, _ in frames[t]}
            for y, x, _, s in frames[t]:
                share[t, y, x] = 1 / (1 + math.exp((s - cross) / tau)) if whole and tau else 0.0
            w = {k: 1 - share[t, *k] for k in lab}
            centre = sum(w[k] * lab[k] for k in lab) / sum(w.values())
            for y, x, _, s in frames[t]:
                staged[t, y, x] = centre + (lab[y, x] - centre) / (2 - min(1, max(0, s)))
            shown = {k: oklab([b / 255 for b in srgb8(staged[t, *k])]) for k in lab}
            mean = sum(w[k] * shown[k] for k in lab) / sum(w.values())
            cov = sum(w[k] * np.outer(shown[k] - mean, shown[k] - mean) for k in lab) / sum(w.values())
            raw.append([*mean, *cov[np.triu_indices(3)]])
            if whole:
                u = {k: share[t, *k] for k in lab}
                log = {k: math.log(math.hypot(*lab[k][1:])) for k in lab}
                mass = sum(u.values())
                m = sum(u[k] * log[k] for k in lab) / mass
                hue = sum(u[k] * lab[k][1:] for k in lab)
                back.append([sum(u[k] * lab[k][0] for k in lab) / mass, m, math.sqrt(max(0, sum(u[k] * log[k] ** 2 for k in lab) / mass - m * m)), *(hue / np.hypot(*hue))])
            else:
                back.append(None)
        gain = level_gain(raw)
        raw, back = smooth(raw, gain), smooth(back, gain)
        nodes, canonical, books = {}, {}, {}
        for t, v, b in zip(ts, raw, back):
            cov = np.zeros((3, 3))
            cov[np.triu_indices(3)] = v[3:]
            levels = tree(v[:3], *jacobi(cov + np.triu(cov, 1).T))
            shown = [displayed(x) for x in levels[7]]
            book = [oklab([c / 255 for c in x]) for x in shown]
            books[t], nodes[t] = book, levels[4]
            canonical[t] = [8 * c + nearest(book[8 * c : 8 * c + 8], levels[4][c])[0] for c in range(16)]
            if b is not None:
                grounds = [np.array([x[0] + b[0] - v[0], -x[1], -x[2]]) for x in book]
            else:
                grounds = []
                for x in book:
                    c = math.hypot(x[1], x[2])
                    k = min(c, math.exp(solve.PRIOR["alpha"] + solve.PRIOR["beta"] * math.log(c))) / c if c > 0 else 0
                    grounds.append(np.array([x[0] + solve.PRIOR["light"] - v[0], x[1] * k, x[2] * k]))
            tables[t] = shown + [displayed(x) for x in reversed(grounds)]
        blocks = lambda k: defaultdict(list)
        mid, rung = blocks(2), blocks(4)
        for t, y, x in staged:
            mid[t // 2, y // 2, x // 2].append(staged[t, y, x])
            rung[t // 4, y // 4, x // 4].append(staged[t, y, x])
        mid = {k: np.mean(v, axis=0) for k, v in mid.items()}
        cost = defaultdict(lambda: [0.0, 0.0])
        for (a, b, c), m in mid.items():
            for half in range(2):
                cost[a // 2, b // 2, c // 2][half] += nearest(nodes[a // 2 * 4][8 * half : 8 * half + 8], m)[1]
        node = {}
        for (a, b, c), m in mid.items():
            half = int(cost[a // 2, b // 2, c // 2][1] < cost[a // 2, b // 2, c // 2][0])
            node[a, b, c] = (64 * half + nearest(books[a * 2][64 * half : 64 * half + 64], m)[0]) >> 3
        for (t, y, x), p in staged.items():
            n = node[t // 2, y // 2, x // 2]
            leaf = 8 * n + nearest(books[t][8 * n : 8 * n + 8], p)[0]
            leaf_of[t, y, x] = leaf, nearest(books[t], p)[0]
            pull = share[t, y, x]
            if pull < 1 / 32:
                indices[t, y, x] = leaf
            elif (BAYER[y % 4][x % 4] + 0.5) / 16 >= pull:
                indices[t, y, x] = leaf
            else:
                target = np.mean(rung[t // 4, y // 4, x // 4], axis=0)
                indices[t, y, x] = 255 - canonical[t][nearest(nodes[t], target)[0]]
    return tables, indices, leaf_of


def make(rng, kind, frames=8, side=8):
    """Rows of two captures: kind 'two' has a near face before a far wall, 'one' a single depth with noise."""
    rows = []
    for capture in range(2):
        for f in range(frames):
            t = capture * frames + f
            for y in range(side):
                for x in range(side):
                    face = (y - 4) ** 2 + (x - 3 - 0.2 * f) ** 2 < 9
                    base = (0.8, 0.5, 0.4) if face else (0.2, 0.4, 0.7)
                    r, g, b = (float(np.clip(c + rng.normal(0, 0.06), 0, 1)) for c in base)
                    s = rng.normal(0.8 if face else 0.2, 0.05) if kind == "two" else rng.normal(0.5, 0.1)
                    rows.append((capture, t, y, x, r, g, b, float(np.clip(s, 0, 1))))
    return rows


@pytest.mark.parametrize("kind", ["two", "one"])
def test_solve_equals_plain_loops(spark, kind):
    rows = make(np.random.default_rng(6), kind)
    got = solve.solve(spark.createDataFrame(rows, "capture int, t int, y int, x int, r double, g double, b double, s double"))
    assert {r.two_phase for r in got.captures.collect()} == {kind == "two"}
    cells = defaultdict(lambda: defaultdict(list))
    for c, t, y, x, r, g, b, s in rows:
        cells[c][t].append((y, x, (r, g, b), s))
    tables, indices, leaves = plain_solve(cells, 8)
    table = {(r.t, r.idx): (r.r8, r.g8, r.b8) for r in got.table.collect()}
    assert len(table) == 256 * 16
    apart = Counter(max(abs(a - b) for a, b in zip(table[t, i], tables[t][i])) for t, i in table)
    assert set(apart) <= {0, 1} and apart[1] <= 4  # halves may round either way
    found = got.cells.collect()
    assert sum(r["index"] != indices[r.t, r.y, r.x] for r in found) <= 3
    books = descent.books(got.leaves, got.nodes16, ["t"])
    best = descent.exhaustive(got.cells.select("t", "y", "x", *LAB), books, ["t"]).collect()
    assert sum(r.leaf != leaves[r.t, r.y, r.x][1] for r in best) <= 2


def test_axes_of_odd_covariances(spark):
    rng = np.random.default_rng(8)
    some = [np.zeros((3, 3)), np.diag([1.0, 2.0, 2.0]), np.full((3, 3), 0.5), np.diag([3.0, 2.0, 1.0])]
    some += [b @ b.T for b in rng.normal(size=(20, 3, 3))]
    rows = [tuple(float(m[i, j]) for i in range(3) for j in range(i, 3)) for m in some]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {', '.join(f'{c} double' for c in COVARIANCE)}")
    for r in df.withColumn("axes", pairtree.axes()).collect():
        want, dirs = jacobi(some[r.k])
        got = np.array([[a.variance, a.d0, a.d1, a.d2] for a in r.axes])
        assert np.allclose(got[:, 0], want, atol=1e-10) and np.allclose(got[:, 1:], dirs, atol=1e-8)


def test_tree_truncates_by_prefix(spark):
    frames = spark.createDataFrame([(0, 0.5, 0.0, 0.0, 0.02, 0.0, 0.0, 0.005, 0.0, 0.001)], f"t int, {', '.join(f'{c} double' for c in (*LAB, *COVARIANCE))}")
    frames = frames.withColumn("axes", pairtree.axes()).withColumn("steps", pairtree.generations())
    nodes = {(r.depth, r.node): np.array([r.ll, r.la, r.lb]) for r in pairtree.nodes(frames, ["t"]).collect()}
    assert len(nodes) == 255
    for d in range(7):  # a node is the mean of its two halves
        assert all(np.allclose((nodes[d + 1, 2 * j] + nodes[d + 1, 2 * j + 1]) / 2, nodes[d, j]) for j in range(1 << d))
    full = {r.leaf: (r.r8, r.g8, r.b8) for r in pairtree.figures(frames, ["t"]).collect()}
    cut = {r.leaf: (r.r8, r.g8, r.b8) for r in pairtree.figures(frames, ["t"], 3).collect()}
    assert len(full) == len(cut) == 128 and len(set(cut.values())) <= 8
    assert all(cut[j] == displayed(nodes[3, j >> 4]) for j in cut)


def test_mixtures_of_odd_groups(spark):
    rows = [("one", 0.5)] + [("same", 0.25)] * 9 + [("two", v) for v in (0.1, 0.9)] + [("null", None), ("nan", float("nan")), ("nan", 0.3), ("nan", 0.6)]
    fits = {r.k: r for r in mixtures.verdict(mixtures.fit(mixtures.counted(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]))).withColumn("flat", mixtures.degenerate()).collect()}
    assert set(fits) == {"one", "same", "two", "nan"} and fits["one"].fit is None
    assert fits["one"].flat and fits["same"].flat and not fits["same"].two_phase
    assert fits["two"].fit.mf > fits["two"].fit.mb
    assert mixtures.fit(mixtures.counted(spark.createDataFrame([], "k string, v double"), "v", ["k"])).count() == 0
