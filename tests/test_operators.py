"""Known values and invariants of the cube operators."""

import math

import pytest
from pyspark.sql import functions as F

from voxlake.operators import bonds, codebook, energy, fits, pool

SIDE = 64


def draws(seed):
    while True:
        seed = (1103515245 * seed + 12345) % (1 << 31)
        yield seed / (1 << 31)


def frame(spark, values):
    return spark.createDataFrame([(0, p // SIDE, p % SIDE, v, int(v >= 128)) for p, v in enumerate(values)], "t int, y int, x int, idx int, spin int")


def random_frame(seed, top=256):
    u = draws(seed)
    return [int(next(u) * top) for _ in range(SIDE * SIDE)]


# Energies of known frames, to 1e-6.
KNOWN = {
    "balanced": ([p % 256 for p in range(SIDE * SIDE)], 0.0, 0.0, 1984, 1573.0622753563964, 256),
    "random": (random_frame(3), 194.9430941564881, 188.67024698034948, 4005, 0.2608463653809565, 256),
    "face": (random_frame(7, 128), 4182.212238948516, 3817.7129259476787, 0, 8064.0, 128),
    "solid": ([255] * SIDE * SIDE, 32768.0, 31922.010929645316, 0, 8064.0, 1),
}


@pytest.mark.parametrize("name", KNOWN)
def test_known_frames(spark, name):
    values, e, exact, walls, wall_e, used = KNOWN[name]
    f = frame(spark, values)
    h = energy.histogram(f, ["t"]).cache()
    m = energy.measures(h, ["t"]).first()
    assert m.energy == pytest.approx(e, abs=1e-6) and m.used == used
    ground = sum(math.log2(k) for k in range(2, 4097)) - 256 * sum(math.log2(k) for k in range(2, 17))
    assert ground - energy.multinomial_bits(h, ["t"]).first().bits == pytest.approx(exact, abs=1e-5)
    levels = energy.level_energies(h, ["t"]).agg(F.sum("energy")).first()[0]
    assert levels == pytest.approx(e, abs=1e-6)  # the levels add up to the whole
    w = bonds.plane_walls(f, "spin").select("walls", energy.wall_bits(F.col("walls"), F.lit(8064)).alias("e")).first()
    assert w.walls == walls and w.e == pytest.approx(wall_e, abs=1e-6)


def small(spark, side=8):
    u = draws(5)
    return spark.createDataFrame([(t, y, x, int(next(u) * 256), next(u)) for t in range(side) for y in range(side) for x in range(side)], "t int, y int, x int, idx int, s double")


def test_pooling_keeps_mass_and_undoes_lifting(spark):
    c = small(spark).cache()
    assert pool.pool_sums(c, ["idx"]).agg(F.sum("idx")).first()[0] == c.agg(F.sum("idx")).first()[0]
    p = pool.pool(c, ["s"])
    assert p.agg(F.avg("s")).first()[0] == pytest.approx(c.agg(F.avg("s")).first()[0])
    again = {(r.t, r.y, r.x): r.s for r in pool.pool(pool.lift(p), ["s"]).collect()}
    assert again == pytest.approx({(r.t, r.y, r.x): r.s for r in p.collect()})
    assert pool.lift(p).count() == c.count()


def test_interior_and_wall_bonds_make_the_whole(spark):
    c = small(spark).cache()
    whole = bonds.energy(c, "idx", bonds.SPREAD).agg(F.sum("bonds"), F.sum("energy")).first()
    parts = bonds.split_by_tile(c, "idx", 4, bonds.SPREAD).agg(F.sum("bonds"), F.sum("energy")).first()
    assert tuple(whole) == tuple(parts) and whole[0] == 3 * 8 * 8 * 7
    turned = c.withColumn("t", (F.col("t") + 3) % 8)
    assert bonds.cyclic_walls(c, "idx", 8).first() == bonds.cyclic_walls(turned, "idx", 8).first()


def test_planted_mixture(spark):
    steps = [(k - 4) * 0.06 / math.sqrt(2) for k in range(9) for _ in range(math.comb(8, k))]
    wall, face = [(0.05 + d,) for d in steps * 12], [(0.75 + d,) for d in steps * 4]
    fit = fits.mixture(spark.createDataFrame(wall + face, "s double"), "s").first()
    assert fit.mf == pytest.approx(0.75, abs=1e-3) and fit.mb == pytest.approx(0.05, abs=1e-3) and fit.pb == pytest.approx(0.75, abs=1e-3)
    assert fits.mixture(spark.createDataFrame([], "s double"), "s").count() == 0


def test_mixture_splits_at_the_median_by_ranges(spark, monkeypatch):
    """The same first split as by sorting everything, with no window over all values, which one task would read."""

    def one_task(*_):
        raise AssertionError("a window without a partition")

    monkeypatch.setattr(fits.Window, "orderBy", one_task)
    values = [round(next(d), 2) for d in [draws(7)] for _ in range(401)] + [0.5] * 60
    for some in (values, values[:1], values[:2], [0.25] * 5):
        n, s = len(some), sorted(some)
        fit = fits.mixture(spark.createDataFrame([(v,) for v in some], "s double").repartition(3), "s", steps=0).first()
        assert fit.mb == pytest.approx(sum(s[: n // 2]) / max(1, n // 2)) and fit.mf == pytest.approx(sum(s[n // 2 :]) / (n - n // 2))


def test_quotas_and_fronts(spark):
    rows = spark.createDataFrame([(g, e, w) for g in (1, 2) for e, w in enumerate((0.4, 0.3, 0.2, 0.1 * g))], "g int, e int, w double")
    q = codebook.largest_remainder(rows, ["g"], "e", "w", F.lit(17)).groupBy("g").agg(F.sum("quota").alias("n")).collect()
    assert [r.n for r in q] == [17, 17]
    points = [(i, i * 7 % 10, i * 3 % 11, i * 5 % 13) for i in range(40)] + [(40, 7, 3, 5)]
    df = spark.createDataFrame(points, "k int, a int, b int, c int")
    for senses in ({"a": True, "b": False}, {"a": True, "b": True, "c": False}):
        up = {k: [v if more else -v for v, more in zip(vals, senses.values())] for k, *vals in [(p[0], *[p["kabc".index(c)] for c in senses]) for p in points]}
        want = {k for k, v in up.items() if not any(all(x >= y for x, y in zip(o, v)) and o != v for o in up.values())}
        assert {r.k for r in codebook.pareto(df, "k", senses).collect()} == want
