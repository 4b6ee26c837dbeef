"""The library's operators as queries over the test tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions import colour, lattice
from voxlake.operators import bonds, codebook, energy, fits, pool, ranks

from .cube import CUBE_SQL, SIDE, capture, cube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, on_cube: bool = True):
    """Register a query under its function's name; on_cube: it takes the cube, and its SQL may use the table cube."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(cube(spark, sf_dir)) if on_cube else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {CUBE_SQL}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}" if on_cube else sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def unit(*names: str) -> tuple:
    return tuple(F.col(n) for n in names)


def rgb() -> tuple:
    return unit("r", "g", "b")


def rgb8() -> tuple:
    return tuple(colour.to_byte(c) for c in rgb())


B8 = "least(255, greatest(0, CAST(round_even({c} * 255.0::DOUBLE, 0) AS INT)))"
LIN = "(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def _m(matrix, names) -> list[str]:
    return [" + ".join(f"{v!r}::DOUBLE * {n}" for v, n in zip(row, names)) for row in matrix]


_lms = _m(colour.OKLAB_LMS, [LIN.format(c=c) for c in "rgb"])
_lab = _m(colour.OKLAB_LAB, ["l3", "m3", "s3"])
LAB_SQL = f"""lms AS (SELECT *, cbrt({_lms[0]}) AS l3, cbrt({_lms[1]}) AS m3, cbrt({_lms[2]}) AS s3 FROM cube),
lab AS (SELECT *, {_lab[0]} AS ll, {_lab[1]} AS la, {_lab[2]} AS lb FROM lms)"""


# Scans and sources


@query("SELECT t, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(s, 6) AS s, idx FROM cube")
def a01_cube_scan(cells):
    return rounded(cells.select("t", "y", "x", "r", "g", "b", "s", "idx"))


@query("SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WHERE n <= 64", on_cube=False)
def a03_bounded_buffer(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").limit(64).select("event_id", "ts")


_FEED = "((1103515245 * ({side} * 7919 + v * 31 + {k}) + 12345) % 2147483648) % 256 / 256.0"


@query(
    "SELECT side, v, " + ", ".join(f"CAST({_FEED.format(side='side', k=k)} AS DOUBLE) AS {c}" for k, c in enumerate("rgbd", 1)) + " FROM (SELECT 16 AS side, range AS v FROM range(4096))",
    on_cube=False,
)
def a10_synthetic_feed(spark, sf_dir):
    s = F.lit(16 * 7919) + F.col("v") * 31
    return spark.range(4096).select(F.lit(16).alias("side"), F.col("id").alias("v")).select("side", "v", *[((lattice.lcg(s + k) % 256) / 256).alias(c) for k, c in enumerate("rgbd", 1)])


@query("SELECT c.t, c.y, c.x, coalesce(h.s, 0.5) AS s FROM cube c LEFT JOIN (SELECT * FROM cube WHERE idx % 3 = 0) h USING (t, y, x)")
def a12_cube_feed_fill(cells):
    have = cells.where("idx % 3 = 0").select("t", "y", "x", "s")
    return cells.select("t", "y", "x").join(have, ["t", "y", "x"], "left").withColumn("s", F.coalesce("s", F.lit(0.5)))


# Sinks: index planes


@query("SELECT t, y * 2 + dy AS y, x * 2 + dx AS x, idx FROM cube, (SELECT range AS dy FROM range(2)), (SELECT range AS dx FROM range(2))")
def b05_index_upscale(cells):
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("dy"), F.lit(j).cast("long").alias("dx")) for i in (0, 1) for j in (0, 1)])
    return cells.select("t", "y", "x", "idx", F.explode(steps).alias("d")).select("t", (F.col("y") * 2 + F.col("d.dy")).alias("y"), (F.col("x") * 2 + F.col("d.dx")).alias("x"), "idx")


@query("SELECT t, y // 4 AS y, x // 4 AS x, idx FROM cube WHERE y % 4 = 0 AND x % 4 = 0")
def b06_index_decimate(cells):
    return cells.where("y % 4 = 0 and x % 4 = 0").select("t", F.expr("cast(y div 4 as int)").alias("y"), F.expr("cast(x div 4 as int)").alias("x"), "idx")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 9", on_cube=False)
def b09_newest_nine(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(9).select("o_orderkey")


# Colour


@query(f"SELECT t, y, x, {', '.join(f'round({LIN.format(c=c)}, 6) AS {c}' for c in 'rgb')} FROM cube")
def c01_srgb_to_linear(cells):
    return rounded(cells.select("t", "y", "x", *[colour.srgb_to_linear(F.col(c)).alias(c) for c in "rgb"]))


@query(f"+ {LAB_SQL} SELECT t, y, x, round(ll, 6) AS l, round(la, 6) AS a, round(lb, 6) AS b FROM lab")
def c04_oklab(cells):
    return rounded(cells.select("t", "y", "x", *[v.alias(n) for v, n in zip(colour.oklab(rgb()), "lab")]))


@query(f"SELECT t, y, x, {', '.join(f'{B8.format(c=c)} AS {c}' for c in 'rgb')} FROM cube")
def c28_float_to_byte(cells):
    return cells.select("t", "y", "x", *[v.alias(n) for v, n in zip(rgb8(), "rgb")])


_back = _m(colour.OKLAB_LMS_BACK, ("ll", "la", "lb"))
_rgb = _m(colour.OKLAB_RGB_BACK, [f"pow({e}, 3)" for e in _back])
# Colours pushed outwards from grey, so that some leave the gamut.
WIDE_SQL = LAB_SQL + ", wide AS (SELECT t, y, x, ll, la * 1.3::DOUBLE AS la, lb * 1.3::DOUBLE AS lb FROM lab), lin AS (SELECT t, y, x, " + ", ".join(f"{e} AS {n}" for e, n in zip(_rgb, "rgb")) + " FROM wide)"


def wide(cells):
    light, a, b = colour.oklab(rgb())
    return cells.select("t", "y", "x", light.alias("l"), (a * 1.3).alias("a"), (b * 1.3).alias("b"))


@query(f"+ {WIDE_SQL} SELECT t, sum((r BETWEEN -1e-6 AND 1 + 1e-6 AND g BETWEEN -1e-6 AND 1 + 1e-6 AND b BETWEEN -1e-6 AND 1 + 1e-6)::INT)::BIGINT AS inside FROM lin GROUP BY t")
def c06_gamut(cells):
    return wide(cells).groupBy("t").agg(F.count_if(colour.in_gamut(unit(*"lab"))).alias("inside"))


_gamma = "(CASE WHEN {c} <= 0.0031308 THEN 12.92::DOUBLE * {c} ELSE 1.055::DOUBLE * pow({c}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)"


@query(f"+ {WIDE_SQL}, cut AS (SELECT t, y, x, {', '.join(f'least(1, greatest(0, {c})) AS {c}' for c in 'rgb')} FROM lin) SELECT t, y, x, {', '.join(f'{B8.format(c=_gamma.format(c=c))} AS {c}' for c in 'rgb')} FROM cut")
def c07_oklab_to_srgb8(cells):
    return wide(cells).select("t", "y", "x", *[v.alias(n) for v, n in zip(colour.srgb8(unit(*"lab")), "rgb")])


_xyz = _m(colour.XYZ, [LIN.format(c=f"{c}") for c in ("br", "bg", "bb")])
_f = lambda e, w: f"(CASE WHEN ({e}) / {w}::DOUBLE > pow(6.0::DOUBLE / 29, 3) THEN cbrt(({e}) / {w}::DOUBLE) ELSE ({e}) / {w}::DOUBLE / (3 * pow(6.0::DOUBLE / 29, 2)) + 4.0::DOUBLE / 29 END)"
CIE_SQL = f"""bytes AS (SELECT t, y, x, idx, {', '.join(f'{B8.format(c=c)} / 255.0::DOUBLE AS b{c}' for c in 'rgb')} FROM cube),
f AS (SELECT *, {', '.join(f'{_f(e, w)} AS f{n}' for e, w, n in zip(_xyz, colour.WHITE, 'xyz'))} FROM bytes),
cie AS (SELECT t, y, x, idx, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f)"""


@query(f"+ {CIE_SQL} SELECT t, y, x, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM cie")
def c19_cielab(cells):
    return rounded(cells.select("t", "y", "x", *[v.alias(n) for v, n in zip(colour.cielab(rgb8()), "lab")]))


_hue = """(0.5 + 0.5 * tanh(-2 + 0.5 * sqrt({p}a * {p}a + {p}b * {p}b))) * (-0.08 - 0.14 * sin(radians({p}h + 50)) - 0.07 * sin(radians(2 * {p}h + 90))
  + (0.22 * {p}l - 12.8) / 10 * exp((90 - {p}h) / 10 - exp((90 - {p}h) / 10)))"""


@query(f"""+ {CIE_SQL}, pairs AS (SELECT p.t, p.y, p.x, p.l::DOUBLE AS pl, p.a AS pa, p.b AS pb, q.l AS ql, q.a AS qa, q.b AS qb FROM cie p JOIN cie q ON p.t = q.t AND p.y = q.y AND p.x + 1 = q.x),
hues AS (SELECT *, (CASE WHEN atan2(pb, pa) < 0 THEN degrees(atan2(pb, pa)) + 360 ELSE degrees(atan2(pb, pa)) END) AS ph,
  (CASE WHEN atan2(qb, qa) < 0 THEN degrees(atan2(qb, qa)) + 360 ELSE degrees(atan2(qb, qa)) END) AS qh,
  sqrt(pa * pa + pb * pb) - sqrt(qa * qa + qb * qb) AS dc FROM pairs)
SELECT t, round(avg(0.04 + 0.53 * tanh(0.8 - 0.045 * sqrt(greatest(0, pow(pa - qa, 2) + pow(pb - qb, 2) - dc * dc) + pow(dc / 1.46, 2)))
  + 0.28 + 0.54 * tanh(-3.88 + 0.029 * (pl + ql)) + 0.14 + 0.15 * tanh(-2 + 0.2 * abs(pl - ql)) + {_hue.format(p='p')} + {_hue.format(p='q')}), 5) AS harmony FROM hues GROUP BY t""")
def c20_neighbour_harmony(cells):
    lab = cells.select("t", "y", "x", F.struct(*[v.alias(n) for v, n in zip(colour.cielab(rgb8()), "lab")]).alias("c"))
    pairs = bonds.bonds(lab, "c", ("x",))
    return rounded(pairs.groupBy("t").agg(F.avg(colour.harmony(unit("p.l", "p.a", "p.b"), unit("q.l", "q.a", "q.b"))).alias("harmony")), 5)


@query("SELECT t, y, x, least(15, CAST(floor(16 * (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)) AS INT)) AS stratum FROM cube")
def c24_luma_stratum(cells):
    return cells.select("t", "y", "x", F.least(F.lit(15), F.floor(colour.luma(rgb()) * 16).cast("int")).alias("stratum"))


@query("SELECT t, y, x, round(1 / (2 - least(1, greatest(0, s))), 6) AS gain FROM cube")
def c25_aerial_gain(cells):
    return rounded(cells.select("t", "y", "x", (1 / (2 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s"))))).alias("gain")))


# Lattice and bits


@query("SELECT t, y, x, idx // 64 AS d, (idx // 16) % 4 AS a, (idx // 4) % 4 AS b, idx % 4 AS c FROM cube")
def c204_index_to_coordinate(cells):
    return cells.select("t", "y", "x", *lattice.split_index(F.col("idx")))


_p = "exp(-pow(t % side - {k} * (side - 1) / 8.0::DOUBLE, 2) / (2 * pow((side - 1) / 8.0::DOUBLE * (2 - s), 2)))"


@query(f"+ p AS (SELECT t, y, x, {', '.join(f'{_p.format(k=k)} AS p{i}' for i, k in enumerate((1, 3, 5, 7)))} FROM cube) SELECT t, y, x, {', '.join(f'round(p{i} / greatest(p0 + p1 + p2 + p3, 1e-10), 6) AS p{i}' for i in range(4))} FROM p")
def c211_epoch_probabilities(cells):
    p = lattice.epoch_probabilities(F.col("t") % F.col("side"), F.col("s"), SIDE)
    return rounded(cells.select("t", "y", "x", *[v.alias(f"p{i}") for i, v in enumerate(p)]))


@query("SELECT event_id, round(CASE WHEN value <= 0 THEN 0.5 ELSE least(1, greatest(0, (1 / value - 1 / 1.5::DOUBLE) / (4 - 1 / 1.5::DOUBLE))) END, 6) AS signal FROM events", on_cube=False)
def c214_metres_to_signal(spark, sf_dir):
    return rounded(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", lattice.metres_to_signal(F.col("value")).alias("signal")))


@query("SELECT rung, count(*) AS n FROM (SELECT CASE WHEN s < 0.03125 OR s > 0.96875 THEN 64 WHEN s < 0.09375 OR s > 0.90625 THEN 32 ELSE 16 END AS rung FROM cube) GROUP BY rung")
def f60_resolution_budget(cells):
    return cells.groupBy(lattice.rung(F.col("s")).alias("rung")).agg(F.count("*").alias("n"))


# Joins


_book = ", ".join(f"({i}, {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)" for i, r, g, b in codebook.lattice_book())


@query(f"+ book(i, cr, cg, cb) AS (VALUES {_book}), d AS (SELECT t, y, x, i, pow(r - cr, 2) + pow(g - cg, 2) + pow(b - cb, 2) AS d FROM cube, book) SELECT t, y, x, i AS code, round(d, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY t, y, x ORDER BY d, i) AS n FROM d) WHERE n = 1")
def e01_nearest_codeword(cells):
    near = codebook.nearest(codebook.lattice_book(), *rgb())
    return rounded(cells.select("t", "y", "x", near.alias("n")).select("t", "y", "x", F.col("n.i").alias("code"), F.col("n.d").alias("d2")))


@query("""WITH store AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, (p_retailprice - 900) / 100 AS b FROM part), d AS (
SELECT q.p_partkey AS probe, s.p_partkey, pow(s.a - q.a, 2) + pow(s.b - q.b, 2) AS d2 FROM store s, (SELECT * FROM store WHERE p_partkey % 100 = 0) q)
SELECT probe, p_partkey, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d2, p_partkey) AS rank FROM d) WHERE rank <= 5""", on_cube=False)
def e06_exact_retrieval(spark, sf_dir):
    store = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") / 50).alias("a"), ((F.col("p_retailprice") - 900) / 100).alias("b"))
    probes = store.where("p_partkey % 100 = 0").withColumnRenamed("p_partkey", "probe")
    return rounded(codebook.k_nearest(store, probes, ["a", "b"], "p_partkey", 5))


_err = ", ".join(f"((idx // {k}) % 4 + 0.5) / 4 - {c} AS e{c}" for k, c in ((16, "r"), (4, "g"), (1, "b")))
ERR_SQL = f"err AS (SELECT t, y, x, side, idx, {_err} FROM cube)"


def shown_errors(cells):
    """What the lattice shows less the truth, per channel."""
    return cells.select("t", "y", "x", "idx", *[((F.expr(f"idx div {k}") % 4 + 0.5) / 4 - F.col(c)).alias(f"e{c}") for k, c in ((16, "r"), (4, "g"), (1, "b"))])


@query(f"+ {ERR_SQL} SELECT t, round(sum(er * er), 5) AS er2, round(sum(eg * eg), 5) AS eg2, round(sum(eb * eb), 5) AS eb2 FROM err GROUP BY t")
def e09_error_field(cells):
    return rounded(shown_errors(cells).groupBy("t").agg(*[F.sum(F.col(f"e{c}") * F.col(f"e{c}")).alias(f"e{c}2") for c in "rgb"]), 5)


_sq = lambda k: f"SELECT sum(pow(a, 2) + pow(b, 2) + pow(c, 2)) / {k**3} AS p FROM (SELECT sum(er) AS a, sum(eg) AS b, sum(eb) AS c FROM err GROUP BY t // {k}, y // {k}, x // {k})"


@query(f"+ {ERR_SQL}, p AS (SELECT (SELECT p FROM ({_sq(1)})) AS e1, (SELECT p FROM ({_sq(2)})) AS e2, (SELECT p FROM ({_sq(4)})) AS e4, (SELECT count(*) FROM err) AS n) SELECT round(e4 / n, 6) AS d16, round(e2 / n, 6) AS d32, round(e1 / n, 6) AS d64, round(e4, 4) AS u4, round(e2 - e4, 4) AS u2, round(e1 - e2, 4) AS u1 FROM p")
def f27_read_distortion_bands(cells):
    out = pool.bands(shown_errors(cells), ["er", "eg", "eb"])
    return out.select(*[F.round(c, 6).alias(c) for c in ("d16", "d32", "d64")], *[F.round(c, 4).alias(c) for c in ("u4", "u2", "u1")])


def _others(axis: str, frames: int = SIDE) -> str:
    """What tells apart the lines along an axis: the other axes, and the capture where time runs along the line."""
    return ", ".join([f"t // {frames}"] * (axis == "t") + [c for c in "tyx" if c != axis])


_open = lambda a, v, cond: f"SELECT '{a}' AS axis, count(*) AS bonds, sum({cond}) AS energy FROM (SELECT {v} AS p, lead({v}) OVER (PARTITION BY {_others(a)} ORDER BY {a}) AS q FROM cube) WHERE q IS NOT NULL"


@query(" UNION ALL ".join(_open(a, "idx", "CASE WHEN p <> q THEN 1 ELSE 0 END::BIGINT").replace("::BIGINT", "") for a in "tyx").replace("AS energy", "::BIGINT AS energy"))
def e11_bond_walls(cells):
    return bonds.energy(cells, "idx")


@query(" UNION ALL ".join(_open(a, "idx", "(p - q) * (p - q)") for a in "tyx").replace("AS energy", "::BIGINT AS energy"))
def n12_bond_spread(cells):
    return bonds.energy(cells, "idx", bonds.SPREAD)


_all = " UNION ALL ".join(f"SELECT {a} AS own, idx AS p, lead(idx) OVER (PARTITION BY {_others(a)} ORDER BY {a}) AS q FROM cube" for a in "tyx")


@query(f"SELECT (own + 1) % 4 = 0 AS wall, count(*) AS bonds, sum(CASE WHEN p <> q THEN 1 ELSE 0 END)::BIGINT AS energy FROM ({_all}) WHERE q IS NOT NULL GROUP BY 1")
def e13_wall_and_interior_energy(cells):
    return bonds.split_by_tile(cells, "idx", 4)


_spin = "CASE WHEN idx >= 128 THEN 1 ELSE 0 END"
_plane = " UNION ALL ".join(f"SELECT t, {_spin} AS p, lead({_spin}) OVER (PARTITION BY t, {b} ORDER BY {a}) AS q FROM k" for a, b in (("x", "y"), ("y", "x")))
# Spins of the depth order within each frame, so that frames hold both.
SPIN_SQL = "k AS (SELECT t, y, x, side, (idx * 37 + y * x) % 256 AS idx FROM cube)"


def mixed_spins(cells):
    i = (F.col("idx") * 37 + F.col("y") * F.col("x")) % 256
    return cells.select("t", "y", "x", "side", i.alias("idx"), F.when(i >= 128, 1).otherwise(0).alias("spin"))


@query(f"+ {SPIN_SQL} SELECT t, sum(CASE WHEN p <> q THEN 1 ELSE 0 END)::BIGINT AS walls FROM ({_plane}) WHERE q IS NOT NULL GROUP BY t")
def e14_plane_walls(cells):
    return bonds.plane_walls(mixed_spins(cells), "spin").select("t", "walls")


@query(f"+ {SPIN_SQL} SELECT sum(CASE WHEN ({_spin.replace('idx', 'a.idx')}) <> ({_spin.replace('idx', 'b.idx')}) THEN 1 ELSE 0 END)::BIGINT AS walls, count(*) AS bonds FROM k a JOIN k b ON b.t = a.t - a.t % a.side + (a.t + 1) % a.side AND a.y = b.y AND a.x = b.x")
def e15_time_walls_cyclic(cells):
    return bonds.cyclic_walls(mixed_spins(cells), "spin", SIDE)


_h = "CASE WHEN {a} > 0 AND {b} > 0 THEN -({a} / ({a} + {b})::DOUBLE * log2({a} / ({a} + {b})::DOUBLE) + {b} / ({a} + {b})::DOUBLE * log2({b} / ({a} + {b})::DOUBLE)) ELSE 0 END"


@query(f"+ {SPIN_SQL}, w AS (SELECT t, sum(CASE WHEN p <> q THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p <> q THEN 0 ELSE 1 END) AS b FROM ({_plane}) WHERE q IS NOT NULL GROUP BY t) SELECT t, round((a + b) * (1 - ({_h.format(a='a', b='b')})), 5) AS bits FROM w")
def f14_wall_energy(cells):
    walls = bonds.plane_walls(mixed_spins(cells), "spin")
    return rounded(walls.select("t", energy.wall_bits(F.col("walls"), F.col("bonds")).alias("bits")), 5)


_stone = lambda a, b: f"CASE WHEN {a} - {b} > 0.08::DOUBLE THEN 0 WHEN {b} - {a} > 0.08::DOUBLE THEN 1 ELSE 2 END"
BOARD_SQL = "board AS (" + " UNION ALL ".join(f"SELECT t || '{a}{b}' AS board, y, x, {_stone(a, b)} AS stone FROM cube WHERE y < 19 AND x < 19" for a, b in ("rg", "gb", "br")) + ")"


def boards(cells):
    three = F.array(*[F.struct(F.lit(a + b).alias("board"), lattice.stone(F.col(a), F.col(b)).alias("stone")) for a, b in ("rg", "gb", "br")])
    return cells.where("y < 19 and x < 19").select("t", "y", "x", F.explode(three).alias("b")).select(F.concat("t", "b.board").alias("board"), "y", "x", "b.stone")


@query(f"+ {BOARD_SQL} SELECT board, y, x, stone FROM board")
def n29_boards(cells):
    return boards(cells)


@query(f"+ {BOARD_SQL} SELECT board, sum((stone = 0)::INT)::BIGINT AS black, sum((stone = 1)::INT)::BIGINT AS white, sum((stone = 2)::INT)::BIGINT AS empty, round((sum((stone = 0)::INT) - sum((stone = 1)::INT)) / count(*), 6) AS score FROM board GROUP BY board")
def f52_territory(cells):
    s = F.col("stone")
    out = boards(cells).groupBy("board").agg(*[F.count_if(s == i).alias(n) for i, n in enumerate(("black", "white", "empty"))], ((F.count_if(s == 0) - F.count_if(s == 1)) / F.count("*")).alias("score"))
    return rounded(out)


@query(f"+ {BOARD_SQL} SELECT board, count(*) AS liberties FROM board e WHERE stone = 2 AND EXISTS (SELECT 1 FROM board n WHERE n.board = e.board AND n.stone = 0 AND abs(n.y - e.y) + abs(n.x - e.x) = 1) GROUP BY board")
def e16_liberties(cells):
    return bonds.liberties(boards(cells), 0)


@query("SELECT idx, t, count(*) AS n, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box FROM cube GROUP BY idx, t")
def e18_colour_graphs(cells):
    y, x = F.col("y"), F.col("x")
    return rounded(cells.groupBy("idx", "t").agg(F.count("*").alias("n"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), ((F.max(y) - F.min(y) + 1) * (F.max(x) - F.min(x) + 1)).alias("box")))


@query("""+ c AS (SELECT idx % 64 AS c, t, y, x FROM cube), n AS (SELECT c, t, count(*) AS n FROM c GROUP BY 1, 2), o AS (SELECT a.c, a.t, count(*) AS o FROM c a JOIN c b ON a.c = b.c AND b.t = a.t + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1, 2)
SELECT n.c, n.t, round(coalesce(o.o, 0) / (n.n + m.n - coalesce(o.o, 0))::DOUBLE, 6) AS jaccard FROM n JOIN n m ON m.c = n.c AND m.t = n.t + 1 LEFT JOIN o ON o.c = n.c AND o.t = n.t""")
def e23_jaccard_coherence(cells):
    return rounded(ranks.jaccard(cells.select((F.col("idx") % 64).alias("c"), "t", "y", "x")))


_dist = "SELECT pow(a // 64 - b // 64, 2) + pow((a // 16) % 4 - (b // 16) % 4, 2) + pow((a // 4) % 4 - (b // 4) % 4, 2) + pow(a % 4 - b % 4, 2) AS d2, (a // 64 <> b // 64)::INT + ((a // 16) % 4 <> (b // 16) % 4)::INT + ((a // 4) % 4 <> (b // 4) % 4)::INT + (a % 4 <> b % 4)::INT AS k FROM (SELECT range AS a FROM range(256)), (SELECT range AS b FROM range(256)) WHERE a < b"


@query(f"SELECT CAST(d2 AS INT) AS d2, count(*) AS n FROM ({_dist}) GROUP BY 1", on_cube=False)
def e24_pair_distances(spark, sf_dir):
    return ranks.lattice_pairs(spark).groupBy("d2").agg(F.count("*").alias("n"))


@query(f"SELECT k, count(*) AS n FROM ({_dist}) GROUP BY 1", on_cube=False)
def e26_differing_axes(spark, sf_dir):
    return ranks.lattice_pairs(spark).groupBy("k").agg(F.count("*").alias("n"))


# Histograms and energies

HIST_SQL = "hist AS (SELECT f.t, i.idx, coalesce(n, 0) AS n FROM (SELECT DISTINCT t FROM cube) f CROSS JOIN (SELECT range AS idx FROM range(256)) i LEFT JOIN (SELECT t, idx, count(*) AS n FROM cube GROUP BY t, idx) c ON c.t = f.t AND c.idx = i.idx), tot AS (SELECT t, sum(n) AS cells FROM hist GROUP BY t)"


def frames(cells):
    return energy.histogram(cells, ["t"])


@query(f"+ {HIST_SQL} SELECT t, CAST(idx AS INT) AS idx, n FROM hist")
def f06_histogram(cells):
    return frames(cells).select("t", "idx", "n")


def _measure(name: str, sql: str):
    @query(f"+ {HIST_SQL} SELECT t, {sql} AS {name} FROM hist JOIN tot USING (t) WHERE n > 0 GROUP BY t")
    def run(cells):
        return rounded(energy.measures(energy.counts(cells, ["t"]), ["t"]).select("t", name))

    return run


for _row, _name, _text in (
    ("f07_entropy", "h0", "round(sum(-n / cells::DOUBLE * log2(n / cells::DOUBLE)), 6)"),
    ("f08_tiling_energy", "energy", "round(sum(n * log2(n / (cells / 256.0::DOUBLE))), 6)"),
    ("f09_energy_per_cell", "per_cell", "round(sum(n * log2(n / (cells / 256.0::DOUBLE))) / first(cells), 6)"),
    ("f13_ground_fraction", "phi", "round(sum(CASE WHEN idx >= 128 THEN n ELSE 0 END) / first(cells)::DOUBLE, 6)"),
):
    _measure(_name, _text)
    QUERIES[_row], ORACLE_SQL[_row] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


@query(f"+ {HIST_SQL}, lf AS (SELECT range AS k, sum(log2(greatest(range, 1))) OVER (ORDER BY range) AS bits FROM range(4097)) SELECT t, round(first(a.bits) - sum(b.bits), 5) AS bits FROM hist JOIN tot USING (t) JOIN lf a ON a.k = cells JOIN lf b ON b.k = n GROUP BY t")
def f11_multinomial_bits(cells):
    return rounded(energy.multinomial_bits(frames(cells), ["t"]), 5)


_lv = " UNION ALL ".join(f"SELECT t, {k} AS level, idx // {2 ** (8 - k)} AS node, sum(CASE WHEN (idx // {2 ** (7 - k)}) % 2 = 0 THEN n ELSE 0 END) AS a, sum(CASE WHEN (idx // {2 ** (7 - k)}) % 2 = 1 THEN n ELSE 0 END) AS b FROM hist GROUP BY t, idx // {2 ** (8 - k)}" for k in range(8))


@query(f"+ {HIST_SQL}, lv AS ({_lv}) SELECT t, level, round(sum((a + b) * (1 - ({_h.format(a='a', b='b')}))), 5) AS energy FROM lv GROUP BY t, level")
def f12_level_energies(cells):
    return rounded(energy.level_energies(frames(cells), ["t"]), 5)


@query(f"+ {HIST_SQL} SELECT t, round(sqrt(sum(pow(n - cells / 256.0::DOUBLE, 2))), 5) AS order_, round(sum(CASE WHEN n > 0 THEN -n / cells::DOUBLE * ln(n / cells::DOUBLE) ELSE 0 END) / ln(256), 5) AS complexity, round(sqrt(sum(pow(n - cells / 256.0::DOUBLE, 2))) / greatest(0.001, sum(CASE WHEN n > 0 THEN -n / cells::DOUBLE * ln(n / cells::DOUBLE) ELSE 0 END) / ln(256)), 4) AS beauty, sum((n > 0)::INT)::BIGINT AS colours_used FROM hist JOIN tot USING (t) GROUP BY t")
def f21_birkhoff(cells):
    b = energy.birkhoff(frames(cells), ["t"])
    return b.select("t", F.round("order", 5).alias("order_"), F.round("complexity", 5).alias("complexity"), F.round("beauty", 4).alias("beauty"), "colours_used")


@query(f"+ {HIST_SQL} SELECT t, round(1 / sum(pow(n / cells::DOUBLE, 2)), 5) AS participation FROM hist JOIN tot USING (t) GROUP BY t")
def f65_participation_ratio(cells):
    h = frames(cells)
    total = h.groupBy("t").agg(F.sum("n").alias("cells"))
    return rounded(h.join(total, "t").groupBy("t").agg((1 / F.sum(F.pow(F.col("n") / F.col("cells"), 2))).alias("participation")), 5)


@query(f"+ {HIST_SQL}, d AS (SELECT a.t, a.idx, sum(a.n - b.n) OVER (PARTITION BY a.t ORDER BY a.idx) AS g, a.n FROM hist a JOIN hist b ON b.t = a.t + 1 AND a.idx = b.idx) SELECT t, round(sum(abs(g)) / sum(n)::DOUBLE, 5) AS emd FROM d GROUP BY t")
def f70_earth_movers(cells):
    h = frames(cells)
    return rounded(energy.earth_movers(h, h.withColumn("t", F.col("t") - 1), ["t"], "idx"), 5)


# Census: name, lowest bit, width, block side, classes
STRATA = (("role", 7, 1, 1, 2), ("rung16", 6, 1, 4, 4), ("rung32", 3, 3, 2, 32), ("rung64", 0, 3, 1, 256))
_census = " UNION ALL ".join(
    f"SELECT '{n}' AS stratum, (SELECT round(avg(s), 6) FROM (SELECT (min((idx >> {lo}) & {2**w - 1}) = max((idx >> {lo}) & {2**w - 1}))::INT AS s FROM cube GROUP BY t // {k}, y // {k}, x // {k})) AS conformance, (SELECT count(DISTINCT idx >> {lo}) FROM cube) AS used, (SELECT min(coalesce(n, 0)) FROM range({c}) r LEFT JOIN (SELECT idx >> {lo} AS c, count(*) AS n FROM cube GROUP BY 1) h ON h.c = r.range) AS least, (SELECT max(n) FROM (SELECT count(*) AS n FROM cube GROUP BY idx >> {lo})) AS most"
    for n, lo, w, k, c in STRATA
)


@query(_census)
def f20_census(cells):
    out = None
    for name, low, width, k, classes in STRATA:
        value = F.shiftright("idx", low)
        share = pool.block_share(cells, value.bitwiseAND(2**width - 1), k)
        counts = energy.histogram(cells.select(value.alias("c")), [], "c", classes).agg(F.count_if(F.col("n") > 0).alias("used"), F.min("n").alias("least"), F.max("n").alias("most"))
        part = counts.select(F.lit(name).alias("stratum"), F.round(share.scalar(), 6).alias("conformance"), "used", "least", "most")
        out = part if out is None else out.unionByName(part)
    return out


@query("+ lf AS (SELECT range AS k, sum(ln(greatest(range, 1))) OVER (ORDER BY range) AS w FROM range(65)), c AS (SELECT t // 4 AS a, y // 4 AS b, x // 4 AS c, idx, count(*) AS n FROM cube WHERE idx >= 128 GROUP BY 1, 2, 3, 4), m AS (SELECT a, b, c, sum(n) AS m FROM c GROUP BY 1, 2, 3) SELECT round((SELECT sum(w) FROM m JOIN lf ON k = m) - (SELECT sum(w) FROM c JOIN lf ON k = n), 4) AS bill, (SELECT count(*) FROM m) AS blocks")
def f28_permutation_bill(cells):
    c = cells.where("idx >= 128").groupBy(*pool.block(4), "idx").agg(F.count("*").alias("n"))
    lf = F.broadcast(energy.log_factorials(cells.sparkSession, 64).select("k", (F.col("bits") * F.ln(F.lit(2.0))).alias("w")))
    m = c.groupBy("t", "y", "x").agg(F.sum("n").alias("n"))
    whole, parts = (d.join(lf, d.n == lf.k).agg(F.sum("w")) for d in (m, c))
    return m.agg(F.count("*").alias("blocks")).select(F.round(whole.scalar() - parts.scalar(), 4).alias("bill"), "blocks")


@query("+ tiles AS (SELECT t // 4 AS bt, y // 4 AS by_, x // 4 AS bx, sum((idx >= 128)::INT) AS ground, count(DISTINCT idx) AS used FROM cube GROUP BY 1, 2, 3) SELECT CASE WHEN ground = 0 THEN 'face' WHEN ground = 64 THEN 'solid' ELSE 'band' END AS phase, count(*) AS tiles, sum(used)::BIGINT AS used FROM tiles GROUP BY 1")
def f30_tiling_summary(cells):
    tiles = cells.groupBy(*pool.block(4)).agg(F.count_if(F.col("idx") >= 128).alias("ground"), F.count_distinct("idx").alias("used"))
    phase = F.when(F.col("ground") == 0, "face").when(F.col("ground") == 64, "solid").otherwise("band")
    return tiles.groupBy(phase.alias("phase")).agg(F.count("*").alias("tiles"), F.sum("used").alias("used"))


# Pools


@query("SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b, round(avg(s), 9) AS s FROM cube GROUP BY t // 2, y // 2, x // 2")
def f38_pool(cells):
    return rounded(pool.pool(cells, ["r", "g", "b", "s"]), 9)


@query("+ p AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, avg(s) AS s FROM cube GROUP BY t // 2, y // 2, x // 2) SELECT c.t, c.y, c.x, round(p.s, 6) AS s FROM cube c JOIN p ON p.t = c.t // 2 AND p.y = c.y // 2 AND p.x = c.x // 2")
def f35_lift(cells):
    lifted = pool.lift(pool.pool(cells, ["s"]))
    return rounded(lifted.join(cells.select("t", "y", "x"), ["t", "y", "x"], "left_semi"))  # the last frame can be part-filled


@query("SELECT round(avg(greatest(0, v)), 6) AS within FROM (SELECT avg(s * s) - avg(s) * avg(s) AS v FROM cube GROUP BY t // 4, y // 4, x // 4)")
def f39_within_variance(cells):
    return rounded(pool.within_variance(cells, "s"))


@query("SELECT t, round(var_pop(s), 6) AS variance FROM cube GROUP BY t")
def f40_variance(cells):
    return rounded(cells.groupBy("t").agg(F.var_pop("s").alias("variance")))


@query(" UNION ALL ".join(f"SELECT {k} AS k, count(*) AS cells, round(sum(m) * {k**3}, 4) AS mass FROM (SELECT avg(s) AS m FROM cube GROUP BY t // {k}, y // {k}, x // {k})" for k in (1, 2, 4)))
def f41_pyramid(cells):
    p = pool.pyramid(cells, ["s"])
    return rounded(p.groupBy("k").agg(F.count("*").alias("cells"), (F.sum("s") * F.pow("k", F.lit(3))).alias("mass")), 4)


@query("SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, sum(idx)::BIGINT AS idx FROM cube GROUP BY t // 2, y // 2, x // 2")
def f42_exact_sum_pool(cells):
    return pool.pool_sums(cells, ["idx"])


@query("SELECT sum((n <= 1)::INT)::BIGINT AS free_blocks, count(*) AS blocks FROM (SELECT sum((idx % 64 <> 0 AND idx % 5 = 0)::INT) AS n FROM cube GROUP BY t // 2, y // 2, x // 2)")
def f44_free_blocks(cells):
    return pool.free_blocks(cells.withColumn("v", F.when((F.col("idx") % 64 != 0) & (F.col("idx") % 5 == 0), 1).otherwise(0)), ["v"])


@query("SELECT t, y // 4 AS y, x // 4 AS x, round(avg(s), 6) AS s FROM cube GROUP BY t, y // 4, x // 4")
def f48_spatial_pool(cells):
    return rounded(pool.pool(cells, ["s"], 4, ("y", "x")))


@query("SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, CAST(w AS INT) AS w, round(sum(CASE WHEN bit_count(w & ((x % 2) + 2 * (y % 2) + 4 * (t % 2))) % 2 = 1 THEN -s ELSE s END) / 8, 6) AS coef FROM cube, (SELECT range AS w FROM range(8)) GROUP BY t // 2, y // 2, x // 2, w")
def f79_haar(cells):
    out = rounded(pool.haar(cells, "s"))
    return out.withColumn("coef", F.when(F.col("coef") == 0, F.lit(0.0)).otherwise(F.col("coef")))


@query("SELECT t, y, x, round(avg(s) OVER (PARTITION BY t // 4, y // 4, x // 4), 6) AS s FROM cube")
def n31_block_projection(cells):
    return rounded(pool.projected(cells.select("t", "y", "x", "s"), "s", 4))


# Moments, fits and folds


@query("+ w AS (SELECT *, 1 - s AS w FROM cube WHERE s < 1), m AS (SELECT t, sum(w) AS w0, sum(w * r) / sum(w) AS mr, sum(w * g) / sum(w) AS mg, sum(w * b) / sum(w) AS mb FROM w GROUP BY t) SELECT t, round(first(mr), 6) AS mr, round(first(mg), 6) AS mg, round(first(mb), 6) AS mb, round(sum(w * pow(r - mr, 2)) / first(w0), 6) AS vrr, round(sum(w * (r - mr) * (g - mg)) / first(w0), 6) AS vrg, round(sum(w * pow(b - mb, 2)) / first(w0), 6) AS vbb FROM w JOIN m USING (t) GROUP BY t")
def f01_weighted_moments(cells):
    m = fits.weighted_moments(cells.where("s < 1").withColumn("w", 1 - F.col("s")), ["t"], ["r", "g", "b"], "w")
    return rounded(m.select("t", F.col("m_r").alias("mr"), F.col("m_g").alias("mg"), F.col("m_b").alias("mb"), F.col("v_r_r").alias("vrr"), F.col("v_r_g").alias("vrg"), F.col("v_b_b").alias("vbb")))


def _em_sql(steps: int) -> str:
    """Iterations over distinct values with counts, unrolled."""
    out = """WITH x AS (SELECT least(1, value / 500) AS s, event_id FROM events), o AS (SELECT s, row_number() OVER (ORDER BY s, event_id) AS i, count(*) OVER () AS n FROM x),
v AS (SELECT s, count(*)::DOUBLE AS c FROM x GROUP BY s),
f0 AS (SELECT avg(CASE WHEN i > n // 2 THEN s END) AS mf, avg(CASE WHEN i <= n // 2 THEN s END) AS mb, 0.5::DOUBLE AS pb, greatest(1e-9, stddev_pop(s)) AS sd FROM o)"""
    for k in range(steps):
        out += f""", r{k} AS (SELECT s, c, 1 / (1 + exp(-(ln(pb / (1 - pb)) + (pow(s - mf, 2) - pow(s - mb, 2)) / (2 * sd * sd)))) AS r FROM v, f{k}),
m{k} AS (SELECT sum(c * r * s) / sum(c * r) AS mb, sum(c * (1 - r) * s) / sum(c * (1 - r)) AS mf, sum(c * r) / sum(c) AS pb FROM r{k}),
f{k + 1} AS (SELECT first(mf) AS mf, first(mb) AS mb, first(pb) AS pb, greatest(1e-9, sqrt(sum(c * (r * pow(s - mb, 2) + (1 - r) * pow(s - mf, 2))) / sum(c))) AS sd FROM r{k}, m{k})"""
    return out + f" SELECT round(mf, 5) AS mf, round(mb, 5) AS mb, round(pb, 5) AS pb, round(sd, 5) AS sd FROM f{steps}"


@query(_em_sql(6), on_cube=False)
def j02_mixture_steps(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.least(F.lit(1.0), F.col("value") / 500).alias("s"))
    return rounded(fits.mixture(x, "s", steps=6), 5)


_series = "ser AS (SELECT t // side AS capture, t, avg(s) AS v FROM cube GROUP BY t, side)"


def depth_series(cells):
    """(capture, t, v): each frame's mean depth."""
    return cells.groupBy(capture(), "t").agg(F.avg("s").alias("v"))


@query(f"+ {_series}, d AS (SELECT capture, t, v - lag(v) OVER (PARTITION BY capture ORDER BY t) AS d FROM ser), e AS (SELECT capture, t, d - avg(d) OVER (PARTITION BY capture) AS e FROM d WHERE d IS NOT NULL), l AS (SELECT capture, e, lag(e) OVER (PARTITION BY capture ORDER BY t) AS p FROM e) SELECT capture, round(sum(e * p) / (count(*) - 1) / (sum(e * e) / count(*)), 6) AS rho FROM l GROUP BY capture HAVING count(*) > 1 AND sum(e * e) > 0")
def g01_lag_autocorrelation(cells):
    return rounded(fits.lag_autocorrelation(fits.differences(depth_series(cells), "t", "v", ["capture"]), "t", "d", ["capture"]))


@query(f"+ {_series} SELECT capture, round(sum(abs(v - p)), 6) AS tv FROM (SELECT capture, v, lag(v) OVER (PARTITION BY capture ORDER BY t) AS p FROM ser) WHERE p IS NOT NULL GROUP BY capture")
def n44_total_variation(cells):
    return rounded(fits.differences(depth_series(cells), "t", "v", ["capture"]).groupBy("capture").agg(F.sum(F.abs("d")).alias("tv")))


@query(f"+ {_series}, k AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM ser) SELECT a.capture, round(avg(abs(a.v - b.v)), 6) AS churn FROM k a JOIN k b ON a.capture = b.capture AND b.i = (a.i + 1) % a.n GROUP BY a.capture")
def g07_ring_churn(cells):
    return rounded(fits.ring_churn(depth_series(cells), "t", "v", ["capture"]))


@query(f"+ {_series}, e AS (SELECT a.t, sum(CASE WHEN b.t % {SIDE} = 0 THEN pow(0.75::DOUBLE, a.t % {SIDE}) ELSE 0.25 * pow(0.75::DOUBLE, a.t - b.t) END * b.v) AS ema FROM ser a JOIN ser b ON a.capture = b.capture AND b.t <= a.t GROUP BY a.t) SELECT t, round(ema, 6) AS ema FROM e")
def g05_moving_average(cells):
    return rounded(fits.moving_average(depth_series(cells), "t", "v", 0.25, ["capture"]).drop("capture"))


@query(f"+ {_series} SELECT t, round((v - avg(v) OVER c) / (stddev_pop(v) OVER c + 1e-12), 6) AS w FROM ser WINDOW c AS (PARTITION BY capture)")
def g06_whiten(cells):
    own = Window.partitionBy("capture")
    return rounded(depth_series(cells).select("t", ((F.col("v") - F.avg("v").over(own)) / (F.stddev_pop("v").over(own) + 1e-12)).alias("w")))


@query(f"+ h AS (SELECT t, idx, count(*) AS n FROM cube GROUP BY 1, 2) SELECT t, idx, n, sum(n) OVER (PARTITION BY t // {SIDE}, idx ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS pooled FROM h")
def g20_running_trace(cells):
    h = cells.groupBy("t", "idx").agg(F.count("*").alias("n"))
    return h.withColumn("pooled", F.sum("n").over(Window.partitionBy(capture(), "idx").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))


# Ranks, quotas, fronts, enumeration

_q = "SELECT t, e, w, w / sum(w) OVER (PARTITION BY t) * 1000 AS x FROM (SELECT t, idx % 4 AS e, sum(s) + 1 AS w FROM cube GROUP BY 1, 2)"


@query(f"+ q AS ({_q}), k AS (SELECT *, floor(x) AS base FROM q), l AS (SELECT *, 1000 - sum(base) OVER (PARTITION BY t) AS spare, row_number() OVER (PARTITION BY t ORDER BY round(x - base, 9) DESC, e) AS n FROM k) SELECT t, e, CAST(base + CASE WHEN n <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM l")
def h01_largest_remainder(cells):
    w = cells.groupBy("t", (F.col("idx") % 4).alias("e")).agg((F.sum("s") + 1).alias("w"))
    return codebook.largest_remainder(w, ["t"], "e", "w", F.lit(1000)).select("t", "e", "quota")


@query("SELECT t, y, x, CAST(row_number() OVER (PARTITION BY t, idx ORDER BY s DESC, y, x) AS INT) AS rank FROM cube")
def g10_rank_by_depth(cells):
    return cells.select("t", "y", "x", F.row_number().over(Window.partitionBy("t", "idx").orderBy(F.desc("s"), "y", "x")).alias("rank"))


@query("SELECT a.t, a.idx AS asc_idx, b.idx AS desc_idx, CAST(a.k AS INT) AS rank FROM (SELECT t, idx, row_number() OVER (PARTITION BY t ORDER BY count(*), idx) AS k FROM cube GROUP BY t, idx) a JOIN (SELECT t, idx, row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, idx) AS k FROM cube GROUP BY t, idx) b ON a.t = b.t AND a.k = b.k")
def e29_contrastive_pairing(cells):
    return ranks.paired(cells.groupBy("t", "idx").agg(F.count("*").alias("n")), "t", "idx", "n")


@query("""+ p AS (SELECT t, idx, count(*) AS n, max(s) AS m FROM cube GROUP BY 1, 2) SELECT t, idx, n, round(m, 6) AS m FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.n >= a.n AND b.m >= a.m AND (b.n > a.n OR b.m > a.m))""")
def i03_pareto_front(cells):
    p = cells.groupBy("t", "idx").agg(F.count("*").alias("n"), F.max("s").alias("m"))
    return rounded(codebook.pareto(p, "idx", {"n": True, "m": True}))


@query("SELECT count(*) AS edits, sum(f + g + c + m + n)::BIGINT AS total FROM " + ", ".join(f"(SELECT range AS {c} FROM range(8)) AS {c}_" for c in "fgcmn"), on_cube=False)
def i02_edit_space(spark, sf_dir):
    dials = [F.expr(f"(id div {8**k}) % 8").alias(c) for k, c in enumerate("fgcmn")]
    return spark.range(8**5).select(*dials).agg(F.count("*").alias("edits"), F.sum(F.col("f") + F.col("g") + F.col("c") + F.col("m") + F.col("n")).alias("total"))


@query("SELECT CAST(bit_count(range) AS INT) AS coverage, count(*) AS tiles FROM range(65536) GROUP BY 1", on_cube=False)
def i13_tiles_by_coverage(spark, sf_dir):
    return spark.range(1 << 16).groupBy(F.bit_count("id").alias("coverage")).agg(F.count("*").alias("tiles"))


@query("SELECT t, CASE WHEN s > 0.6 THEN 'subject' WHEN s < 0.4 THEN 'ground' ELSE 'border' END AS part, count(*) AS n, round(avg(s), 6) AS mean FROM cube GROUP BY 1, 2")
def f50_subject_split(cells):
    part = F.when(F.col("s") > 0.6, "subject").when(F.col("s") < 0.4, "ground").otherwise("border")
    return rounded(cells.groupBy("t", part.alias("part")).agg(F.count("*").alias("n"), F.avg("s").alias("mean")))


@query("SELECT t, min(CASE WHEN idx % 64 = 0 THEN y * side + x END) AS first_black, min(CASE WHEN idx % 64 = 63 THEN y * side + x END) AS first_white, sum((idx % 64 = 0)::INT)::BIGINT AS black, sum((idx % 64 = 63)::INT)::BIGINT AS white FROM cube GROUP BY t")
def f51_anchors(cells):
    at, c = (F.col("y") * F.col("side") + F.col("x")), F.col("idx") % 64
    return cells.groupBy("t").agg(F.min(F.when(c == 0, at)).alias("first_black"), F.min(F.when(c == 63, at)).alias("first_white"), F.count_if(c == 0).alias("black"), F.count_if(c == 63).alias("white"))


@query("SELECT t, round(avg((idx % 64 = p)::INT), 6) AS same FROM (SELECT t, idx, lag(idx % 64) OVER (PARTITION BY t // side, y, x ORDER BY t) AS p FROM cube) WHERE p IS NOT NULL GROUP BY t")
def f75_frame_coherence(cells):
    now = F.col("idx") % 64
    before = cells.select("t", now.alias("c"), F.lag(now).over(Window.partitionBy(capture(), "y", "x").orderBy("t")).alias("p")).where("p is not null")
    return rounded(before.groupBy("t").agg(F.avg((F.col("c") == F.col("p")).cast("int")).alias("same")))


@query("+ h AS (SELECT t, least(63, CAST(floor(s * 64) AS INT)) AS bin, count(*) AS n FROM cube GROUP BY 1, 2) SELECT f.t, CAST(i.range AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT t FROM cube) f CROSS JOIN range(64) i LEFT JOIN h ON h.t = f.t AND h.bin = i.range")
def f61_depth_histogram(cells):
    return energy.histogram(cells.withColumn("bin", F.least(F.lit(63), F.floor(F.col("s") * 64).cast("int"))), ["t"], "bin", 64).select("t", "bin", "n")
