"""Queries of barycentres, centroids, soft assignment, blends and pools, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxlake.functions import colour
from voxlake.operators import centroids, codebook, pairtree, wasserstein
from voxlake.operators.pairtree import COVARIANCE, LAB

from .catalog import LAB_SQL, _book, query, rgb, rounded
from .catalog_more import lab_cells
from .cube import SIDE, capture

CELLS = SIDE * SIDE
_luma = "least(15, CAST(floor(16 * (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)) AS INT))"
STRATA_SQL = f"st AS (SELECT t, t // side AS capture, row_number() OVER (PARTITION BY t ORDER BY {_luma}, y, x) - 1 AS j, {_luma} AS k FROM cube WHERE t IN (SELECT t FROM cube GROUP BY t HAVING count(*) = {CELLS}))"


def strata(cells):
    """(t, j, k): the luma strata of each whole frame as quantiles."""
    k = F.least(F.lit(15), F.floor(colour.luma(rgb()) * 16).cast("int"))
    rows = cells.select("t", "y", "x", k.alias("k"))
    whole = rows.groupBy("t").agg(F.count("*").alias("n")).where(f"n = {CELLS}").select("t")
    return wasserstein.quantiles(rows.join(whole, "t"), ["t"], "k", ["y", "x"])


@query(f"+ {STRATA_SQL} SELECT a.t, CAST((2 * a.k + 3 * b.k + 5 * c.k) // 10 AS INT) AS k, count(*) AS n FROM st a JOIN st b ON b.t = a.t + 1 AND b.j = a.j AND b.capture = a.capture JOIN st c ON c.t = a.t + 2 AND c.j = a.j AND c.capture = a.capture GROUP BY 1, 2")
def f71_quantile_barycentre(cells):
    """Luma strata of the barycentre of each frame and the next two of its capture, weighted 2, 3 and 5."""
    q = strata(cells)
    later = lambda d: q.select((F.col("t") - d).alias("t"), "j", F.col("k").alias(f"k{d}")).where(f"(t + {d}) div {SIDE} = t div {SIDE}")
    tables = q.withColumnRenamed("k", "k0").join(later(1), ["t", "j"]).join(later(2), ["t", "j"])
    return wasserstein.barycentre(tables, ["t"], (2, 3, 5))


_grid = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(wasserstein.simplex(10)))


@query(f"""+ {STRATA_SQL}, atom AS (SELECT capture, j, max(CASE WHEN t % {SIDE} = 0 THEN k END) AS k0, max(CASE WHEN t % {SIDE} = 5 THEN k END) AS k1, max(CASE WHEN t % {SIDE} = 10 THEN k END) AS k2 FROM st WHERE t % {SIDE} IN (0, 5, 10) GROUP BY 1, 2 HAVING count(*) = 3),
grid(i, w0, w1, w2) AS (VALUES {_grid}), bc AS (SELECT capture, i, w0, w1, w2, (w0 * k0 + w1 * k1 + w2 * k2) // 10 AS k, count(*) AS n FROM atom, grid GROUP BY ALL),
bins AS (SELECT range AS b FROM range(16)), hb AS (SELECT capture, i, w0, w1, w2, b, sum(n) AS c FROM bc JOIN bins ON k <= b GROUP BY ALL), hs AS (SELECT capture, t, b, count(*) AS c FROM st JOIN bins ON k <= b GROUP BY ALL),
e AS (SELECT s.capture, s.t, s.i, sum(abs(coalesce(h.c, 0) - coalesce(s.c, 0))) / {CELLS}::DOUBLE AS d FROM (SELECT x.capture, x.t, y.i, b.b, hs.c FROM (SELECT DISTINCT capture, t FROM st) x JOIN (SELECT DISTINCT capture, i FROM bc) y USING (capture) CROSS JOIN bins b LEFT JOIN hs ON hs.t = x.t AND hs.b = b.b) s LEFT JOIN hb h ON h.capture = s.capture AND h.i = s.i AND h.b = s.b GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, i) AS k FROM e), g AS (SELECT * FROM grid) SELECT t, CAST(g.w0 AS INT) AS w0, CAST(g.w1 AS INT) AS w1, CAST(g.w2 AS INT) AS w2, round(d, 6) AS d FROM r JOIN g ON g.i = r.i WHERE r.k = 1""")
def f72_barycentric_coordinates(cells):
    """Each frame's nearest barycentre of three frames of its capture (0, 5 and 10), in tenths."""
    q = strata(cells).withColumn("capture", capture())
    at = [F.max(F.when(F.col("t") % SIDE == a, F.col("k"))).alias(f"k{i}") for i, a in enumerate((0, 5, 10))]
    atoms = q.where(f"t % {SIDE} in (0, 5, 10)").groupBy("capture", "j").agg(*at, F.count("*").alias("n")).where("n = 3").drop("n")
    targets = wasserstein.running(q.groupBy("capture", "t", "k").agg(F.count("*").alias("n")), ["capture", "t"])
    return rounded(wasserstein.coordinates(targets, atoms, "capture", "t", CELLS).drop("capture"))


def _lloyd_sql(n: int = 8, steps: int = 8) -> str:
    lum = "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"
    out = f"p AS (SELECT t, y, x, r, g, b, row_number() OVER (PARTITION BY t ORDER BY {lum}, y, x) - 1 AS k, count(*) OVER (PARTITION BY t) AS n FROM cube), c0 AS (SELECT t, j, r, g, b FROM p, (SELECT range AS j FROM range({n})) WHERE k = (j * n) // {n})"
    for k in range(steps):
        out += f""", a{k} AS (SELECT t, j, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM (SELECT p.t, j, p.r, p.g, p.b, row_number() OVER (PARTITION BY p.t, y, x ORDER BY round((p.r - c.r) * (p.r - c.r) + (p.g - c.g) * (p.g - c.g) + (p.b - c.b) * (p.b - c.b), 9), j) AS i FROM p JOIN c{k} c ON c.t = p.t) WHERE i = 1 GROUP BY 1, 2),
c{k + 1} AS (SELECT c.t, c.j, coalesce(a.r, c.r) AS r, coalesce(a.g, c.g) AS g, coalesce(a.b, c.b) AS b FROM c{k} c LEFT JOIN a{k} a ON a.t = c.t AND a.j = c.j)"""
    return out + f" SELECT t, CAST(j AS INT) AS j, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c{steps}"


@query(f"+ {_lloyd_sql()}")
def j16_lloyd(cells):
    """Eight colours of each frame by eight of Lloyd's steps, from seeds at eighths of the order of luma."""
    points = cells.select("t", "y", "x", "r", "g", "b")
    found = centroids.lloyd(points, ["t"], ["r", "g", "b"], [colour.luma(rgb()), F.col("y"), F.col("x")], 8)
    return rounded(found.select("t", F.posexplode("centres").alias("j", "c")).select("t", "j", "c.*"))


@query(f"+ book(i, cr, cg, cb) AS (VALUES {_book}), d AS (SELECT t, y, x, i, pow(r - cr, 2) + pow(g - cg, 2) + pow(b - cb, 2) AS d FROM cube, book), m AS (SELECT *, min(d) OVER (PARTITION BY t, y, x) AS m FROM d), w AS (SELECT t, y, x, sum(exp(-(d - m) / 0.02::DOUBLE)) AS z FROM m GROUP BY 1, 2, 3) SELECT t, y, x, round(1 / z, 6) AS best FROM w")
def n34_soft_assignment(cells):
    """The weight of the nearest of the lattice's 64 colours under a soft assignment of temperature 0.02."""
    best = centroids.softness([w for _, *w in codebook.lattice_book()], 0.02)
    return rounded(cells.select("t", "y", "x", best("r", "g", "b").alias("best")))


@query("SELECT bt, by_, bx, round(lgamma(65) - sum(lgamma(n + 1)), 6) AS ln_w FROM (SELECT t // 4 AS bt, y // 4 AS by_, x // 4 AS bx, idx, count(*) AS n FROM cube GROUP BY ALL) GROUP BY ALL HAVING sum(n) = 64")
def n36_multiplicity(cells):
    """Log of the number of ways to arrange the indices of each whole block of 64 cells."""
    block = [F.expr(f"cast({c} div 4 as int)").alias(n) for c, n in zip("tyx", ("bt", "by_", "bx"))]
    log = lambda n: F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda z, k: z + F.ln(k))
    counts = cells.groupBy(*block, "idx").agg(F.count("*").alias("n"))
    whole = counts.groupBy("bt", "by_", "bx").agg(F.sum("n").alias("total"), F.sum(log(F.col("n"))).alias("parts")).where("total = 64")
    return rounded(whole.select("bt", "by_", "bx", (log(F.lit(64).cast("long")) - F.col("parts")).alias("ln_w")))


_pairs = list(zip(COVARIANCE, "lllaab", "lababb"))


@query(f"+ {LAB_SQL}, m AS (SELECT t, {', '.join(f'sum(s * l{a}) / sum(s) AS m{a}' for a in 'lab')} FROM lab WHERE s > 0 GROUP BY t) SELECT t, {', '.join(f'round(sum(s * (l{a} - m{a}) * (l{b} - m{b})) / sum(s), 7) AS {c}' for c, a, b in _pairs)} FROM lab JOIN m USING (t) WHERE s > 0 GROUP BY t")
def n38_weighted_covariance(cells):
    """Population covariance of each frame's colours, weighted by depth."""
    return rounded(pairtree.moments(lab_cells(cells, "s").where("s > 0"), ["t"], F.col("s")).select("t", *COVARIANCE), 7)


@query(f"+ {LAB_SQL} SELECT t, y, x, " + ", ".join(f"round(avg({c}) OVER (PARTITION BY t // 4, y // 4, x // 4) / 6 + avg({c}) OVER (PARTITION BY t // 2, y // 2, x // 2) / 3 + {c} / 2, 6) AS {c[1]}" for c in LAB) + " FROM lab")
def f36_octave_blend(cells):
    """Each cell's colour blended with its blocks' means at half and quarter resolution, by weights of 3, 2 and 1 in 6."""
    rows = lab_cells(cells)
    for k in (4, 2):
        key = {f"b{k}{c}": F.expr(f"{c} div {k}") for c in "tyx"}
        rows = rows.withColumns(key)
        rows = rows.join(rows.groupBy(*key).agg(*[F.avg(c).alias(f"{c}{k}") for c in LAB]), list(key)).drop(*key)
    return rounded(rows.select("t", "y", "x", *[(F.col(f"{c}4") / 6 + F.col(f"{c}2") / 3 + F.col(c) / 2).alias(c[1]) for c in LAB]))


@query("SELECT t, y // 8 AS y, x // 8 AS x, " + ", ".join(f"round(least(1, greatest(0, avg({c}))), 9) AS {c}" for c in "rgbs") + " FROM cube GROUP BY t, y // 8, x // 8")
def f49_block_pool(cells):
    """Each frame pooled from 16 to 2 cells a side; a depth that is no number counts as one half, means stay in the unit."""
    filled = lambda c: F.when(F.isnan(c), 0.5).otherwise(F.col(c))
    mean = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(filled(c)))).alias(c)
    return rounded(cells.groupBy("t", *[F.expr(f"cast({c} div 8 as int)").alias(c) for c in "yx"]).agg(*[mean(c) for c in "rgbs"]), 9)


_site = "CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN r WHEN y % 2 = 1 AND x % 2 = 1 THEN b ELSE g END"
_mirror = lambda c: f"CASE WHEN {c} < 0 THEN 1 WHEN {c} > {SIDE - 1} THEN {SIDE - 2} ELSE {c} END"
_offsets = ", ".join(f"max(CASE WHEN dy = {dy} AND dx = {dx} THEN k.v END) AS {n}" for n, dy, dx in (("u", -1, 0), ("d", 1, 0), ("l", 0, -1), ("q", 0, 1), ("ul", -1, -1), ("uq", -1, 1), ("dl", 1, -1), ("dq", 1, 1)))


@query(f"""+ m AS (SELECT t, y, x, {_site} AS v FROM cube WHERE t IN (SELECT t FROM cube GROUP BY t HAVING count(*) = {CELLS})), o AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b),
n AS (SELECT c.t, c.y, c.x, any_value(c.v) AS v, {_offsets} FROM m c CROSS JOIN o JOIN m k ON k.t = c.t AND k.y = ({_mirror('(c.y + dy)')}) AND k.x = ({_mirror('(c.x + dx)')}) GROUP BY 1, 2, 3),
a AS (SELECT *, (u + d + l + q) / 4 AS cross4, (ul + uq + dl + dq) / 4 AS diag, (l + q) / 2 AS h, (u + d) / 2 AS w, 2 * (y % 2) + x % 2 AS site FROM n)
SELECT t, y, x, round(CASE site WHEN 0 THEN v WHEN 1 THEN h WHEN 2 THEN w ELSE diag END, 9) AS r, round(CASE site WHEN 0 THEN cross4 WHEN 3 THEN cross4 ELSE v END, 9) AS g, round(CASE site WHEN 0 THEN diag WHEN 1 THEN w WHEN 2 THEN h ELSE v END, 9) AS b FROM a""")
def n76_bilinear_demosaic(cells):
    """Each whole frame's mosaic back to three channels: the measured one as it is, the others as means of the nearest sites
    of their colour. Beyond an edge, what lies on its other side counts."""
    whole = cells.groupBy("t").agg(F.count("*").alias("n")).where(f"n = {CELLS}").select("t")
    odd = lambda c: F.col(c) % 2 == 1
    v = F.when(~odd("y") & ~odd("x"), F.col("r")).when(odd("y") & odd("x"), F.col("b")).otherwise(F.col("g"))
    rows = cells.join(whole, "t").select("t", "y", "x", v.alias("v"))
    row, column = Window.partitionBy("t", "y").orderBy("x"), Window.partitionBy("t", "x").orderBy("y")
    both = lambda c, line: (F.coalesce(F.lag(c).over(line), F.lead(c).over(line)), F.coalesce(F.lead(c).over(line), F.lag(c).over(line)))
    rows = rows.withColumns(dict(zip(("left", "right"), both("v", row))))
    rows = rows.withColumns({f"{n}_{c}": e for c in ("v", "left", "right") for n, e in zip(("up", "down"), both(c, column))})
    h, w = (F.col("left") + F.col("right")) / 2, (F.col("up_v") + F.col("down_v")) / 2
    cross, diag = (h + w) / 2, (F.col("up_left") + F.col("up_right") + F.col("down_left") + F.col("down_right")) / 4
    red, blue = ~odd("y") & ~odd("x"), odd("y") & odd("x")
    r = F.when(red, F.col("v")).when(blue, diag).when(odd("x"), h).otherwise(w)
    b = F.when(blue, F.col("v")).when(red, diag).when(odd("x"), w).otherwise(h)
    return rounded(rows.select("t", "y", "x", r.alias("r"), F.when(red | blue, cross).otherwise(F.col("v")).alias("g"), b.alias("b")), 9)
