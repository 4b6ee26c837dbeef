"""Queries of the solve of captures: mixture fits and what follows from them, axes, pair trees, tables and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import colour
from voxlake.operators import descent, mixtures, pairtree, solve
from voxlake.operators.pairtree import COVARIANCE, LAB

from .catalog import LAB_SQL, query, rounded
from .catalog_more import lab_cells
from .cube import capture

STEPS = mixtures.STEPS


def keyed(cells):
    return cells.withColumn("capture", capture())


def em_sql(name: str, key: str, source: str = "cube", value: str = "s") -> str:
    """Table name(g, mf, mb, pb, sd): the fit of each group's values."""
    r = "1 / (1 + exp(-(ln(pb / (1 - pb)) + (pow(v.s - mf, 2) - pow(v.s - mb, 2)) / (2 * sd * sd))))"
    return f"""{name}_o AS (SELECT {key} AS g, {value} AS s, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
{name}_v AS (SELECT g, s, count(*)::DOUBLE AS c FROM {name}_o GROUP BY 1, 2),
{name}_r AS (SELECT g, 0 AS k, avg(CASE WHEN i > n // 2 THEN s END) AS mf, avg(CASE WHEN i <= n // 2 THEN s END) AS mb, 0.5::DOUBLE AS pb, greatest(1e-9, stddev_pop(s)) AS sd FROM {name}_o GROUP BY g HAVING count(*) > 1
  UNION ALL SELECT g, k + 1, sum(c * (1 - r) * s) / sum(c * (1 - r)), sum(c * r * s) / sum(c * r), sum(c * r) / sum(c),
  greatest(1e-9, sqrt(greatest(0, (sum(c * s * s) - pow(sum(c * r * s), 2) / sum(c * r) - pow(sum(c * (1 - r) * s), 2) / sum(c * (1 - r))) / sum(c))))
  FROM (SELECT f.g, k, v.s, c, {r} AS r FROM {name}_r f JOIN {name}_v v ON v.g = f.g WHERE k < {STEPS}) GROUP BY g, k),
{name} AS (SELECT g, greatest(mf, mb) AS mf, least(mf, mb) AS mb, CASE WHEN mf < mb THEN 1 - pb ELSE pb END AS pb, sd FROM {name}_r WHERE k = {STEPS})"""


_norm = "(-0.5 * pow((v.s - {m}) / {sd}, 2) - ln({sd}) - 0.5 * ln(2 * pi()))"


def likelihood_sql(name: str) -> str:
    """Tables name_l(g, n, ll) and name_b(g, bic_one, bic_two, two_phase) of the fits in name."""
    one, two = (_norm.format(m=f"f.{m}", sd="f.sd") for m in ("mb", "mf"))
    return f"""{name}_l AS (SELECT v.g, sum(c) AS n, sum(c * (greatest(ln(pb) + {one}, ln(1 - pb) + {two}) + ln(1 + exp(-abs(ln(pb) + {one} - ln(1 - pb) - {two}))))) AS ll FROM {name}_v v JOIN {name} f ON f.g = v.g GROUP BY v.g),
{name}_m AS (SELECT g, avg(s) AS m, greatest(1e-9, stddev_pop(s)) AS sd FROM {name}_o GROUP BY g),
{name}_b AS (SELECT a.g, 2 * ln(n) - 2 * l1 AS bic_one, 4 * ln(n) - 2 * ll AS bic_two, mf > mb AND 4 * ln(n) - 2 * ll < 2 * ln(n) - 2 * l1 AS two_phase
  FROM (SELECT v.g, sum(c * {_norm.format(m='m', sd='sd')}) AS l1 FROM {name}_v v JOIN {name}_m m ON m.g = v.g GROUP BY v.g) a JOIN {name}_l l ON l.g = a.g JOIN {name} f ON f.g = a.g)"""


def gain_sql(name: str, series: str) -> str:
    """Table name(capture, gain) of series(capture, t, k, v)."""
    return f"""{name}_d AS (SELECT capture, k, t, v - lag(v) OVER (PARTITION BY capture, k ORDER BY t) AS d, count(*) OVER (PARTITION BY capture, k) AS m FROM {series}),
{name}_e AS (SELECT *, d - avg(d) OVER (PARTITION BY capture, k) AS e FROM {name}_d WHERE d IS NOT NULL AND m > 2),
{name}_f AS (SELECT *, lead(e) OVER (PARTITION BY capture, k ORDER BY t) AS f FROM {name}_e),
{name}_q AS (SELECT capture, k, CASE WHEN avg(e * e) > 0 THEN sum(e * f) / ((count(*) - 1) * avg(e * e)) END AS rho FROM {name}_f GROUP BY 1, 2),
{name}_s AS (SELECT capture, sum(greatest(0, -rho)) AS noise, sum(greatest(0, 1 + 2 * least(0, rho))) AS drift FROM {name}_q WHERE rho IS NOT NULL GROUP BY 1),
{name}_x AS (SELECT *, (drift / nullif(noise, 0) + sqrt(pow(drift / nullif(noise, 0), 2) + 4 * drift / nullif(noise, 0))) / 2 AS x FROM {name}_s),
{name} AS (SELECT c.capture, coalesce(CASE WHEN noise = 0 THEN 1 WHEN drift = 0 THEN 0 ELSE x / (x + 1) END, 1) AS gain FROM (SELECT DISTINCT capture FROM {series}) c LEFT JOIN {name}_x x ON x.capture = c.capture)"""


def smooth_sql(name: str, series: str, gains: str) -> str:
    """Table name(capture, t, k, v): series(capture, t, k, v) as a filtered sequence, in closed form."""
    return f"""{name}_i AS (SELECT *, row_number() OVER (PARTITION BY capture, k ORDER BY t) - 1 AS i FROM {series}),
{name} AS (SELECT a.capture, a.t, a.k, sum(CASE WHEN b.i = 0 THEN pow(1 - gain, a.i) ELSE gain * pow(1 - gain, a.i - b.i) END * b.v) AS v
  FROM {name}_i a JOIN {name}_i b ON a.capture = b.capture AND a.k = b.k AND b.i <= a.i JOIN {gains} g ON g.capture = a.capture GROUP BY 1, 2, 3)"""


# Mixture fits


_EVENTS = "ev AS (SELECT 0 AS one, least(1.0, value / 500) AS s FROM events)"


@query(f"WITH RECURSIVE {_EVENTS}, {em_sql('f', 'one', 'ev')} SELECT round(mf, 5) AS mf, round(mb, 5) AS mb, round(pb, 5) AS pb, round(sd, 5) AS sd FROM f", on_cube=False)
def j01_mixture_fit(spark, sf_dir):
    from voxlake.operators import fits

    x = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.least(F.lit(1.0), F.col("value") / 500).alias("s"))
    return rounded(fits.mixture(x, "s"), 5)


CAPTURES_SQL = f"{em_sql('cf', 't // side')}, {likelihood_sql('cf')}"
FRAMES_SQL = em_sql("ff", "t")
FILTER_SQL = f"""{FRAMES_SQL}, st AS (SELECT g // (SELECT n FROM side) AS capture, g AS t, unnest([0, 1, 2, 3]) AS k, unnest([mf, mb, ln(pb / (1 - pb)), ln(sd)]) AS v FROM ff),
{gain_sql('fg', 'st')}, {smooth_sql('fs', 'st', 'fg')},
fit AS (SELECT t, capture, mf, mb, 1 / (1 + exp(-pb)) AS pb, exp(sd) AS sd FROM (SELECT t, capture, max(CASE WHEN k = 0 THEN v END) AS mf, max(CASE WHEN k = 1 THEN v END) AS mb, max(CASE WHEN k = 2 THEN v END) AS pb, max(CASE WHEN k = 3 THEN v END) AS sd FROM fs GROUP BY 1, 2))"""
_tau = "(sd * sd / (mf - mb))"
SHARE_SQL = f"""{CAPTURES_SQL}, {FILTER_SQL}, sh AS (SELECT c.*, two_phase, CASE WHEN two_phase AND mf > mb THEN 1 / (1 + exp((s - ((mf + mb) / 2 + {_tau} * ln(pb / (1 - pb)))) / {_tau})) ELSE 0 END AS p
  FROM cube c JOIN fit USING (t) JOIN cf_b b ON b.g = c.t // c.side)"""


def shares(cells):
    """Each cell with share, the back phase's, from its frame's filtered fit."""
    captures, fits = solve.phases(keyed(cells))
    return solve.covered(keyed(cells), captures, fits)


@query(f"+ {CAPTURES_SQL} SELECT g AS capture, round(bic_one, 3) AS bic_one, round(bic_two, 3) AS bic_two, two_phase FROM cf_b")
def d02_two_phase(cells):
    """Whether a capture's fit of two phases beats one phase by BIC, its front lying above its back."""
    return rounded(solve.phases(keyed(cells))[0].select("capture", "bic_one", "bic_two", "two_phase"), 3)


@query(f"+ {FRAMES_SQL} SELECT c.t, coalesce(NOT mf > mb, true) AS degenerate FROM (SELECT DISTINCT t FROM cube) c LEFT JOIN ff ON g = t")
def d03_degenerate_fit(cells):
    """Whether the two phases of a frame's fit coincide."""
    return mixtures.fit(mixtures.counted(cells, "s", ["t"])).select("t", mixtures.degenerate().alias("degenerate"))


@query(f"+ {FRAMES_SQL}, {likelihood_sql('ff')} SELECT g AS t, round(ll, 3) AS ll FROM ff_l")
def j03_log_likelihood(cells):
    fitted = mixtures.fit(mixtures.counted(cells, "s", ["t"])).where("fit is not null")
    return rounded(fitted.select("t", mixtures.log_likelihood("fit").alias("ll")), 3)


_blocks = "bl AS (SELECT t // side AS capture, t // 4 AS bt, y // 4 AS by_, x // 4 AS bx, avg(s) AS s, greatest(0, avg(s * s) - avg(s) * avg(s)) AS w FROM cube GROUP BY ALL)"


@query(f"+ {_blocks}, {em_sql('bf', 'capture', 'bl')}, w AS (SELECT capture, avg(w) AS w FROM bl GROUP BY 1) SELECT capture, round(mf, 5) AS mf, round(mb, 5) AS mb, round(sqrt(sd * sd + w), 5) AS sd FROM bf JOIN w ON capture = g")
def j04_variance_lift(cells):
    """The fit of each capture's block means, widened by the mean variance within blocks of side 4."""
    block = [F.expr(f"{c} div 4").alias(f"b{c}") for c in ("t", "y", "x")]
    means = keyed(cells).groupBy("capture", *block).agg(F.avg("s").alias("s"), F.greatest(F.lit(0.0), F.avg(F.col("s") * F.col("s")) - F.avg("s") * F.avg("s")).alias("w"))
    fitted = mixtures.fit(mixtures.counted(means, "s", ["capture"])).join(means.groupBy("capture").agg(F.avg("w").alias("w")), "capture")
    return rounded(fitted.withColumn("fit", mixtures.lifted(F.col("w"))).select("capture", "fit.mf", "fit.mb", "fit.sd"), 5)


@query(f"+ {FILTER_SQL} SELECT t, round(mf, 4) AS mf, round(mb, 4) AS mb, round(pb, 4) AS pb, round(sd, 4) AS sd, round(gain, 4) AS gain FROM fit JOIN fg USING (capture)")
def g03_mixture_filter(cells):
    """Each frame's fit as its capture's filtered sequence: means, the weight's logit and the deviation's logarithm."""
    return rounded(solve.phases(keyed(cells))[1].select("t", "fit.*", "gain"), 4)


@query(f"+ {FILTER_SQL} SELECT t, round({_tau}, 4) AS tau, round((mf + mb) / 2 + {_tau} * ln(pb / (1 - pb)), 4) AS crossover, round(1 / (1 / 1.5::DOUBLE + ((mf + mb) / 2 + {_tau} * ln(pb / (1 - pb))) * (4 - 1 / 1.5::DOUBLE)), 4) AS metres FROM fit WHERE mf > mb")
def n39_background_temperature(cells):
    """The width and the place of the transition between the phases of each frame, and that place in metres."""
    at = mixtures.crossover()
    rows = solve.phases(keyed(cells))[1].where(~mixtures.degenerate())
    return rounded(rows.select("t", mixtures.temperature().alias("tau"), at.alias("crossover"), (1 / (1 / 1.5 + at * (4 - 1 / 1.5))).alias("metres")), 4)


@query(f"+ {SHARE_SQL} SELECT t, y, x, round(p, 4) AS soft, CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS hard FROM sh")
def c217_role_coverage(cells):
    """The back phase's share of each cell, and what remains of it without bleed, by its frame's filtered fit."""
    return rounded(shares(cells).select("t", "y", "x", F.col("share").alias("soft"), F.when(F.col("share") < 0.5, 0).otherwise(1).alias("hard")), 4)


@query(f"+ {FRAMES_SQL} SELECT t, y, x, round(1 / (1 + exp((s - ((mf + mb) / 2 + {_tau} * ln(pb / (1 - pb)))) / {_tau})), 4) AS pull FROM cube JOIN ff ON ff.g = cube.t WHERE mf > mb")
def c218_logistic_pull(cells):
    """The posterior of the back phase at each cell's depth, by its frame's own fit; degenerate frames are left out."""
    fitted = mixtures.fit(mixtures.counted(cells, "s", ["t"])).select("t", "fit").where(~mixtures.degenerate())
    return rounded(cells.join(fitted, "t").select("t", "y", "x", mixtures.pull(F.col("s")).alias("pull")), 4)


@query(f"+ {SHARE_SQL} SELECT t, count(*) FILTER (p < 1 / 32.0::DOUBLE) AS face, count(*) FILTER (p >= 1 / 32.0::DOUBLE AND p <= 31 / 32.0::DOUBLE) AS band, count(*) FILTER (p > 31 / 32.0::DOUBLE) AS mirror FROM sh GROUP BY t")
def n43_role(cells):
    """How many cells of a frame are face, band and mirror, by their share."""
    p = F.col("share")
    return shares(cells).groupBy("t").agg(F.count_if(p < 1 / 32).alias("face"), F.count_if(p.between(1 / 32, 31 / 32)).alias("band"), F.count_if(p > 31 / 32).alias("mirror"))


@query(f"+ {SHARE_SQL} SELECT t, round(avg((p > 1 / 32.0::DOUBLE)::INT), 6) AS phi FROM sh GROUP BY t")
def n45_background_fraction(cells):
    return rounded(shares(cells).groupBy("t").agg(F.avg((F.col("share") > 1 / 32).cast("int")).alias("phi")))


# Axes and trees of each frame's colours


MOMENTS_SQL = f"""{LAB_SQL}, mo AS (SELECT t, avg(ll) AS ll, avg(la) AS la, avg(lb) AS lb, {', '.join(f'avg(l{a} * l{b}) - avg(l{a}) * avg(l{b}) AS {c}' for c, a, b in zip(COVARIANCE, 'lllaab', 'lababb'))} FROM lab GROUP BY t)"""


def _jacobi_sql() -> str:
    """Tables j (all rotations) and ax(t, n, variance, d0, d1, d2): the axes of mo's covariances, n from 0 by falling variance."""
    pick = lambda cases: f"CASE w WHEN 0 THEN {cases[0]} WHEN 1 THEN {cases[1]} ELSE {cases[2]} END"
    pairs = ((0, 1), (0, 2), (1, 2))
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    pp, qq, pq = (pick([f(*p) for p in pairs]) for f in (lambda p, q: a(p, p), lambda p, q: a(q, q), lambda p, q: a(p, q)))

    def entry(i: int, j: int) -> str:
        out = []
        for p, q in pairs:
            r = 3 - p - q
            if (i, j) == (p, p):
                out.append("c * c * pp + 2 * s * c * pq + s * s * qq")
            elif (i, j) == (q, q):
                out.append("s * s * pp - 2 * s * c * pq + c * c * qq")
            elif (i, j) == (p, q):
                out.append("0")
            elif (i, j) == (r, r):
                out.append(a(r, r))
            elif p in (i, j):
                out.append(f"c * {a(r, p)} + s * {a(r, q)}")
            else:
                out.append(f"c * {a(r, q)} - s * {a(r, p)}")
        return pick(out)

    def turned(k: int, j: int) -> str:
        return pick([f"c * v{k}{p} + s * v{k}{q}" if j == p else f"c * v{k}{q} - s * v{k}{p}" if j == q else f"v{k}{j}" for p, q in pairs])

    fields = [f"{entry(i, j)} AS a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"{turned(k, j)} AS v{k}{j}" for k in range(3) for j in range(3)]
    lead = "CASE WHEN abs(d0) > 1e-9 THEN d0 WHEN abs(d1) > 1e-9 THEN d1 ELSE d2 END"
    three = " UNION ALL ".join(f"SELECT t, a{k}{k} AS variance, {k} AS k, v0{k} AS d0, v1{k} AS d1, v2{k} AS d2 FROM jl" for k in range(3))
    return f"""j AS (SELECT t, 0 AS k, {', '.join(f'{c} AS a{c[1:]}' for c in COVARIANCE)}, {', '.join(f'{float(i == j)}::DOUBLE AS v{i}{j}' for i in range(3) for j in range(3))} FROM mo
  UNION ALL SELECT t, k + 1, {', '.join(fields)} FROM (SELECT *, sin(th) AS s, cos(th) AS c FROM (SELECT *, CASE WHEN abs(pp - qq) < 1e-15 THEN pi() / 4 ELSE 0.5 * atan(2 * pq / (pp - qq)) END AS th
  FROM (SELECT *, {pp} AS pp, {qq} AS qq, {pq} AS pq FROM (SELECT *, CASE WHEN abs(a12) >= greatest(abs(a01), abs(a02)) THEN 2 WHEN abs(a02) >= abs(a01) THEN 1 ELSE 0 END AS w FROM j WHERE k < 50 AND greatest(abs(a01), abs(a02), abs(a12)) >= 1e-12))))),
jl AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY t ORDER BY k DESC) = 1),
ax AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY variance DESC, k) - 1 AS n, variance, d0 * sign AS d0, d1 * sign AS d1, d2 * sign AS d2 FROM (SELECT *, CASE WHEN {lead} < 0 THEN -1 ELSE 1 END AS sign FROM ({three})))"""


AXES_SQL = f"{MOMENTS_SQL}, {_jacobi_sql()}"
_wide = [f"max(CASE WHEN n = {n} THEN {c} END) AS {c}_{n}" for n in range(3) for c in ("variance", "d0", "d1", "d2")]
TREE_SQL = f"""{AXES_SQL}, fr AS (SELECT t, {', '.join(_wide)} FROM ax GROUP BY t),
ge AS (SELECT t, 0 AS g, greatest(0, variance_0) AS v0, greatest(0, variance_1) AS v1, greatest(0, variance_2) AS v2, 0 AS w, 0::DOUBLE AS v FROM fr UNION ALL
  SELECT t, g + 1, CASE WHEN a = 0 THEN v0 * h ELSE v0 END, CASE WHEN a = 1 THEN v1 * h ELSE v1 END, CASE WHEN a = 2 THEN v2 * h ELSE v2 END, a, CASE a WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END
  FROM (SELECT *, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS a, 1 - 2 / pi() AS h FROM ge WHERE g < 7)),
sp AS (SELECT ge.t, g, {', '.join(f'sqrt(2 / pi()) * sqrt(v) * d{k} AS s{k}' for k in range(3))} FROM ge JOIN ax ON ax.t = ge.t AND ax.n = ge.w WHERE g > 0),
nd AS (SELECT a.range AS depth, b.range AS node FROM range(8) a, range(128) b WHERE b.range < (1 << a.range)),
tr AS (SELECT m.t, depth, node, {', '.join(f'any_value({c}) + coalesce(sum(CASE WHEN (node >> (depth - g)) & 1 = 1 THEN s{k} ELSE -s{k} END), 0) AS {c}' for k, c in enumerate(LAB))}
  FROM mo m CROSS JOIN nd LEFT JOIN sp ON sp.t = m.t AND g <= depth GROUP BY m.t, depth, node)"""


def frame_moments(cells):
    return pairtree.moments(lab_cells(cells), ["t"], F.lit(1.0)).withColumn("axes", pairtree.axes())


@query(f"+ {AXES_SQL} SELECT t, CAST(n AS INT) AS n, round(variance, 7) AS variance, round(d0, 4) AS d0, round(d1, 4) AS d1, round(d2, 4) AS d2 FROM ax")
def j05_principal_axes(cells):
    """Each frame's axes by rotations of its covariance, with canonical signs (J05, J06)."""
    rows = frame_moments(cells).select("t", F.posexplode("axes").alias("n", "x")).select("t", "n", *[F.round(f"x.{c}", 7 if c == "variance" else 4).alias(c) for c in ("variance", "d0", "d1", "d2")])
    return rows.select("t", "n", *[(F.col(c) + 0.0).alias(c) for c in ("variance", "d0", "d1", "d2")])


@query(f"+ {AXES_SQL}, la AS (SELECT range AS level, [1, 1, 2, 4, 8, 16, 32, 64][range + 1] AS n FROM range(8)), pt AS (SELECT level, n, unnest(range(n)) AS j FROM la) SELECT m.t, CAST(level AS INT) AS level, CAST(j AS INT) AS j, "
       + ", ".join(f"round({c} + 2 * level / 7.0::DOUBLE * (cos(2 * pi() * j / pt.n) * greatest(1e-3, sqrt(greatest(0, a.variance))) * a.d{k} + sin(2 * pi() * j / pt.n) * greatest(1e-3, sqrt(greatest(0, b.variance))) * b.d{k}), 4) AS {c[1]}" for k, c in enumerate(LAB))
       + " FROM mo m JOIN ax a ON a.t = m.t AND a.n = 0 JOIN ax b ON b.t = m.t AND b.n = 1 CROSS JOIN pt")
def j07_shell_points(cells):
    return rounded(pairtree.shells(frame_moments(cells), ["t"]).select("t", "level", "j", *[F.col(c).alias(c[1]) for c in LAB]), 4)


@query(f"+ {TREE_SQL} SELECT t, CAST(depth AS INT) AS depth, CAST(node AS INT) AS node, {', '.join(f'round({c}, 4) AS {c[1]}' for c in LAB)} FROM tr")
def j08_pair_tree(cells):
    """All 255 nodes of each frame's tree."""
    frames = frame_moments(cells).withColumn("steps", pairtree.generations())
    return rounded(pairtree.nodes(frames, ["t"]).select("t", "depth", "node", *[F.col(c).alias(c[1]) for c in LAB]), 4)


@query(f"+ {TREE_SQL}, lf AS (SELECT a.t, a.node AS leaf, b.node, sqrt(pow(a.ll - b.ll, 2) + pow(a.la - b.la, 2) + pow(a.lb - b.lb, 2)) AS d FROM tr a JOIN tr b ON a.t = b.t AND a.depth = 7 AND b.depth = 4 AND b.node = a.node >> 3) SELECT t, CAST(node AS INT) AS node, count(*) AS leaves, round(avg(d), 4) AS spread FROM lf GROUP BY 1, 2")
def j09_truncated_spread(cells):
    """How far the eight leaves of a depth-4 node lie from it, before they are displayed: what a truncated index loses."""
    frames = frame_moments(cells).withColumn("steps", pairtree.generations())
    leaf = pairtree.nodes(frames, ["t"], 7, 7).select("t", F.col("node").alias("leaf"), F.struct(*LAB).alias("own")).withColumn("node", F.shiftright("leaf", 3))
    mean = pairtree.nodes(frames, ["t"], 4, 4).select("t", "node", F.struct(*LAB).alias("mean"))
    d = F.sqrt(colour.distance2(*[tuple(F.col(f"{s}.{c}") for c in LAB) for s in ("own", "mean")]))
    return rounded(leaf.join(mean, ["t", "node"]).groupBy("t", "node").agg(F.count("*").alias("leaves"), F.avg(d).alias("spread")), 4)


# The whole solve; tests hold it against plain loops


_solved: dict[DataFrame, solve.Solve] = {}


def solved(cells) -> solve.Solve:
    """The solve of a cube, kept for the session: its tables lie in the checkpoint folder."""
    if cells not in _solved:
        _solved[cells] = solve.solve(keyed(cells))
    return _solved[cells]


@query(None)
def j10_colour_table(cells):
    """All 256 displayed colours of each frame: the leaves, and the grounds mirrored."""
    return solved(cells).table


@query(None)
def j11_frame_solve(cells):
    """What generates each frame's table: filtered moments, the ground law and the canonical leaves of its nodes."""
    s = solved(cells)
    canon = s.canonical.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("node", "leaf"))).getField("leaf").alias("canonical"))
    return rounded(s.frames.select("t", *LAB, *COVARIANCE, "gain", "delta_l", "alpha", "beta", "rot_a", "rot_b", "fitted").join(canon, "t"), 6)


@query(None)
def j12_capture_solve(cells):
    """Every cell's index after three-rung assignment and the ordered dither."""
    return solved(cells).cells.select("t", "y", "x", "index")


@query(None)
def d04_ordered_dither(cells):
    """How many cells of each frame's band stay, turn to the figure side or take their block's node, by the dither."""
    rows = solved(cells).cells.where(~F.col("figure"))
    turned = descent.bayer(F.col("y"), F.col("x")) >= F.col("pull")
    return rows.groupBy("t").agg(F.count("*").alias("band"), F.count_if(turned).alias("turned"), F.count_distinct(F.when(~turned, F.col("index"))).alias("pooled_codes"))


@query(None)
def e02_assign_roles(cells):
    """The nearest of all 128 leaves for a figure's cell, its mirror for others."""
    rows = solved(cells).assigned(best=descent.all_leaves)
    return rows.select("t", "y", "x", descent.roles(F.col("best"), F.col("figure")).cast("int").alias("code"))


def _agreement(rows):
    """Against the exhaustive search: cells of equal leaf, and the excess of squared distance."""
    return rounded(rows.groupBy("t").agg(F.count("*").alias("cells"), F.avg((F.col("leaf") == F.col("best")).cast("int")).alias("agreement"), F.avg(F.col("d") - F.col("best_d")).alias("excess")), 8)


@query(None)
def e03_three_rungs(cells):
    """The three-rung descent beside the exhaustive search."""
    return _agreement(solved(cells).assigned(best=descent.all_leaves))


@query(None)
def e04_greedy_descent(cells):
    """The greedy descent by means beside the exhaustive search."""
    rows = solved(cells).assigned(best=descent.all_leaves, greedy=descent.by_means)
    return _agreement(rows.select("t", "best", "best_d", F.col("greedy").alias("leaf"), F.col("greedy_d").alias("d")))


@query(None)
def e05_exhaustive_leaf(cells):
    rows = solved(cells).assigned(best=descent.all_leaves)
    return rounded(rows.select("t", "y", "x", F.col("best").alias("leaf"), F.col("best_d").alias("d")), 8)


@query(None)
def g04_stats_filter(cells):
    """Each frame's filtered colour moments, and how far its first axis has turned since the frame before."""
    own = Window.partitionBy("capture").orderBy("t")
    first = lambda k: F.col("axes")[0][f"d{k}"]
    turn = sum((first(k) * F.lag(first(k)).over(own) for k in range(1, 3)), first(0) * F.lag(first(0)).over(own))
    return rounded(solved(cells).frames.select("t", *LAB, *COVARIANCE, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turn))).alias("turn")), 6)


@query("SELECT t // 2 AS bt, y // 2 AS by_, x // 2 AS bx, w, " + ", ".join(f"round(sum((CASE WHEN bit_count((w & (4 * (t % 2) + 2 * (y % 2) + x % 2))::INT) % 2 = 0 THEN 0.125 ELSE -0.125 END) * {c}), 9) AS {c}" for c in "rgb") + " FROM cube, (SELECT range AS w FROM range(8)) GROUP BY ALL HAVING count(*) = 8")
def f80_walsh_features(cells):
    """The eight signed means of each whole 2 x 2 x 2 block, for three channels."""
    corner = (F.col("t") % 2 * 4 + F.col("y") % 2 * 2 + F.col("x") % 2).cast("int")
    block = [F.expr(f"cast({c} div 2 as int)").alias(n) for c, n in zip("tyx", ("bt", "by_", "bx"))]
    modes = cells.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    sign = 0.125 - 0.25 * (F.bit_count(F.col("w").cast("int").bitwiseAND(corner)) % 2)
    sums = modes.groupBy(*block, "w").agg(F.count("*").alias("n"), *[F.sum(sign * F.col(c)).alias(c) for c in "rgb"])
    return rounded(sums.where("n = 8").drop("n"), 9)
