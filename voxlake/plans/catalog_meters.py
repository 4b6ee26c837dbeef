"""Queries of ground colours, memory colours, roles, tiles, meters and frame series, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxlake.functions import colour, lattice
from voxlake.operators import bonds, codebook, energy, ground

from .catalog import B8, HIST_SQL, LAB_SQL, SPIN_SQL, WIDE_SQL, _book, _gamma, _h, _lv, _m, _others, _p, _plane, frames, mixed_spins, query, rgb, rounded, unit
from .catalog_more import lab_cells
from .cube import SIDE, capture


def lab():
    return unit("ll", "la", "lb")


def lin_sql(light: str, a: str, b: str) -> list[str]:
    """Linear r, g, b of an OKLab colour."""
    lms = [f"pow({e}, 3)" for e in _m(colour.OKLAB_LMS_BACK, (f"({light})", f"({a})", f"({b})"))]
    return _m(colour.OKLAB_RGB_BACK, lms)


def clamp_sql(source: str) -> str:
    """Tables g0 to g40 from source(gl, ga, gb, ...): g40 has the share of chroma that fits, lo."""
    fits = lambda share: " AND ".join(f"{e} BETWEEN -1e-6 AND 1 + 1e-6" for e in lin_sql("gl", f"ga * ({share})", f"gb * ({share})"))
    steps = [f"g0 AS (SELECT *, CASE WHEN {fits('1')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, {fits('1')} AS whole FROM {source})"]
    for k in range(1, 41):
        steps.append(f"g{k} AS (SELECT * REPLACE (CASE WHEN NOT whole AND {fits(f'lo + {0.5**k!r}::DOUBLE')} THEN lo + {0.5**k!r}::DOUBLE ELSE lo END AS lo) FROM g{k - 1})")
    return ",\n".join(steps)


# Ground colours

PRIM_SQL = f"{LAB_SQL}, prim AS (SELECT t, idx, avg(ll) AS ll, avg(la) AS la, avg(lb) AS lb FROM lab GROUP BY t, idx)"
BACK_SQL = """bsum AS (SELECT t, sum(w * ll) / sum(w) AS mean_l, sum(w * c) / sum(w) AS mean_ln_c, sum(w * c * c) / sum(w) AS m2, sum(w * la) AS ba, sum(w * lb) AS bb
  FROM (SELECT *, 1 - s AS w, ln(sqrt(la * la + lb * lb)) AS c FROM lab WHERE s < 1) GROUP BY t),
back AS (SELECT t, mean_l, mean_ln_c, sqrt(greatest(0, m2 - mean_ln_c * mean_ln_c)) AS sd_ln_c, ba / sqrt(ba * ba + bb * bb) AS hue_a, bb / sqrt(ba * ba + bb * bb) AS hue_b FROM bsum)"""
GROUND_SQL = f"""{PRIM_SQL}, {BACK_SQL}, psum AS (SELECT t, avg(ll) AS pl, avg(c) AS m, avg(c * c) AS m2, sum(la) AS pa, sum(lb) AS pb FROM (SELECT *, ln(sqrt(la * la + lb * lb)) AS c FROM prim) GROUP BY t),
gsum AS (SELECT *, CASE WHEN m2 - m * m > 0 THEN sd_ln_c / sqrt(m2 - m * m) ELSE {ground.PRIOR_SLOPE} END AS beta, hue_a * pa + hue_b * pb AS ra, hue_b * pa - hue_a * pb AS rb FROM psum JOIN back USING (t)),
gm AS (SELECT t, mean_l - pl AS delta_l, mean_ln_c - beta * m AS alpha, beta, ra / sqrt(ra * ra + rb * rb) AS rot_a, rb / sqrt(ra * ra + rb * rb) AS rot_b FROM gsum)"""


def primaries(cells):
    """(t, idx, ll, la, lb): the mean colour of each entry that a frame uses."""
    return lab_cells(cells, "idx").groupBy("t", "idx").agg(*[F.avg(c).alias(c) for c in ("ll", "la", "lb")])


def grounded(cells):
    """primaries() beside their frame's ground moments."""
    back = ground.background_moments(lab_cells(cells, "s"), 1 - F.col("s"), ["t"])
    return primaries(cells).join(ground.ground_moments(primaries(cells), back, ["t"]), "t")


@query(f"+ {LAB_SQL}, {BACK_SQL} SELECT t, round(mean_l, 6) AS mean_l, round(mean_ln_c, 6) AS mean_ln_c, round(sd_ln_c, 6) AS sd_ln_c, round(hue_a, 6) AS hue_a, round(hue_b, 6) AS hue_b FROM back")
def f03_background_moments(cells):
    return rounded(ground.background_moments(lab_cells(cells, "s"), 1 - F.col("s"), ["t"]))


@query(f"+ {GROUND_SQL} SELECT t, round(delta_l, 6) AS delta_l, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM gm")
def f04_ground_moments(cells):
    return rounded(grounded(cells).select("t", "delta_l", "alpha", "beta").distinct())


@query(f"+ {GROUND_SQL} SELECT t, round(rot_a, 6) AS rot_a, round(rot_b, 6) AS rot_b FROM gm")
def c15_hue_rotation_fit(cells):
    return rounded(grounded(cells).select("t", "rot_a", "rot_b").distinct())


@query(f"+ {GROUND_SQL} SELECT t, idx, round(ll + delta_l, 6) AS l, round(0 - la, 6) AS a, round(0 - lb, 6) AS b FROM prim JOIN gm USING (t)")
def c16_balanced_ground(cells):
    return rounded(grounded(cells).select("t", "idx", *[v.alias(n) for n, v in zip("lab", ground.balanced_ground(lab()))]))


_fitted = "(SELECT t, idx, ll + delta_l AS l, la * rot_a - lb * rot_b AS a, la * rot_b + lb * rot_a AS b, exp(alpha + beta * ln(sqrt(la * la + lb * lb))) / sqrt(la * la + lb * lb) AS k FROM prim JOIN gm USING (t))"


@query(f"+ {GROUND_SQL} SELECT t, idx, round(l, 6) AS l, round(a * k, 6) AS a, round(b * k, 6) AS b FROM {_fitted}")
def c17_fitted_ground(cells):
    return rounded(grounded(cells).select("t", "idx", *[v.alias(n) for n, v in zip("lab", ground.fitted_ground(lab()))]))


_bytes = ", ".join(
    f"{B8.format(c=_gamma.format(c=f'least(1, greatest(0, {e}))'))} AS {n}" for n, e in zip("rgb", lin_sql("gl", "ga * lo", "gb * lo"))
)


@query(f"+ {GROUND_SQL}, balanced AS (SELECT t, idx, least(1, greatest(0, ll + delta_l)) AS gl, 0 - la AS ga, 0 - lb AS gb FROM prim JOIN gm USING (t)), {clamp_sql('balanced')} SELECT t, idx, {_bytes} FROM g40")
def c18_ground_bytes(cells):
    light, a, b = ground.balanced_ground(lab())
    inside = grounded(cells).select("t", "idx", F.least(F.lit(1.0), F.greatest(F.lit(0.0), light)).alias("ll"), a.alias("la"), b.alias("lb"))
    return ground.chroma_clamp(inside).select("t", "idx", *[v.alias(n) for n, v in zip("rgb", colour.srgb8(lab()))])


@query(f"+ {WIDE_SQL}, source AS (SELECT t, y, x, ll AS gl, la AS ga, lb AS gb FROM wide), {clamp_sql('source')} SELECT t, y, x, round(ga * lo, 6) AS a, round(gb * lo, 6) AS b FROM g40")
def c09_chroma_clamp(cells):
    wide = lab_cells(cells).select("t", "y", "x", "ll", (F.col("la") * 1.3).alias("la"), (F.col("lb") * 1.3).alias("lb"))
    return rounded(ground.chroma_clamp(wide).select("t", "y", "x", F.col("la").alias("a"), F.col("lb").alias("b")))


@query(f"+ {PRIM_SQL} SELECT t, round(avg(la), 6) AS a, round(avg(lb), 6) AS b, round(avg(la * la + lb * lb), 6) AS chroma2 FROM prim GROUP BY t")
def f81_net_cast(cells):
    return rounded(primaries(cells).groupBy("t").agg(F.avg("la").alias("a"), F.avg("lb").alias("b"), F.avg(F.col("la") * F.col("la") + F.col("lb") * F.col("lb")).alias("chroma2")))


@query(f"+ {PRIM_SQL} SELECT t, idx // 4 AS node, round(avg(ll), 6) AS l, round(avg(la), 6) AS a, round(avg(lb), 6) AS b FROM prim GROUP BY t, idx // 4")
def f83_truncated_nodes(cells):
    node = F.expr("cast(idx div 4 as int)").alias("node")
    return rounded(primaries(cells).groupBy("t", node).agg(*[F.avg(c).alias(n) for c, n in zip(("ll", "la", "lb"), "lab")]))


@query(f"+ {PRIM_SQL} SELECT c.t, y, x, round(ll, 6) AS l, round(la, 6) AS a, round(lb, 6) AS b FROM cube c JOIN prim p ON p.t = c.t AND p.idx = c.idx")
def e08_palette_lookup(cells):
    return rounded(cells.select("t", "y", "x", "idx").join(primaries(cells), ["t", "idx"]).select("t", "y", "x", *[c.alias(n) for c, n in zip(lab(), "lab")]))


# Memory colours: stand-in anchors (measured, remembered), the remembered of the same hue and greater chroma.

ANCHORS = (((0.7, 0.04, 0.04), (0.7, 0.05, 0.05)), ((0.65, -0.03, -0.08), (0.65, -0.039, -0.104)), ((0.55, -0.08, 0.06), (0.55, -0.1, 0.075)))
TOLERANCE = (0.004, 0.001, 0.006)  # of a, of both, of b
GAUSS_SQL = f"{LAB_SQL}, g AS (SELECT t, avg(ll) AS ml, avg(la) AS ma, avg(lb) AS mb, var_pop(la) AS caa, covar_pop(la, lb) AS cab, var_pop(lb) AS cbb FROM lab GROUP BY t)"


def gaussians(cells):
    own = (F.avg("ll").alias("ml"), F.avg("la").alias("ma"), F.avg("lb").alias("mb"))
    return lab_cells(cells).groupBy("t").agg(*own, F.var_pop("la").alias("caa"), F.covar_pop("la", "lb").alias("cab"), F.var_pop("lb").alias("cbb"))


def mahalanobis(da, db, caa, cab, cbb):
    """Squared distance of (da, db) under a 2 x 2 covariance; 0 where that has no inverse."""
    det = caa * cbb - cab * cab
    return F.when(det > 0, (cbb * da * da - cab * da * db * 2 + caa * db * db) / det).otherwise(0.0)


_maha = "CASE WHEN {aa} * {bb} - {ab} * {ab} > 0 THEN ({bb} * ({da}) * ({da}) - 2 * {ab} * ({da}) * ({db}) + {aa} * ({db}) * ({db})) / ({aa} * {bb} - {ab} * {ab}) ELSE 0 END"


@query(f"+ {GAUSS_SQL} SELECT t, y, x, round({_maha.format(aa='caa', ab='cab', bb='cbb', da='la - ma', db='lb - mb')}, 5) AS d2 FROM lab JOIN g USING (t)")
def c29_mahalanobis(cells):
    both = lab_cells(cells).join(gaussians(cells), "t")
    return rounded(both.select("t", "y", "x", mahalanobis(F.col("la") - F.col("ma"), F.col("lb") - F.col("mb"), *unit("caa", "cab", "cbb")).alias("d2")), 5)


_own = dict(zip(("aa", "ab", "bb"), (f"{v!r}::DOUBLE" for v in TOLERANCE)))


@query(f"+ {LAB_SQL} SELECT t, y, x, {', '.join(f'round(exp(-0.5::DOUBLE * ({_maha.format(da=f"la - ({a!r}::DOUBLE)", db=f"lb - ({b!r}::DOUBLE)", **_own)})), 6) AS s{k}' for k, (_, (_, a, b)) in enumerate(ANCHORS))} FROM lab")
def c30_memory_similarity(cells):
    tolerance = [F.lit(v) for v in TOLERANCE]
    return rounded(lab_cells(cells).select("t", "y", "x", *[F.exp(mahalanobis(F.col("la") - a, F.col("lb") - b, *tolerance) * -0.5).alias(f"s{k}") for k, (_, (_, a, b)) in enumerate(ANCHORS)]))


_rows = ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for v in m + r)})" for k, (m, r) in enumerate(ANCHORS))
_reach = _maha.format(aa="caa", ab="cab", bb="cbb", da="ra - ma", db="rb - mb")


@query(f"""+ {GAUSS_SQL}, anchor(k, al, aa, ab, l2, a2, b2) AS (VALUES {_rows}), near AS (SELECT t, ml, ma, mb, caa, cab, cbb, l2 - al AS dl, ma + a2 - aa AS ra, mb + b2 - ab AS rb,
row_number() OVER (PARTITION BY t ORDER BY pow(ml - al, 2) + pow(ma - aa, 2) + pow(mb - ab, 2), k) AS n FROM g, anchor),
step AS (SELECT *, least(1, 0.05::DOUBLE / sqrt(greatest(1e-12, {_reach}))) AS kl FROM near WHERE n = 1)
SELECT t, round(ml + kl * dl, 6) AS l, round(ma + kl * (ra - ma), 6) AS a, round(mb + kl * (rb - mb), 6) AS b FROM step""")
def c31_memory_shift(cells):
    """Each frame's mean, moved towards the nearest anchor's remembered colour by at most 0.05 of its own spread."""
    mean = unit("ml", "ma", "mb")
    lits = lambda v: tuple(F.lit(c) for c in v)
    moves = [F.struct(colour.distance2(mean, lits(m)).alias("d"), F.lit(k).alias("k"), *[F.lit(q - p).alias(n) for n, p, q in zip("lab", m, r)]) for k, (m, r) in enumerate(ANCHORS)]
    step = gaussians(cells).withColumn("m", F.array_min(F.array(*moves)))
    kl = F.least(F.lit(1.0), 0.05 / F.sqrt(F.greatest(F.lit(1e-12), mahalanobis(F.col("m.a"), F.col("m.b"), *unit("caa", "cab", "cbb")))))
    return rounded(step.select("t", *[(c + kl * F.col(f"m.{n}")).alias(n) for c, n in zip(mean, "lab")]))


# Lattice, digests and metrics


@query("SELECT t, y, x, CAST((t % side) // (side // 4) AS INT) AS d, " + ", ".join(f"least(3, greatest(0, CAST(floor({c} * 4) AS INT))) AS {n}" for c, n in zip("rgb", "abc")) + " FROM cube")
def c208_quantize_floor(cells):
    level = lambda c: F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col(c) * 4).cast("int")))
    return cells.select("t", "y", "x", F.expr("cast((t % side) div (side div 4) as int)").alias("d"), *[level(c).alias(n) for c, n in zip("rgb", "abc")])


@query("+ p AS (SELECT t, y, x, " + ", ".join(f"{_p.format(k=k)} AS p{k}" for k in (1, 3, 5, 7)) + " FROM cube) SELECT t, y, x, CASE WHEN p1 >= greatest(p3, p5, p7) THEN 0 WHEN p3 >= greatest(p5, p7) THEN 1 WHEN p5 >= p7 THEN 2 ELSE 3 END AS epoch FROM p")
def c210_dominant_epoch(cells):
    p = F.array(*lattice.epoch_probabilities(F.col("t") % F.col("side"), F.col("s"), SIDE))
    return cells.select("t", "y", "x", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("epoch"))


@query("SELECT event_id, round(least(1, greatest(0, (1 / m - 1 / 1.5::DOUBLE) / (4 - 1 / 1.5::DOUBLE))), 6) AS signal FROM (SELECT event_id, value / 100 AS m FROM events WHERE value > 0)", on_cube=False)
def c213_metres_to_signal(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0").select("event_id", (F.col("value") / 100).alias("m"))
    return rounded(m.select("event_id", lattice.metres_to_signal(F.col("m")).alias("signal")))


_pull = "1 / (1 + exp((s - 0.5::DOUBLE) / 0.1::DOUBLE))"


def pull():
    return 1 / (1 + F.exp((F.col("s") - 0.5) / 0.1))


@query(f"SELECT t, y, x, CASE WHEN p < 1 / 32.0::DOUBLE OR p > 31 / 32.0::DOUBLE THEN 64 WHEN p < 3 / 32.0::DOUBLE OR p > 29 / 32.0::DOUBLE THEN 32 ELSE 16 END AS rung FROM (SELECT t, y, x, {_pull} AS p FROM cube)")
def c219_rung(cells):
    return cells.select("t", "y", "x", lattice.rung(pull()).alias("rung"))


@query(f"+ {LAB_SQL}, q AS (SELECT *, lead(ll) OVER w AS ql, lead(la) OVER w AS qa, lead(lb) OVER w AS qb FROM lab WINDOW w AS (PARTITION BY t, y ORDER BY x)) SELECT t, y, x, round(sqrt(pow(ll - ql, 2) + pow(la - qa, 2) + pow(lb - qb, 2)), 6) AS d FROM q WHERE ql IS NOT NULL")
def c22_colour_difference(cells):
    pairs = bonds.bonds(lab_cells(cells).select("t", "y", "x", F.struct("ll", "la", "lb").alias("c")), "c", ("x",))
    return rounded(pairs.select("t", "y", "x", F.sqrt(colour.distance2(unit("p.ll", "p.la", "p.lb"), unit("q.ll", "q.la", "q.lb"))).alias("d")))


@query("SELECT t, y, x, CAST((37 * idx + 11) % 256 AS INT) AS code, CAST(xor(idx, 85) AS INT) AS masked FROM cube")
def c234_relabel(cells):
    """Each index through a permutation of the 256, kept as a table, and by a mask."""
    table = cells.sparkSession.range(256).select(F.col("id").cast("int").alias("idx"), ((F.col("id") * 37 + 11) % 256).cast("int").alias("code"))
    return cells.join(F.broadcast(table), "idx").select("t", "y", "x", "code", F.col("idx").bitwiseXOR(F.lit(85)).alias("masked"))


@query("""+ n AS (SELECT t, y, x, lead(t) OVER w - t AS dt, lead(x) OVER w - x AS dx, (t + x) % 5 AS dy FROM cube WINDOW w AS (PARTITION BY y, idx ORDER BY t, x))
SELECT t, y, x, round(sqrt(dx * dx + dy * dy), 6) AS l2, CAST(abs(dx) + dy AS INT) AS l1, CAST(greatest(abs(dx), dy) AS INT) AS linf, round(sqrt(dx * dx + dy * dy + dt * dt), 6) AS voxel, round(sqrt(dx * dx + dy * dy + 0.5::DOUBLE * dt * dt), 6) AS weighted FROM n WHERE dx IS NOT NULL""")
def c236_metrics(cells):
    """Five metrics of the offset from a cell to its row's next cell of its colour, with a made offset of 0 to 4 along y."""
    w = Window.partitionBy("y", "idx").orderBy("t", "x")
    n = cells.select("t", "y", "x", (F.lead("t").over(w) - F.col("t")).alias("dt"), (F.lead("x").over(w) - F.col("x")).alias("dx"), ((F.col("t") + F.col("x")) % 5).alias("dy")).where("dx is not null")
    flat = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    t2 = F.col("dt") * F.col("dt")
    return rounded(n.select("t", "y", "x", F.sqrt(flat).alias("l2"), (F.abs("dx") + F.col("dy")).alias("l1"), F.greatest(F.abs("dx"), F.col("dy")).alias("linf"), F.sqrt(flat + t2).alias("voxel"), F.sqrt(flat + t2 * 0.5).alias("weighted")))


@query("+ n AS (SELECT t, y, x, r, lead(r) OVER w AS r2, s, lead(s) OVER w AS s2 FROM cube WINDOW w AS (PARTITION BY t // side, y, x ORDER BY t)), b AS (SELECT *, 0.24::DOUBLE * ((2 - least(s, s2)) / (2 - greatest(s, s2)) - 1) AS u FROM n WHERE r2 IS NOT NULL) SELECT t, y, x, round(r * r2 * (exp(-3.51::DOUBLE * u) - exp(-5.75::DOUBLE * u)), 6) AS urgency FROM b")
def c241_bond_urgency(cells):
    w = Window.partitionBy(capture(), "y", "x").orderBy("t")
    n = cells.select("t", "y", "x", "r", "s", F.lead("r").over(w).alias("r2"), F.lead("s").over(w).alias("s2")).where("r2 is not null")
    u = ((2 - F.least("s", "s2")) / (2 - F.greatest("s", "s2")) - 1) * 0.24
    return rounded(n.select("t", "y", "x", (F.col("r") * F.col("r2") * lattice.dissonance(u)).alias("urgency")))


@query(f"+ {HIST_SQL} SELECT t, round((8 - sum(-n / cells::DOUBLE * log2(n / cells::DOUBLE))) / 8, 6) AS meter FROM hist JOIN tot USING (t) WHERE n > 0 GROUP BY t")
def c243_rate_meter(cells):
    return rounded(energy.measures(energy.counts(cells, ["t"]), ["t"]).select("t", ((8 - F.col("h0")) / 8).alias("meter")))


# FNV-1a's 64-bit offset and prime; the prime is 2^40 + 435.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv(values):
    """FNV-1a of an array of bytes as 16 hex digits, by halves of 32 bits, so that no product leaves a long."""
    word = lambda v: F.lit(v).cast("long")
    mask = word(0xFFFFFFFF)

    def step(h, v):
        low = h["lo"].bitwiseXOR(v.cast("long").bitwiseAND(255))
        product = low * 435
        high = h["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(word(FNV_OFFSET >> 32).alias("hi"), word(FNV_OFFSET & 0xFFFFFFFF).alias("lo"))
    return F.aggregate(values, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


@query(f"+ d AS (SELECT t, y, list_reduce(list_concat([{FNV_OFFSET}::UHUGEINT], list(idx::UHUGEINT ORDER BY x)), lambda h, v: xor(h, v) * {FNV_PRIME}::UHUGEINT % 18446744073709551616::UHUGEINT) AS h FROM cube GROUP BY t, y) SELECT t, y, printf('%016x', h::UBIGINT) AS digest FROM d")
def c244_fnv_digest(cells):
    """The digest of each row of a frame (at most 64 cells)."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("x", "idx"))), lambda c: c["idx"])
    return cells.groupBy("t", "y").agg(fnv(row).alias("digest"))


# Phases, orders and edits


_bins = ", ".join(f"sum((least(7, CAST(floor(s * 8) AS INT)) = {k})::INT) AS n{k}" for k in range(8))


@query(f"SELECT t, n0 < n1 AND n1 < n2 AND n2 < n3 AND n3 < n4 AND n4 < n5 AND n5 > n6 AND n6 > n7 AS unimodal, n5 > n6 AND n6 > n7 AS falls FROM (SELECT t, {_bins} FROM cube GROUP BY t)")
def d08_unimodal_order(cells):
    """Whether a frame's eight depth counts rise strictly to the sixth, and fall strictly from there on."""
    level = F.least(F.lit(7), F.floor(F.col("s") * 8).cast("int"))
    n = cells.groupBy("t").agg(*[F.count_if(level == k).alias(f"n{k}") for k in range(8)])
    rise = reduce(lambda p, q: p & q, [F.col(f"n{k}") < F.col(f"n{k + 1}") for k in range(5)])
    falls = (F.col("n5") > F.col("n6")) & (F.col("n6") > F.col("n7"))
    return n.select("t", (rise & falls).alias("unimodal"), falls.alias("falls"))


_dials = {"fig": "idx % 9", "gnd": "CASE WHEN idx % 3 = 0 THEN idx % 10 ELSE 4 END", "coarse": "CASE WHEN idx % 5 = 0 THEN 1 ELSE 0 END", "mid": "0", "fine": "7"}
_edit = "edit AS (SELECT t, y, x, " + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in _dials.items()) + " FROM cube)"


def edits(cells):
    return cells.select("t", "y", "x", *[F.expr(f"cast({e} as int)").alias(n) for n, e in _dials.items()])


@query("+ " + _edit + " SELECT t, y, x, " + " AND ".join(f"{n} BETWEEN 0 AND 7" for n in _dials) + " AS representable FROM edit")
def d12_edit_representable(cells):
    return edits(cells).select("t", "y", "x", reduce(lambda p, q: p & q, [F.col(n).between(0, 7) for n in _dials]).alias("representable"))


@query("+ " + _edit + " SELECT t, y, x, CASE WHEN fig = 7 AND gnd = 4 AND coarse = 0 AND mid = 0 AND fine = 7 THEN 'identity' WHEN gnd <> 4 THEN 'ground' WHEN coarse <> 0 OR mid <> 0 OR fine <> 7 THEN 'octave' ELSE 'figure' END AS verdict FROM edit")
def d13_edit_supported(cells):
    """What an edit asks for: nothing, the figure dial alone (supported), the ground dial or the octaves (both are not)."""
    octaves = (F.col("coarse") != 0) | (F.col("mid") != 0) | (F.col("fine") != 7)
    rest = F.when(F.col("gnd") != 4, "ground").when(octaves, "octave")
    return edits(cells).select("t", "y", "x", rest.when(F.col("fig") == 7, "identity").otherwise("figure").alias("verdict"))


# Bonds and tiles


def lab_bonds(cells, frames=SIDE):
    """bonds() of colours with d2, the squared distance, and own, the place along the axis."""
    pairs = bonds.bonds(cells.select("t", "y", "x", F.struct("ll", "la", "lb").alias("c")), "c", frames=frames)
    return pairs.select("*", colour.distance2(unit("p.ll", "p.la", "p.lb"), unit("q.ll", "q.la", "q.lb")).alias("d2"), own_place())


def own_place():
    return F.when(F.col("axis") == "t", F.col("t")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("x")).alias("own")


def bonds_sql(table: str, frames: int = SIDE) -> str:
    parts = [f"SELECT t, y, x, {a} AS own, pow(ll - lead(ll) OVER w, 2) + pow(la - lead(la) OVER w, 2) + pow(lb - lead(lb) OVER w, 2) AS d2 FROM {table} WINDOW w AS (PARTITION BY {_others(a, frames)} ORDER BY {a})" for a in "tyx"]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE d2 IS NOT NULL)"


@query(f"+ {LAB_SQL} SELECT count(*) AS bonds, round(sum(d2), 3) AS energy FROM {bonds_sql('lab')}")
def e12_cube_energy(cells):
    return rounded(lab_bonds(lab_cells(cells)).agg(F.count("*").alias("bonds"), F.sum("d2").alias("energy")), 3)


_rungs = ", ".join(f"r{k} AS (SELECT t // {k} AS t, y // {k} AS y, x // {k} AS x, avg(ll) AS ll, avg(la) AS la, avg(lb) AS lb FROM lab GROUP BY t // {k}, y // {k}, x // {k})" for k in (1, 2, 4))


@query(f"+ {LAB_SQL}, {_rungs} " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg(d2), 6) AS density FROM {bonds_sql(f'r{k}', SIDE // k)}" for k in (1, 2, 4)))
def f33_coarsening_density(cells):
    """Energy per bond of the cube, and of its means over blocks of sides 2 and 4."""
    out, whole = [], lab_cells(cells)
    for k in (1, 2, 4):
        pooled = whole.groupBy(*[F.expr(f"{c} div {k}").alias(c) for c in ("t", "y", "x")]).agg(*[F.avg(c).alias(c) for c in ("ll", "la", "lb")]) if k > 1 else whole
        out.append(lab_bonds(pooled, SIDE // k).agg(F.avg("d2").alias("density")).select(F.lit(k).alias("k"), "density"))
    return rounded(reduce(lambda p, q: p.unionByName(q), out))



def tile():
    return [F.expr(f"cast({c} div 4 as int)").alias(f"t{c}") for c in "tyx"]


_tile = "t // 4 AS tt, y // 4 AS ty, x // 4 AS tx"
_idx_bonds = " UNION ALL ".join(f"SELECT t, y, x, {a} AS own, idx AS p, lead(idx) OVER (PARTITION BY {_others(a)} ORDER BY {a}) AS q FROM cube" for a in "tyx")


@query(f"SELECT {_tile}, sum(CASE WHEN p <> q THEN 1 ELSE 0 END)::BIGINT AS walls FROM ({_idx_bonds}) WHERE q IS NOT NULL AND (own + 1) % 4 <> 0 GROUP BY t // 4, y // 4, x // 4")
def e17_index_walls(cells):
    inside = bonds.bonds(cells, "idx").select("*", own_place()).where("(own + 1) % 4 <> 0")
    return inside.groupBy(*tile()).agg(F.sum(bonds.DIFFERS(F.col("p"), F.col("q"))).alias("walls"))


@query(f"""+ {LAB_SQL}, m AS (SELECT {_tile}, sum((idx >= 128)::INT)::BIGINT AS ground, count(DISTINCT idx) AS used, sum((CASE WHEN (t + y + x) % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN idx >= 128 THEN 1 ELSE -1 END))::BIGINT AS staggered FROM cube GROUP BY t // 4, y // 4, x // 4),
e AS (SELECT {_tile}, sum(d2) AS d2 FROM {bonds_sql('lab')} WHERE (own + 1) % 4 <> 0 GROUP BY t // 4, y // 4, x // 4) SELECT tt, ty, tx, ground, used, staggered, round(coalesce(d2, 0), 5) AS interior FROM m LEFT JOIN e USING (tt, ty, tx)""")
def f29_tile_measure(cells):
    sign = F.when((F.col("t") + F.col("y") + F.col("x")) % 2 == 0, 1).otherwise(-1) * F.when(F.col("idx") >= 128, 1).otherwise(-1)
    m = cells.groupBy(*tile()).agg(F.count_if(F.col("idx") >= 128).alias("ground"), F.count_distinct("idx").alias("used"), F.sum(sign).alias("staggered"))
    e = lab_bonds(lab_cells(cells)).where("(own + 1) % 4 <> 0").groupBy(*tile()).agg(F.sum("d2").alias("interior"))
    return rounded(m.join(e, ["tt", "ty", "tx"], "left").withColumn("interior", F.coalesce("interior", F.lit(0.0))), 5)


@query(f"SELECT {_tile}, CASE WHEN sum((idx >= 128)::INT) = 0 THEN 'face' WHEN sum((idx >= 128)::INT) = count(*) THEN 'solid' ELSE 'band' END AS phase FROM cube GROUP BY t // 4, y // 4, x // 4")
def f31_tile_phase(cells):
    n = F.count_if(F.col("idx") >= 128)
    return cells.groupBy(*tile()).agg(F.when(n == 0, "face").when(n == F.count("*"), "solid").otherwise("band").alias("phase"))


_ranked = "SELECT t, idx, row_number() OVER (PARTITION BY t ORDER BY count(*), idx) AS k FROM cube GROUP BY t, idx"


@query(f"SELECT a.t, a.idx, b.idx AS next_idx, CAST(a.k AS INT) AS rank FROM ({_ranked}) a JOIN ({_ranked}) b ON b.t = a.t + 1 AND b.k = a.k")
def e30_sympathetic_pairing(cells):
    """Colours of a frame and of the next, paired by rank of size."""
    rank = F.row_number().over(Window.partitionBy("t").orderBy("n", "idx"))
    r = cells.groupBy("t", "idx").agg(F.count("*").alias("n")).select("t", "idx", rank.alias("rank"))
    after = r.select((F.col("t") - 1).alias("t"), F.col("idx").alias("next_idx"), "rank")
    return r.join(after, ["t", "rank"]).select("t", "idx", "next_idx", "rank")


_rows3 = "SELECT t, y, x, side, idx, lag(idx) OVER w AS l, lead(idx) OVER w AS r FROM cube WINDOW w AS (PARTITION BY t, y ORDER BY x)"
_near8 = " + ".join(f"coalesce(({v} = idx)::INT, 0)" for v in ("l", "r", *[f"{f}({v}) OVER c" for f in ("lag", "lead") for v in ("l", "idx", "r")]))


@query(f"+ h AS (SELECT t, idx, count(*) AS n FROM cube GROUP BY t, idx), near AS (SELECT t, y, x, side, idx, {_near8} AS same FROM ({_rows3}) WINDOW c AS (PARTITION BY t, x ORDER BY y)) SELECT a.t, y, x, round(same - 8.0::DOUBLE * n / (side * side), 6) AS deviation FROM near a JOIN h ON h.t = a.t AND h.idx = a.idx")
def e33_neighbour_density(cells):
    """Of the eight places around a cell, how many more share its colour than the colour's share of the frame lets expect."""
    line, column = Window.partitionBy("t", "y").orderBy("x"), Window.partitionBy("t", "x").orderBy("y")
    wide = cells.select("t", "y", "x", "side", "idx", F.lag("idx").over(line).alias("l"), F.lead("idx").over(line).alias("r"))
    others = [F.col("l"), F.col("r"), *[f(v).over(column) for f in (F.lag, F.lead) for v in ("l", "idx", "r")]]
    same = reduce(lambda p, q: p + q, [F.coalesce((o == F.col("idx")).cast("int"), F.lit(0)) for o in others])
    n = cells.groupBy("t", "idx").agg(F.count("*").alias("n"))
    near = wide.withColumn("same", same).join(n, ["t", "idx"])
    return rounded(near.select("t", "y", "x", (F.col("same") - F.col("n") * 8.0 / (F.col("side") * F.col("side"))).alias("deviation")))


# Meters


@query(f"+ {HIST_SQL}, lf AS (SELECT range AS k, sum(log2(greatest(range, 1))) OVER (ORDER BY range) AS bits FROM range(4097)) SELECT t, round(sum(b.bits) - 256 * first(a.bits), 4) AS energy FROM hist JOIN tot USING (t) JOIN lf a ON a.k = cells // 256 JOIN lf b ON b.k = n GROUP BY t")
def f10_exact_energy(cells):
    """Bits by which a frame's histogram has fewer arrangements than the level one: log2 of the factorials' ratio."""
    logs = F.broadcast(energy.log_factorials(cells.sparkSession, 64 * 64))
    hist = frames(cells)
    level = hist.groupBy("t").agg(F.expr("sum(n) div 256").alias("k")).join(logs, "k").select("t", F.col("bits").alias("level"))
    parts = hist.join(logs, hist.n == logs.k).groupBy("t").agg(F.sum("bits").alias("parts"))
    return rounded(parts.join(level, "t").select("t", (F.col("parts") - F.col("level") * 256).alias("energy")), 4)


_cyclic = "(SELECT sum(((a.idx >= 128) <> (b.idx >= 128))::INT) AS a, sum(((a.idx >= 128) = (b.idx >= 128))::INT) AS b FROM k a JOIN k b ON b.t = a.t - a.t % a.side + (a.t + 1) % a.side AND a.y = b.y AND a.x = b.x)"
_time = f"SELECT (a + b) * (1 - ({_h.format(a='a', b='b')})) AS bits FROM {_cyclic}"


def time_energy(cells):
    walls = bonds.cyclic_walls(mixed_spins(cells), "spin", SIDE)
    return walls.select(energy.wall_bits(F.col("walls"), F.col("bonds")).alias("bits"))


@query(f"+ {SPIN_SQL} SELECT round(bits, 3) AS bits FROM ({_time})")
def f15_time_energy(cells):
    return rounded(time_energy(cells), 3)


_walls = f"w AS (SELECT t, sum(CASE WHEN p <> q THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p <> q THEN 0 ELSE 1 END) AS b FROM ({_plane}) WHERE q IS NOT NULL GROUP BY t)"


@query(f"+ {SPIN_SQL}, {_walls}, p AS (SELECT idx, count(*) AS n FROM k GROUP BY idx) SELECT round((SELECT sum(n * log2(n / ((SELECT count(*) FROM k) / 256.0::DOUBLE))) FROM p), 3) AS e_hist, round((SELECT sum((a + b) * (1 - ({_h.format(a='a', b='b')}))) FROM w), 3) AS e_wall, round((SELECT bits FROM ({_time})), 3) AS e_time")
def f16_cube_value(cells):
    """Energies of the pooled histogram, of all frames' walls and of the loops in time, in bits."""
    spins = mixed_spins(cells)
    pooled = energy.measures(spins.groupBy("idx").agg(F.count("*").alias("n")), []).select(F.col("energy").alias("e_hist"))
    walls = bonds.plane_walls(spins, "spin").agg(F.sum(energy.wall_bits(F.col("walls"), F.col("bonds"))).alias("e_wall"))
    return rounded(pooled.join(F.broadcast(walls)).join(F.broadcast(time_energy(cells).withColumnRenamed("bits", "e_time"))), 3)


KHIST_SQL = "khist AS (SELECT t, idx, count(*) AS n FROM k GROUP BY t, idx), ktot AS (SELECT t, count(*) AS cells, sum((idx >= 128)::INT) AS up, abs(sum(CASE WHEN ((x + y) % 2 = 0) = (idx >= 128) THEN 1 ELSE -1 END)) AS stag FROM k GROUP BY t)"


@query(f"+ {SPIN_SQL}, {_walls}, {KHIST_SQL}, o AS (SELECT t, sum(-n / cells::DOUBLE * ln(n / cells::DOUBLE)) / ln(256) AS s_occ FROM khist JOIN ktot USING (t) GROUP BY t) SELECT t, a::BIGINT AS walls, round(a / (a + b)::DOUBLE, 6) AS w, round(s_occ, 6) AS s_occ, round(up / cells::DOUBLE, 6) AS phi, round(stag / cells::DOUBLE, 6) AS m_stag FROM ktot JOIN w USING (t) JOIN o USING (t)")
def f23_frame_energy(cells):
    """Walls and their share of the bonds, entropy of the colours, share of upper spins, and staggered magnetisation."""
    spins = mixed_spins(cells)
    measures = energy.measures(energy.counts(spins, ["t"]), ["t"]).select("t", (F.col("h0") / 8).alias("s_occ"), "phi")
    agree = ((F.col("x") + F.col("y")) % 2 == 0) == (F.col("spin") == 1)
    stag = spins.groupBy("t").agg((F.abs(F.sum(F.when(agree, 1).otherwise(-1))) / F.count("*")).alias("m_stag"))
    walls = bonds.plane_walls(spins, "spin").select("t", "walls", (F.col("walls") / F.col("bonds")).alias("w"))
    return rounded(walls.join(measures, "t").join(stag, "t"))


@query(f"+ {SPIN_SQL}, {KHIST_SQL} SELECT t, round(1 + (1 - up / cells::DOUBLE) * 7 + up / cells::DOUBLE * 4, 6) AS bits, 144 AS colours FROM ktot")
def f82_rate_bits(cells):
    """Mean bits of an index where the figure has 2^7 colours and the ground 2^4."""
    share = F.avg(F.col("spin"))
    return rounded(mixed_spins(cells).groupBy("t").agg((1 + (1 - share) * 7 + share * 4).alias("bits")).withColumn("colours", F.lit(2**7 + 2**4)))


@query(f"+ {HIST_SQL}, {SPIN_SQL}, {_walls}, lv AS ({_lv}), e AS (SELECT t, level, sum((a + b) * (1 - ({_h.format(a='a', b='b')}))) AS energy FROM lv GROUP BY t, level), u AS (SELECT t, sum((n = 0)::INT)::BIGINT AS unused, sum(CASE WHEN n > 0 THEN n * log2(n / (cells / 256.0::DOUBLE)) ELSE 0 END) / first(cells) AS eps FROM hist JOIN tot USING (t) GROUP BY t), "
       f"v AS (SELECT t, {', '.join(f'round(sum(CASE WHEN level = {k} THEN energy ELSE 0 END), 4) AS e{k}' for k in range(8))} FROM e GROUP BY t) SELECT v.*, round((a + b) * (1 - ({_h.format(a='a', b='b')})), 4) AS wall, unused, round(eps, 4) AS eps FROM v JOIN w USING (t) JOIN u USING (t)")  # fmt: skip
def f78_rung_state(cells):
    """A frame's eleven numbers: its level energies, wall energy, unused colours, and energy per cell."""
    hist = energy.counts(cells, ["t"])
    level = energy.level_energies(hist, ["t"]).groupBy("t").agg(*[F.sum(F.when(F.col("level") == k, F.col("energy")).otherwise(0.0)).alias(f"e{k}") for k in range(8)])
    walls = bonds.plane_walls(mixed_spins(cells), "spin").select("t", energy.wall_bits(F.col("walls"), F.col("bonds")).alias("wall"))
    rest = energy.measures(hist, ["t"]).select("t", (256 - F.col("used")).alias("unused"), F.col("per_cell").alias("eps"))
    return rounded(level.join(walls, "t").join(rest, "t"), 4)


@query(f"+ {HIST_SQL}, lv AS ({_lv}), e AS (SELECT t, level, sum((a + b) * (1 - ({_h.format(a='a', b='b')}))) AS energy FROM lv GROUP BY t, level), d AS (SELECT t, energy - lag(energy) OVER (PARTITION BY t // n, level ORDER BY t) AS d FROM e, side) SELECT t, round(sqrt(sum(d * d)), 4) AS error FROM d WHERE d IS NOT NULL GROUP BY t")
def g21_persistence_error(cells):
    """Distance of a frame's level energies from those of the frame before, within a capture."""
    levels = energy.level_energies(frames(cells), ["t"])
    before = F.lag("energy").over(Window.partitionBy(capture(), "level").orderBy("t"))
    gaps = levels.select("t", (F.col("energy") - before).alias("d")).where("d is not null")
    return rounded(gaps.groupBy("t").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("error")), 4)


_series3 = "SELECT t, n AS side, unnest(['s', 'r', 'g']) AS name, unnest([avg(s), avg(r), avg(g)]) AS v FROM cube, side GROUP BY t, n"


@query(f"""+ d AS (SELECT t // side AS capture, name, t, v - lag(v) OVER (PARTITION BY t // side, name ORDER BY t) AS d FROM ({_series3})), e AS (SELECT *, d - avg(d) OVER (PARTITION BY capture, name) AS e FROM d WHERE d IS NOT NULL),
n AS (SELECT *, lead(e) OVER (PARTITION BY capture, name ORDER BY t) AS f FROM e), r AS (SELECT capture, name, count(*) AS n, sum(e * f) / nullif(count(*) - 1, 0) / nullif(avg(e * e), 0) AS rho FROM n GROUP BY capture, name),
q AS (SELECT capture, sum(greatest(0, -rho)) AS noise, sum(greatest(0, 1 + 2 * least(0, rho))) AS drift FROM r WHERE rho IS NOT NULL GROUP BY capture)
SELECT capture, round(CASE WHEN noise = 0 THEN 1 WHEN drift = 0 THEN 0 ELSE (drift / noise + sqrt(pow(drift / noise, 2) + 4 * drift / noise)) / 2 / ((drift / noise + sqrt(pow(drift / noise, 2) + 4 * drift / noise)) / 2 + 1) END, 5) AS gain FROM q""")
def g02_local_level_gain(cells):
    """The steady Kalman gain of a local level under each capture's mean depth, red and green, by the first autocorrelation
    of their steps. Captures of fewer than three frames are left out."""
    means = cells.groupBy("t").agg(F.array(*[F.struct(F.lit(c).alias("name"), F.avg(c).alias("v")) for c in ("s", "r", "g")]).alias("m")).select("t", F.inline("m"))
    own = Window.partitionBy("capture", "name")
    steps = means.withColumn("capture", capture()).withColumn("d", F.col("v") - F.lag("v").over(own.orderBy("t"))).where("d is not null")
    steps = steps.withColumn("e", F.col("d") - F.avg("d").over(own)).withColumn("f", F.lead("e").over(own.orderBy("t")))
    rho = F.sum(F.col("e") * F.col("f")) / F.nullif(F.count("*") - 1, F.lit(0)) / F.nullif(F.avg(F.col("e") * F.col("e")), F.lit(0.0))
    r = steps.groupBy("capture", "name").agg(rho.alias("rho")).where("rho is not null")
    zero = F.lit(0.0)
    q = r.groupBy("capture").agg(F.sum(F.greatest(zero, -F.col("rho"))).alias("noise"), F.sum(F.greatest(zero, 1 + F.least(zero, F.col("rho")) * 2)).alias("drift"))
    ratio = F.col("drift") / F.nullif(F.col("noise"), zero)
    x = (ratio + F.sqrt(ratio * ratio + ratio * 4)) / 2
    return rounded(q.select("capture", F.when(F.col("noise") == 0, 1.0).when(F.col("drift") == 0, 0.0).otherwise(x / (x + 1)).alias("gain")), 5)


_dh = "dh AS (SELECT t, least(63, CAST(floor(s * 64) AS INT)) AS bin, count(*) AS n FROM cube GROUP BY 1, 2), dt AS (SELECT t, sum(n) AS cells, max(n) AS top FROM dh GROUP BY t)"


def depth_histogram(cells):
    return cells.groupBy("t", F.least(F.lit(63), F.floor(F.col("s") * 64).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"+ {_dh} SELECT t, round(sqrt(sum(pow(n - cells / 64.0::DOUBLE, 2)) + (64 - count(*)) * pow(first(cells) / 64.0::DOUBLE, 2)) / greatest(0.001, sum(-n / cells::DOUBLE * ln(n / cells::DOUBLE)) / ln(64)), 4) AS beauty FROM dh JOIN dt USING (t) GROUP BY t")
def f62_depth_birkhoff(cells):
    """Deviation of a frame's depths from a level histogram of 64 bins, over their scaled entropy."""
    h = depth_histogram(cells)
    h = h.join(h.groupBy("t").agg(F.sum("n").alias("cells")), "t")
    p, level = F.col("n") / F.col("cells"), F.col("cells") / 64
    empty = (64 - F.count("*")) * F.first(level * level)
    order = F.sqrt(F.sum(F.pow(F.col("n") - level, 2)) + empty)
    return rounded(h.groupBy("t").agg((order / F.greatest(F.lit(0.001), F.sum(-p * F.ln(p)) / F.ln(F.lit(64.0)))).alias("beauty")), 4)


@query(f"+ {_dh} SELECT t, (min(CASE WHEN n = top THEN bin END) + 0.5::DOUBLE) / 64 AS peak, sum((n > top // 2)::INT) / 64.0::DOUBLE AS width FROM dh JOIN dt USING (t) GROUP BY t")
def f63_subject_peak(cells):
    """Centre of the fullest depth bin, the nearest to 0 on ties, and the share of bins above half of it."""
    h = depth_histogram(cells)
    h = h.join(h.groupBy("t").agg(F.max("n").alias("top")), "t")
    peak = F.min(F.when(F.col("n") == F.col("top"), F.col("bin")))
    return h.groupBy("t").agg(((peak + 0.5) / 64).alias("peak"), (F.count_if(F.expr("n > top div 2")) / 64).alias("width"))


@query(f"+ {HIST_SQL}, p AS (SELECT t, n / cells::DOUBLE AS p FROM hist JOIN tot USING (t) WHERE n > 0) SELECT t, round(sum(-p * ln(p)) / ln(256), 6) AS entropy, round(3 * (0.6::DOUBLE * sum(-p * ln(p)) + 0.4::DOUBLE * ln(greatest(1, 1 / sum(p * p)))) / ln(256), 6) AS dimension FROM p GROUP BY t")
def f66_normalised_entropy(cells):
    return rounded(energy.birkhoff(frames(cells), ["t"]).select("t", F.col("complexity").alias("entropy"), F.col("manifold_dim").alias("dimension")))


@query("+ m AS (SELECT t, y // 4 AS y, x // 4 AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM cube GROUP BY t, y // 4, x // 4) SELECT c.t, round(avg((abs(c.r - m.r) + abs(c.g - m.g) + abs(c.b - m.b)) / 3 * 255), 5) AS divergence FROM cube c JOIN m ON m.t = c.t AND m.y = c.y // 4 AND m.x = c.x // 4 WHERE c.y % 4 = 2 AND c.x % 4 = 2 GROUP BY c.t")
def f59_box_against_point(cells):
    """How far the centre of a block of 4 x 4 lies from the block's mean, in bytes."""
    centre = (F.col("y") % 4 == 2) & (F.col("x") % 4 == 2)
    block = [F.expr("y div 4").alias("by"), F.expr("x div 4").alias("bx")]
    both = cells.groupBy("t", *block).agg(*[F.avg(c).alias(c) for c in "rgb"], *[F.max(F.when(centre, F.col(c))).alias(f"p{c}") for c in "rgb"]).where("pr is not null")
    gap = sum((F.abs(F.col(f"p{c}") - F.col(c)) for c in "rgb"), F.lit(0.0)) / 3 * 255
    return rounded(both.groupBy("t").agg(F.avg(gap).alias("divergence")), 5)


_ledger = f"{HIST_SQL}, z AS (SELECT t, first(cells) AS n, first(cells) * sum(-n / cells::DOUBLE * log2(n / cells::DOUBLE)) AS h, count(*) AS u FROM hist JOIN tot USING (t) WHERE n > 0 GROUP BY t), ledger AS (SELECT t, 1 AS step, n * 24.0::DOUBLE AS bits_in, n * 8.0::DOUBLE AS bits_out FROM z UNION ALL SELECT t, 2, n * 8.0::DOUBLE, h FROM z UNION ALL SELECT t, 3, CASE WHEN t % 5 = 0 THEN h + 1 ELSE h END, u * 24.0::DOUBLE FROM z)"


def ledger(cells):
    """(t, step, bits_in, bits_out): true colours to indices, to their entropy, to the table; one frame in five has a gap."""
    z = energy.measures(energy.counts(cells, ["t"]), ["t"]).select("t", F.col("cells").alias("n"), (F.col("cells") * F.col("h0")).alias("h"), F.col("used").alias("u"))
    n, h = F.col("n"), F.col("h")
    steps = ((n * 24.0, n * 8.0), (n * 8.0, h), (F.when(F.col("t") % 5 == 0, h + 1).otherwise(h), F.col("u") * 24.0))
    return z.select("t", F.inline(F.array(*[F.struct(F.lit(k).alias("step"), i.alias("bits_in"), o.alias("bits_out")) for k, (i, o) in enumerate(steps, 1)])))


@query(f"+ {_ledger} SELECT t, step, round(bits_in, 4) AS bits_in, round(bits_out, 4) AS bits_out FROM ledger")
def f56_funnel_ledger(cells):
    return rounded(ledger(cells), 4)


@query(f"+ {_ledger} SELECT t, round(product(bits_out / bits_in), 12) AS ratio FROM ledger GROUP BY t")
def f57_telescoped_ratio(cells):
    return rounded(ledger(cells).groupBy("t").agg(F.product(F.col("bits_out") / F.col("bits_in")).alias("ratio")), 12)


@query(f"+ {_ledger} SELECT t, bool_and(abs(bits_out - after) < 1e-6) AS connected FROM (SELECT *, lead(bits_in) OVER (PARTITION BY t ORDER BY step) AS after FROM ledger) WHERE after IS NOT NULL GROUP BY t")
def f58_path_connectivity(cells):
    after = F.lead("bits_in").over(Window.partitionBy("t").orderBy("step"))
    return ledger(cells).withColumn("after", after).where("after is not null").groupBy("t").agg(F.bool_and(F.abs(F.col("bits_out") - F.col("after")) < 1e-6).alias("connected"))
