"""Queries of ordered scans, exchange sweeps and transport. Without SQL where the order of a scan is beyond it; tests hold
those against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import colour, lattice
from voxlake.operators import lineage, scans, sweep, transport
from voxlake.operators.pairtree import LAB

from .catalog import query, rounded
from .catalog_solve import solved
from .cube import SIDE, capture

# Error diffusion and epochs


@query(None)
def g17_error_diffusion(cells):
    """Levels of each channel by the error diffusion of frames, errors taken up whole."""
    return scans.diffuse(cells, SIDE, None, True).select("t", "y", "x", "a", "b", "c")


@query(None)
def g11_diffused_epochs(cells):
    """The index of each cell: colour levels by diffusion with bounded errors, epochs by rank of depth in the colour."""
    threaded = scans.thread_epochs(scans.diffuse(cells, SIDE), SIDE, ["a", "b", "c"], tasks=lineage.tasks(cells.count()))
    return threaded.select("t", "y", "x", (F.col("epoch") * 64 + F.col("a") * 16 + F.col("b") * 4 + F.col("c")).cast("int").alias("index"))


_p = [f"exp(-pow(t % side - {k} * (side - 1) / 8.0::DOUBLE, 2) / (2 * pow((side - 1) / 8.0::DOUBLE * (2 - m), 2)))" for k in (1, 3, 5, 7)]
THREAD_SQL = f"""z AS (SELECT *, count(*) OVER k AS n, avg(s) OVER k AS m, row_number() OVER (PARTITION BY t, code ORDER BY s DESC, y, x) AS i FROM code WINDOW k AS (PARTITION BY t, code)),
g AS (SELECT DISTINCT t, code, n, m, side, unnest([0, 1, 2, 3]) AS e FROM z),
w AS (SELECT *, CASE e WHEN 0 THEN {_p[0]} WHEN 1 THEN {_p[1]} WHEN 2 THEN {_p[2]} ELSE {_p[3]} END / greatest(1e-10, {' + '.join(_p)}) AS p FROM g),
b AS (SELECT *, floor(n * p) AS base, round(n * p - floor(n * p), 9) AS rest FROM w),
q AS (SELECT t, code, e, base + (row_number() OVER (PARTITION BY t, code ORDER BY rest DESC, e) <= n - sum(base) OVER (PARTITION BY t, code))::INT AS quota FROM b),
u AS (SELECT t, code, e, quota, sum(quota) OVER (PARTITION BY t, code ORDER BY quota DESC, e ROWS UNBOUNDED PRECEDING) AS upto FROM q)"""


@query(f"+ code AS (SELECT t, y, x, s, side, 16 * least(3, CAST(floor(r * 4) AS INT)) + 4 * least(3, CAST(floor(g * 4) AS INT)) + least(3, CAST(floor(b * 4) AS INT)) AS code FROM cube), {THREAD_SQL} SELECT z.t, y, x, CAST(64 * e + z.code AS INT) AS index FROM z JOIN u ON u.t = z.t AND u.code = z.code AND z.i <= upto AND z.i > upto - quota")
def g13_threaded_epochs(cells):
    """Epochs threaded through cells whose colours are floored without diffusion."""
    level = lambda c: F.least(F.lit(3), F.floor(F.col(c) * 4).cast("int"))
    coded = cells.select("t", "y", "x", "s", (level("r") * 16 + level("g") * 4 + level("b")).alias("code"))
    return scans.thread_epochs(coded, SIDE, ["code"]).select("t", "y", "x", (F.col("epoch") * 64 + F.col("code")).cast("int").alias("index"))


@query(None)
def g14_greedy_bins(cells):
    """The bin of each block of side 4, channel by channel, chosen in order to meet the wanted counts of a layer of blocks."""
    parts = None
    for c in "rgb":
        binned = cells.select(F.lit(c).alias("channel"), *[F.expr(f"cast({k} div 4 as int)").alias(f"b{k}") for k in ("t", "y", "x")], lattice.value_to_bin(F.col(c)).alias("bin"))
        parts = binned if parts is None else parts.unionByName(binned)
    counts = parts.groupBy("channel", "bt", "by", "bx").agg(F.array(*[F.count_if(F.col("bin") == k).cast("int") for k in range(14)]).alias("hist"))
    place = (F.col("by") * (SIDE // 4) + F.col("bx")).cast("int").alias("place")
    groups = counts.groupBy("channel", "bt").agg(F.array_sort(F.collect_list(F.struct(place, "hist"))).alias("hists"))
    return scans.greedy_bins(groups, ["channel", "bt"])


def ideal_lines(cells):
    """(capture, y, x, t0, ideals): the ideal epoch of each place along a capture's frames, in order."""
    p = lattice.epoch_probabilities(F.col("t") % SIDE, F.col("s"), SIDE)
    ideal = F.round(p[1] + p[2] * 2 + p[3] * 3, 9).alias("v")
    rows = cells.select(capture(), "t", "y", "x", ideal).groupBy("capture", "y", "x").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("line"))
    return rows.select("capture", "y", "x", F.element_at("line", 1)["t"].alias("t0"), F.col("line.v").alias("ideals"))


def _unrolled(lines, levels):
    out = lines.select("y", "x", "t0", F.posexplode(levels).alias("k", "epoch"))
    return out.select((F.col("t0") + F.col("k")).cast("int").alias("t"), "y", "x", "epoch")


_c = [f"exp(-pow(t % side - {k} * (side - 1) / 8.0::DOUBLE, 2) / (2 * pow((side - 1) / 8.0::DOUBLE * (2 - s), 2)))" for k in (1, 3, 5, 7)]
IDEAL_SQL = f"ideal AS (SELECT t, y, x, side, round(({_c[1]} + 2 * {_c[2]} + 3 * {_c[3]}) / greatest(1e-10, {' + '.join(_c)}), 9) AS v FROM cube)"
_even = "least(3, greatest(0, CAST(round_even({v}, 0) AS INT)))"


@query(f"+ {IDEAL_SQL}, r AS (SELECT t, y, x, side, {_even.format(v='v')} AS epoch, 0.7::DOUBLE * (v - {_even.format(v='v')}) AS e FROM ideal WHERE t % side = 0 UNION ALL SELECT i.t, i.y, i.x, i.side, {_even.format(v='(i.v + r.e)')}, 0.7::DOUBLE * (i.v + r.e - {_even.format(v='(i.v + r.e)')}) FROM r JOIN ideal i ON i.t = r.t + 1 AND i.y = r.y AND i.x = r.x WHERE i.t % i.side <> 0) SELECT t, y, x, epoch FROM r")
def g15_error_carry(cells):
    """Epochs of each place along a capture, seven tenths of each frame's error carried forward."""
    lines = ideal_lines(cells)
    return _unrolled(lines, scans.carried(F.col("ideals"), 0.7, True))


@query(f"+ {IDEAL_SQL}, z AS (SELECT *, max(t) OVER (PARTITION BY t // side, y, x) AS last FROM ideal), r AS (SELECT t, y, x, side, {_even.format(v='v')} AS epoch, v - {_even.format(v='v')} AS e FROM z WHERE t = last UNION ALL SELECT i.t, i.y, i.x, i.side, {_even.format(v='(i.v + 0.5::DOUBLE * r.e)')}, i.v + 0.5::DOUBLE * r.e - {_even.format(v='(i.v + 0.5::DOUBLE * r.e)')} FROM r JOIN ideal i ON i.t = r.t - 1 AND i.y = r.y AND i.x = r.x WHERE r.t % r.side <> 0) SELECT t, y, x, epoch FROM r")
def g16_both_ways(cells):
    """Epochs after two rounds of a pass forwards and one backwards."""
    lines = ideal_lines(cells)
    return _unrolled(lines, scans.both_ways(F.col("ideals"), 2))


# Exchange sweeps


def colour_books(cells):
    """(t, colours): the 256 displayed colours of each solved frame that is the first of its blocks, in order."""
    lab = colour.oklab(tuple(F.col(c) / 255 for c in ("r8", "g8", "b8")))
    rows = solved(cells).table.where(F.col("t") % sweep.SIDE == 0).select("t", F.struct(F.col("idx").alias("k"), *[v.alias(c) for c, v in zip(LAB, lab)]).alias("x"))
    return rows.groupBy("t").agg(F.array_sort(F.collect_list("x")).alias("x")).select("t", F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in LAB])).alias("colours"))


@query(None)
def j13_exchange_sweep(cells):
    """The objective of every whole block of the solved cube before and after one and four sweeps over its eight most used
    colours."""
    whole = solved(cells).blocks.where(F.size("cells") == sweep.CELLS)
    swept = sweep.refine(sweep.most_used(whole), colour_books(cells), 4, (1,))
    return rounded(swept.select("bt", "by", "bx", "before", "after1", F.col("after").alias("after4")), 8)


@query(None)
def j15_refine_far_blocks(cells):
    """The solved cube's indices, those of blocks that are far throughout after four sweeps."""
    blocks = solved(cells).blocks
    far = F.forall("cells", lambda x: F.coalesce((x["pull"] >= 31 / 32) & (x["code"] >= 128), F.lit(False))) & (F.size("cells") == sweep.CELLS)
    moved = sweep.placed(sweep.refine(sweep.most_used(blocks.where(far)), colour_books(cells)))
    return sweep.unpacked(blocks.where(~far)).unionByName(moved).withColumnRenamed("code", "index")


# Transport


def _pairs(cells):
    return transport.paired(cells.withColumn("c", F.col("idx") % 64), "c", SIDE)


@query(None)
def e27_greedy_transport(cells):
    """Matches and cost of each colour from a frame to the next, each place taking the nearest that is left."""
    return rounded(transport.costs(_pairs(cells), "c", ["greedy"]).withColumnRenamed("greedy", "cost").select("c", "t", "matches", "cost"))


@query(None)
def e28_assignment_transport(cells):
    """The same by greedy choice on reduced costs, and the least cost of all plans."""
    return rounded(transport.costs(_pairs(cells), "c", ["reduced", "cheapest"]).select("c", "t", "matches", "reduced", "cheapest"))


_VAR = "v AS (SELECT t, var_pop(r) + var_pop(g) + var_pop(b) AS lam, s >= 0.5 AS front FROM cube GROUP BY t, s >= 0.5)"


@query(f"+ {_VAR}, p AS (SELECT t, max(CASE WHEN front THEN lam END) AS f, max(CASE WHEN NOT front THEN lam END) AS b FROM v GROUP BY t) SELECT t, 7 AS figure, CAST(greatest(0, least(7, 7 - CASE WHEN f / b <= 1 THEN 0 ELSE floor(log2(f / b) / 2) END)) AS INT) AS ground FROM p WHERE f > 0 AND b > 0")
def j22_water_filling(cells):
    """Tree depths of the two roles of a frame: the ground's is lower by half the log of the ratio of their variances."""
    lam = F.var_pop("r") + F.var_pop("g") + F.var_pop("b")
    roles = cells.groupBy("t", (F.col("s") >= 0.5).alias("front")).agg(lam.alias("lam"))
    p = roles.groupBy("t").agg(F.max(F.when(F.col("front"), F.col("lam"))).alias("f"), F.max(F.when(~F.col("front"), F.col("lam"))).alias("b")).where("f > 0 and b > 0")
    ratio = F.col("f") / F.col("b")
    gap = F.when(ratio <= 1, 0).otherwise(F.floor(F.log2(ratio) / 2))
    return p.select("t", F.lit(7).alias("figure"), F.greatest(F.lit(0), F.least(F.lit(7), 7 - gap)).cast("int").alias("ground"))
