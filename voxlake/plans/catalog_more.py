"""More queries: geometry, bits, filters, boards, walks, quotas and enumerations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import colour, lattice
from voxlake.operators import bonds, energy, groups, pool

from .catalog import BOARD_SQL, CIE_SQL, HIST_SQL, LAB_SQL, boards, frames, query, rgb, rgb8, rounded, unit
from .cube import SIDE, capture

def lab_cells(cells: DataFrame, *more: str) -> DataFrame:
    return cells.select("t", "y", "x", *more, *[v.alias(n) for v, n in zip(colour.oklab(rgb()), ("ll", "la", "lb"))])


# Colour


@query("SELECT t, y, x, " + ", ".join(f"round(CASE WHEN {c} <= 0.0031308 THEN 12.92::DOUBLE * {c} ELSE 1.055::DOUBLE * pow({c}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END, 6) AS {c}" for c in "rgb") + " FROM cube")
def c02_linear_to_srgb(cells):
    return rounded(cells.select("t", "y", "x", *[colour.linear_to_srgb(F.col(c)).alias(c) for c in "rgb"]))


@query(f"+ {LAB_SQL} SELECT t, y, x, round(ll, 6) AS l, round(0 - la, 6) AS a, round(0 - lb, 6) AS b FROM lab")
def c08_complement(cells):
    return rounded(cells.select("t", "y", "x", *[v.alias(n) for v, n in zip(colour.complement(colour.oklab(rgb())), "lab")]))


@query(f"+ {LAB_SQL}, q AS (SELECT *, lead(ll) OVER w AS ql, lead(la) OVER w AS qa, lead(lb) OVER w AS qb FROM lab WINDOW w AS (PARTITION BY t, y ORDER BY x)) SELECT t, y, x, round(pow(ll - ql, 2) + pow(la - qa, 2) + pow(lb - qb, 2), 6) AS d2 FROM q WHERE ql IS NOT NULL")
def c11_neighbour_distance(cells):
    lab = lab_cells(cells).select("t", "y", "x", F.struct("ll", "la", "lb").alias("c"))
    return rounded(bonds.bonds(lab, "c", ("x",)).select("t", "y", "x", colour.distance2(unit("p.ll", "p.la", "p.lb"), unit("q.ll", "q.la", "q.lb")).alias("d2")))


@query("SELECT t, y, x, 255 - idx AS partner FROM cube")
def c12_partner(cells):
    return cells.select("t", "y", "x", (255 - F.col("idx")).alias("partner"))


@query(f"+ {LAB_SQL}, c AS (SELECT t, avg(ll) AS cl, avg(la) AS ca, avg(lb) AS cb FROM lab GROUP BY t) SELECT t, y, x, round(cl + (ll - cl) / (2 - s), 6) AS l, round(ca + (la - ca) / (2 - s), 6) AS a, round(cb + (lb - cb) / (2 - s), 6) AS b FROM lab JOIN c USING (t)")
def c26_aerial_staging(cells):
    lab = lab_cells(cells, "s")
    centre = F.broadcast(lab.groupBy("t").agg(F.avg("ll").alias("cl"), F.avg("la").alias("ca"), F.avg("lb").alias("cb")))
    gain = 1 / (2 - F.col("s"))
    return rounded(lab.join(centre, "t").select("t", "y", "x", *[(F.col(c) + (F.col(v) - F.col(c)) * gain).alias(n) for v, c, n in (("ll", "cl", "l"), ("la", "ca", "a"), ("lb", "cb", "b"))]))


@query(f"+ {LAB_SQL} SELECT t, round(sum((1 - s) * la), 5) AS a, round(sum((1 - s) * lb), 5) AS b, round(sum(la * la + lb * lb), 5) AS chroma2 FROM lab GROUP BY t")
def f05_hue_resultant(cells):
    w = 1 - F.col("s")
    lab = lab_cells(cells, "s")
    return rounded(lab.groupBy("t").agg(F.sum(w * F.col("la")).alias("a"), F.sum(w * F.col("lb")).alias("b"), F.sum(F.col("la") * F.col("la") + F.col("lb") * F.col("lb")).alias("chroma2")), 5)


@query(f"+ {LAB_SQL} SELECT t, round(avg(ll), 6) AS ml, round(var_pop(ll), 6) AS vl, round(covar_pop(la, lb), 6) AS cab FROM lab GROUP BY t")
def f02_gaussian_contraction(cells):
    return rounded(lab_cells(cells).groupBy("t").agg(F.avg("ll").alias("ml"), F.var_pop("ll").alias("vl"), F.covar_pop("la", "lb").alias("cab")))


# Lattice, bits, geometry


@query("SELECT t, y, x, " + ", ".join(f"least(13, greatest(0, CAST(floor({c} * 14) AS INT))) AS {c}" for c in "rgb") + " FROM cube")
def c201_value_to_bin(cells):
    return cells.select("t", "y", "x", *[lattice.value_to_bin(F.col(c)).alias(c) for c in "rgb"])


@query("SELECT range AS idx, " + ", ".join(f"CAST(round(((range // {k}) % 4 + 0.5) / 4 * 255) AS INT) AS {c}" for k, c in ((16, "r"), (4, "g"), (1, "b"))) + " FROM range(256)", on_cube=False)
def c206_lattice_colour(spark, sf_dir):
    return spark.range(256).select(F.col("id").alias("idx"), *[F.round((F.expr(f"(id div {k}) % 4") + 0.5) / 4 * 255).cast("int").alias(c) for k, c in ((16, "r"), (4, "g"), (1, "b"))])


@query("SELECT t, y, x, 16 * CAST(round(3 * r) AS INT) + 4 * CAST(round(3 * g) AS INT) + CAST(round(3 * b) AS INT) AS code FROM cube")
def c209_preview_quantize(cells):
    a, b, c = (F.round(F.col(n) * 3).cast("int") for n in "rgb")
    return cells.select("t", "y", "x", (a * 16 + b * 4 + c).alias("code"))


@query("SELECT event_id, round(1 / (least(1, value / 500) * (4 - 1 / 1.5::DOUBLE) + 1 / 1.5::DOUBLE), 6) AS metres FROM events", on_cube=False)
def c215_signal_to_metres(spark, sf_dir):
    s = F.least(F.lit(1.0), F.col("value") / 500)
    return rounded(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (1 / (s * (4 - 1 / 1.5) + 1 / 1.5)).alias("metres")))


@query("SELECT t, y, x, round(CASE WHEN s <= 0.2 THEN 0 ELSE 1 - (s - lo) / nullif(hi - lo, 0) END, 6) AS depth FROM (SELECT *, min(CASE WHEN s > 0.2 THEN s END) OVER (PARTITION BY t) AS lo, max(CASE WHEN s > 0.2 THEN s END) OVER (PARTITION BY t) AS hi FROM cube)")
def c216_depth_normalise(cells):
    valid = F.when(F.col("s") > 0.2, F.col("s"))
    w = Window.partitionBy("t")
    ends = cells.withColumn("lo", F.min(valid).over(w)).withColumn("hi", F.max(valid).over(w))
    return rounded(ends.select("t", "y", "x", F.when(F.col("s") <= 0.2, F.lit(0.0)).otherwise(1 - (F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("depth")))


@query("SELECT t, y, x, idx >> 7 AS role, (idx >> 6) & 1 AS r16, (idx >> 3) & 7 AS r32, idx & 7 AS r64, idx >> 3 AS class32, ((idx >> 7) << 7) + (((idx >> 6) & 1) << 6) + (((idx >> 3) & 7) << 3) + (idx & 7) AS composed FROM cube")
def c220_bit_fields(cells):
    f = {n: F.shiftright("idx", lo).bitwiseAND(2**w - 1) for n, lo, w in (("role", 7, 1), ("r16", 6, 1), ("r32", 3, 3), ("r64", 0, 3))}
    composed = f["role"] * 128 + f["r16"] * 64 + f["r32"] * 8 + f["r64"]
    return cells.select("t", "y", "x", *[v.alias(n) for n, v in f.items()], F.shiftright("idx", 3).alias("class32"), composed.alias("composed"))


@query("SELECT t, y AS x, side - 1 - x AS y, idx FROM cube")
def c227_quarter_turn(cells):
    return cells.select("t", F.col("y").alias("x"), (F.col("side") - 1 - F.col("x")).alias("y"), "idx")


@query("SELECT t, y, side - 1 - x AS x, idx FROM cube")
def c228_row_mirror(cells):
    return cells.select("t", "y", (F.col("side") - 1 - F.col("x")).alias("x"), "idx")


@query("SELECT t, y, x, (t * side + y) * side + x AS cell, t // 4 AS tt, y // 4 AS ty, x // 4 AS tx FROM cube")
def c230_tile_of_cell(cells):
    return cells.select("t", "y", "x", ((F.col("t") * F.col("side") + F.col("y")) * F.col("side") + F.col("x")).alias("cell"), *[b.alias(n) for b, n in zip(pool.block(4), ("tt", "ty", "tx"))])


@query("SELECT vec_id, (i - 1) // 16 AS t, ((i - 1) // 4) % 4 AS y, (i - 1) % 4 AS x, round(embedding[i]::DOUBLE, 6) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)", on_cube=False)
def c231_block_address(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rounded(e.select("vec_id", F.expr("i div 16").alias("t"), F.expr("(i div 4) % 4").cast("long").alias("y"), (F.col("i") % 4).cast("long").alias("x"), F.col("v").cast("double").alias("v")))


@query("SELECT k, t, CASE WHEN k % 4 = 0 THEN y WHEN k % 4 = 1 THEN m WHEN k % 4 = 2 THEN side - 1 - y ELSE side - 1 - m END AS y, CASE WHEN k % 4 = 0 THEN m WHEN k % 4 = 1 THEN side - 1 - y WHEN k % 4 = 2 THEN side - 1 - m ELSE y END AS x, idx FROM (SELECT *, CASE WHEN k >= 4 THEN side - 1 - x ELSE x END AS m FROM cube, (SELECT CAST(range AS INT) AS k FROM range(8)) )")
def c232_dihedral(cells):
    out = cells.select("*", F.explode(F.array(*map(F.lit, range(8)))).alias("k"))
    m = F.when(F.col("k") >= 4, F.col("side") - 1 - F.col("x")).otherwise(F.col("x"))
    turn, last = F.col("k") % 4, F.col("side") - 1
    y = F.when(turn == 0, F.col("y")).when(turn == 1, m).when(turn == 2, last - F.col("y")).otherwise(last - m)
    x = F.when(turn == 0, m).when(turn == 1, last - F.col("y")).when(turn == 2, last - m).otherwise(F.col("y"))
    return out.select("k", "t", y.alias("y"), x.alias("x"), "idx")


@query("SELECT t, y // 2 AS y, x // 2 AS x, idx FROM cube WHERE (y + 1) % 2 = 0 AND x % 2 = 0")
def c233_polyphase(cells):
    return cells.where("y % 2 = 1 and x % 2 = 0").select("t", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), "idx")


@query("SELECT event_id, round(exp(-3.51 * v) - exp(-5.75 * v), 6) AS g, round(0.24::DOUBLE / (0.0207::DOUBLE * value + 18.96::DOUBLE), 9) AS scale, round(least(v, 1 - v), 6) AS circle FROM (SELECT event_id, value, least(1, value / 500) AS v FROM events)", on_cube=False)
def c237_dissonance_terms(spark, sf_dir):
    v = F.least(F.lit(1.0), F.col("value") / 500)
    out = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", lattice.dissonance(v).alias("g"), (F.lit(0.24) / (F.col("value") * 0.0207 + 18.96)).alias("scale"), F.least(v, 1 - v).alias("circle"))
    return out.select("event_id", F.round("g", 6).alias("g"), F.round("scale", 9).alias("scale"), F.round("circle", 6).alias("circle"))


_partials = ", ".join(f"({i}, {m * 125 * 2**k}.0::DOUBLE, {1 / (1 + i)!r}::DOUBLE)" for i, (m, k) in enumerate((m, k) for m in (4, 5, 6) for k in range(4)))


@query(f"WITH p(i, f, w) AS (VALUES {_partials}) SELECT round(0.5 * sum(CASE WHEN a.f = b.f THEN 0 ELSE a.w * b.w * (exp(-3.51 * 0.24::DOUBLE / (0.0207::DOUBLE * least(a.f, b.f) + 18.96::DOUBLE) * abs(a.f - b.f)) - exp(-5.75 * 0.24::DOUBLE / (0.0207::DOUBLE * least(a.f, b.f) + 18.96::DOUBLE) * abs(a.f - b.f))) END), 6) AS d FROM p a, p b", on_cube=False)
def n24_quadratic_dissonance(spark, sf_dir):
    partials = [(i, float(m * 125 * 2**k), 1 / (1 + i)) for i, (m, k) in enumerate((m, k) for m in (4, 5, 6) for k in range(4))]
    p = spark.createDataFrame(partials, "i int, f double, w double")
    other = p.select(F.col("i").alias("j"), F.col("f").alias("f2"), F.col("w").alias("w2"))
    term = lattice.pair_dissonance(F.col("f"), F.col("w"), F.col("f2"), F.col("w2"))
    return rounded(p.join(F.broadcast(other), F.col("i") < F.col("j")).agg(F.sum(term).alias("d")))


# Filters and predicates


@query("SELECT o_orderkey AS capture, count(*) AS frames FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING bool_and(l_discount > 0)", on_cube=False)
def d01_export_eligibility(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_discount").groupBy("l_orderkey").agg(F.count("*").alias("frames"), F.bool_and(F.col("l_discount") > 0).alias("every"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return lines.where("every").join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_orderkey").alias("capture"), "frames")


@query("SELECT t, count(*) AS cells, count(DISTINCT idx) AS used, count(*) = first(side) * first(side) AS whole FROM cube GROUP BY t")
def d10_frame_validity(cells):
    side = F.first("side")
    return cells.groupBy("t").agg(F.count("*").alias("cells"), F.count_distinct("idx").alias("used"), (F.count("*") == side * side).alias("whole"))


@query("SELECT user_id AS capture, count(*) AS kept, count(*) >= 10 AS complete FROM events GROUP BY user_id", on_cube=False)
def d11_capture_completeness(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("capture")).agg(F.count("*").alias("kept"), (F.count("*") >= 10).alias("complete"))


# Graphs of colours

_pair = "c AS (SELECT idx % 64 AS c, t, y, x FROM cube)"


def graphs(cells):
    return cells.select((F.col("idx") % 64).alias("c"), "t", "y", "x")


@query(f"+ {_pair}, n AS (SELECT c, t, count(*) AS n FROM c GROUP BY 1, 2) SELECT coalesce(a.c, b.c) AS c, coalesce(a.t, b.t - 1) AS t, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS m FROM n a FULL JOIN n b ON a.c = b.c AND b.t = a.t + 1")
def e19_paired_graphs(cells):
    n = graphs(cells).groupBy("c", "t").agg(F.count("*").alias("n"))
    m = n.select("c", (F.col("t") - 1).alias("t"), F.col("n").alias("m"))
    return n.join(m, ["c", "t"], "full").select("c", "t", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@query(f"+ {_pair} SELECT a.c, a.t, count(*) AS shared FROM c a JOIN c b ON a.c = b.c AND b.t = a.t + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1, 2")
def e20_overlap(cells):
    g = graphs(cells)
    return g.join(g.select("c", (F.col("t") - 1).alias("t"), "y", "x"), ["c", "t", "y", "x"]).groupBy("c", "t").agg(F.count("*").alias("shared"))


@query(f"+ {_pair}, d AS (SELECT a.c, a.t, a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx, pow(a.y - b.y, 2) + pow(a.x - b.x, 2) AS d FROM c a JOIN c b ON a.c = b.c AND b.t = a.t + 1), f AS (SELECT c, t, max(m) AS m FROM (SELECT c, t, min(d) AS m FROM d GROUP BY c, t, ay, ax) GROUP BY 1, 2 UNION ALL SELECT c, t, max(m) FROM (SELECT c, t, min(d) AS m FROM d GROUP BY c, t, by_, bx) GROUP BY 1, 2) SELECT c, t, round(sqrt(max(m)), 6) AS hausdorff FROM f GROUP BY 1, 2")
def e21_hausdorff(cells):
    """A colour's places in two frames are one row, so no pair of places is a row of its own."""
    from voxlake.operators import transport

    return rounded(transport.hausdorff(transport.paired(graphs(cells), "c", None), "c"))


@query(f"+ {_pair} SELECT a.c, a.t, round(avg(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))), 6) AS mean FROM c a JOIN c b ON a.c = b.c AND a.t = b.t AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2")
def e22_mean_pair_distance(cells):
    g = graphs(cells)
    h = g.select("c", "t", F.col("y").alias("v"), F.col("x").alias("u"))
    pairs = g.join(h, ["c", "t"]).where("y != v or x != u")
    return rounded(pairs.groupBy("c", "t").agg(F.avg(F.sqrt(F.pow(F.col("y") - F.col("v"), 2) + F.pow(F.col("x") - F.col("u"), 2))).alias("mean")))


# Measures


@query(f"+ {HIST_SQL} SELECT t, round(sum(CASE WHEN n > 0 THEN -n / cells::DOUBLE * ln(n / cells::DOUBLE) ELSE 0 END) / ln(256), 6) AS entropy, round(3 * (0.6 * sum(CASE WHEN n > 0 THEN -n / cells::DOUBLE * ln(n / cells::DOUBLE) ELSE 0 END) / ln(256) + 0.4 * ln(greatest(1, 1 / sum(pow(n / cells::DOUBLE, 2)))) / ln(256)), 5) AS manifold_dim FROM hist JOIN tot USING (t) GROUP BY t")
def f67_manifold_dimension(cells):
    b = energy.birkhoff(frames(cells), ["t"])
    return b.select("t", F.round("complexity", 6).alias("entropy"), F.round("manifold_dim", 5).alias("manifold_dim"))


@query(f"+ {HIST_SQL} SELECT t, idx, n - cells // 256 AS deviation FROM (SELECT t, CAST(idx AS INT) AS idx, n, CAST(cells AS BIGINT) AS cells FROM hist JOIN tot USING (t))")
def f68_frame_deviation(cells):
    h = frames(cells)
    total = F.broadcast(h.groupBy("t").agg(F.sum("n").alias("cells")))
    return h.join(total, "t").select("t", "idx", F.expr("n - cells div 256").alias("deviation"))


@query(f"+ {HIST_SQL}, r AS (SELECT t, n, row_number() OVER (PARTITION BY t ORDER BY n) AS k FROM hist) SELECT a.t, round(avg(abs(a.n - b.n)), 6) AS distance FROM r a JOIN r b ON b.t = a.t + 1 AND a.k = b.k GROUP BY a.t")
def f69_sorted_wasserstein(cells):
    r = frames(cells).select("t", "n", F.row_number().over(Window.partitionBy("t").orderBy("n")).alias("k"))
    return rounded(r.join(r.select((F.col("t") - 1).alias("t"), "k", F.col("n").alias("m")), ["t", "k"]).groupBy("t").agg(F.avg(F.abs(F.col("n") - F.col("m"))).alias("distance")))


@query("SELECT t, CAST(channel AS VARCHAR) AS channel, level, round(count(*) / (SELECT count(*) FROM cube WHERE t = u.t)::DOUBLE, 6) AS share FROM (" + " UNION ALL ".join(f"SELECT t, '{c}' AS channel, (idx // {k}) % 4 AS level FROM cube" for k, c in ((16, "r"), (4, "g"), (1, "b"))) + ") u GROUP BY t, channel, level")
def f25_channel_occupancy(cells):
    three = F.array(*[F.struct(F.lit(c).alias("channel"), F.expr(f"cast((idx div {k}) % 4 as int)").alias("level")) for k, c in ((16, "r"), (4, "g"), (1, "b"))])
    u = cells.select("t", F.explode(three).alias("u")).select("t", "u.*")
    n = F.broadcast(cells.groupBy("t").agg(F.count("*").alias("n")))
    return rounded(u.groupBy("t", "channel", "level").agg(F.count("*").alias("k")).join(n, "t").select("t", "channel", "level", (F.col("k") / F.col("n")).alias("share")))


@query(f"+ {BOARD_SQL}, t AS (SELECT board, sum((stone = 2)::INT) AS empty FROM board GROUP BY board), l AS (SELECT board, n.stone AS colour, count(DISTINCT (e.y, e.x)) AS n FROM board e JOIN (SELECT board AS b2, y AS ny, x AS nx, stone FROM board) n ON n.b2 = e.board AND n.stone < 2 AND abs(n.ny - e.y) + abs(n.nx - e.x) = 1 WHERE e.stone = 2 GROUP BY 1, 2) SELECT t.board, round((coalesce(sum(l.n), 0) + first(empty)) / 361.0::DOUBLE, 6) AS complexity FROM t LEFT JOIN l ON l.board = t.board GROUP BY t.board")
def f53_board_complexity(cells):
    b = boards(cells)
    free = bonds.liberties(b, 0).unionByName(bonds.liberties(b, 1)).groupBy("board").agg(F.sum("liberties").alias("free"))
    empty = b.groupBy("board").agg(F.count_if(F.col("stone") == 2).alias("empty"))
    return rounded(empty.join(free, "board", "left").select("board", ((F.coalesce("free", F.lit(0)) + F.col("empty")) / 361).alias("complexity")))


@query("SELECT t, least(7, CAST(floor(s * 8) AS INT)) AS band, count(*) AS n, count(DISTINCT idx) AS colours FROM cube GROUP BY 1, 2")
def f64_colours_by_depth(cells):
    return cells.groupBy("t", F.least(F.lit(7), F.floor(F.col("s") * 8).cast("int")).alias("band")).agg(F.count("*").alias("n"), F.count_distinct("idx").alias("colours"))


@query("SELECT t, round(avg(CASE WHEN m < side THEN same END), 6) AS centre, round(avg(CASE WHEN m >= side THEN same END), 6) AS edge FROM (SELECT t, side, abs(2 * y + 1 - side) + abs(2 * x + 1 - side) AS m, (idx % 64 = lag(idx % 64) OVER (PARTITION BY t // side, y, x ORDER BY t))::INT AS same FROM cube) GROUP BY t HAVING count(same) > 0")
def f76_centre_and_edge_stability(cells):
    c, side = F.col("idx") % 64, F.col("side")
    m = F.abs(F.col("y") * 2 + 1 - side) + F.abs(F.col("x") * 2 + 1 - side)
    s = cells.select("t", (m < side).alias("inner"), (c == F.lag(c).over(Window.partitionBy(capture(), "y", "x").orderBy("t"))).cast("int").alias("same")).where("same is not null")
    return rounded(s.groupBy("t").agg(F.avg(F.when(F.col("inner"), F.col("same"))).alias("centre"), F.avg(F.when(~F.col("inner"), F.col("same"))).alias("edge")))


@query("SELECT bt, by_, bx, channel, bin, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT t // 4 AS bt, y // 4 AS by_, x // 4 AS bx, '{c}' AS channel, least(13, greatest(0, CAST(floor({c} * 14) AS INT))) AS bin FROM cube" for c in "rgb") + ") GROUP BY ALL")
def f77_block_histograms(cells):
    three = F.array(*[F.struct(F.lit(c).alias("channel"), lattice.value_to_bin(F.col(c)).alias("bin")) for c in "rgb"])
    u = cells.select(*[b.alias(n) for b, n in zip(pool.block(4), ("bt", "by_", "bx"))], F.explode(three).alias("u"))
    return u.groupBy("bt", "by_", "bx", "u.channel", "u.bin").agg(F.count("*").alias("n"))


@query("+ k AS (SELECT t, y, x, CASE WHEN (idx * 37 + y * x) % 256 >= 128 THEN 1 ELSE -1 END AS s FROM cube), q AS (SELECT t, s, lead(s) OVER (PARTITION BY t, y ORDER BY x) AS r, lead(s) OVER (PARTITION BY t, x ORDER BY y) AS d, (y + x) % 2 AS odd FROM k) SELECT t, sum(s * coalesce(r, 0) + s * coalesce(d, 0))::BIGINT AS ising, round(avg(CASE WHEN odd = 1 THEN -s ELSE s END), 6) AS staggered FROM q GROUP BY t")
def n46_ising(cells):
    k = cells.select("t", "y", "x", F.when((F.col("idx") * 37 + F.col("y") * F.col("x")) % 256 >= 128, 1).otherwise(-1).alias("s"))
    ising = bonds.bonds(k, "s", ("y", "x")).groupBy("t").agg(F.sum(F.col("p") * F.col("q")).alias("ising"))
    staggered = k.groupBy("t").agg(F.avg(F.when((F.col("y") + F.col("x")) % 2 == 1, -F.col("s")).otherwise(F.col("s"))).alias("staggered"))
    return rounded(ising.join(staggered, "t"))


@query("+ p AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, avg(s) AS s FROM cube GROUP BY t // 2, y // 2, x // 2) SELECT c.t, c.y, c.x, round(c.s - p.s, 9) AS residual FROM cube c JOIN p ON p.t = c.t // 2 AND p.y = c.y // 2 AND p.x = c.x // 2")
def n17_residual(cells):
    up = pool.lift(pool.pool(cells, ["s"])).withColumnRenamed("s", "p")
    return rounded(cells.join(up, ["t", "y", "x"]).select("t", "y", "x", (F.col("s") - F.col("p")).alias("residual")), 9)


@query("+ r AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, avg(abs(s - m)) AS g FROM (SELECT *, avg(s) OVER (PARTITION BY t // 2, y // 2, x // 2) AS m FROM cube) GROUP BY t // 2, y // 2, x // 2) SELECT t, y, x, round(g, 9) AS g FROM r")
def f46_residual_magnitude(cells):
    p = pool.projected(cells.select("t", "y", "x", "s", F.col("s").alias("m")), "m", 2)
    return rounded(p.groupBy(*pool.block(2)).agg(F.avg(F.abs(F.col("s") - F.col("m"))).alias("g")), 9)


@query("SELECT vec_id, round(sqrt(sum(v * v)), 5) AS norm, round(max(abs(v)), 6) AS top FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id", on_cube=False)
def f37_block_norm(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)
    return e.select("vec_id", F.round(F.sqrt(square), 5).alias("norm"), F.round(F.array_max(F.transform("v", lambda v: F.abs(v))), 6).alias("top"))


# Walks, order, quotas


@query("SELECT t, round(coalesce(avg(CASE WHEN idx % 64 = 21 THEN y END), side / 2.0), 6) AS cy, round(coalesce(avg(CASE WHEN idx % 64 = 21 THEN x END), side / 2.0), 6) AS cx FROM cube GROUP BY t, side")
def g18_spatial_walk(cells):
    here = F.col("idx") % 64 == 21
    mid = F.col("side") / 2
    return rounded(cells.groupBy("t", "side").agg(F.avg(F.when(here, F.col("y"))).alias("cy"), F.avg(F.when(here, F.col("x"))).alias("cx")).select("t", F.coalesce("cy", mid).alias("cy"), F.coalesce("cx", mid).alias("cx")))


@query("+ w AS (SELECT t, avg(y * s) AS a, avg(x * s) AS b FROM cube GROUP BY t) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM w j WHERE j.t <= i.t - 2 AND sqrt(pow(i.a - j.a, 2) + pow(i.b - j.b, 2)) <= 0.1) THEN 1.0 ELSE 0.0 END), 6) AS returns FROM w i WHERE t >= 2")
def g19_return_probability(cells):
    w = cells.groupBy("t").agg(F.avg(F.col("y") * F.col("s")).alias("a"), F.avg(F.col("x") * F.col("s")).alias("b"))
    j = F.broadcast(w.select(F.col("t").alias("t2"), F.col("a").alias("a2"), F.col("b").alias("b2")))  # one row a frame
    near = F.sqrt(F.pow(F.col("a") - F.col("a2"), 2) + F.pow(F.col("b") - F.col("b2"), 2)) <= 0.1
    back = w.where("t >= 2").join(j, (F.col("t2") <= F.col("t") - 2) & near, "left_semi").agg(F.count("*").alias("n"))
    return rounded(back.select((F.col("n") / w.where("t >= 2").agg(F.count("*")).scalar()).alias("returns")))


@query("SELECT t, bt, code, CAST(rank AS INT) AS rank FROM (SELECT t, bt, code, row_number() OVER (PARTITION BY t, bt ORDER BY n DESC, code) AS rank FROM (SELECT t // 4 AS t, (y // 4) * 1000 + x // 4 AS bt, idx AS code, count(*) AS n FROM cube GROUP BY 1, 2, 3)) WHERE rank <= 8")
def h02_top_candidates(cells):
    n = cells.groupBy(F.expr("cast(t div 4 as int)").alias("t"), F.expr("cast((y div 4) * 1000 + x div 4 as int)").alias("bt"), F.col("idx").alias("code")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("t", "bt").orderBy(F.desc("n"), "code"))
    return n.withColumn("rank", rank).where("rank <= 8").select("t", "bt", "code", "rank")


_prob = [f"exp(-pow(t % side - {k} * (side - 1) / 8.0::DOUBLE, 2) / (2 * pow((side - 1) / 8.0::DOUBLE * (2 - 0.5), 2)))" for k in (1, 3, 5, 7)]


@query(f"""+ g AS (SELECT t, side, idx % 64 AS c, y, x, s, row_number() OVER (PARTITION BY t, idx % 64 ORDER BY s DESC, y, x) AS k, count(*) OVER (PARTITION BY t, idx % 64) AS n FROM cube),
w AS (SELECT DISTINCT t, c, n, unnest([0, 1, 2, 3]) AS e, unnest([{', '.join(_prob)}]) AS p FROM g), x AS (SELECT *, n * p / sum(p) OVER (PARTITION BY t, c) AS q FROM w),
b AS (SELECT *, n - sum(floor(q)) OVER (PARTITION BY t, c) AS spare, row_number() OVER (PARTITION BY t, c ORDER BY round(q - floor(q), 9) DESC, e) AS r FROM x),
quota AS (SELECT t, c, e, floor(q) + CASE WHEN r <= spare THEN 1 ELSE 0 END AS quota FROM b),
u AS (SELECT *, sum(quota) OVER (PARTITION BY t, c ORDER BY quota DESC, e) AS upto FROM quota)
SELECT g.t, g.y, g.x, u.e AS epoch FROM g JOIN u ON u.t = g.t AND u.c = g.c AND g.k <= u.upto AND g.k > u.upto - u.quota""")
def g12_epoch_quotas(cells):
    """Pixels of one colour, nearest first, are dealt to epochs in order of quota; quotas follow the epochs' chances."""
    from voxlake.operators import lineage, scans

    coded = cells.select("t", "y", "x", "s", (F.col("idx") % 64).alias("c"))
    return scans.thread_epochs(coded, SIDE, ["c"], 0.5, lineage.tasks(cells.count())).select("t", "y", "x", "epoch")


@query("SELECT range // 256 AS t, (range // 16) % 16 AS y, range % 16 AS x FROM range(4096)", on_cube=False)
def i01_coordinate_grid(spark, sf_dir):
    return spark.range(4096).select(F.expr("id div 256").alias("t"), F.expr("(id div 16) % 16").alias("y"), (F.col("id") % 16).alias("x"))


@query("SELECT CAST(a.range AS INT) AS a, CAST(b.range AS INT) AS b, CAST(8 - a.range - b.range AS INT) AS c FROM range(9) a, range(9) b WHERE a.range + b.range <= 8", on_cube=False)
def n37_compositions(spark, sf_dir):
    ab = spark.range(81).select(F.expr("cast(id div 9 as int)").alias("a"), (F.col("id") % 9).cast("int").alias("b"))
    return ab.where("a + b <= 8").select("a", "b", (8 - F.col("a") - F.col("b")).alias("c"))


@query("WITH lf AS (SELECT range AS k, sum(ln(greatest(range, 1))) OVER (ORDER BY range) AS w FROM range(64)) SELECT CAST(k.k AS INT) AS k, round(exp(n.w - k.w - r.w + k.k * ln(0.3) + (63 - k.k) * ln(0.7)), 9) AS p FROM lf k JOIN lf n ON n.k = 63 JOIN lf r ON r.k = 63 - k.k", on_cube=False)
def n53_binomial(spark, sf_dir):
    lf = energy.log_factorials(spark, 63).select("k", (F.col("bits") * F.ln(F.lit(2.0))).alias("w"))
    rest = lf.select((63 - F.col("k")).alias("k"), F.col("w").alias("v"))
    top = lf.where("k = 63").select("w").scalar()
    p = F.exp(top - F.col("w") - F.col("v") + F.col("k") * F.ln(F.lit(0.3)) + (63 - F.col("k")) * F.ln(F.lit(0.7)))
    return lf.join(rest, "k").select(F.col("k").cast("int").alias("k"), F.round(p, 9).alias("p"))


@query("WITH RECURSIVE s(n, v) AS (SELECT 0, 7::BIGINT UNION ALL SELECT n + 1, (1103515245 * v + 12345) % 2147483648 FROM s WHERE n < 200) SELECT n, v FROM s", on_cube=False)
def a11_generator(spark, sf_dir):
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.array(F.lit(7).cast("long")), lambda acc, _: F.concat(acc, F.array(lattice.lcg(F.element_at(acc, -1)))))
    return spark.range(1).select(F.posexplode(fold).alias("n", "v"))


_tree = "WITH RECURSIVE node(depth, path) AS (SELECT 0, '' UNION ALL SELECT depth + 1, path || CAST(k.range AS VARCHAR) FROM node, range(8) k WHERE depth < 3 AND k.range < CASE WHEN depth = 0 THEN 2 ELSE 8 END)"


@query(f"{_tree} SELECT depth, path FROM node", on_cube=False)
def i05_expand_tree(spark, sf_dir):
    fans = (2, 8, 8)
    level = spark.range(1).select(F.lit(0).alias("depth"), F.lit("").alias("path"))
    out = level
    for d, fan in enumerate(fans):
        level = level.select(F.lit(d + 1).alias("depth"), "path", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("k")).select("depth", F.concat("path", F.col("k").cast("string")).alias("path"))
        out = out.unionByName(level)
    return out


_near = "a.t = b.t AND a.c = b.c AND abs(a.y - b.y) + abs(a.x - b.x) = 1"


@query(f"""+ c AS (SELECT t, y, x, idx % 4 AS c FROM cube), e AS (SELECT a.t, a.y, a.x, b.y AS v, b.x AS u FROM c a JOIN c b ON {_near}),
r AS (SELECT t, y, x, y AS v, x AS u FROM c UNION SELECT r.t, r.y, r.x, e.v, e.u FROM r JOIN e ON e.t = r.t AND e.y = r.v AND e.x = r.u),
g AS (SELECT t, y, x, min(v * {SIDE} + u) AS label, count(*) AS size FROM r GROUP BY 1, 2, 3)
SELECT t, c, count(*) FILTER (label = y * {SIDE} + x) AS groups, max(size) AS largest FROM g JOIN c USING (t, y, x) GROUP BY 1, 2""")
def f55_connected_groups(cells):
    """Connected groups of each frame's cells of one of four colours: how many, and the cells of the largest."""
    labelled = groups.connected(cells.withColumn("c", F.col("idx") % 4), "c", SIDE)
    sizes = labelled.groupBy("t", "c", "label").agg(F.count("*").alias("n"))
    return sizes.groupBy("t", "c").agg(F.count("*").alias("groups"), F.max("n").alias("largest"))


# Mosaics


@query("SELECT t, y, x, round(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN r WHEN y % 2 = 1 AND x % 2 = 1 THEN b ELSE g END, 9) AS v FROM cube")
def n75_mosaic(cells):
    v = F.when((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), F.col("r")).when((F.col("y") % 2 == 1) & (F.col("x") % 2 == 1), F.col("b")).otherwise(F.col("g"))
    return rounded(cells.select("t", "y", "x", v.alias("v")), 9)


@query("+ m AS (SELECT t, avg(pow(r - ((idx // 16) % 4 + 0.5) / 4, 2) + pow(g - ((idx // 4) % 4 + 0.5) / 4, 2) + pow(b - (idx % 4 + 0.5) / 4, 2)) / 3 AS mse FROM cube GROUP BY t) SELECT t, round(CASE WHEN mse < 1e-12 THEN 99 ELSE 10 * log10(1 / mse) END, 5) AS psnr FROM m")
def n77_psnr(cells):
    gap = [F.pow(F.col(c) - (F.expr(f"(idx div {k}) % 4") + 0.5) / 4, 2) for k, c in ((16, "r"), (4, "g"), (1, "b"))]
    m = cells.groupBy("t").agg((F.avg(gap[0] + gap[1] + gap[2]) / 3).alias("mse"))
    return rounded(m.select("t", F.when(F.col("mse") < 1e-12, F.lit(99.0)).otherwise(F.log10(1 / F.col("mse")) * 10).alias("psnr")), 5)


@query("SELECT c.t, c.y, c.x, round(sum(k.s), 6) AS s FROM cube c, (SELECT range // 4 AS dt, (range // 2) % 2 AS dy, range % 2 AS dx FROM range(8)) d, cube k WHERE k.t = c.t - c.t % c.side + (c.t + d.dt) % c.side AND k.y = (c.y + d.dy) % c.side AND k.x = (c.x + d.dx) % c.side GROUP BY 1, 2, 3")
def n69_sliding_sum(cells):
    """2 x 2 x 2 sums from every cell of each capture as a torus: each cell is sent to the eight cells that it counts for."""
    side = F.lit(SIDE)
    d = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("d")
    sent = cells.select("t", "y", "x", "s", d)
    first = F.col("t") - F.col("t") % side  # of the capture
    at = [(F.pmod(F.col(c) - F.expr(f"cast((d div {k}) % 2 as int)"), side) + (first if c == "t" else 0)).cast("int").alias(c) for c, k in (("t", 4), ("y", 2), ("x", 1))]
    sums = sent.select(*at, "s", "d").groupBy("t", "y", "x").agg(F.sum("s").alias("s"), F.min("d").alias("d"))
    return rounded(sums.where("d = 0").drop("d"))  # a cell that is not there counts for none


@query(f"+ {CIE_SQL} SELECT t, round(avg(l), 5) AS l, round(avg(sqrt(a * a + b * b)), 5) AS chroma FROM cie GROUP BY t")
def f22_frame_chroma(cells):
    lab = cells.select("t", *[v.alias(n) for v, n in zip(colour.cielab(rgb8()), "lab")])
    return rounded(lab.groupBy("t").agg(F.avg("l").alias("l"), F.avg(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("chroma")), 5)
