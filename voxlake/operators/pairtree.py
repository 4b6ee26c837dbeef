"""Principal axes and pair trees of many frames at once, as expressions on one row a frame.

A pair tree halves a normal distribution at its mean along its widest axis, seven times; the halves' means and variances are
closed forms, so both halves of a generation split along the same axis. A node is known by its depth and its path: the signs
of its generations as bits, the first the highest, so that a path without its last bits is the node above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions import colour
from voxlake.operators import ground

DEPTH = 7
LEAVES = 1 << DEPTH
HALF_MEAN = math.sqrt(2 / math.pi)  # of the upper half of a standard normal
HALF_VARIANCE = 1 - 2 / math.pi
LAB = ("ll", "la", "lb")
COVARIANCE = ("c00", "c01", "c02", "c11", "c12", "c22")
#: Points of the shells about a centroid, by level.
LADDER = (1, 1, 2, 4, 8, 16, 32, 64)


def middle(weight: Column) -> list[Column]:
    """Aggregates: the weighted mean of ll, la, lb; cells of no positive weight do not count, and a group without any is
    mid-grey."""
    w = F.when(weight > 0, weight)
    return [F.coalesce(F.sum(w * F.col(c)) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(d)).alias(f"m_{c}") for c, d in zip(LAB, (0.5, 0.0, 0.0))]


def moments(cells: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """(by, ll, la, lb, c00, ..., c22): weighted mean and population covariance of cells(ll, la, lb); cells of no positive
    weight do not count, and a group without any is mid-grey without spread."""
    w = F.when(weight > 0, weight)
    mass = F.nullif(F.sum(w), F.lit(0.0))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = cells.groupBy(*by).agg(*[(F.sum(w * F.col(c)) / mass).alias(c) for c in LAB], *[(F.sum(w * F.col(LAB[i]) * F.col(LAB[j])) / mass).alias(f"_{i}{j}") for i, j in pairs])
    spread = [F.coalesce(F.col(f"_{i}{j}") - F.col(LAB[i]) * F.col(LAB[j]), F.lit(0.0)).alias(c) for (i, j), c in zip(pairs, COVARIANCE)]
    return sums.select(*by, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in zip(LAB, (0.5, 0.0, 0.0))], *spread)


def _rotation(p: int, q: int) -> str:
    """One Jacobi rotation of the state z that clears its entry (p, q)."""
    r = 3 - p - q
    at = lambda i, j: f"z.a{min(i, j)}{max(i, j)}"
    pp, qq, pq, rp, rq = at(p, p), at(q, q), at(p, q), at(r, p), at(r, q)
    entries = {
        (p, p): f"w.c * w.c * {pp} + 2 * w.s * w.c * {pq} + w.s * w.s * {qq}", (q, q): f"w.s * w.s * {pp} - 2 * w.s * w.c * {pq} + w.c * w.c * {qq}",
        (p, q): "0D", (min(r, p), max(r, p)): f"w.c * {rp} + w.s * {rq}", (min(r, q), max(r, q)): f"w.c * {rq} - w.s * {rp}", (r, r): at(r, r),
    }
    turned = {p: lambda k: f"w.c * z.v{k}{p} + w.s * z.v{k}{q}", q: lambda k: f"w.c * z.v{k}{q} - w.s * z.v{k}{p}", r: lambda k: f"z.v{k}{r}"}
    fields = [f"'a{i}{j}', {entries[i, j]}" for i in range(3) for j in range(i, 3)] + [f"'v{k}{j}', {turned[j](k)}" for k in range(3) for j in range(3)]
    angle = f"if(abs({pp} - {qq}) < 1e-15D, pi() / 4, 0.5D * atan(2 * {pq} / nullif({pp} - {qq}, 0D)))"
    bound = f"transform(array({angle}), th -> named_struct('s', sin(th), 'c', cos(th)))[0]"
    return f"transform(array({bound}), w -> named_struct({', '.join(fields)}))[0]"


def axes(rotations: int = 50) -> Column:
    """array of (variance, d0, d1, d2), by falling variance, of the covariance in c00 to c22: at most so many rotations, each
    at the largest entry off the diagonal (of equal ones the later), until that is below 1e-12. A direction's first
    component above 1e-9 is positive."""
    start = [f"'a{c[1:]}', {c}" for c in COVARIANCE] + [f"'v{i}{j}', {float(i == j)}D" for i in range(3) for j in range(3)]
    m01, m02, m12 = (f"abs(z.a{p})" for p in ("01", "02", "12"))
    step = f"case when greatest({m01}, {m02}, {m12}) < 1e-12D then z when {m12} >= greatest({m01}, {m02}) then {_rotation(1, 2)} when {m02} >= {m01} then {_rotation(0, 2)} else {_rotation(0, 1)} end"
    kept = ", ".join(f"named_struct('down', -z.a{k}{k}, 'k', {k}, 'd', array(z.v0{k}, z.v1{k}, z.v2{k}))" for k in range(3))
    found = F.expr(f"aggregate(sequence(1, {rotations}), named_struct({', '.join(start)}), (z, k) -> {step}, z -> array_sort(array({kept})))")

    def canonical(x: Column) -> Column:
        d = x["d"]
        lead = F.when(F.abs(d[0]) > 1e-9, d[0]).when(F.abs(d[1]) > 1e-9, d[1]).otherwise(d[2])
        sign = F.when(lead < 0, -1.0).otherwise(1.0)
        return F.struct((-x["down"]).alias("variance"), *[(d[k] * sign).alias(f"d{k}") for k in range(3)])

    return F.transform(found, canonical)


def generations(axes: str = "axes") -> Column:
    """The tree's seven offsets from a mean to its upper half's, each along the axis that is widest by then (of equal ones
    the first)."""
    widest = "array_position(z.v, array_max(z.v))"
    halved = f"transform(z.v, (v, i) -> if(i + 1 = {widest}, v * {HALF_VARIANCE!r}D, v))"
    along = f"transform(array({axes}[int({widest}) - 1]), x -> array(x.d0, x.d1, x.d2))[0]"
    offset = f"named_struct('v', {halved}, 'steps', concat(z.steps, array(transform({along}, d -> sqrt(array_max(z.v)) * {HALF_MEAN!r}D * d))))"
    start = f"named_struct('v', transform({axes}, x -> greatest(0D, x.variance)), 'steps', cast(array() as array<array<double>>))"
    return F.expr(f"aggregate(sequence(1, {DEPTH}), {start}, (z, k) -> {offset}, z -> z.steps)")


def levels(columns: list[pa.Array], most: int = DEPTH) -> list[np.ndarray]:
    """The (frames, 2 ** depth, 3) nodes of each depth up to most, from the columns ll, la, lb and steps."""
    place = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns[:3]])[:, None]
    steps = columns[3].flatten().flatten().to_numpy().reshape(len(place), -1, 3)
    out = [place]
    for d in range(most):
        step = steps[:, None, d]
        out.append(np.stack([out[-1] - step, out[-1] + step], 2).reshape(len(place), -1, 3))
    return out


def nodes(frames: DataFrame, by: list[str], least: int = 0, most: int = DEPTH, at_once: int = 512) -> DataFrame:
    """(by, depth, node, ll, la, lb) of the trees of frames(by, ll, la, lb, steps), for depths from least to most; each level
    is made from the one above for many frames at once."""
    schema = T.StructType([*[frames.schema[c] for c in by], *[T.StructField(c, T.IntegerType()) for c in ("depth", "node")], *[T.StructField(c, T.DoubleType()) for c in LAB]])
    depth = np.repeat(np.arange(least, most + 1), 1 << np.arange(least, most + 1)).astype(np.int32)
    node = np.concatenate([np.arange(1 << d) for d in range(least, most + 1)]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, at_once):
                batch = whole.slice(low, at_once)
                n = batch.num_rows
                place = np.concatenate(levels(batch.columns[len(by) : len(by) + 4], most)[least:], 1).reshape(-1, 3)
                frame = pa.array(np.repeat(np.arange(n), len(node)))
                keys = [batch.column(k).take(frame) for k in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(depth, n)), pa.array(np.tile(node, n)), *[pa.array(place[:, k]) for k in range(3)]], schema.names)

    return frames.select(*by, *LAB, "steps").mapInArrow(run, schema)


def displayed(colours: DataFrame) -> DataFrame:
    """colours(ll, la, lb, ...) as the bytes r8, g8, b8 that are shown, and ll, la, lb as those bytes' colours."""
    inside = ground.chroma_clamp(colours.withColumn("ll", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ll")))))
    shown = inside.withColumns(dict(zip(("r8", "g8", "b8"), colour.srgb8(tuple(F.col(c) for c in LAB)))))
    return shown.withColumns(dict(zip(LAB, colour.oklab(tuple(F.col(c) / 255 for c in ("r8", "g8", "b8"))))))


def figures(frames: DataFrame, by: list[str], depth: int = DEPTH) -> DataFrame:
    """(by, leaf, ll, la, lb, r8, g8, b8): the 128 displayed leaves; a smaller depth gives each the colour of its node there."""
    found = displayed(nodes(frames, by, depth, depth))
    low = F.expr(f"explode(sequence(0, {(1 << DEPTH - depth) - 1}))")
    return found.select(*by, "node", *LAB, "r8", "g8", "b8", low.alias("low")).select(*by, (F.col("node") * (1 << DEPTH - depth) + F.col("low")).alias("leaf"), *LAB, "r8", "g8", "b8")


def canonical_leaves(figures: DataFrame, nodes16: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, leaf): of each depth-4 node's eight leaves that nearest to its mean, the lowest on ties."""
    mean = nodes16.select(*by, "node", F.struct(*LAB).alias("mean"))
    member = figures.select(*by, F.shiftright("leaf", 3).alias("node"), "leaf", F.struct(*LAB).alias("own"))
    d = colour.distance2(*[tuple(F.col(f"{s}.{c}") for c in LAB) for s in ("own", "mean")])
    return member.join(mean, [*by, "node"]).groupBy(*by, "node").agg(F.min(F.struct(d.alias("d"), "leaf")).alias("x")).select(*by, "node", "x.leaf")


def shells(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, j, ll, la, lb): points of eight ellipses about the centroid in the plane of the first two of axes."""
    each = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(j).alias("j"), F.lit(2 * math.pi * j / n).alias("th"), F.lit(2 * k / (len(LADDER) - 1)).alias("rho")) for k, n in enumerate(LADDER) for j in range(n)])
    wide = lambda k: F.greatest(F.lit(1e-3), F.sqrt(F.greatest(F.lit(0.0), F.col("axes")[k]["variance"])))
    rows = frames.select(*by, *LAB, "axes", F.explode(each).alias("p"))
    u, w = (F.col("p.rho") * f(F.col("p.th")) * wide(k) for k, f in enumerate((F.cos, F.sin)))
    return rows.select(*by, "p.level", "p.j", *[(F.col(c) + u * F.col("axes")[0][f"d{i}"] + w * F.col("axes")[1][f"d{i}"]).alias(c) for i, c in enumerate(LAB)])
