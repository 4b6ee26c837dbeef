"""Ordered scans of frames, blocks and lines: error diffusion, greedy bins, error carries, and epochs by rank.

What a scan needs in order is one frame, one layer of blocks or one line of a capture. Such groups are packed into one row by
an aggregation; scans whose state is two-dimensional walk the places of a frame once for all frames of a batch, the others are
folds over an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import lattice

# The shares of an error that the next cell, and three cells of the next row, take (Floyd and Steinberg, 1976).
SHARES = ((0, 1, 7 / 16), (1, -1, 3 / 16), (1, 0, 5 / 16), (1, 1, 1 / 16))
# Wanted counts of the fourteen bins, out of 254.
BINS = (1, 2, 4, 8, 16, 32, 64, 64, 32, 16, 8, 4, 2, 1)

CENTRES = np.array([0.125, 0.375, 0.625, 0.875])


def diffuse(cells: DataFrame, side: int, most: float | None = 0.2, nearest: bool = False, at_once: int = 512) -> DataFrame:
    """(t, y, x, s, a, b, c): three levels from 0 to 3 a cell of cells(t, y, x, r, g, b, s), each frame's errors diffused
    along its rows, the near cells' (s near 1) less.

    most: bound of the error that a cell takes up, if any. nearest: a level's cell is that of the nearest of four centres,
    otherwise of the nearest third. A part-filled frame's missing cells take and give no error. at_once: frames in one walk.
    """
    names = ("r", "g", "b")
    packed = cells.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("y", "x", *[F.col(c).cast("double").alias(c) for c in (*names, "s")]))).alias("cells"))

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat = lists.flatten()
        frame = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
        y, x = (flat.field(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        colour = np.zeros((batch.num_rows, side, side, 3))
        colour[frame, y, x] = np.column_stack([flat.field(c).to_numpy() for c in names])
        strength = np.zeros((batch.num_rows, side, side))
        near = flat.field("s").to_numpy()
        strength[frame, y, x] = 1 - near * 0.7
        error = np.zeros((batch.num_rows, side + 1, side + 2, 3))
        level = np.zeros((batch.num_rows, side, side, 3), np.int8)
        for v in range(side):
            for u in range(side):
                taken = error[:, v, u + 1]
                want = colour[:, v, u] + (taken if most is None else np.clip(taken, -most, most))
                own = np.clip(np.floor(want * 4 if nearest else want * 3 + 0.5), 0, 3).astype(np.int64)
                level[:, v, u] = own
                rest = (want - CENTRES[own]) * strength[:, v, u, None]
                for dv, du, part in SHARES:
                    error[:, v + dv, u + 1 + du] += rest * part
        found = level[frame, y, x]
        columns = [batch.column(0).to_numpy()[frame].astype(np.int32), y.astype(np.int32), x.astype(np.int32), near, *(found[:, k].astype(np.int32) for k in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "y", "x", "s", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                yield walk(batch.slice(low, at_once))

    return packed.mapInArrow(run, "t int, y int, x int, s double, a int, b int, c int")


def gone_before(sizes: list[Column], e: int, counts: list[Column]) -> Column:
    """Sum of the counts of those that are served before entry e: of greater size, or of equal size and named earlier."""
    served = [(sizes[f] >= sizes[e] if f < e else sizes[f] > sizes[e], n) for f, n in enumerate(counts) if f != e]
    return sum((F.when(first, n).otherwise(0) for first, n in served), F.lit(0))


def epoch_targets(total: Column, chances: list[Column]) -> list[Column]:
    """How many of total go to each of four epochs by its chance; what truncation leaves goes to the largest remainders, one
    each (the first on ties). Plain columns: Spark interprets functions over arrays, which took most of a scan's time."""
    whole = [F.floor(total * p) for p in chances]
    rest = [F.round(total * p - n, 9) for p, n in zip(chances, whole)]
    left = total - sum(whole, F.lit(0))
    one = [F.lit(1)] * len(chances)
    return [n + F.when(gone_before(rest, e, one) < left, 1).otherwise(0) for e, n in enumerate(whole)]


def thread_epochs(cells: DataFrame, side: int, by: list[str], mean: float | None = None, tasks: int | None = None) -> DataFrame:
    """cells(t, y, x, s, ...) with epoch: of the cells of each frame's group by, in order of falling s and place, the first
    go to the epoch of most targets, and so on. Targets follow the group's mean s, or the mean given, and the frame's place in
    its capture; they are made at a group's first cell. tasks: frames are dealt to so many, so that none sorts too much. A cell
    that no target reaches has epoch -1, as where the mean is null or NaN."""
    ordered = Window.partitionBy("t", *by).orderBy(F.desc("s"), "y", "x")
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the same order: one sort for all
    dealt = cells if tasks is None else cells.repartition(tasks, "t")
    rows = dealt.withColumns({"_n": F.count("*").over(group), "_m": F.avg("s").over(group) if mean is None else F.lit(mean), "_k": F.row_number().over(ordered)})
    rows = rows.withColumn("_m", F.when(F.col("_k") == 1, F.col("_m")))  # null elsewhere, and what follows from it costs nothing
    rows = rows.withColumns({f"_p{e}": p for e, p in enumerate(lattice.epoch_probabilities(F.col("t") % side, F.col("_m"), side))})
    names = [f"_q{e}" for e in range(4)]
    rows = rows.withColumns(dict(zip(names, epoch_targets(F.col("_n"), [F.col(f"_p{e}") for e in range(4)]))))
    rows = rows.withColumns({q: F.first(q).over(group) for q in names})
    targets = [F.col(q) for q in names]
    spans = [(gone_before(targets, e, targets), n) for e, n in enumerate(targets)]
    epoch = F.coalesce(*[F.when((F.col("_k") > low) & (F.col("_k") <= low + n), e) for e, (low, n) in enumerate(spans)], F.lit(-1))
    return rows.withColumn("epoch", epoch).drop("_n", "_m", "_k", *names, *[f"_p{e}" for e in range(4)])


def scaled_target(n: int) -> list[int]:
    """BINS scaled to n, what flooring leaves dealt to the bins of largest remainder (by the rule of the fixed values: that
    of target * n * n over the total), the first on ties."""
    total = sum(BINS)
    base = [b * n // total for b in BINS]
    order = sorted(range(len(BINS)), key=lambda k: -(BINS[k] * n * n % total))
    more = set(order[: n - sum(base)])
    return [b + (k in more) for k, b in enumerate(base)]


def greedy_bins(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, bin) of groups(by, hists): hists is an array of (place, hist), in order; each place takes the bin of
    greatest hist times remaining demand (the last on ties), or its strongest bin where no product is positive, and uses up
    one of the bin's demand. The demand is scaled_target of the number of places."""
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields if f.name in by}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hists = batch.column(batch.schema.get_field_index("hists"))
            many = np.asarray(hists.value_lengths())
            flat = hists.flatten()
            hist = flat.field("hist").flatten().to_numpy().reshape(-1, len(BINS)).astype(np.int64)
            first = np.append(0, np.cumsum(many))[:-1]
            left = np.array([scaled_target(int(n)) for n in many], np.int64).reshape(-1, len(BINS))
            taken = np.zeros(len(hist), np.int32)
            for k in range(int(many.max(initial=0))):  # place k of all groups that have it
                own = np.flatnonzero(many > k)
                at = first[own] + k
                score = hist[at] * left[own]
                score = np.where(score.max(1, keepdims=True) > 0, score, hist[at])
                best = len(BINS) - 1 - score[:, ::-1].argmax(1)
                taken[at] = best
                left[own, best] = np.maximum(0, left[own, best] - 1)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), many))
            keys = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, flat.field("place"), pa.array(taken)], [*by, "place", "bin"])

    return groups.select(*by, "hists").mapInArrow(run, f"{', '.join(f'{c} {kinds[c]}' for c in by)}, place int, bin int")


def half_even(v: Column) -> Column:
    """Nearest of 0 to 3, halves to even."""
    return F.least(F.lit(3), F.greatest(F.lit(0), F.rint(v).cast("int")))


def carried(ideals: Column, share: float, after: bool) -> Column:
    """Levels of an array of ideal values, each step's error carried to the next: share of it, taken as it leaves (after) or
    as it arrives."""
    gone = lambda e: e * share if after else e
    come = lambda e: e if after else e * share

    def step(z: Column, v: Column) -> Column:
        want = v + come(z["e"])
        return F.struct(gone(want - half_even(want)).alias("e"), F.concat(z["q"], F.array(half_even(want))).alias("q"))

    start = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<int>").alias("q"))
    return F.aggregate(ideals, start, step, lambda z: z["q"])


def both_ways(ideals: Column, rounds: int) -> Column:
    """Levels after rounds of a pass forwards and one backwards, half of each error carried; no round is plain rounding. A
    pass decides afresh, so what the last one leaves is the backward one's."""
    if not rounds:
        return F.transform(ideals, half_even)
    return F.reverse(carried(F.reverse(ideals), 0.5, False))
