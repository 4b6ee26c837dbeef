"""A live feed of frames: pooled tumbling frames, a sliding ring of them, and a throttle, as stateful streams.

The feed has one row per capture and pixel row or cell, (capture, t, ts, y, x, s, ...); t counts frames of a capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def clean(s: Column, fill: float = 0.5) -> Column:
    """A depth signal kept in [0, 1]; NaN and null are the neutral fill."""
    return F.when(F.isnan(s) | s.isNull(), F.lit(fill)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def coarse_frames(feed: DataFrame, block: int = 4, frames: int = 4) -> DataFrame:
    """(capture, coarse, cy, cx, s, within): means over block x block pixels and `frames` frames, and the variance inside
    each mean. The same expression serves a batch and a stream (complete or update mode)."""
    s = clean(F.col("s"))
    key = [F.col("capture"), F.expr(f"t div {frames}").cast("int").alias("coarse"), F.expr(f"y div {block}").cast("int").alias("cy"), F.expr(f"x div {block}").cast("int").alias("cx")]
    return feed.groupBy(*key).agg(F.avg(s).alias("s"), F.greatest(F.lit(0.0), F.avg(s * s) - F.avg(s) * F.avg(s)).alias("within"))


def ring_batch(coarse: DataFrame, ring: int = 16) -> DataFrame:
    """(capture, coarse, frames, mean, within): over the last `ring` coarse frames, sliding by one; one row a coarse frame
    in coarse(capture, coarse, mean, within)."""
    last = Window.partitionBy("capture").orderBy("coarse").rowsBetween(1 - ring, 0)
    return coarse.select("capture", "coarse", F.count("*").over(last).alias("frames"), F.avg("mean").over(last).alias("mean"), F.avg("within").over(last).alias("within"))


def ring_stream(coarse: DataFrame, ring: int = 16) -> DataFrame:
    """ring_batch() on a stream: the state of a capture is its last `ring` coarse frames. Rows of a capture arrive in order
    of coarse across batches, in any order within one."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        means, withins = (list(v) for v in state.get) if state.exists else ([], [])
        out = []
        for row in pd.concat(batches).sort_values("coarse").itertuples():
            means, withins = [*means, row.mean][-ring:], [*withins, row.within][-ring:]
            out.append((key[0], row.coarse, len(means), sum(means) / len(means), sum(withins) / len(withins)))
        state.update((means, withins))
        yield pd.DataFrame(out, columns=["capture", "coarse", "frames", "mean", "within"])

    return coarse.groupBy("capture").applyInPandasWithState(
        update, "capture string, coarse int, frames long, mean double, within double", "means array<double>, withins array<double>", "append", GroupStateTimeout.NoTimeout
    )


def throttle(frames: DataFrame, gap: float) -> DataFrame:
    """(capture, ts): frames(capture, ts as seconds) that are at least gap after the last one taken."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        taken = []
        for ts in sorted(pd.concat(batches)["ts"]):
            if ts - last >= gap:
                last = ts
                taken.append(ts)
        state.update((last,))
        yield pd.DataFrame({"capture": [key[0]] * len(taken), "ts": taken})

    return frames.groupBy("capture").applyInPandasWithState(update, "capture string, ts double", "last double", "append", GroupStateTimeout.NoTimeout)


def latest_solve(frames: DataFrame, solves: DataFrame) -> DataFrame:
    """(capture, ts, solve): each frame with the newest solve closed at or before it, null if none; a union and one window,
    no join. Equal times: the solve counts for the frame."""
    both = frames.select("capture", "ts", F.lit(None).cast("long").alias("solve"), F.lit(1).alias("_frame")).unionByName(solves.select("capture", "ts", F.col("solve").cast("long").alias("solve"), F.lit(0).alias("_frame")))
    order = Window.partitionBy("capture").orderBy("ts", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("solve", F.last("solve", ignorenulls=True).over(order)).where("_frame = 1").drop("_frame")
