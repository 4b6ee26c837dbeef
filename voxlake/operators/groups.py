"""Connected groups of cells of one colour in each frame's plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels(colour: np.ndarray) -> np.ndarray:
    """(frames, side, side) least places y * side + x that can be reached over neighbours of equal colour; colour below 0 is no
    cell. Labels spread to neighbours, and each cell then jumps to the label of its label's cell, until nothing changes."""
    frames, side = colour.shape[:2]
    label = np.broadcast_to(np.arange(side * side).reshape(side, side), colour.shape).copy()
    sides = [((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(None), slice(None), slice(1, None)), (slice(None), slice(None), slice(None, -1)))]
    same = [colour[a] == colour[b] for a, b in sides]
    while True:
        before = label.copy()
        for (a, b), equal in zip(sides, same):
            for to, of in ((a, b), (b, a)):
                label[to] = np.where(equal, np.minimum(label[to], label[of]), label[to])
        flat = label.reshape(frames, -1)
        label = np.take_along_axis(flat, flat, 1).reshape(colour.shape)
        if (label == before).all():
            return label


def connected(cells: DataFrame, colour: str, side: int, at_once: int = 1024) -> DataFrame:
    """(t, y, x, colour, label) of cells(t, y, x, colour): a group's label is its first place, y * side + x. A frame is one row
    while it is labelled, which its size bounds; missing cells part groups. Null colours belong to no group and are left out."""
    rows = cells.where(F.col(colour).isNotNull()).select("t", F.struct("y", "x", F.col(colour).cast("int").alias("c")).alias("cell"))
    packed = rows.groupBy("t").agg(F.collect_list("cell").alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, at_once):
                batch = whole.slice(low, at_once)
                lists = batch.column(1)
                flat = lists.flatten()
                frame = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                y, x, c = (flat.field(n).to_numpy().astype(np.int64) for n in ("y", "x", "c"))
                names, code = np.unique(c, return_inverse=True)
                grid = -1 - np.broadcast_to(np.arange(side * side).reshape(side, side), (batch.num_rows, side, side))
                grid = grid.copy()  # a missing cell is like no other
                grid[frame, y, x] = code
                label = labels(grid)[frame, y, x]
                columns = [batch.column(0).to_numpy()[frame], y, x, names[code] if len(c) else c, label]
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in columns], ["t", "y", "x", colour, "label"])

    return packed.mapInArrow(run, f"t int, y int, x int, {colour} int, label int")
