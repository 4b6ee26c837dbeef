"""Tensor files: a capture's colours as a coarse picture with signed detail where it is significant, and its depths.

'TSRTENS1', frames, side, flags and a zero as little-endian 16-bit integers; all depths as 32-bit floats; the means of 4 x 4 x 4
cells (roots), three channels each, as 16-bit floats; one bit a root and channel, significant or not; and for each significant
one the mean magnitudes of its detail at half and at full resolution as 16-bit floats, and the signs of its 8 and 64 details.
Bits run from the highest of a byte. Flag 1: no threshold was found and every root is significant.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators import mixtures

MAGIC = b"TSRTENS1"
HEADER = 16
LEAST = 1e-12  # of a deviation whose logarithm is taken
SCHEMA = "capture int, t int, y int, x int, l float, a float, b float, s float"


def pool(level: np.ndarray) -> np.ndarray:
    """Means over 2 x 2 x 2 cells of (frames, side, side, channels), summed one after another as 32-bit floats."""
    total = np.zeros_like(level[::2, ::2, ::2])
    for dt, dy, dx in np.ndindex(2, 2, 2):
        total = total + level[dt::2, dy::2, dx::2]
    return total / np.float32(8)


def up(level: np.ndarray) -> np.ndarray:
    for axis in range(3):
        level = level.repeat(2, axis)
    return level


def parts(fine: np.ndarray) -> dict[str, np.ndarray]:
    """The roots' means, both levels' residuals, the mean magnitudes at the roots, and their deviation, for 32-bit floats."""
    half = pool(fine)
    root = pool(half)
    r_half, r_fine = half - up(root), fine - up(half)
    g_half, g_fine = pool(abs(r_half)), pool(pool(abs(r_fine)))
    return {"root": root, "r_half": r_half, "r_fine": r_fine, "g_half": g_half, "g_fine": g_fine, "dev": (np.float32(8) * g_half + np.float32(64) * g_fine) / np.float32(72)}


def _children(detail: np.ndarray, k: int) -> np.ndarray:
    """(roots and channels, k ** 3) of a level k times as fine, children in order of t, y, x."""
    f, h, w, c = (n // k if i < 3 else n for i, n in enumerate(detail.shape))
    return detail.reshape(f, k, h, k, w, k, c).transpose(0, 2, 4, 6, 1, 3, 5).reshape(f * h * w * c, k**3)


def _spread(children: np.ndarray, shape: tuple[int, ...], k: int) -> np.ndarray:
    f, h, w, c = shape
    return children.reshape(f, h, w, c, k, k, k).transpose(0, 4, 1, 5, 2, 6, 3).reshape(f * k, h * k, w * k, c)


def pack(fine: np.ndarray, depth: np.ndarray, threshold: float | None) -> bytes | None:
    """fine (frames, side, side, 3) and depth (frames, side, side); None unless both are whole and fours fit into them."""
    if fine.ndim != 4 or not len(fine) or fine.shape[1] != fine.shape[2] or depth.shape != fine.shape[:3] or len(fine) % 4 or fine.shape[1] % 4:
        return None
    p = parts(fine.astype(np.float32))
    loud = np.ones(p["dev"].size, bool) if threshold is None else p["dev"].ravel() >= np.float32(threshold)
    means = np.column_stack([p[g].ravel()[loud] for g in ("g_half", "g_fine")]).astype(">f2")
    bits = [np.unpackbits(means.view(np.uint8), axis=1), _children(p["r_half"] >= 0, 2)[loud], _children(p["r_fine"] >= 0, 4)[loud]]
    body = np.packbits(np.concatenate([b.astype(np.uint8) for b in bits], axis=1))
    head = MAGIC + struct.pack("<HHHH", len(fine), fine.shape[1], int(threshold is None), 0)
    return head + depth.astype("<f4").tobytes() + p["root"].astype("<f2").tobytes() + np.packbits(loud).tobytes() + body.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """(colours, depths) of a whole file; None for anything else."""
    if len(data) < HEADER or data[:8] != MAGIC:
        return None
    frames, side = struct.unpack("<HH", data[8:12])
    if not frames or not side or frames % 4 or side % 4:
        return None
    cells, shape = frames * side * side, (frames // 4, side // 4, side // 4, 3)
    roots = int(np.prod(shape))
    cuts = np.cumsum([HEADER, cells * 4, roots * 2, -(-roots // 8)])
    if len(data) < cuts[-1]:
        return None
    depth = np.frombuffer(data, "<f4", cells, HEADER).reshape(frames, side, side)
    root = np.frombuffer(data, "<f2", roots, int(cuts[1])).astype(np.float32)
    loud = np.unpackbits(np.frombuffer(data, np.uint8, cuts[3] - cuts[2], int(cuts[2])))[:roots].astype(bool)
    body = np.frombuffer(data, np.uint8, offset=int(cuts[3]))
    many = int(loud.sum())
    if len(body) != -(-many * 104 // 8):
        return None
    bits = np.unpackbits(body)[: many * 104].reshape(many, 104)
    means = np.packbits(bits[:, :32], axis=1).view(">f2").astype(np.float32).reshape(many, 2)
    signed = {}
    for name, g, at, n in (("half", 0, 32, 8), ("fine", 1, 40, 64)):
        children = np.zeros((roots, n), np.float32)
        children[loud] = np.where(bits[:, at : at + n], means[:, g, None], -means[:, g, None])
        signed[name] = _spread(children, shape, 2 if n == 8 else 4)
    return up(up(root.reshape(shape)) + signed["half"]) + signed["fine"], depth


def _packed(cells: DataFrame) -> DataFrame:
    """(capture, frames, side, cells): a capture's cells(capture, t, y, x, l, a, b, s) in order, t from the capture's first."""
    rows = cells.select(F.col("capture").cast("int").alias("capture"), "t", "y", "x", *[F.col(c).cast("float").alias(c) for c in ("l", "a", "b", "s")])
    return rows.groupBy("capture").agg(
        (F.max("t") - F.min("t") + 1).cast("int").alias("frames"), (F.greatest(F.max("y"), F.max("x")) + 1).cast("int").alias("side"),
        F.array_sort(F.collect_list(F.struct("t", "y", "x", "l", "a", "b", "s"))).alias("cells"),
    )


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(colours, depths) of a row of _packed; None if cells are missing or too many."""
    frames, side, cells = (batch.column(i)[k].as_py() if i < 3 else batch.column(3)[k].values for i in (1, 2, 3))
    if len(cells) != frames * side * side or not side:
        return None
    t, y, x = (cells.field(c).to_numpy().astype(np.int64) for c in "tyx")
    if len(np.unique(((t - t.min()) * side + y) * side + x)) != len(t):
        return None
    return np.column_stack([cells.field(c).to_numpy() for c in "lab"]).reshape(frames, side, side, 3), cells.field("s").to_numpy().reshape(frames, side, side)


def deviations(packed: DataFrame) -> DataFrame:
    """(capture, dev): the deviations of all roots and channels of each whole capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_arrays(batch, k) for k in range(batch.num_rows)]
            dev = [parts(a[0])["dev"].ravel().tolist() if a and not (a[0].shape[0] % 4 or a[0].shape[1] % 4) else None for a in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dev, pa.list_(pa.float32()))], ["capture", "dev"])

    return packed.mapInArrow(run, "capture int, dev array<float>")


def thresholds(deviations: DataFrame) -> DataFrame:
    """(capture, threshold): where the phases of the deviations' logarithms meet; null for one phase."""
    logs = deviations.where("dev is not null").select("capture", F.explode("dev").alias("d")).select("capture", F.ln(F.greatest(F.col("d").cast("double"), F.lit(LEAST))).alias("v"))
    fitted = mixtures.verdict(mixtures.fit(mixtures.counted(logs, "v", ["capture"])))
    level: Column = F.when(F.col("two_phase") & ~mixtures.degenerate(), F.exp(mixtures.crossover()).cast("float"))
    return fitted.select("capture", level.alias("threshold"))


def encode(cells: DataFrame) -> DataFrame:
    """(capture, threshold, data) of cells(capture, t, y, x, l, a, b, s): one file a capture, null for one that is not whole
    or whose sides fours do not fit into. A capture has a fixed size, which bounds a group."""
    packed = _packed(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pack(*a, batch.column(4)[k].as_py()) if (a := _arrays(batch, k)) else None for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(data, pa.binary())], ["capture", "threshold", "data"])

    both = packed.join(thresholds(deviations(packed)), "capture", "left").select("capture", "frames", "side", "cells", "threshold")
    return both.mapInArrow(run, "capture int, threshold float, data binary")


def decode(files: DataFrame) -> DataFrame:
    """Cells of files(capture, data), t from 0; files that are not whole give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py()
                got = unpack(data) if data is not None else None
                if got is None:
                    continue
                colour, depth = got
                t, y, x = (i.ravel().astype(np.int32) for i in np.indices(depth.shape))
                capture = np.full(len(t), batch.column(0)[k].as_py(), np.int32)
                columns = [capture, t, y, x, *colour.reshape(-1, 3).T, depth.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["capture", "t", "y", "x", "l", "a", "b", "s"])

    return files.select("capture", "data").mapInArrow(run, SCHEMA)
