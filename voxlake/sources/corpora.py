"""Text corpora of samples, one JSON object a line, and portable pixmaps.

Lines are read under a stated schema. What is no object of it is kept apart with its text, never dropped in silence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trees: a frame's nodes in the order of their depth and path, and what colours to find in it.
TREE = "frame int, centroid array<double>, nodes array<array<double>>, queries array<array<double>>, leaves array<int>"
#: Pairs: a term, its token and the term after one step.
PAIR = "source string, token string, target string, steps int"

_BAD = "_line"


def _once(x: Column) -> Column:
    """x as a generated column: filters on it don't repeat the expression, as they do where they are pushed below a projection."""
    return F.explode(F.array(x))


def to_lines(samples: DataFrame) -> DataFrame:
    """(value): one JSON object a row, null fields left out."""
    return samples.select(_once(F.to_json(F.struct("*"))).alias("value"))


def from_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(samples, bad): rows of the schema from lines(value), and the lines (value) that are none. Empty lines are neither."""
    full = lines.where(F.trim("value") != "").select("value", _once(F.from_json("value", f"{schema}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})).alias("x"))
    bad = F.col("x").isNull() | F.col(f"x.{_BAD}").isNotNull()
    return full.where(~bad).select("x.*").drop(_BAD), full.where(bad).select("value")


_HEAD = re.compile(rb"P6(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def ppm(pixels: np.ndarray) -> bytes:
    """A binary pixmap of (height, width, 3) bytes."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def from_ppm(data: bytes) -> np.ndarray | None:
    """(height, width, 3) bytes; None for anything but a whole binary pixmap of one byte a sample."""
    head = _HEAD.match(data)
    if not head:
        return None
    width, height, most = map(int, head.groups())
    if not 0 < most < 256 or not width * height or len(data) - head.end() < width * height * 3:
        return None
    return np.frombuffer(data, np.uint8, width * height * 3, head.end()).reshape(height, width, 3)


def encode_ppm(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, data) of cells(by, y, x, r8, g8, b8): one pixmap a group of whole rows; null where cells are missing."""
    kinds = dict(cells.dtypes)
    packed = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "x", "r8", "g8", "b8"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                rows = batch.column(len(by))[k].values
                y, x = (rows.field(c).to_numpy().astype(np.int64) for c in ("y", "x"))
                height, width = int(y.max()) + 1, int(x.max()) + 1
                whole = len(y) == height * width == len(np.unique(y * width + x)) and y.min() >= 0 and x.min() >= 0
                out.append(ppm(np.column_stack([rows.field(c).to_numpy() for c in ("r8", "g8", "b8")]).reshape(height, width, 3)) if whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, pa.binary())], [*by, "data"])

    return packed.mapInArrow(run, f"{', '.join(f'{c} {kinds[c]}' for c in by)}, data binary")


def decode_ppm(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x, r8, g8, b8) of files(by, data); files that are no pixmaps give none."""
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(len(by))[k].as_py()
                pixels = from_ppm(data) if data is not None else None
                if pixels is None:
                    continue
                y, x = (i.ravel().astype(np.int32) for i in np.indices(pixels.shape[:2]))
                keys = [c.slice(k, 1).take(pa.array(np.zeros(len(y), np.int64))) for c in batch.columns[: len(by)]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(y), pa.array(x), *(pa.array(c) for c in np.ascontiguousarray(pixels.reshape(-1, 3).T.astype(np.int32)))], [*by, "y", "x", "r8", "g8", "b8"])

    return files.select(*by, "data").mapInArrow(run, f"{', '.join(f'{c} {kinds[c]}' for c in by)}, y int, x int, r8 int, g8 int, b8 int")
