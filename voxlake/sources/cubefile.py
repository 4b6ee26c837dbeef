"""Binary cube files: 'TSRCUBE1', frames and side as little-endian 32-bit integers, then per frame the sRGB bytes of all
pixels and their depths as 32-bit floats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAGIC = b"TSRCUBE1"
HEADER = 16
SCHEMA = "capture string, t int, y int, x int, r float, g float, b float, s float"


def pack(rgb: np.ndarray, depth: np.ndarray) -> bytes | None:
    """rgb (frames, side, side, 3) in [0, 1] and depth (frames, side, side); None unless both are whole cubes."""
    if rgb.ndim != 4 or not len(rgb) or rgb.shape[1] != rgb.shape[2] or depth.shape != rgb.shape[:3]:
        return None
    frames, side = rgb.shape[:2]
    body = np.empty((frames, side * side * 7), np.uint8)
    body[:, : side * side * 3] = np.clip(np.rint(rgb.astype(np.float64) * 255), 0, 255).astype(np.uint8).reshape(frames, -1)
    body[:, side * side * 3 :] = np.ascontiguousarray(depth, "<f4").view(np.uint8).reshape(frames, -1)
    return MAGIC + struct.pack("<II", frames, side) + body.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """What pack() was given, colours in steps of 1/255; None for anything but a whole file."""
    if len(data) < HEADER or data[:8] != MAGIC:
        return None
    frames, side = struct.unpack("<II", data[8:HEADER])
    if not frames or not side or len(data) != HEADER + frames * side * side * 7:
        return None
    body = np.frombuffer(data, np.uint8, offset=HEADER).reshape(frames, -1)
    cut = side * side * 3
    return body[:, :cut].reshape(frames, side, side, 3).astype(np.float32) / 255, np.ascontiguousarray(body[:, cut:]).view("<f4").reshape(frames, side, side)


def encode(cells: DataFrame, n_frames: int | None = None) -> DataFrame:
    """(capture, data) of cells(capture, t, y, x, r, g, b, s): one file a capture; null for a capture with missing,
    repeated or surplus cells, or of other than n_frames frames, if they are given. A capture is one cube of fixed size, so a
    group is bounded."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        frames, side = int(rows.t.max()) + 1, int(max(rows.y.max(), rows.x.max())) + 1
        place = (rows.t.to_numpy() * side + rows.y.to_numpy()) * side + rows.x.to_numpy()
        whole = n_frames in (None, frames) and len(rows) == frames * side * side == len(np.unique(place))
        rows = rows.iloc[np.argsort(place)]
        data = pack(rows[["r", "g", "b"]].to_numpy().reshape(frames, side, side, 3), rows["s"].to_numpy().reshape(frames, side, side)) if whole else None
        return pd.DataFrame({"capture": [rows["capture"].iloc[0]], "data": [data]})

    return cells.select("capture", "t", "y", "x", "r", "g", "b", "s").groupBy("capture").applyInPandas(one, "capture string, data binary")


def decode(files: DataFrame) -> DataFrame:
    """Cells of files(capture, data); files that are not whole give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for capture, data in zip(batch["capture"], batch["data"]):
                got = unpack(bytes(data)) if data is not None else None
                if got:
                    rgb, depth = got
                    t, y, x = (a.ravel().astype(np.int32) for a in np.indices(depth.shape))
                    yield pd.DataFrame({"capture": capture, "t": t, "y": y, "x": x, "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel(), "s": depth.ravel()})

    return files.select("capture", "data").mapInPandas(run, SCHEMA)
