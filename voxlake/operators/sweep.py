"""Exchange sweeps: blocks of 4 x 4 x 4 cells whose colours are chosen anew, one cell after another, to lower the error of the
block at three scales: of cells, of 2 x 2 x 2 cells, and of the whole block.

Blocks do not touch each other, so a block is one row and a sweep needs no shuffle: 64 places are visited in order, each for
all blocks of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairtree import LAB

SIDE = 4
CELLS = SIDE**3
CANDIDATES = 8
CURVATURE = 1 + 1 / 8 + 1 / 64  # what a cell's own change adds at the three scales

_v = np.arange(CELLS)
_eighth = (_v % 4) // 2 + 2 * (_v // 4 % 4 // 2) + 4 * (_v // 16 // 2)  # the 2 x 2 x 2 cell of place x + 4 (y + 4 t)
_members = np.array([np.flatnonzero(_eighth == e) for e in range(8)])


def objective(error: np.ndarray) -> np.ndarray:
    """Squared errors of cells, of eight-cell means (times eight) and of the block's mean (times 64), by block."""
    eighths = error[:, _members].mean(2)
    return (error**2).sum((1, 2)) + 8 * (eighths**2).sum((1, 2)) + 64 * (error.mean(1) ** 2).sum(1)


def sweep(choice: np.ndarray, target: np.ndarray, candidates: np.ndarray, sweeps: int) -> np.ndarray:
    """choice (blocks, 64) after so many sweeps: each place takes the candidate (blocks, 8, 3) that lowers the objective
    against target (blocks, 64, 3) most; only a strict decrease moves it, the first candidate on ties."""
    q, block = choice.copy(), np.arange(len(choice))
    error = candidates[block[:, None], q] - target
    eighths, whole = error[:, _members].sum(2), error.sum(1)
    for _ in range(sweeps):
        for v in range(CELLS):
            slope = error[:, v] + eighths[:, _eighth[v]] / 8 + whole / CELLS
            step = candidates - candidates[block, q[:, v]][:, None]
            change = 2 * np.einsum("bk,bck->bc", slope, step) + CURVATURE * (step**2).sum(2)
            best = change.argmin(1)
            moves = change[block, best] < 0
            q[:, v] = np.where(moves, best, q[:, v])
            moved = np.where(moves[:, None], step[block, best], 0)
            error[:, v] += moved
            eighths[:, _eighth[v]] += moved
            whole += moved
    return q


def blocks(cells: DataFrame, code: str) -> DataFrame:
    """(bt, by, bx, cells): whole blocks of cells(t, y, x, ll, la, lb, code, far), packed in order of their places."""
    place = F.expr("cast(x % 4 + 4 * (y % 4 + 4 * (t % 4)) as int)").alias("v")
    key = [F.expr(f"cast({c} div {SIDE} as int)").alias(f"b{c}") for c in ("t", "y", "x")]
    rows = cells.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(place, F.col(code).alias("code"), "far", *LAB))).alias("cells"))
    return rows.where(F.col("n") == CELLS).drop("n")


def arrays(place: np.ndarray, columns: dict[str, pa.Array]) -> list[pa.Array]:
    """The columns bt, by, bx and cells of blocks() for cells at place (n, 3: t, y, x), all in one batch: each cell has its
    place v in its block, and the columns given."""
    key, v = place // SIDE, place[:, 2] % SIDE + SIDE * (place[:, 1] % SIDE + SIDE * (place[:, 0] % SIDE))
    order = np.lexsort((v, *key.T[::-1]))
    key = key[order]
    first = np.flatnonzero((np.diff(key, axis=0, prepend=-1) != 0).any(1))
    own = pa.array(order)
    cells = pa.StructArray.from_arrays([pa.array(v[order].astype(np.int32)), *[c.take(own) for c in columns.values()]], ["v", *columns])
    return [*[pa.array(k.astype(np.int32)) for k in key[first].T], pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), cells)]


def _top(codes: np.ndarray) -> np.ndarray:
    """(blocks, 8): of each row of codes those that most of it has, the lowest on ties; fewer are repeated in turn."""
    block = np.repeat(np.arange(len(codes)), codes.shape[1])
    order = np.lexsort((codes.ravel(), block))
    block, code = block[order], codes.ravel()[order]
    first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (code[1:] != code[:-1]))[: len(block)])
    count = np.diff(np.append(first, len(block)))
    block, code = block[first], code[first]
    order = np.lexsort((code, -count, block))
    code, many = code[order], np.bincount(block, minlength=len(codes))
    start = np.cumsum(many) - many
    return code[start[:, None] + np.arange(CANDIDATES) % np.minimum(many, CANDIDATES)[:, None]]


def most_used(blocks: DataFrame) -> DataFrame:
    """blocks with codes, the eight codes that most of a block's cells have, the lowest on ties; fewer are repeated in turn."""

    @F.pandas_udf("array<int>")
    def top(codes: pd.Series) -> pd.Series:
        return pd.Series(list(_top(np.stack(codes.to_numpy())).astype(np.int32))) if len(codes) else pd.Series([], dtype=object)

    return blocks.withColumn("codes", top(F.col("cells.code")))


def refine(blocks: DataFrame, books: DataFrame, sweeps: int = 4, also: tuple[int, ...] = ()) -> DataFrame:
    """(bt, by, bx, before, after, codes): the objective of each block of most_used() before and after so many sweeps, and the
    cells' codes by then. also: lesser numbers of sweeps, in order, whose objectives are columns after1 and so on besides.
    books(t, colours): the colour (ll, la, lb) of every code, in order, of a frame; a block reads that of its first. A cell whose code is none of the eight begins with the first of them; targets are centred on their mean."""
    own = books.where(F.col("t") % SIDE == 0).select(F.expr(f"cast(t div {SIDE} as int)").alias("bt"), "colours")
    shown = blocks.join(own, "bt").withColumn("candidates", F.transform("codes", lambda c: F.element_at("colours", c + 1))).drop("colours")

    kinds = {**dict.fromkeys(("bt", "by", "bx"), "int"), "before": "double", "after": "double", "codes": "array<int>", **{f"after{k}": "double" for k in also}}
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            cells, codes = col("cells").flatten(), col("codes").flatten().to_numpy().reshape(-1, CANDIDATES)
            target = np.column_stack([cells.field(c).to_numpy() for c in LAB]).reshape(-1, CELLS, 3)
            middle = target.mean(1, keepdims=True)
            shades = col("candidates").flatten()
            shades = np.column_stack([shades.field(c).to_numpy() for c in LAB]).reshape(-1, CANDIDATES, 3) - middle
            code = cells.field("code").to_numpy().reshape(-1, CELLS)
            start = (code[:, :, None] == codes[:, None, :]).argmax(2)
            target = target - middle
            row, steps = np.arange(len(start))[:, None], (0, *also, sweeps)
            found = [start]
            for k, more in zip(steps, steps[1:]):
                found.append(sweep(found[-1], target, shades, more - k))
            end = found[-1]
            before, *between, after = (pa.array(objective(shades[row, q] - target)) for q in found)
            chosen = pa.ListArray.from_arrays(pa.array(np.arange(len(end) + 1, dtype=np.int32) * CELLS), pa.array(codes[row, end].ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([col("bt"), col("by"), col("bx"), before, after, chosen, *between], names)

    return shown.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def placed(refined: DataFrame) -> DataFrame:
    """(t, y, x, code) of refined(bt, by, bx, codes)."""
    return _at(refined.select("bt", "by", "bx", F.posexplode("codes").alias("v", "code")))


def unpacked(blocks: DataFrame) -> DataFrame:
    """(t, y, x, code) of blocks(bt, by, bx, cells), which need not be whole."""
    return _at(blocks.select("bt", "by", "bx", F.inline("cells")))


def _at(rows: DataFrame) -> DataFrame:
    at = {"t": "bt * 4 + v div 16", "y": "by * 4 + v div 4 % 4", "x": "bx * 4 + v % 4"}
    return rows.select(*[F.expr(f"cast({e} as int)").alias(c) for c, e in at.items()], "code")
