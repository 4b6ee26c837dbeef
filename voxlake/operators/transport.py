"""Transport of a colour's places in one frame to its places in the next.

Both frames' places of a colour are packed into one row, which a frame's size bounds; plans are made for a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _greedy(cost: np.ndarray) -> np.ndarray:
    """greedy() of many matrices (many, n, m) of one shape, row by row for all at once."""
    cost, out, own = cost.astype(float), np.full(cost.shape[:2], -1), np.arange(len(cost))
    for r in range(min(cost.shape[1:])):
        out[:, r] = cost[:, r].argmin(1)
        cost[own, :, out[:, r]] = np.inf
    return out


def greedy(cost: np.ndarray) -> np.ndarray:
    """Column of each row in turn: the cheapest that is left, the first on ties; -1 where none is."""
    return _greedy(cost[None])[0]


def _reduced(cost: np.ndarray) -> np.ndarray:
    n = min(cost.shape[1:])
    square = cost[:, :n, :n] - cost[:, :n, :n].min(2, keepdims=True) if n else cost[:, :n, :n]
    return _greedy(square - square.min(1, keepdims=True) if n else square)


def reduced(cost: np.ndarray) -> np.ndarray:
    """Columns of the first n rows and columns, n the lesser side, greedily after each row's and then each column's least is
    taken off."""
    return _reduced(cost[None])[0]


def _cheapest(cost: np.ndarray) -> np.ndarray:
    """cheapest() of many matrices (many, n, m) of one shape: each row's paths grow for all whose path has not ended."""
    many, rows, columns = cost.shape
    if rows > columns:
        back = _cheapest(cost.transpose(0, 2, 1))
        out = np.full((many, rows), -1)
        np.put_along_axis(out, back, np.broadcast_to(np.arange(columns), back.shape), 1)
        return out
    every = np.arange(many)
    price, owner, due = np.zeros((many, columns)), np.full((many, columns), -1), np.zeros((many, rows))
    for row in range(rows):
        reach, came, done = np.full((many, columns), np.inf), np.full((many, columns), -1), np.zeros((many, columns), bool)
        low, last = np.zeros(many), np.full(many, -1)
        live, at, column = every, np.full(many, row), np.full(many, -1)
        while len(live):
            length = low[live, None] + cost[live, at] - due[live, at][:, None] - price[live]
            ended, near = done[live], reach[live]
            closer = ~ended & (length < near)
            near = np.where(closer, length, near)
            reach[live], came[live] = near, np.where(closer, column[:, None], came[live])
            column = np.where(ended, np.inf, near).argmin(1)
            low[live] = reach[live, column]
            done[live, column] = True
            last[live] = column
            at = owner[live, column]
            on = at >= 0
            live, at, column = live[on], at[on], column[on]
        done[every, last] = False
        own, settled = np.nonzero(done)
        more = low[own] - reach[own, settled]
        due[:, row] += low
        due[own, owner[own, settled]] += more
        price[own, settled] -= more
        live, column = every, last
        while len(live):
            before = came[live, column]
            owner[live, column] = np.where(before < 0, row, owner[live, before])
            on = before >= 0
            live, column = live[on], before[on]
    out = np.full((many, rows), -1)
    own, column = np.nonzero(owner >= 0)
    out[own, owner[own, column]] = column
    return out


def cheapest(cost: np.ndarray) -> np.ndarray:
    """Column of each row (-1 for rows without) in a plan of least total cost that matches the lesser side wholly: shortest
    augmenting paths under dual prices (Jonker and Volgenant, 1987)."""
    return _cheapest(cost[None])[0]


PLANS = {"greedy": greedy, "reduced": reduced, "cheapest": cheapest}
_AT_ONCE = {"greedy": _greedy, "reduced": _reduced, "cheapest": _cheapest}


def paired(cells: DataFrame, group: str, frames: int | None) -> DataFrame:
    """(group, t, a, b): the places (y, x) that a group has in frame t and in the next one of its capture, in order; frames is
    a capture's, or None where frames follow one another throughout."""
    own = cells.groupBy(group, "t").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("a"))
    after = own.select(group, (F.col("t") - 1).alias("t"), F.col("a").alias("b"))
    return own.join(after if frames is None else after.where((F.col("t") + 1) % frames != 0), [group, "t"])


def _sides(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a and of b: where each row's places begin, and all places (y, x)."""
    sides = []
    for c in ("a", "b"):
        lists = batch.column(batch.schema.get_field_index(c))
        flat = lists.flatten()
        sides.append((np.append(0, np.cumsum(np.asarray(lists.value_lengths()))), np.column_stack([flat.field(k).to_numpy() for k in ("y", "x")]).astype(np.int64)))
    return sides


def _planned(sides: list[tuple[np.ndarray, np.ndarray]], kinds: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(rows, cost, columns by kind) of rows with equally many places on both sides, whose plans are made together; at most
    so many costs at a time."""
    sizes = np.column_stack([np.diff(cut) for cut, _ in sides])
    shapes, own = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(own.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(own.ravel(), minlength=len(shapes)))
    for (n, m), low, high in zip(shapes, [0, *ends[:-1]], ends):
        step = max(1, most // max(1, n * m))
        for k in range(low, high, step):
            rows = order[k : min(k + step, high)]
            a, b = (places[cut[rows][:, None] + np.arange(size)] for (cut, places), size in zip(sides, (n, m)))
            cost = np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(3))
            yield rows, cost, {kind: _AT_ONCE[kind](cost) for kind in kinds}


def _total(cost: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Cost of each plan's matches."""
    taken = np.take_along_axis(cost[:, : to.shape[1]], np.maximum(to, 0)[:, :, None], 2)[:, :, 0]
    return np.where(to >= 0, taken, 0).sum(1)


def costs(pairs: DataFrame, group: str, kinds: list[str]) -> DataFrame:
    """(group, t, matches, and a column a kind of plan): the number of matches, the same for every plan, and their total
    distance by plan."""
    kind = dict(pairs.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = _sides(batch)
            total = {k: np.zeros(batch.num_rows) for k in kinds}
            for rows, cost, plan in _planned(sides, kinds):
                for k, to in plan.items():
                    total[k][rows] = _total(cost, to)
            matches = np.minimum(*[np.diff(cut) for cut, _ in sides]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(matches), *(pa.array(v) for v in total.values())], [group, "t", "matches", *kinds])

    return pairs.select(group, "t", "a", "b").mapInArrow(run, f"{group} {kind}, t int, matches int, {', '.join(f'{k} double' for k in kinds)}")


def plans(pairs: DataFrame, group: str) -> DataFrame:
    """(group, t, plan, matches, cost, y, x, v, u): for each pair of frames and kind of plan the number and total distance of
    matches, and the matches as arrays of places."""
    kind = dict(pairs.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            keys = [batch.column(batch.schema.get_field_index(c)) for c in (group, "t")]
            sides = _sides(batch)
            for rows, cost, found in _planned(sides, list(PLANS)):
                for name, plan in found.items():
                    for k, to, whole in zip(rows, plan, _total(cost, plan)):
                        a, b = (places[cut[k] : cut[k + 1]] for cut, places in sides)
                        of = np.flatnonzero(to >= 0)
                        out.append((k, name, len(of), float(whole), a[of, 0], a[of, 1], b[to[of], 0], b[to[of], 1]))
            rows = pa.array([o[0] for o in out], pa.int64())
            lists = [pa.array([o[i].tolist() for o in out], pa.list_(pa.int32())) for i in range(4, 8)]
            yield pa.RecordBatch.from_arrays(
                [*(key.take(rows) for key in keys), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.float64()), *lists],
                [group, "t", "plan", "matches", "cost", "y", "x", "v", "u"],
            )

    return pairs.select(group, "t", "a", "b").mapInArrow(run, f"{group} {kind}, t int, plan string, matches int, cost double, y array<int>, x array<int>, v array<int>, u array<int>")


def hausdorff(pairs: DataFrame, group: str) -> DataFrame:
    """(group, t, hausdorff): the greatest distance of a place of either side to the nearest place of the other, for each row
    of pairs(group, t, a, b)."""
    kind = dict(pairs.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for rows, cost, _ in _planned(_sides(batch), []):
                found[rows] = np.maximum(cost.min(2).max(1), cost.min(1).max(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], [group, "t", "hausdorff"])

    return pairs.select(group, "t", "a", "b").mapInArrow(run, f"{group} {kind}, t int, hausdorff double")
