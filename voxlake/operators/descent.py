"""Assignment of cells to the leaves of their frame's tree: exhaustive, greedy, and by three rungs with lookahead.

The codebook of a frame is one row of arrays. Where every cell is assigned, a frame's cells are packed into one row, which the
frame's size bounds, and meet the codebook there as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairtree import LAB

GROUP = 8  # leaves of a node, and nodes of a half
BACKGROUND = 255

# The ordered dither's ranks of a cell's place in its 4 x 4 square.
BAYER = ((0, 8, 2, 10), (12, 4, 14, 6), (3, 11, 1, 9), (15, 7, 13, 5))


def books(leaves: DataFrame, nodes16: DataFrame, by: list[str]) -> DataFrame:
    """(by, leaves, nodes): each frame's 128 leaves (leaf, ll, la, lb) and 16 nodes (node, ll, la, lb) as arrays in order."""
    rows = lambda df, key, name: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), *LAB))).alias(name))
    return rows(leaves, "leaf", "leaves").join(rows(nodes16, "node", "nodes"), by)


def nearest(book: Column, point: tuple[Column, Column, Column]) -> Column:
    """(d, k) of the entry of book nearest to a point, the lowest k on ties."""
    gap = lambda w: tuple(w[c] - p for c, p in zip(LAB, point))
    d2 = lambda g: g[0] * g[0] + g[1] * g[1] + g[2] * g[2]
    return F.array_min(F.transform(book, lambda w: F.struct(d2(gap(w)).alias("d"), w["k"].alias("k"))))


def point() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) for c in LAB)


def _least(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, d) of the entry nearest to each of points (n, 3), the lowest k on ties; book is (m, 3), or (n, m, 3) with each
    point's own entries."""
    gap = [book[..., c] - points[:, c, None] for c in range(3)]
    d = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
    k = d.argmin(1)
    return k, d[np.arange(len(d)), k]


def _by_frame(cells: DataFrame, books: DataFrame, by: list[str], decide: Callable, frames_at_once: int = 64) -> DataFrame:
    """cells with leaf and d, as decide(points, *books) gives them for the cells of a frame, from the frame's row of books."""
    names = [c for c in books.columns if c not in by]
    kept = [c for c in cells.columns if c not in (*by, "leaf", "d")]
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct(*kept)).alias("_cells")).join(books, by).select(*by, "_cells", *names)
    schema = T.StructType([*[cells.schema[c] for c in (*by, *kept)], T.StructField("leaf", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def array(rows: pa.StructArray) -> np.ndarray:
        return np.column_stack([rows.field(c).to_numpy(zero_copy_only=False) for c in LAB])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, frames_at_once):
                batch = whole.slice(low, frames_at_once)
                lists, size = batch.column(len(by)), batch.num_rows
                flat = lists.flatten()
                ends = np.cumsum(np.asarray(lists.value_lengths()))
                points = array(flat)
                leaf, d = np.empty(len(flat), np.int32), np.empty(len(flat))
                for row, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                    own = [array(batch.column(len(by) + 1 + k)[row].values) for k in range(len(names))]
                    leaf[a:b], d[a:b] = decide(points[a:b], *own)
                frame = pa.array(np.repeat(np.arange(size), np.diff(ends, prepend=0)))
                columns = [*[batch.column(k).take(frame) for k in range(len(by))], *[flat.field(c) for c in kept], pa.array(leaf), pa.array(d)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return packed.mapInArrow(run, schema)


def all_leaves(points: np.ndarray, leaves: np.ndarray, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, d): the nearest of all 128."""
    return _least(points, leaves)


def by_means(points: np.ndarray, leaves: np.ndarray, nodes: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, d), each level committed to its nearest mean: a half, a node, a leaf."""
    node = _least(points, halves)[0] * GROUP
    node = node + _least(points, nodes.reshape(-1, GROUP, 3)[node // GROUP])[0]
    return _within(points, node, leaves)


def exhaustive(cells: DataFrame, books: DataFrame, by: list[str]) -> DataFrame:
    """cells with leaf, the nearest of all 128, and d, its squared distance."""
    return _by_frame(cells, books.select(*by, "leaves"), by, all_leaves)


def greedy(cells: DataFrame, books: DataFrame, halves: DataFrame, by: list[str]) -> DataFrame:
    """cells with leaf and d, each level committed to its nearest mean: a half of halves(by, node, ll, la, lb), a node, a leaf."""
    two = halves.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("k"), *LAB))).alias("halves"))
    return _by_frame(cells, books.select(*by, "leaves", "nodes").join(two, by), by, by_means)


def _within(points: np.ndarray, node: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, d): the nearest of the leaves of each point's node."""
    node = node.astype(np.int64)
    k, d = _least(points, leaves.reshape(-1, GROUP, 3)[node])
    return node * GROUP + k, d


def _means(key: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, own, means): of each distinct row of key a row that has it, each row's distinct row, and the mean of its points."""
    code = np.zeros(len(key), np.int64)
    for c in key.T:
        code = code * (int(c.max(initial=0)) + 1) + c
    _, first, own = np.unique(code, return_index=True, return_inverse=True)
    count = np.bincount(own, minlength=len(first))
    return first, own, np.column_stack([np.bincount(own, points[:, k], len(first)) / count for k in range(3)])


def finder(frames: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of frames t that gives the place of each among frames, of another one where it is missing."""
    order = np.argsort(frames)
    return lambda t: order[np.minimum(np.searchsorted(frames, t, sorter=order), len(order) - 1)]


def rungs(place: np.ndarray, points: np.ndarray, frames: np.ndarray, leaves: np.ndarray, nodes: np.ndarray, coarse: int = 4, mid: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, leaf, d) of the cells at place (n, 3: t, y, x) whose blocks have their trees: leaves and nodes of frames, in any
    order. See three_rungs()."""
    half_size = GROUP * GROUP
    tree = finder(frames)
    t = place[:, 0]
    wanted = (t, t // mid * mid, t // coarse * coarse)
    rows = np.flatnonzero(np.logical_and.reduce([frames[tree(w)] == w for w in wanted]))
    place, points, t = place[rows], points[rows], t[rows]
    first, own, means = _means(place // mid, points)
    block = place[first]  # a cell of each mid block
    _, above, _ = _means(block // coarse, means)
    upper = nodes.reshape(-1, 2, GROUP, 3)[tree(block[:, 0] // coarse * coarse)]
    cost = [np.bincount(above, _least(means, upper[:, h])[1]) for h in range(2)]
    half = (cost[1] < cost[0]).astype(np.int64)[above]
    node = half * GROUP + _least(means, leaves.reshape(-1, 2, half_size, 3)[tree(block[:, 0] // mid * mid), half])[0] // GROUP
    node = node[own]
    k, d = _least(points, leaves.reshape(-1, 2 * GROUP, GROUP, 3)[tree(t), node])
    return rows, (node * GROUP + k).astype(np.int32), d


def three_rungs(cells: DataFrame, books: DataFrame, coarse: int = 4, mid: int = 2, layers_at_once: int = 32) -> DataFrame:
    """cells(t, y, x, ll, la, lb, ...) with leaf and d, each bit decided once at its own rung.

    Every coarse block takes the half whose nodes lie nearer to its mid blocks' means, summed; every mid block the node of
    that half with the leaf nearest to its mean; every cell the nearest leaf of that node. A block reads the tree of its
    first frame. Blocks at the edge of a part-filled frame hold the cells that there are. The frames of a layer of coarse
    blocks are one row, which their size bounds, so cells are dealt once for all rungs. coarse is a multiple of mid.
    """
    kept = [c for c in cells.columns if c not in ("t", "leaf", "d")]
    packed = by_layer(cells.select("t", *kept), books.select("t", "leaves", "nodes"), coarse)
    schema = T.StructType([*[cells.schema[c] for c in ("t", *kept)], T.StructField("leaf", T.IntegerType()), T.StructField("d", T.DoubleType())])
    table = lambda rows: np.column_stack([rows.field(c).to_numpy(zero_copy_only=False) for c in LAB])

    def run(flat: pa.StructArray, trees: pa.StructArray) -> list[pa.Array]:
        place = np.column_stack([flat.field(c).to_numpy().astype(np.int64) for c in ("t", "y", "x")])
        rows, leaf, d = rungs(place, table(flat), trees.field("t").to_numpy(), *[table(trees.field(c).flatten()) for c in ("leaves", "nodes")], coarse, mid)
        here = pa.array(rows)
        return [*[flat.field(c).take(here) for c in ("t", *kept)], pa.array(leaf), pa.array(d)]

    return in_layers(packed, run, schema, layers_at_once)


def by_layer(rows: DataFrame, trees: DataFrame, frames: int) -> DataFrame:
    """(rows, trees): of each layer of so many frames the rows of both tables (t, ...), as structs, which a frame's size bounds."""
    layer = F.expr(f"cast(t div {frames} as int)").alias("_layer")
    lists = [df.groupBy(layer).agg(F.collect_list(F.struct(*df.columns)).alias(name)) for df, name in ((rows, "rows"), (trees, "trees"))]
    return lists[0].join(lists[1], "_layer").select("rows", "trees")


def in_layers(packed: DataFrame, decide: Callable, schema: T.StructType, layers_at_once: int = 32) -> DataFrame:
    """What decide(rows, trees) gives for some layers of by_layer() together, as columns of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, layers_at_once):
                batch = whole.slice(low, layers_at_once)
                yield pa.RecordBatch.from_arrays(decide(batch.column(0).flatten(), batch.column(1).flatten()), schema.names)

    return packed.mapInArrow(run, schema)


def roles(leaf: Column, figure: Column) -> Column:
    """A figure's leaf as it is, another's mirrored."""
    return F.when(figure, leaf).otherwise(BACKGROUND - leaf)


def bayer(y: Column, x: Column) -> Column:
    """The dither's threshold at a place, from 1/32 to 31/32."""
    square = F.array(*[F.lit((v + 0.5) / 16) for row in BAYER for v in row])
    return square[(y % 4 * 4 + x % 4).cast("int")]


def canonical(leaves: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """(frames, 16): of each node's eight of leaves (frames, 128, 3) that nearest to it, the lowest on ties."""
    own = leaves.reshape(-1, GROUP, 3)
    return _least(nodes.reshape(-1, 3), own)[0].reshape(len(leaves), -1) + GROUP * np.arange(nodes.shape[1])


def pooled(place: np.ndarray, points: np.ndarray, frames: np.ndarray, leaves: np.ndarray, nodes: np.ndarray, rung: int = 4) -> np.ndarray:
    """The mirrored canonical leaf, in its frame, of the node nearest to the mean of each cell's rung^3 block: a frame's part
    of a block takes one. Every cell's frame is among frames."""
    tree, canon = finder(frames), canonical(leaves, nodes)
    _, block, means = _means(place // rung, points)
    _, first, part = np.unique(block * rung + place[:, 0] % rung, return_index=True, return_inverse=True)
    at = tree(place[first, 0])
    return (BACKGROUND - canon[at, _least(means[block[first]], nodes[at])[0]]).astype(np.int32)[part]


def dithered(place: np.ndarray, leaf: np.ndarray, pooled: np.ndarray, figure: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Each cell's index after the ordered dither: a figure's leaf; of others the leaf, its partner on the figure side, where
    the threshold reaches the pull, and else what its block has pooled."""
    threshold = (np.array(BAYER)[place[:, 1] % 4, place[:, 2] % 4] + 0.5) / 16
    return np.where(figure | (threshold >= pull), leaf, pooled)
