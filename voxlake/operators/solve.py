"""The solve of captures: from cells with colour and depth to each frame's 256 colours and every cell's index.

Cells are keyed (capture, t, y, x), and packed by frame. Every step is a projection, an aggregation by frame or by capture, or a
fold over a capture's frames; joins are of rows of frames and captures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions import colour

from . import descent, ground, mixtures, packing, pairtree, sweep
from .lineage import cut, spread
from .pairtree import COVARIANCE, LAB

# The ground law of frames without a background, and the least share of the back phase that shows.
PRIOR = {"light": 0.6170482164370319, "alpha": -1.3176036044137163, "beta": ground.PRIOR_SLOPE}
FLOOR = 1 / 32

BYTES = ("r8", "g8", "b8")
BACK = ("mean_l", "mean_ln_c", "sd_ln_c", "hue_a", "hue_b")
MIDDLE = tuple(f"m_{c}" for c in LAB)
LAW = ("fitted", "capped", "delta_l", "alpha", "beta", "rot_a", "rot_b")


# Arrays of a frame's row, one value a cell: 16 bytes together.
CELLS = ("place", "rgb", "s")
ROW = 1 << 16  # a cell's place is y * ROW + x


@dataclass
class Solve:
    """captures(capture, fit, two_phase, gain), frames(capture, t, fit, ll, la, lb, c00, ..., axes, steps, and the ground's
    moments), packed cells and books with a row a frame; leaves, nodes16 and canonical as in pairtree,
    table(t, idx, r8, g8, b8), and cells with index are made from those where they are used."""

    captures: DataFrame
    frames: DataFrame
    packed: DataFrame
    books: DataFrame
    bleed: bool = True

    @property
    def leaves(self) -> DataFrame:
        return unpacked_leaves(self.books.select("t", "leaves"))

    @property
    def nodes16(self) -> DataFrame:
        return pairtree.nodes(self.books, ["t"], 4, 4).drop("depth")

    @property
    def canonical(self) -> DataFrame:
        return canonical(self.books)

    @property
    def table(self) -> DataFrame:
        return table(unpacked_leaves(self.books.select("t", "leaves", *LAW)))

    @property
    def cells(self) -> DataFrame:
        return self.assigned()

    def assigned(self, **ways: Callable) -> DataFrame:
        """The cells, (capture, t, y, x, ll, la, lb, share, pull, figure, leaf, d, index), and of each other way of descent its leaf
        and d, as columns of its name and its name with _d."""
        return assigned(self.packed, self.books, ways, self.bleed)

    @property
    def blocks(self) -> DataFrame:
        """(bt, by, bx, cells): the cells (v, code, pull, ll, la, lb) of every block of the sweep, whole or not, by their places v
        in it; code is the index. A layer has all of its blocks, so that no cell is dealt."""
        return assigned(self.packed, self.books, {}, self.bleed, as_blocks=True)


def phases(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures, frames): each capture's fit of its depths s and whether it has two phases, each frame's filtered fit."""
    captures = mixtures.verdict(cut(mixtures.fit(mixtures.counted(cells, "s", ["capture"])))).select("capture", "fit", "two_phase", "bic_one", "bic_two")
    per_frame = cut(mixtures.fit(mixtures.counted(cells, "s", ["capture", "t"])).select("capture", "t", "fit"))
    return captures, mixtures.filtered(per_frame, ["capture"], "t")


def staged(lab: tuple[Column, ...], s: Column, about: tuple[Column, ...]) -> tuple[Column, ...]:
    """A colour drawn towards its frame's centroid, the far ones more."""
    pull = 1 / (2 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    return tuple(c + pull * (v - c) for v, c in zip(lab, about))


def covered(cells: DataFrame, captures: DataFrame, frames: DataFrame, bleed: bool = True) -> DataFrame:
    """cells(capture, t, y, x, r, g, b, s) with their bytes' colour ll, la, lb and share, the back phase's share."""
    shown = tuple(colour.to_byte(F.col(c)) / 255 for c in ("r", "g", "b"))
    # Rows of captures meet rows of frames first, so that cells are joined once.
    both = frames.select("capture", "t", "fit").join(captures.select("capture", "two_phase"), "capture")
    rows = cells.withColumns(dict(zip(LAB, colour.oklab(shown)))).join(both, ["capture", "t"])
    return rows.withColumn("share", mixtures.coverage(F.col("s"), "fit", F.col("two_phase"), bleed)).drop("fit")


def smoothed_moments(frames: DataFrame) -> DataFrame:
    """frames(capture, t, ll, ..., c22, back) with the moments, and the backgrounds' vectors, as one filtered sequence a
    capture; the gain is that of the moments. Columns: capture, t, ll, ..., c22, gain, back."""
    names = [*LAB, *COVARIANCE]
    rows = frames.select("capture", "t", F.array(*names).alias("v"), "back")
    gains = mixtures.gain(rows, ["capture"], "t", "v")
    moments = mixtures.smoothed(rows, ["capture"], "t", "v", gains)
    back = mixtures.smoothed(rows, ["capture"], "t", "back", gains)
    return moments.join(back, ["capture", "t"]).join(gains, "capture").select("capture", "t", *[F.col("v")[k].alias(c) for k, c in enumerate(names)], "gain", "back")


def ground_of(frames: DataFrame, leaves: DataFrame) -> DataFrame:
    """frames(t, ll, back, ...) with delta_l, alpha, beta, rot_a, rot_b and fitted: the ground law that takes the leaves to
    the background, or the prior law where there is none."""
    back = frames.where(F.col("back").isNotNull()).select("t", F.col("ll").alias("centroid"), *[F.col("back")[k].alias(c) for k, c in enumerate(BACK)])
    law = ground.ground_moments(leaves, back, ["t"]).drop("delta_l")
    both = frames.join(law, "t", "left").withColumn("fitted", F.col("back").isNotNull()).withColumn("capped", F.col("back").isNull())
    light = F.when(F.col("fitted"), F.col("back")[0]).otherwise(PRIOR["light"])
    return both.withColumns({
        "delta_l": light - F.col("ll"), "alpha": F.coalesce("alpha", F.lit(PRIOR["alpha"])), "beta": F.coalesce("beta", F.lit(PRIOR["beta"])),
        "rot_a": F.coalesce("rot_a", F.lit(1.0)), "rot_b": F.coalesce("rot_b", F.lit(0.0)),
    })


def grounds(leaves: DataFrame) -> DataFrame:
    """leaves(ll, la, lb, and LAW's columns, ...) in their ground colours. A fitted law mirrors a colour about neutral at the
    background's lightness; another maps log chroma and turns hue, and raises no chroma where it is capped."""
    own = tuple(F.col(c) for c in LAB)
    light, a, b = ground.fitted_ground(own)
    to, chroma = F.sqrt(a * a + b * b), F.sqrt(own[1] * own[1] + own[2] * own[2])
    keep = F.when(F.col("capped") & (to > chroma), chroma / to).otherwise(1.0)
    law = zip(LAB, ground.balanced_ground(own), (light, a * keep, b * keep))
    return leaves.withColumns({c: F.when(F.col("fitted"), p).otherwise(q) for c, p, q in law})


def table(leaves: DataFrame) -> DataFrame:
    """(t, idx, r8, g8, b8) of leaves(t, leaf, ll, la, lb, r8, g8, b8, and LAW's columns): the displayed leaves, and their
    displayed grounds mirrored."""
    own = F.struct(F.col("leaf").alias("idx"), *BYTES)
    mirrored = F.struct((255 - F.col("leaf")).alias("idx"), *BYTES)
    both = pairtree.displayed(grounds(leaves.withColumn("own", own).drop(*BYTES)))
    return both.select("t", F.inline(F.array("own", mirrored)))


def packed(cells: DataFrame) -> DataFrame:
    """(capture, t, place, rgb, s): a row a frame, with its cells' places, bytes of colour and depths as arrays."""
    r, g, b = (colour.to_byte(F.col(c)) for c in ("r", "g", "b"))
    numbers = ((F.col("y") * ROW + F.col("x")).cast("int"), (r * (1 << 16) + g * (1 << 8) + b).cast("int"), F.col("s").cast("double"))
    return packing.packed(cells.select("capture", "t", *[v.alias(c) for c, v in zip(CELLS, numbers)]), ["capture", "t"], "t")


def _of_bytes(rows: DataFrame, number: str) -> DataFrame:
    """rows with r8, g8, b8, the low 24 bits of a number, and their colour ll, la, lb."""
    rows = rows.withColumns({c: F.shiftright(number, k).bitwiseAND(255) for c, k in zip(BYTES, (16, 8, 0))})
    return rows.withColumns(dict(zip(LAB, colour.oklab(tuple(F.col(c) / 255 for c in BYTES)))))


def unpacked(frames: DataFrame) -> DataFrame:
    """The cells of packed() with ll, la, lb, s and the further columns of frames; their places stay packed."""
    return _of_bytes(frames.select(*[c for c in frames.columns if c not in CELLS], F.inline(F.arrays_zip("rgb", "s"))), "rgb").drop("rgb", *BYTES)


def packed_leaves(leaves: DataFrame) -> DataFrame:
    """(t, leaves): of each frame its leaves in order, one number each: the leaf above its three bytes."""
    number = sum((F.col(c) * (1 << k) for c, k in zip(BYTES, (16, 8, 0))), F.col("leaf") * (1 << 24)).cast("int").alias("leaves")
    return packing.packed(leaves.select("t", number), ["t"], "t").withColumn("leaves", F.array_sort("leaves"))


def unpacked_leaves(books: DataFrame) -> DataFrame:
    """(t, leaf, ll, la, lb, r8, g8, b8, ...) of books(t, leaves, ...)."""
    rows = books.select(*[c for c in books.columns if c != "leaves"], F.explode("leaves").alias("_n")).withColumn("leaf", F.shiftright("_n", 24))
    return _of_bytes(rows, "_n").drop("_n")


def _shelf(books: pa.StructArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(frames, 128, 3) leaves and the nodes of each depth down to 4 of rows of books."""
    leaves = colour.oklab_of(books.field("leaves").flatten().to_numpy()).reshape(len(books), -1, 3)
    return leaves, pairtree.levels([books.field(c) for c in (*LAB, "steps")], 4)


def canonical(books: DataFrame) -> DataFrame:
    """(t, node, leaf): of each depth-4 node's eight leaves that nearest to its mean, the lowest on ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, levels = _shelf(batch.to_struct_array())
            found = pa.array(descent.canonical(leaves, levels[4]).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * 16), found)], ["t", "leaf"])

    rows = books.select("t", *LAB, "steps", "leaves").mapInArrow(run, T.StructType([books.schema["t"], T.StructField("leaf", T.ArrayType(T.IntegerType()))]))
    return rows.select("t", F.posexplode("leaf").alias("node", "leaf"))


def assigned(frames: DataFrame, books: DataFrame, ways: dict[str, Callable], bleed: bool = True, as_blocks: bool = False, coarse: int = sweep.SIDE) -> DataFrame:
    """The cells of packed frames(capture, t, place, rgb, s, cross, tau) with their indices by three rungs and the ordered
    dither, see Solve.assigned(). books(t, m_ll, m_la, m_lb, ll, la, lb, steps, leaves). A layer of coarse blocks is one row, so
    frames are dealt once for the rungs, the dither and all ways. as_blocks: as in Solve.blocks."""
    doubles, ints = lambda *names: [T.StructField(c, T.DoubleType()) for c in names], lambda *names: [T.StructField(c, T.IntegerType()) for c in names]
    schema = T.StructType([frames.schema["capture"], *ints("t", "y", "x"), *doubles(*LAB, "share"), *ints("leaf"), *doubles("d"), *ints("index"), *[f for c in ways for f in (*ints(c), *doubles(f"{c}_d"))]])
    if as_blocks:
        cell = T.StructType([*ints("v", "code"), *doubles("pull", *LAB)])
        schema = T.StructType([*ints("bt", "by", "bx"), T.StructField("cells", T.ArrayType(cell))])

    def decide(rows: pa.StructArray, trees: pa.StructArray) -> list[pa.Array]:
        frame, (leaves, levels) = trees.field("t").to_numpy(), _shelf(trees)
        cells = {c: rows.field(c).flatten() for c in CELLS}
        own = np.repeat(np.arange(len(rows)), np.asarray(rows.field("place").value_lengths()))
        at = cells["place"].to_numpy().astype(np.int64)
        t = rows.field("t").to_numpy().astype(np.int64)[own]
        place = np.column_stack([t, at // ROW, at % ROW])
        s, missing = cells["s"].to_numpy(zero_copy_only=False), np.asarray(cells["s"].is_null())
        cross, tau = (rows.field(c).to_numpy(zero_copy_only=False)[own] for c in ("cross", "tau"))
        with np.errstate(all="ignore"):
            share = np.where(np.isnan(tau), 0.0, 1 / (1 + np.exp((s - cross) / tau)))
        if not bleed:
            share = np.where(share < 0.5, 0.0, 1.0)
        # As staged() does: no depth counts as 0, and one that is no number as 1.
        near = np.where(missing, 0.0, np.where(np.isnan(s), 1.0, np.clip(s, 0, 1)))
        book = descent.finder(frame)(t)
        about = np.column_stack([trees.field(f"m_{c}").to_numpy() for c in LAB])[book]
        points = about + (1 / (2 - near))[:, None] * (colour.oklab_of(cells["rgb"].to_numpy()) - about)
        kept, leaf, d = descent.rungs(place, points, frame, leaves, levels[4], coarse)
        place, points, share, own, book = place[kept], points[kept], share[kept], own[kept], book[kept]
        pooled = descent.pooled(place, points, frame, leaves, levels[4], coarse)
        index = descent.dithered(place, leaf, pooled, share < FLOOR, share)
        shares, lab = pa.array(share, mask=missing[kept] & ~np.isnan(tau[kept])), [pa.array(v) for v in points.T]
        if as_blocks:
            return sweep.arrays(place, {"code": pa.array(index), "pull": shares, **dict(zip(LAB, lab))})
        more = []
        ends = np.append(np.flatnonzero(np.diff(book, prepend=-1)), len(book))
        for way in ways.values():
            found, gap = np.empty(len(book), np.int32), np.empty(len(book))
            for a, b in zip(ends, ends[1:]):
                k = book[a]
                found[a:b], gap[a:b] = way(points[a:b], leaves[k], levels[4][k], levels[1][k])
            more += [pa.array(found), pa.array(gap)]
        numbers = [pa.array(v.astype(np.int32)) for v in place.T]
        return [rows.field("capture").take(pa.array(own)), *numbers, *lab, shares, pa.array(leaf), pa.array(d), pa.array(index), *more]

    layers = descent.by_layer(frames.select("capture", "t", *CELLS, "cross", "tau"), books.select("t", *[f"m_{c}" for c in LAB], *LAB, "steps", "leaves"), coarse)
    found = descent.in_layers(layers, decide, schema)
    return found if as_blocks else found.withColumn("figure", F.col("share") < FLOOR).withColumn("pull", F.col("share"))


def solve(cells: DataFrame, bleed: bool = True, depth: int = pairtree.DEPTH) -> Solve:
    """Solve every capture of cells(capture, t, y, x, r, g, b, s): phases, staging, filtered moments, trees, tables, and
    indices by three rungs and the ordered dither. bleed: shares are posteriors; depth: the leaves' level in the tree.

    Frames are known by t alone. A frame without mass in front has a grey tree; a capture of one phase, or frames before the
    first background, take the prior ground law. An empty table gives empty tables. Cells are written once, packed by frame;
    tables of cells and of leaves are made from rows of frames, and not written.
    """
    captures, fits = (cut(x) for x in phases(cells))
    both = fits.select("capture", "t", "fit").join(captures.select("capture", "two_phase"), "capture")
    # Dealt by the key that packs them, frames meet their fits where they lie.
    rows = packed(cells).join(both, ["capture", "t"])
    known = F.col("two_phase") & ~mixtures.degenerate()
    rows = cut(rows.withColumn("cross", F.when(known, mixtures.crossover())).withColumn("tau", F.when(known, mixtures.temperature())))
    lit = lambda df: unpacked(df).withColumn("share", mixtures.coverage(F.col("s"), "fit", F.col("two_phase"), bleed))
    front = 1 - F.col("share")
    # The background's moments are read before staging, which draws its hue to the front's.
    sums = lit(rows).groupBy("t").agg(*pairtree.middle(front), *ground.background_sums(F.when(F.col("two_phase"), F.col("share"))))
    back = F.struct(*ground.background()).alias("back")
    middles = cut(sums.select("t", *MIDDLE, back).withColumn("back", F.when(F.col("back.mean_ln_c").isNotNull(), F.array(*[f"back.{c}" for c in BACK]))))
    own, about = tuple(F.col(c) for c in LAB), tuple(F.col(c) for c in MIDDLE)
    shown = lit(rows.join(middles, "t")).withColumns(dict(zip(LAB, staged(own, F.col("s"), about))))
    shown = shown.withColumns(dict(zip(BYTES, colour.srgb8(own)))).withColumns(dict(zip(LAB, colour.oklab(tuple(F.col(c) / 255 for c in BYTES)))))
    frames = cut(pairtree.moments(shown, ["capture", "t"], front).join(middles.select("t", "back"), "t"))
    # A frame's row is short, so that few tasks would take them all, but axes and leaves cost much.
    frames = cut(spread(smoothed_moments(frames), "t").withColumn("axes", pairtree.axes()))
    frames = cut(frames.withColumn("steps", pairtree.generations()))
    leaves = cut(packed_leaves(pairtree.figures(frames, ["t"], depth)))
    laws = cut(ground_of(frames, unpacked_leaves(leaves)))
    books = cut(spread(laws.select("t", *LAB, "steps", *LAW).join(leaves, "t").join(middles.select("t", *MIDDLE), "t"), "t"))
    return Solve(captures, laws.join(fits.select("t", "fit"), "t"), rows, books, bleed)
