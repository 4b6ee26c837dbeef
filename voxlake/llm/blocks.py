"""Links of similar sets in buckets and clusters of any size: square blocks of chunks, of which only forests are sent.

A judge tells by signatures which pairs may be similar: of many blocks' sides (sig, n, other sig, other n) it gives a matrix
of booleans each, in order. Most blocks are small, so it sees a batch of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .durable import durable, tasks_for
from .shingles import _few, _members
from .simhash import _roots
from .text import release

LINKS = 100_000  # a task's in the rounds that find components

Judge = Callable[[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]], Iterator[np.ndarray]]


def _neighbours(differing: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int):
    """(a, b, apart), a < b, of rows (bucket, set, sig), sorted by bucket: each set with the one before it and with the first of its
    bucket here, where their signatures are apart by most or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # the row before, and the first of its bucket: bucket, set, sig
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, name = (batch.column(k).to_numpy() for k in range(2))
            sig = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            if last is not None:
                bucket, name, sig = (np.concatenate([np.stack([f, x]), v]) for f, x, v in zip(first, last, (bucket, name, sig)))
            new = np.append(True, bucket[1:] != bucket[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            at = np.flatnonzero(~new)
            x, y = np.append(at, at), np.append(at - 1, head[at])
            apart = differing(sig[x].view(np.uint64), sig[y].view(np.uint64))
            keep = (apart <= most) & (name[x] != name[y])
            a, b = name[x[keep]], name[y[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(apart[keep].astype(np.int32))], ["a", "b", "apart"])
            first, last = ((v[k].copy() for v in (bucket, name, sig)) for k in (head[-1], -1))
            first, last = tuple(first), tuple(last)
        release()

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Those of the durable pairs(a, b) whose full sets are as similar as least."""
    num, den = least
    need = durable(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())
    sets = durable(_members(texts.join(_few(need), "set", "left_semi").dropDuplicates(["set"]), shingle))
    own = lambda name, members: sets.select(F.col("set").alias(name), F.col("members").alias(members))
    full = pairs.select("a", "b").join(own("a", "x"), "a").join(own("b", "y"), "b")
    return full.where(F.size(F.array_intersect("x", "y")) * (num + den) >= (F.size("x") + F.size("y")) * num).select("a", "b")


def _shared_members(x: list[np.ndarray], y: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """(len(x), len(y)) sizes of the intersections of sets of hashes, by products of incidence matrices of slab members each."""
    flat = [np.concatenate(part) for part in (x, y)]
    common = np.intersect1d(*flat)
    code, own = [], []
    for part, values in zip((x, y), flat):
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        code.append(at[hit])
        own.append(np.repeat(np.arange(len(part)), [len(m) for m in part])[hit])
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(common), slab):
        sides = []
        for k, part in enumerate((x, y)):
            here = (code[k] >= low) & (code[k] < low + slab)
            side = np.zeros((len(part), slab), np.float32)
            side[own[k][here], code[k][here] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T  # whole numbers far below 2 ** 24, so exact
    return out


def _in_blocks(rows: DataFrame, group: str, least: tuple[int, int], judge: Judge) -> DataFrame:
    """(a, b): pairs of components c that join those of a group as all pairs of sets would that are judged to be similar and
    whose components differ; a block sends fewer than it has components.

    rows(group, chunks, set, c, sig, n, members): a group's sets are dealt to its chunks, and each pair of chunks is one
    block in one task. Pairs are judged by their signatures, by judge; where members are given, by their full sets then.
    """
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(F.col(group).alias("group"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "c", "n", "sig", "members")
    num, den = least

    def sides(table: pa.Table) -> tuple[np.ndarray, ...]:
        """A block's rows on its two sides, and its columns."""
        own, c, n = (table.column(k).to_numpy() for k in ("own", "c", "n"))
        i, j = (table.column(k)[0].as_py() for k in ("i", "j"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(own), -1).view(np.uint64)
        return np.flatnonzero(own == i), np.flatnonzero(own == j), c, n, sig

    def joined(table: pa.Table, on_i: np.ndarray, on_j: np.ndarray, c: np.ndarray, n: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = table.column("members").combine_chunks()
        exact = lists.null_count == 0
        if exact:
            cut, flat = np.asarray(lists.offsets), lists.values.to_numpy()
        parts, c = np.unique(c, return_inverse=True)
        label = np.arange(len(parts))
        for low in range(0, len(on_i), 256):
            x = on_i[low : low + 256]
            small, large = np.minimum(n[x][:, None], n[on_j][None, :]), np.maximum(n[x][:, None], n[on_j][None, :])
            like = near[low : low + 256] & (label[c[x]][:, None] != label[c[on_j]][None, :]) & (small * den >= large * num)
            if exact and like.any():
                p, q = np.flatnonzero(like.any(1)), np.flatnonzero(like.any(0))
                both = _shared_members(*([flat[cut[r] : cut[r + 1]] for r in some] for some in (x[p], on_j[q])))
                like[np.ix_(p, q)] &= both * (num + den) >= num * (n[x[p]][:, None] + n[on_j[q]][None, :])
            at, to = np.nonzero(like)
            _roots(label, c[x[at]], c[on_j[to]])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return parts[moved], parts[label[moved]]

    def compared(tables: list[pa.Table]) -> pa.RecordBatch:
        known = [sides(t) for t in tables]
        found = judge([(sig[on_i], n[on_i], sig[on_j], n[on_j]) for on_i, on_j, _, n, sig in known])
        links = [joined(t, *k[:4], near) for t, k, near in zip(tables, known, found)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*links)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = [table.column(k).to_numpy() for k in ("group", "i", "j")]
            new = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])))
            if len(new) > 1:
                yield compared([table.slice(a, b - a) for a, b in zip(new[:-1], new[1:])])
            held = table.slice(new[-1]).to_batches()
        if held:
            yield compared([pa.Table.from_batches(held)])
        release()

    key = ["group", "i", "j"]
    dealt = rows.repartition(tasks_for(rows.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _clusters(met: DataFrame, sets: DataFrame, least: tuple[int, int], judge: Judge, chunk: int) -> DataFrame:
    """(c, cluster) of the components with a set that shares a bucket with, and by its signature may be similar to, a set of
    another one: any two such components have one cluster. met(bucket, set, c) is durable; buckets of one component are left."""
    several = met.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    several = several.select("bucket", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks"))
    rows = met.join(several, "bucket").join(sets.select("set", "sig", "n"), "set").withColumn("members", F.lit(None).cast("array<long>"))
    return connected_components(_in_blocks(rows, "bucket", least, judge), LINKS).select(F.col("node").alias("c"), F.col("component").alias("cluster"))


def _links_within(clusters: DataFrame, sets: DataFrame, named: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int], judge: Judge, chunk_members: int) -> DataFrame:
    """(a, b): links of components of named(set, c), themselves sets, that join them as all links between their sets do."""
    held = sets.select("set", "sig", "n").join(named, "set", "left").withColumn("c", F.coalesce("c", "set"))
    held = durable(held.join(_few(clusters), "c"))
    sizes = held.groupBy("cluster").agg(F.ceil(F.sum("n") / chunk_members).cast("int").alias("chunks"))
    members = _members(texts.join(_few(held.select("set")), "set", "left_semi").dropDuplicates(["set"]), shingle)
    return _in_blocks(held.join(sizes, "cluster").join(members, "set"), "cluster", least, judge)
