"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that agree in at least one set of bit blocks (the pigeonhole principle: a radius of r leaves b - r of b
blocks untouched) meet in a bucket. A bucket stores its fingerprints vertically, one bit plane per bit and 64
fingerprints per machine word; a query's distances to 64 others are counted at once by carry-save adders, and words
whose 64 distances are all beyond the radius are abandoned after every few planes. Nothing is capped: a bucket that
is too large for one task is dealt out again by the blocks of its remaining bits, which is exact by the same
principle. Only a spanning star per bucket leaves a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .durable import durable, tasks_for
from .text import LOWER, pieces, utf8, words

BITS = 64
SEED = 42


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Majority fingerprint of each row's shingles; rows without a word have 0."""
    normal, starts, ends, first = words(LOWER[data], offsets)
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    many = np.maximum(counts[full] - shingle + 1, 1)
    group = np.zeros(len(full) + 1, np.int64)
    np.cumsum(many, out=group[1:])
    at = np.repeat(first[full] - group[:-1], many) + np.arange(group[-1])
    last = np.minimum(at + shingle, np.repeat(first[full + 1], many)) - 1
    raw, digest = normal.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[last].tolist())], np.uint64)
    sums = np.empty((len(full), BITS), np.int64)
    step = 1 << 17  # shingles unpacked at a time
    cuts = np.searchsorted(group, np.arange(0, group[-1], step))
    cuts = np.unique(np.append(cuts, len(full)))
    for lo, hi in zip(np.append(0, cuts[:-1]), cuts):
        if hi > lo:
            bits = np.unpackbits(h[group[lo] : group[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[lo:hi] = np.add.reduceat(bits, group[lo:hi] - group[lo], axis=0, dtype=np.int64)
    bits = (2 * sums > many[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a long whose bit is 1 if it is set in over half of the XXH64 of the row's word shingles.

    Words are runs of bytes other than ASCII space and 9 to 13, after A-Z are lower-cased. A text of fewer words than
    a shingle is one shingle; a null, empty or blank text has fingerprint 0. Repeats count. Null ids stay as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fp = _fingerprints(*utf8(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def within(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit-sliced distances of fps[query[k]] to the 64 fingerprints of word[k]: (query, word, lanes within radius).

    planes[j, w] holds bit j of 64 fingerprints. Carry-save counters ones, twos, fours and a sticky overflow count the
    differing bits of 64 lanes at once; pairs without a lane left are abandoned after every 8 planes. radius is 6 at most.
    """
    q = fps[query]
    ones, twos, fours, over = (np.zeros(len(q), np.uint64) for _ in range(4))
    lanes = over
    for j in range(BITS):
        d = planes[j, word] ^ (np.uint64(0) - (q >> np.uint64(j) & np.uint64(1)))
        carry = ones & d
        ones ^= d
        d = twos & carry
        twos ^= carry
        over |= fours & d
        fours ^= d
        if j % 8 == 7:
            far, equal = over.copy(), ~over
            for have, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
                if bit:
                    equal &= have
                else:
                    far |= equal & have
                    equal &= ~have
            lanes = ~far
            alive = lanes != 0
            if not alive.all():
                query, word, q, lanes = query[alive], word[alive], q[alive], lanes[alive]
                ones, twos, fours, over = ones[alive], twos[alive], fours[alive], over[alive]
            if not len(q):
                break
    return query, word, lanes


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[k] and b[k] in place; label[i] <= i points to a member, roots to themselves."""
    while len(a):
        x, y = label[a], label[b]
        while True:  # to the roots
            nx, ny = label[x], label[y]
            if (nx == x).all() and (ny == y).all():
                break
            x, y = nx, ny
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        a, b = a[apart], b[apart]
    while True:
        up = label[label]
        if (up == label).all():
            return
        label[:] = up


def _stars(bucket: np.ndarray, fps: np.ndarray, radius: int, pairs: int = 1 << 18) -> np.ndarray:
    """label[i]: the first row of i's class, where rows of one bucket that are within radius are linked.

    bucket is sorted. pairs: (fingerprint, word) pairs compared at a time, which bounds the memory.
    """
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(starts, n))
    width = -(-size // 64)
    base = np.cumsum(width) - width
    own = np.repeat(np.arange(len(starts)), size)
    lane = np.arange(n) - starts[own]
    slot = base[own] * 64 + lane
    bits = np.zeros((int(width.sum()) * 64, 8), np.uint8)
    bits[slot] = fps.view(np.uint8).reshape(-1, 8)
    row = np.zeros(len(bits), np.int64)
    row[slot] = np.arange(n)
    used = np.zeros(len(bits), np.uint8)
    used[slot] = 1
    used = np.packbits(used, bitorder="little").view(np.uint64)
    planes = np.packbits(np.unpackbits(bits, axis=1, bitorder="little").T, axis=1, bitorder="little")
    planes = np.ascontiguousarray(planes).view(np.uint64)
    # A query is compared with its own word and the later words of its bucket: each pair of rows once or twice.
    reach = width[own] - lane // 64
    reach[size[own] == 1] = 0
    upto = np.cumsum(reach)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs, "right")))
        many = reach[at:end]
        query = np.repeat(np.arange(at, end), many)
        word = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + (base[own] + lane // 64)[query]
        query, word, lanes = within(planes, fps, query, word, radius)
        lanes = lanes & used[word]
        for lo in range(0, len(query), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            on = np.unpackbits(np.ascontiguousarray(lanes[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(on)
            a, b = query[part][k], row[word[part][k] * 64 + bit]
            _roots(label, a[a != b], b[a != b])
        at = end
    return label


def _blocks(of: list[int], parts: int) -> list[list[int]]:
    return [[int(x) for x in p] for p in np.array_split(np.array(of), parts)]


def _masked(bits: list[int]) -> Column:
    """fp with all but the given bits cleared; as good a key as the bits moved together."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def near_classes(
    fps: DataFrame, radius: int = 4, per_bucket: int = 2048, largest: int = 32_768
) -> DataFrame:
    """(fp, component, n_rows) of every distinct fingerprint in fps(doc_id, fp): component is the smallest doc_id that
    can be reached over links of radius or fewer differing bits.

    per_bucket: wanted fingerprints in a bucket, from which the number of blocks follows; largest: buckets above it are
    dealt out again by the blocks of their remaining bits. Both change the cost only, never a link. Null ids count as
    rows but are never a component unless all ids of a class are null.
    """
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    n = distinct.count()
    spare = 1
    while spare < 3 and n / 2 ** (spare * BITS / (radius + spare)) > per_bucket:
        spare += 1
    tables = [sorted(sum(c, [])) for c in combinations(_blocks(list(range(BITS)), radius + spare), spare)]
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _masked(b).alias("k")) for t, b in enumerate(tables)])).alias("x")
    ).select("fp", F.xxhash64("x.t", "x.k").alias("bucket"), "x.t")
    crowded = durable(keyed.groupBy("bucket").count().where(F.col("count") > largest).select("bucket"))
    if crowded.limit(1).count():
        rest = [[b for b in range(BITS) if b not in set(t)] for t in tables]
        again = F.array(
            *[
                F.when(F.col("t") == t, F.struct(F.lit(s).alias("s"), _masked(b).alias("k")))
                for t, r in enumerate(rest)
                for s, b in enumerate(_blocks(r, radius + 1))
            ]
        )
        finer = (
            keyed.join(crowded, "bucket", "left_semi")
            .select("fp", "bucket", F.explode(F.array_compact(again)).alias("x"))
            .select("fp", F.xxhash64("bucket", "x.s", "x.k").alias("bucket"))
        )
        keyed = keyed.join(crowded, "bucket", "left_anti").select("fp", "bucket").unionByName(finer)
    keyed = keyed.select("bucket", "fp").repartition(tasks_for(fps.sparkSession), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def compared(upto: int, cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            bucket, fp = (c[:upto] for c in cols)
            same = bucket[1:] == bucket[:-1]
            met = np.append(False, same) | np.append(same, False)  # a fingerprint alone in its bucket has no link here
            bucket, fp = bucket[met], fp[met]
            first = _stars(bucket, fp.view(np.uint64), radius) if len(fp) else np.zeros(0, np.int64)
            links = np.flatnonzero(first != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[links]), pa.array(fp[first[links]])], ["a", "b"])

        for batch in batches:
            kept.append(tuple(batch.column(i).fill_null(0).to_numpy() for i in range(2)))
            cols = tuple(np.concatenate(c) for c in zip(*kept))
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if last >= 1 << 14:  # whole buckets only
                yield compared(last, cols)
                cols = tuple(c[last:] for c in cols)
            kept = [cols]
        if kept and len(kept[0][0]):
            yield compared(len(kept[0][0]), kept[0])

    linked = connected_components(keyed.mapInArrow(run, "a long, b long"))
    grouped = (
        distinct.join(linked, distinct.fp == linked.node, "left")
        .select("fp", "rep", "n_rows", F.coalesce("component", "fp").alias("root"))
    )
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    return grouped.join(least, "root").select("fp", "component", "n_rows")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, **sizes: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text, ...): see fingerprints and near_classes.

    Ties cannot arise: a component is named by its smallest doc_id. Copies meet as one fingerprint before anything is
    compared, so a group of any size costs one row. An empty table gives an empty table; extra columns are ignored.
    """
    fps = durable(fingerprints(docs, shingle))
    classes = near_classes(fps, radius, **sizes)
    return fps.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs, of each component only the rows that have its smallest doc_id; all columns stay as they are.

    Rows whose doc_id is null stay: they cannot be told apart.
    """
    classes = near_duplicates(docs, shingle, radius).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    return docs.join(classes.distinct(), docs.doc_id.eqNullSafe(F.col("_kept")), "left_semi")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
