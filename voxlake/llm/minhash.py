"""b-bit MinHash near-duplicates: band candidates, packed low bits of minima, links confirmed on full sets.

Each distinct set of word shingles gets ROWS * BANDS minima. Hashes of ROWS full minima are its bands' keys, and of every
minimum only the two low bits are kept, as two bit planes in 64-bit words. Sets that share a band's key are candidates; the
number of differing places of two signatures, one popcount a word, gives their similarity once the quarter of chance hits is
taken out. Candidates whose estimate lies seven standard deviations below the threshold go; the others are confirmed on
their full sets.

A pair at the threshold itself shares no band with a probability of (1 - 0.8 ** 6) ** 84, below 1e-11, and is dropped by its
estimate with about 1e-12; any pair above it with less. Nothing else is lost: buckets have no cap. A bucket's sets first meet
their neighbours and the bucket's first set; each set's best candidate is confirmed first, so that a group of near copies
becomes one component at the cost of a pair a set. Buckets that still hold several components are dealt out in square blocks
of chunks, where the signatures of all their pairs are judged in tasks of bounded size; what leaves a block is a spanning
forest of its components under the pairs that pass. Its trees are clusters: any pair left to confirm lies in one. So each set
of a cluster is sent once more, with its members, and the clusters' blocks compare full sets and again send forests.

Sets and their members are known by 64-bit hashes; rows of one set count as copies and meet as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LINKS, Judge, _clusters, _confirmed, _links_within, _neighbours
from .components import connected_components
from .durable import durable, tasks_for
from .shingles import _names, _sets, _texts
from .text import mixed, pieces, release, utf8

ROWS = 6
BANDS = 84
K = ROWS * BANDS
WORDS = -(-K // 64)
CHANCE = 0.25  # of two unequal minima to agree in both low bits

_RNG = np.random.default_rng(12)
_SHIFT, _ODD, _LAST = (_RNG.integers(0, 1 << 32, K, dtype=np.uint32) for _ in range(3))
_ODD |= np.uint32(1)
_LAST |= np.uint32(1)


def minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(K, rows) least values of K hash functions over each row's members h[first[r]:first[r + 1]], rows not empty."""
    low = h.astype(np.uint32)
    out = np.empty((K, len(first) - 1), np.uint32)
    for k in range(K):
        x = (low ^ _SHIFT[k]) * _ODD[k]
        x ^= x >> np.uint32(15)
        x *= _LAST[k]
        out[k] = np.minimum.reduceat(x, first[:-1])
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """(rows, 2 * WORDS) packed low bits of minima: WORDS words of the lowest bits, then of the second ones."""
    bits = np.zeros((2, WORDS * 64, least.shape[1]), np.uint8)
    bits[0, :K] = least & np.uint32(1)
    bits[1, :K] = least >> np.uint32(1) & np.uint32(1)
    packed = np.packbits(bits, axis=1, bitorder="little")  # (2, 8 * WORDS, rows)
    return np.ascontiguousarray(packed.transpose(2, 0, 1)).view(np.int64).reshape(least.shape[1], 2 * WORDS)


def band_keys(least: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys of the bands, told apart by the band's number."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], (BANDS, least.shape[1]))
    for r in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS].astype(np.uint64))
    return np.ascontiguousarray(h.T).view(np.int64)


def most_apart(least: tuple[int, int], deviations: float = 7) -> int:
    """Differing places beyond which a pair is taken to be less similar than least."""
    differ = (1 - CHANCE) * (1 - least[0] / least[1])
    return math.ceil(K * differ + deviations * math.sqrt(K * differ * (1 - differ)))


def estimated(apart):
    """Similarity that the number of differing places tells, corrected for chance hits."""
    return 1 - apart / K / (1 - CHANCE)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set, n, sig, keys) of docs(doc_id, text); a row without words has no sig and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, first = _sets(*utf8(batch.column(1)), shingle)
            n = np.diff(first)
            some = np.flatnonzero(n)
            sig, keys = np.zeros((0, 2 * WORDS), np.int64), np.zeros((0, BANDS), np.int64)
            if len(some):
                least = minima(h, np.append(first[some], len(h)))
                sig, keys = signatures(least), band_keys(least)
            lists = []
            for values, width in ((sig, 2 * WORDS), (keys, BANDS)):
                cuts = np.append(0, np.cumsum((n > 0) * width)).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_names(h, first)), pa.array(n), *lists], ["doc_id", "set", "n", "sig", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set long, n long, sig array<long>, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (bucket, set), sorted by bucket, whose bucket has another row, here or maybe in the next partition."""
    bucket, name, met = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row is not known yet

    def out(bucket: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(name)], ["bucket", "set"])

    for batch in batches:
        bucket, name = (np.append(x, batch.column(k).to_numpy()) for k, x in enumerate((bucket, name)))
        if len(bucket) < 2:
            continue
        same = bucket[1:] == bucket[:-1]
        keep = np.append(met, same[:-1]) | same
        yield out(bucket[:-1][keep], name[:-1][keep])
        bucket, name, met = bucket[-1:], name[-1:], bool(same[-1])
    if len(bucket):
        yield out(bucket, name)
    release()


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in which signatures x and y, of rows of words, differ."""
    apart = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.uint16)
    for k in range(WORDS):
        apart += np.bitwise_count((x[..., k] ^ y[..., k]) | (x[..., k + WORDS] ^ y[..., k + WORDS]))
    return apart


def _judge(least: tuple[int, int]) -> Judge:
    """Pairs whose signatures differ in no more places than most_apart."""
    most = most_apart(least)

    def judge(blocks: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
        for sig, _, other, _ in blocks:
            yield np.concatenate([_differing(sig[low : low + 256, None, :], other[None, :, :]) <= most for low in range(0, len(sig), 256)] or [np.zeros((0, len(other)), bool)])

    return judge


def near_documents(docs: DataFrame, shingle: int = 2, least: tuple[int, int] = (4, 5), chunk: int = 1024, chunk_members: int = 1 << 17) -> DataFrame:
    """(doc_id, n, component_id) of every row of docs(doc_id, text, ...): n is the size of its set of distinct word shingles,
    component_id the smallest doc_id that can be reached over links of sets with a Jaccard similarity of least or more.

    Words are runs of signs other than ASCII space and 9 to 13, after A-Z are lower-cased; fewer words than a shingle are one
    shingle. Null, empty and blank texts have n 0 and are linked with nothing, not even with each other. Rows of one set are
    linked. Null ids name a component only where all are null. Other columns are ignored; an empty table gives no rows.
    chunk: sets of a bucket's chunk, and chunk_members: members of a cluster's chunk; both change the cost only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(_signed(docs, shingle))
    sets = durable(rows.where("n > 0").groupBy("set").agg(F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.min("doc_id").alias("rep")))
    keyed = sets.select(F.explode("keys").alias("bucket"), "set")
    dealt = keyed.repartitionByRange(tasks_for(docs.sparkSession), "bucket", "set").sortWithinPartitions("bucket", "set")
    met = durable(dealt.mapInArrow(_shared, "bucket long, set long"))
    texts = _texts(docs, shingle)

    signed = met.join(sets.select("set", "sig"), "set").select("bucket", "set", "sig").repartitionByRange(tasks_for(docs.sparkSession), "bucket", "set")
    near = signed.sortWithinPartitions("bucket", "set").mapInArrow(_neighbours(_differing, most_apart(least)), "a long, b long, apart int")
    best = durable(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"))
    links = _confirmed(best, texts, shingle, least)
    named = durable(connected_components(links, LINKS).select(F.col("node").alias("set"), F.col("component").alias("c")))
    inside = durable(met.join(named, "set", "left").withColumn("c", F.coalesce("c", "set")))
    clusters = durable(_clusters(inside, sets, least, _judge(least), chunk))
    more = _links_within(clusters, sets, named, texts, shingle, least, _judge(least), chunk_members)
    joined = durable(connected_components(more, LINKS).select(F.col("node").alias("c"), F.col("component").alias("root")))
    rooted = sets.select("set", "rep").join(named, "set", "left").withColumn("c", F.coalesce("c", "set"))
    rooted = rooted.join(joined, "c", "left").withColumn("root", F.coalesce("root", "c"))
    found = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("set", "component_id")
    full = rows.where("n > 0").select("doc_id", "set", "n").join(found, "set").select("doc_id", "n", "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    """Near copies of documents by 2-word shingles and Jaccard 0.8, links confirmed on full sets; see near_documents.

    Null and empty texts are linked with nothing; a null doc_id is kept only where its whole component has none.
    """
    found = near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
