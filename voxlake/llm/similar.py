"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, by SimHash and bit-sliced comparison.

Each set has a SimHash fingerprint of 512 bits. At a similarity of 0.8 two of them differ by 78 bits, give or take 8: too many
for buckets of equal bit blocks, but enough to judge a pair. So buckets come from the shingles: in any order that holds for
all documents, two sets that are similar share one of their first n - ceil(0.8 n) + 1 members (prefix filtering). The order
puts what a sample shows to be frequent last, so that lines which many documents hold make no large buckets; it changes the
cost only, never a link.

A bucket's sets first meet their neighbours and the bucket's first set, and each set's nearest is confirmed on full sets, so
that a group of near copies becomes one component at the cost of a pair a set. Buckets that still hold several components are
dealt out in square blocks of chunks. A block stores one side's fingerprints vertically, one bit plane a bit and 64
fingerprints a machine word, and counts a fingerprint's distances to 64 others at once by carry-save adders; words whose 64
distances are all beyond the bound are abandoned on the way. Only a spanning forest of the components leaves a block, never
pairs; its trees are clusters, whose full sets are compared in blocks likewise (blocks.py).

The bound lies seven standard deviations above the distance at the threshold, so that a link is lost with about 1e-12; none is
made without its full sets. Sets and their members are known by 64-bit hashes; texts of equal sets count as copies.
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
from .shingles import _few, _members, _names, _sets, _texts
from .text import mixed, pieces, release, utf8

WIDE = 8  # words of a fingerprint
SMALL = 64  # members; ties make the bits of smaller sets' fingerprints differ more often than by the angle
SMALL_SHARE = 0.1875  # of the bits at most, at a similarity of 0.8 or more: sets of four and five members


def _fingerprints(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """SimHash of each row's members, WIDE words of 64 bits: a bit is set where it is in over half of the members' hashes."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = []
    for k in range(WIDE):
        word = np.zeros(len(n), np.uint64)
        if len(some):
            on = np.unpackbits(mixed(h + np.uint64(k * _STEP % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total = np.add.reduceat(on, first[some], axis=0, dtype=np.int32)
            word[some] = np.packbits(total * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
        out.append(word.view(np.int64))
    return out


#: Fixed value: an odd number whose multiples tell the words of a fingerprint apart.
_STEP = 0x9E3779B97F4A7C15


def _most_apart(least: tuple[int, int], small: bool, deviations: float = 7) -> int:
    """Distance of fingerprints beyond which a pair is taken to be less similar than least."""
    share = math.acos(2 * least[0] / (least[0] + least[1])) / math.pi  # of the bits, at the least similarity
    share = max(share, SMALL_SHARE) if small else share
    bits = 64 * WIDE
    return math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints x and y, of rows of words, differ."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)


def _planes(sig: np.ndarray) -> np.ndarray:
    """(bits, words) of fingerprints (64 * words, WIDE): word w of plane j holds bit j of rows 64 w to 64 w + 63."""
    bits = np.unpackbits(sig.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three words, lane by lane."""
    u = a ^ b
    return u ^ c, a & b | u & c


def _upto(counters: list[np.ndarray], over: np.ndarray, most: int) -> np.ndarray:
    """Lanes whose count, 2 ** k from counters[k], is most or less."""
    far, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if most >> k & 1:
            equal &= counters[k]
        else:
            far |= equal & counters[k]
            equal &= ~counters[k]
    return ~far


def _lanes(planes: np.ndarray, sig: np.ndarray, query: np.ndarray, word: np.ndarray, bounds: tuple[int, ...]) -> list[np.ndarray]:
    """For each of bounds (falling, below 256) the lanes of planes' word[k] within it of sig[query[k]]."""
    out = [np.zeros(len(query), np.uint64) for _ in bounds]
    at, zero = np.arange(len(query)), np.zeros(len(query), np.uint64)
    counters, over = [zero.copy() for _ in range(8)], zero.copy()
    for first in range(0, 64 * WIDE, 8):
        whole = sig[query[at], first // 64]
        d = [planes[first + j, word[at]] ^ (np.uint64(0) - (whole >> np.uint64(first % 64 + j) & np.uint64(1))) for j in range(8)]
        fours = []
        for j in (0, 4):
            twos = []
            for i in (j, j + 2):
                counters[0], carry = _added(counters[0], d[i], d[i + 1])
                twos.append(carry)
            counters[1], carry = _added(counters[1], *twos)
            fours.append(carry)
        counters[2], carry = _added(counters[2], *fours)
        for k in range(3, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if first % 64 == 56 and first >= 64 * WIDE // 4:
            alive = _upto(counters, over, bounds[0]) != 0
            if not alive.all():
                at, over = at[alive], over[alive]
                counters = [c[alive] for c in counters]
    for found, most in zip(out, bounds):
        found[at] = _upto(counters, over, most)
    return out


def _judge(least: tuple[int, int], pairs: int = 1 << 15) -> Judge:
    """Pairs whose fingerprints differ by no more than _most_apart. pairs: (fingerprint, word) pairs compared at a time."""
    bounds = _most_apart(least, True), _most_apart(least, False)

    def together(blocks: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
        rows = np.array([len(b[0]) for b in blocks])
        words = np.array([-(-len(b[2]) // 64) for b in blocks])
        base, start = np.append(0, np.cumsum(words)), np.append(0, np.cumsum(rows))
        room = np.zeros((int(base[-1]) * 64, WIDE), np.uint64)
        for b, lo in zip(blocks, base.tolist()):
            room[64 * lo : 64 * lo + len(b[2])] = b[2]
        own = np.repeat(np.arange(len(blocks)), rows * words)
        k = np.arange(len(own)) - np.repeat(np.cumsum(rows * words) - rows * words, rows * words)
        found = _lanes(_planes(room), np.concatenate([b[0] for b in blocks]), start[own] + k // words[own], base[own] + k % words[own], bounds)
        cut = np.append(0, np.cumsum(rows * words)).tolist()
        for i, (sig, n, other, m) in enumerate(blocks):
            shape = len(sig), int(words[i]) * 8
            wide, tight = (np.unpackbits(f[cut[i] : cut[i + 1]].view(np.uint8).reshape(shape), axis=1, bitorder="little")[:, : len(other)].astype(bool) for f in found)
            yield np.where(np.minimum(n[:, None], m[None, :]) < SMALL, wide, tight)

    def judge(blocks: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for b in blocks:
            held.append(b)
            size += len(b[0]) * -(-len(b[2]) // 64)
            if size >= pairs:
                yield from together(held)
                held, size = [], 0
        if held:
            yield from together(held)

    return judge


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set, n, sig) of every row of docs(doc_id, text): its set's name, size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, first = _sets(*utf8(batch.column(1)), shingle)
            sig = np.stack(_fingerprints(h, first), 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * WIDE), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_names(h, first)), pa.array(np.diff(first)), lists], ["doc_id", "set", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set long, n long, sig array<long>")


def _frequent(docs: DataFrame, shingle: int, rows: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that about sample documents hold three times or more; shingles ascend."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // sample))) == 0)
    held = _members(some.select(F.lit(0).cast("long").alias("set"), "text"), shingle).select(F.explode("members").alias("h"))
    top = held.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, count = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def _prefixes(docs: DataFrame, shingle: int, least: tuple[int, int], frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, set): the members that a similar set must share one of."""
    common, often = frequent
    num, den = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            h, first = _sets(*utf8(batch.column(0)), shingle)
            names, n = _names(h, first), np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                rank = np.where(common[at] == h, often[at], 0)
            order = np.lexsort((h, rank, row))
            pos = np.arange(len(h)) - first[row]
            new = np.array([not (s in seen or seen.add(s)) for s in names.tolist()], bool)
            keep = (pos < n[row] + (-num * n[row]) // den + 1) & new[row]  # n - ceil(n num / den) + 1
            row = row[keep]
            cols = h[order][keep].view(np.int64), names[row]
            for lo in range(0, len(row), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in cols], ["h", "set"])

    return docs.select("text").mapInArrow(run, "h long, set long")


def _by_bucket(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches that are sorted by the first, in runs of whole buckets."""
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(tuple(batch.column(i).to_numpy() for i in range(batch.num_columns)))
        rows += batch.num_rows
        if rows < least:
            continue
        cols = tuple(np.concatenate(c) for c in zip(*kept))
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            yield tuple(c[:last] for c in cols)
        kept, rows = [tuple(c[last:] for c in cols)], len(cols[0]) - last
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept))
    kept = []
    release()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (bucket, set) of buckets that hold two sets or more, each set once."""
    for h, name in _by_bucket(batches):
        new = np.append(True, (h[1:] != h[:-1]) | (name[1:] != name[:-1]))
        h, name = h[new], name[new]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(starts, len(h)))
        keep = np.repeat(size, size) > 1
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, name)], ["bucket", "set"])


def similar_documents(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), sample: int = 2000, most: int = 65_536, chunk: int = 1024, chunk_members: int = 1 << 17) -> DataFrame:
    """(doc_id, component_id) of every row of docs(doc_id, text, ...): the smallest doc_id that can be reached over links
    between texts whose sets of word shingles have a Jaccard similarity of least (a fraction) or more.

    Words and shingles are those of simhash.fingerprints. Null, empty and blank texts are copies of each other. sample
    and most bound the list of frequent shingles, chunk a block's sets and chunk_members its members; they change the cost
    only. Null ids name a component only where all are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = tasks_for(docs.sparkSession)
    rows = durable(_named(docs, shingle))
    sets = durable(rows.groupBy("set").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), F.min("doc_id").alias("rep")))
    frequent = _frequent(docs, shingle, rows.count(), sample, most)
    dealt = _prefixes(docs, shingle, least, frequent).repartition(tasks, "h").sortWithinPartitions("h", "set")
    met = durable(dealt.mapInArrow(_met, "bucket long, set long"))
    texts = _texts(docs, shingle)

    signed = met.join(sets.select("set", "sig", "n"), "set").repartitionByRange(tasks, "bucket", "n", "set").sortWithinPartitions("bucket", "n", "set")
    near = signed.select("bucket", "set", "sig").mapInArrow(_neighbours(_apart, _most_apart(least, True)), "a long, b long, apart int")
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
    return rows.select("doc_id", "set").join(found, "set").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs, of each component only the rows that have its smallest doc_id; all columns stay as they are.

    Rows whose doc_id is null stay: they cannot be told apart. Rows that share a doc_id stay if one of them does.
    """
    ids = durable(similar_documents(docs, shingle, least).where("doc_id is not null"))
    gone = ids.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    gone = _few(gone.select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs.doc_id.cast("long") == F.col("_gone"), "left_anti")
