"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs with at most k edits shares at least m + 1 - q (k + 1) of its q-grams with the
text, all on k + 1 neighbouring diagonals (text position less passage position). Shared q-grams are counted in
overlapping bands of 2 (k + 1) diagonals; bands that reach the bound are kept and verified by banded alignment. The
filter loses nothing, the alignment decides. Passages are the query set, broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import IS_SEPARATOR, LOWER, pieces, utf8

Q = 8
PIECE = 1 << 19  # bytes of text handled at a time: their arrays stay in the processor's cache
BATCH = 32 << 20  # bytes of text whose candidates are aligned together
FLAT = np.where(IS_SEPARATOR, np.uint8(32), LOWER)


def normal(text: str) -> str:
    """A-Z lower-cased, each run of ASCII white space one space, none at the ends."""
    raw = FLAT[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].tobytes()
    return b" ".join(w for w in raw.split(b" ") if w).decode("utf-8", "replace")


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all rows, first and end of each row): as normal() gives them for each row."""
    data, at = utf8(column)
    flat = FLAT[data]
    space = flat == 32
    again = np.flatnonzero(space[1:] & space[:-1]) + 1
    if len(again):
        flat = np.delete(flat, again)
        at = at - np.searchsorted(again, at)
    chars: np.ndarray = flat
    if len(flat) and flat.max() >= 128:
        wide = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        inner = np.flatnonzero((flat & 0xC0) == 0x80)
        if len(wide) == len(flat) - len(inner):  # else bytes that are not UTF-8: as single characters
            chars, at = wide, at - np.searchsorted(inner, at)
    low, high = at[:-1].copy(), at[1:].copy()
    if len(chars):
        low += (low < high) & (chars[np.minimum(low, len(chars) - 1)] == 32)
        high -= (low < high) & (chars[high - 1] == 32)
    return chars, low, high


def grams(chars: np.ndarray) -> np.ndarray:
    """The characters from each position on, eight to a number: a byte of each. (A view; equal parts give equal numbers, and
    the rare others only cost an alignment.)"""
    flat = np.zeros(len(chars) + Q, np.uint8)
    flat[: len(chars)] = chars if chars.dtype == np.uint8 else chars ^ chars >> 8 ^ chars >> 16
    return np.ndarray((len(chars),), "<u8", flat, strides=(1,))


@dataclass
class Passages:
    """A block of passages and its q-gram index."""

    ids: pa.Array
    chars: np.ndarray
    start: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    codes: np.ndarray
    posts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    lookup: np.ndarray
    shift: np.uint64
    crowd: int  # gram codes that share a place of the sieve, at most
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length below Q: grams in order, and their passages

    @property
    def coarse(self) -> int:
        """Coarse cells are 2 ** coarse diagonals."""
        return max(10, (2 * int(self.budget.max(initial=0)) + 2).bit_length())

    def spot(self, code: np.ndarray) -> np.ndarray:
        """Place of grams in the sieve."""
        return code * _SPREAD >> self.shift


_SLOTS = (1 << 18) - 1

#: Fixed value: an odd multiplier whose products have well spread upper bits.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def index(ids: list, texts: list, error: float, least: int = 1) -> Passages:
    kept = [np.frombuffer(normal(t).encode("utf-32-le"), np.uint32) for t in texts]
    good = [i for i, c in enumerate(kept) if len(c) >= max(least, 1)]
    kept = [kept[i] for i in good]
    size = np.array([len(c) for c in kept], np.int64)
    start = np.append(0, np.cumsum(size)).astype(np.int64)
    budget = np.maximum(np.minimum((size * error).astype(np.int64), size // Q - 1), 0)
    codes = [grams(c)[: max(0, len(c) - Q + 1)] for c in kept]
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(kept)), [len(c) for c in codes])
    place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
    bits = min(max(len(flat) * 16, 1 << 12).bit_length(), 24)
    spot = flat * _SPREAD >> np.uint64(64 - bits)
    order = np.lexsort((flat, spot))
    flat, item, place, spot = flat[order], item[order], place[order], spot[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    distinct, spot = flat[first], spot[first]
    lookup = np.zeros(1 << bits, np.int32)
    lookup[spot[::-1]] = np.arange(len(spot), dtype=np.int32)[::-1]  # the first code of each place
    short = {}
    for n in sorted(set(size[size < Q].tolist())):
        which = np.flatnonzero(size == n)
        code = np.array([grams(kept[i])[0] for i in which], np.uint64)
        short[n] = (np.sort(code), which[np.argsort(code, kind="stable")])
    p = Passages(
        pa.array([ids[i] for i in good], pa.int64()), np.concatenate(kept) if kept else np.zeros(0, np.uint32), start, budget, size + 1 - Q * (budget + 1),
        distinct, np.append(first, len(flat)), item, place, np.zeros(1 << bits, bool), lookup, np.uint64(64 - bits),
        int(np.bincount(spot.astype(np.int64)).max(initial=0)), short,
    )
    p.sieve[p.spot(distinct)] = True
    return p


def shared(p: Passages, chars: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, band) of all bands of diagonals with enough shared q-grams; band b of a passage with budget k is the
    diagonals from b (k + 1) to (b + 2) (k + 1) - 1. Passages below q characters: the diagonals of their occurrences."""
    code = grams(chars)
    bands = [short_bands(p, code, n) for n in p.short]
    maybe = np.flatnonzero(p.sieve[p.spot(code)]) if len(p.codes) else np.zeros(0, np.int64)
    found = code[maybe]
    where = p.lookup[p.spot(found)].astype(np.int64)
    for _ in range(1, p.crowd):
        where += (p.codes[where] != found) & (where + 1 < len(p.codes))
    real = p.codes[where] == found if len(maybe) else np.zeros(0, bool)
    pos, where = maybe[real], where[real]
    if len(pos):
        row = np.searchsorted(low, pos, "right") - 1
        inside = (row >= 0) & (pos + Q <= high[row])  # not across two rows
        pos, where = pos[inside], where[inside]
    many = p.posts[where + 1] - p.posts[where]
    keys = []
    upto = np.cumsum(many)
    lo = 0
    while lo < len(pos):  # at most some million hits at a time
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 21), "right")))
        m = many[lo:hi]
        post = np.repeat(p.posts[where[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        item = p.item[post]
        diagonal = np.repeat(pos[lo:hi], m) - p.place[post]
        # Coarse cells, no narrower than a band and counted together where their slots collide, leave out most hits. (Not
        # where hits come in several rounds, which may share a cell.)
        slot = item * 0x9E3779B1 + (diagonal >> p.coarse) & _SLOTS
        many_in = np.bincount(slot, minlength=_SLOTS + 1)
        near = many_in[slot] + np.maximum(many_in[slot - 1 & _SLOTS], many_in[slot + 1 & _SLOTS])
        some = np.flatnonzero((near >= p.need[item]) | (len(m) < len(pos)))
        item = item[some]
        band = diagonal[some] // (p.budget[item] + 1)
        key, count = np.unique(item << 40 | band + (1 << 20), return_counts=True)
        keys.append((key, count))
        lo = hi
    if not keys:
        return tuple(map(np.concatenate, zip((np.zeros(0, np.int64),) * 2, *bands)))
    key, place = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
    count = np.bincount(place, np.concatenate([c for _, c in keys])).astype(np.int64)
    # A band is two cells of k + 1 diagonals; it can start in a cell with hits or in the one before.
    starts = np.unique(np.append(key, key - 1))
    total = np.zeros(len(starts), np.int64)
    for shift in (0, 1):
        i = np.minimum(np.searchsorted(key, starts + shift), len(key) - 1)
        total += np.where(key[i] == starts + shift, count[i], 0)
    item = starts >> 40
    enough = total >= p.need[item]
    bands.append((item[enough], (starts[enough] & ((1 << 40) - 1)) - (1 << 20)))
    return tuple(map(np.concatenate, zip(*bands)))


def short_bands(p: Passages, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, diagonal) of the occurrences of the passages of n < q characters, by their first n characters."""
    known, which = p.short[n]
    part = code & np.uint64((1 << 8 * n) - 1)
    pos = np.flatnonzero(np.isin(part, known))
    lo, hi = np.searchsorted(known, part[pos]), np.searchsorted(known, part[pos], "right")
    place = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
    return which[place], np.repeat(pos, hi - lo)


def aligned(p: Passages, chars: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least edits that turn passage item into some part of chars[low:high] near the diagonals from first on, or more than
    its budget. Rows that have left their budget are abandoned."""
    live = np.arange(len(item))
    out = np.full(len(item), 1 << 20)
    k = p.budget[item]
    wide = int((4 * k + 2).max())
    size = p.start[item + 1] - p.start[item]
    base = first[:, None] + np.arange(wide)[None, :]
    row = np.zeros((len(item), wide), np.int32)
    # A match starts inside the row's text: cells before it cost as much as no match.
    row[(base < low[:, None]) | (base > high[:, None])] = 1 << 20
    step = np.arange(wide, dtype=np.int32)
    for i in range(int(size.max())):
        t = base + i
        sign = p.chars[p.start[item] + i]
        inside = (t >= low[:, None]) & (t < high[:, None])
        differs = (chars[np.minimum(np.maximum(t, 0), len(chars) - 1)] != sign[:, None]) | ~inside
        new = row + differs
        new[~inside] = 1 << 20
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
        ended = size == i + 1
        if ended.any() or i % 16 == 15:
            best = row.min(1)
            out[live[ended]] = best[ended]
            stay = np.flatnonzero((best <= k) & ~ended)
            if len(stay) < len(live):
                live, k, size, base, row, low, high, item = (x[stay] for x in (live, k, size, base, row, low, high, item))
                if not len(live):
                    break
    return out


def search(p: Passages, column: pa.Array, at_once: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, passage, edits) of every passage found in a row, with the least edits."""
    none = np.zeros(0, np.int64)
    rows, items, firsts, ends, windows = [none], [none], [none], [none], [np.zeros(0, np.uint32)]
    before = total = 0
    for piece in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", PIECE):
        chars, low, high = characters(piece.column(0))
        item, band = shared(p, chars, low, high)
        if len(item):
            # A band may touch several rows of texts: each is tried by itself.
            k = p.budget[item]
            first = band * (k + 1) - k
            end = first + 4 * k + 2 + np.diff(p.start)[item]
            r0, r1 = (np.maximum(np.searchsorted(low, x, "right") - 1, 0) for x in (first, end))
            many = r1 - r0 + 1
            row = np.repeat(r0 - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            item, first, end = (np.repeat(x, many) for x in (item, first, end))
            lo, hi = np.maximum(low[row], first), np.minimum(high[row], end)
            some = hi > lo
            row, item, first, lo, hi = row[some], item[some], first[some], lo[some], hi[some]
            new = total + np.cumsum(hi - lo)
            windows += [chars[a:b].astype(np.uint32) for a, b in zip(lo.tolist(), hi.tolist())]
            rows.append(before + row)
            items.append(item)
            firsts.append(first - lo + new - (hi - lo))
            ends.append(new)
            total = int(new[-1]) if len(new) else total
        before += piece.num_rows
    row, item, first, end = map(np.concatenate, (rows, items, firsts, ends))
    chars = np.concatenate(windows)
    low = np.append(0, end)[:-1]
    edits = np.full(len(item), 1 << 20)
    order = np.argsort(p.budget[item] * (1 << 20) + np.diff(p.start)[item], kind="stable")
    for part in np.array_split(order, max(1, len(order) // at_once)) if len(order) else []:
        edits[part] = aligned(p, chars, low[part], end[part], item[part], first[part])
    ok = edits <= p.budget[item]
    row, item, edits = row[ok], item[ok], edits[ok]
    order = np.lexsort((edits, item, row))
    row, item, edits = row[order], item[order], edits[order]
    best = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))[: len(row)]
    return row[best], item[best], edits[best]


def _blocks(docs: DataFrame, benchmark: DataFrame, error: float, least_chars: int, block_chars: int) -> Iterator[Broadcast]:
    """The benchmark's passages in blocks of about block_chars characters, indexed and broadcast."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield docs.sparkSession.sparkContext.broadcast(index([r.item_id for r in rows], [r.text for r in rows], error, least_chars))


def leaks(docs: DataFrame, benchmark: DataFrame, error: float = 0.1, least_chars: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, edits, budget): one row for each row of docs and benchmark passage that occurs in it with at most
    budget = floor(error * length) edits of characters (fewer for passages so short that the lemma would not filter, none
    below 16 characters).

    Case of A-Z and the amount of white space do not matter. Passages of fewer than least_chars characters, and empty and
    null ones, are not searched; null texts hold none. Null ids are kept as null. Repeated rows of docs give repeated rows,
    passages repeated with their item_id are searched once. Every character of every text is read; documents are not shuffled.
    block_chars bounds what is broadcast at once: a larger benchmark is searched in several passes over docs.
    """
    side = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for block in _blocks(docs, benchmark, error, least_chars, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            p = block.value
            for batch in pieces(batches, "text", BATCH):
                row, item, edits = search(p, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), p.ids.take(pa.array(item)), pa.array(edits), pa.array(p.budget[item])], ["doc_id", "item_id", "edits", "budget"])

        part = side.mapInArrow(run, "doc_id long, item_id long, edits long, budget long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error: float = 0.1, least_chars: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage (see leaks). Each row is judged by its own text, whatever
    its doc_id; null and empty texts stay; repeated rows go or stay together; all columns pass unchanged."""
    at = docs.columns.index("text")
    for block in _blocks(docs, benchmark, error, least_chars, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            p = block.value
            for batch in pieces(batches, "text", BATCH):
                keep = np.ones(batch.num_rows, bool)
                keep[search(p, batch.column(at))[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """leaks() of documents and benchmark, with its defaults: null, empty and repeated rows as stated there."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
