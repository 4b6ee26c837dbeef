"""Repeats of bytes by external induced sorting (after Bingmann, Fischer and Osipov, eSAIS, 2013).

Within a shard, suffixes that begin an S-run after an L-run (S*) are sorted first; all others follow by induction: taking
suffixes in order, the one that starts a byte earlier is next of its own first byte. The queues of pending suffixes hold
tuples (position, common prefix with the one before), one queue per first byte, in order of arrival, which is their order
of rank; beyond a bound of memory their chunks move to a file. Common prefixes are carried along: an induced pair shares
one byte more than the least common prefix between its sources.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import LAST, PIECE, Rows, Windows, covered, mark
from .text import pieces, utf8

LENGTH = 100
SIGNS = 257  # 0 ends a text, bytes are one more
FAR = np.int32(1 << 20)


class Queues:
    """First-in-first-out queues of (position, common prefix), one for each sign; large ones live in a file."""

    def __init__(self, in_memory: int):
        self.chunks: list[list] = [[] for _ in range(SIGNS)]
        self.held, self.in_memory, self.file = 0, in_memory, None
        self.least = np.full(SIGNS, FAR)  # least common prefix since the last arrival
        self.fresh = np.ones(SIGNS, bool)

    def put(self, sign: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.chunks[sign].append(np.stack([pos.astype(np.int32), lcp.astype(np.int32)]))
        self.held += len(pos)
        if self.held > self.in_memory:
            self.file = self.file or tempfile.TemporaryFile()
            for queue in self.chunks:
                for k, c in enumerate(queue):
                    if isinstance(c, np.ndarray):
                        at = self.file.seek(0, 2)
                        self.file.write(c.tobytes())
                        queue[k] = (at, c.shape[1])
            self.held = 0

    def take(self, sign: int) -> Iterator[np.ndarray]:
        """What has arrived, oldest first, in chunks of about in_memory tuples."""
        queue, self.chunks[sign] = self.chunks[sign], []
        batch, size = [], 0
        for c in queue:
            if isinstance(c, tuple):
                self.file.seek(c[0])
                c = np.frombuffer(self.file.read(8 * c[1]), np.int32).reshape(2, -1)
            else:
                self.held -= c.shape[1]
            batch.append(c)
            size += c.shape[1]
            if size >= self.in_memory:
                yield np.concatenate(batch, axis=1)
                batch, size = [], 0
        if batch:
            yield np.concatenate(batch, axis=1)

    def induce(self, target: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Sources in order, with the common prefix of each with the one before; target: the sign of the suffix that
        each induces at pos - 1, or -1."""
        if not len(pos):
            return
        absent = np.ones(SIGNS, bool)
        order = np.argsort(target, kind="stable")
        some = target[order]
        cuts = np.append(np.flatnonzero(np.append(True, some[1:] != some[:-1])), len(some))
        for a, b in zip(cuts[:-1], cuts[1:]):
            sign = int(some[a])
            if sign < 0:
                continue
            absent[sign] = False
            idx = order[a:b]
            shared = np.minimum.reduceat(lcp, np.append(0, idx[:-1] + 1))
            # reduceat runs the last part to the end of the chunk: the last arrival counts to its own place only.
            last = lcp[(idx[-2] + 1 if len(idx) > 1 else 0) : idx[-1] + 1].min()
            shared[-1] = last
            shared[0] = min(shared[0], self.least[sign])
            shared = np.minimum(shared + 1, FAR)
            if self.fresh[sign]:
                shared[0], self.fresh[sign] = 0, False
            self.put(sign, pos[idx] - 1, shared)
            self.least[sign] = lcp[idx[-1] + 1 :].min() if idx[-1] + 1 < len(lcp) else FAR
        self.least[absent] = np.minimum(self.least[absent], lcp.min())

    def close(self) -> None:
        if self.file:
            self.file.close()


def _words(signs: np.ndarray) -> np.ndarray:
    """Seven signs from each position as one number; signs after the end of a text are 0."""
    out = np.zeros(len(signs), np.int64)
    live = np.ones(len(signs), bool)
    for j in range(7):
        s = np.zeros(len(signs), np.int64)
        s[: len(signs) - j] = signs[j:]
        out = out << 9 | np.where(live, s, 0)
        live &= s > 0
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading signs that two words share."""
    x = (a ^ b).astype(np.uint64)
    out = np.full(len(x), 7)
    for j in range(7):
        out = np.where((out == 7) & (x >> np.uint64(9 * (6 - j)) != 0), j, out)
    return out


def _seeds(signs: np.ndarray, word: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """pos in the order of their suffixes to at least depth signs, and the common prefixes of neighbours: rounds of seven
    signs, each over the suffixes that are still equal to a neighbour."""
    group = np.zeros(len(pos), np.int64)
    lcp = np.zeros(len(pos), np.int64)
    active = np.arange(len(pos))
    ended = np.zeros(len(pos), bool)
    for done in range(0, depth, 7):
        if not len(active):
            break
        p = pos[active]
        w = np.where(ended[active], 0, word[np.minimum(p + done, len(word) - 1)])
        order = np.lexsort((w, group[active]))
        pos[active], w = p[order], w[order]
        ended[active] = ended[active][order] | (w & 511 == 0)
        g = group[active]
        apart = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        now = np.flatnonzero((w[1:] != w[:-1]) & (g[1:] == g[:-1])) + 1
        lcp[active[now]] = done + _common(w[now], w[now - 1])
        fresh = np.append(True, apart)
        group[active] = active[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
    # What is still equal shares depth signs, or ends together.
    same = np.flatnonzero(np.append(False, group[1:] == group[:-1]))
    lcp[same] = depth
    return pos, lcp


def sorted_suffixes(signs: np.ndarray, depth: int, in_memory: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks (position, common prefix with the suffix before) of all suffixes in descending order, right to depth signs.

    signs: texts one after another, each ended by 0. in_memory: pending tuples held outside the file.
    """
    n = len(signs)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(signs[1:].astype(np.int16) - signs[:-1].astype(np.int16))
    rise[signs == 0] = 1
    known = np.where(rise != 0, np.arange(n, dtype=np.int32), n - 1)
    small = rise[np.minimum.accumulate(known[::-1])[::-1]] > 0  # S-type
    star = small.copy()
    star[1:] &= ~small[:-1]
    star[signs == 0] = True
    word = _words(signs)
    ends = np.flatnonzero(signs == 0)
    seeds = np.flatnonzero(star & (signs > 0))
    seeds, shared = _seeds(signs, word, seeds, depth)
    seeds, shared = np.append(ends, seeds), np.append(np.zeros(len(ends), np.int64), shared).astype(np.int32)
    cut = np.searchsorted(signs[seeds], np.arange(SIGNS + 1))

    def prefix(a: int, b: int) -> int:
        """Common prefix of two suffixes by their signs."""
        for k in range(0, depth, 7):
            if a + k >= n or b + k >= n:
                return k
            c = int(_common(word[a + k : a + k + 1], word[b + k : b + k + 1])[0])
            if c < 7 or not (word[a + k] & 511 and word[b + k] & 511):
                return k + c
        return depth

    def before(pos: np.ndarray, kind: bool) -> np.ndarray:
        """Sign of the suffix one earlier if it is of the kind (S or L) and of the same text, or -1."""
        p = np.maximum(pos - 1, 0)
        s = signs[p].astype(np.int64)
        return np.where((pos > 0) & (s > 0) & (small[p] == kind), s, -1)

    large, ordered, final = Queues(in_memory), Queues(in_memory), Queues(in_memory)
    try:
        for c in range(SIGNS):
            last = -1
            while large.chunks[c]:
                for pos, lcp in large.take(c):
                    ordered.put(c, pos, lcp)
                    large.induce(before(pos, False), pos, lcp)
                    last = int(pos[-1])
            pos, lcp = seeds[cut[c] : cut[c + 1]], shared[cut[c] : cut[c + 1]].copy()
            if len(pos):
                lcp[0] = prefix(last, int(pos[0])) if last >= 0 else 0
                large.induce(before(pos, False), pos, lcp)
        for c in range(SIGNS - 1, 0, -1):
            last = -1
            while final.chunks[c]:
                for pos, lcp in final.take(c):
                    yield pos, lcp
                    final.induce(before(pos, True), pos, lcp)
                    last = int(pos[-1])
            parts = list(ordered.take(c))
            for k in range(len(parts) - 1, -1, -1):
                pos = parts[k][0][::-1]
                lcp = np.empty(len(pos), np.int32)
                lcp[1:] = parts[k][1][::-1][:-1]
                lcp[0] = parts[k + 1][1][0] if k + 1 < len(parts) else prefix(last, int(pos[0])) if last >= 0 else 0
                yield pos, lcp
                final.induce(before(pos, True), pos, lcp)
    finally:
        for q in (large, ordered, final):
            q.close()


def group_bytes(contents: list[bytes], length: int = LENGTH, in_memory: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, class) of the windows of length bytes that occur at least twice in contents."""
    data, offsets = utf8(pa.array(contents, pa.binary()))
    lens = np.diff(offsets)
    row = np.repeat(np.arange(len(lens)), lens)
    signs = np.zeros(len(data) + len(lens), np.uint16)
    signs[np.arange(len(data)) + row] = data.astype(np.uint16) + 1
    start = offsets[:-1] + np.arange(len(lens))
    stop = start + lens
    of = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1)
    found, classes, number, held = [], [], 0, None
    for pos, lcp in sorted_suffixes(signs, length, in_memory):
        fits = pos + length <= stop[of[pos]]
        new = np.where(fits, lcp < length, False)
        # A short suffix in between ends a class, and so does a small common prefix; both show in the next window's lcp.
        pos, new = pos[fits], new[fits]
        if not len(pos):
            continue
        cls = number + np.cumsum(new)
        number = int(cls[-1])
        found.append(pos)
        classes.append(cls)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    pos, cls = np.concatenate(found).astype(np.int64), np.concatenate(classes)
    many = np.bincount(cls)[cls] > 1
    pos, cls = pos[many], cls[many]
    return of[pos].astype(np.int64), pos - start[of[pos]], cls


BYTES = Windows("bytes", LENGTH, 24, True, group_bytes)


def _cut(docs: DataFrame, w: Windows, whole_characters: bool) -> DataFrame:
    """docs' rows as (doc_id, text, spans, copy, plus all columns of docs under row) are cut by mark(); see callers."""
    found = mark(docs, w)
    copies = found.ids.where("doc_id != first").select("doc_id", "key", F.lit(True).alias("copy")).distinct()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row") if whole_characters else F.lit(None).cast("int").alias("row")
    texts = docs.select(doc, F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("text").isNull().alias("none"), row).withColumn("key", F.xxhash64("text"))
    joined = texts.join(found.spans, ["doc_id", "key"], "left").join(copies, ["doc_id", "key"], "left")
    joined = joined.select("doc_id", "text", "spans", "copy", "none", "row")
    kept_type = "string" if whole_characters else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows = Rows.of(w, batch.column(1))
            n = np.diff(rows.offsets)
            gone = covered(rows, batch.column(2), w.length)
            gone |= np.repeat(np.asarray(batch.column(3).is_valid()) & (n >= w.length), n)
            if whole_characters:  # a character goes if all of its bytes go
                head = np.flatnonzero((rows.values & 0xC0) != 0x80)
                if len(head):
                    gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(gone))))
            start = np.append(True, ~gone[:-1])
            start[rows.offsets[:-1][rows.offsets[:-1] < len(gone)]] = True
            total = np.append(0, np.cumsum(~gone))[rows.offsets]
            spans = np.append(0, np.cumsum(gone & start[: len(gone)]))[rows.offsets]
            raw = rows.values[~gone].tobytes()
            kept = [raw[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
            if whole_characters:
                kept = [None if o else k.decode("utf-8", "replace") for k, o in zip(kept, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.array(n), pa.array(n - np.diff(total)), pa.array(np.diff(spans)), pa.array(kept, kept_type)],
                ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    row_type = texts.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id long, row {row_type}, n_bytes long, n_removed long, n_spans long, kept {kept_type}")


def without_repeats(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each row of docs(doc_id, text, ...) without the bytes that lie in a
    string of 100 bytes which also starts earlier: in a document of smaller doc_id, or earlier in the same one.

    Strings are judged on the input and never cross documents; kept: the other bytes, which may not be whole characters.
    n_spans: maximal runs of removed bytes. A null text is empty; a null doc_id comes after all others; rows that share a
    doc_id are ordered by a hash of their text, and equal ones are treated alike. Shorter texts stay whole, copies of
    longer texts are removed whole. Extra columns are ignored.
    """
    return _cut(docs, w, False).select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def cut_repeats(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """docs with repeated strings cut from text; a character goes only if all its bytes do, so texts stay valid. Rows whose
    text becomes empty go, empty and null texts of the input stay. Other columns are as they were; n_chars, if there is
    one, is the new length."""
    out = _cut(docs, w, True).where("n_bytes = 0 or n_removed < n_bytes")
    cols = [
        F.col("kept").alias(c) if c == "text"
        else F.coalesce(F.length("kept"), F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return out.select(*cols)


def op9_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
