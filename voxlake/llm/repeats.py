"""Repeated windows of a corpus: the Spark side of the two exact-substring operators.

A window is `length` consecutive units (bytes, or words) of one document. Documents meet only where they can share one:

1. Copies of a whole text collapse to the row of smallest doc_id.
2. Every window picks an anchor, its leftmost gram of least hash, so equal windows have equal anchors. Anchors are a few
   percent of the units; packed per task and shuffled by hash, they tell which are repeated. An anchor that repeats inside
   a task is settled there and sent once, so a hot passage costs a few entries per task.
3. Runs of windows that share a repeated anchor are shuffled by it with their content, again one entry per task and
   content (and document, where its runs share their fate: the row lists their positions). A shard gets all runs of its
   anchors and hands those that differ to the operator's own sorter, which groups equal windows. Anchors with very many runs are dealt out window by window.
4. Windows that are not first go back by doc_id and are cut from the texts.

Nothing is capped. Hashes bring runs together, contents decide: runs of one hash are compared byte by byte. Copies of a whole
text are told by SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, tasks_for
from .text import hash_grams, hash_spans, pieces, release, utf8, words

PIECE = 1 << 20  # bytes of text handled at a time: numpy needs a hundredfold
LAST = (1 << 63) - 1  # stands for a null doc_id: after all others


@dataclass(frozen=True)
class Windows:
    """What a window is, and how a shard groups equal ones.

    group(contents: list of bytes) -> (content, offset, class) arrays: windows of the contents, in units, whose class
    holds two or more of them; the others need not be listed.
    """

    unit: str  # "bytes" or "words"
    length: int
    gram: int
    by_position: bool  # an earlier start in the same document counts as first, too
    group: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    crowded: int = 200_000  # runs of one anchor beyond which it is dealt out window by window


@dataclass
class Rows:
    """The units of a few rows of texts."""

    values: np.ndarray
    offsets: np.ndarray
    raw: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None

    @classmethod
    def of(cls, w: Windows, column: pa.Array) -> Rows:
        data, offsets = utf8(column)
        if w.unit == "bytes":
            return cls(data, offsets, data, None, None)
        normal, starts, ends, first = words(data, offsets)
        return cls(hash_spans(normal, starts, ends), first, normal, starts, ends)

    def content(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the units lo to hi - 1."""
        return (lo, hi) if self.starts is None else (self.starts[lo], self.ends[hi - 1])


def _running(grid: np.ndarray, place: np.ndarray, better: np.ufunc, toward: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """(least value so far, where it was last better) along each row of grid; places run in the direction of toward."""
    least = np.minimum.accumulate(grid, axis=1)
    new = np.ones(grid.shape, bool)
    new[:, 1:] = better(grid[:, 1:], least[:, :-1])
    never = -1 if toward is np.maximum else np.iinfo(np.int32).max
    return least, toward.accumulate(np.where(new, place, np.int32(never)), axis=1)


def runs(w: Windows, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor, hash of the anchor) of the runs of windows that share an anchor; windows and
    anchors as positions in rows.values, in ascending order."""
    n, width = len(rows.values), w.length - w.gram + 1
    none = np.zeros(0, np.int64)
    if n < w.length:
        return none, none, none, none, np.zeros(0, np.uint64)
    gram = hash_grams(rows.values, w.gram)
    # The leftmost least gram of each window, from running minima of blocks forwards and backwards. Whole hashes are compared,
    # so that a window's anchor depends on nothing but the window.
    blocks = -(-len(gram) // width)
    grid = np.full(blocks * width, ~np.uint64(0))
    grid[: len(gram)] = gram
    grid = grid.reshape(blocks, width)
    place = np.arange(blocks * width, dtype=np.int32).reshape(blocks, width)
    ahead, ahead_at = _running(grid, place, np.less, np.maximum)
    behind, behind_at = (x[:, ::-1].ravel() for x in _running(grid[:, ::-1], place[:, ::-1], np.less_equal, np.minimum))
    total, last = n - w.length + 1, slice(width - 1, width - 1 + n - w.length + 1)
    anchor = np.where(behind[:total] <= ahead.ravel()[last], behind_at[:total], ahead_at.ravel()[last]).astype(np.int64)
    del grid, place, ahead, ahead_at, behind, behind_at
    row = np.repeat(np.arange(len(rows.offsets) - 1), np.diff(rows.offsets))[:total]
    window = np.flatnonzero(np.arange(total) + w.length <= rows.offsets[row + 1])
    anchor, row = anchor[window], row[window]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))[: len(window)]
    first = np.flatnonzero(new)
    return row[first], window[first], np.diff(np.append(first, len(window))), anchor[first], gram[anchor[first]]


def _bytes(parts: list[np.ndarray], cuts: np.ndarray) -> list[pa.Array]:
    """Each array cut into binary values at cuts."""
    out = []
    for p in parts:
        p = np.ascontiguousarray(p)
        out.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * p.itemsize).astype(np.int32).tobytes()), pa.py_buffer(p.tobytes())]))
    return out


def _repeated_anchors(texts: DataFrame, w: Windows, tasks: int) -> DataFrame:
    """(key, at, crowded): for texts(key, text), packed positions in each distinct text of the anchors that
    occur elsewhere too; and, where crowded is 1, the hashes (as key) of anchors with more runs than w.crowded."""
    flush = 1 << 18

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send() -> pa.RecordBatch:
            key, at, h = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, key, h))
            key, at, h = key[order], at[order], h[order]
            same = (h[1:] == h[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1])  # copies of one text
            fresh = np.append(True, ~same)
            key, at, h = key[fresh], at[fresh].astype(np.uint32), h[fresh]
            first = np.append(True, h[1:] != h[:-1])
            many = np.diff(np.append(np.flatnonzero(first), len(h))).astype(np.uint32)
            rider = np.flatnonzero(~first)  # known to repeat: they need no answer, but go the way of their text
            rider = rider[np.argsort(key[rider] % tasks, kind="stable")]
            rider_cuts = np.searchsorted(key[rider] % tasks, np.arange(tasks + 1))
            part = (h[first] % np.uint64(tasks)).astype(np.int64)
            take = np.lexsort((key[first], part))
            cuts = np.searchsorted(part[take], np.arange(tasks + 1))
            cols = _bytes([h[first][take], key[first][take], at[first][take], many[take]], cuts) + _bytes([key[rider], at[rider]], rider_cuts)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(tasks), pa.int32()), *cols], ["part", "h", "key", "at", "count", "rider_key", "rider_at"])

        for batch in pieces(batches, "text", PIECE):
            rows = Rows.of(w, batch.column(1))
            row, _, _, anchor, h = runs(w, rows)
            held.append((batch.column(0).to_numpy()[row], anchor - rows.offsets[row], h))
            size += len(row)
            if size >= flush:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def by_text(key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        key, value = key[order], at[order].astype(np.uint32)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        for lo in range(0, len(starts), 1 << 15):
            some = starts[lo : lo + (1 << 15)]
            end = starts[lo + (1 << 15)] if lo + (1 << 15) < len(starts) else len(key)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), _bytes([value[some[0] : end]], np.append(some, end) - some[0])[0], pa.array(np.zeros(len(some), np.int8))], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"h": np.uint64, "key": np.int64, "at": np.uint32, "count": np.uint32, "rider_key": np.int64, "rider_at": np.uint32}
        parts: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
        for b in batches:
            x = {k: np.frombuffer(utf8(b.column(b.schema.get_field_index(k)))[0].tobytes(), kind) for k, kind in kinds.items()}
            yield from by_text(x["rider_key"], x["rider_at"])
            for k in ("h", "key", "at", "count"):
                parts[k].append(x[k])
        if not parts["h"]:
            return
        h, key, at, count = (np.concatenate(parts[k]) for k in ("h", "key", "at", "count"))
        if not len(h):
            return
        order = np.lexsort((at, key, h))
        h, key, at, count = h[order], key[order], at[order], count[order].astype(np.int64)
        # The same place may come from two tasks that hold copies of one text; it counts once.
        fresh = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1]))
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(new, len(h)))
        total = np.add.reduceat(count, new)
        places = np.add.reduceat(fresh.astype(np.int64), new)
        repeated = (places > 1) | (np.maximum.reduceat(count, new) > 1)
        crowd = h[new[total > w.crowded]]
        if len(crowd):
            yield pa.RecordBatch.from_arrays([pa.array(crowd.view(np.int64)), pa.array([b""] * len(crowd), pa.binary()), pa.array(np.ones(len(crowd), np.int8))], names)
        take = np.repeat(repeated, size) & fresh
        key, at = key[take], at[take]
        del h, count, order, fresh, new, size, total, places, repeated, take, parts
        release()
        yield from by_text(key, at)

    names = ["key", "at", "crowded"]
    sent = texts.mapInArrow(scan, "part int, h binary, key binary, at binary, count binary, rider_key binary, rider_at binary")
    return sent.repartition(tasks, "part").mapInArrow(meet, "key long, at binary, crowded byte")


def _first_and_other(w: Windows, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that may be first of their group, rows that are not), for rows sorted by group and then by place."""
    new = np.append(True, group[1:] != group[:-1])[: len(group)]
    if w.by_position:
        return np.flatnonzero(new), np.flatnonzero(~new)
    lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else doc
    return np.flatnonzero(doc == lead), np.flatnonzero(doc != lead)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _grouped(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows in order of h, content raw[lo:hi] and by, and the number of each one's group of equal h and
    content. Contents are told apart by a hash first, and byte by byte then."""
    same = hash_spans(raw, lo, hi)
    while True:
        order = np.lexsort((*reversed(by), same, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (same[order][1:] != same[order][:-1]))[: len(order)]
        group = np.cumsum(new) - 1
        lead = order[np.flatnonzero(new)][group]
        size = hi[order] - lo[order]
        again = np.flatnonzero(~new & (size == hi[lead] - lo[lead]))
        differs = ~new & (size != hi[lead] - lo[lead])
        if len(again):
            unlike = raw[ranges(lo[order[again]], size[again])] != raw[ranges(lo[lead[again]], size[again])]
            differs[again] = np.logical_or.reduceat(unlike, np.cumsum(size[again]) - size[again])
        if not differs.any():
            return order, group
        mixed = order[np.isin(group, group[differs])]
        ids: dict[bytes, int] = {}
        same[mixed] = [ids.setdefault(raw[a:b].tobytes(), len(ids)) for a, b in zip(lo[mixed].tolist(), hi[mixed].tolist())]


def _content_runs(texts: DataFrame, w: Windows, crowded) -> DataFrame:
    """Rows (h, doc, key, at, n, content) for the runs of texts(doc_id, key, text, at: array of packed positions of
    anchors): n windows from each unit of at, packed. Rows without content are known not to be first: an earlier row of this
    task has their anchor and their content. crowded: a broadcast of the crowded anchors in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows = Rows.of(w, batch.column(2))
            row, first, many, anchor, h = runs(w, rows)
            owner, ask = unpacked(batch.column(3))
            ask = np.sort(rows.offsets[owner] + ask)
            if not len(ask):
                continue
            hit = np.flatnonzero(ask[np.minimum(np.searchsorted(ask, anchor), len(ask) - 1)] == anchor)
            row, first, many, h = row[hit], first[hit], many[hit], h[hit]
            crowd = np.isin(h, crowded.value)
            if crowd.any():  # one run for each window of a crowded anchor, under a hash of the window
                each = np.where(crowd, many, 1)
                step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                row, h, crowd = (np.repeat(x, each) for x in (row, h, crowd))
                first, many = np.repeat(first, each) + step, np.where(crowd, 1, np.repeat(many, each))
                h = np.where(crowd, hash_spans(rows.values, first, first + w.length), h)
            lo, hi = rows.content(first, first + many + w.length - 1)
            doc, key = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            at = first - rows.offsets[row]
            order, group = _grouped(rows.raw, lo, hi, h, [doc, key, at])
            keep, other = _first_and_other(w, doc[order], group)
            new = np.append(True, (group[keep][1:] != group[keep][:-1]) | (key[order[keep]][1:] != key[order[keep]][:-1]))[: len(keep)]
            listed = at[order[keep]]  # runs of one content in the first document go or stay together
            cuts = np.append(np.flatnonzero(new), len(keep))
            keep, other = order[keep[new]], order[other]
            other = other[np.argsort(first[other], kind="stable")]
            total = many.copy()
            if len(other):  # known runs that follow one another in a row of text are one
                f, m, r = first[other], many[other], row[other]
                start = np.append(True, (f[1:] != f[:-1] + m[:-1]) | (r[1:] != r[:-1]))
                begin = np.flatnonzero(start)
                total[other[begin]] = np.add.reduceat(m, begin)
                other = other[begin]
            raw = rows.raw.tobytes()
            text = pa.array([raw[a:b] for a, b in zip(lo[keep].tolist(), hi[keep].tolist())] + [None] * len(other), pa.binary())
            take = np.append(keep, other)
            places = _bytes([np.append(listed, at[other]).astype(np.uint32)], np.append(cuts, cuts[-1] + 1 + np.arange(len(other))))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[take].view(np.int64)), pa.array(doc[take]), pa.array(key[take]), places, pa.array(total[take]), text], ["h", "doc", "key", "at", "n", "content"]
            )

    return texts.mapInArrow(scan, "h long, doc long, key long, at binary, n long, content binary")


def _not_first(sent: DataFrame, w: Windows, tasks: int, batch_bytes: int = 3 << 20) -> DataFrame:
    """(doc_id, key, spans): packed pairs (unit, windows) of the windows that are not first."""

    def decide(h, doc, key, at, n, content) -> Iterator[tuple[np.ndarray, ...]]:
        """For whole anchors: (row, offset, n) of windows that are not first; at: the row's least position."""
        ids: dict[bytes, int] = {}
        which = np.fromiter((ids.setdefault(c, len(ids)) for c in content), np.int64, len(content))
        order = np.lexsort((at, key, doc, which))
        new = np.append(True, which[order][1:] != which[order][:-1])
        keep, other = _first_and_other(w, doc[order], np.cumsum(new))
        yield order[other], np.zeros(len(other), np.int64), n[order[other]]
        rows = order[keep]
        lead = order[np.flatnonzero(new)]  # by content id: its earliest row
        texts = list(ids)
        anchor = h[lead]
        by = np.argsort(anchor, kind="stable")
        edge = np.append(True, anchor[by][1:] != anchor[by][:-1])
        many = np.diff(np.append(np.flatnonzero(edge), len(by)))
        mixed = np.sort(by[np.repeat(many > 1, many)])  # contents that share their anchor with others
        if not len(mixed):
            return
        c, off, cls = w.group([texts[i] for i in mixed])
        if not len(c):
            return
        c = mixed[c]
        order = np.lexsort((at[lead[c]] + off, key[lead[c]], doc[lead[c]], cls))
        c, off, cls = c[order], off[order], cls[order]
        start = np.append(True, cls[1:] != cls[:-1])
        k = np.cumsum(start) - 1
        if w.by_position:
            late = ~start
        else:
            late = doc[lead[c]] != doc[lead[c]][np.flatnonzero(start)][k]
        c, off = c[late], off[late]
        # All rows of a content that could be first share its earliest row's document.
        order = np.lexsort((off, c))
        c, off = c[order], off[order]
        new = np.append(True, (c[1:] != c[:-1]) | (off[1:] != off[:-1] + 1))[: len(c)]
        s = np.flatnonzero(new)
        length = np.diff(np.append(s, len(c)))
        c, off = c[s], off[s]
        own = np.argsort(which[rows], kind="stable")
        rows = rows[own]
        lo, hi = np.searchsorted(which[rows], c), np.searchsorted(which[rows], c, "right")
        rep = hi - lo
        yield rows[ranges(lo, rep)], np.repeat(off, rep), np.repeat(length, rep)

    def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of all rows, first of each row, number of each row) of packed positions."""
        data, cut = utf8(column)
        return np.frombuffer(data.tobytes(), np.uint32).astype(np.int64), cut[:-1] // 4, np.diff(cut) // 4

    def packed(doc, key, at, n) -> pa.RecordBatch:
        order = np.lexsort((key, doc))
        doc, key, pair = doc[order], key[order], np.column_stack([at, n])[order].astype(np.uint32)
        s = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(doc)])
        return pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(key[s]), _bytes([pair.ravel()], np.append(s, len(doc)) * 2)[0]], ["doc_id", "key", "spans"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            h, doc, key, n = (table.column(i).to_numpy() for i in (0, 1, 2, 4))
            at, start, many = places(table.column(3))
            for row, off, length in decide(h, doc, key, at[start], n, table.column(5).to_pylist()):
                if len(row):
                    rep = many[row]
                    row, off, length, which = np.repeat(row, rep), np.repeat(off, rep), np.repeat(length, rep), ranges(start[row], rep)
                    yield packed(doc[row], key[row], at[which] + off, length)

        for batch in batches:
            known = batch.filter(batch.column(5).is_null())
            if known.num_rows:
                yield packed(known.column(1).to_numpy(), known.column(2).to_numpy(), places(known.column(3))[0], known.column(4).to_numpy())
            batch = batch.filter(batch.column(5).is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= batch_bytes:  # whole anchors only
                table = pa.Table.from_batches(held)
                h = table.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield from settle(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from settle(pa.Table.from_batches(held))
        held = []
        release()

    # Rows that are already decided go anywhere; they follow their document's hash to spread.
    dealt = sent.withColumn("h", F.when(F.col("content").isNull(), F.xxhash64("doc", "at", "key")).otherwise(F.col("h")))
    return dealt.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(shard, "doc_id long, key long, spans binary")


@dataclass
class Marked:
    """ids(doc_id, key, sha, first, n_bytes): one row per row of docs, first the smallest doc_id of its text; spans(doc_id,
    key, spans: array of packed pairs) for the rows that are first of their text and hold windows that are not first."""

    ids: DataFrame
    spans: DataFrame


def mark(docs: DataFrame, w: Windows) -> Marked:
    """Find the windows of docs(doc_id, text) that are not first of their kind."""
    tasks = tasks_for(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    docs = docs.select(doc, text)
    keyed = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("key"))
    keyed = durable(keyed)
    firsts = durable(keyed.groupBy("sha").agg(F.min("doc_id").alias("first"), F.min("key").alias("key")))
    anchors = durable(_repeated_anchors(docs.select(F.xxhash64("text").alias("key"), "text"), w, tasks))
    # At most (number of runs) / w.crowded hashes.
    crowded = np.sort(np.array([r.key for r in anchors.where("crowded = 1").select("key").collect()], np.int64).view(np.uint64))
    asked = (
        anchors.where("crowded = 0").groupBy("key").agg(F.collect_list("at").alias("at"))
        .join(firsts.select("key", F.col("first").alias("doc_id")), "key")
    )
    # Only the row of smallest doc_id of each text takes part, so copies of one text are not one large key here.
    some = docs.withColumn("key", F.xxhash64("text")).join(asked, ["doc_id", "key"]).select("doc_id", "key", "text", "at")
    spans = _not_first(_content_runs(some, w, docs.sparkSession.sparkContext.broadcast(crowded)), w, tasks)
    spans = durable(spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans")))
    ids = keyed.join(firsts.drop("key"), "sha").select("doc_id", "key", "sha", "first", "n_bytes")
    return Marked(ids, spans)


def unpacked(lists: pa.Array, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, numbers) of a column of arrays of binary values that hold groups of width 32-bit numbers; a null is an empty
    array."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    data, cut = utf8(lists.flatten())
    elements = np.diff(np.asarray(lists.offsets))
    if lists.null_count:
        elements[np.asarray(lists.is_null())] = 0
    values = np.frombuffer(data.tobytes(), np.uint32).astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(lists)), elements), np.diff(cut) // (4 * width))
    return row, values if width == 1 else values.reshape(-1, width)


def covered(rows: Rows, spans: pa.Array, length: int) -> np.ndarray:
    """Units of rows that lie in a marked window; spans: for each row a list of packed pairs, or null."""
    owner, pair = unpacked(spans, 2)
    start = rows.offsets[owner] + pair[:, 0]
    step = np.zeros(len(rows.values) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + pair[:, 1] + length - 1, len(rows.values)), -1)
    return np.cumsum(step[:-1]) > 0
