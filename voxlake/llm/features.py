"""Hashed terms of whole texts, and bounded training samples, for the two text models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .text import LOWER, hash_spans, pieces, utf8, words

# ASCII other than letters and digits parts terms; bytes of other scripts belong to terms.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)

# Shapes: one sign for a run of lower-case letters or bytes of other scripts, of capitals, and of digits.
_SHAPE = np.array([65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 97 if b >= 128 or chr(b).isalpha() else b for b in range(256)], np.uint8)
_RUN = np.isin(np.arange(256), (48, 65, 97))


def terms(data: np.ndarray, offsets: np.ndarray, bits: int, keep_marks: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each distinct hashed term of each row, in order of row and term.

    Terms are lower-cased (A-Z) words without ASCII punctuation, hashed to 2 ** bits. keep_marks: the shape of each
    word counts as a term too, its first 24 signs, so that tables, capitals, markup and the like are seen. prefixes: so
    do the first bytes of longer words, which gather the inflected forms of a stem.
    """
    low = LOWER[data]
    normal, starts, ends, first = words(_PLAIN[low], offsets)
    mask = np.uint64((1 << bits) - 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    term = hash_spans(normal, starts, ends) & mask
    rows, of = [row], [term]
    for k in prefixes:
        longer = np.flatnonzero(ends - starts > k)
        rows.append(row[longer])
        of.append(hash_spans(normal, starts[longer], starts[longer] + k) * np.uint64(5) & mask)
    row, term = np.concatenate(rows), np.concatenate(of)
    if keep_marks:
        shape = _SHAPE[data]
        again = np.zeros(len(shape), bool)
        again[1:] = (shape[1:] == shape[:-1]) & _RUN[shape[1:]]
        inner = offsets[1:-1]
        again[inner[inner < len(again)]] = False
        ended = np.append(0, np.cumsum(~again))
        normal, starts, ends, shaped = words(shape[~again], ended[offsets])
        row = np.append(row, np.repeat(np.arange(len(offsets) - 1), np.diff(shaped)))
        term = np.append(term, hash_spans(normal, starts, np.minimum(ends, starts + 24)) * np.uint64(3) & mask)
    key, count = np.unique(row.astype(np.uint64) << np.uint64(bits) | term, return_counts=True)
    return (key >> np.uint64(bits)).astype(np.int64), (key & mask).astype(np.int64), count


def labelled_sample(docs: DataFrame, grades: DataFrame, bits: int, rows: int, cells: int, **kinds) -> list:
    """Rows (doc_id, grade, weight, term, count) for training, at most rows of them with cells terms in all.

    grades(doc_id, grade): one row per document that may be learnt from. Each grade gives up to an equal share of the
    rows, those whose hashed id is smallest; weight is how many rows of its grade a drawn row stands for. What is drawn
    is bounded by the two parameters at any size of the tables; only this sample comes to the driver.
    """
    counts = {r.grade: r["count"] for r in grades.groupBy("grade").count().collect()}
    if not counts:
        return []
    share = max(1, rows // len(counts))
    drawn = None
    for grade in sorted(counts):
        part = grades.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share)
        drawn = part if drawn is None else drawn.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = utf8(batch.column(2))
            row, term, count = terms(data, offsets, bits, **kinds)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "grade", "term", "count"])

    # rows is a fixed parameter, so the drawn ids are a bounded side.
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
        .join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "grade", "text")
        .mapInArrow(run, "doc_id long, grade int, term array<int>, count array<int>")
    )
    key = [F.xxhash64("doc_id").alias("hash"), F.col("doc_id"), F.col("grade")]
    found = durable(found.select(*key, "term", "count"))
    sizes = found.groupBy("hash", "doc_id", "grade").agg(F.sum(F.size("term")).alias("cells")).orderBy("hash", "doc_id", "grade").collect()  # rows at most
    taken = int((np.cumsum([r.cells for r in sizes]) <= cells).sum())
    if not taken:
        return []
    last = sizes[taken - 1]
    upto = F.struct(F.lit(last["hash"]).cast("long"), F.lit(last.doc_id).cast("long"), F.lit(last.grade).cast("int"))
    got = found.where(F.struct("hash", "doc_id", "grade") <= upto).orderBy("hash", "doc_id", "grade").select("doc_id", "grade", "term", "count").toArrow()
    doc, grade = (got.column(c).to_numpy() for c in ("doc_id", "grade"))
    lists = [got.column(c).combine_chunks() for c in ("term", "count")]
    cuts = np.append(0, np.cumsum(np.asarray(lists[0].value_lengths())))
    term, count = (np.asarray(x.flatten()) for x in lists)  # packed() widens them, once
    have = dict(zip(*(x.tolist() for x in np.unique(grade, return_counts=True))))
    return [
        (d, g, counts[g] / have[g], term[a:b], count[a:b]) for d, g, a, b in zip(doc.tolist(), grade.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())
    ]


def packed(sample: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grade, weight of mean 1, row starts, term, count) of a labelled sample."""
    grade = np.array([s[1] for s in sample], np.int64)
    weight = np.array([s[2] for s in sample])
    start = np.append(0, np.cumsum([len(s[3]) for s in sample])).astype(np.int64)
    term = np.concatenate([s[3] for s in sample], dtype=np.int64) if sample else np.zeros(0, np.int64)
    count = np.concatenate([s[4] for s in sample], dtype=np.float64) if sample else np.zeros(0)
    return grade, weight / weight.mean() if len(weight) else weight, start, term, count


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def held_out_remainder(parts: int = 5):
    """crc32 of the id as text, modulo parts; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts
