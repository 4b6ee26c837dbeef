"""Sets of word shingles, known by 64-bit hashes, and tables of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, hash_spans, pieces, utf8, words


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct shingles in ascending order are hashes[first[r]:first[r + 1]]."""
    normal, starts, ends, first = words(LOWER[data], offsets)
    counts = np.diff(first)
    many = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    group = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(many, out=group[1:])
    row = np.repeat(np.arange(len(counts)), many)
    at = first[row] + np.arange(group[-1]) - group[row]
    last = np.minimum(at + shingle, first[row + 1]) - 1
    h = hash_spans(normal, starts[at], ends[last]) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    raw = h.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], np.uint64).view(np.int64)


def _texts(docs: DataFrame, shingle: int) -> DataFrame:
    """(set, text), of rows of one set in one task the first only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            names = _names(*_sets(*utf8(batch.column(0)), shingle))
            new = [i for i, s in enumerate(names.tolist()) if not (s in seen or seen.add(s))]
            yield pa.RecordBatch.from_arrays([pa.array(names[new]), batch.column(0).take(pa.array(new, pa.int64()))], ["set", "text"])

    return docs.select("text").mapInArrow(run, "set long, text string")


def _members(texts: DataFrame, shingle: int) -> DataFrame:
    """(set, members) of texts(set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, first = _sets(*utf8(batch.column(1)), shingle)
            members = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), members], ["set", "members"])

    return texts.select("set", "text").mapInArrow(run, "set long, members array<long>")


def _few(df: DataFrame, most: int = 4_000_000) -> DataFrame:
    """df, to be broadcast if it has no more rows than most (of one number each)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
