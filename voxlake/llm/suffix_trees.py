"""Repeats of words by prefix-partitioned suffix trees (after Mansour et al., ERA, 2011).

The suffixes of a shard's texts are split by prefixes of one word, then two, and so on, until every prefix has few enough
suffixes for memory. Each prefix's subtree is its suffixes in order with the common prefixes of neighbours; its internal
nodes of a window's depth are the repeats. A prefix with a single suffix is a leaf and has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import LAST, PIECE, Rows, Windows, covered, mark
from .text import pieces, utf8, words

LENGTH = 13
IN_MEMORY = 1 << 16  # suffixes of a subtree


def subtrees(units: np.ndarray, suffixes: np.ndarray, depth: int = 0, length: int = LENGTH, in_memory: int = IN_MEMORY) -> Iterator[np.ndarray]:
    """The suffixes of each deep internal node: arrays of two or more suffixes that share their first length units.

    units: numbered words; suffixes: starts that share depth units already, each with length units to come.
    """
    if len(suffixes) < 2:
        return
    if depth == length:
        yield suffixes
        return
    if len(suffixes) > in_memory:  # a longer prefix
        head = units[suffixes + depth]
        order = np.argsort(head, kind="stable")
        head, suffixes = head[order], suffixes[order]
        for part in np.split(suffixes, np.flatnonzero(head[1:] != head[:-1]) + 1):
            yield from subtrees(units, part, depth + 1, length, in_memory)
        return
    rest = units[suffixes[:, None] + np.arange(depth, length)[None, :]]
    order = np.lexsort(rest.T[::-1])
    rest, suffixes = rest[order], suffixes[order]
    differ = rest[1:] != rest[:-1]
    common = np.where(differ.any(1), differ.argmax(1), length - depth)  # common prefix of neighbours
    node = np.append(False, common >= length - depth)
    starts = np.flatnonzero(~node)
    size = np.diff(np.append(starts, len(suffixes)))
    for s, n in zip(starts[size > 1].tolist(), size[size > 1].tolist()):
        yield suffixes[s : s + n]


def group_words(contents: list[bytes], length: int = LENGTH, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, word, class) of the windows that occur at least twice in contents."""
    data, offsets = utf8(pa.array(contents, pa.binary()))
    normal, starts, ends, first = words(data, offsets)
    raw = normal.tobytes()
    number: dict[bytes, int] = {}
    units = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    row = np.repeat(np.arange(len(contents)), np.diff(first))
    suffixes = np.flatnonzero(np.arange(len(units)) + length <= first[row + 1])
    nodes = list(subtrees(units, suffixes, 0, length, in_memory))
    if not nodes:
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate(nodes)
    return row[at], at - first[row[at]], np.repeat(np.arange(len(nodes)), [len(n) for n in nodes])


WORDS = Windows("words", LENGTH, 4, False, group_words)


def without_repeats(docs: DataFrame, w: Windows = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row of docs(doc_id, text, ...) without the words that lie in a window of
    13 words which also starts in a document of smaller doc_id; kept: the other words, one space between them.

    Words are runs of bytes other than ASCII space and 9 to 13, unchanged. Windows are judged on the input. A null text
    has no words; a null doc_id comes after all others; rows that share a doc_id are one document here, none smaller than
    the other. Texts shorter than a window stay whole, copies of longer texts are removed whole. Extra columns are ignored.
    """
    found = mark(docs, w)
    copies = found.ids.where("doc_id != first").select("doc_id", "key", F.lit(True).alias("copy")).distinct()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    texts = docs.select(doc, F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    joined = texts.join(found.spans, ["doc_id", "key"], "left").join(copies, ["doc_id", "key"], "left").select("doc_id", "text", "spans", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows = Rows.of(w, batch.column(1))
            n = np.diff(rows.offsets)
            gone = covered(rows, batch.column(2), w.length)
            copy = np.asarray(batch.column(3).is_valid()) & (n >= w.length)
            gone |= np.repeat(copy, n)
            # Bytes of a kept word and of the space after it.
            keep = np.repeat(~gone, rows.ends - rows.starts + 1)
            total = np.append(0, np.cumsum(keep))
            at = np.append(rows.starts, len(keep))[rows.offsets]
            raw = rows.raw[keep].tobytes()
            kept = [raw[a : max(a, b - 1)] for a, b in zip(total[at[:-1]].tolist(), total[at[1:]].tolist())]
            removed = np.append(0, np.cumsum(gone))[rows.offsets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.diff(removed)), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
