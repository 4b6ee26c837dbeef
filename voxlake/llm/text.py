"""Arrow string columns as numpy byte arrays, and words in them; the vectorised ground of several operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The separators of words, ASCII space and the bytes 9 to 13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows one after another, offsets of the rows and the end); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory back to the system: a worker stays for later tasks, and those of an executor share its bound."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", target: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of about target bytes of the text column, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: (normal, starts, ends, first).

    normal holds the rows' words, each followed by one space; word i is normal[starts[i]:ends[i]]; the words of
    row r are first[r] to first[r + 1].
    """
    lens = np.diff(offsets)
    rows = len(lens)
    spaced = np.full(len(data) + rows, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(rows), lens)] = data
    gap = IS_SEPARATOR[spaced]
    before = np.empty_like(gap)
    before[:1] = True
    before[1:] = gap[:-1]
    kept = ~(gap & before)
    row_end = offsets[1:] + np.arange(rows)
    normal = spaced[kept]
    gap = gap[kept]
    normal[gap] = 32
    ends = np.flatnonzero(gap)
    starts = np.empty_like(ends)
    starts[:1] = 0
    starts[1:] = ends[:-1] + 1
    ended = np.cumsum(kept & (IS_SEPARATOR[spaced]))
    first = np.zeros(rows + 1, np.int64)
    if rows:
        first[1:] = ended[row_end]
    return normal, starts, ends, first


# An odd multiplier, its inverse modulo 2 ** 64, and the odd factors of the finishing steps.
_R = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Well spread bits of h."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(_MIX[0])
    h = (h ^ h >> np.uint64(27)) * np.uint64(_MIX[1])
    return h ^ h >> np.uint64(31)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def hash_grams(values: np.ndarray, k: int) -> np.ndarray:
    """hash_spans of the k values from each position that has them, in little memory."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((_BYTE[values] if values.dtype == np.uint8 else values) * up[:-1], out=total[1:])
    h = total[k:] - total[:-k]
    del total
    h *= down[: len(h)]
    h += np.uint64(k)
    return mixed(h)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span values[starts[i]:ends[i]], equal for equal contents; values: bytes, or hashes of units."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((_BYTE[values] if values.dtype == np.uint8 else values) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
