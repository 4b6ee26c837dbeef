"""Media columns: payloads as progressive JPEG, decoded to coefficients and full-resolution RGB tensors.

The decoder accumulates all scans (spectral selection and successive approximation) of many files at once into one
coefficient array: every restart interval is a lane, and lanes read one Huffman symbol each per numpy step. Coefficients
are dequantized and inverse-transformed, chroma is upsampled, and colours become RGB. Any baseline-free progressive file
with 8-bit samples, one or three components and integer sampling ratios can be read.

A payload is stored in the coefficients, the format's own unit, of a colour image whose chroma has half the resolution both
ways, 64 bytes a block in zigzag order: the luma's blocks first, then those of the two chroma components. A payload of one
block is an image of 8 x 8 whose chroma is filled up. A byte b is the coefficient b + 2, which is not zero in any scan.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import pieces, utf8

BLOCK = 64
INTERVAL = 4  # blocks between restart markers
WIDEST = 4000  # units of 16 x 16 pixels
SAMPLING = ((2, 2), (1, 1), (1, 1))  # of the components, across and down
OFFSET = 2

# The zigzag order by its rule: anti-diagonals in turn, odd ones downwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
# Basis of the 8-point inverse cosine transform: BASIS[k, x].
BASIS = np.array([[np.cos((2 * x + 1) * k * np.pi / 16) * (0.5 if k else np.sqrt(0.125)) for x in range(8)] for k in range(8)])

# Code lengths of the encoder's tables: 4 bits for sizes without a run, 9 bits for everything else.
DC_TABLE = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
_SHORT = list(range(9))
_LONG = [r << 4 | s for r in range(16) for s in range(11) if (r << 4 | s) not in _SHORT]
AC_TABLE = bytes([0, 0, 0, len(_SHORT), 0, 0, 0, 0, len(_LONG)] + [0] * 7) + bytes(_SHORT + _LONG)

# Scans of the encoder: (first and last coefficient, high and low bit position).
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))


def huffman(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) by the next 16 bits; length 0: no code."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            length[span], symbol[span] = n, table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol."""
    out, lens = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[table[k]], lens[table[k]] = code, n
            code, k = code + 1, k + 1
        code <<= 1
    return out, lens


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _stream(value: np.ndarray, bits: np.ndarray, interval: np.ndarray, last: np.ndarray, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes and where each interval's begin: values of up to 32 bits, by interval in order; last: intervals
    that end a scan and are followed by no restart marker."""
    n = len(last)
    total = np.bincount(interval, bits, n).astype(np.int64)
    pad = -total % 8
    size = (total + pad) // 8 + 2 * ~last
    start = np.append(0, np.cumsum(size))
    run = np.cumsum(bits) - bits
    first = np.searchsorted(interval, np.arange(n))
    at = run - run[first][interval] + start[interval] * 8
    ends = start[:-1] * 8 + total
    words = np.zeros(start[-1] // 4 + 3, np.uint64)
    for pos, val, ln in ((at, value, bits), (ends, (1 << pad) - 1, pad)):
        moved = val.astype(np.uint64) << (64 - (pos & 31) - ln).astype(np.uint64) % np.uint64(64)
        word = pos >> 5
        group = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[group]] += np.add.reduceat(moved >> np.uint64(32), group)
        words[word[group] + 1] += np.add.reduceat(moved & np.uint64(0xFFFFFFFF), group)
    raw = words.astype(">u4").view(np.uint8)[: start[-1]].copy()
    mark = np.zeros(len(raw), bool)
    at = start[1:][~last] - 2
    raw[at], raw[at + 1] = 0xFF, 0xD0 + marker[~last]
    mark[at] = True
    double = (raw == 0xFF) & ~mark
    place = np.arange(len(raw)) + np.cumsum(double) - double
    out = np.zeros(len(raw) + int(double.sum()), np.uint8)
    out[place] = raw
    return out, np.append(place, len(out))[start]


def encode(data: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """Progressive JPEG files of payloads: data holds their bytes one after another, blocks the number of 64-byte blocks."""
    units = -(-blocks // sum(h * v for h, v in SAMPLING))
    tall = -(-units // WIDEST)
    wide = -(-units // tall)
    single = blocks == 1
    each = np.stack([np.where(single, 1, wide * tall * h * v) for h, v in SAMPLING], 1)  # blocks of each file's components
    room = each.ravel()
    start = np.append(0, np.cumsum(room))
    coef = np.full((int(start[-1]), BLOCK), OFFSET, np.int64)
    own = np.repeat(np.arange(len(blocks)), blocks)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    coef[start[len(SAMPLING) * own] + inner] = data.reshape(-1, BLOCK) + np.int64(OFFSET)
    # Each component is a row of blocks of its own: all scans are of one component.
    part = np.repeat(np.arange(len(room)), room)
    within = np.arange(len(part)) - start[part]
    per_part = -(-room // INTERVAL)
    first_interval = np.append(0, np.cumsum(per_part))
    interval = first_interval[part] + within // INTERVAL
    owner = np.repeat(np.arange(len(room)), per_part)
    number = np.arange(len(owner)) - first_interval[owner]
    last = number == per_part[owner] - 1
    (dc, dc_len), (ac, ac_len) = codes(DC_TABLE), codes(AC_TABLE)
    scans = []
    for ss, se, high, low in SCANS:
        if se == 0 and not high:
            v = coef[:, 0] >> low
            d = v - np.where(within % INTERVAL == 0, 0, np.append(0, v[:-1]))
            s = _sizes(d)
            value, bits = dc[s] << s | np.where(d < 0, d + (1 << s) - 1, d), dc_len[s] + s
            where = interval
        elif not high:
            v = (coef[:, ss : se + 1] >> low).ravel()
            s = _sizes(v)
            value, bits, where = ac[s] << s | v, ac_len[s] + s, np.repeat(interval, se - ss + 1)
        elif se == 0:
            value, bits, where = coef[:, 0] & 1, np.ones(len(coef), np.int64), interval
        else:  # an end-of-block symbol, then one more bit of each coefficient
            one = coef[:, 1:] & 1
            power = 1 << np.arange(31, -1, -1)
            value = np.stack([np.full(len(coef), ac[0]), one[:, :32] @ power, one[:, 32:] @ power[1:]], 1).ravel()
            bits, where = np.tile([ac_len[0], 32, 31], len(coef)), np.repeat(interval, 3)
        scans.append(_stream(value, bits, where, last, number % 8))
    head = _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, b"\x00" + DC_TABLE) + _segment(0xC4, b"\x10" + AC_TABLE) + _segment(0xDD, struct.pack(">H", INTERVAL))
    orders = [[_segment(0xDA, bytes([1, c + 1, 0, ss, se, high << 4 | low])) for c in range(len(SAMPLING))] for ss, se, high, low in SCANS]
    raw = [(out.tobytes(), begin[first_interval].tolist()) for out, begin in scans]
    shape = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
    side = np.where(single, 8, 16)
    return [
        b"".join(
            [
                b"\xff\xd8",
                _segment(0xFE, struct.pack(">Q", int(blocks[i]))),
                _segment(0xC2, struct.pack(">BHHB", 8, int(side[i] * tall[i]), int(side[i] * wide[i]), len(SAMPLING)) + shape),
                head,
                *(x for order, (r, b) in zip(orders, raw) for c, o in enumerate(order) for x in (o, r[b[len(order) * i + c] : b[len(order) * i + c + 1]])),
                b"\xff\xd9",
            ]
        )
        for i in range(len(blocks))
    ]


@dataclass
class Component:
    tag: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks of the component itself
    tall: int = 0
    stride: int = 0  # blocks in the array, whole MCUs
    first: int = 0  # first block in the array of all files


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes


class Decoder:
    """Coefficients of files in zigzag order: coef[block, k]; images tell which blocks are whose."""

    def __init__(self, files: list[bytes]):
        self.raw = np.frombuffer(b"".join(files) + b"\0" * 8, np.uint8)
        follow = self.raw[1:]
        mark = np.flatnonzero((self.raw[:-1] == 0xFF) & (follow != 0) & ((follow < 0xD0) | (follow > 0xD7)))
        self.images: list[Image] = []
        self.blocks = 0
        groups: dict[tuple, list] = defaultdict(list)
        base = 0
        for f in files:
            self._headers(f, base, mark, groups)
            base += len(f)
        self.coef = np.zeros((self.blocks, BLOCK), np.int32)
        for key in sorted(groups, key=lambda k: k[0]):
            self._scan(key, groups[key])

    def _headers(self, f: bytes, base: int, mark: np.ndarray, groups: dict) -> None:
        if f[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        tables: dict[int, bytes] = {}
        quant: dict[int, np.ndarray] = {}
        image, comment, restart, at, order = None, b"", 0, 2, 0
        while True:
            marker = f[at + 1]
            if marker == 0xD9:
                break
            size = f[at + 2] << 8 | f[at + 3]
            body = f[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                restart = body[0] << 8 | body[1]
            elif marker == 0xC2:
                _, height, width, n = struct.unpack(">BHHB", body[:6])
                parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                h, v = max(c.h for c in parts), max(c.v for c in parts)
                mx, my = -(-width // (8 * h)), -(-height // (8 * v))
                for c in parts:
                    c.wide, c.tall = -(-width * c.h // (8 * h)), -(-height * c.v // (8 * v))
                    c.stride, c.first = mx * c.h, self.blocks
                    self.blocks += mx * c.h * my * c.v
                image = Image(width, height, parts, quant, comment)
                self.images.append(image)
            elif marker == 0xDA:
                n = body[0]
                chosen = [next(c for c in image.components if c.tag == body[1 + 2 * i]) for i in range(n)]
                ids = [body[2 + 2 * i] for i in range(n)]
                ss, se, bits = body[1 + 2 * n : 4 + 2 * n]
                end = int(mark[np.searchsorted(mark, base + at)]) - base
                # The kind of a scan: its place in the file, what it codes and by which tables, and the blocks of an MCU.
                kind = (order, ss, se, bits >> 4, bits & 15, tuple(tables.get(i >> 4, b"") if ss == 0 else tables.get(0x10 | i & 15, b"") for i in ids), tuple(c.h * c.v for c in chosen) if n > 1 else (1,), restart)
                groups[kind].append((base + at, base + end, self._slots(chosen)))
                at, order = end, order + 1
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive files with Huffman codes are read")

    @staticmethod
    def _slots(chosen: list[Component]) -> np.ndarray:
        """Blocks of a scan in the order in which they are coded."""
        if len(chosen) == 1:
            c = chosen[0]
            return c.first + (np.arange(c.tall)[:, None] * c.stride + np.arange(c.wide)[None, :]).ravel()
        c = chosen[0]
        mx = c.stride // c.h
        my = -(-c.tall // c.v)
        y, x = (a.ravel()[:, None] for a in np.mgrid[:my, :mx])
        return np.concatenate([c.first + (y * c.v + np.repeat(np.arange(c.v), c.h)) * c.stride + x * c.h + np.tile(np.arange(c.h), c.v) for c in chosen], axis=1).ravel()

    def _scan(self, kind: tuple, members: list) -> None:
        _, ss, se, high, low, tables, mcu, restart = kind
        lens = np.array([b - a for a, b, _ in members])
        data = np.concatenate([self.raw[a:b] for a, b, _ in members])
        file_start = np.append(0, np.cumsum(lens))
        ff = np.append(data[:-1] == 0xFF, False)
        ff[file_start[1:] - 1] = False
        follow = np.append(data[1:], 0)
        rst = np.flatnonzero(ff & (follow >= 0xD0) & (follow <= 0xD7))
        drop = np.zeros(len(data), bool)
        drop[np.flatnonzero(ff & (follow == 0)) + 1] = True
        drop[rst] = drop[rst + 1] = True
        place = np.append(0, np.cumsum(~drop))
        buffer = np.append(data[~drop], np.zeros(16, np.uint8)).astype(np.int64)
        self.window = buffer[:-2] << 16 | buffer[1:-1] << 8 | buffer[2:]
        slots = [s for _, _, s in members]
        n_blocks = np.array([len(s) for s in slots])
        self.slot = np.concatenate(slots)
        step = restart * sum(mcu) or int(n_blocks.max())
        per_file = -(-n_blocks // step)
        owner = np.repeat(np.arange(len(members)), per_file)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_file) - per_file, per_file)
        # Lanes in order of files and intervals are in order of bytes.
        begins = np.sort(np.append(file_start[:-1], rst + 2))
        if len(begins) != len(owner):
            raise ValueError("a restart marker is missing or extra")
        self.bit = place[begins] * 8
        self.first = np.cumsum(n_blocks)[owner] - n_blocks[owner] + number * step
        self.count = np.minimum(n_blocks[owner] - number * step, step)
        if ss == 0:
            self._dc(high, low, tables, mcu)
        elif high == 0:
            self._ac_first(ss, se, low, tables[0])
        else:
            self._ac_refine(ss, se, low, tables[0])

    def _peek(self, bit: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return self.window[bit >> 3] >> (8 - (bit & 7)) & 0xFFFF

    def _dc(self, high: int, low: int, tables: tuple, mcu: tuple) -> None:
        if high:
            lane = np.repeat(np.arange(len(self.bit)), self.count)
            j = np.arange(len(lane)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
            bit = self.bit[lane] + j
            self.coef[self.slot[self.first[lane] + j], 0] |= (self._peek(bit) >> 15 << low).astype(np.int32)
            return
        books = [huffman(t) for t in tables]
        part = np.repeat(np.arange(len(mcu)), mcu)
        before = np.zeros((len(self.bit), len(mcu)), np.int64)
        lane = np.arange(len(self.bit))
        for j in range(int(self.count.max(initial=0))):
            lane = lane[self.count[lane] > j]
            c = part[j % len(part)]
            length, symbol = books[c]
            w = self._peek(self.bit[lane])
            s = symbol[w]
            bit = self.bit[lane] + length[w]
            x = self._peek(bit) >> (16 - s)
            before[lane, c] += np.where((x >> np.maximum(s - 1, 0) & 1) | (s == 0), x, x - (1 << s) + 1)
            self.bit[lane] = bit + s
            self.coef[self.slot[self.first[lane] + j], 0] = before[lane, c] << low

    def _ac_first(self, ss: int, se: int, low: int, table: bytes) -> None:
        length, symbol = huffman(table)
        lane = np.flatnonzero(self.count > 0)
        bit, block, left = self.bit[lane], self.first[lane], self.first[lane] + self.count[lane]
        k = np.full(len(lane), ss)
        while len(bit):
            w = self._peek(bit)
            rs = symbol[w]
            bit = bit + length[w]
            r, s = rs >> 4, rs & 15
            x = self._peek(bit) >> (16 - s)
            value = np.where(x >> np.maximum(s - 1, 0) & 1, x, x - (1 << s) + 1) << low
            k = k + r
            put = s > 0
            if put.all():
                self.coef[self.slot[block], k] = value
                bit, k = bit + s, k + 1
            else:
                self.coef[self.slot[block[put]], k[put]] = value[put]
                end = ~put & (r < 15)  # end of this block and of (1 << r) - 1 + bits more
                run = (1 << r) + np.where(r > 0, self._peek(bit) >> (16 - r), 0)
                bit = bit + np.where(put, s, np.where(end, r, 0))
                block = block + np.where(end, run, 0)
                k = np.where(end, ss, k + 1)
            over = k > se
            if over.any():
                block = block + over
                k = np.where(over, ss, k)
            live = block < left
            if not live.all():
                bit, block, left, k = bit[live], block[live], left[live], k[live]

    def _ac_refine(self, ss: int, se: int, low: int, table: bytes) -> None:
        length, symbol = huffman(table)
        lane = np.flatnonzero(self.count > 0)
        bit, block, left = self.bit[lane], self.first[lane], self.first[lane] + self.count[lane]
        k, run = np.full(len(lane), ss), np.zeros(len(lane), np.int64)
        span = np.arange(ss, se + 1)
        while len(bit):
            w = self._peek(bit)
            rs = np.where(run > 0, 0, symbol[w])
            bit = bit + np.where(run > 0, 0, length[w])
            r, s = rs >> 4, rs & 15
            end = (s == 0) & (r < 15)
            more = end & (run == 0)
            run = np.where(more, (1 << r) + np.where(r > 0, self._peek(bit) >> (16 - r), 0), run)
            bit = bit + np.where(more, r, 0)
            sign = np.where(self._peek(bit) >> 15, 1, -1)
            bit = bit + (s > 0)
            rows = self.slot[block]
            now = self.coef[rows, ss : se + 1]
            ahead = span[None, :] >= k[:, None]
            zero = (now == 0) & ahead
            # Up to the zero after r others, or to the end of the block.
            stop = np.where(end[:, None], False, zero & (np.cumsum(zero, 1) == r[:, None] + 1))
            upto = np.where(stop.any(1), stop.argmax(1), se - ss + 1)
            fix = (now != 0) & ahead & (np.arange(len(span))[None, :] < upto[:, None])
            place = bit[:, None] + np.cumsum(fix, 1) - fix
            on = fix & (self.window[np.minimum(place >> 3, len(self.window) - 1)] >> (23 - (place & 7)) & 1).astype(bool)
            now = now + np.where(on, np.where(now > 0, 1, -1) << low, 0)
            new = np.flatnonzero(s > 0)
            new = new[upto[new] <= se - ss]
            now[new, upto[new]] = sign[new] << low
            self.coef[rows, ss : se + 1] = now
            bit = bit + fix.sum(1)
            k = ss + upto + 1
            over = end | (k > se)
            run = np.where(end, run - 1, run)
            block, k = block + over, np.where(over, ss, k)
            live = block < left
            if not live.all():
                bit, block, left, k, run = bit[live], block[live], left[live], k[live], run[live]


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples from 0 to 255 of zigzag coefficients. Sums run in one order, whatever the batch."""
    grid = np.zeros((len(coef), 64), np.float32)
    grid[:, ZIGZAG] = coef * quant
    grid = grid.reshape(-1, 8, 8)
    basis = BASIS.astype(np.float32)
    for axis in (1, 2):
        parts = [np.take(grid, k, axis) for k in range(8)]
        out = []
        for x in range(8):
            total = parts[0] * basis[0, x]
            for k in range(1, 8):
                total += parts[k] * basis[k, x]
            out.append(total)
        grid = np.stack(out, axis)
    return np.clip(np.rint(grid + 128), 0, 255).astype(np.uint8)


def rgb(d: Decoder, image: Image) -> np.ndarray:
    """(height, width, 3) tensor of one image: chroma samples are repeated up to full resolution."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        n = c.stride * (-(-image.height // (8 * v)) * c.v)
        s = samples(d.coef[c.first : c.first + n], image.quant[c.table]).reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.stride * 8)
        planes.append(np.repeat(np.repeat(s, v // c.v, 0), h // c.h, 1)[: image.height, : image.width].astype(np.float32))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def channel_sums(d: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of squares), (images, 3), of the full-resolution R, G and B of images that encode() made: rgb() for all at
    once, a quarter of each unit of 16 x 16 pixels at a time."""
    luma, chroma = ([i.components[k] for i in d.images] for k in (0, 1))
    units = np.array([c.stride for c in chroma]) * [c.tall for c in chroma]
    own = np.repeat(np.arange(len(units)), units)
    k = np.arange(len(own)) - np.repeat(np.cumsum(units) - units, units)
    across = np.array([c.stride for c in chroma])[own]
    y, x = k // across, k % across
    first, stride, tall, wide = (np.array([getattr(c, name) for c in luma])[own] for name in ("first", "stride", "tall", "wide"))
    s = samples(d.coef, 1)
    cb, cr = (s[np.array([i.components[c].first for i in d.images])[own] + k].astype(np.float32) - 128 for c in (1, 2))
    one, two = np.zeros((len(units), 3)), np.zeros((len(units), 3))
    for j in range(2):
        for i in range(2):
            inside = np.flatnonzero((2 * y + j < tall) & (2 * x + i < wide))
            light = s[(first + (2 * y + j) * stride + 2 * x + i)[inside]].astype(np.float32)
            b, r = (c[inside, 4 * j : 4 * j + 4, 4 * i : 4 * i + 4].repeat(2, 1).repeat(2, 2) for c in (cb, cr))
            for c, v in enumerate((light + 1.402 * r, light - 0.344136 * b - 0.714136 * r, light + 1.772 * b)):
                v = np.clip(np.rint(v), 0, 255).astype(np.int32).reshape(len(v), BLOCK)
                one[:, c] += np.bincount(own[inside], v.sum(1), len(units))
                two[:, c] += np.bincount(own[inside], (v * v).sum(1), len(units))
    return one, two


def payloads(d: Decoder) -> list[bytes]:
    """The bytes that encode() stored in each file."""
    raw = (d.coef - OFFSET).astype(np.uint8)
    return [raw[(c := i.components[0]).first : c.first + struct.unpack(">Q", i.comment)[0]].tobytes() for i in d.images]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as UTF-8, padded with bytes 0 to a positive multiple of 64, in a JPEG
    file. A null text is empty; equal texts give equal files; repeated rows stay; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            data, offsets = utf8(batch.column(1))
            n = np.diff(offsets)
            blocks = np.maximum(-(-n // BLOCK), 1)
            padded = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
            start = (np.cumsum(blocks) - blocks) * BLOCK
            padded[np.arange(len(data)) + np.repeat(start - offsets[:-1], n)] = data
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(encode(padded, blocks), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """media(media, ...) with columns height, width and rgb (bytes of the height x width x 3 tensor); a null file has nulls."""
    schema = T.StructType(list(media.schema.fields)).add("height", T.IntegerType()).add("width", T.IntegerType()).add("rgb", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 2 << 20):
            files = batch.column(batch.schema.get_field_index("media")).to_pylist()
            d = Decoder([f for f in files if f is not None])
            images = iter(d.images)
            got = [None if f is None else rgb(d, next(images)) for f in files]
            cols = [pa.array([None if g is None else g.shape[i] for g in got], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array([None if g is None else g.tobytes() for g in got], pa.binary())], schema.names)

    return media.mapInArrow(run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of store()'s rows,
    from the stored bytes alone; feature: size, mean and spread of each channel of the decoded RGB tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 2 << 20):
            files = batch.column(2).to_pylist()
            d = Decoder(files)
            got = payloads(d)
            one, two = (x.tolist() for x in channel_sums(d))
            feature = []
            for i, a, b in zip(d.images, one, two):
                n = i.height * i.width
                means = [f"{c}={p / n:.4f}/{max(0, q / n - (p / n) ** 2) ** 0.5:.4f}" for c, p, q in zip("rgb", a, b)]
                feature.append(f"{i.width}x{i.height} {' '.join(means)}")
            sha = lambda x: hashlib.sha256(x).hexdigest()
            cols = [
                pa.array([len(p) for p in got]), pa.array([sha(p) for p in got]), pa.array([zlib.crc32(p[-BLOCK:]) for p in got], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()), pa.array([sha(f) for f in files]), pa.array(feature),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    names = ["doc_id", "n_bytes", *kinds]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join([f"doc_id {media.schema['doc_id'].dataType.simpleString()}", "n_bytes long", *(f"{k} {v}" for k, v in kinds.items())]))


def op2_media(spark, sf_dir: str) -> DataFrame:
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))))
