import hashlib
import struct
import zlib

import numpy as np
import pytest

from voxlake.llm import media

D = "/root/testdata/sf0.001"


class Bits:
    """Scalar writer of one scan, bit by bit."""

    def __init__(self):
        self.bits, self.out = [], b""

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def flush(self, marker=None):
        while len(self.bits) % 8:
            self.bits.append(1)
        for i in range(0, len(self.bits), 8):
            b = int("".join(map(str, self.bits[i : i + 8])), 2)
            self.out += bytes([b]) + (b"\0" if b == 255 else b"")
        self.bits = []
        if marker is not None:
            self.out += bytes([0xFF, 0xD0 + marker])


def down(v, low):
    return (abs(v) >> low) * (1 if v > 0 else -1)


def put_size(w, book, prefix, v):
    s = abs(v).bit_length()
    w.put(int(book[0][prefix << 4 | s]), int(book[1][prefix << 4 | s]))
    if s:
        w.put(v if v > 0 else v + (1 << s) - 1, s)


def scan_dc(parts, low, book, restart):
    """parts: per MCU a list of (component, value)."""
    w, before = Bits(), {}
    for m, mcu in enumerate(parts):
        if m and m % restart == 0:
            w.flush((m // restart - 1) % 8)
            before = {}
        for c, v in mcu:
            v >>= low
            put_size(w, book, 0, v - before.get(c, 0))
            before[c] = v
    w.flush()
    return w.out


def scan_bits(values, low, restart):
    w = Bits()
    for m, v in enumerate(values):
        if m and m % restart == 0:
            w.flush((m // restart - 1) % 8)
        for x in v:
            w.put(x >> low & 1, 1)
    w.flush()
    return w.out


def scan_ac(blocks, ss, se, high, low, book, restart):
    w = Bits()
    symbol = lambda s: w.put(int(book[0][s]), int(book[1][s]))
    run, held = 0, []

    def end_run():
        nonlocal run, held
        if run:
            n = run.bit_length() - 1
            symbol(n << 4)
            w.put(run - (1 << n), n)
            for b in held:
                w.put(b, 1)
        run, held = 0, []

    for m, block in enumerate(blocks):
        if m and m % restart == 0:
            end_run()
            w.flush((m // restart - 1) % 8)
        v = [down(int(x), low) for x in block]
        fresh = [k for k in range(ss, se + 1) if v[k] and (not high or abs(v[k]) == 1)]
        last, zeros, fix = max(fresh, default=-1), 0, []
        for k in range(ss, se + 1):
            if high and abs(v[k]) > 1:
                fix.append(abs(v[k]) & 1)
                continue
            if k > last:
                continue
            if v[k] == 0:
                zeros += 1
                if zeros == 16 and high:
                    end_run()
                    symbol(0xF0)
                    for b in fix:
                        w.put(b, 1)
                    zeros, fix = 0, []
                continue
            end_run()
            while zeros > 15:
                symbol(0xF0)
                zeros -= 16
            if high:
                symbol(zeros << 4 | 1)
                w.put(int(v[k] > 0), 1)
                for b in fix:
                    w.put(b, 1)
                fix = []
            else:
                put_size(w, book, zeros, v[k])
            zeros = 0
        if last < se:
            run, held = run + 1, held + fix
            if run == 0x7FFF:
                end_run()
    end_run()
    w.flush()
    return w.out


def colour_file(rng, width, height, sampling, restart=5):
    parts = []
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mx, my = -(-width // (8 * h)), -(-height // (8 * v))
    for ch, cv in sampling:
        coef = np.where(rng.random((my * cv, mx * ch, 64)) < 0.12, rng.integers(-60, 61, (my * cv, mx * ch, 64)), 0)
        coef[:, :, 0] = rng.integers(-300, 300, coef.shape[:2])
        coef[0, 0, 1:] = 0
        coef[0, 0, 40] = 1
        parts.append(coef)
    dc, ac = (media.codes(t) for t in (media.DC_TABLE, AC_FULL))
    mcus = [[(c, int(parts[c][y * cv + j, x * ch + i, 0])) for c, (ch, cv) in enumerate(sampling) for j in range(cv) for i in range(ch)] for y in range(my) for x in range(mx)]
    seg = media._segment
    n = len(sampling)
    out = b"\xff\xd8" + seg(0xDB, bytes([0] + [2] * 64)) + seg(0xC2, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)))
    out += seg(0xC4, b"\x00" + media.DC_TABLE) + seg(0xC4, b"\x10" + AC_FULL) + seg(0xDD, struct.pack(">H", restart))
    order = lambda ids, ss, se, a: seg(0xDA, bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([ss, se, a]))
    every = list(range(n))
    real = [p[: -(-height * cv // (8 * v)), : -(-width * ch // (8 * h))].reshape(-1, 64) for p, (ch, cv) in zip(parts, sampling)]
    one = n == 1
    first = [[(0, int(b[0]))] for b in real[0]] if one else mcus
    out += order(every, 0, 0, 0x01) + scan_dc(first, 1, dc, restart)
    for c in every:
        for ss, se in ((1, 9), (10, 63)):
            out += order([c], ss, se, 0x02) + scan_ac(real[c], ss, se, 0, 2, ac, restart)
    out += order(every, 0, 0, 0x10) + scan_bits([[x for _, x in m] for m in first], 0, restart)
    for c in every:
        for high, low in ((2, 1), (1, 0)):
            out += order([c], 1, 63, high << 4 | low) + scan_ac(real[c], 1, 63, high, low, ac, restart)
    return out + b"\xff\xd9", parts, real


# All symbols, end-of-block runs too.
AC_FULL = bytes([0, 0, 0, 9, 0, 0, 0, 0, len(media._LONG)] + [0] * 7) + bytes(media._SHORT + media._LONG)


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
def test_decoder_reads_general_files(sampling):
    rng = np.random.default_rng(len(sampling) + sampling[0][1])
    made = [colour_file(rng, w, h, sampling) for w, h in ((8, 8), (37, 21), (64, 40))]
    d = media.Decoder([m[0] for m in made])
    for image, (_, parts, real) in zip(d.images, made):
        for c, p, r in zip(image.components, parts, real):
            got = d.coef[c.first : c.first + p.shape[0] * p.shape[1]].reshape(p.shape)
            assert (got[: c.tall, : c.wide].reshape(-1, 64) == r).all()
            assert (got[:, :, 0] == p[:, :, 0]).all() or len(parts) == 1
        out = media.rgb(d, image)
        assert out.shape == (image.height, image.width, 3) and out.dtype == np.uint8


def test_inverse_transform_and_chroma():
    rng = np.random.default_rng(2)
    coef = rng.integers(-40, 40, (5, 64))
    want = np.zeros((5, 64))
    want[:, media.ZIGZAG] = coef * 3
    a = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
    want = np.clip(np.rint(np.einsum("ki,nkl,lj->nij", a, want.reshape(5, 8, 8), a) + 128), 0, 255)
    assert np.abs(want - media.samples(coef, np.full(64, 3))).max() <= 1
    f, parts, _ = colour_file(rng, 16, 16, [(2, 2), (1, 1), (1, 1)])
    d = media.Decoder([f])
    out = media.rgb(d, d.images[0]).astype(int)
    y, cb, cr = (media.samples(d.coef[c.first : c.first + n], 2) for c, n in zip(d.images[0].components, (4, 1, 1)))
    r = np.clip(np.rint(y[0][0, 0] + 1.402 * (float(cr[0][0, 0]) - 128)), 0, 255)
    assert out[0, 0, 0] == out[0, 0, 0] == r


def test_query_round_trip(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = media.op2_media(spark, D).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_odd_rows(spark):
    texts = [None, "", "a", "\x00\x01\xff" * 50, "é" * 32, "x" * 64, "y" * 700_000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = media.store(df)
    got = {r.doc_id: r for r in media.read_back(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[i].n_bytes == len(raw)
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert media.read_back(media.store(df.limit(0))).count() == 0
    shapes = {r.doc_id: (r.height, r.width, len(r.rgb)) for r in media.tensors(stored.where("doc_id < 6")).collect()}
    assert shapes[5] == (8, 8, 192) and shapes[1] == (8, 8, 192)


def test_stored_files_have_colour(spark):
    """Files were grey, so that no chroma was stored, decoded or brought to full resolution; the features are the tensor's."""
    texts = ["a", "x" * 64, "y" * 65, "Some words. " * 40, "z\x00é" * 3000, "w" * 1_700_000]
    stored = media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in media.read_back(stored).collect()}
    for i, t in enumerate(texts):
        d = media.Decoder([files[i]])
        assert [(c.h, c.v) for c in d.images[0].components] == [(2, 2), (1, 1), (1, 1)]
        raw = t.encode()
        assert media.payloads(d)[0] == raw + bytes(-len(raw) % 64)
        if i == 5:
            continue
        pixels = media.rgb(d, d.images[0]).reshape(-1, 3).astype(float)
        means = [f"{c}={m:.4f}/{v:.4f}" for c, m, v in zip("rgb", pixels.mean(0), pixels.std(0))]
        assert got[i].feature == f"{d.images[0].width}x{d.images[0].height} {' '.join(means)}"
    chroma = media.rgb(d := media.Decoder([files[3]]), d.images[0]).astype(int)
    assert np.ptp(chroma, axis=2).max() > 0
