"""Tensor files, traces, corpora, pixmaps and the data source of whole files."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import pairtree, solve
from voxlake.operators.pairtree import COVARIANCE, LAB
from voxlake.sources import blobs, corpora, tensorfile, trace

from .test_solve import displayed, jacobi, make, oklab, tree

f4, f2 = np.float32, np.float16


def plain_tensor(fine, depth, threshold):
    """The file's bytes, bit by bit, in plain loops."""
    n, side = fine.shape[:2]

    def pooled(level):
        f, s = level.shape[0] // 2, level.shape[1] // 2
        out = np.zeros((f, s, s, 3), f4)
        for t, y, x, c in np.ndindex(f, s, s, 3):
            total = f4(0)
            for d in np.ndindex(2, 2, 2):
                total = f4(total + level[2 * t + d[0], 2 * y + d[1], 2 * x + d[2], c])
            out[t, y, x, c] = f4(total / f4(8))
        return out

    half = pooled(fine)
    root = pooled(half)
    up = lambda v: np.kron(v, np.ones((2, 2, 2, 1), f4)).astype(f4)
    r32, r64 = half - up(root), fine - up(half)
    g32, g64 = pooled(abs(r32)), pooled(pooled(abs(r64)))
    dev = (f4(8) * g32 + f4(64) * g64) / f4(72)
    sig, loud = [], []
    for t, y, x, c in np.ndindex(root.shape):
        on = threshold is None or dev[t, y, x, c] >= f4(threshold)
        sig.append(on)
        if on:
            for g in (g32, g64):
                v = int(np.array(g[t, y, x, c], f2).view(np.uint16))
                loud += [(v >> (15 - k)) & 1 for k in range(16)]
            loud += [r32[2 * t + d[0], 2 * y + d[1], 2 * x + d[2], c] >= 0 for d in np.ndindex(2, 2, 2)]
            loud += [r64[4 * t + d[0], 4 * y + d[1], 4 * x + d[2], c] >= 0 for d in np.ndindex(4, 4, 4)]
    packed = b"".join(bytes(int("".join("01"[int(b)] for b in bits[k : k + 8]).ljust(8, "0"), 2) for k in range(0, len(bits), 8)) for bits in (sig, loud))
    return b"TSRTENS1" + struct.pack("<HHHH", n, side, int(threshold is None), 0) + depth.astype("<f4").tobytes() + root.astype("<f2").tobytes() + packed


@pytest.mark.parametrize("threshold", [None, 0.02, 1e9])
def test_tensor_bytes_are_the_formats(threshold):
    rng = np.random.default_rng(1)
    fine, depth = rng.normal(0.5, 0.1, (8, 8, 8, 3)).astype(f4), rng.random((8, 8, 8)).astype(f4)
    fine[:4] = fine[:4, :1, :1]  # quiet roots
    data = tensorfile.pack(fine, depth, threshold)
    assert data == plain_tensor(fine, depth, threshold)
    colours, back = tensorfile.unpack(data)
    assert np.array_equal(back, depth)
    again = tensorfile.unpack(tensorfile.pack(colours, back, threshold))[0]
    assert np.abs(colours - fine).max() < 0.5 and again.shape == fine.shape
    for bad in (b"", data[:-1], data + b"\0", b"X" + data[1:], data[:8] + struct.pack("<HHHH", 3, 8, 0, 0) + data[16:]):
        assert tensorfile.unpack(bad) is None
    assert tensorfile.pack(fine[:3], depth[:3], None) is None


def test_tensor_files_of_captures(spark):
    rng = np.random.default_rng(2)
    rows = []
    for capture in range(3):
        busy = rng.random((8, 8, 8)) < 0.3
        for t, y, x in np.ndindex(8, 8, 8):
            if capture < 2 or (t, y, x) != (7, 7, 7):
                colour = 0.5 + rng.normal(0, 0.2 if busy[t // 4 * 4, y // 4 * 4, x // 4 * 4] else 1e-4, 3)
                rows.append((capture, t, y, x, *map(float, colour), float(rng.random())))
    cells = spark.createDataFrame(rows, "capture int, t int, y int, x int, l double, a double, b double, s double")
    files = {r.capture: r for r in tensorfile.encode(cells).collect()}
    assert files[2].data is None and len(files) == 3
    for capture in range(2):
        own = np.array([r[4:] for r in rows if r[0] == capture], f4).reshape(8, 8, 8, 4)
        assert bytes(files[capture].data) == tensorfile.pack(own[..., :3], own[..., 3], files[capture].threshold)
    back = tensorfile.decode(tensorfile.encode(cells).unionByName(spark.createDataFrame([(9, None, b"TSRTENS1nothing")], "capture int, threshold float, data binary")))
    assert back.groupBy("capture").count().collect().__len__() == 2 and back.count() == 1024
    assert tensorfile.encode(cells.where("t < 0")).count() == 0


def test_files_are_written_whole_and_read_back(spark, tmp_path):
    spark.dataSource.register(blobs.Blobs)
    folder = str(tmp_path / "files")
    os.makedirs(folder)
    rows = [(f"{k}.bin", bytes([k]) * (k * 1000 + 1)) for k in range(7)]
    df = spark.createDataFrame(rows, "name string, data binary").repartition(3)
    df.write.format("blobs").mode("append").save(folder)
    read = lambda: sorted((r.name, bytes(r.data)) for r in spark.read.format("blobs").option("filesPerTask", 2).load(folder).collect())
    assert read() == rows and os.listdir(os.path.join(folder, blobs.TASKS)) == []
    df.where("name < '2'").write.format("blobs").mode("overwrite").save(folder)
    assert read() == rows[:2]
    for bad in ([("../out", b"x")], [("same", b"x"), ("same", b"y")], [(None, b"x")]):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame(bad, "name string, data binary").write.format("blobs").mode("append").save(folder)
    assert read() == rows[:2]
    assert spark.read.format("binaryFile").load(f"{folder}/*.bin").count() == 2


def plain_table(numbers, hue, version):
    cov = np.zeros((3, 3))
    cov[np.triu_indices(3)] = numbers[3:9]
    variances, dirs = jacobi(cov + np.triu(cov, 1).T)
    if version == 3:
        leaves = tree(numbers[:3], variances, dirs)[7]
    else:
        wide = [max(1e-3, v**0.5) for v in variances[:2]]
        leaves = [np.array(numbers[:3]) + 2 * k / 7 * (np.cos(a) * wide[0] * dirs[0] + np.sin(a) * wide[1] * dirs[1]) for k, n in enumerate(pairtree.LADDER) for a in (2 * np.pi * j / n for j in range(n))]
    shown = [displayed(v) for v in leaves]
    book = [oklab([c / 255 for c in v]) for v in shown]
    delta, alpha, beta, capped = (solve.PRIOR["light"] - book[0][0], solve.PRIOR["alpha"], solve.PRIOR["beta"], 1) if version == 1 else numbers[9:13]
    a, b, fitted = hue or (1, 0, 0)
    out = []
    for v in book:
        c = np.hypot(v[1], v[2])
        if fitted and version > 1:
            out.append(np.array([v[0] + delta, -v[1], -v[2]]))
            continue
        to = np.exp(alpha + beta * np.log(c)) if c > 0 else 0
        k = (min(c, to) if capped else to) / c if c > 0 else 0
        out.append(np.array([v[0] + delta, (v[1] * a - v[2] * b) * k, (v[1] * b + v[2] * a) * k]))
    return shown + [displayed(v) for v in reversed(out)]


def test_tables_come_back_from_traces_of_every_version(spark):
    rng = np.random.default_rng(3)
    spread = lambda: (m := rng.normal(0, 0.1, (3, 3))) @ m.T
    texts, want = {}, {}
    for capture, version in enumerate((1, 2, 3, 3)):
        rows, hues = [], []
        for k in range(3):
            law = [0.1, -0.9, 0.8, k % 2]
            rows.append([0.5, 0.02, -0.01, *spread()[np.triu_indices(3)], *(law if version > 1 else [])])
            hues.append((0.6, 0.8, int(capture == 3)))
        text = [f"A NOTE {capture}", f"DYAD STATS v{version} frames=3", *(" ".join(map(repr, map(float, r))) for r in rows), "DYAD GROUNDHUE v2 frames=2", *(" ".join(map(str, h)) for h in hues[:2]), "END", "0.1 0.2 0.3"]
        texts[capture] = "\n".join(text)
        want |= {(capture, k): plain_table(r, hues[k] if k < 2 and version > 1 else None, version) for k, r in enumerate(rows)}
    odd = {10: "", 11: None, 12: "DYAD STATS v3 frames=1", 13: "DYAD STATS v3 frames=1\n" + "x " * 13, 14: "no header\n" + "0.1 " * 13}
    df = spark.createDataFrame([*texts.items(), *odd.items()], "capture int, trace string")
    got = {}
    for r in trace.tables(trace.parse(df)).collect():
        got.setdefault((r.capture, r.i), {})[r.idx] = (r.r8, r.g8, r.b8)
    assert set(got) == set(want)
    for k, colours in want.items():
        apart = [max(abs(a - b) for a, b in zip(colours[i], got[k][i])) for i in range(256)]
        assert max(apart) <= 1 and sum(apart) <= 3


def test_a_solves_trace_gives_its_tables(spark):
    rows = make(np.random.default_rng(6), "two", frames=4)
    done = solve.solve(spark.createDataFrame(rows, "capture int, t int, y int, x int, r double, g double, b double, s double"))
    back = trace.tables(trace.parse(trace.write(done, {"NOTE": F.col("two_phase").cast("string")})))
    got = {(r.capture * 4 + r.i, r.idx): (r.r8, r.g8, r.b8) for r in back.collect()}
    assert got == {(r.t, r.idx): (r.r8, r.g8, r.b8) for r in done.table.collect()} and len(got) == 8 * 256
    assert set(LAB) | set(COVARIANCE) <= set(trace.NUMBERS)


def test_broken_lines_are_kept_apart(spark):
    good = [("a", "S", "b", 1), ("é\n", "K", None, 2)]
    lines = corpora.to_lines(spark.createDataFrame(good, "source string, token string, target string, steps int"))
    bad = ["{", "nonsense", '{"steps": "x"}', "[1]"]
    samples, broken = corpora.from_lines(lines.unionByName(spark.createDataFrame([(b,) for b in [*bad, "", "  "]], "value string")), corpora.PAIR)
    assert sorted(map(tuple, samples.collect())) == good and sorted(r.value for r in broken.collect()) == sorted(bad)


def test_pixmaps(spark):
    rng = np.random.default_rng(4)
    pixels = {0: rng.integers(0, 256, (3, 5, 3)), 1: rng.integers(0, 256, (1, 1, 3))}
    rows = [(k, y, x, *map(int, p[y, x])) for k, p in pixels.items() for y in range(p.shape[0]) for x in range(p.shape[1])] + [(2, 1, 1, 0, 0, 0)]
    cells = spark.createDataFrame(rows, "k int, y int, x int, r8 int, g8 int, b8 int")
    files = corpora.encode_ppm(cells, ["k"])
    assert {r.k: r.data is None for r in files.collect()} == {0: False, 1: False, 2: True}
    assert sorted(map(tuple, corpora.decode_ppm(files, ["k"]).collect())) == sorted(rows[:-1])
    assert corpora.from_ppm(b"P6 # a note\n 2\n1 # and\n255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    for bad in (b"", b"P5 1 1 255 abc", b"P6 1 1 255\nab", b"P6 1 1 65535\nabcdef"):
        assert corpora.from_ppm(bad) is None
