import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.sources import cubefile, gif
from voxlake.streaming import live


def cells(side=4, frames=3, captures=("a", "b")):
    rng = random.Random(1)
    return [(c, t, y, x, *[rng.randrange(256) / 255 for _ in range(3)], rng.random()) for c in captures for t in range(frames) for y in range(side) for x in range(side)]


def test_cube_files(spark):
    df = spark.createDataFrame(cells(), cubefile.SCHEMA)
    files = cubefile.encode(df)
    assert {len(r.data) for r in files.collect()} == {16 + 3 * 16 * 7}
    back = cubefile.decode(files)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert cubefile.encode(df.where("not (capture = 'a' and t = 1 and y = 2 and x = 0)")).where("data is null").first().capture == "a"
    data = files.first().data
    assert cubefile.unpack(bytes(data)[:-1]) is None and cubefile.unpack(b"x" + bytes(data)[1:]) is None and cubefile.unpack(b"") is None
    assert cubefile.decode(files.limit(0)).count() == 0


@pytest.mark.parametrize("pixels", [b"", b"\0", bytes(range(256)), b"\7" * 9000, bytes(np.random.default_rng(0).integers(0, 256, 20000).astype(np.uint8)), bytes(np.random.default_rng(1).integers(0, 3, 60000).astype(np.uint8))])
def test_lzw_round_trip(pixels):
    assert gif.unlzw(gif.lzw(pixels)) == pixels


def test_gif_files(spark):
    rng = np.random.default_rng(3)
    rows = [(c, t, rng.integers(0, 256, 64).astype(np.uint8).tobytes(), rng.integers(0, 256, 768).astype(np.uint8).tobytes()) for c in "ab" for t in range(3)]
    df = spark.createDataFrame([(c, t, bytearray(p), bytearray(q)) for c, t, p, q in rows[::-1]], "capture string, t int, pixels binary, palette binary")
    out = gif.encode(df, 8, comment="x" * 300)
    for r in out.collect():
        d = bytes(r.data)
        frames = [x for x in rows if x[0] == r.capture]
        assert d[:6] == b"GIF89a" and struct.unpack("<HH", d[6:10]) == (8, 8) and d[13:781] == frames[0][3] and d[-1:] == b";"
        at = 781 + 19
        assert d[at : at + 3] == b"\x21\xfe\xff"
        at += 2 + 256 + 46 + 1
        for _, _, pixels, palette in frames:
            assert d[at : at + 8] == b"\x21\xf9\x04\0\5\0\0\0" and d[at + 18 : at + 786] == palette
            end = at + 786 + len(gif.lzw(pixels))
            assert gif.unlzw(d[at + 786 : end]) == pixels
            at = end
        assert at == len(d) - 1
    assert {bytes(r.p) for r in out.select(gif.first_palette(F.col("data")).alias("p")).collect()} == {rows[0][3], rows[3][3]}
    assert gif.encode(df.where("t = 0"), 9).where("data is null").count() == 2


def drain(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_ring_on_a_stream_equals_the_batch(spark, tmp_path):
    feed = spark.createDataFrame([(c, t, y, x, float("nan") if v > 0.95 else 2 * v) for c, t, y, x, _, _, _, v in cells(8, 40)], "capture string, t int, y int, x int, s double")
    coarse = live.coarse_frames(feed)
    assert coarse.count() == 2 * 10 * 4
    frames = coarse.groupBy("capture", "coarse").agg(F.avg("s").alias("mean"), F.avg("within").alias("within")).cache()
    for k in range(10):
        frames.where(F.col("coarse") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f")
    got = {(r.capture, r.coarse): (r.frames, round(r["mean"], 9), round(r.within, 9)) for r in drain(live.ring_stream(stream, 4), "ring", spark).collect()}
    want = {(r.capture, r.coarse): (r.frames, round(r["mean"], 9), round(r.within, 9)) for r in live.ring_batch(frames, 4).collect()}
    assert got == want and len(got) == 20 and max(v[0] for v in got.values()) == 4


def test_throttle_and_latest_solve(spark, tmp_path):
    times = [0.0, 0.01, 0.05, 0.06, 0.11, 0.12, 0.2]
    spark.createDataFrame([("a", t) for t in times], "capture string, ts double").write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("capture string, ts double").parquet(f"{tmp_path}/t")
    assert sorted(r.ts for r in drain(live.throttle(stream, 0.05), "throttled", spark).collect()) == [0.0, 0.05, 0.11, 0.2]
    frames = spark.createDataFrame([("a", t) for t in times], "capture string, ts double")
    solves = spark.createDataFrame([("a", 0.05, 1), ("a", 0.115, 2), ("b", 0.0, 9)], "capture string, ts double, solve long")
    got = {r.ts: r.solve for r in live.latest_solve(frames, solves).collect()}
    assert got == {0.0: None, 0.01: None, 0.05: 1, 0.06: 1, 0.11: 1, 0.12: 2, 0.2: 2}
