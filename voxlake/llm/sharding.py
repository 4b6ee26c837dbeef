"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows lie in blocks. How many rows of block p go to shard s is drawn first, for the whole matrix at once: row p is a
multivariate hypergeometric draw from the room that is left in the shards, so that all sums come out exact. Each block is
then permuted by itself and cut along its row of the matrix, the pieces are exchanged, and each shard is permuted again.
Only block counts and the matrix pass the driver, never rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

LARGEST = 1_000_000_000  # what numpy's draws take


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement from good + bad are good.

    Beyond numpy's range the draw inverts the distribution from its mode outwards, about one standard deviation's steps, in
    doubles: its law is then exact to their rounding, and a draw that rounding leaves open is the mode.
    """
    if good + bad < LARGEST:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good + bad else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    u = rng.random()
    a = b = mode
    pa = pb = p
    u -= p
    while u > 0 and (a > low or b < high):
        if b < high:
            pb *= (good - b) / (b + 1) * (draws - b) / (bad - draws + b + 1)
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > low:
            pa *= a / (good - a + 1) * (bad - draws + a) / (draws - a + 1)
            a -= 1
            u -= pa
            if u <= 0:
                return a
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """(blocks, shards) counts with the given sums over rows and columns, in the law of a uniform permutation."""
    assert sum(blocks) == sum(shards)
    rng = np.random.default_rng(seed)
    room = [int(s) for s in shards]
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for p, n in enumerate(blocks):
        left, rest = int(n), sum(room)
        for s, r in enumerate(room):
            rest -= r
            k = hypergeometric(rng, r, rest, left)
            out[p, s] = k
            left -= k
            room[s] -= k
    return out


def shuffle_rows(df: DataFrame, key: str = "doc_id", shards: int = 40, seed: int = 2024, rows_per_block: int = 20_000, most_blocks: int = 4096) -> DataFrame:
    """df with columns _shard (0 to shards - 1, sizes at most one apart) and _slot (gapless from 0 in each shard).

    All columns of df stay, whatever their names; where it has a _shard or _slot of its own, the new one gets as many more
    underscores in front as tell them apart. Every assignment of rows to (shard, slot) is equally likely, as far as hashes of
    key and seed act as random. Blocks are hashes of key, so that a repeated task puts its rows where they were; rows that
    share a key, or have a null key, are told apart by a hash of all columns, and equal rows are interchangeable. Rows of one
    key in plenty make one large block, which is sorted with spilling, never collected. The matrix has at most most_blocks
    rows, which bounds what is broadcast to most_blocks * shards counts. An empty table gives an empty table.
    """
    spark = df.sparkSession
    content = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")], F.lit(seed))
    total = df.count()
    names = ["_shard", "_slot"]
    for k, name in enumerate(names):
        while name in df.columns:
            name = f"_{name}"
        names[k] = name
    n_blocks = max(1, min(most_blocks, -(-total // rows_per_block)))
    # Rows of one key are spread over blocks by their content, so that a key with many rows does not make one block.
    placed = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), content.alias("_r")).withColumn("_block", F.pmod(F.xxhash64("_r", F.lit("block")), F.lit(n_blocks)).cast("int"))
    have = {r._block: r["count"] for r in placed.groupBy("_block").count().collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([have.get(p, 0) for p in range(n_blocks)], sizes, seed)
    bounds = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)], "_block int, _bounds array<long>")
    order = Window.partitionBy("_block").orderBy(F.xxhash64("_r", F.lit("first")), "_r", "_key")
    cut = (
        placed.withColumn("_rank", F.row_number().over(order) - 1)
        .join(F.broadcast(bounds), "_block")
        .withColumn("_shard", F.aggregate("_bounds", F.lit(0), lambda n, b: n + F.when(b <= F.col("_rank"), 1).otherwise(0)))
        .drop("_bounds", "_rank")
    )
    # The second permutation: a random lane of the shard, then a random order in the lane; slots follow from lane sizes.
    lanes = max(1, -(-total // (shards * rows_per_block)))
    cut = durable(cut.withColumn("_lane", F.pmod(F.xxhash64("_r", F.lit("lane"), F.col("_block")), F.lit(lanes)).cast("int")))
    counts = cut.groupBy("_shard", "_lane").count()
    before = Window.partitionBy("_shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    second = Window.partitionBy("_shard", "_lane").orderBy(F.xxhash64("_r", F.lit("second")), "_r", "_key", "_block")
    slotted = cut.withColumn("_n", F.row_number().over(second) - 1)
    placed = slotted.join(starts, ["_shard", "_lane"])
    return placed.select("_row.*", F.col("_shard").cast("int").alias(names[0]), (F.col("_start") + F.col("_n")).cast("long").alias(names[1]))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Law rows: shard sizes at most one apart. size is the UTF-8 bytes of the text (null: none) plus 16."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_rows(durable(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
