"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm import bpe, decontaminate, similar, suffix_array, toxicity
from voxlake.llm.durable import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is more likely toxic than not go; the model learns from sf_dir's labels."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts linked by 5-word Jaccard 0.8 or more stays."""
    return similar.drop_similar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more that occur earlier are cut from the texts."""
    return suffix_array.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of sf_dir's benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns, with the text's token ids (tokens), their number and the text that they decode to (decoded)."""
    return bpe.checked(docs, bpe.tokenizer(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", near_dedup),
    ("suffix_array_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("byte_bpe", tokenize),
]

#: Rows go to Python tasks in batches of so many bytes, so that neither side holds thousands of long texts at once.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Trained weights, sorted suffixes and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what a stage keeps is written to the shared folder before the next."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = f"{base}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)
    return docs
