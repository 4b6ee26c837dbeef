"""Toxicity by a second-order factorization machine over hashed terms (Rendle, 2010).

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if z_i)^2 - sum_i (v_if z_i)^2)), where a term that is present
has x = how well it tells the labels apart in the training rows (its squared smoothed log-odds times its rows), and
z = 1 / sqrt(number of terms): the pair weights <v_i, v_j> catch terms that are toxic only together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import held_out_remainder, labelled_sample, packed, row_sums, terms
from .text import pieces, release, utf8

PREFIXES = (5, 7)


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # (terms, rank)
    scale: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        many = np.bincount(row, minlength=rows)
        z = 1 / np.sqrt(np.maximum(many, 1))
        out = self.bias + row_sums(self.linear[term] * self.scale[term], row, rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            s, q = row_sums(v, row, rows), row_sums(v * v, row, rows)
            out += 0.5 * (s * s - q) * z * z
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(
    grade: np.ndarray, weight: np.ndarray, start: np.ndarray, term: np.ndarray, bits: int,
    rank: int = 4, epochs: int = 12, batch: int = 64, rate: float = 0.3, decay: float = 1e-4, seed: int = 7,
) -> FactorizationMachine:
    """Weighted logistic loss by AdaGrad in small batches; without rows every score is the prior 0."""
    rng = np.random.default_rng(seed)
    size = 1 << bits
    model = FactorizationMachine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)), np.ones(size))
    n = len(grade)
    if not n:
        return FactorizationMachine(-20.0, model.linear, model.factors * 0, model.scale)
    rate0 = np.clip((weight * grade).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model.bias = float(np.log(rate0 / (1 - rate0)))
    g_bias, g_linear, g_factors = 1e-2, np.full(size, 1e-4), np.full((size, rank), 1e-3)
    seen = np.bincount(term, minlength=size)
    bad = np.bincount(term, np.repeat(grade, np.diff(start)), size)
    odds = np.log((bad + 1) / (grade.sum() + 2)) - np.log((seen - bad + 1) / (n - grade.sum() + 2))
    model.scale = np.clip(odds**2 * np.minimum(seen, 64) / 64, 0.002, 2)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            many = start[rows + 1] - start[rows]
            row = np.repeat(np.arange(len(rows)), many)
            t = term[np.repeat(start[rows] - (np.cumsum(many) - many), many) + np.arange(len(row))]
            err = weight[rows] * (sigmoid(model.logits(row, t, len(rows))) - grade[rows])
            distinct, place = np.unique(t, return_inverse=True)
            g = float(err.sum()) / len(rows)
            g_bias += g * g
            model.bias -= rate * g / np.sqrt(g_bias)
            g = np.bincount(place, err[row] * model.scale[t], len(distinct)) / len(rows) + decay * model.linear[distinct]
            g_linear[distinct] += g * g
            model.linear[distinct] -= rate * g / np.sqrt(g_linear[distinct])
            z2 = 1 / np.maximum(many, 1)
            for f in range(rank):
                v = model.factors[t, f]
                s = row_sums(v, row, len(rows))
                g = np.bincount(place, (err * z2)[row] * (s[row] - v), len(distinct)) / len(rows) + decay * model.factors[distinct, f]
                g_factors[distinct, f] += g * g
                model.factors[distinct, f] -= rate * g / np.sqrt(g_factors[distinct, f])
    model.factors[seen == 0] = 0  # terms that no labelled row has say nothing
    return model


def learn(docs: DataFrame, labels: DataFrame, bits: int = 17, rows: int = 8000, cells: int = 4_000_000) -> FactorizationMachine:
    """A model from labels(doc_id, toxic) of rows whose crc32(doc_id as text) mod 5 is not 0.

    rows, cells: bounds of the labelled sample (features.labelled_sample). A document with several labels takes the
    largest; null labels and null ids teach nothing.
    """
    grades = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(held_out_remainder() != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("grade"))
    )
    grade, weight, start, term, _ = packed(labelled_sample(docs, grades, bits, rows, cells, prefixes=PREFIXES))
    model = fit(np.minimum(grade, 1), weight, start, term, bits)
    del grade, weight, start, term
    release()
    return model


def score(docs: DataFrame, model: FactorizationMachine, bits: int = 17) -> DataFrame:
    """(doc_id, score) of every row: the whole text's probability of being toxic. Null and empty texts get the score of
    a text without terms. One pass over the rows without a shuffle; the model's size is fixed by bits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, term, _ = terms(*utf8(batch.column(1)), bits, prefixes=PREFIXES)
            out = sigmoid(shared.value.logits(row, term, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; labels, languages, sources and ids are no inputs of a
    score. Repeated rows get equal scores; extra columns are ignored; an empty table gives an empty one."""
    return score(docs, learn(docs, labels)).select(
        "doc_id", (held_out_remainder() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores limit or more; all columns stay. Rows are judged by their text alone, so
    rows that share a doc_id are judged one by one."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = [f.name for f in docs.schema].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, term, _ = terms(*utf8(batch.column(text)), 17, prefixes=PREFIXES)
            yield batch.filter(pa.array(sigmoid(shared.value.logits(row, term, batch.num_rows)) < limit))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
