"""Quality by ordinal cumulative-link regression (McCullagh, 1980) on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k): one weight vector over hashed terms shared by all grades, and ordered thresholds
t_1 < t_2 < ..., kept in order by learning the logarithms of their gaps. The expected grade is the sum of these tails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import held_out_remainder, labelled_sample, packed, row_sums, terms
from .text import pieces, utf8
from .toxicity import sigmoid

BITS = 17


@dataclass
class CumulativeLink:
    weights: np.ndarray
    first: float
    gaps: np.ndarray  # logarithms of the gaps between thresholds

    def thresholds(self) -> np.ndarray:
        return self.first + np.append(0, np.cumsum(np.exp(self.gaps)))

    def tails(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        """(rows, grades - 1): probability of grade 1 and more, of 2 and more, and so on."""
        return sigmoid(row_sums(self.weights[term] * x, row, rows)[:, None] - self.thresholds()[None, :])


def inputs(row: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """log(1 + count), scaled to length 2 in each row."""
    x = np.log1p(count)
    return 2 * x / np.sqrt(np.maximum(row_sums(x * x, row, rows), 1e-12))[row]


def fit(
    grade: np.ndarray, weight: np.ndarray, start: np.ndarray, term: np.ndarray, count: np.ndarray,
    grades: int = 3, epochs: int = 25, batch: int = 32, rate: float = 0.6, decay: float = 1e-5, seed: int = 11,
) -> CumulativeLink:
    """Weighted log-likelihood of the grades by AdaGrad; without rows all grades are equally likely."""
    rng = np.random.default_rng(seed)
    cuts = grades - 1
    share = np.array([(weight * (grade >= k + 1)).sum() for k in range(cuts)]) / max(weight.sum(), 1e-12) if len(grade) else (cuts - np.arange(cuts)) / grades
    share = np.clip(share, 1e-3, 1 - 1e-3)
    t0 = -np.log(share / (1 - share))
    model = CumulativeLink(np.zeros(1 << BITS), float(t0[0]), np.log(np.maximum(np.diff(t0), 0.1)))
    g_w, g_first, g_gaps = np.full(1 << BITS, 0.1), 1.0, np.ones(cuts - 1)
    n = len(grade)
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            many = start[rows + 1] - start[rows]
            row = np.repeat(np.arange(len(rows)), many)
            at = np.repeat(start[rows] - (np.cumsum(many) - many), many) + np.arange(len(row))
            t, x = term[at], inputs(row, count[at], len(rows))
            tail = model.tails(row, t, x, len(rows))
            # With tails S_0 = 1 >= S_1 >= ... >= S_grades = 0, P(y) = S_y - S_{y+1}; dlog P / d(score) = 1 - S_y - S_{y+1}.
            s = np.column_stack([np.ones(len(rows)), tail, np.zeros(len(rows))])
            y, i = grade[rows], np.arange(len(rows))
            up, down = s[i, y], s[i, y + 1]
            p = np.maximum(up - down, 1e-9)
            g_score = -(1 - up - down) * weight[rows]
            g_cut = np.zeros((len(rows), cuts + 2))
            g_cut[i, y] += up * (1 - up) / p * weight[rows]
            g_cut[i, y + 1] -= down * (1 - down) / p * weight[rows]
            g_cut = g_cut[:, 1:-1].sum(0) / len(rows)
            distinct, place = np.unique(t, return_inverse=True)
            g = np.bincount(place, g_score[row] * x, len(distinct)) / len(rows) + decay * model.weights[distinct]
            g_w[distinct] += g * g
            model.weights[distinct] -= rate * g / np.sqrt(g_w[distinct])
            g = float(g_cut.sum())
            g_first += g * g
            model.first -= rate * g / np.sqrt(g_first)
            if cuts > 1:
                g = np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(model.gaps)
                g_gaps += g * g
                model.gaps -= rate * g / np.sqrt(g_gaps)
    return model


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) with 0 for low quality, 1 for good but toxic text, 2 for good text that is not toxic.

    Rows without an id or a quality label are left out, a missing toxic label counts as 0; a document with several
    rows takes the lowest grade.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("t"))
        .where("doc_id is not null and q is not null")
        .groupBy("doc_id")
        .agg(F.min(F.when(F.col("q") == 0, 0).when(F.col("t") == 0, 2).otherwise(1)).alias("grade"))
    )


def learn(docs: DataFrame, labels: DataFrame, rows: int = 8000, cells: int = 4_000_000) -> CumulativeLink:
    """A model of the ratings of rows that are not held out (crc32(doc_id as text) mod 5 is not 0); rows and cells bound
    the labelled sample (features.labelled_sample)."""
    grades = ratings(labels).where(held_out_remainder() != 0)
    return fit(*packed(labelled_sample(docs, grades, BITS, rows, cells, keep_marks=True)))


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, expected_grade, p_good, p_best, keep) of every row of docs(doc_id, text, ...).

    p_good and p_best are the tail probabilities of grade 1 and 2; keep is p_good >= least, so toxic but well written
    text is left to the toxicity filter. Null and empty texts are scored by the thresholds alone. One pass without a
    shuffle; repeated rows get equal scores; extra columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, term, count = terms(*utf8(batch.column(1)), BITS, True)
            tail = shared.value.tails(row, term, inputs(row, count, batch.num_rows), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tail.sum(1)), pa.array(tail[:, 0].copy()), pa.array(tail[:, -1].copy())], ["doc_id", "expected_grade", "p_good", "p_best"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_good double, p_best double")
    return scored.select("doc_id", (held_out_remainder() == 0).alias("held_out"), "expected_grade", "p_good", "p_best", (F.col("p_good") >= least).alias("keep"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
