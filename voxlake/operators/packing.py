"""Short rows of one key as arrays in one row: they lie on disk and travel without their keys, and what is known of a key is
joined to one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def packed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, every other column as an array): the rows of each key; order is that of by whose values part keys, the others
    follow from it. Rows of a batch are packed where they lie, so that parts of keys are dealt, not rows."""
    names = [c for c in rows.columns if c not in by]
    rows = rows.select(*by, *names)
    parts = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(by.index(order)).to_numpy()
            at = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[at], prepend=key[at[0]] - 1)) if len(at) else at
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            keys, own = pa.array(at[first]), pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(keys) for k in range(len(by))], *[pa.ListArray.from_arrays(ends, batch.column(len(by) + k).take(own)) for k in range(len(names))]], parts.names)

    merged = rows.mapInArrow(run, parts).groupBy(*by).agg(F.collect_list(F.struct(*names)).alias("_parts"))
    return merged.select(*by, *[F.flatten(F.col("_parts").getField(c)).alias(c) for c in names])
