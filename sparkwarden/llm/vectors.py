"""Vectors that can take part in a comparison, as packed binary rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, vector binary of doubles), one row per id.

    Left out: null ids, and vectors that are null, empty, zero, or hold null or non-finite components. Of rows with the
    same id the smallest vector takes part.
    """
    v = embeddings[vector].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.where(embeddings[key].isNotNull() & fine).groupBy(embeddings[key].cast("long").alias("vec_id"))
    rows = rows.agg(F.min(v).alias("v"))

    def pack(batches):
        for b in batches:
            column = b.column(1)
            bounds = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            vectors = [flat[s:e].tobytes() for s, e in zip(bounds, bounds[1:])]
            dims = pa.array(np.diff(bounds).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), dims, pa.array(vectors, pa.binary())], ["vec_id", "dim", "vector"])

    return rows.mapInArrow(pack, "vec_id long, dim int, vector binary")
