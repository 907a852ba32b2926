"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x), within LIMIT either way, so that squares of distances and products fit into 64 bits.
SCALE, LIMIT = 256, 1 << 26


def whole_numbers(rows: DataFrame, vector: str, out: str = "x") -> DataFrame:
    """rows with out, the vector as whole numbers; rows whose vector is null or holds null or non-finite components are left out."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return rows.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).withColumn(out, F.transform(vector, whole))


def even_width(rows: DataFrame, column: str = "x", parts: int = 1) -> tuple[DataFrame, int]:
    """rows with all vectors filled up with zeros to the longest, and to a multiple of parts; that width, which is parts for none at all."""
    short, most = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    width = max(1, -(-(most or 0) // parts)) * parts
    if short is not None and short < width:
        rows = rows.withColumn(column, F.concat(column, F.array_repeat(F.lit(0), F.lit(width) - F.size(column))))
    return rows, width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of one width as 64-bit rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
