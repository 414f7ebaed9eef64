"""Integer vectors from a column of float vectors, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(vector: Column) -> Column:
    """Not null, not empty, and no entry null, NaN or infinite."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def scaled(vector: Column, scale: int, limit: int, shift: int = 0) -> Column:
    """``floor(scale * c) + shift`` of each entry c as double; the floor is held between -limit and limit."""

    def one(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(limit))), F.lit(float(limit)))) + F.lit(shift).cast("long")

    return F.transform(vector, one)


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the greater one in a tie; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return found["n"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow list column of equally long lists without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
