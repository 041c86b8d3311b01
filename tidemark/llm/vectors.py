"""What the two vector operators share: validity, and arrays of arrays in numpy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(column, dtype: str = "f8"):
    """A list column whose lists have one length, as rows of a matrix."""
    import numpy as np

    values = np.asarray(column.flatten()).astype(dtype, copy=False)
    return values.reshape(len(column), -1) if len(column) and len(values) else values.reshape(len(column), 0)
