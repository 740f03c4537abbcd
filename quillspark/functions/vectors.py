"""Vector expressions over arrays of numbers, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import col

#: Least norm a vector is divided by.
FLOOR = 1e-12


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: str | Column) -> Column:
    """Divide by the Euclidean norm."""
    a = col(a)
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(FLOOR))
    return F.transform(a, lambda x: x.cast("double") / norm)
