"""Vector expressions: cosine distance, norms and a fixed-dimension check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product of two numeric arrays, in double."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - a·b / (|a| |b|), computed in double."""
    return F.lit(1.0) - dot(a, b) / (l2_norm(a) * l2_norm(b))


def check_vectors(df: DataFrame, col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejected) by the fixed vector dimension.

    Rejected rows carry an ``error`` column."""
    ok = F.col(col).isNotNull() & (F.size(col) == dim) & ~F.exists(col, lambda x: x.isNull())
    valid = df.filter(ok)
    rejected = df.filter(~ok | ok.isNull()).withColumn(
        "error", F.concat(F.lit(f"expected {dim} dimensions, got "),
                          F.coalesce(F.size(col).cast("string"), F.lit("null"))))
    return valid, rejected
