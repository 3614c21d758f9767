"""Vector arithmetic in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one width; null for a null, a zero vector or different widths."""
    x, y = as_double(a), as_double(b)
    return F.when(F.size(x) == F.size(y), dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0)))


def cosine_to(v: Column, vector: Sequence[float]) -> Column:
    """Cosine of a column to one vector: a matrix product for each Arrow batch. Null where ``cosine`` is null."""
    q = np.asarray(vector, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        fit = np.flatnonzero(s.map(lambda x: x is not None and len(x) == len(q)).to_numpy(bool))
        if len(fit):
            x = np.stack(s.iloc[fit].to_numpy()).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            out[fit] = np.where(n > 0, (x @ q) / np.where(n > 0, n, 1.0), np.nan)
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return run(v)


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def usable(v: Column, width: int) -> Column:
    """Whether a vector has ``width`` finite numbers, not all zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) == width) & ~odd & F.exists(v, lambda x: x != 0)
