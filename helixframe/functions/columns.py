"""Small numeric expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logsumexp(values: Column) -> Column:
    """Of an array, steady for large values; null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def _printed(x: Column, form: str) -> Column:
    """Doubles by a C format: the exact binary value is rounded, ties to the even digit, where Java's formatter rounds the shortest decimal half up."""

    @arrow_udf(T.StringType())
    def printed(v: pa.Array) -> pa.Array:
        return pa.array([None if a is None else form % a for a in v.to_pylist()], pa.string())

    return printed(x.cast("double"))


def fixed(x: Column, decimals: int = 2) -> Column:
    return _printed(x, f"%.{decimals}f")


def scientific(x: Column, decimals: int = 3) -> Column:
    return _printed(x, f"%.{decimals}e")
