"""Dense-vector arithmetic on ``array<double>`` columns.

Everything here is a built-in higher-order function, so a recording is scored in the
row it already sits in: no explode, no regrouping, no shuffle. Vectors are stored as
``array<float>`` and always computed in double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below STD_FLOOR a profile dimension counts as constant, below NORM_FLOOR
# a signal-feature vector counts as zero.
STD_FLOOR = 1e-10
NORM_FLOOR = 1e-10
UNIT_EPS = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column expression used inside a lambda would be computed again for every element;
    bound to a lambda variable it is not. For array results that may feed a Python UDF use
    ``scaled_down``: Spark cannot hand nested lambdas to Python.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled_down(v: Column, divisor: Column) -> Column:
    """Every element divided by ``divisor``, which is computed once per row."""
    return F.zip_with(v, F.array_repeat(divisor, F.size(v)), lambda x, d: x / d)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def sum_abs(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x))


def norm(v: Column) -> Column:
    return F.sqrt(sum_squares(v))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def euclidean(a: Column, b: Column) -> Column:
    return norm(difference(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return sum_abs(difference(a, b))


def cosine(a: Column, b: Column, floor: float = NORM_FLOOR) -> Column:
    """Cosine similarity, 0.0 when either norm is zero or below ``floor``."""

    def ratio(s: Column) -> Column:
        na, nb = s["a"], s["b"]
        degenerate = (na < floor) | (nb < floor) | (na == 0) | (nb == 0)
        return F.when(degenerate, F.lit(0.0)).otherwise(s["ab"] / (na * nb))

    return let(F.struct(norm(a).alias("a"), norm(b).alias("b"), dot(a, b).alias("ab")), ratio)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std, with constant profile dimensions forced to zero deviation."""
    return F.zip_with(
        difference(v, mean), std, lambda d, s: F.when(s < STD_FLOOR, F.lit(0.0)).otherwise(d / s)
    )


def zscore_unit_fallback(v: Column, mean: Column, std: Column) -> Column:
    """The evaluation variant: only an exactly zero std is special, and it divides by one."""
    return F.zip_with(
        difference(v, mean), std, lambda d, s: d / F.when(s == 0, F.lit(1.0)).otherwise(s)
    )


def cosine_to_ones(z: Column) -> Column:
    """Cosine between ``z`` and the all-ones direction, 0.0 for a zero vector."""
    sums = F.struct(norm(z).alias("n"), total(z).alias("t"), F.sqrt(F.size(z).cast("double")).alias("w"))
    return let(sums, lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["t"] / (s["n"] * s["w"])))


def unit(v: Column, eps: float = UNIT_EPS) -> Column:
    return scaled_down(v, F.greatest(norm(v), F.lit(eps)))


def has_null(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull())


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def has_inf(v: Column) -> Column:
    return F.exists(v, lambda x: F.abs(x) == F.lit(float("inf")))
