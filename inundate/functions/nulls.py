"""Unknown cells are NULL: conversions at the sources and guarded expressions.

NaN and infinities become NULL once, where a table is read; from then on a
comparison with an unknown value is NULL and flags say what NULL means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def known(df: DataFrame) -> DataFrame:
    """Every floating-point column with NaN and infinities as NULL."""
    return df.withColumns({n: finite(F.col(n)) for n, t in df.dtypes if t in ("float", "double")})


def yes(c: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


def depth_over(stage: Column, datum: Column) -> Column:
    """Water depth above a datum, never negative; unknown stays unknown."""
    return F.when(stage.isNotNull() & datum.isNotNull(), F.greatest(stage - datum, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_above(a: Column, b: Column) -> Column:
    """a / b where b is above 0; else NULL."""
    return F.when(b > 0, ratio(a, b))


def complete(agg: Column, c: Column) -> Column:
    """An aggregate that is NULL as soon as one of its inputs is."""
    return F.when(F.count(c) == F.count(F.lit(1)), agg)
