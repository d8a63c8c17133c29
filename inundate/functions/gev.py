"""Generalised extreme value expressions (Hosking's L-moment estimators)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329
#: Below this |shape| the fit, and below the other the quantile, is Gumbel's.
FIT_FLAT, QUANTILE_FLAT = 1e-6, 1e-8


#: Lanczos's approximation of order 9 (fixed values).
LANCZOS_G = 7
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
]


def gamma(x: Column) -> Column:
    """The gamma function of a positive number (Spark has none), in generated code; NULL elsewhere."""

    def above_half(v: Column) -> Column:
        y = v - 1
        total = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            total = total + F.lit(c) / (y + i)
        t = y + LANCZOS_G + 0.5
        return math.sqrt(2 * math.pi) * F.pow(t, y + 0.5) * F.exp(-t) * total

    return F.when(x >= 0.5, above_half(x)).when(x > 0, F.lit(math.pi) / (F.sin(F.lit(math.pi) * x) * above_half(1 - x)))


def shape(t3: Column) -> Column:
    c = 2 / (3 + t3) - math.log(2) / math.log(3)
    return 7.8590 * c + 2.9554 * c * c


def _scale(l2: Column, k: Column, g: Column) -> Column:
    flat = F.abs(k) < FIT_FLAT
    safe = F.when(~flat, k)
    return F.when(flat, l2 / math.log(2)).otherwise(F.try_divide(l2 * safe, (1 - F.pow(F.lit(2.0), -safe)) * g))


def parameters(l1: Column, l2: Column, t3: Column) -> dict[str, Column]:
    """loc, scale and shape."""
    k = shape(t3)
    g = gamma(1 + k)
    scale = _scale(l2, k, g)
    flat = F.abs(k) < FIT_FLAT
    loc = F.when(flat, l1 - EULER * scale).otherwise(l1 - F.try_divide(scale * (1 - g), F.when(~flat, k)))
    return {"loc": loc, "scale": scale, "shape": F.when(flat, 0.0).otherwise(k)}


def quantile(loc: Column, scale: Column, k: Column, period) -> Column:
    """The return level of a period in years; NULL for a period of one year or less."""
    t = F.lit(float(period)) if not isinstance(period, Column) else period.cast("double")
    below = F.when(t > 1, 1 - F.try_divide(F.lit(1.0), t))
    y = -F.ln(below)
    flat = F.abs(k) < QUANTILE_FLAT
    return F.when(flat, loc - scale * F.ln(y)).otherwise(loc + F.try_divide(scale, F.when(~flat, k)) * (1 - F.pow(y, k)))
