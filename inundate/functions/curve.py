"""Monotone look-up in a zone's curve, held as an array of (h, volume) points ordered by h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What the order of a sum may move it by, as a part of it.
SLACK = 1e-12


def _look_up(points: Column, x: Column, given: str, wanted: str, slack: float = 0.0) -> Column:
    """Linear interpolation of ``wanted`` at ``given`` = x, clamped at both ends.

    Where several points share the value, the last of them counts, so a search on a
    plateau gives its upper end.  A point at x but for a part ``slack`` of it is at x.
    """
    n = F.size(points)
    lo = F.size(F.filter(points, lambda p: p[given] <= x + F.abs(x) * slack))

    def at(i: Column, field: str) -> Column:
        return F.get(points, i)[field]

    a, b = at(lo - 1, given), at(lo, given)
    low, high = at(lo - 1, wanted), at(lo, wanted)
    between = low + (x - a) * F.try_divide(high - low, b - a)
    return F.when(points.isNull() | x.isNull() | (n == 0), None).when(lo == 0, at(F.lit(0), wanted)).when((lo == n) | (a >= x - F.abs(x) * slack), low).otherwise(between)


def stage_for(points: Column, volume: Column) -> Column:
    return _look_up(points, volume, "volume", "h", SLACK)


def volume_for(points: Column, stage: Column) -> Column:
    return _look_up(points, stage, "h", "volume")


def outside(points: Column, volume: Column) -> Column:
    """Whether a volume lies off the curve's ends (the ends themselves, but for the order of their sums, are on it)."""
    room = F.abs(volume) * SLACK
    return F.coalesce((volume + room < F.get(points, F.lit(0))["volume"]) | (volume - room > F.element_at(points, -1)["volume"]), F.lit(False))
