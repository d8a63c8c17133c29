"""Fluvial or pluvial, and where a scenario is least certain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ratio, yes

FLUVIAL, PLUVIAL = 0, 1
HAND_BELOW, FLOW_FROM = 3.0, 500
LOG_RATIO, STEEP, SHORT_PERIOD = math.log(2), 0.15, 10


def classify(hand: Column, flow_acc: Column, hand_below: float = HAND_BELOW, flow_from: float = FLOW_FROM) -> Column:
    """0 near a channel or on a large flow path, else 1; unknown inputs don't make a cell fluvial."""
    return F.when(yes(hand < hand_below) | yes(flow_acc >= flow_from), FLUVIAL).otherwise(PLUVIAL).cast("tinyint")


def low_confidence(
    log_ratio: Column, slope: Column | None = None, urban: Column | None = None, period: float | None = None, coastal: Column | None = None,
    log_limit: float = LOG_RATIO, steep: float = STEEP, short: float = SHORT_PERIOD,
) -> Column:
    """Any of: rain far from the anchor's, steep, built-up, a short return period, coastal."""
    flag = yes(F.abs(log_ratio) > log_limit)
    if slope is not None:
        flag = flag | yes(slope > steep)
    if urban is not None:
        flag = flag | yes(urban)
    if period is not None:
        flag = flag | F.lit(period < short)
    return flag if coastal is None else flag | yes(coastal)


def departs(rain: Column, anchor_rain: Column, limit: float = LOG_RATIO) -> Column:
    """Whether scenario rain is off the anchor's by more than a factor of two; no rain at all is, unknown or negative rain is not."""
    q = ratio(rain, anchor_rain)
    return yes(F.when(anchor_rain > 0, F.when(rain == 0, True).when(rain > 0, F.abs(F.ln(q)) > limit).otherwise(False)))


def shares(cells: DataFrame, column: str = "regime") -> DataFrame:
    from .zonal import class_shares

    return class_shares(cells, column, {FLUVIAL: "fluvial", PLUVIAL: "pluvial"})
