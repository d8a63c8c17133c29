"""Scenario depth: curve inversion by zone, ratio methods and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import depth_over, finite, ratio, yes
from . import regime
from .curves import invert_stage
from .zonal import spread


def zone_stage(alpha: DataFrame, rain: DataFrame, areas: DataFrame, indexed: DataFrame, zone: str = "catchment_id", strict: bool = False) -> DataFrame:
    """(zone, volume, stage, extrapolated): the stage that the scenario's runoff volume fills each zone to.

    A zone without a finite coefficient, rain or area has no volume and no stage.
    """
    z = indexed.select(zone).join(alpha.select(zone, finite(F.col("alpha")).alias("_a")), zone, "full_outer")
    z = z.join(rain.select(zone, finite(F.col("p_prime")).alias("_p")), zone, "left").join(areas.select(zone, finite(F.col("area")).alias("_s")), zone, "left")
    return invert_stage(z.select(zone, (F.col("_a") * F.col("_p") * F.col("_s")).alias("volume")), indexed, zone, "volume", strict)


def render_depth(cells: DataFrame, stages: DataFrame, zone: str = "catchment_id", datum: str = "hand", depth: str = "depth", extrapolated: str = "extrapolated") -> DataFrame:
    """Depth over the datum at each zone's stage; fluvial with (catchment, HAND), pluvial with (depression, height above its floor)."""
    both = spread(cells, stages.select(zone, F.col("stage").alias("_stage"), F.col("extrapolated").alias("_beyond")), zone)
    return both.withColumns({depth: depth_over(F.col("_stage"), F.col(datum)), extrapolated: yes(F.col("_beyond"))}).drop("_stage", "_beyond")


def naive_ratio(depth: Column, rain_anchor: Column, rain: Column) -> Column:
    """Depth scaled by the rain ratio; dry (or unknown) stays 0, wet without anchor rain is unknown."""
    return F.when(depth > 0, F.when(rain_anchor > 0, ratio(depth, rain_anchor) * rain)).otherwise(0.0)


def channel_ratio_depth(cells: DataFrame, ratios: DataFrame, zone: str = "catchment_id", depth: str = "d100", rain: str = "rain_pp", name: str = "depth") -> DataFrame:
    """Depth as a zone's ratio times rain on the anchor's wet cells; 0 elsewhere; wet without a ratio is unknown."""
    both = spread(cells, ratios.select(zone, F.col("k").alias("_k")), zone)
    return both.withColumn(name, F.when(F.col(depth) > 0, F.col("_k") * F.col(rain)).otherwise(0.0)).drop("_k")


def in_depression(depression: Column, inside: Column, channel: Column) -> Column:
    """The depression's value wherever there is a depression, even an unknown one; else the channel's."""
    return F.when(depression > 0, inside).otherwise(channel)


def combine(cells: DataFrame, split: str = "depression", depression: str = "depression_id") -> DataFrame:
    """Depth and flag from both renderings (fluvial_*, pluvial_*).

    ``split="depression"``: the depression's wherever there is one.  ``split="regime"``:
    fluvial cells take the fluvial depth, pluvial cells the pluvial one (unknown where
    there is no depression).
    """
    if split == "depression":
        pick = lambda p, f: in_depression(F.col(depression), F.col(p), F.col(f))
    elif split == "regime":
        pick = lambda p, f: F.when(F.col("regime") == regime.FLUVIAL, F.col(f)).otherwise(F.col(p))
    else:
        raise ValueError(f"unknown split {split!r}")
    return cells.withColumns({"depth": pick("pluvial_depth", "fluvial_depth"), "extrapolated": yes(pick("pluvial_extrapolated", "fluvial_extrapolated"))})


def pipeline_confidence(cells: DataFrame, quality: DataFrame, zone: str = "catchment_id", rain: str = "rain_pp", anchor_rain: str = "rain_p100") -> DataFrame:
    """low_confidence: a zone that reconstructs badly, rain far from the anchor's, or a stage off the curve."""
    flagged = spread(cells, quality.select(zone, F.col("flag_low_csi").alias("_low")), zone)
    return flagged.withColumn("low_confidence", yes(F.col("_low")) | regime.departs(F.col(rain), F.col(anchor_rain)) | yes(F.col("extrapolated"))).drop("_low")
