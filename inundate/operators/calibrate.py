"""Reconstruction at the anchor stage, its quality, volume checks and runoff coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curve import SLACK
from ..functions.nulls import complete, depth_over, ratio, ratio_above, yes
from .curves import volume_at_stage
from .zonal import inside, spread

THRESHOLDS = (0.15, 0.3, 0.5, 1.0)
CSI_GATE, CSI_AT = 0.8, 0.3
VOLUME_TOLERANCE = 0.05
ALPHA_RANGE = (0.05, 0.4)


def csi_name(t: float) -> str:
    return f"csi_{t:g}" if t != 1.0 else "csi_1.0"


def reconstruct_depth(cells: DataFrame, stages: DataFrame, zone: str = "catchment_id", datum: str = "hand", name: str = "recon") -> DataFrame:
    """Depth of a flat water surface at each zone's stage h100."""
    return spread(cells, stages.select(zone, F.col("h100").alias("_h")), zone).withColumn(name, depth_over(F.col("_h"), F.col(datum))).drop("_h")


def success_index(observed: Column, rebuilt: Column) -> Column:
    """hits / (hits + misses + false alarms) as an aggregate; unknown counts as dry; NULL without any."""
    o, r = yes(observed), yes(rebuilt)
    return ratio(F.count_if(o & r), F.count_if(o | r))


def reconstruction_quality(rebuilt: DataFrame, stages: DataFrame, zone: str = "catchment_id", depth: str = "d100", recon: str = "recon", thresholds=THRESHOLDS) -> DataFrame:
    """One row for each zone with a stage: CSI by threshold, RMSE over cells wet in either, wet-area ratio, the stage and the low-CSI flag."""
    o, r = F.col(depth), F.col(recon)
    wet_o, wet_r = yes(o > 0), yes(r > 0)
    either = wet_o | wet_r
    squares = F.when(either, (o - r) * (o - r))
    unknown = F.count_if(either & (o.isNull() | r.isNull()))
    rows = inside(rebuilt, zone).join(stages.select(zone), zone, "left_semi")
    out = rows.groupBy(zone).agg(
        *(success_index(o > t, r > t).alias(csi_name(t)) for t in thresholds),
        F.when(unknown == 0, F.sqrt(F.avg(squares))).alias("rmse"),
        ratio(F.count_if(wet_r), F.count_if(wet_o)).alias("area_ratio"),
    )
    return out.join(stages, zone, "left").withColumn("flag_low_csi", yes(F.col(f"`{csi_name(CSI_AT)}`") < CSI_GATE))


def cross_check_volume(cells: DataFrame, stages: DataFrame, indexed: DataFrame, zone: str = "catchment_id", depth: str = "d100", cell_area: float = 1.0, tolerance: float = VOLUME_TOLERANCE) -> DataFrame:
    """Observed volume of each zone against its curve's volume at h100."""
    direct = inside(cells, zone).groupBy(zone).agg((complete(F.sum(depth), F.col(depth)) * cell_area).alias("v_direct"))
    both = volume_at_stage(stages.select(zone, "h100").join(direct, zone, "left"), indexed, zone, "h100", "v_curve")
    off = ratio_above(F.abs(F.col("v_curve") - F.col("v_direct")), F.col("v_direct"))
    return both.withColumn("rel_diff", off).withColumn("flag_volume_mismatch", yes(F.col("rel_diff") > tolerance)).drop("h100")


def calibrate_alpha(cells: DataFrame, rain: DataFrame, areas: DataFrame, zone: str = "catchment_id", depth: str = "d100", cell_area: float = 1.0, bounds=ALPHA_RANGE) -> DataFrame:
    """Runoff coefficient: observed volume over rain volume, with a flag (both bounds are in range; unknown is not)."""
    observed = inside(cells, zone).groupBy(zone).agg((complete(F.sum(depth), F.col(depth)) * cell_area).alias("v_obs"))
    return alpha_from_sums(observed.join(rain, zone, "left").join(areas, zone, "left"), zone, bounds)


def zone_sums(cells: DataFrame, zone: str = "catchment_id", depth: str = "d100", rain: str = "rain_p100", scenario: str = "rain_pp", cell_area: float = 1.0) -> DataFrame:
    """(zone, v_obs, p100, p_prime, area): all that coefficients and scenario volumes need, in one pass over the cells."""
    return inside(cells, zone).groupBy(zone).agg(
        (complete(F.sum(depth), F.col(depth)) * cell_area).alias("v_obs"), F.avg(rain).alias("p100"), F.avg(scenario).alias("p_prime"),
        (F.count("*") * F.lit(float(cell_area))).alias("area"),
    )


def within(value: Column, low: float, high: float) -> Column:
    """Whether a ratio of sums lies in a range, ends included; one that equals an end but for the order of its sums does."""
    return value.between(low - abs(low) * SLACK, high + abs(high) * SLACK)


def alpha_from_sums(sums: DataFrame, zone: str = "catchment_id", bounds=ALPHA_RANGE) -> DataFrame:
    """The same as ``calibrate_alpha`` from ``zone_sums``."""
    both = sums.withColumn("v_rain", F.col("p100") * F.col("area")).withColumn("alpha", ratio_above(F.col("v_obs"), F.col("v_rain")))
    return both.select(zone, "v_obs", "v_rain", "alpha", (~yes(within(F.col("alpha"), *bounds))).alias("flag_alpha_out_of_range"))


def calibration_table(quality: DataFrame, alpha: DataFrame, zone: str = "catchment_id") -> DataFrame:
    """Every zone of either table."""
    return alpha.join(quality, zone, "full_outer")
