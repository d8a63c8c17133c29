"""The basin run: calibration of depressions and catchments on a cell table, rendering and flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, curves, regime, render, zonal
from ..operators.raster import clip
from ..sources.store import checkpointed

MIN_CELLS = 100


@dataclass
class Side:
    """One zone system: its anchor stages, curves, runoff coefficients and scenario stages."""

    zone: str
    datum: str
    spread: DataFrame
    anchor: DataFrame
    curves: DataFrame
    indexed: DataFrame
    alpha: DataFrame
    areas: DataFrame
    stages: DataFrame


def side(cells: DataFrame, zone: str, datum: str, cell_area: float = 1.0, rain: str = "rain_p100", scenario: str = "rain_pp") -> Side:
    """Calibrates one zone system.  Its tables have a row or a few for each zone; anchors, curves and sums are
    checkpointed, so that what follows does not read the cells again for them."""
    spread = checkpointed(zonal.anchor_stage_spread(cells, zone, datum))
    anchor = spread.select(zone, F.col("h100").alias("stage"))
    table = checkpointed(curves.stage_curves(cells, anchor, zone, datum, cell_area))
    sums = checkpointed(calibrate.zone_sums(cells, zone, "d100", rain, scenario, cell_area))
    indexed = curves.index_curves(table, zone)
    alpha = calibrate.alpha_from_sums(sums, zone)
    stages = render.zone_stage(alpha, sums.select(zone, "p_prime"), sums.select(zone, "area"), indexed, zone)
    return Side(zone, datum, spread, anchor, table, indexed, alpha, sums.select(zone, "area"), stages)


@dataclass
class Basin:
    cells: DataFrame
    fluvial: Side
    pluvial: Side
    quality: DataFrame
    depth: DataFrame


def run_basin(
    cells: DataFrame, cell_area: float = 1.0, min_cells: int = MIN_CELLS, split: str = "depression", naive: bool = False, ring: list[tuple[float, float]] | None = None,
    confidence: dict | None = None,
) -> Basin:
    """Calibrates both zone systems at the anchor and renders the scenario.

    ``cells`` has catchment_id, depression_id, hand, dem, d100, rain_p100, rain_pp
    (and flow_acc for ``split="regime"``).  Unknown anchor depth counts as 0; unknown
    rain stays unknown.  With ``ring`` the depth is clipped to a polygon of x and y
    (flags are not).  low_confidence follows the zones' quality, the rain's departure
    and the curves' ends; with ``confidence``, the arguments of
    ``regime.low_confidence`` (log_ratio and any others), that rule instead.
    """
    ready = cells.withColumn("d100", F.coalesce("d100", F.lit(0.0)))
    ready = zonal.large_zone_elevation(ready, "depression_id", min_cells, "dem", "hd")
    pluvial = side(ready, "depression_id", "hd", cell_area)
    fluvial = side(ready, "catchment_id", "hand", cell_area)
    quality = checkpointed(calibrate.reconstruction_quality(calibrate.reconstruct_depth(ready, fluvial.spread), fluvial.spread))
    out = render.render_depth(ready, fluvial.stages, "catchment_id", "hand", "fluvial_depth", "fluvial_extrapolated")
    out = render.render_depth(out, pluvial.stages, "depression_id", "hd", "pluvial_depth", "pluvial_extrapolated")
    if split == "regime":
        out = out.withColumn("regime", regime.classify(F.col("hand"), F.col("flow_acc")))
    out = render.combine(out, split)
    if confidence is None:
        out = render.pipeline_confidence(out, quality)
    else:
        out = out.withColumn("low_confidence", regime.low_confidence(**confidence))
    if ring is not None:
        out = clip(out, ring, "depth")
    if naive:
        out = out.withColumn("naive_depth", render.naive_ratio(F.col("d100"), F.col("rain_p100"), F.col("rain_pp")))
    return Basin(ready, fluvial, pluvial, quality, out)


def run_scenario(cells: DataFrame, multipliers: DataFrame, region: str = "region_id", **more) -> Basin:
    """A basin run with scenario rain from regional multipliers."""
    from ..operators.rainfall import scale_rain

    return run_basin(scale_rain(cells.drop("rain_pp"), multipliers, region), **more)


def holdout_render(cells: DataFrame, predicted: DataFrame, rain: DataFrame, areas: DataFrame, indexed: DataFrame, zone: str = "catchment_id") -> DataFrame:
    """Depth of held-out zones alone, from predicted coefficients; other zones become background."""
    test = predicted.select(zone, F.lit(True).alias("_test"))
    only = zonal.spread(cells, test, zone).withColumn(zone, F.when(F.col("_test"), F.col(zone)).otherwise(0)).drop("_test")
    stages = render.zone_stage(predicted.select(zone, F.col("predicted").alias("alpha")), rain, areas, indexed.join(predicted.select(zone), zone, "left_semi"), zone)
    return render.render_depth(only, stages, zone)
