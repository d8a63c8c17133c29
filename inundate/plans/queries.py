"""One query for each operator over the test tables; see ``oracles`` for the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gev
from ..functions.nulls import finite, ratio
from ..operators import calibrate, curves, raster, rainfall, regime, render, terrain, validate, zonal
from ..sources import fixtures as fx
from . import basin, study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIOD, MIN_CELLS, STREAM = 25.0, 30, 40
#: A polygon in columns and rows of the grid.
RING = [(4.5, 3.5), (33.5, 6.5), (28.5, 44.5), (17.5, 22.5), (6.5, 38.5)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (what lies half-way, but for the order of a sum, goes up), counts as BIGINT, dots in names
    replaced: the form both engines are compared in."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        name = f.name.replace(".", "_")
        c = F.round(c.cast("double") + F.lit(1e-9), digits) + F.lit(0.0) if kind in ("double", "float", "decimal") else c.cast("bigint") if kind in ("integer", "long", "byte", "short") else c
        out.append(c.alias(name))
    return df.select(*out)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def _filled(spark, sf_dir) -> DataFrame:
    return fx.cells(spark, sf_dir).withColumn("d100", F.coalesce("d100", F.lit(0.0)))


def _fluvial(cells: DataFrame) -> basin.Side:
    return basin.side(cells, "catchment_id", "hand")


def _depressions(cells: DataFrame) -> DataFrame:
    return zonal.relative_elevation(zonal.keep_large_zones(cells, "depression_id", MIN_CELLS))


def _by_zone(df: DataFrame, *zones: str, depth: str = "depth", flags: tuple[str, ...] = ()) -> DataFrame:
    """Cells have no key in these tables, so a rendering is compared by sums and counts."""
    return df.groupBy(*zones).agg(
        F.sum(depth).alias("depth_sum"), F.count_if(F.col(depth) > 0).alias("n_wet"), F.count_if(F.col(depth).isNull()).alias("n_unknown"),
        F.count("*").alias("n"), *(F.count_if(F.col(x)).alias(f"n_{x}") for x in flags),
    )


@query
def anchor_stage(spark, sf_dir):
    return zonal.anchor_stage(fx.cells(spark, sf_dir))


@query
def h100_iqr(spark, sf_dir):
    return zonal.anchor_stage_spread(fx.cells(spark, sf_dir))


@query
def stage_curves(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return curves.stage_curves(c, zonal.anchor_stage(c))


@query
def curves_without_anchor(spark, sf_dir):
    return curves.stage_curves(fx.cells(spark, sf_dir), steps=8, cell_area=2.5)


@query
def curve_monotonic(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    table = curves.stage_curves(c, zonal.anchor_stage(c))
    bent = F.when((F.col("step") == 7) & (F.col("catchment_id") % 10 == 0), -1e6).otherwise(0.0)
    return curves.not_monotone(table.withColumn("volume", F.col("volume") + bent))


@query
def invert_stage(spark, sf_dir):
    return _fluvial(_filled(spark, sf_dir)).stages


@query
def volume_at_stage(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    side = _fluvial(c)
    return curves.volume_at_stage(zonal.anchor_stage_spread(c), side.indexed)


@query
def reconstruct_depth(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return _by_zone(calibrate.reconstruct_depth(c, zonal.anchor_stage_spread(c)), "catchment_id", depth="recon")


@query
def reconstruction_qc(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    stages = zonal.anchor_stage_spread(c)
    return calibrate.reconstruction_quality(calibrate.reconstruct_depth(c, stages), stages)


@query
def cross_check_volume(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    side = _fluvial(c)
    return calibrate.cross_check_volume(c, zonal.anchor_stage_spread(c), side.indexed)


@query
def calibrate_alpha(spark, sf_dir):
    return _fluvial(_filled(spark, sf_dir)).alpha


@query
def calibration_table(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    stages = zonal.anchor_stage_spread(c)
    qc = calibrate.reconstruction_quality(calibrate.reconstruct_depth(c, stages), stages)
    return calibrate.calibration_table(qc.select("catchment_id", "rmse", "flag_low_csi"), _fluvial(c).alpha)


@query
def zone_rain_and_area(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("seen", F.when(F.col("hand").isNotNull(), F.col("rain_p100")))
    out = zonal.zone_mean(c, "catchment_id", "seen", "mean_known").join(zonal.zone_mean(c, "catchment_id", "seen", "mean_strict", strict=True), "catchment_id")
    return out.join(zonal.zone_area(c, "catchment_id", 2.5), "catchment_id")


@query
def channel_ratio(spark, sf_dir):
    return zonal.channel_ratio(fx.cells(spark, sf_dir), excluded=F.col("depression_id") > 0)


@query
def render_channel_ratio(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return _by_zone(render.channel_ratio_depth(c, zonal.channel_ratio(c)), "catchment_id")


@query
def render_naive(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("rain_p100", F.when(F.col("linenumber") != 3, F.col("rain_p100")).otherwise(0.0))
    return _by_zone(c.withColumn("depth", render.naive_ratio(F.col("d100"), F.col("rain_p100"), F.col("rain_pp"))), "catchment_id")


@query
def render_fluvial(spark, sf_dir):
    c = _filled(spark, sf_dir)
    return _by_zone(render.render_depth(c, _fluvial(c).stages), "catchment_id", flags=("extrapolated",))


@query
def render_pluvial(spark, sf_dir):
    c = _depressions(_filled(spark, sf_dir))
    side = basin.side(c, "depression_id", "hd")
    return _by_zone(render.render_depth(c, side.stages, "depression_id", "hd"), "depression_id", flags=("extrapolated",))


@query
def render_depth_depression(spark, sf_dir):
    out = basin.run_basin(fx.cells(spark, sf_dir), min_cells=MIN_CELLS, naive=True)
    return _by_zone(out.depth, "catchment_id", flags=("extrapolated", "low_confidence"))


@query
def render_depth_regime(spark, sf_dir):
    out = basin.run_basin(fx.cells(spark, sf_dir), min_cells=MIN_CELLS, split="regime")
    return _by_zone(out.depth, "catchment_id", "regime", flags=("extrapolated",))


@query
def render_regime_confidence(spark, sf_dir):
    rule = {"log_ratio": F.ln(ratio(F.col("rain_pp"), F.col("rain_p100"))), "slope": F.col("slope"), "urban": F.col("urban"), "period": PERIOD, "coastal": F.col("coastal")}
    out = basin.run_basin(fx.cells(spark, sf_dir), min_cells=MIN_CELLS, split="regime", confidence=rule)
    return _by_zone(out.depth, "catchment_id", "regime", flags=("extrapolated", "low_confidence"))


@query
def run_scenario(spark, sf_dir):
    m = rainfall.scenario_multiplier(rainfall.growth_curves(fx.annual_maxima(spark, sf_dir)), rainfall.climate_multiplier(fx.climate_deltas(spark, sf_dir), ["region_id"], warming="warming"), PERIOD)
    out = basin.run_scenario(fx.cells(spark, sf_dir), m, min_cells=MIN_CELLS)
    return _by_zone(out.depth, "catchment_id", flags=("extrapolated",))


@query
def holdout_render(spark, sf_dir):
    c = _filled(spark, sf_dir)
    side = _fluvial(c)
    predicted = side.alpha.where("catchment_id % 5 = 1").select("catchment_id", (F.col("alpha") * 1.25).alias("predicted"))
    return _by_zone(basin.holdout_render(c, predicted, zonal.zone_mean(c, "catchment_id", "rain_pp", "p_prime"), side.areas, side.indexed), "catchment_id")


@query
def low_confidence_regime(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    q = F.ln(ratio(F.col("rain_pp"), F.col("rain_p100")))
    flag = regime.low_confidence(q, F.col("slope"), F.col("urban"), 25.0, F.col("coastal"))
    return c.groupBy("catchment_id").agg(F.count_if(flag).alias("n_low"), F.count_if(regime.low_confidence(q)).alias("n_rain_only"), F.count_if(regime.low_confidence(q, period=5.0)).alias("n_short"))


@query
def rain_departure(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("p", F.expr("case linenumber when 1 then 0e0 when 2 then -1e0 when 3 then null else rain_pp end")).withColumn("a", F.expr("case linenumber when 4 then 0e0 else rain_p100 end"))
    return c.groupBy("catchment_id").agg(F.count_if(regime.departs(F.col("p"), F.col("a"))).alias("n_departs"))


@query
def classify_regime(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("regime", regime.classify(F.col("hand"), F.col("flow_acc")))
    return c.groupBy("catchment_id", "regime").agg(F.count("*").alias("n"))


@query
def regime_summary(spark, sf_dir):
    return regime.shares(fx.cells(spark, sf_dir).withColumn("regime", regime.classify(F.col("hand"), F.col("flow_acc"))))


@query
def relative_elevation(spark, sf_dir):
    c = zonal.relative_elevation(fx.cells(spark, sf_dir))
    return c.groupBy("depression_id").agg(F.sum("hd").alias("hd_sum"), F.max("hd").alias("hd_max"), F.count("hd").alias("n"))


@query
def depression_filter(spark, sf_dir):
    return zonal.keep_large_zones(fx.cells(spark, sf_dir), "depression_id", MIN_CELLS).groupBy("depression_id").agg(F.count("*").alias("n"))


@query
def depression_curves(spark, sf_dir):
    c = _depressions(_filled(spark, sf_dir))
    return curves.stage_curves(c, zonal.anchor_stage(c, "depression_id", "hd"), "depression_id", "hd")


@query
def depression_alpha(spark, sf_dir):
    return basin.side(_depressions(_filled(spark, sf_dir)), "depression_id", "hd").alpha


@query
def modal_snap(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("catchment_id", F.when(F.col("depression_id") % 30 == 0, F.col("depression_id") % 70).otherwise(0).alias("label"))
    return zonal.relabel_by_mode(c, "catchment_id", "label")


@query
def l_moments(spark, sf_dir):
    return rainfall.l_moments(fx.annual_maxima(spark, sf_dir))


@query
def regional_moments(spark, sf_dir):
    return rainfall.regional_moments(fx.annual_maxima(spark, sf_dir))


@query
def gev_fit(spark, sf_dir):
    return rainfall.fit(rainfall.l_moments(fx.annual_maxima(spark, sf_dir)).where("t3 is not null")).select("station_id", "loc", "scale", "shape")


@query
def growth_curves(spark, sf_dir):
    return rainfall.growth_curves(fx.annual_maxima(spark, sf_dir))


@query
def growth_factor(spark, sf_dir):
    g = rainfall.growth_curves(fx.annual_maxima(spark, sf_dir))
    c = [F.col(x) for x in ("loc", "scale", "shape")]
    return g.select("region_id", *(gev.quantile(*c, t).alias(f"t{int(t)}") for t in (1.0, 2.0, 25.0, 100.0, 500.0)))


@query
def period_multiplier(spark, sf_dir):
    return rainfall.period_multiplier(rainfall.growth_curves(fx.annual_maxima(spark, sf_dir)), PERIOD)


@query
def climate_multiplier(spark, sf_dir):
    return rainfall.climate_multiplier(fx.climate_deltas(spark, sf_dir), ["region_id"], warming="warming")


@query
def scenario_multiplier(spark, sf_dir):
    g = rainfall.growth_curves(fx.annual_maxima(spark, sf_dir))
    return rainfall.scenario_multiplier(g, rainfall.climate_multiplier(fx.climate_deltas(spark, sf_dir), ["region_id"], warming="warming"), PERIOD)


@query
def event_metrics(spark, sf_dir):
    pairs = fx.event_pairs(fx.cells(spark, sf_dir)).withColumn("depth", F.when(F.col("hand").isNotNull(), F.col("d100")))
    return validate.event_metrics(pairs)


@query
def event_gate(spark, sf_dir):
    pairs = fx.event_pairs(fx.cells(spark, sf_dir)).withColumn("depth", F.col("d100"))
    return validate.event_gate(validate.event_metrics(pairs))


@query
def reconstruction_gate(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return validate.gate_summary(validate.reconstruction_gate(c, indexed=_fluvial(c).indexed))


@query
def holdout_split(spark, sf_dir):
    return validate.holdout_split(fx.attributes(spark, sf_dir))


@query
def holdout_ols(spark, sf_dir):
    rows = _fluvial(_filled(spark, sf_dir)).alpha.join(fx.attributes(spark, sf_dir), "catchment_id")
    c = validate.fit_linear(rows, "alpha", ["level"])
    return spark.createDataFrame([(float(c[0]), float(c[1]))], "intercept double, slope double")


@query
def holdout_report(spark, sf_dir):
    return validate.spatial_holdout(_fluvial(_filled(spark, sf_dir)).alpha, fx.attributes(spark, sf_dir), ["level"])


@query
def holdout_summary(spark, sf_dir):
    return validate.holdout_summary(validate.spatial_holdout(_fluvial(_filled(spark, sf_dir)).alpha, fx.attributes(spark, sf_dir), ["level"]))


@query
def color_limit(spark, sf_dir):
    return raster.color_limit(fx.cells(spark, sf_dir), "d100")


@query
def convert_units(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("depth", raster.convert(F.round(F.col("d100") * 1000).cast("int"), 1000.0, 0))
    return c.groupBy("catchment_id").agg(F.sum(F.col("depth").cast("double")).alias("depth_sum"), F.count("depth").alias("n"))


@query
def finite_values(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("x", F.when(F.col("linenumber") == 1, F.lit(float("nan"))).when(F.col("linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("d100")))
    return c.groupBy("catchment_id").agg(F.count(finite(F.col("x"))).alias("n"), F.sum(finite(F.col("x"))).alias("total"))


@query
def bbox_tiles(spark, sf_dir):
    return raster.overlapping(fx.tiles(spark, sf_dir), 2.2, 1.0, 5.0, 4.0)


@query
def mosaic_tiles(spark, sf_dir):
    """Half-unit pixels of the overlapping tiles; the first tile with a known value wins."""
    t = raster.overlapping(fx.tiles(spark, sf_dir), 2.2, 1.0, 5.0, 4.0)
    p = t.select("tile", F.explode(F.sequence((F.col("xmin") * 2).cast("bigint"), (F.col("xmax") * 2).cast("bigint"))).alias("c"), "ymin", "ymax")
    p = p.select("tile", "c", F.explode(F.sequence((F.col("ymin") * 2).cast("bigint"), (F.col("ymax") * 2).cast("bigint"))).alias("r"))
    v = F.expr("case when (r + c + tile) % 3 <> 0 then tile * 100e0 + r + c / 10e0 end")
    return raster.mosaic(p.withColumn("value", v), "tile", "value", "r", "c")


@query
def read_window(spark, sf_dir):
    return raster.window(fx.grid(spark, sf_dir), 5, 7, 25, 31)


@query
def d8_pointer(spark, sf_dir):
    return terrain.flow_direction(fx.grid(spark, sf_dir))


def _drained(spark, sf_dir):
    from ..sources.store import checkpointed

    grid = fx.grid(spark, sf_dir)
    pointers = checkpointed(terrain.flow_direction(grid))
    stream = checkpointed(terrain.streams(terrain.flow_accumulation(pointers), STREAM))
    return grid, pointers, stream


@query
def flow_accumulation(spark, sf_dir):
    return terrain.flow_accumulation(terrain.flow_direction(fx.grid(spark, sf_dir)))


@query
def stream_cells(spark, sf_dir):
    return _drained(spark, sf_dir)[2]


@query
def hand_grid(spark, sf_dir):
    return terrain.height_above_drainage(*_drained(spark, sf_dir))


@query
def stream_links(spark, sf_dir):
    _, pointers, stream = _drained(spark, sf_dir)
    return terrain.stream_links(pointers, stream)


@query
def subbasins(spark, sf_dir):
    _, pointers, stream = _drained(spark, sf_dir)
    return terrain.catchments(pointers, stream, terrain.stream_links(pointers, stream))


@query
def hand_stack(spark, sf_dir):
    out = terrain.build_hand_stack(fx.grid(spark, sf_dir), STREAM)
    return out.select("cell", "hand", "reach_id", "catchment_id")


@query
def assemble_cells(spark, sf_dir):
    """Terrain, drainage, depressions, depth and coarser rain as one cell table."""
    grid = fx.grid(spark, sf_dir)
    depth = grid.select("r", "c", F.expr(WATER).alias("depth"))
    rain = grid.select(F.floor(F.col("r") / 4.0).alias("r"), F.floor(F.col("c") / 4.0).alias("c")).distinct().withColumn("rain_p100", F.expr(RAIN))
    out = study.assemble_cells(grid.select("r", "c", "z"), depth, {"rain_p100": (rain, 4.0)}, STREAM)
    return out.select("cell", "r", "c", "dem", "hand", "reach_id", "catchment_id", "flow_acc", "depression_id", "d100", "rain_p100")


#: Made-up depth by cell, and rain by coarse cell.
WATER, RAIN = "greatest(0e0, 0.8e0 - abs(c - 20) / 10e0)", "1e0 + (r * 3 + c) % 7 / 10e0"


@query
def condition_dem(spark, sf_dir):
    """A short reach, so that some pits are breached and others filled."""
    return terrain.condition_dem(fx.grid(spark, sf_dir, fx.AMPLITUDE_ROUGH), max_dist=3).select("cell", "z")


@query
def fill_dem(spark, sf_dir):
    return terrain.fill(fx.grid(spark, sf_dir, fx.AMPLITUDE_ROUGH))


@query
def delineate_depressions(spark, sf_dir):
    return terrain.sinks(fx.grid(spark, sf_dir, fx.AMPLITUDE_ROUGH))


def _blocks(spark, sf_dir):
    return fx.grid(spark, sf_dir, fx.AMPLITUDE_ROUGH).withColumn("depression_id", F.expr(BLOCKS))


#: Blocks of the grid as zones; every third one is background.
BLOCKS = "cast(case when (floor(r / 6e0) + floor(c / 7e0)) % 3 <> 0 then floor(r / 6e0) * 6 + floor(c / 7e0) + 1 else 0 end as bigint)"


@query
def pour_points(spark, sf_dir):
    return terrain.pour_points(_blocks(spark, sf_dir)).select("depression_id", "cell", "z")


@query
def watershed(spark, sf_dir):
    g = _blocks(spark, sf_dir)
    return terrain.watershed(terrain.flow_direction(g), terrain.pour_points(g))


@query
def line_snap(spark, sf_dir):
    """Stream links against four made-up lines across the grid."""
    grid, pointers, stream = _drained(spark, sf_dir)
    cells = terrain.stream_links(pointers, stream).join(grid.select("cell", "r", "c"), "cell")
    lines = spark.createDataFrame(LINES, "label long, ord long, r1 double, c1 double, r2 double, c2 double")
    return terrain.snap_to_lines(cells, lines)


LINES = [(11, 1, 2.0, 18.0, 14.0, 22.0), (12, 2, 10.0, 21.0, 30.0, 17.5), (13, 3, 28.0, 3.0, 28.0, 36.0), (14, 4, 40.0, 20.0, 40.0, 20.0)]


@query
def boundary_mask(spark, sf_dir):
    g = fx.grid(spark, sf_dir).withColumn("zone", F.expr("case when (r - 20) * (r - 20) + (c - 18) * (c - 18) < 90 then 1 when c > 30 then 2 else 0 end"))
    return raster.boundary_mask(g, "zone")


@query
def resample_bilinear(spark, sf_dir):
    g = fx.grid(spark, sf_dir).withColumn("z", F.expr("case when cell % 17 <> 0 then z end"))
    target = fx.grid(spark, sf_dir).select("cell", F.expr("r * 0.75e0 + 0.3e0").alias("y"), F.expr("c * 0.8e0 - 0.6e0").alias("x"))
    return raster.resample_bilinear(g, target, "z")


@query
def polygon_clip(spark, sf_dir):
    g = fx.grid(spark, sf_dir).withColumns({"x": F.col("c") + 0.25, "y": F.col("r") + 0.25})
    return raster.clip(g, RING, "z").select("cell", "z")


@query
def vertex_bounds(spark, sf_dir):
    return raster.bounds(fx.grid(spark, sf_dir).selectExpr("c * 1.5e0 as x", "r * 2.5e0 as y"))


def calibration_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor stages, reconstruction and its quality, curves, volume check and coefficients in one report."""
    c = _filled(spark, sf_dir)
    side = _fluvial(c)
    report = validate.reconstruction_gate(c, indexed=side.indexed, stages=side.spread)
    return rounded(calibrate.calibration_table(report, side.alpha))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario depth by catchment: anchor stage, curves, runoff coefficient, inversion, rendering."""
    return QUERIES["render_fluvial"](spark, sf_dir)
