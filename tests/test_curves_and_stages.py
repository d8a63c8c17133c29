import math

import duckdb
import numpy as np
import pytest
from inundate.functions import curve
from inundate.functions.nulls import known
from inundate.operators import calibrate, curves, render, zonal
from inundate.plans import basin
from pyspark.sql import functions as F

CELL = "catchment_id long, hand double, d100 double"


def cells(spark, rows, schema=CELL):
    return spark.createDataFrame(rows, schema)


def flat(n=400, zone=1, level=0.8, seed=0):
    rng = np.random.default_rng(seed)
    return [(zone, float(h), float(max(level - h, 0.0))) for h in rng.uniform(0, 1.5, n)]


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.98, 1.0])
def test_quantiles_equal_numpy(spark, q):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=501), 2: np.array([1.0, 2, 3, 10]), 3: np.repeat(5.0, 70), 4: np.round(rng.exponential(size=300), 1), 5: np.array([-7.5])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (6, None)]
    got = {r.k: r.v for r in zonal.quantiles(spark.createDataFrame(rows, "k long, x double").repartition(7), "k", "x", {"v": q}).collect()}
    assert got == {k: pytest.approx(np.quantile(v, q), abs=1e-12) for k, v in groups.items()}


def test_flat_water_is_recovered(spark):
    df = cells(spark, flat())
    assert one(zonal.anchor_stage(df)).stage == pytest.approx(0.8)
    stages = zonal.anchor_stage_spread(df)
    r = one(calibrate.reconstruction_quality(calibrate.reconstruct_depth(df, stages), stages))
    assert r["csi_0.3"] == 1.0 and r.rmse == pytest.approx(0, abs=1e-12) and r.area_ratio == 1.0 and not r.flag_low_csi
    indexed = curves.index_curves(curves.stage_curves(df, zonal.anchor_stage(df)))
    v = one(calibrate.cross_check_volume(df, stages, indexed))
    assert v.rel_diff < 0.05 and not v.flag_volume_mismatch


def test_curve_by_hand(spark):
    df = cells(spark, [(1, 0.0, 0.0), (1, 1.0, 0.0), (1, None, 0.0), (0, 0.5, 0.0), (-3, 0.5, 0.0)])
    got = [(r.h, r.volume, r.area) for r in curves.stage_curves(df, steps=3, cell_area=2.0).orderBy("step").collect()]
    assert got == [(0.0, 0.0, 0.0), (0.5, 1.0, 2.0), (1.0, 2.0, 2.0)]  # the cell at the stage itself is not below it


def test_single_step_and_flat_zone(spark):
    df = cells(spark, [(1, 0.0, 0.0)])
    assert [r.h for r in curves.stage_curves(df, steps=1).collect()] == [0.0]
    assert max(r.h for r in curves.stage_curves(df).collect()) == pytest.approx(1e-6)


def test_curves_are_monotone_and_bad_ones_found(spark):
    df = cells(spark, flat() + flat(zone=1 << 33, seed=5))
    table = curves.stage_curves(df)
    assert curves.not_monotone(table).count() == 0
    bad = table.withColumn("volume", F.when((F.col("step") == 9) & (F.col("catchment_id") == 1 << 33), 0.0).otherwise(F.col("volume")))
    assert [r.catchment_id for r in curves.not_monotone(bad).collect()] == [1 << 33]


POINTS = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 4.0), (4.0, 4.0)]


@pytest.mark.parametrize(
    ("v", "h", "out"), [(0.0, 2.0, False), (2.0, 2.5, False), (4.0, 4.0, False), (4.0001, 4.0, True), (-1.0, 0.0, True), (None, None, False)]
)
def test_inversion_and_plateaus(spark, v, h, out):
    df = spark.createDataFrame([(POINTS, v)], "points array<struct<h:double,volume:double>>, v double")
    r = one(df.select(curve.stage_for(F.col("points"), F.col("v")).alias("h"), curve.outside(F.col("points"), F.col("v")).alias("out")))
    assert r.h == h and r.out == out


def test_volume_at_a_point_but_for_the_order_of_its_sums(spark):
    """The last bits of a sum decide neither the flag nor the stage; a part in a million does."""
    end = 27.65
    at = [math.nextafter(end, 0), end, math.nextafter(end, 99), end * (1 + 1e-6), end * (1 - 1e-6)]
    df = spark.createDataFrame([(i, [(0.0, 0.0), (0.5, 9.0), (0.75, end)], v) for i, v in enumerate(at)], "i int, points array<struct<h:double,volume:double>>, v double")
    got = df.select(curve.stage_for(F.col("points"), F.col("v")).alias("h"), curve.outside(F.col("points"), F.col("v")).alias("out")).orderBy("i").collect()
    assert [r.out for r in got] == [False, False, False, True, False]
    assert [r.h for r in got[:4]] == [0.75] * 4 and got[4].h < 0.75


def test_inversion_equals_numpy(spark):
    rng = np.random.default_rng(3)
    h = np.linspace(0, 5, 20)
    v = np.cumsum(rng.integers(0, 3, 20)).astype(float)
    xs = [float(x) for x in np.linspace(-1, v[-1] + 1, 57)] + v.tolist()
    df = spark.createDataFrame([(list(zip(h.tolist(), v.tolist(), strict=True)), x) for x in xs], "points array<struct<h:double,volume:double>>, v double")
    got = [r.h for r in df.select(curve.stage_for(F.col("points"), F.col("v")).alias("h")).collect()]
    assert got == pytest.approx(np.interp(xs, v, h).tolist())


def test_round_trip(spark):
    df = cells(spark, flat())
    indexed = curves.index_curves(curves.stage_curves(df, steps=50))
    targets = spark.createDataFrame([(1, 0.37), (1, 1.1)], "catchment_id long, h100 double")
    back = curves.invert_stage(curves.volume_at_stage(targets, indexed), indexed)
    for r in back.collect():
        assert r.stage == pytest.approx(r.h100, abs=0.02) and not r.extrapolated


def test_missing_curve(spark):
    indexed = curves.index_curves(curves.stage_curves(cells(spark, flat())))
    targets = spark.createDataFrame([(2, 1.0), (3, None)], "catchment_id long, volume double")
    assert {(r.stage, r.extrapolated) for r in curves.invert_stage(targets, indexed).collect()} == {(None, False)}
    with pytest.raises(Exception, match="no curve for zone 2"):
        curves.invert_stage(targets, indexed, strict=True).collect()
    assert curves.invert_stage(targets.where("catchment_id = 3"), indexed, strict=True).count() == 1


def quality(spark, rows, h100):
    df = cells(spark, rows)
    stages = spark.createDataFrame(h100, "catchment_id long, h100 double, h100_iqr double")
    return {r.catchment_id: r for r in calibrate.reconstruction_quality(calibrate.reconstruct_depth(df, stages), stages).collect()}


def test_shallow_zone_is_not_flagged(spark):
    r = quality(spark, [(1, 0.9, 0.1), (1, 2.0, 0.0)], [(1, 1.0, 0.0)])[1]
    assert r["csi_0.3"] is None and not r.flag_low_csi


def test_unknown_reconstruction_is_a_miss(spark):
    r = quality(spark, [(1, None, 1.0), (1, 0.0, 1.0), (1, 0.0, 1.0)], [(1, 1.0, 0.0)])[1]
    assert r["csi_0.3"] == pytest.approx(2 / 3) and r.rmse is None and r.flag_low_csi


def test_zone_without_stage_is_left_out(spark):
    assert set(quality(spark, [(1, 0.0, 1.0), (2, 0.0, 0.0)], [(1, 1.0, 0.0)])) == {1}


def test_alpha(spark):
    df = cells(spark, [(1, 0.0, 1.0), (1, 0.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 1.0), (4, 0.0, 0.1)])
    rain = spark.createDataFrame([(1, 4.0), (2, 1.0), (4, 2.0)], "catchment_id long, p100 double")
    areas = zonal.zone_area(df, "catchment_id", 2.0)
    got = {r.catchment_id: r for r in calibrate.calibrate_alpha(df, rain, areas, cell_area=2.0).collect()}
    assert got[1].alpha == 0.25 and not got[1].flag_alpha_out_of_range
    assert got[2].alpha == 0 and got[2].flag_alpha_out_of_range
    assert got[3].alpha is None and got[3].flag_alpha_out_of_range
    assert got[4].alpha == pytest.approx(0.05) and not got[4].flag_alpha_out_of_range  # the bound is in range


def test_calibration_table_keeps_both_sides(spark):
    qc = spark.createDataFrame([(1, 0.9)], "catchment_id long, rmse double")
    alpha = spark.createDataFrame([(2, 0.1)], "catchment_id long, alpha double")
    assert {(r.catchment_id, r.rmse, r.alpha) for r in calibrate.calibration_table(qc, alpha).collect()} == {(1, 0.9, None), (2, None, 0.1)}


def render_one(spark, alpha, rain, area):
    df = cells(spark, flat())
    indexed = curves.index_curves(curves.stage_curves(df))
    frame = lambda x, n: spark.createDataFrame([(1, x)] if x != "none" else [], f"catchment_id long, {n} double")
    stages = render.zone_stage(frame(alpha, "alpha"), frame(rain, "p_prime"), frame(area, "area"), indexed)
    return render.render_depth(df.unionByName(cells(spark, [(0, 0.0, 0.0), (9, 0.0, 0.0)])), stages).collect()


@pytest.mark.parametrize("case", [("none", 1.0, 1.0), (0.1, "none", 1.0), (0.1, 1.0, "none"), (math.nan, 1.0, 1.0), (0.1, math.inf, 1.0)])
def test_incomplete_zone_is_unknown_not_dry(spark, case):
    assert {(r.depth, r.extrapolated) for r in render_one(spark, *case)} == {(None, False)}


def test_background_and_unknown_zones_are_unknown(spark):
    got = render_one(spark, 0.1, 100.0, 5.0)
    assert all((r.depth is None) == (r.catchment_id != 1) for r in got)


def test_anchor_rain_reproduces_the_anchor(spark):
    rows = [(1, h, d, 1.0, 1.0, 0, 100.0, 1) for _, h, d in flat(2000)]
    df = spark.createDataFrame(rows, "catchment_id long, hand double, d100 double, rain_p100 double, rain_pp double, depression_id long, dem double, flow_acc long")
    small, large = (basin.run_basin(df, cell_area=a).depth.agg(F.sum("depth"), F.sum("d100")).first() for a in (1.0, 900.0))
    assert small[0] == pytest.approx(small[1], rel=0.03)
    assert large[0] == pytest.approx(small[0])  # depth does not depend on the cell area


def test_depression_without_depth_does_not_fall_back(spark):
    df = spark.createDataFrame([(5, None, 2.0, 0), (0, 1.0, 2.0, 1), (0, None, None, 0)], "depression_id long, pluvial_depth double, fluvial_depth double, regime int")
    df = df.withColumns({"pluvial_extrapolated": F.lit(True), "fluvial_extrapolated": F.lit(None).cast("boolean")})
    assert [(r.depth, r.extrapolated) for r in render.combine(df).collect()] == [(None, True), (2.0, False), (None, False)]
    assert [r.depth for r in render.combine(df, "regime").collect()] == [2.0, 1.0, None]
    with pytest.raises(ValueError, match="split"):
        render.combine(df, "other")


def test_ratio_methods(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0, 6.0), (1, 0.0, 4.0, 6.0), (1, 1.0, 0.0, 6.0), (1, 0.0, None, None), (2, 1.0, 1.0, 1.0), (1, 100.0, 4.0, 1.0), (1, 3.0, 4.0, 1.0)], "catchment_id long, d100 double, rain_p100 double, rain_pp double")
    naive = [r.x for r in df.select(render.naive_ratio(F.col("d100"), F.col("rain_p100"), F.col("rain_pp")).alias("x")).collect()]
    assert naive[:4] == [3.0, 0.0, None, 0.0]
    k = zonal.channel_ratio(df.where("catchment_id = 1"))
    assert one(k).k == 0.75  # the median, not the mean
    got = sorted((r.catchment_id, r.d100, r.depth is None, r.depth or 0.0) for r in render.channel_ratio_depth(df, k).collect())
    assert got == [(1, 0.0, False, 0.0), (1, 0.0, False, 0.0), (1, 1.0, False, 4.5), (1, 2.0, False, 4.5), (1, 3.0, False, 0.75), (1, 100.0, False, 0.75), (2, 1.0, True, 0.0)]


def test_not_finite_is_unknown(spark):
    df = known(spark.createDataFrame([(math.nan, 1), (math.inf, 2), (-math.inf, 3), (0.5, 4)], "x double, i long"))
    assert [r.x for r in df.orderBy("i").collect()] == [None, None, None, 0.5]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_changes_nothing(spark, parts):
    df = cells(spark, flat() + flat(zone=2, level=0.3, seed=2)).repartition(parts)
    got = [(r.catchment_id, r.step, round(r.volume, 9)) for r in curves.stage_curves(df, zonal.anchor_stage(df)).orderBy("catchment_id", "step").collect()]
    base = cells(spark, flat() + flat(zone=2, level=0.3, seed=2))
    assert got == [(r.catchment_id, r.step, round(r.volume, 9)) for r in curves.stage_curves(base, zonal.anchor_stage(base)).orderBy("catchment_id", "step").collect()]


def test_empty_tables(spark):
    df = cells(spark, [])
    assert curves.stage_curves(df, zonal.anchor_stage(df)).count() == 0 and zonal.anchor_stage_spread(df).count() == 0


def test_anchor_of_unknown_height_falls_back(spark):
    df = cells(spark, [(1, None, 1.0), (1, 2.0, 0.0)])
    assert max(r.h for r in curves.stage_curves(df, zonal.anchor_stage(df)).collect()) == 2.0


def test_curves_at_stages_equal_to_cells(spark):
    """A cell at a stage is not below it, whatever the division that finds the stage rounds to."""
    top = 0.3
    at = [i * (top * 1.5 / 19) for i in range(20)]
    zs = [*at, *np.nextafter(at, 9).tolist(), *np.nextafter(at, -9).tolist(), -0.2, 7.0]
    rows = cells(spark, [(1, z, 0.0) for z in zs])
    anchor = spark.createDataFrame([(1, top)], "catchment_id long, stage double")
    for r in curves.stage_curves(rows, anchor).collect():
        below = [z for z in zs if z < r.h]
        assert r.area == len(below) and r.volume == pytest.approx(sum(r.h - z for z in below))


@pytest.mark.parametrize("rain", [-1.0, 0.0])
def test_no_ratio_without_a_positive_denominator(spark, rain):
    df = spark.createDataFrame([(1, 0.5, rain, 1.0)], "catchment_id long, d100 double, rain_p100 double, rain_pp double")
    r = one(calibrate.alpha_from_sums(calibrate.zone_sums(df)))
    assert r.alpha is None and r.flag_alpha_out_of_range and r.v_rain == rain


def test_calibration_table_keeps_unmatched_zones(spark):
    qc = spark.createDataFrame([(1, 0.1), (2, 0.2)], "catchment_id long, rmse double")
    alpha = spark.createDataFrame([(2, 0.3), (3, 0.4)], "catchment_id long, alpha double")
    got = {(r.catchment_id, r.rmse, r.alpha) for r in calibrate.calibration_table(qc, alpha).collect()}
    assert got == {(1, 0.1, None), (2, 0.2, 0.3), (3, None, 0.4)}


def test_zones_without_a_ratio_are_unknown(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.5, 2.0), (2, 0.0, 2.0)], "catchment_id long, d100 double, rain_pp double")
    ratios = spark.createDataFrame([(1, 0.25)], "catchment_id long, k double")
    got = sorted((r.catchment_id, r.d100, r.depth) for r in render.channel_ratio_depth(df, ratios).collect())
    assert got == [(1, 0.5, 0.5), (2, 0.0, 0.0), (2, 0.5, None)]


def test_large_zone_elevation_equals_its_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 9)), None if i % 17 == 0 else float(rng.normal())) for i in range(300)] + [(900, 77, 1.0)]
    df = spark.createDataFrame(rows, "i long, depression_id long, dem double")
    want = zonal.relative_elevation(zonal.keep_large_zones(df, "depression_id", 5)).select("i", "depression_id", "hd").collect()
    got = zonal.large_zone_elevation(df, min_cells=5).select("i", "depression_id", "hd").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_coefficient_on_a_bound_is_in_range_in_any_order_of_its_sums(spark):
    """0.05 and 0.4 as sums come out one bit off."""
    rows = [(1, 2.9499999999999997, 1.0, 59.0), (2, 18.040000000000006, 1.0, 45.1), (3, 2.9499, 1.0, 59.0), (4, 18.0401, 1.0, 45.1), (5, None, 1.0, 59.0)]
    assert rows[0][1] / 59.0 < 0.05 and rows[1][1] / 45.1 > 0.4
    got = calibrate.alpha_from_sums(spark.createDataFrame(rows, "catchment_id long, v_obs double, p100 double, area double"))
    assert {r.catchment_id: r.flag_alpha_out_of_range for r in got.collect()} == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_medians_equal_sql_to_the_last_bit(spark):
    """A stage one bit off moves a cell of its very height under or over the water."""
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k in range(1, 300) for v in np.round(rng.uniform(0, 3, 4), 2) + 0.1]
    got = {r.k: (r.half, r.same) for r in zonal.quantiles(spark.createDataFrame(rows + [(300, 0.3)] * 4, "k long, v double"), "k", "v", {"half": 0.5, "same": 0.98}).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT k, quantile_cont(v, 0.5e0) FROM t GROUP BY 1").fetchall())
    assert {k: half for k, (half, _) in got.items() if k < 300} == want and got[300] == (0.3, 0.3)
