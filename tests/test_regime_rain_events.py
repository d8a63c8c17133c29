import math

import numpy as np
import pytest
from inundate.functions import gev
from inundate.operators import rainfall, regime, validate, zonal
from inundate.plans import basin
from inundate.streaming import gauges
from pyspark.sql import functions as F


def one(df):
    return df.collect()[0]


def test_regime_boundaries(spark):
    df = spark.createDataFrame([(2.9, 1), (3.0, 499), (3.0, 500), (None, None), (None, 500), (1.0, None)], "hand double, acc long")
    assert [r.x for r in df.select(regime.classify(F.col("hand"), F.col("acc")).alias("x")).collect()] == [0, 1, 0, 1, 0, 0]


def test_confidence_arms(spark):
    df = spark.createDataFrame([(0.0, 0.1, False, False), (math.log(2) + 1e-9, 0.1, False, False), (math.log(2), 0.15, False, False), (None, 0.2, False, False), (0.0, None, True, False), (0.0, None, False, True)], "q double, s double, u boolean, c boolean")
    flag = regime.low_confidence(F.col("q"), F.col("s"), F.col("u"), 25.0, F.col("c"))
    assert [r.x for r in df.select(flag.alias("x")).collect()] == [False, True, False, True, True, True]
    assert one(df.select(regime.low_confidence(F.col("q"), period=9.9).alias("x"))).x


def test_departure(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-1.0, 1.0), (1.0, 0.0), (None, 1.0), (2.0, 1.0), (2.1, 1.0), (0.4, 1.0)], "p double, a double")
    assert [r.x for r in df.select(regime.departs(F.col("p"), F.col("a")).alias("x")).collect()] == [True, False, False, False, False, True, True]


def test_modes(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, 9), (2, 3), (3, 0), (0, 7)], "z long, l long")
    assert {(r.z, r.label) for r in zonal.relabel_by_mode(df, "z", "l").collect()} == {(1, 5), (2, 3), (3, 3 + 10)}


def test_lowest_cell_ties(spark):
    df = spark.createDataFrame([(1, 1, 1, 2.0), (1, 0, 3, 2.0), (1, 0, 0, None), (0, 0, 0, -5.0)], "z long, r long, c long, dem double")
    assert [(r.r, r.c) for r in zonal.lowest_cell(df, "z", "dem", "r", "c").collect()] == [(0, 3)]


def moments(x):
    x = np.sort(x)
    n, i = len(x), np.arange(len(x))
    b0, b1, b2 = x.mean(), (i * x).sum() / n / (n - 1), (i * (i - 1) * x).sum() / n / (n - 1) / (n - 2)
    return b0, 2 * b1 - b0, 6 * b2 - 6 * b1 + b0


def test_l_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.gumbel(50, 15, 40)
    rows = [("a", "north", float(v)) for v in x] + [("b", "north", 1.0), ("b", "north", 2.0)] + [("c", "south", 5.0)] * 4
    got = {r.station_id: r for r in rainfall.l_moments(spark.createDataFrame(rows, "station_id string, region_id string, value double")).collect()}
    l1, l2, l3 = moments(x)
    assert (got["a"].l1, got["a"].l2, got["a"].t3) == pytest.approx((l1, l2, l3 / l2))
    assert got["b"].l1 is None and got["b"].t3 is None  # two years are too few
    assert got["c"].l2 == pytest.approx(0) and got["c"].t3 is None


def test_gumbel_fit_and_quantile(spark):
    t3 = 0.169925001442312  # Gumbel's
    r = one(rainfall.fit(spark.createDataFrame([(50.0, 15 * math.log(2), t3)], "l1 double, l2 double, t3 double")))
    assert r["scale"] == pytest.approx(15, rel=2e-3) and r["loc"] == pytest.approx(50 - 0.5772156649 * 15, rel=2e-3)
    flat = spark.createDataFrame([(0.0, 1.0, 0.0)], "loc double, scale double, shape double")
    c = [F.col(n) for n in ("loc", "scale", "shape")]
    assert one(flat.select(gev.quantile(*c, 100.0).alias("x"))).x == pytest.approx(-math.log(-math.log(0.99)))
    assert one(flat.select(gev.quantile(*c, 1.0).alias("x"))).x is None


def test_multiplier_is_one_at_the_anchor(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", f"r{s % 2}", float(v)) for s in range(4) for v in rng.gumbel(50, 15, 40)]
    g = rainfall.growth_curves(spark.createDataFrame(rows, "station_id string, region_id string, value double"))
    assert [r.multiplier for r in rainfall.period_multiplier(g, 100.0).collect()] == pytest.approx([1.0, 1.0])
    levels = [r.growth for t in (2.0, 10.0, 100.0) for r in rainfall.growth_factor(g, t).where("region_id = 'r0'").collect()]
    assert levels == sorted(levels)
    m = rainfall.scenario_multiplier(g, spark.createDataFrame([("r0", 1.1, 0.0)], "region_id string, climate double, model_spread double"), 100.0)
    assert [(r.region_id, r.multiplier) for r in m.collect()] == [("r0", pytest.approx(1.1))]
    cells = spark.createDataFrame([("r0", 10.0), ("r9", 10.0)], "region_id string, rain_p100 double")
    assert {r.region_id: r.rain_pp for r in rainfall.scale_rain(cells, m).collect()} == {"r0": pytest.approx(11.0), "r9": None}


def test_climate_bound(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 30.0, 1.0), (1, 40.0, 1.0), (2, None, 1.0), (2, 1.0, 1.0), (3, -50.0, 2.0)], "region_id long, delta_pct double, warming double")
    got = {r.region_id: r for r in rainfall.climate_multiplier(df, ["region_id"], warming="warming").collect()}
    assert got[1].climate == pytest.approx(1.07) and got[1].model_spread == pytest.approx(np.std([5, 30, 40]))
    assert got[2].climate is None and got[3].climate == pytest.approx(0.86)
    free = {r.region_id: r.climate for r in rainfall.climate_multiplier(df, ["region_id"]).collect()}
    assert free[1] == pytest.approx(1.3)


PAIR = "event string, depth double, observed boolean"


def test_event_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 0.1, True), ("a", 1.0, False), ("a", 0.0, False), ("a", None, True)], PAIR)
    r = {x.threshold: x for x in validate.event_metrics(df).collect()}[0.3]
    assert (r.hits, r.misses, r.false_alarms, r.csi, r.hit_rate, r.false_alarm_ratio, r.area_error) == (1, 1, 1, pytest.approx(1 / 3), 0.5, 0.5, 0.0)


@pytest.mark.parametrize(("rows", "passed"), [([], False), ([("a", 0.0, False)], False), ([("a", 1.0, True)], True), ([("a", 1.0, True), ("b", 1.0, False)], False)])
def test_event_gate(spark, rows, passed):
    assert one(validate.event_gate(validate.event_metrics(spark.createDataFrame(rows, PAIR)))).passed is passed


def test_reconstruction_gate(spark):
    rng = np.random.default_rng(0)
    good = [(1, float(h), float(max(0.8 - h, 0))) for h in rng.uniform(0, 1.5, 300)]
    bad = [(2, float(h), float(d)) for h, d in zip(rng.uniform(0, 1.5, 300), rng.uniform(0, 1.5, 300), strict=True)]
    gate = lambda rows: one(validate.gate_summary(validate.reconstruction_gate(spark.createDataFrame(rows, "catchment_id long, hand double, d100 double"))))
    assert gate(good).passed and not gate(good + bad).passed and not gate([]).passed
    assert gate(good + bad).pass_rate == 0.5


def test_holdout(spark):
    rng = np.random.default_rng(1)
    area = rng.uniform(1, 10, 200)
    rows = [(i + 1, float(0.05 + 0.02 * a), float(a), i % 8) for i, a in enumerate(area)]
    df = spark.createDataFrame(rows, "catchment_id long, alpha double, area double, block long")
    split = validate.holdout_split(df).collect()
    block = {r[0]: r[3] for r in rows}
    held = {block[r.catchment_id] for r in split if r.held_out}
    assert len(held) == 2 and not held & {block[r.catchment_id] for r in split if not r.held_out}  # bround(1.6)
    report = validate.spatial_holdout(df.select("catchment_id", "alpha"), df.drop("alpha"), ["area"])
    s = one(validate.holdout_summary(report))
    assert s.n == 50 and s.rmse < 1e-9
    noise = df.withColumn("area", F.rand(3))
    assert one(validate.holdout_summary(validate.spatial_holdout(df.select("catchment_id", "alpha"), noise.drop("alpha"), ["area"]))).rmse > 0.01
    alone = validate.holdout_split(df.limit(3), block=None).where("held_out").count()
    assert alone == 1
    two = validate.fit_linear(df.withColumn("same", F.col("area")), "alpha", ["area", "same"])
    assert two[1] == pytest.approx(two[2]) == pytest.approx(0.01)  # the shortest of many solutions


def test_holdout_render_leaves_others_unknown(spark):
    rows = [(z, float(h), 0.5, 1.0) for z in (1, 2) for h in np.linspace(0, 1, 40)]
    df = spark.createDataFrame(rows, "catchment_id long, hand double, d100 double, rain_p100 double").withColumn("rain_pp", F.lit(1.0))
    side = basin.side(df, "catchment_id", "hand")
    out = basin.holdout_render(df, spark.createDataFrame([(2, 0.2)], "catchment_id long, predicted double"), zonal.zone_mean(df, "catchment_id", "rain_pp", "p_prime"), side.areas, side.indexed)
    assert {(r.catchment_id, r.depth is None) for r in out.collect()} == {(0, True), (2, False)}


def test_streamed_maxima(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 3.0), (1, "2024-01-01 05:00:00", 7.0), (1, "2024-01-02 05:00:00", 1.0), (2, "2024-01-09 00:00:00", 2.0), (1, "2024-01-20 00:00:00", 2.0)]
    df = spark.createDataFrame(rows, "station_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = gauges.block_maxima(stream).writeStream.outputMode("append").format("memory").queryName("maxima").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.station_id, str(r.block)[:10], r.value) for r in spark.table("maxima").collect()}
    assert (1, "2024-01-01", 7.0) in got and (1, "2024-01-02", 1.0) in got and all(b != "2024-01-20" for _, b, _ in got)
    assert got < {(r.station_id, str(r.block)[:10], r.value) for r in gauges.block_maxima(df).collect()}


def test_gamma_equals_the_library(spark):
    xs = [0.02, 0.3, 0.5, 0.999, 1.0, 1.0000005, 1.5, 2.0, 4.7]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(gev.gamma(F.col("x")).alias("g")).collect()]
    assert got == [pytest.approx(math.gamma(x), rel=1e-12) for x in xs]


def test_flat_shapes_are_gumbels(spark):
    """A shape within the tolerance is exactly 0, so the quantile takes Gumbel's formula too."""
    c0 = math.log(2) / math.log(3)
    t3 = 2 / (c0 + 5e-7 / 7.859) - 3  # about k = 5e-7
    r = rainfall.fit(spark.createDataFrame([(1.0, 0.2, t3)], "l1 double, l2 double, t3 double")).first()
    assert r["shape"] == 0.0 and r["scale"] == pytest.approx(0.2 / math.log(2))
    q = spark.range(1).select(gev.quantile(F.lit(r["loc"]), F.lit(r["scale"]), F.lit(r["shape"]), 100.0).alias("q")).first().q
    assert q == pytest.approx(r["loc"] - r["scale"] * math.log(-math.log(1 - 1 / 100)))


def test_station_of_several_regions(spark):
    df = spark.createDataFrame([(1, 5, 2.0, 1), (1, 3, 1.0, 2), (2, 4, 1.0, 3)], "station_id long, region_id long, value double, at long")
    assert dict(rainfall.station_regions(df, order="at").collect()) == {1: 5, 2: 4}
    assert dict(rainfall.station_regions(df.where("at <> 2")).collect()) == {1: 5, 2: 4}
    with pytest.raises(Exception, match="several regions"):
        rainfall.station_regions(df).collect()


def test_unknown_flags_do_not_spread(spark):
    df = spark.createDataFrame([(0.1, None, None), (0.1, True, None), (2.0, None, False)], "q double, urban boolean, coastal boolean")
    got = [r.x for r in df.select(regime.low_confidence(F.col("q"), urban=F.col("urban"), coastal=F.col("coastal")).alias("x")).collect()]
    assert got == [False, True, True]
