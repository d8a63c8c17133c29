"""Plans: filters and columns reach the scan, zone tables are joined by key, nothing is crossed."""

import re

import pytest
from inundate.operators import calibrate, curves, validate, zonal
from inundate.plans import basin


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    rows = [(i % 5, i % 3, i / 50, max(0.0, 1 - i / 40), 100.0 + i % 7, 1.0, 1.5, i, "x" * 20, bool(i % 2)) for i in range(200)]
    names = "catchment_id long, depression_id long, hand double, d100 double, dem double, rain_p100 double, rain_pp double, flow_acc long, wide string, observed boolean"
    spark.createDataFrame(rows, names).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(text):
    return {tuple(x.split(":")[0] for x in m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)}


def test_scans_read_what_they_need(cells):
    text = plan(curves.stage_curves(cells))
    assert schemas(text) == {("catchment_id", "hand")}
    assert "GreaterThan(catchment_id,0)" in text and "IsNotNull(hand)" in text
    assert schemas(plan(zonal.anchor_stage(cells))) == {("catchment_id", "hand", "d100")}
    assert re.search(r"Filter .*d100#\d+ > 0\.0", plan(zonal.anchor_stage(cells)))


def test_curves_take_one_shuffle_of_partial_sums(cells):
    text = plan(curves.stage_curves(cells))
    assert "partial_sum" in text and "Expand" not in text and "Generate" in text


def test_zone_sums_are_one_pass(cells):
    text = plan(calibrate.zone_sums(cells))
    assert text.count("FileScan") == 1 and len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert plan(validate.event_metrics(cells.selectExpr("wide as event", "d100 as depth", "observed"))).count("FileScan") == 1


def test_nothing_is_crossed(cells):
    out = basin.run_basin(cells, min_cells=2, split="regime", naive=True)
    for df in (out.depth, out.quality, out.fluvial.stages, zonal.anchor_stage_spread(cells)):
        assert not re.search("CartesianProduct|NestedLoop|PythonUDF|ArrowEval", plan(df))
