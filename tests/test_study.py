"""A study from tiles and grids to depth tables."""

import json
import math

import pytest
from inundate import __main__ as cli
from inundate.plans import study
from pyspark.sql import functions as F

ROWS, COLS, STEP = 24, 20, 4


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """A valley that drains to the south in two tiles, water along it, and rain on cells four times as large."""
    at = tmp_path_factory.mktemp("inputs")
    cells = spark.range(ROWS * COLS).select((F.floor(F.col("id") / COLS) - ROWS).alias("r"), (F.col("id") % COLS).alias("c"))
    dem = cells.withColumn("z", 40.0 - F.col("r") * 0.5 + F.abs(F.col("c") - 9) * 1.0 + F.when((F.col("r") == -12) & (F.col("c") == 3), -6.0).otherwise(0.0))
    for name, part in (("west", F.col("c") < 11), ("east", F.col("c") >= 10)):
        dem.where(part).write.parquet(f"{at}/{name}")
    box = "id string, href string, xmin double, ymin double, xmax double, ymax double"
    spark.createDataFrame([("1west", f"{at}/west", 0.0, 0.0, 11.0, 24.0), ("2east", f"{at}/east", 10.0, 0.0, 20.0, 24.0), ("3far", f"{at}/none", 90.0, 0.0, 99.0, 9.0)], box).write.parquet(f"{at}/tiles")
    cells.withColumn("rp100", F.greatest(F.lit(0), 900 - F.abs(F.col("c") - 9) * 300).cast("int")).write.parquet(f"{at}/water")
    coarse = cells.select(F.floor(F.col("r") / STEP).alias("r"), F.floor(F.col("c") / STEP).alias("c")).distinct()
    coarse.withColumn("now", F.lit(1.0)).withColumn("later", F.lit(1.5)).write.parquet(f"{at}/rain")
    return str(at)


def test_assembled_grids_are_not_broadcast(spark, inputs):
    dem = spark.read.parquet(f"{inputs}/west").where("c < 11").unionByName(spark.read.parquet(f"{inputs}/east").where("c >= 11"))
    depth = spark.read.parquet(f"{inputs}/water").withColumnRenamed("rp100", "depth")
    rain = spark.read.parquet(f"{inputs}/rain").select("r", "c", (F.col("c") * 1.0).alias("v"))
    out = study.assemble_cells(dem, depth, {"v": (rain, STEP)}, threshold=10)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_assembled_cells(spark, inputs):
    dem = spark.read.parquet(f"{inputs}/west").where("c < 11").unionByName(spark.read.parquet(f"{inputs}/east").where("c >= 11"))
    depth = spark.read.parquet(f"{inputs}/water").where("r <> -1").withColumnRenamed("rp100", "depth")
    rain = spark.read.parquet(f"{inputs}/rain").select("r", "c", (F.col("c") * 1.0).alias("v"))
    got = {(r.r, r.c): r for r in study.assemble_cells(dem, depth, {"v": (rain, STEP)}, threshold=10).collect()}
    assert len(got) == ROWS * COLS and {r.cell for r in got.values()} == set(range(ROWS * COLS))
    assert all((r.d100 is None) == (r.r == -1) for r in got.values())
    assert all(r.v == pytest.approx(min(max((r.c + 0.5) / STEP - 0.5, 0), 4)) for r in got.values())
    assert got[-12, 3].depression_id > 0 and sum(r.depression_id > 0 for r in got.values()) < 30
    assert all(r.hand >= 0 and r.catchment_id > 0 for r in got.values() if r.hand is not None)


def test_study_from_a_box(spark, inputs, tmp_path, monkeypatch):
    config = {
        "box": [0.0, 0.0, 20.0, 24.0], "dem_tiles": f"{inputs}/tiles", "depth": [f"{inputs}/water", "rp100"], "cell": 1.0, "rain_step": STEP, "threshold": 10, "min_cells": 3,
        "rain": {"rain_p100": [f"{inputs}/rain", "now"], "rain_pp": [f"{inputs}/rain", "later"]},
    }
    path, out = tmp_path / "study.json", str(tmp_path / "out")
    path.write_text(json.dumps(config))
    assert cli.main(["study", str(path), out]) == 0
    cells = spark.read.parquet(f"{out}/depth")
    assert cells.count() == ROWS * COLS and cells.where("depth > 0").count() > 0
    alpha = {r.catchment_id: r.alpha for r in spark.read.parquet(f"{out}/calibration").collect()}
    assert alpha and all(a is None or a > 0 for a in alpha.values())
    curves = spark.read.parquet(f"{out}/curves")
    assert curves.where("volume < 0").count() == 0 and set(alpha) >= {r.catchment_id for r in curves.select("catchment_id").distinct().collect()}
    rises = cells.where("depth is not null and d100 > 0 and depression_id = 0").agg(F.avg(F.col("depth") - F.col("d100"))).first()[0]
    assert rises is not None and math.isfinite(rises) and rises > 0  # half as much rain again
    given = config | {"dem_tiles": spark.read.parquet(f"{inputs}/tiles")}
    clipped = study.run_study(spark, out=out, ring=[(0.0, -10.0), (20.0, -10.0), (20.0, 0.0), (0.0, 0.0)], **{k: v for k, v in given.items()})
    assert 0 <= clipped["wet"] < ROWS * COLS and clipped["cells"] == ROWS * COLS
    with pytest.raises(ValueError, match="no terrain tile"):
        study.run_study(spark, out=str(tmp_path / "x"), **(given | {"box": [500.0, 0.0, 501.0, 1.0]}))


def test_depression_and_multiplier_steps(spark, inputs, tmp_path):
    dem = spark.read.parquet(f"{inputs}/west").withColumn("cell", F.monotonically_increasing_id())
    dem.write.parquet(str(tmp_path / "grid"))
    assert cli.main(["depressions", str(tmp_path / "grid"), str(tmp_path / "deep"), "--min-cells", "1"]) == 0
    assert spark.read.parquet(str(tmp_path / "deep")).where("depression_id > 0 and hd >= 0").count() > 0
    spark.createDataFrame([(1, 1.0, 0.2, 0.05)], "region_id long, loc double, scale double, shape double").write.parquet(str(tmp_path / "growth"))
    spark.createDataFrame([(1, 10.0), (1, 14.0)], "region_id long, delta_pct double").write.parquet(str(tmp_path / "deltas"))
    assert cli.main(["multiplier", str(tmp_path / "growth"), str(tmp_path / "deltas"), str(tmp_path / "m"), "--period", "100"]) == 0
    assert spark.read.parquet(str(tmp_path / "m")).first().multiplier == pytest.approx(1.12)
