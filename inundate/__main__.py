"""Command lines for the steps: ``python -m inundate STEP ...`` or the same by spark-submit.

Tables are Parquet paths.  ``gate`` and ``events`` exit with 1 where the gate fails.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import curves, rainfall, terrain, validate, zonal
from .plans import basin, study
from .sources import tables


def _curves(spark, a) -> None:
    c = tables.read_cells(spark, a.cells)
    table = curves.stage_curves(c, zonal.anchor_stage(c, a.zone, a.datum), a.zone, a.datum, a.cell_area)
    tables.write_curves(table, a.out)
    bad = [r[0] for r in curves.not_monotone(spark.read.parquet(a.out), a.zone).limit(10).collect()]
    print(f"not monotone: {bad}" if bad else "all curves rise")


def _calibrate(spark, a) -> None:
    c = tables.read_cells(spark, a.cells)
    side = basin.side(c, a.zone, a.datum, a.cell_area)
    report = validate.reconstruction_gate(c, a.zone, a.datum, indexed=side.indexed, cell_area=a.cell_area)
    tables.write_calibration(report, side.alpha, a.out, a.zone)


def _run(spark, a) -> None:
    out = basin.run_basin(tables.read_cells(spark, a.cells), a.cell_area, a.min_cells, a.split, a.compare)
    out.depth.write.mode("overwrite").parquet(f"{a.out}/depth")
    tables.write_curves(out.fluvial.curves, f"{a.out}/curves")
    tables.write_calibration(out.quality, out.fluvial.alpha, f"{a.out}/calibration")
    n = spark.read.parquet(f"{a.out}/depth").agg(F.count_if("extrapolated"), F.count_if("low_confidence")).first()
    print(f"extrapolated cells: {n[0]}, low confidence: {n[1]}")


def _rainfall(spark, a) -> None:
    growth = rainfall.growth_curves(tables.read_cells(spark, a.maxima))
    growth.write.mode("overwrite").parquet(a.out)


def _delineate(spark, a) -> None:
    terrain.build_hand_stack(tables.read_cells(spark, a.grid), a.threshold).write.mode("overwrite").parquet(a.out)


def _study(spark, a) -> None:
    """The arguments of ``study.run_study`` come as a JSON file; dem_tiles there is the path of the tiles' table."""
    with open(a.config, encoding="utf-8") as f:
        given = json.load(f)
    given["dem_tiles"] = spark.read.parquet(given["dem_tiles"])
    print(study.run_study(spark, out=a.out, **given))


def _depressions(spark, a) -> None:
    grid = tables.read_cells(spark, a.grid)
    zones = zonal.keep_large_zones(grid.join(terrain.sinks(grid), "cell"), "depression_id", a.min_cells)
    zonal.relative_elevation(zones, "depression_id", "z", "hd").write.mode("overwrite").parquet(a.out)


def _multiplier(spark, a) -> None:
    climate = rainfall.climate_multiplier(spark.read.parquet(a.deltas), ["region_id"], warming=a.warming or None)
    rainfall.scenario_multiplier(spark.read.parquet(a.growth), climate, a.period).write.mode("overwrite").parquet(a.out)


def _gate(spark, a) -> int:
    c = tables.read_cells(spark, a.cells)
    report = validate.reconstruction_gate(c, a.zone, a.datum)
    tables.write_report(report, a.out)
    summary = validate.gate_summary(report).first()
    print(summary.asDict())
    return 0 if summary.passed else 1


def _events(spark, a) -> int:
    metrics = validate.event_metrics(tables.read_cells(spark, a.pairs))
    tables.write_report(metrics, a.out)
    return 0 if validate.event_gate(metrics).first().passed else 1


def _holdout(spark, a) -> None:
    report: DataFrame = validate.spatial_holdout(spark.read.parquet(a.alpha), spark.read.parquet(a.attributes), a.features.split(","), a.zone, a.block or None)
    tables.write_report(report, a.out)
    print(validate.holdout_summary(report).first().asDict())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inundate")
    steps = p.add_subparsers(dest="step", required=True)

    def step(name, run, *paths, **options):
        s = steps.add_parser(name)
        for x in (*paths, "out"):
            s.add_argument(x)
        for x, default in options.items():
            flag = "--" + x.replace("_", "-")
            s.add_argument(flag, action="store_true") if default is False else s.add_argument(flag, default=default, type=type(default))
        s.set_defaults(run=run)

    zones = {"zone": "catchment_id", "datum": "hand"}
    step("curves", _curves, "cells", cell_area=1.0, **zones)
    step("calibrate", _calibrate, "cells", cell_area=1.0, **zones)
    step("run", _run, "cells", cell_area=1.0, min_cells=basin.MIN_CELLS, split="depression", compare=False)
    step("rainfall", _rainfall, "maxima")
    step("delineate", _delineate, "grid", threshold=terrain.STREAM_CELLS)
    step("study", _study, "config")
    step("depressions", _depressions, "grid", min_cells=basin.MIN_CELLS)
    step("multiplier", _multiplier, "growth", "deltas", period=25.0, warming="")
    step("gate", _gate, "cells", **zones)
    step("events", _events, "pairs")
    step("holdout", _holdout, "alpha", "attributes", features="area", zone="catchment_id", block="block")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"inundate {a.step}").getOrCreate()
    return a.run(spark, a) or 0


if __name__ == "__main__":
    sys.exit(main())
