"""A study from a box of a catalog to depth tables: extract, align, delineate, calibrate, render, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terrain
from ..operators.raster import resample_bilinear
from ..sources import tables
from ..sources.store import checkpointed
from . import basin


def numbered(dem: DataFrame) -> DataFrame:
    """A terrain grid (r, c, z) with row-major cell numbers from 0."""
    e = dem.agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    if e.r0 is None:
        return dem.withColumn("cell", F.lit(None).cast("bigint")).select("cell", "r", "c", "z")
    return dem.select(((F.col("r") - e.r0) * (e.c1 - e.c0 + 1) + F.col("c") - e.c0).cast("bigint").alias("cell"), "r", "c", "z")


def aligned(grid: DataFrame, coarse: DataFrame, step: float, name: str) -> DataFrame:
    """(cell, name): a grid (r, c, name) of cells ``step`` times as large, at the centres of the cells of ``grid``."""
    half = F.lit(0.5)
    centre = lambda x: (F.col(x) + half) / F.lit(float(step)) - half
    return resample_bilinear(coarse.withColumnRenamed(name, "_v"), grid.select("cell", centre("r").alias("y"), centre("c").alias("x")), "_v").withColumnRenamed("_v", name)


def assemble_cells(
    dem: DataFrame, depth: DataFrame, rain: dict[str, tuple[DataFrame, float]], threshold: int = terrain.STREAM_CELLS, segments: DataFrame | None = None,
) -> DataFrame:
    """The cell table of a basin run from grids: every cell of the terrain (r, c, z) once, with its drainage, its
    depression, the anchor's depth (r, c, depth) and rain (name -> (grid, step), aligned).

    Grids meet by (r, c); a cell that a grid lacks is unknown there.  Depressions are
    those of the terrain as it is, the drainage that of the conditioned one.  Grids meet
    by shuffles alone: none goes through the driver, however small its files are.
    """
    grid = checkpointed(numbered(dem), sized=False)
    out = terrain.build_hand_stack(grid, threshold, segments).withColumnRenamed("z", "dem")
    out = out.join(terrain.sinks(grid), "cell", "left").join(depth.select("r", "c", F.col("depth").alias("d100")).hint("merge"), ["r", "c"], "left")
    for name, (coarse, step) in rain.items():
        out = out.join(aligned(grid, coarse, step, name), "cell", "left")
    return out


def run_study(
    spark: SparkSession, box: tuple[float, float, float, float], out: str, dem_tiles: DataFrame, depth: tuple[str, str], rain: dict[str, tuple[str, str]], cell: float,
    rain_step: float = 1.0, threshold: int = terrain.STREAM_CELLS, min_cells: int = basin.MIN_CELLS, ring: list[tuple[float, float]] | None = None, overwrite: bool = False,
) -> dict:
    """From a box (and a polygon in it) to ``out``/depth, curves, calibration and report; returns the run's counters.

    ``rain`` names the cell tables of ``rain_p100`` and ``rain_pp``, on cells
    ``rain_step`` times as large as the terrain's.  The extracted grids and the cell
    table are stages: a second run reads what is there.
    """
    made = tables.extract_basin(spark, box, f"{out}/grids", dem_tiles, depth, rain, cell, overwrite, rain_step)
    band = depth[1]
    grids = {name: (made[name].withColumnRenamed(rain[name][1], name), rain_step) for name in rain}
    cells = tables.stage_table(
        spark, f"{out}/cells", lambda: assemble_cells(made["dem"], made["depth"].withColumnRenamed(band, "depth"), grids, threshold).withColumns({"x": (F.col("c") + 0.5) * cell, "y": -(F.col("r") + 0.5) * cell}), overwrite,
    )
    done = basin.run_basin(cells, cell * cell, min_cells, ring=ring)
    done.depth.write.mode("overwrite").parquet(f"{out}/depth")
    tables.write_curves(done.fluvial.curves, f"{out}/curves")
    tables.write_calibration(done.quality, done.fluvial.alpha, f"{out}/calibration")
    tables.write_report(done.quality, f"{out}/report")
    counts = spark.read.parquet(f"{out}/depth").agg(F.count("*").alias("cells"), F.count_if(F.col("depth") > 0).alias("wet"), F.count_if("extrapolated").alias("extrapolated"), F.count_if("low_confidence").alias("low_confidence"))
    return counts.first().asDict()
