"""Cell tables, catalogs and reports: reading and writing."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import known
from ..operators.calibrate import calibration_table
from ..operators.raster import convert, mosaic, overlapping, window

TILE_CELLS = 2000


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A cell table with NaN and infinities as NULL."""
    return known(spark.read.parquet(path))


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cells in folders by tile, so that a window's scan reads only the tiles it meets; rows sorted inside."""
    tiled = cells.withColumns({"tile_r": F.floor(F.col("r") / TILE_CELLS), "tile_c": F.floor(F.col("c") / TILE_CELLS)})
    tiled.repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "r", "c").write.mode(mode).partitionBy("tile_r", "tile_c").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """A window of a cell table written by tile: tiles are pruned, then row groups, then rows."""
    cells = read_cells(spark, path)
    tiles = (F.col("tile_r").between(r0 // TILE_CELLS, (r1 - 1) // TILE_CELLS)) & (F.col("tile_c").between(c0 // TILE_CELLS, (c1 - 1) // TILE_CELLS))
    return window(cells.where(tiles), r0, c0, r1, c1).drop("tile_r", "tile_c")


def read_band(spark: SparkSession, path: str, band: str, box: tuple[int, int, int, int], scale: float = 1.0, nodata: float | None = None) -> DataFrame:
    """(r, c, band) of a window in units; only the band's column is read."""
    return window(spark.read.parquet(path).select("r", "c", band), *box).withColumn(band, convert(F.col(band), scale, nodata))


def catalog_row(catalog: DataFrame, wanted: str) -> dict:
    """The entry with an id; KeyError names the ids there are."""
    row = catalog.where(F.col("id") == wanted).limit(1).collect()
    if not row:
        ids = sorted(r.id for r in catalog.select("id").distinct().limit(50).collect())
        raise KeyError(f"{wanted!r} is not in the catalog; it has {ids}")
    return row[0].asDict(recursive=True)


def catalog_band(catalog: DataFrame, wanted: str, year: int) -> tuple[str, int]:
    """Path and band number (from 1) of a year's grid."""
    asset = catalog_row(catalog, wanted)["assets"][str(year)]
    return asset["href"], asset["band_index"] + 1


def storage_path(href: str, scheme: str = "gs://") -> str:
    """A catalog's address, checked, for Spark's file systems."""
    if not href.startswith(scheme):
        raise ValueError(f"{href!r} does not start with {scheme}")
    return href


def extract_basin(
    spark: SparkSession, box: tuple[float, float, float, float], out: str, dem_tiles: DataFrame, depth: tuple[str, str], rain: dict[str, tuple[str, str]], cell: float, overwrite: bool = False, rain_step: float = 1.0,
) -> dict[str, DataFrame]:
    """The terrain mosaic and the depth and rain grids of a box (xmin, ymin, xmax, ymax), each written once.

    ``dem_tiles`` has id, the box columns and href; ``depth`` and ``rain`` name the
    path and band of a cell table.  Depth is stored in millimetres.  Rain may lie on
    cells ``rain_step`` times as large; then a margin of one of these comes with it.
    ValueError if no tile overlaps the box.
    """
    xmin, ymin, xmax, ymax = box
    tiles = overlapping(dem_tiles, xmin, ymin, xmax, ymax).select("id", "href").collect()  # the few tiles that meet the box
    if not tiles:
        raise ValueError(f"no terrain tile overlaps {box}")
    rows = math.floor(-ymax / cell), math.ceil(-ymin / cell)
    cols = math.floor(xmin / cell), math.ceil(xmax / cell)
    place = (rows[0], cols[0], rows[1], cols[1])
    wide = place if rain_step == 1 else (*(math.floor(x / rain_step) - 1 for x in place[:2]), *(math.ceil(x / rain_step) + 1 for x in place[2:]))

    def terrain() -> DataFrame:
        parts = [window(read_cells(spark, t.href), *place).select("r", "c", "z").withColumn("tile", F.lit(t.id)) for t in tiles]
        return mosaic(reduce(DataFrame.unionByName, parts), "tile", "z", "r", "c")

    made = {"dem": stage_table(spark, f"{out}/dem", terrain, overwrite)}
    made["depth"] = stage_table(spark, f"{out}/depth", lambda: read_band(spark, *depth, place, 1000.0), overwrite)
    for name, (path, band) in rain.items():
        made[name] = stage_table(spark, f"{out}/{name}", lambda path=path, band=band: read_band(spark, path, band, wide), overwrite)
    return made


def write_curves(curves: DataFrame, path: str) -> None:
    curves.write.mode("overwrite").parquet(path)


def write_calibration(quality: DataFrame, alpha: DataFrame, path: str, zone: str = "catchment_id") -> DataFrame:
    table = calibration_table(quality, alpha, zone)
    table.write.mode("overwrite").parquet(path)
    return table


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").csv(path, header=True)


def stage_table(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """A stage's table: read where it is there already, else made and written."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    if overwrite or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
