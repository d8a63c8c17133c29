"""Grid work on cell tables: windows, mosaics, resampling, masks and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .terrain import neighbours
from .zonal import quantiles

CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def overlapping(tiles: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Tiles whose box strictly overlaps the given one."""
    return tiles.where((F.col("xmin") < xmax) & (F.col("xmax") > xmin) & (F.col("ymin") < ymax) & (F.col("ymax") > ymin))


def mosaic(pixels: DataFrame, rank: str, value: str, *place: str) -> DataFrame:
    """One value for each place: the known one of the tile first by rank."""
    return pixels.where(F.col(value).isNotNull()).groupBy(*place).agg(F.min(F.struct(rank, value)).alias("_m")).select(*place, F.col(f"_m.{value}").alias(value))


def window(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """Cells of a row and column range (ends excluded); the ranges reach a Parquet scan as filters."""
    return cells.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def convert(raw: Column, scale: float = 1.0, nodata: float | None = None) -> Column:
    """A stored integer as single-precision units; the no-data value as NULL."""
    value = (raw.cast("float") / F.lit(float(scale))).cast("float")
    return value if nodata is None else F.when(raw != F.lit(nodata), value)


def resample_bilinear(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """``value`` at target places (cell, y, x in source rows and columns): the weighted mean of the known ones of the four source cells around."""
    y, x = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - y, F.col("x") - x
    corners = F.array(*(
        F.struct((y + a).alias("r"), (x + b).alias("c"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)
    ))
    asked = target.select("cell", F.inline(corners)).where("w > 0")
    met = asked.join(source.select("r", "c", F.col(value).alias("v")).where("v is not null").hint("merge"), ["r", "c"])
    got = met.groupBy("cell").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"))
    return target.join(got, "cell", "left").select("cell", F.try_divide("wv", "w").alias(value))


def boundary_mask(grid: DataFrame, zone: str, dilate: int = 2) -> DataFrame:
    """(r, c, boundary): cells that differ from one of their four neighbours, grown by ``dilate`` cells."""
    ids = grid.select("r", "c", F.col(zone).alias("id"))
    own = ids.withColumn("code", F.lit(-1))
    met = own.unionByName(neighbours(ids, "id", around=CROSS)).groupBy("r", "c").agg(
        F.max(F.when(F.col("code") == -1, F.col("id"))).alias("own"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    edge = met.where("own is not null and (lo <> own or hi <> own)").select("r", "c")
    reach = [(a, b) for a in range(-dilate, dilate + 1) for b in range(-dilate, dilate + 1) if abs(a) + abs(b) <= dilate]
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in reach))
    grown = edge.select("r", "c", F.explode(offsets).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()
    return grid.select("r", "c").join(grown.withColumn("boundary", F.lit(True)), ["r", "c"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast against a ring of vertices (a fixed expression, in generated code)."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
            at = F.lit(float(x1)) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """The same against a ring held as ARRAY<STRUCT<x, y>>, for polygons that come as a column or have many vertices."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, turned, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < a["x"] + (y - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"]), F.lit(False)))
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def clip(cells: DataFrame, ring: list[tuple[float, float]], *values: str, x: str = "x", y: str = "y") -> DataFrame:
    """Values outside the polygon become NULL; the ring's box is tested first."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
    inside = box & in_polygon(F.col(x), F.col(y), ring)
    return cells.withColumns({v: F.when(inside, F.col(v)) for v in values})


def bounds(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def color_limit(cells: DataFrame, depth: str = "depth") -> DataFrame:
    """The 98th percentile of wet depth for a picture's scale; 1 without a wet cell."""
    wet = cells.where(F.col(depth) > 0).select(F.lit(1).alias("all"), F.col(depth))
    return quantiles(wet, "all", depth, {"vmax": 0.98}).agg(F.coalesce(F.max("vmax"), F.lit(1.0)).alias("vmax"))


def first_valid(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
