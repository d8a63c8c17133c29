"""Lines and polygons from GeoJSON, as segments and rings in grid units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def _features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("ord", "f"))
    return rows.where(F.col("f.geometry.type") == kind).select("ord", F.col("f.geometry.coordinates").alias("c"), F.col("f.properties").alias("properties"))


def read_lines(spark: SparkSession, path: str, label: str, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """(label, ord, r1, c1, r2, c2): each LineString's segments, rows counted down from ``y0``; ``label`` names a numeric property."""
    lines = _features(spark, path, "LineString").withColumn("p", F.from_json("c", "array<array<double>>"))
    to = lambda p: F.struct(((y0 - p[1]) / cell).alias("r"), ((p[0] - x0) / cell).alias("c"))
    pairs = F.zip_with(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"), lambda a, b: F.struct(to(a).alias("a"), to(b).alias("b")))
    cut = lines.where(F.size("p") > 1).select(F.col("properties")[label].cast("long").alias("label"), "ord", F.explode(pairs).alias("s"))
    return cut.select("label", F.col("ord").cast("long").alias("ord"), *(F.col(f"s.{e}.{x}").alias(f"{x}{i}") for i, e in ((1, "a"), (2, "b")) for x in ("r", "c")))


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """(ord, ring): each Polygon's outer ring as ARRAY<STRUCT<x, y>> without its closing vertex."""
    rings = _features(spark, path, "Polygon").withColumn("p", F.from_json("c", "array<array<array<double>>>")[0])
    return rings.select("ord", F.expr("transform(slice(p, 1, size(p) - 1), v -> struct(v[0] as x, v[1] as y))").alias("ring"))


def vertices(rings: DataFrame) -> DataFrame:
    """(x, y) of all vertices, for bounds."""
    return rings.select(F.inline("ring"))
