"""Zonal statistics: order statistics, means, counts, modes and look-ups by zone.

A zone id of 0 or less is background and leaves before any shuffle.  All group-bys
combine in the map tasks first.  A hot zone may hold a third of all cells, so exact
quantiles never gather a zone's values in one task: see ``quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed

BUCKETS = 512


def inside(cells: DataFrame, zone: str) -> DataFrame:
    return cells.where(F.col(zone) > 0)


def quantiles(df: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles by key with linear interpolation; NULL values are skipped.

    The values beside a rank are weighted as SQL's ``quantile_cont`` weights them: of a
    median even the last bit counts, for a stage lies at, over or under a cell's height.
    Each key's range is cut into buckets, and equal values of a bucket are counted in
    the map tasks.  Bucket counts tell which buckets hold the ranks that are asked for,
    and only those are ordered, one task for each (key, bucket).
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    ends = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    bucket = F.coalesce(F.floor((F.col("v") - F.col("lo")) * BUCKETS / width), F.lit(0))
    placed = rows.join(ends, "k").withColumn("b", F.least(bucket, F.lit(BUCKETS - 1)).cast("int"))
    placed = placed.groupBy("k", "total", "b", "v").agg(F.count("*").alias("n"))
    by_bucket = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("k", "b", "total").agg(F.sum("n").alias("m")).withColumn("through", F.sum("m").over(by_bucket))
    ranks = {name: (F.floor((F.col("total") - 1) * q), F.ceil((F.col("total") - 1) * q)) for name, q in wanted.items()}
    holds = F.lit(False)
    for pair in ranks.values():
        for r in pair:
            holds = holds | ((r >= F.col("through") - F.col("m")) & (r < F.col("through")))
    used = sums.where(holds).select("k", "b", (F.col("through") - F.col("m")).alias("before"))
    by_value = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(used, ["k", "b"]).withColumn("reached", F.col("before") + F.sum("n").over(by_value))
    picks = [F.min(F.when(F.col("reached") > r, F.col("v"))).alias(f"{name}_{i}") for name, pair in ranks.items() for i, r in enumerate(pair)]
    found = ranked.groupBy("k", "total").agg(*picks)
    out = [F.col("k").alias(key)]
    for name, q in wanted.items():
        p = (F.col("total") - 1) * q
        low, high, part = F.col(f"{name}_0"), F.col(f"{name}_1"), p - F.floor(p)
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    return found.select(*out)


def wet(cells: DataFrame, zone: str, depth: str = "d100") -> DataFrame:
    return cells.where((F.col(zone) > 0) & (F.col(depth) > 0))


def anchor_stage(cells: DataFrame, zone: str = "catchment_id", datum: str = "hand", depth: str = "d100") -> DataFrame:
    """Median water level (depth + datum) over each zone's wet cells."""
    levels = wet(cells, zone, depth).select(zone, (F.col(depth) + F.col(datum)).alias("stage"))
    return quantiles(levels, zone, "stage", {"stage": 0.5})


def anchor_stage_spread(cells: DataFrame, zone: str = "catchment_id", datum: str = "hand", depth: str = "d100") -> DataFrame:
    """The median water level ``h100`` and its interquartile range."""
    levels = wet(cells, zone, depth).select(zone, (F.col(depth) + F.col(datum)).alias("stage"))
    q = quantiles(levels, zone, "stage", {"h100": 0.5, "q25": 0.25, "q75": 0.75})
    return q.select(zone, "h100", (F.col("q75") - F.col("q25")).alias("h100_iqr"))


def zone_mean(cells: DataFrame, zone: str, value: str, name: str, strict: bool = False) -> DataFrame:
    """Mean over a zone's known cells; with ``strict`` NULL for a zone with an unknown one."""
    from ..functions.nulls import complete

    mean = F.avg(value)
    return inside(cells, zone).groupBy(zone).agg((complete(mean, F.col(value)) if strict else mean).alias(name))


def zone_area(cells: DataFrame, zone: str, cell_area: float = 1.0) -> DataFrame:
    return inside(cells, zone).groupBy(zone).agg((F.count("*") * F.lit(float(cell_area))).alias("area"))


def spread(cells: DataFrame, values: DataFrame, zone: str) -> DataFrame:
    """Every cell with its zone's values; background and unknown zones get NULL.

    A plain left join: Spark sends the zone table to all executors only where its
    size is known to be small, and splits hot zones of a shuffled join otherwise.
    """
    values = values if values.schema[zone].dataType.typeName() == "string" else values.where(F.col(zone) > 0)
    return cells.join(values, zone, "left")


def relative_elevation(cells: DataFrame, zone: str = "depression_id", elevation: str = "dem", name: str = "hd") -> DataFrame:
    """Elevation above the zone's lowest cell; NULL in the background."""
    floors = inside(cells, zone).groupBy(zone).agg(F.min(elevation).alias("_floor"))
    return spread(cells, floors, zone).withColumn(name, F.col(elevation) - F.col("_floor")).drop("_floor")


def keep_large_zones(cells: DataFrame, zone: str, min_cells: int) -> DataFrame:
    """Zones of fewer than ``min_cells`` cells become background."""
    large = inside(cells, zone).groupBy(zone).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells).select(zone, F.lit(True).alias("_large"))
    return spread(cells, large, zone).withColumn(zone, F.when(F.col("_large"), F.col(zone)).otherwise(F.lit(0).cast(cells.schema[zone].dataType))).drop("_large")


def large_zone_elevation(cells: DataFrame, zone: str = "depression_id", min_cells: int = 1, elevation: str = "dem", name: str = "hd") -> DataFrame:
    """``keep_large_zones`` and ``relative_elevation`` with one aggregation, a durable table of zones, and one join."""
    zones = inside(cells, zone).groupBy(zone).agg(F.count("*").alias("_n"), F.min(elevation).alias("_floor")).where(F.col("_n") >= min_cells)
    zones = checkpointed(zones.select(zone, "_floor", F.lit(True).alias("_large")))
    both = spread(cells, zones, zone).withColumn(name, F.when(F.col("_large"), F.col(elevation) - F.col("_floor")))
    return both.withColumn(zone, F.when(F.col("_large"), F.col(zone)).otherwise(F.lit(0).cast(cells.schema[zone].dataType))).drop("_large", "_floor")


def lowest_cell(cells: DataFrame, zone: str, value: str, *place: str) -> DataFrame:
    """The place of each zone's lowest known value; of equals the first in row-major order."""
    first = inside(cells, zone).where(F.col(value).isNotNull()).groupBy(zone).agg(F.min(F.struct(value, *place)).alias("_m"))
    return first.select(zone, *(F.col(f"_m.{c}").alias(c) for c in place), F.col(f"_m.{value}").alias(value))


def modal_label(pairs: DataFrame, zone: str, label: str) -> DataFrame:
    """Each zone's most frequent label; of equals the least.  Labels of 0 or less don't count."""
    counted = pairs.where((F.col(zone) > 0) & (F.col(label) > 0)).groupBy(zone, label).agg(F.count("*").alias("_n"))
    best = counted.groupBy(zone).agg(F.max(F.struct("_n", (-F.col(label)).alias("_l"))).alias("_m"))
    return best.select(zone, (-F.col("_m._l")).alias(label))


def relabel_by_mode(cells: DataFrame, zone: str, label: str) -> DataFrame:
    """Zone ids replaced by their modal label; a zone without one gets its id moved above all labels."""
    modes = modal_label(cells, zone, label).withColumnRenamed(label, "_label")
    top = cells.agg(F.max(label)).first()[0]
    zones = inside(cells, zone).select(zone).distinct().join(modes, zone, "left")
    return zones.select(zone, F.coalesce("_label", F.col(zone) + F.lit(max(top or 0, 0) + 1)).alias("label"))


def class_shares(cells: DataFrame, column: str, names: dict[int, str]) -> DataFrame:
    return cells.agg(*(F.avg((F.col(column) == k).cast("double")).alias(n) for k, n in names.items()))


def channel_ratio(cells: DataFrame, zone: str = "catchment_id", depth: str = "d100", rain: str = "rain_p100", excluded: Column | None = None) -> DataFrame:
    """Median depth per unit of rain over a zone's wet cells with rain, but for those excluded."""
    rows = wet(cells, zone, depth).where(F.col(rain) > 0)
    if excluded is not None:
        rows = rows.where(~F.coalesce(excluded, F.lit(False)))
    return quantiles(rows.select(zone, (F.col(depth) / F.col(rain)).alias("k")), zone, "k", {"k": 0.5})


def zones_in(cells: DataFrame, ids: DataFrame, zone: str, out: bool = False) -> DataFrame:
    """The cells of listed zones, or (``out``) of all others."""
    return cells.join(ids.select(zone), zone, "left_anti" if out else "left_semi")
