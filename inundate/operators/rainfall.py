"""Extreme rainfall: L-moments, regional growth curves, climate deltas and multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gev
from ..functions.nulls import complete, ratio

LEAST_YEARS = 3
DELTA_PER_DEGREE = 0.07


def l_moments(maxima: DataFrame, station: str = "station_id", value: str = "value") -> DataFrame:
    """(station, n, l1, l2, l3, t3) from probability-weighted moments; fewer than three years give NULL moments."""
    w = Window.partitionBy(station).orderBy(value)
    n_all = Window.partitionBy(station)
    rows = maxima.where(F.col(value).isNotNull()).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(n_all)})
    x, i, n = F.col(value), F.col("i"), F.col("n")
    b = rows.groupBy(station, "n").agg(
        F.avg(x).alias("b0"),
        (F.sum(i * x) / F.when(F.max(n) > 1, F.max(n) * (F.max(n) - 1))).alias("b1"),
        (F.sum(i * (i - 1) * x) / F.when(F.max(n) > 2, F.max(n) * (F.max(n) - 1) * (F.max(n) - 2))).alias("b2"),
    )
    enough = F.col("n") >= LEAST_YEARS
    l2 = 2 * F.col("b1") - F.col("b0")
    l3 = 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    return b.select(
        station, "n", F.when(enough, F.col("b0")).alias("l1"), F.when(enough, l2).alias("l2"), F.when(enough, l3).alias("l3"), F.when(enough, ratio(l3, l2)).alias("t3"),
    )


def fit(moments: DataFrame) -> DataFrame:
    """The table with loc, scale and shape from l1, l2 and t3."""
    return moments.withColumns(gev.parameters(F.col("l1"), F.col("l2"), F.col("t3")))


def station_regions(maxima: DataFrame, station: str = "station_id", region: str = "region_id", order: str | None = None) -> DataFrame:
    """(station, region): the region of each station's first row by ``order``.  A table has no order of its own, so
    without that column a station of several regions is an error."""
    if order is not None:
        return maxima.groupBy(station).agg(F.min_by(region, order).alias(region))
    several = F.raise_error(F.concat(F.lit("several regions for station "), F.col(station).cast("string"))).cast(maxima.schema[region].dataType)
    both = maxima.groupBy(station).agg(F.min(region).alias("_a"), F.max(region).alias("_b"))
    return both.select(station, F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_a").isNotNull(), several).alias(region))


def regional_moments(maxima: DataFrame, station: str = "station_id", region: str = "region_id", value: str = "value", order: str | None = None) -> DataFrame:
    """(region, lcv, t3, n_stations): record-length weighted means over a region's stations; a station counts in its first region."""
    where = station_regions(maxima, station, region, order)
    s = l_moments(maxima, station, value).withColumn("lcv", ratio(F.col("l2"), F.col("l1"))).where("lcv is not null and t3 is not null")
    n = F.col("n")
    return s.join(where, station).groupBy(region).agg(
        (F.sum(n * F.col("lcv")) / F.sum(n)).alias("lcv"), (F.sum(n * F.col("t3")) / F.sum(n)).alias("t3"), F.count("*").alias("n_stations"),
    )


def growth_curves(maxima: DataFrame, **names) -> DataFrame:
    """(region, loc, scale, shape) of each region's dimensionless growth curve (l1 = 1)."""
    region = names.get("region", "region_id")
    pooled = regional_moments(maxima, **names).select(region, F.lit(1.0).alias("l1"), F.col("lcv").alias("l2"), "t3")
    return fit(pooled).select(region, "loc", "scale", "shape")


def growth_factor(curves: DataFrame, period: float, name: str = "growth") -> DataFrame:
    return curves.withColumn(name, gev.quantile(F.col("loc"), F.col("scale"), F.col("shape"), period))


def period_multiplier(curves: DataFrame, period: float, anchor: float = 100.0, region: str = "region_id") -> DataFrame:
    """(region, multiplier): the growth factor over the anchor period's."""
    c = [F.col(x) for x in ("loc", "scale", "shape")]
    return curves.select(region, ratio(gev.quantile(*c, period), gev.quantile(*c, anchor)).alias("multiplier"))


def climate_multiplier(deltas: DataFrame, keys: list[str], delta: str = "delta_pct", warming: str | None = None, rate: float = DELTA_PER_DEGREE) -> DataFrame:
    """(keys, climate, model_spread): one plus the models' median change, within the bound that warming sets; the spread is the population's."""
    x = F.col(delta)
    aggs = [complete(F.median(x), x).alias("_m"), complete(F.stddev_pop(x), x).alias("model_spread")]
    if warming is not None:
        aggs.append((F.max(warming) * rate * 100).alias("_b"))
    out = deltas.groupBy(*keys).agg(*aggs)
    bounded = F.when(F.col("_m").isNotNull(), F.least(F.greatest(F.col("_m"), -F.col("_b")), F.col("_b"))) if warming is not None else F.col("_m")
    return out.select(*keys, (1 + bounded / 100).alias("climate"), "model_spread")


def scenario_multiplier(curves: DataFrame, climate: DataFrame, period: float, anchor: float = 100.0, region: str = "region_id") -> DataFrame:
    """(region, multiplier, model_spread): return period times climate."""
    both = period_multiplier(curves, period, anchor, region).join(climate, region)
    return both.select(region, (F.col("multiplier") * F.col("climate")).alias("multiplier"), "model_spread")


def scale_rain(cells: DataFrame, multipliers: DataFrame, region: str = "region_id", rain: str = "rain_p100", name: str = "rain_pp") -> DataFrame:
    """Anchor rain times each region's multiplier: the scenario's rain by cell."""
    from .zonal import spread

    return spread(cells, multipliers.select(region, F.col("multiplier").alias("_x")), region).withColumn(name, F.col(rain) * F.col("_x")).drop("_x")
