"""Domain views over the test tables; the expressions are valid in Spark and in ANSI SQL engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "(l_quantity * 10 + l_linenumber) / 100e0"
CELLS = {
    "catchment_id": "cast(l_suppkey as bigint)",
    "depression_id": "cast(case when l_partkey % 10 = 0 then l_partkey else 0 end as bigint)",
    "hand": f"case when l_linenumber = 7 and (l_quantity >= 49 or (l_quantity <= 2 and l_suppkey % 7 = 0)) then null else {LEVEL} end",
    "d100": f"greatest(0e0, 0.5e0 + (l_suppkey % 20) / 8e0 - {LEVEL} + (l_discount - 0.05e0) * 10e0 * (l_suppkey % 4))",
    "dem": "100e0 + (l_partkey % 7) + l_quantity / 10e0",
    "flow_acc": "cast(floor(l_extendedprice / 50) as bigint)",
    "rain_p100": "1e0 + l_tax * 10e0",
    "rain_pp": "(1e0 + l_tax * 10e0) * (case when l_suppkey % 5 = 0 then 2.5e0 else 1e0 + l_discount end)",
    "slope": "l_tax * 2.5e0",
    "urban": "l_returnflag = 'R'",
    "coastal": "(l_linestatus = 'F' and l_suppkey % 10 = 0)",
    "event": "l_returnflag",
    "region_id": "cast(1 + l_suppkey % 4 as bigint)",
    "linenumber": "l_linenumber",
}
AMPLITUDE_SMOOTH, AMPLITUDE_ROUGH = 50, 12
GRID = {
    "cell": "cast(p_partkey as bigint)",
    "r": "cast(floor(p_partkey / 40e0) as bigint)",
    "c": "cast(p_partkey % 40 as bigint)",
}


def elevation(amplitude: int) -> str:
    return f"floor(p_partkey / 40e0) * -2e0 + abs(p_partkey % 40 - 20) * 1e0 + (p_partkey * 7919 % 101) / {amplitude}e0"


def as_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(n) for n, e in CELLS.items()))


def grid(spark: SparkSession, sf_dir: str, amplitude: int = AMPLITUDE_SMOOTH) -> DataFrame:
    columns = GRID | {"z": elevation(amplitude)}
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(n) for n, e in columns.items()))


def annual_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value by station and day, a day standing for a year."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("station_id"), F.col("ts").cast("date").alias("day"), "value")
    return e.groupBy("station_id", "day").agg(F.max("value").alias("value")).withColumn("region_id", (1 + F.col("station_id") % 4).cast("bigint"))


def climate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("region_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("model"))
    return n.withColumns({"delta_pct": F.expr("((region_id * 7 + model * 13) % 41) - 10e0"), "warming": F.expr("1e0 + (region_id % 5) * 0.5e0")})


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("bigint").alias("catchment_id"), F.col("s_acctbal").alias("acctbal"), F.expr("cast(s_suppkey % 20 as double)").alias("level"), F.col("s_nationkey").cast("bigint").alias("block"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("tile"))
    return n.select("tile", *(F.expr(e).alias(x) for x, e in TILE.items()))


TILE = {"xmin": "(tile % 5) * 2e0", "xmax": "(tile % 5) * 2e0 + 2.5e0", "ymin": "floor(tile / 5e0) * 2e0", "ymax": "floor(tile / 5e0) * 2e0 + 2.5e0"}


def event_pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("observed", F.expr(OBSERVED))


OBSERVED = "d100 + (slope / 2.5e0 - 0.04e0) * 5e0 > 0.3e0"
