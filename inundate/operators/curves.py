"""Stage-volume-area curves by zone, and their inversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curve
from .zonal import inside, relative_elevation, spread

STEPS, MULTIPLE, LEAST = 20, 1.5, 1e-6


def stage_curves(
    cells: DataFrame, anchor: DataFrame | None = None, zone: str = "catchment_id", datum: str = "hand",
    cell_area: float = 1.0, steps: int = STEPS, multiple: float = MULTIPLE,
) -> DataFrame:
    """(zone, step, h, volume, area) at ``steps`` stages from 0 to ``multiple`` times the anchor stage.

    Area counts the cells strictly below the stage, volume sums the water over them.
    A zone without an anchor stage reaches to its highest cell.  A cell is put under the
    first stage above it and summed once, in the map tasks; the steps' sums run over
    the few rows of these.
    """
    rows = inside(cells, zone).where(F.col(datum).isNotNull()).select(zone, F.col(datum).alias("z"))
    tops = rows.groupBy(zone).agg(F.max("z").alias("_top"))
    if anchor is not None:
        tops = tops.join(anchor.select(zone, F.col("stage").alias("_anchor")), zone, "left")
        top = F.coalesce(F.col("_anchor") * multiple, F.col("_top"))
    else:
        top = F.col("_top")
    tops = tops.select(zone, F.greatest(top, F.lit(LEAST)).alias("h_max"))
    apart = F.col("h_max") / max(steps - 1, 1)
    at = [F.lit(0.0) if i == 0 else F.col("h_max") if i == steps - 1 else i * apart for i in range(steps)]
    # a division finds the stage but for rounding, so the stages around it are compared as they are
    guess = F.least(F.greatest(F.floor(F.col("z") / apart), F.lit(0)), F.lit(steps - 1)).cast("int")
    stage = lambda i: F.when(i >= steps - 1, F.col("h_max")).otherwise(i * apart)
    k = F.col("guess")
    first = F.when((k > 0) & (F.col("z") < stage(k - 1)), k - 1).when(F.col("z") < stage(k), k).when((k < steps - 1) & (F.col("z") < stage(k + 1)), k + 1).otherwise(k + 2)
    placed = rows.join(tops, zone).withColumn("guess", guess).withColumn("first", first)
    summed = placed.groupBy(zone, "h_max", "first").agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    sums = []
    for i in range(steps):
        below = F.col("first") <= i
        sums += [F.coalesce(F.sum(F.when(below, F.col("n"))), F.lit(0)).alias(f"n{i}"), F.sum(F.when(below, F.col("s"))).alias(f"s{i}")]
    wide = summed.groupBy(zone, "h_max").agg(*sums)
    points = [
        F.struct(F.lit(i).alias("step"), h.alias("h"), ((h * F.col(f"n{i}") - F.coalesce(f"s{i}", F.lit(0.0))) * cell_area).alias("volume"), (F.col(f"n{i}") * F.lit(float(cell_area))).alias("area"))
        for i, h in enumerate(at)
    ]
    return wide.select(zone, F.inline(F.array(*points)))


def depression_curves(cells: DataFrame, anchor: DataFrame | None = None, zone: str = "depression_id", elevation: str = "dem", **more) -> DataFrame:
    """Curves over each depression's own floor."""
    return stage_curves(relative_elevation(cells, zone, elevation), anchor, zone, "hd", **more)


def index_curves(curves: DataFrame, zone: str = "catchment_id") -> DataFrame:
    """(zone, points): a zone's few curve points as one array ordered by stage."""
    return curves.groupBy(zone).agg(F.sort_array(F.collect_list(F.struct("h", "volume"))).alias("points"))


def not_monotone(curves: DataFrame, zone: str = "catchment_id", slack: float = 1e-9) -> DataFrame:
    """Zones whose volume or area falls with the stage."""
    w = Window.partitionBy(zone).orderBy("h", "step")
    steps = curves.select(zone, (F.col("volume") - F.lag("volume").over(w)).alias("dv"), (F.col("area") - F.lag("area").over(w)).alias("da"))
    return steps.where((F.col("dv") < -slack) | (F.col("da") < -slack)).select(zone).distinct()


def invert_stage(targets: DataFrame, indexed: DataFrame, zone: str = "catchment_id", volume: str = "volume", strict: bool = False) -> DataFrame:
    """``targets`` with stage and extrapolated.  A known volume without a curve gives NULL, or with ``strict`` an error."""
    both = spread(targets, indexed, zone)
    stage = curve.stage_for(F.col("points"), F.col(volume))
    if strict:
        lost = F.col(volume).isNotNull() & F.col("points").isNull()
        stage = F.when(lost, F.raise_error(F.concat(F.lit("no curve for zone "), F.col(zone).cast("string")))).otherwise(stage)
    return both.withColumns({"stage": stage, "extrapolated": curve.outside(F.col("points"), F.col(volume))}).drop("points")


def volume_at_stage(targets: DataFrame, indexed: DataFrame, zone: str = "catchment_id", stage: str = "h100", name: str = "volume") -> DataFrame:
    return spread(targets, indexed, zone).withColumn(name, curve.volume_for(F.col("points"), F.col(stage))).drop("points")
