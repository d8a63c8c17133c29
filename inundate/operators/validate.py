"""Gates and reports: events, reconstruction, spatial holdout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio, yes
from .calibrate import CSI_AT, CSI_GATE, THRESHOLDS, cross_check_volume, reconstruct_depth, reconstruction_quality
from .zonal import anchor_stage_spread

EVENT_CSI, PASS_RATE = 0.5, 0.95


def event_metrics(pairs: DataFrame, thresholds=THRESHOLDS, event: str = "event", depth: str = "depth", observed: str = "observed", cell_area: float = 1.0) -> DataFrame:
    """Contingency counts and scores by (event, threshold) over cells of known depth, in one pass."""
    o = F.col(observed)
    aggs, rows = [], []
    for i, t in enumerate(thresholds):
        wet = F.col(depth) > t
        aggs += [F.count_if(wet & o).alias(f"h{i}"), F.count_if(~wet & o).alias(f"m{i}"), F.count_if(wet & ~o).alias(f"f{i}")]
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{i}").alias("hits"), F.col(f"m{i}").alias("misses"), F.col(f"f{i}").alias("false_alarms")))
    counted = pairs.where(F.col(depth).isNotNull()).groupBy(event).agg(*aggs).select(event, F.inline(F.array(*rows)))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return counted.select(
        event, "threshold", "hits", "misses", "false_alarms", ratio(h, h + m + f).alias("csi"), ratio(h, h + m).alias("hit_rate"), ratio(f, h + f).alias("false_alarm_ratio"),
        ((h + f) * F.lit(float(cell_area))).alias("rendered_area"), ((h + m) * F.lit(float(cell_area))).alias("observed_area"), ratio(f - m, h + m).alias("area_error"),
    )


def event_gate(metrics: DataFrame, at: float = CSI_AT, least: float = EVENT_CSI) -> DataFrame:
    """passed: every event reaches the score at the threshold; false without events."""
    rows = metrics.where(F.abs(F.col("threshold") - at) < 1e-9)
    return rows.agg(F.coalesce(F.bool_and(yes(F.col("csi") >= least)), F.lit(False)).alias("passed"))


def reconstruction_gate(cells: DataFrame, zone: str = "catchment_id", datum: str = "hand", depth: str = "d100", indexed: DataFrame | None = None, cell_area: float = 1.0, stages: DataFrame | None = None) -> DataFrame:
    """The zones' quality report, with the volume check where curves are given; ``stages`` if they are known already."""
    stages = anchor_stage_spread(cells, zone, datum, depth) if stages is None else stages
    report = reconstruction_quality(reconstruct_depth(cells, stages, zone, datum), stages, zone, depth)
    if indexed is not None:
        report = report.join(cross_check_volume(cells, stages, indexed, zone, depth, cell_area), zone, "left")
    return report


def gate_summary(report: DataFrame, least: float = PASS_RATE) -> DataFrame:
    """Zones, those that pass, the pass rate, medians and the gate; no zones fail it."""
    good = ~F.col("flag_low_csi")
    rate = ratio(F.count_if(good), F.count("*"))
    at = F.col(f"`csi_{CSI_AT:g}`")
    return report.agg(
        F.count("*").alias("n_zones"), F.count_if(good).alias("n_pass"), rate.alias("pass_rate"), F.median(at).alias("median_csi"), F.median("rmse").alias("median_rmse"),
        yes(rate >= least).alias("passed"),
    )


def holdout_split(zones: DataFrame, zone: str = "catchment_id", block: str | None = "block", share: float = 0.2, seed: int = 0) -> DataFrame:
    """(zone, held_out): whole blocks (or, without blocks, zones) held out in the order of a hash; at least one, and a rounded share of all."""
    key = block or zone
    blocks = zones.select(key).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    # blocks are few: one row for each region that holds out or stays as a whole
    ranked = blocks.withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
    wanted = max(1, round(blocks.count() * share))
    chosen = ranked.select(key, (F.col("_r") <= wanted).alias("held_out"))
    return zones.select(zone, *([block] if block else [])).distinct().join(chosen, key).select(zone, "held_out")


def fit_linear(rows: DataFrame, target: str, features: list[str]) -> list[float]:
    """Least-squares coefficients (intercept first) from the sums of products; of many solutions the shortest."""
    names = ["_one", *features]
    known = rows.where(F.col(target).isNotNull()).withColumn("_one", F.lit(1.0))
    for f in features:
        known = known.where(F.col(f).isNotNull())
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = known.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in pairs), *(F.sum(F.col(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(names))).first()
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    for i, j in pairs:
        a[i, j] = a[j, i] = got[f"x{i}_{j}"] or 0.0
    for i in range(len(names)):
        b[i] = got[f"y{i}"] or 0.0
    return np.linalg.lstsq(a, b, rcond=None)[0].tolist()


def predict_linear(coefficients: list[float], features: list[str]) -> Column:
    out = F.lit(coefficients[0])
    for c, f in zip(coefficients[1:], features, strict=True):
        out = out + F.lit(c) * F.col(f)
    return out


def spatial_holdout(alpha: DataFrame, attributes: DataFrame, features: list[str], zone: str = "catchment_id", block: str | None = "block", share: float = 0.2, seed: int = 0) -> DataFrame:
    """(zone, alpha, predicted, abs_error, rel_error) of the held-out zones, from a regression on the others."""
    rows = alpha.where("alpha is not null").select(zone, "alpha").join(attributes, zone)
    marked = rows.join(holdout_split(rows, zone, block, share, seed), zone)
    c = fit_linear(marked.where("not held_out"), "alpha", features)
    test = marked.where("held_out").withColumn("predicted", predict_linear(c, features))
    error = F.col("predicted") - F.col("alpha")
    return test.select(zone, "alpha", "predicted", F.abs(error).alias("abs_error"), ratio(F.abs(error), F.abs(F.col("alpha"))).alias("rel_error"))


def holdout_summary(report: DataFrame) -> DataFrame:
    e = F.col("abs_error")
    return report.agg(F.count("*").alias("n"), F.median(e).alias("median_abs_error"), F.median("rel_error").alias("median_rel_error"), F.sqrt(F.avg(e * e)).alias("rmse"))


def passes(csi: Column) -> Column:
    return ~yes(csi < CSI_GATE)
