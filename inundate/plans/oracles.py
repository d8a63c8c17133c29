"""SQL for the queries: independent formulations that an ANSI engine runs over the same tables."""

from __future__ import annotations

import re

from ..sources import fixtures as fx
from . import queries as q

CELLS = f"cells AS ({fx.as_sql(fx.CELLS, 'lineitem')})"


def r(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0e0 AS {name or expr}"


def statement(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


def curve_ctes(p: str, src: str, zone: str, datum: str, anchored: bool = True, steps: int = 20, area: float = 1.0) -> list[str]:
    last = steps - 1
    top = f"coalesce(max(a.stage) * 1.5e0, max({datum}))" if anchored else f"max({datum})"
    return [
        f"{p}_anchor AS (SELECT {zone} AS z, quantile_cont(d100 + {datum}, 0.5e0) AS stage FROM {src} WHERE {zone} > 0 AND d100 > 0 AND {datum} IS NOT NULL GROUP BY 1)",
        f"{p}_tops AS (SELECT s.{zone} AS z, greatest({top}, 1e-6) AS h_max FROM {src} s LEFT JOIN {p}_anchor a ON a.z = s.{zone} WHERE s.{zone} > 0 AND {datum} IS NOT NULL GROUP BY 1)",
        f"{p}_steps AS (SELECT z, i, CASE WHEN i = 0 THEN 0e0 WHEN i = {last} THEN h_max ELSE i * (h_max / {last}) END AS h FROM {p}_tops, range({steps}) t(i))",
        f"""{p}_curve AS (SELECT t.z, t.i, t.h, (t.h * count(s.{datum}) - coalesce(sum(s.{datum}), 0e0)) * {area}e0 AS volume, count(s.{datum}) * {area}e0 AS area
          FROM {p}_steps t LEFT JOIN {src} s ON s.{zone} = t.z AND s.{datum} < t.h GROUP BY 1, 2, 3)""",
    ]


def stage_ctes(p: str, src: str, zone: str, alpha: str = "alpha", where: str = "TRUE", rain: str = "rain_pp") -> list[str]:
    """Scenario stages; needs the curves."""
    return [
        f"""{p}_zone AS (SELECT {zone} AS z, sum(d100) AS v_obs, avg(rain_p100) * count(*) AS v_rain, avg({rain}) AS pp, CAST(count(*) AS DOUBLE) AS area,
          CASE WHEN avg(rain_p100) * count(*) > 0 THEN sum(d100) / (avg(rain_p100) * count(*)) END AS alpha FROM {src} WHERE {zone} > 0 GROUP BY 1)""",
        f"{p}_target AS (SELECT z, {alpha} * pp * area AS v FROM {p}_zone WHERE {where})",
        f"""{p}_lo AS (SELECT t.z, t.v, max(c.i) FILTER (c.volume <= t.v) AS lo, max(c.i) AS n, min(c.volume) AS v0, max(c.volume) AS v1
          FROM {p}_target t LEFT JOIN {p}_curve c USING (z) GROUP BY 1, 2)""",
        f"""{p}_stage AS (SELECT l.z, l.v, CASE WHEN l.v IS NULL OR l.n IS NULL THEN NULL WHEN l.lo IS NULL THEN 0e0 WHEN l.lo = l.n OR a.volume = l.v THEN a.h
          ELSE a.h + (l.v - a.volume) * ((b.h - a.h) / (b.volume - a.volume)) END AS stage, coalesce(l.v < l.v0 OR l.v > l.v1, FALSE) AS extrapolated
          FROM {p}_lo l LEFT JOIN {p}_curve a ON a.z = l.z AND a.i = l.lo LEFT JOIN {p}_curve b ON b.z = l.z AND b.i = l.lo + 1)""",
    ]


SUMS = "{}, count(*) FILTER (depth > 0) AS n_wet, count(*) FILTER (depth IS NULL) AS n_unknown, count(*) AS n".format(r("sum(depth)", "depth_sum"))
FLUVIAL = [CELLS, *curve_ctes("f", "cells", "catchment_id", "hand"), *stage_ctes("f", "cells", "catchment_id")]


def kept(src: str = "cells") -> list[str]:
    return [
        f"large AS (SELECT depression_id AS d FROM {src} WHERE depression_id > 0 GROUP BY 1 HAVING count(*) >= {q.MIN_CELLS})",
        f"flat AS (SELECT s.* REPLACE (CASE WHEN d IS NULL THEN 0 ELSE depression_id END AS depression_id) FROM {src} s LEFT JOIN large ON d = depression_id)",
        "deep AS (SELECT *, CASE WHEN depression_id > 0 THEN dem - min(dem) OVER (PARTITION BY depression_id) END AS hd FROM flat)",
    ]


def both(src: str = "cells") -> list[str]:
    return [
        *kept(src), *curve_ctes("f", "deep", "catchment_id", "hand"), *stage_ctes("f", "deep", "catchment_id"),
        *curve_ctes("p", "deep", "depression_id", "hd"), *stage_ctes("p", "deep", "depression_id"),
        """paired AS (SELECT deep.*, CASE WHEN f.stage IS NOT NULL AND hand IS NOT NULL THEN greatest(f.stage - hand, 0e0) END AS fd, coalesce(f.extrapolated, FALSE) AS fe,
          CASE WHEN p.stage IS NOT NULL AND hd IS NOT NULL THEN greatest(p.stage - hd, 0e0) END AS pd, coalesce(p.extrapolated, FALSE) AS pe
          FROM deep LEFT JOIN f_stage f ON f.z = catchment_id LEFT JOIN p_stage p ON p.z = depression_id)""",
    ]


H100 = [
    CELLS,
    "h AS (SELECT catchment_id, quantile_cont(d100 + hand, 0.5e0) AS h100, quantile_cont(d100 + hand, 0.75e0) - quantile_cont(d100 + hand, 0.25e0) AS h100_iqr FROM cells WHERE catchment_id > 0 AND d100 > 0 AND hand IS NOT NULL GROUP BY 1)",
    "rec AS (SELECT c.*, h.h100, CASE WHEN h.h100 IS NOT NULL AND hand IS NOT NULL THEN greatest(h.h100 - hand, 0e0) END AS recon FROM cells c LEFT JOIN h ON h.catchment_id = c.catchment_id)",
]


def csi(t: str) -> str:
    o, k = f"d100 > {t}", f"coalesce(recon > {t}, FALSE)"
    return f"count(*) FILTER ({o} AND {k}) / nullif(CAST(count(*) FILTER ({o} OR {k}) AS DOUBLE), 0)"


QC = """qc AS (SELECT catchment_id, {} AS c15, {} AS c30, {} AS c50, {} AS c100,
  CASE WHEN count(*) FILTER (d100 > 0 AND recon IS NULL) = 0 THEN sqrt(avg((d100 - recon) * (d100 - recon)) FILTER (d100 > 0 OR recon > 0)) END AS rmse,
  count(*) FILTER (recon > 0) / nullif(CAST(count(*) FILTER (d100 > 0) AS DOUBLE), 0) AS area_ratio, max(h100) AS h100
  FROM rec WHERE h100 IS NOT NULL GROUP BY 1)""".format(*map(csi, ("0.15e0", "0.3e0", "0.5e0", "1e0")))
CHECK = "ck AS (SELECT h.catchment_id, d.v_direct, k.v_curve, CASE WHEN d.v_direct > 0 THEN abs(k.v_curve - d.v_direct) / d.v_direct END AS rel FROM h JOIN (SELECT catchment_id, sum(d100) AS v_direct FROM cells GROUP BY 1) d USING (catchment_id) LEFT JOIN fwd k ON k.z = h.catchment_id)"
FORWARD = [
    "flo AS (SELECT h.catchment_id AS z, h.h100 AS x, max(c.i) FILTER (c.h <= h.h100) AS lo, max(c.i) AS n FROM h LEFT JOIN f_curve c ON c.z = h.catchment_id GROUP BY 1, 2)",
    """fwd AS (SELECT l.z, l.x, CASE WHEN l.n IS NULL THEN NULL WHEN l.lo IS NULL THEN c0.volume WHEN l.lo = l.n OR a.h = l.x THEN a.volume
      ELSE a.volume + (l.x - a.h) * ((b.volume - a.volume) / (b.h - a.h)) END AS v_curve
      FROM flo l LEFT JOIN f_curve a ON a.z = l.z AND a.i = l.lo LEFT JOIN f_curve b ON b.z = l.z AND b.i = l.lo + 1 LEFT JOIN f_curve c0 ON c0.z = l.z AND c0.i = 0)""",
]
H_CURVE = [*H100, *curve_ctes("f", "cells", "catchment_id", "hand"), *FORWARD]

MAXIMA = "m AS (SELECT CAST(user_id AS BIGINT) AS s, CAST(ts AS DATE) AS d, max(value) AS x FROM events GROUP BY 1, 2)"
MOMENTS = [
    MAXIMA,
    "o AS (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM m WHERE x IS NOT NULL)",
    "b AS (SELECT s, n, avg(x) AS b0, sum(i * x) / nullif(n * (n - 1), 0) AS b1, sum(i * (i - 1) * x) / nullif(n * (n - 1) * (n - 2), 0) AS b2 FROM o GROUP BY 1, 2)",
    "l AS (SELECT s, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, (6 * b2 - 6 * b1 + b0) / nullif(2 * b1 - b0, 0) AS t3 FROM b WHERE n >= 3)",
]
REGION = "g AS (SELECT 1 + s % 4 AS region_id, sum(n * (l2 / l1)) / sum(n) AS lcv, sum(n * t3) / sum(n) AS t3, count(*) AS n_stations FROM l WHERE t3 IS NOT NULL AND l1 <> 0 GROUP BY 1)"


def fit_ctes(src: str, key: str, l1: str, l2: str) -> list[str]:
    c = "(2 / (3 + t3) - ln(2) / ln(3))"
    return [
        f"fk AS (SELECT {key}, {l1} AS l1, {l2} AS l2, 7.8590e0 * {c} + 2.9554e0 * {c} * {c} AS k FROM {src} WHERE t3 IS NOT NULL)",
        "fs AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN l2 / ln(2) ELSE l2 * k / ((1 - pow(2e0, -k)) * gamma(1 + k)) END AS scale FROM fk)",
        f"fit AS (SELECT {key}, CASE WHEN abs(k) < 1e-6 THEN l1 - 0.5772156649015329e0 * scale ELSE l1 - scale * (1 - gamma(1 + k)) / k END AS loc, scale, CASE WHEN abs(k) < 1e-6 THEN 0e0 ELSE k END AS shape FROM fs)",
    ]


def level(t: float) -> str:
    y = f"(-ln(1 - 1 / {t}e0))"
    return f"(CASE WHEN abs(shape) < 1e-8 THEN loc - scale * ln({y}) ELSE loc + scale / shape * (1 - pow({y}, shape)) END)"


GROWTH = [*MOMENTS, REGION, *fit_ctes("g", "region_id", "1e0", "lcv")]
DELTAS = "dl AS (SELECT CAST(n_nationkey AS BIGINT) AS region_id, ((n_nationkey * 7 + model * 13) % 41) - 10e0 AS d, 1e0 + (n_nationkey % 5) * 0.5e0 AS w FROM nation, range(1, 8) t(model))"
CLIMATE = "cl AS (SELECT region_id, 1 + least(greatest(quantile_cont(d, 0.5e0), -max(w) * 7e0), max(w) * 7e0) / 100 AS climate, stddev_pop(d) AS model_spread FROM dl GROUP BY 1)"
MULTIPLIER = f"mu AS (SELECT region_id, {level(q.PERIOD)} / {level(100.0)} AS x FROM fit)"


def events(depth: str) -> list[str]:
    return [
        CELLS,
        f"pairs AS (SELECT event, {depth} AS depth, {fx.OBSERVED} AS observed FROM cells)",
        "hits AS (SELECT event, t AS threshold, count(*) FILTER (depth > t AND observed) AS h, count(*) FILTER (NOT depth > t AND observed) AS m, count(*) FILTER (depth > t AND NOT observed) AS f FROM pairs, (VALUES (0.15e0), (0.3e0), (0.5e0), (1e0)) v(t) WHERE depth IS NOT NULL GROUP BY 1, 2)",
    ]


ATTRIBUTES = "att AS (SELECT CAST(s_suppkey AS BIGINT) AS z, CAST(s_suppkey % 20 AS DOUBLE) AS level, CAST(s_nationkey AS BIGINT) AS block FROM supplier)"


def split(src: str) -> list[str]:
    return [
        f"blocks AS (SELECT block, row_number() OVER (ORDER BY md5(CAST(block AS VARCHAR) || ':0'), block) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM {src}))",
        f"split AS (SELECT z, k <= greatest(1, round_even(n * 0.2e0, 0)) AS held_out FROM {src} JOIN blocks USING (block))",
    ]


HOLDOUT = [
    *FLUVIAL, ATTRIBUTES, "al AS (SELECT f.z, f.alpha, att.level, att.block FROM f_zone f JOIN att USING (z) WHERE f.alpha IS NOT NULL)", *split("al"),
    "co AS (SELECT regr_slope(alpha, level) AS s, regr_intercept(alpha, level) AS i FROM al JOIN split USING (z) WHERE NOT held_out)",
    "rep AS (SELECT al.z AS catchment_id, alpha, i + s * level AS predicted, abs(i + s * level - alpha) AS e, abs(i + s * level - alpha) / nullif(abs(alpha), 0) AS rel FROM al JOIN split USING (z), co WHERE held_out)",
]


def grid(amplitude: int = fx.AMPLITUDE_SMOOTH) -> str:
    return f"grid AS ({fx.as_sql(fx.GRID | {'z': fx.elevation(amplitude)}, 'part')})"


POINTERS = """drops AS (SELECT a.cell, b.cell AS down, (a.z - b.z) / sqrt(CAST((b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c) AS DOUBLE)) AS slope, (b.r - a.r + 1) * 3 + b.c - a.c + 1 AS k
  FROM grid a JOIN grid b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND b.cell <> a.cell AND a.z > b.z),
ptr AS (SELECT g.cell, coalesce(d.down, g.cell) AS down FROM grid g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY slope DESC, k) AS n FROM drops) d ON d.cell = g.cell AND d.n = 1)"""
DRAINED = [
    grid(), POINTERS,
    "walk AS (SELECT cell AS src, cell AS cur FROM ptr UNION ALL SELECT w.src, p.down FROM walk w JOIN ptr p ON p.cell = w.cur WHERE p.down <> p.cell)",
    "acc AS (SELECT cur AS cell, count(*) AS acc FROM walk GROUP BY 1)",
    f"st AS (SELECT cell FROM acc WHERE acc >= {q.STREAM})",
    "down_to AS (SELECT cell AS src, cell AS cur FROM ptr UNION ALL SELECT w.src, p.down FROM down_to w JOIN ptr p ON p.cell = w.cur WHERE p.down <> p.cell AND w.cur NOT IN (SELECT cell FROM st))",
    "reach AS (SELECT src AS cell, cur AS terminal FROM down_to WHERE cur IN (SELECT cell FROM st))",
    "ups AS (SELECT st.cell, count(p.cell) AS n, min(p.cell) AS up FROM st LEFT JOIN (SELECT * FROM ptr WHERE down <> cell AND cell IN (SELECT cell FROM st)) p ON p.down = st.cell GROUP BY 1)",
    "climb AS (SELECT cell, cell AS cur FROM st UNION ALL SELECT c.cell, u.up FROM climb c JOIN ups u ON u.cell = c.cur WHERE u.n = 1)",
    "link AS (SELECT c.cell, c.cur + 1 AS link_id FROM climb c JOIN ups u ON u.cell = c.cur WHERE u.n <> 1)",
]
def carved(amplitude: int, reach: int | None = None) -> list[str]:
    """The breach of a grid g0: pointers ptr and terrain grid.  Levels come by as many relaxations as there are basins."""
    near = "" if reach is None else f" AND t IN (SELECT t FROM pth JOIN lab USING (cell) GROUP BY 1 HAVING count(*) <= {reach})"
    return [
        grid(amplitude).replace("grid AS", "g0 AS", 1), re.sub(r"\bgrid\b", "g0", re.sub(r"\bptr\b", "p0", POINTERS)),
        "w0 AS (SELECT cell AS src, cell AS cur FROM p0 UNION ALL SELECT w.src, p.down FROM w0 w JOIN p0 p ON p.cell = w.cur WHERE p.down <> p.cell)",
        "lab AS (SELECT g0.*, cur AS t FROM g0 JOIN w0 ON src = g0.cell JOIN p0 ON p0.cell = cur AND p0.down = cur)",
        "nb AS (SELECT a.cell, a.t, a.z, b.cell AS over, b.t AS other, b.z AS zn FROM lab a JOIN lab b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND b.cell <> a.cell)",
        "rim AS (SELECT t, min(z) AS w, arg_min(cell, (z, cell)) AS cell FROM lab WHERE cell NOT IN (SELECT cell FROM nb GROUP BY 1 HAVING count(*) = 8) GROUP BY 1)",
        "pass AS (SELECT t, other, w, cell, over FROM (SELECT t, other, greatest(z, zn) AS w, cell, over, row_number() OVER (PARTITION BY t, other ORDER BY greatest(z, zn), cell, over) AS n FROM nb WHERE other <> t) WHERE n = 1)",
        "edge AS (SELECT t, other, w FROM pass UNION ALL SELECT t, -1, w FROM rim UNION ALL SELECT -1, -1, CAST('-inf' AS DOUBLE))",
        "lv AS (SELECT -1 AS t, CAST('-inf' AS DOUBLE) AS level, 0 AS i UNION ALL SELECT e.t, min(greatest(e.w, l.level)), l.i + 1 FROM lv l JOIN edge e ON e.other = l.t WHERE l.i <= (SELECT count(DISTINCT t) FROM lab) GROUP BY e.t, l.i)",
        "lev AS (SELECT t, level FROM lv WHERE i = (SELECT max(i) FROM lv))",
        "tight AS (SELECT e.t, e.other FROM edge e JOIN lev a ON a.t = e.t JOIN lev b ON b.t = e.other WHERE e.t <> -1 AND greatest(e.w, b.level) = a.level)",
        "hp AS (SELECT -1 AS t, 0 AS h UNION SELECT k.t, h + 1 FROM hp JOIN tight k ON k.other = hp.t WHERE h <= (SELECT count(DISTINCT t) FROM lab))",
        "hops AS (SELECT t, min(h) AS h FROM hp GROUP BY 1)",
        "nxt AS (SELECT k.t, min(k.other) AS other FROM tight k JOIN hops a ON a.t = k.t JOIN hops b ON b.t = k.other AND a.h = b.h + 1 GROUP BY 1)",
        "heads0 AS (SELECT t, cell, over FROM nxt JOIN pass USING (t, other) UNION ALL SELECT t, cell, cell FROM nxt JOIN rim USING (t) WHERE other = -1)",
        "pth AS (SELECT cell FROM heads0 UNION SELECT p.down FROM pth JOIN p0 p USING (cell) WHERE p.down <> p.cell)",
        f"way AS (SELECT cell, t FROM pth JOIN lab USING (cell) WHERE TRUE{near})",
        f"turn AS (SELECT down AS cell, cell AS back FROM way JOIN p0 USING (cell) WHERE down <> cell UNION ALL SELECT cell, over FROM heads0 WHERE TRUE{near})",
        "ptr AS (SELECT p0.cell, coalesce(back, down) AS down FROM p0 LEFT JOIN turn USING (cell))",
        "w1 AS (SELECT cell AS src, cell AS cur FROM ptr UNION ALL SELECT w.src, p.down FROM w1 w JOIN ptr p ON p.cell = w.cur WHERE p.down <> p.cell)",
        "grid AS (SELECT g0.* REPLACE (low AS z) FROM g0 JOIN (SELECT cur AS cell, min(z) AS low FROM w1 JOIN g0 ON g0.cell = src GROUP BY 1) USING (cell))",
    ]


def flooded(src: str) -> list[str]:
    """The filled level of every cell: as many relaxations as a way out may take on these grids."""
    return [
        f"nbr AS (SELECT a.cell, b.cell AS over FROM {src} a JOIN {src} b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND b.cell <> a.cell)",
        "inner_ AS (SELECT cell FROM nbr GROUP BY 1 HAVING count(*) = 8)",
        f"fl AS (SELECT cell, CASE WHEN cell IN (SELECT cell FROM inner_) THEN CAST('inf' AS DOUBLE) ELSE z END AS w, 0 AS i FROM {src} UNION ALL (SELECT cell, w, i FROM (SELECT n.cell, greatest(g.z, min(f.w)) AS w, f.i + 1 AS i FROM fl f JOIN nbr n ON n.over = f.cell JOIN {src} g ON g.cell = n.cell WHERE f.i < 250 AND n.cell IN (SELECT cell FROM inner_) GROUP BY n.cell, g.z, f.i UNION ALL SELECT f.cell, f.w, f.i + 1 FROM fl f WHERE f.i < 250 AND f.cell NOT IN (SELECT cell FROM inner_))))",
        "filled AS (SELECT cell, w AS filled FROM fl WHERE i = 250)",
    ]


BLOCK_GRID = [grid(fx.AMPLITUDE_ROUGH), f"blk AS (SELECT *, {q.BLOCKS} AS depression_id FROM grid)", "pour AS (SELECT * FROM (SELECT depression_id, cell, z, row_number() OVER (PARTITION BY depression_id ORDER BY z, r, c) AS n FROM blk WHERE depression_id > 0) WHERE n = 1)"]


def ring_sql(x: str, y: str) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(q.RING, [*q.RING[1:], q.RING[0]], strict=True):
        if y1 != y2:
            parts.append(f"CASE WHEN (({y1}e0 > {y}) <> ({y2}e0 > {y})) AND {x} < {x1}e0 + ({y} - {y1}e0) * ({(x2 - x1) / (y2 - y1)!r}) THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


TILES = "tl AS (SELECT tile, {} FROM (SELECT CAST(n_nationkey AS BIGINT) AS tile FROM nation)), hit AS (SELECT * FROM tl WHERE xmin < 5e0 AND xmax > 2.2e0 AND ymin < 4e0 AND ymax > 1e0)".format(", ".join(f"{e} AS {n}" for n, e in fx.TILE.items()))
CURVE_OUT = f"CAST(i AS BIGINT) AS step, {r('h')}, {r('volume')}, {r('area')}"
STAGE_OUT = f"{r('v', 'volume')}, {r('stage')}, extrapolated"
REGIME = "CASE WHEN coalesce(hand < 3, FALSE) OR coalesce(flow_acc >= 500, FALSE) THEN 0 ELSE 1 END"
LINES = "ln AS (SELECT * FROM (VALUES {}) v(label, ord, r1, c1, r2, c2))".format(", ".join("({}, {}, {}e0, {}e0, {}e0, {}e0)".format(*x) for x in q.LINES))

ORACLES: dict[str, str] = {
    "anchor_stage": statement([CELLS, *curve_ctes("f", "cells", "catchment_id", "hand")[:1]], f"SELECT z AS catchment_id, {r('stage')} FROM f_anchor"),
    "h100_iqr": statement(H100, f"SELECT catchment_id, {r('h100')}, {r('h100_iqr')} FROM h"),
    "stage_curves": statement([CELLS, *curve_ctes("f", "cells", "catchment_id", "hand")], f"SELECT z AS catchment_id, {CURVE_OUT} FROM f_curve"),
    "curves_without_anchor": statement([CELLS, *curve_ctes("f", "cells", "catchment_id", "hand", False, 8, 2.5)], f"SELECT z AS catchment_id, {CURVE_OUT} FROM f_curve"),
    "curve_monotonic": statement(
        [CELLS, *curve_ctes("f", "cells", "catchment_id", "hand"), "bent AS (SELECT z, i, volume - CASE WHEN i = 7 AND z % 10 = 0 THEN 1e6 ELSE 0 END AS v, area AS a FROM f_curve)"],
        "SELECT DISTINCT x.z AS catchment_id FROM bent x JOIN bent y ON x.z = y.z AND y.i = x.i + 1 WHERE y.v - x.v < -1e-9 OR y.a - x.a < -1e-9",
    ),
    "invert_stage": statement(FLUVIAL, f"SELECT z AS catchment_id, {STAGE_OUT} FROM f_stage"),
    "volume_at_stage": statement(H_CURVE, f"SELECT z AS catchment_id, {r('h.h100', 'h100')}, {r('h.h100_iqr', 'h100_iqr')}, {r('v_curve', 'volume')} FROM fwd JOIN h ON h.catchment_id = z"),
    "reconstruct_depth": statement(
        H100, f"SELECT catchment_id, {r('sum(recon)', 'depth_sum')}, count(*) FILTER (recon > 0) AS n_wet, count(*) FILTER (recon IS NULL) AS n_unknown, count(*) AS n FROM rec GROUP BY 1"
    ),
    "reconstruction_qc": statement(
        [*H100, QC],
        f"SELECT qc.catchment_id, {r('c15', 'csi_0_15')}, {r('c30', 'csi_0_3')}, {r('c50', 'csi_0_5')}, {r('c100', 'csi_1_0')}, {r('rmse')}, {r('area_ratio')}, {r('h.h100', 'h100')}, {r('h.h100_iqr', 'h100_iqr')}, coalesce(c30 < 0.8e0, FALSE) AS flag_low_csi FROM qc JOIN h USING (catchment_id)",
    ),
    "cross_check_volume": statement([*H_CURVE, CHECK], f"SELECT catchment_id, {r('v_direct')}, {r('v_curve')}, {r('rel', 'rel_diff')}, coalesce(rel > 0.05e0, FALSE) AS flag_volume_mismatch FROM ck"),
    "calibrate_alpha": statement(FLUVIAL, f"SELECT z AS catchment_id, {r('v_obs')}, {r('v_rain')}, {r('alpha')}, NOT coalesce(alpha BETWEEN 0.05e0 AND 0.4e0, FALSE) AS flag_alpha_out_of_range FROM f_zone"),
    "calibration_table": statement(
        [*H100, QC, *curve_ctes("f", "cells", "catchment_id", "hand"), *stage_ctes("f", "cells", "catchment_id")],
        f"SELECT coalesce(a.z, c.catchment_id) AS catchment_id, {r('v_obs')}, {r('v_rain')}, {r('alpha')}, flag_alpha_out_of_range, {r('rmse')}, flag_low_csi FROM (SELECT *, NOT coalesce(alpha BETWEEN 0.05e0 AND 0.4e0, FALSE) AS flag_alpha_out_of_range FROM f_zone) a FULL JOIN (SELECT catchment_id, rmse, coalesce(c30 < 0.8e0, FALSE) AS flag_low_csi FROM qc) c ON c.catchment_id = a.z",
    ),
    "zone_rain_and_area": statement(
        [CELLS],
        f"SELECT catchment_id, {r('avg(rain_p100) FILTER (hand IS NOT NULL)', 'mean_known')}, {r('CASE WHEN count(hand) = count(*) THEN avg(rain_p100) END', 'mean_strict')}, {r('count(*) * 2.5e0', 'area')} FROM cells WHERE catchment_id > 0 GROUP BY 1",
    ),
    "channel_ratio": statement([CELLS], f"SELECT catchment_id, {r('quantile_cont(d100 / rain_p100, 0.5e0)', 'k')} FROM cells WHERE catchment_id > 0 AND d100 > 0 AND rain_p100 > 0 AND NOT depression_id > 0 GROUP BY 1"),
    "render_channel_ratio": statement(
        [
            CELLS,
            "k AS (SELECT catchment_id AS z, quantile_cont(d100 / rain_p100, 0.5e0) AS k FROM cells WHERE catchment_id > 0 AND d100 > 0 AND rain_p100 > 0 GROUP BY 1)",
            "d AS (SELECT catchment_id, CASE WHEN d100 > 0 THEN k * rain_pp ELSE 0 END AS depth FROM cells LEFT JOIN k ON z = catchment_id)",
        ],
        f"SELECT catchment_id, {SUMS} FROM d GROUP BY 1",
    ),
    "render_naive": statement(
        [
            CELLS,
            "w AS (SELECT catchment_id, d100, rain_pp, CASE WHEN linenumber <> 3 THEN rain_p100 ELSE 0e0 END AS p FROM cells)",
            "d AS (SELECT catchment_id, CASE WHEN d100 > 0 THEN CASE WHEN p > 0 THEN d100 / p * rain_pp END ELSE 0 END AS depth FROM w)",
        ],
        f"SELECT catchment_id, {SUMS} FROM d GROUP BY 1",
    ),
    "render_fluvial": statement(
        [
            *FLUVIAL,
            "d AS (SELECT catchment_id, CASE WHEN stage IS NOT NULL AND hand IS NOT NULL THEN greatest(stage - hand, 0e0) END AS depth, coalesce(extrapolated, FALSE) AS e FROM cells LEFT JOIN f_stage ON z = catchment_id)",
        ],
        f"SELECT catchment_id, {SUMS}, count(*) FILTER (e) AS n_extrapolated FROM d GROUP BY 1",
    ),
    "render_pluvial": statement([CELLS, *both()], f"SELECT depression_id, {SUMS}, count(*) FILTER (pe) AS n_extrapolated FROM (SELECT *, pd AS depth FROM paired) GROUP BY 1"),
    "render_depth_depression": statement(
        [CELLS, *both(), *[x.replace("FROM cells c", "FROM deep c") for x in H100[1:]], QC],
        f"""SELECT catchment_id, {SUMS}, count(*) FILTER (e) AS n_extrapolated, count(*) FILTER (e OR low OR (rain_p100 > 0 AND (rain_pp = 0 OR (rain_pp > 0 AND abs(ln(rain_pp / rain_p100)) > ln(2e0))))) AS n_low_confidence
          FROM (SELECT b.*, CASE WHEN depression_id > 0 THEN pd ELSE fd END AS depth, CASE WHEN depression_id > 0 THEN pe ELSE fe END AS e, coalesce(c30 < 0.8e0, FALSE) AS low FROM paired b LEFT JOIN qc USING (catchment_id)) GROUP BY 1""",
    ),
    "render_depth_regime": statement(
        [CELLS, *both()],
        f"SELECT catchment_id, CAST(regime AS BIGINT) AS regime, {SUMS}, count(*) FILTER (e) AS n_extrapolated FROM (SELECT *, CASE WHEN regime = 0 THEN fd ELSE pd END AS depth, CASE WHEN regime = 0 THEN fe ELSE pe END AS e FROM (SELECT *, {REGIME} AS regime FROM paired)) GROUP BY 1, 2",
    ),
    "render_regime_confidence": statement(
        [CELLS, *both()],
        f"SELECT catchment_id, CAST(regime AS BIGINT) AS regime, {SUMS}, count(*) FILTER (e) AS n_extrapolated, count(*) FILTER (abs(ln(rain_pp / rain_p100)) > ln(2e0) OR slope > 0.15e0 OR urban OR coastal) AS n_low_confidence FROM (SELECT *, CASE WHEN regime = 0 THEN fd ELSE pd END AS depth, CASE WHEN regime = 0 THEN fe ELSE pe END AS e FROM (SELECT *, {REGIME} AS regime FROM paired)) GROUP BY 1, 2",
    ),
    "run_scenario": statement(
        [
            CELLS, *GROWTH, DELTAS, CLIMATE, MULTIPLIER, "sm AS (SELECT mu.region_id, mu.x * cl.climate AS x FROM mu JOIN cl USING (region_id))",
            "wet AS (SELECT cells.* REPLACE (rain_p100 * sm.x AS rain_pp) FROM cells LEFT JOIN sm USING (region_id))", *both("wet"),
        ],
        f"SELECT catchment_id, {SUMS}, count(*) FILTER (e) AS n_extrapolated FROM (SELECT *, CASE WHEN depression_id > 0 THEN pd ELSE fd END AS depth, CASE WHEN depression_id > 0 THEN pe ELSE fe END AS e FROM paired) GROUP BY 1",
    ),
    "holdout_render": statement(
        [
            CELLS, *curve_ctes("f", "cells", "catchment_id", "hand"), *stage_ctes("f", "cells", "catchment_id", "(alpha * 1.25e0)", "z % 5 = 1"),
            "d AS (SELECT CASE WHEN catchment_id > 0 AND catchment_id % 5 = 1 THEN catchment_id ELSE 0 END AS catchment_id, CASE WHEN stage IS NOT NULL AND hand IS NOT NULL THEN greatest(stage - hand, 0e0) END AS depth FROM cells LEFT JOIN f_stage ON z = catchment_id)",
        ],
        f"SELECT catchment_id, {SUMS} FROM d GROUP BY 1",
    ),
    "low_confidence_regime": statement(
        [CELLS, "d AS (SELECT *, abs(ln(rain_pp / rain_p100)) > ln(2e0) AS far FROM cells)"],
        "SELECT catchment_id, count(*) FILTER (far OR slope > 0.15e0 OR urban OR coastal) AS n_low, count(*) FILTER (far) AS n_rain_only, count(*) AS n_short FROM d GROUP BY 1",
    ),
    "rain_departure": statement(
        [CELLS, "d AS (SELECT catchment_id, CASE linenumber WHEN 1 THEN 0e0 WHEN 2 THEN -1e0 WHEN 3 THEN NULL ELSE rain_pp END AS p, CASE linenumber WHEN 4 THEN 0e0 ELSE rain_p100 END AS a FROM cells)"],
        "SELECT catchment_id, count(*) FILTER (a > 0 AND (p = 0 OR (p > 0 AND (p / a > 2e0 OR p / a < 0.5e0)))) AS n_departs FROM d GROUP BY 1",
    ),
    "classify_regime": statement([CELLS], f"SELECT catchment_id, CAST({REGIME} AS BIGINT) AS regime, count(*) AS n FROM cells GROUP BY 1, 2"),
    "regime_summary": statement([CELLS, f"d AS (SELECT {REGIME} AS g FROM cells)"], f"SELECT {r('count(*) FILTER (g = 0) / CAST(count(*) AS DOUBLE)', 'fluvial')}, {r('count(*) FILTER (g = 1) / CAST(count(*) AS DOUBLE)', 'pluvial')} FROM d"),
    "relative_elevation": statement(
        [CELLS, "d AS (SELECT depression_id, CASE WHEN depression_id > 0 THEN dem - min(dem) OVER (PARTITION BY depression_id) END AS hd FROM cells)"],
        f"SELECT depression_id, {r('sum(hd)', 'hd_sum')}, {r('max(hd)', 'hd_max')}, count(hd) AS n FROM d GROUP BY 1",
    ),
    "depression_filter": statement([CELLS, *kept()], "SELECT depression_id, count(*) AS n FROM flat GROUP BY 1"),
    "depression_curves": statement([CELLS, *kept(), *curve_ctes("p", "deep", "depression_id", "hd")], f"SELECT z AS depression_id, {CURVE_OUT} FROM p_curve"),
    "depression_alpha": statement(
        [CELLS, *kept(), *curve_ctes("p", "deep", "depression_id", "hd"), *stage_ctes("p", "deep", "depression_id")],
        f"SELECT z AS depression_id, {r('v_obs')}, {r('v_rain')}, {r('alpha')}, NOT coalesce(alpha BETWEEN 0.05e0 AND 0.4e0, FALSE) AS flag_alpha_out_of_range FROM p_zone",
    ),
    "modal_snap": statement(
        [
            CELLS,
            "pr AS (SELECT catchment_id AS z, CASE WHEN depression_id % 30 = 0 THEN depression_id % 70 ELSE 0 END AS label FROM cells)",
            "best AS (SELECT z, label FROM (SELECT z, label, row_number() OVER (PARTITION BY z ORDER BY count(*) DESC, label) AS n FROM pr WHERE z > 0 AND label > 0 GROUP BY z, label) WHERE n = 1)",
        ],
        "SELECT z AS catchment_id, coalesce(best.label, z + (SELECT max(label) + 1 FROM pr)) AS label FROM (SELECT DISTINCT z FROM pr WHERE z > 0) LEFT JOIN best USING (z)",
    ),
    "l_moments": statement(
        MOMENTS, f"SELECT b.s AS station_id, b.n, {r('l.l1', 'l1')}, {r('l.l2', 'l2')}, {r('l.l3', 'l3')}, {r('l.t3', 't3')} FROM b LEFT JOIN l ON l.s = b.s"
    ),
    "regional_moments": statement([*MOMENTS, REGION], f"SELECT region_id, {r('lcv')}, {r('t3')}, n_stations FROM g"),
    "gev_fit": statement([*MOMENTS, *fit_ctes("l", "s", "l1", "l2")], f"SELECT s AS station_id, {r('loc')}, {r('scale')}, {r('shape')} FROM fit"),
    "growth_curves": statement(GROWTH, f"SELECT region_id, {r('loc')}, {r('scale')}, {r('shape')} FROM fit"),
    "growth_factor": statement(GROWTH, f"SELECT region_id, CAST(NULL AS DOUBLE) AS t1, {r(level(2.0), 't2')}, {r(level(25.0), 't25')}, {r(level(100.0), 't100')}, {r(level(500.0), 't500')} FROM fit"),
    "period_multiplier": statement([*GROWTH, MULTIPLIER], f"SELECT region_id, {r('x', 'multiplier')} FROM mu"),
    "climate_multiplier": statement([DELTAS, CLIMATE], f"SELECT region_id, {r('climate')}, {r('model_spread')} FROM cl"),
    "scenario_multiplier": statement([*GROWTH, DELTAS, CLIMATE, MULTIPLIER], f"SELECT region_id, {r('x * climate', 'multiplier')}, {r('model_spread')} FROM mu JOIN cl USING (region_id)"),
    "event_metrics": statement(
        events("CASE WHEN hand IS NOT NULL THEN d100 END"),
        f"SELECT event, {r('threshold')}, h AS hits, m AS misses, f AS false_alarms, {r('h / nullif(CAST(h + m + f AS DOUBLE), 0)', 'csi')}, {r('h / nullif(CAST(h + m AS DOUBLE), 0)', 'hit_rate')}, {r('f / nullif(CAST(h + f AS DOUBLE), 0)', 'false_alarm_ratio')}, {r('h + f', 'rendered_area')}, {r('h + m', 'observed_area')}, {r('(f - m) / nullif(CAST(h + m AS DOUBLE), 0)', 'area_error')} FROM hits",
    ),
    "event_gate": statement(events("d100"), "SELECT coalesce(bool_and(coalesce(h / nullif(CAST(h + m + f AS DOUBLE), 0) >= 0.5e0, FALSE)), FALSE) AS passed FROM hits WHERE threshold = 0.3e0"),
    "reconstruction_gate": statement(
        [*H100, QC],
        f"SELECT count(*) AS n_zones, count(*) FILTER (NOT coalesce(c30 < 0.8e0, FALSE)) AS n_pass, {r('count(*) FILTER (NOT coalesce(c30 < 0.8e0, FALSE)) / CAST(count(*) AS DOUBLE)', 'pass_rate')}, {r('quantile_cont(c30, 0.5e0)', 'median_csi')}, {r('quantile_cont(rmse, 0.5e0)', 'median_rmse')}, coalesce(count(*) FILTER (NOT coalesce(c30 < 0.8e0, FALSE)) / CAST(count(*) AS DOUBLE) >= 0.95e0, FALSE) AS passed FROM qc",
    ),
    "holdout_split": statement([ATTRIBUTES, *split("att")], "SELECT z AS catchment_id, held_out FROM split"),
    "holdout_ols": statement([*FLUVIAL, ATTRIBUTES], f"SELECT {r('regr_intercept(alpha, level)', 'intercept')}, {r('regr_slope(alpha, level)', 'slope')} FROM f_zone JOIN att USING (z)"),
    "holdout_report": statement(HOLDOUT, f"SELECT catchment_id, {r('alpha')}, {r('predicted')}, {r('e', 'abs_error')}, {r('rel', 'rel_error')} FROM rep"),
    "holdout_summary": statement(HOLDOUT, f"SELECT count(*) AS n, {r('quantile_cont(e, 0.5e0)', 'median_abs_error')}, {r('quantile_cont(rel, 0.5e0)', 'median_rel_error')}, {r('sqrt(avg(e * e))', 'rmse')} FROM rep"),
    "color_limit": statement([CELLS], f"SELECT {r('coalesce(quantile_cont(d100, 0.98e0), 1e0)', 'vmax')} FROM cells WHERE d100 > 0"),
    "convert_units": statement(
        [CELLS, "d AS (SELECT catchment_id, CAST(round(d100 * 1000) AS INTEGER) AS v FROM cells)", "e AS (SELECT catchment_id, CASE WHEN v <> 0 THEN CAST(CAST(v AS FLOAT) / CAST(1000 AS FLOAT) AS DOUBLE) END AS x FROM d)"],
        f"SELECT catchment_id, {r('sum(x)', 'depth_sum')}, count(x) AS n FROM e GROUP BY 1",
    ),
    "finite_values": statement([CELLS], f"SELECT catchment_id, count(*) FILTER (linenumber > 2) AS n, {r('sum(d100) FILTER (linenumber > 2)', 'total')} FROM cells GROUP BY 1"),
    "bbox_tiles": statement([TILES], f"SELECT tile, {', '.join(r(n) for n in fx.TILE)} FROM hit"),
    "mosaic_tiles": statement(
        [TILES, "px AS (SELECT tile, c, r, CASE WHEN (r + c + tile) % 3 <> 0 THEN tile * 100e0 + r + c / 10e0 END AS value FROM hit, range(0, 40) a(c), range(0, 40) b(r) WHERE c BETWEEN xmin * 2 AND floor(xmax * 2) AND r BETWEEN ymin * 2 AND floor(ymax * 2))"],
        f"SELECT r, c, {r('value')} FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY tile) AS n FROM px WHERE value IS NOT NULL) WHERE n = 1",
    ),
    "read_window": statement([grid()], f"SELECT cell, r, c, {r('z')} FROM grid WHERE r >= 5 AND r < 25 AND c >= 7 AND c < 31"),
    "d8_pointer": statement([grid(), POINTERS], "SELECT cell, down FROM ptr"),
    "flow_accumulation": statement(DRAINED[:4], "SELECT cell, acc FROM acc", True),
    "stream_cells": statement(DRAINED[:5], "SELECT cell FROM st", True),
    "hand_grid": statement(DRAINED[:7], f"SELECT g.cell, {r('g.z - t.z', 'hand')} FROM grid g LEFT JOIN reach ON reach.cell = g.cell LEFT JOIN grid t ON t.cell = reach.terminal", True),
    "stream_links": statement(DRAINED, "SELECT cell, link_id FROM link", True),
    "subbasins": statement(DRAINED, "SELECT g.cell, coalesce(link_id, 0) AS catchment_id FROM grid g LEFT JOIN reach ON reach.cell = g.cell LEFT JOIN link ON link.cell = reach.terminal", True),
    "hand_stack": statement(
        [*carved(fx.AMPLITUDE_SMOOTH), *DRAINED[2:]],
        f"SELECT g.cell, {r('g.z - t.z', 'hand')}, coalesce(mine.link_id, 0) AS reach_id, coalesce(link.link_id, 0) AS catchment_id FROM grid g LEFT JOIN reach ON reach.cell = g.cell LEFT JOIN grid t ON t.cell = reach.terminal LEFT JOIN link ON link.cell = reach.terminal LEFT JOIN link mine ON mine.cell = g.cell",
        True,
    ),
    "assemble_cells": statement(
        [
            *carved(fx.AMPLITUDE_SMOOTH), *DRAINED[2:], *flooded("g0"), "wet AS (SELECT cell FROM filled JOIN g0 USING (cell) WHERE filled > z)",
            "conn AS (SELECT cell, cell AS low FROM wet UNION SELECT n.over, c.low FROM conn c JOIN nbr n USING (cell) WHERE n.over IN (SELECT cell FROM wet))",
            "sink AS (SELECT cell, min(low) + 1 AS depression_id FROM conn GROUP BY 1)",
            f"coarse AS (SELECT r, c, {q.RAIN} AS v FROM (SELECT DISTINCT floor(r / 4e0) AS r, floor(c / 4e0) AS c FROM g0))",
            "wt AS (SELECT g.cell, k.v, (1 - abs((g.r + 0.5e0) / 4e0 - 0.5e0 - k.r)) * (1 - abs((g.c + 0.5e0) / 4e0 - 0.5e0 - k.c)) AS w FROM g0 g JOIN coarse k ON abs((g.r + 0.5e0) / 4e0 - 0.5e0 - k.r) < 1 AND abs((g.c + 0.5e0) / 4e0 - 0.5e0 - k.c) < 1)",
            "rained AS (SELECT cell, sum(w * v) / sum(w) AS rain FROM wt GROUP BY 1)",
        ],
        f"SELECT g0.cell, g0.r, g0.c, {r('g0.z', 'dem')}, {r('g.z - t.z', 'hand')}, coalesce(mine.link_id, 0) AS reach_id, coalesce(link.link_id, 0) AS catchment_id, acc AS flow_acc, CAST(coalesce(sink.depression_id, 0) AS BIGINT) AS depression_id, {r('greatest(0e0, 0.8e0 - abs(g0.c - 20) / 10e0)', 'd100')}, {r('rain', 'rain_p100')} "
        "FROM g0 JOIN grid g USING (cell) LEFT JOIN reach ON reach.cell = g0.cell LEFT JOIN grid t ON t.cell = reach.terminal LEFT JOIN link ON link.cell = reach.terminal LEFT JOIN link mine ON mine.cell = g0.cell JOIN acc ON acc.cell = g0.cell LEFT JOIN sink ON sink.cell = g0.cell JOIN rained ON rained.cell = g0.cell",
        True,
    ),
    "condition_dem": statement([*carved(fx.AMPLITUDE_ROUGH, 3), *flooded("grid")], f"SELECT cell, {r('filled', 'z')} FROM filled", True),
    "fill_dem": statement([grid(fx.AMPLITUDE_ROUGH), *flooded("grid")], f"SELECT cell, {r('filled')} FROM filled", True),
    "delineate_depressions": statement(
        [
            grid(fx.AMPLITUDE_ROUGH), *flooded("grid"), "wet AS (SELECT cell FROM filled JOIN grid USING (cell) WHERE filled > z)",
            "conn AS (SELECT cell, cell AS low FROM wet UNION SELECT n.over, c.low FROM conn c JOIN nbr n USING (cell) WHERE n.over IN (SELECT cell FROM wet))",
        ],
        "SELECT grid.cell, CAST(coalesce(min(low) + 1, 0) AS BIGINT) AS depression_id FROM grid LEFT JOIN conn USING (cell) GROUP BY 1",
        True,
    ),
    "pour_points": statement(BLOCK_GRID, f"SELECT depression_id, cell, {r('z')} FROM pour"),
    "watershed": statement(
        [*BLOCK_GRID, POINTERS, "walk AS (SELECT cell AS src, cell AS cur FROM ptr UNION ALL SELECT w.src, p.down FROM walk w JOIN ptr p ON p.cell = w.cur WHERE p.down <> p.cell AND w.cur NOT IN (SELECT cell FROM pour))"],
        "SELECT g.cell, coalesce(max(pour.depression_id), 0) AS depression_id FROM grid g JOIN walk ON walk.src = g.cell LEFT JOIN pour ON pour.cell = walk.cur GROUP BY 1",
        True,
    ),
    "line_snap": statement(
        [
            *DRAINED, LINES, "cl AS (SELECT link.cell, link_id, r, c FROM link JOIN grid USING (cell))",
            "near AS (SELECT cl.*, label, ord, (r2 - r1) * (r2 - r1) + (c2 - c1) * (c2 - c1) AS len, r1, c1, r2, c2 FROM cl, ln)",
            "at_ AS (SELECT *, CASE WHEN len = 0 THEN 0e0 ELSE least(greatest(((r - r1) * (r2 - r1) + (c - c1) * (c2 - c1)) / len, 0e0), 1e0) END AS t FROM near)",
            "lab AS (SELECT cell, arg_max(label, ord) AS label FROM at_ WHERE pow(r - r1 - t * (r2 - r1), 2) + pow(c - c1 - t * (c2 - c1), 2) <= 4e0 GROUP BY 1)",
            "best AS (SELECT link_id, label FROM (SELECT link_id, label, row_number() OVER (PARTITION BY link_id ORDER BY count(*) DESC, label) AS n FROM cl JOIN lab USING (cell) GROUP BY 1, 2) WHERE n = 1)",
        ],
        "SELECT link_id, coalesce(best.label, link_id + coalesce((SELECT max(label) FROM lab), 0) + 1) AS label FROM (SELECT DISTINCT link_id FROM cl) LEFT JOIN best USING (link_id)",
        True,
    ),
    "boundary_mask": statement(
        [
            grid(), "zn AS (SELECT r, c, CASE WHEN (r - 20) * (r - 20) + (c - 18) * (c - 18) < 90 THEN 1 WHEN c > 30 THEN 2 ELSE 0 END AS zone FROM grid)",
            "ed AS (SELECT DISTINCT a.r, a.c FROM zn a JOIN zn b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.zone <> b.zone)",
        ],
        "SELECT r, c, EXISTS (SELECT 1 FROM ed WHERE abs(ed.r - zn.r) + abs(ed.c - zn.c) <= 2) AS boundary FROM zn",
    ),
    "resample_bilinear": statement(
        [
            grid(), "tg AS (SELECT cell, r * 0.75e0 + 0.3e0 AS y, c * 0.8e0 - 0.6e0 AS x FROM grid)", "src AS (SELECT r, c, z FROM grid WHERE cell % 17 <> 0)",
            "wt AS (SELECT t.cell, s.z, (1 - abs(t.y - s.r)) * (1 - abs(t.x - s.c)) AS w FROM tg t JOIN src s ON abs(t.y - s.r) < 1 AND abs(t.x - s.c) < 1)",
        ],
        f"SELECT tg.cell, {r('v', 'z')} FROM tg LEFT JOIN (SELECT cell, sum(w * z) / sum(w) AS v FROM wt GROUP BY 1) USING (cell)",
    ),
    "polygon_clip": statement([grid()], f"SELECT cell, {r('CASE WHEN ' + ring_sql('(c + 0.25e0)', '(r + 0.25e0)') + ' THEN z END', 'z')} FROM grid"),
    "vertex_bounds": statement([grid()], f"SELECT {r('min(c * 1.5e0)', 'xmin')}, {r('min(r * 2.5e0)', 'ymin')}, {r('max(c * 1.5e0)', 'xmax')}, {r('max(r * 2.5e0)', 'ymax')} FROM grid"),
}
