"""Drainage on a grid (cell, r, c, z): flow, accumulation, heights, links, catchments, sinks.

Neighbours meet by one shuffle: every cell sends its value to the eight around it,
and sums combine in the map tasks.  Ties are broken by the lowest direction number
``(dr + 1) * 3 + dc + 1``; a cell without a lower neighbour is a pit and points to
itself.  Ids of links, sinks and basins are a cell's number plus 1, so they need no
global numbering.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .graph import accumulate, alone, paths_from, small, smallest_reachable, terminals
from .zonal import lowest_cell, relabel_by_mode

AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
STREAM_CELLS = 500


def code(dr: int, dc: int) -> int:
    return (dr + 1) * 3 + dc + 1


def neighbours(grid: DataFrame, *values: str, around=AROUND) -> DataFrame:
    """(r, c, code, values of the neighbour in that direction) for every cell and direction inside the grid's reach."""
    # the cell at (r, c) is the neighbour in direction (dr, dc) of the cell at (r - dr, c - dc)
    offsets = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(code(dr, dc)).alias("code")) for dr, dc in around))
    sent = grid.select("r", "c", *values, F.explode(offsets).alias("o"))
    return sent.select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.code").alias("code"), *values)


def flow_direction(grid: DataFrame, z: str = "z") -> DataFrame:
    """(cell, down): the neighbour of the steepest drop."""
    sent = neighbours(grid.select("cell", "r", "c", F.col(z).alias("z")), "cell", "z")
    own = grid.select("r", "c", F.lit(-1).alias("code"), "cell", F.col(z).alias("z"))
    picks = [F.max(F.when(F.col("code") == code(dr, dc), F.struct("z", "cell"))).alias(f"n{code(dr, dc)}") for dr, dc in AROUND]
    met = own.unionByName(sent).groupBy("r", "c").agg(F.max(F.when(F.col("code") == -1, F.struct("cell", "z"))).alias("own"), *picks).where("own is not null")
    options = []
    for dr, dc in AROUND:
        n = F.col(f"n{code(dr, dc)}")
        slope = (F.col("own.z") - n["z"]) / math.hypot(dr, dc)
        options.append(F.when(slope > 0, F.struct(slope.alias("slope"), F.lit(-code(dr, dc)).alias("code"), n["cell"].alias("cell"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return met.select(F.col("own.cell").alias("cell"), F.coalesce(best["cell"], F.col("own.cell")).alias("down"))


def flow_accumulation(pointers: DataFrame) -> DataFrame:
    return accumulate(pointers)


def streams(acc: DataFrame, threshold: int = STREAM_CELLS) -> DataFrame:
    """Cells with ``threshold`` or more cells upstream, themselves included."""
    return acc.where(F.col("acc") >= threshold).select("cell")


def drained_to(pointers: DataFrame, stream: DataFrame) -> DataFrame:
    """(cell, terminal) with stream cells as terminals; paths that end elsewhere get NULL."""
    marked = pointers.join(stream.select("cell", F.lit(True).alias("on")), "cell", "left")
    ended = terminals(marked.select("cell", F.when(F.col("on"), F.col("cell")).otherwise(F.col("down")).alias("down")))
    reached = stream.select(F.col("cell").alias("terminal"), F.lit(True).alias("on"))
    return ended.join(reached, "terminal", "left").select("cell", F.when(F.col("on"), F.col("terminal")).alias("terminal"))


def height_above_drainage(grid: DataFrame, pointers: DataFrame, stream: DataFrame, z: str = "z", drained: DataFrame | None = None) -> DataFrame:
    """(cell, hand): elevation over the stream cell that a cell drains to; NULL if it reaches none.  ``drained`` if it is known already."""
    drained = drained_to(pointers, stream) if drained is None else drained
    low = grid.select(F.col("cell").alias("terminal"), F.col(z).alias("zt"))
    return drained.join(low, "terminal", "left").join(grid.select("cell", F.col(z).alias("z")), "cell").select("cell", (F.col("z") - F.col("zt")).alias("hand"))


def stream_links(pointers: DataFrame, stream: DataFrame) -> DataFrame:
    """(cell, link_id): a link starts where streams rise or meet; its id is its first cell's number plus 1."""
    on = pointers.join(stream, "cell", "left_semi")
    inflow = on.where("down <> cell").select(F.col("down").alias("cell"), F.col("cell").alias("up"))
    met = stream.join(inflow, "cell", "left").groupBy("cell").agg(F.count("up").alias("n"), F.min("up").alias("up"))
    chain = met.select("cell", F.when(F.col("n") == 1, F.col("up")).otherwise(F.col("cell")).alias("down"))
    return terminals(chain).select("cell", (F.col("terminal") + 1).alias("link_id"))


def catchments(pointers: DataFrame, stream: DataFrame, links: DataFrame, drained: DataFrame | None = None) -> DataFrame:
    """(cell, catchment_id): the id of the link a cell drains to; 0 if it reaches none.  ``drained`` if it is known already."""
    drained = drained_to(pointers, stream) if drained is None else drained
    named = links.select(F.col("cell").alias("terminal"), "link_id")
    return drained.join(named, "terminal", "left").select("cell", F.coalesce("link_id", F.lit(0)).alias("catchment_id"))


def _basins(zs: DataFrame, pointers: DataFrame | None = None):
    """The grid with each cell's pit; passes (terminal, other, pass, cell, over): the lowest way from basin to
    basin, ``cell`` in the one and ``over`` in the other; and outlets (terminal, level, cell) at the border."""
    ends = terminals(flow_direction(zs) if pointers is None else pointers)
    labelled = checkpointed(zs.join(ends, "cell"))
    beside = neighbours(labelled, "cell", "terminal", "z").withColumnsRenamed({"cell": "over", "terminal": "other", "z": "zn"})
    met = beside.join(labelled, ["r", "c"])
    border = met.groupBy("cell", "terminal", "z").agg(F.count("*").alias("n")).where("n < 8").select("cell", "terminal", "z")
    single = labelled.join(met.select("cell").distinct(), "cell", "left_anti").select("cell", "terminal", "z")  # a grid of one cell
    outlets = border.unionByName(single).groupBy("terminal").agg(F.min(F.struct("z", "cell")).alias("m")).select("terminal", F.col("m.z").alias("level"), F.col("m.cell").alias("cell"))
    low = met.where("other <> terminal").groupBy("terminal", "other").agg(F.min(F.struct(F.greatest("z", "zn").alias("pass"), "cell", "over")).alias("m"))
    return labelled, checkpointed(low.select("terminal", "other", "m.pass", "m.cell", "m.over")), outlets


OUTSIDE = -1


def _ways(terminal: np.ndarray, other: np.ndarray, w: np.ndarray):
    """``_levels`` of a small graph: levels in ascending order from the outside, then fewest hops among the lowest ways."""
    names, ends = np.unique(np.r_[OUTSIDE, terminal, other].astype(np.int64), return_inverse=True)
    start, outside = ends[len(terminal) + 1 :], int(ends[0])
    by = np.argsort(start, kind="stable")
    ends, w = ends[1 : len(terminal) + 1][by], w[by]
    first = np.searchsorted(start[by], np.arange(len(names) + 1)).tolist()

    def beside(at: int):
        part = slice(first[at], first[at + 1])
        return zip(ends[part].tolist(), w[part].tolist(), strict=True)

    level: dict[int, float] = {}
    heap = [(-math.inf, outside)]
    while heap:
        low, at = heapq.heappop(heap)
        if at not in level:
            level[at] = low
            for t, x in beside(at):
                if t not in level:
                    heapq.heappush(heap, (max(low, x), t))
    hops, ring = {outside: (-1, outside)}, [outside]
    while ring:
        found: dict[int, int] = {}
        for at in ring:
            for t, x in beside(at):
                if t not in hops and max(level[at], x) == level[t]:
                    found[t] = min(found.get(t, at), at)
        n = hops[ring[0]][0] + 1
        hops |= {t: (n, o) for t, o in found.items()}
        ring = list(found)
    done = [t for t in hops if t != outside]
    return names[done], np.array([level[t] for t in done]), np.array([hops[t][0] for t in done], np.int32), names[[hops[t][1] for t in done]]


def _levels(labelled: DataFrame, passes: DataFrame, outlets: DataFrame) -> DataFrame:
    """(terminal, level, hops, other): each basin's least highest pass on its way out, and the next basin on it
    (``OUTSIDE`` from an outlet).

    Of equal levels the way of fewest hops counts, then the least next basin, so the
    next basins form a tree.  Basins are a far smaller graph than the grid.  Up to
    ``graph.ALONE`` passes one task solves it; a larger one is relaxed, first to the
    levels and then, over the passes that lie on lowest ways, to the hops.
    """
    edges = checkpointed(
        passes.select("terminal", "other", F.col("pass").cast("double").alias("w")).unionByName(outlets.select("terminal", F.lit(OUTSIDE).cast("bigint").alias("other"), F.col("level").cast("double").alias("w")))
    )
    if small(edges):
        return alone(edges, _ways, "terminal long, level double, hops int, other long")

    def relaxed(links: DataFrame, start: DataFrame, step, kind: str) -> DataFrame:
        now = checkpointed(start)
        while True:
            known = now.select(F.col("terminal").alias("other"), F.col("best").alias("b"))
            offer = links.join(known, "other").groupBy("terminal").agg(F.min(step).cast(kind).alias("new"))
            better = F.col("new").isNotNull() & (F.col("best").isNull() | (F.col("new") < F.col("best")))
            both = checkpointed(now.join(offer, "terminal", "full_outer").select("terminal", F.when(better, F.col("new")).otherwise(F.col("best")).alias("best"), better.alias("moved")))
            now = both.select("terminal", "best")
            if not both.where("moved").limit(1).count():
                return now

    outlet = edges.where(F.col("other") == OUTSIDE)
    inner = edges.where(F.col("other") != OUTSIDE)
    level = relaxed(inner, outlet.select("terminal", F.col("w").alias("best")), F.greatest("w", "b"), "double").withColumnRenamed("best", "level")
    beyond = level.select(F.col("terminal").alias("other"), F.col("level").alias("lo")).unionByName(level.sparkSession.createDataFrame([(OUTSIDE, float("-inf"))], "other long, lo double"))
    tight = checkpointed(edges.join(level, "terminal").join(beyond, "other").where(F.greatest("w", "lo") == F.col("level")).select("terminal", "other"))
    start = tight.where(F.col("other") == OUTSIDE).select("terminal", F.lit(0).alias("best"))
    hops = relaxed(tight.where(F.col("other") != OUTSIDE), start, F.col("b") + 1, "int").withColumnRenamed("best", "hops")
    before = hops.select(F.col("terminal").alias("other"), (F.col("hops") + 1).alias("hops")).unionByName(hops.sparkSession.createDataFrame([(OUTSIDE, 0)], "other long, hops int"))
    following = tight.join(before, "other").join(hops, ["terminal", "hops"]).groupBy("terminal", "hops").agg(F.min("other").alias("other"))
    return following.join(level, "terminal").select("terminal", "level", "hops", "other")


def fill(grid: DataFrame, z: str = "z") -> DataFrame:
    """(cell, filled): the lowest level at which water at a cell can leave the grid's border.

    A cell's level is the greater of its own elevation and its basin's level.
    """
    labelled, passes, outlets = _basins(grid.select("cell", "r", "c", F.col(z).alias("z")))
    return labelled.join(_levels(labelled, passes, outlets), "terminal").select("cell", F.greatest("z", "level").alias("filled"))


def breach(grid: DataFrame, z: str = "z", max_dist: int | None = None) -> DataFrame:
    """(cell, down, z): a drainage that reaches the border from every cell, and the terrain carved to fit it.

    Each pit that is not an outlet drains over its basin's lowest way out: the flow
    path from that pass down to the pit is turned round.  Every cell is lowered to the
    least elevation that drains through it, so the carved terrain never rises along
    the drainage.  A path of more than ``max_dist`` cells is left as it is, and its pit stays.
    This is a least-pass breach, not a least-cost one.
    """
    zs = checkpointed(grid.select("cell", "r", "c", F.col(z).alias("z")))
    pointers = checkpointed(flow_direction(zs))
    labelled, passes, outlets = _basins(zs, pointers)
    tree = checkpointed(_levels(labelled, passes, outlets))
    out = tree.join(passes.select("terminal", "other", "cell", "over"), ["terminal", "other"]).select("terminal", "cell", "over")
    rim = tree.where(F.col("other") == OUTSIDE).join(outlets.select("terminal", "cell"), "terminal").select("terminal", "cell", F.col("cell").alias("over"))
    heads = checkpointed(out.unionByName(rim))
    path = paths_from(heads.select("cell"), pointers).join(labelled.select("cell", "terminal"), "cell")
    if max_dist is not None:
        path = checkpointed(path)
        far = path.groupBy("terminal").agg(F.count("*").alias("n")).where(F.col("n") > max_dist).select("terminal")
        path, heads = path.join(far, "terminal", "left_anti"), heads.join(far, "terminal", "left_anti")
    back = path.join(pointers, "cell").where("down <> cell").select(F.col("down").alias("cell"), F.col("cell").alias("back"))
    turned = back.unionByName(heads.select("cell", F.col("over").alias("back")))
    done = checkpointed(pointers.join(turned, "cell", "left").select("cell", F.coalesce("back", "down").alias("down")).join(zs.select("cell", "z"), "cell"))
    return done.select("cell", "down").join(accumulate(done, weight="z", least=True).withColumnRenamed("acc", "z"), "cell")


#: Cells that a breach may be long; deeper-lying pits are filled.
MAX_DIST = 1000


def condition_dem(grid: DataFrame, z: str = "z", method: str = "breach", max_dist: int | None = MAX_DIST) -> DataFrame:
    """The grid with a terrain conditioned by ``breach``, pits it leaves filled, or by ``fill`` alone."""
    if method == "breach":
        carved = checkpointed(grid.select("cell", "r", "c").join(breach(grid, z, max_dist).select("cell", "z"), "cell"))
        new = fill(carved, "z") if max_dist is not None else carved.select("cell", F.col("z").alias("filled"))
    else:
        new = fill(grid, z)
    return grid.join(new.withColumnRenamed("filled", "_new"), "cell").withColumn(z, F.col("_new")).drop("_new")


def sinks(grid: DataFrame, z: str = "z") -> DataFrame:
    """(cell, depression_id): connected (8 neighbours) cells below their filled level share the least cell's number plus 1; 0 elsewhere."""
    wet = checkpointed(grid.select("cell", "r", "c", F.col(z).alias("z")).join(fill(grid, z), "cell").withColumn("on", F.col("filled") > F.col("z")))
    on = wet.where("on").select("cell", "r", "c")
    links = neighbours(on, "cell").withColumnRenamed("cell", "a").join(on, ["r", "c"]).select("a", F.col("cell").alias("b")).where("a < b")
    stars = smallest_reachable(links, together=True).select(F.col("a").alias("cell"), F.col("b").alias("least"))
    return wet.join(stars, "cell", "left").select("cell", F.when(F.col("on"), F.coalesce("least", "cell") + 1).otherwise(0).cast("bigint").alias("depression_id"))


def pour_points(grid: DataFrame, z: str = "z", zone: str = "depression_id") -> DataFrame:
    """Each depression's lowest cell; of equals the first in row-major order."""
    return lowest_cell(grid, zone, z, "r", "c", "cell")


def watershed(pointers: DataFrame, pours: DataFrame, zone: str = "depression_id") -> DataFrame:
    """(cell, zone): the pour point a cell's path meets first; 0 if none."""
    at = pours.select("cell", F.col(zone).alias("_zone"))
    marked = pointers.join(at, "cell", "left")
    ended = terminals(marked.select("cell", F.when(F.col("_zone").isNotNull(), F.col("cell")).otherwise(F.col("down")).alias("down")))
    return ended.join(at.withColumnRenamed("cell", "terminal"), "terminal", "left").select("cell", F.coalesce("_zone", F.lit(0)).cast("bigint").alias(zone))


def line_buffer(segments: DataFrame, reach: float = 2.0) -> DataFrame:
    """(r, c, label): cells whose centre lies within ``reach`` cells of a segment (label, ord, r1, c1, r2, c2); the later segment wins.

    Every segment lists the cells of its own bounding box, so nothing is crossed.
    """
    k = F.lit(float(reach))
    rows = F.sequence(F.floor(F.least("r1", "r2") - k), F.ceil(F.greatest("r1", "r2") + k))
    cols = F.sequence(F.floor(F.least("c1", "c2") - k), F.ceil(F.greatest("c1", "c2") + k))
    near = segments.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    length = dr * dr + dc * dc
    t = F.coalesce(F.try_divide((F.col("r") - F.col("r1")) * dr + (F.col("c") - F.col("c1")) * dc, length), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    off_r, off_c = F.col("r") - F.col("r1") - t * dr, F.col("c") - F.col("c1") - t * dc
    inside = near.where(off_r * off_r + off_c * off_c <= k * k)
    return inside.groupBy("r", "c").agg(F.max(F.struct("ord", "label")).alias("_m")).select("r", "c", F.col("_m.label").alias("label"))


def snap_to_lines(cells: DataFrame, segments: DataFrame, zone: str = "link_id", reach: float = 2.0) -> DataFrame:
    """(zone, label): each stream link's most frequent line label within reach, or its id moved above all labels."""
    return relabel_by_mode(cells.join(line_buffer(segments, reach), ["r", "c"], "left"), zone, "label")


def build_hand_stack(grid: DataFrame, threshold: int = STREAM_CELLS, segments: DataFrame | None = None) -> DataFrame:
    """The grid with hand, reach_id (0 off streams), catchment_id and flow_acc, from conditioning to catchments."""
    carved = checkpointed(breach(grid))
    pointers = carved.select("cell", "down")
    filled = checkpointed(grid.select("cell", "r", "c").join(carved.select("cell", "z"), "cell"))
    flow = checkpointed(flow_accumulation(pointers))
    stream = checkpointed(streams(flow, threshold))
    links = checkpointed(stream_links(pointers, stream))
    named = links
    if segments is not None:
        snapped = snap_to_lines(links.join(grid.select("cell", "r", "c"), "cell"), segments)
        named = links.join(snapped, "link_id").select("cell", F.col("label").alias("link_id"))
    drained = checkpointed(drained_to(pointers, stream))
    hand = height_above_drainage(filled, pointers, stream, drained=drained)
    areas = catchments(pointers, stream, named, drained)
    reach = named.select("cell", F.col("link_id").alias("reach_id"))
    out = grid.join(hand, "cell", "left").join(areas, "cell", "left").join(flow.withColumnRenamed("acc", "flow_acc"), "cell", "left")
    return out.join(reach, "cell", "left").withColumn("reach_id", F.coalesce("reach_id", F.lit(0)))
