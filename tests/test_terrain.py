import heapq
import random

import numpy as np
import pytest
from inundate.operators import graph, raster, terrain
from inundate.sources import tables
from pyspark.sql import functions as F


def grid(spark, rows, cols, seed=0, f=None):
    rng = random.Random(seed)
    z = {(r, c): float(f(r, c)) if f else float(rng.randint(0, 30)) for r in range(rows) for c in range(cols)}
    return z, spark.createDataFrame([(r * cols + c, r, c, v) for (r, c), v in z.items()], "cell long, r long, c long, z double")


def near(z, r, c):
    return [(r + a, c + b) for a, b in terrain.AROUND if (r + a, c + b) in z]


def plain_fill(z):
    level, heap = {}, []
    for p in z:
        if len(near(z, *p)) < 8:
            level[p] = z[p]
            heapq.heappush(heap, (z[p], p))
    while heap:
        v, p = heapq.heappop(heap)
        for q in near(z, *p):
            if q not in level:
                level[q] = max(v, z[q])
                heapq.heappush(heap, (level[q], q))
    return level


@pytest.mark.parametrize("seed", [0, 1])
def test_fill_and_sinks(spark, seed):
    z, df = grid(spark, 11, 13, seed)
    want = plain_fill(z)
    got = {r.cell: r.filled for r in terrain.fill(df).collect()}
    assert got == {r * 13 + c: v for (r, c), v in want.items()}
    low = {p for p in z if want[p] > z[p]}
    label = {}
    for p in sorted(low):
        if p not in label:
            label[p] = p
            stack = [p]
            while stack:
                for q in near(z, *stack.pop()):
                    if q in low and q not in label:
                        label[q] = p
                        stack.append(q)
    ids = {r.cell: r.depression_id for r in terrain.sinks(df).collect()}
    assert ids == {r * 13 + c: (label[r, c][0] * 13 + label[r, c][1] + 1 if (r, c) in low else 0) for r, c in z}


def test_breached_terrain_drains(spark):
    z, df = grid(spark, 11, 13, 3)
    got = {r.cell: r for r in terrain.breach(df).collect()}
    for cell in got:
        seen, at = set(), cell
        while got[at].down != at:
            assert at not in seen
            seen.add(at)
            assert got[got[at].down].z <= got[at].z or len(near(z, *divmod(at, 13))) == 8
            at = got[at].down
        assert len(near(z, *divmod(at, 13))) < 8  # every path ends at the border
    assert all(got[r * 13 + c].z <= v for (r, c), v in z.items())


def test_flow_on_a_slope(spark):
    _, df = grid(spark, 4, 3, f=lambda r, c: -r)
    down = {r.cell: r.down for r in terrain.flow_direction(df).collect()}
    assert down[0] == 3 and down[4] == 7 and down[10] == 10
    assert {r.cell: r.acc for r in terrain.flow_accumulation(terrain.flow_direction(df)).collect()}[10] == 4


def test_links_and_catchments(spark):
    # two arms meet at 4 and run on to 6; 9 drains to 6, 8 to nowhere
    p = spark.createDataFrame([(1, 2), (2, 4), (3, 4), (4, 5), (5, 6), (6, 6), (9, 6), (8, 8)], "cell long, down long")
    stream = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "cell long")
    links = terrain.stream_links(p, stream)
    assert dict(links.collect()) == {1: 2, 2: 2, 3: 4, 4: 5, 5: 5, 6: 5}
    assert dict(terrain.catchments(p, stream, links).collect()) == {1: 2, 2: 2, 3: 4, 4: 5, 5: 5, 6: 5, 9: 5, 8: 0}


def test_long_paths(spark):
    n = 300
    p = spark.createDataFrame([(i, min(i + 1, n - 1)) for i in range(n)], "cell long, down long")
    assert {r.terminal for r in graph.terminals(p).collect()} == {n - 1}
    assert dict(graph.accumulate(p).collect()) == {i: i + 1 for i in range(n)}
    assert graph.paths_from(spark.createDataFrame([(120,)], "cell long"), p).count() == n - 120


def test_components(spark):
    links = spark.createDataFrame([(5, 1), (2, 5), (9, 8), (7, 7), (8, 10), (11, 2)], "a long, b long")
    assert dict(graph.smallest_reachable(links).collect()) == {2: 1, 5: 1, 11: 1, 9: 8, 10: 8}
    assert graph.smallest_reachable(links.limit(0)).count() == 0


def test_build_stack_reaches_every_cell(spark):
    _, df = grid(spark, 12, 12, 5)
    out = terrain.build_hand_stack(df, 6).collect()
    assert len(out) == 144 and any(r.reach_id > 0 for r in out)
    on = [r for r in out if r.reach_id > 0]
    assert all(r.catchment_id == r.reach_id and r.hand == 0 for r in on)
    assert all(r.hand >= 0 for r in out if r.hand is not None)


def test_watershed_and_pour_points(spark):
    _, df = grid(spark, 1, 6, f=lambda r, c: [5, 4, 4, 3, 2, 1][c])
    zones = df.withColumn("depression_id", F.expr("case when c between 1 and 2 then 7 else 0 end").cast("long"))
    pours = terrain.pour_points(zones)
    assert [(r.depression_id, r.cell) for r in pours.collect()] == [(7, 1)]
    assert dict(terrain.watershed(terrain.flow_direction(df), pours).collect()) == {0: 7, 1: 7, 2: 0, 3: 0, 4: 0, 5: 0}


def test_boundary_mask(spark):
    _, df = grid(spark, 7, 7, f=lambda r, c: 0)
    zones = df.withColumn("zone", F.expr("case when r = 3 and c = 3 then 1 else 0 end"))
    on = {(r.r, r.c) for r in raster.boundary_mask(zones, "zone", dilate=0).collect() if r.boundary}
    assert on == {(3, 3), (2, 3), (4, 3), (3, 2), (3, 4)}
    assert {r.boundary for r in raster.boundary_mask(zones.withColumn("zone", F.lit(4)), "zone").collect()} == {False}


def test_polygon_and_resample(spark):
    _, df = grid(spark, 5, 5, f=lambda r, c: 10 * r + c)
    square = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]
    kept = {(r.r, r.c) for r in raster.clip(df.withColumns({"x": F.col("c") * 1.0, "y": F.col("r") * 1.0}), square, "z").collect() if r.z is not None}
    assert kept == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}
    target = spark.createDataFrame([(1, 1.5, 2.25), (2, 0.0, 0.0), (3, 99.0, 0.0), (4, 4.5, 4.0)], "cell long, y double, x double")
    assert dict(raster.resample_bilinear(df, target, "z").collect()) == {1: 17.25, 2: 0.0, 3: None, 4: 44.0}


def test_tiled_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TILE_CELLS", 4)
    _, df = grid(spark, 9, 9)
    tables.write_cells(df, str(tmp_path / "cells"))
    got = tables.read_window(spark, str(tmp_path / "cells"), 2, 3, 5, 8)
    assert {(r.r, r.c) for r in got.collect()} == {(r, c) for r in range(2, 5) for c in range(3, 8)}
    assert "PartitionFilters" in got._jdf.queryExecution().toString() and "tile_r" in got._jdf.queryExecution().toString()
    band = tables.read_band(spark, str(tmp_path / "cells"), "z", (0, 0, 2, 2), scale=10.0, nodata=5.0)
    assert band.columns == ["r", "c", "z"]


def test_catalog(spark):
    rows = [("a", {"2050": ("gs://x/a.tif", 2)}), ("b", {})]
    catalog = spark.createDataFrame(rows, "id string, assets map<string, struct<href:string, band_index:int>>")
    assert tables.catalog_band(catalog, "a", 2050) == ("gs://x/a.tif", 3)
    with pytest.raises(KeyError, match="'a', 'b'"):
        tables.catalog_row(catalog, "c")
    with pytest.raises(ValueError, match="gs://"):
        tables.storage_path("/local")


def test_stage_tables(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    path = str(tmp_path / "stage")
    assert tables.stage_table(spark, path, lambda: make(3)).count() == 3
    assert tables.stage_table(spark, path, lambda: make(5)).count() == 3
    assert tables.stage_table(spark, path, lambda: make(5), overwrite=True).count() == 5 and made == [3, 5]


def rough(spark, seed=0, rows=8, cols=7):
    rng = np.random.default_rng(seed)
    z = np.round(rng.random((rows, cols)) * 6)  # many ties
    return spark.createDataFrame([(r * cols + c, r, c, float(z[r, c])) for r in range(rows) for c in range(cols)], "cell long, r long, c long, z double")


def test_one_task_and_rounds_agree(spark, monkeypatch):
    """Small graphs are solved in one task; the rounds of large ones come to the same."""
    g = rough(spark).cache()
    pointers = terrain.flow_direction(g).cache()
    links = spark.createDataFrame([(1, 2), (3, 2), (7, 5), (5, 9), (9, 9), (12, 7)], "a long, b long")
    starts = g.where("cell % 13 = 0").select("cell")

    def everything():
        found = (
            graph.terminals(pointers), graph.accumulate(pointers), graph.accumulate(pointers.withColumn("w", F.col("cell") * 0.5), weight="w"), graph.accumulate(pointers.withColumn("w", 9 - F.col("cell")), weight="w", least=True), graph.paths_from(starts, pointers),
            graph.smallest_reachable(links, together=True), terrain.breach(g, max_dist=2),
        )
        return [sorted(map(tuple, df.select(sorted(df.columns)).collect())) for df in found]

    alone = everything()
    monkeypatch.setattr(graph, "ALONE", 0)
    assert alone == everything()


@pytest.mark.parametrize("seed", [1, 2])
def test_breach_within_a_distance(spark, seed):
    """Far pits stay in the carved terrain and are filled afterwards; without a bound nothing is left to fill."""
    g = rough(spark, seed)
    whole = {r.cell: r.z for r in terrain.condition_dem(g, max_dist=None).collect()}
    assert {r.cell: r.z for r in terrain.condition_dem(g, max_dist=1000).collect()} == whole
    carved = spark.createDataFrame([(r.cell, r.r, r.c, whole[r.cell]) for r in g.collect()], g.schema)
    assert {r.cell: r.filled for r in terrain.fill(carved).collect()} == whole
    none = {r.cell: r.z for r in terrain.condition_dem(g, max_dist=0).collect()}
    assert none == {r.cell: r.filled for r in terrain.fill(g).collect()}
    some = {r.cell: r.z for r in terrain.condition_dem(g, max_dist=2).collect()}
    mine = {r.cell: r.z for r in g.collect()}
    assert all(some[c] >= min(whole[c], mine[c]) for c in some) and some != none


def test_graphs_without_rows(spark):
    none = spark.createDataFrame([], "cell long, down long")
    assert graph.terminals(none).count() == 0 and graph.accumulate(none).count() == 0 and graph.paths_from(none.select("cell"), none).count() == 0
    assert graph.smallest_reachable(spark.createDataFrame([], "a long, b long"), together=True).count() == 0
    assert terrain.fill(spark.createDataFrame([], "cell long, r long, c long, z double")).count() == 0


def test_a_loop_of_joins_keeps_the_estimated_size_bounded(spark):
    from inundate.sources.store import checkpointed

    now = spark.range(50).selectExpr("id as cell", "least(id + 1, 49) as at")
    for _ in range(6):
        hop = now.selectExpr("cell as at", "at as beyond")
        now = checkpointed(now.join(hop, "at", "left").selectExpr("cell", "coalesce(beyond, at) as at"))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert {tuple(r) for r in now.collect()} == {(i, 49) for i in range(50)}


def test_passes_of_a_million_cells_are_solved_in_one_task(spark):
    """The rough 40-column grid of 1.2 million cells has 1,214,225 passes; rounds over them took longer than all else."""
    assert graph.small(spark.range(1_214_225))
    way = np.arange(5)
    t, level, hops, other = terrain._ways(way, way - 1, np.array([3.0, 1.0, 4.0, 1.0, 5.0]))  # a chain from the outside
    assert sorted(zip(t, level, hops, other, strict=True)) == [(0, 3, 0, -1), (1, 3, 1, 0), (2, 4, 2, 1), (3, 4, 3, 2), (4, 5, 4, 3)]
