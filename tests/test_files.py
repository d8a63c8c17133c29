import math

import numpy as np
import pytest
from inundate import __main__ as cli
from inundate.operators import raster
from inundate.sources import grids, tables
from pyspark.sql import functions as F


def test_text_grid(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "z.asc")
    shape = grids.Profile(3, 4, 10.0, 20.0, 0.5, -1.0)
    cells = spark.createDataFrame([(r, c, None if (r, c) == (1, 2) else r * 10.0 + c) for r in range(3) for c in range(4)], "r int, c int, value double")
    grids.write_text_grid(cells.where("not (r = 2 and c = 0)"), path, shape)
    assert grids.profile(path) == shape and shape.cell_area == 0.25
    grids.register(spark)
    got = {(r.r, r.c): r.value for r in spark.read.format("cellgrid").load(path).collect()}
    assert len(got) == 12 and got[1, 2] is None and got[2, 0] is None and got[2, 3] == 23.0
    reader = grids.GridReader(path, 1)
    monkeypatch.setattr(grids, "CHUNK_ROWS", 2)
    assert [(p.begin, p.end) for p in reader.partitions()] == [(0, 2), (2, 3)]


def test_extract(spark, tmp_path):
    grid = [(r, c, float(r * 100 + c)) for r in range(-8, 0) for c in range(8)]
    spark.createDataFrame([(r, c, z if c < 5 else None) for r, c, z in grid], "r int, c int, z double").write.parquet(str(tmp_path / "t1"))
    spark.createDataFrame([(r, c, -z) for r, c, z in grid], "r int, c int, z double").write.parquet(str(tmp_path / "t2"))
    spark.createDataFrame([(r, c, 1500) for r, c, _ in grid], "r int, c int, d int").write.parquet(str(tmp_path / "d"))
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 8.0, str(tmp_path / "t1")), ("b", 0.0, 0.0, 8.0, 8.0, str(tmp_path / "t2")), ("c", 9.0, 9.0, 10.0, 10.0, "nowhere")], "id string, xmin double, ymin double, xmax double, ymax double, href string")
    got = tables.extract_basin(spark, (3.0, 2.0, 7.0, 5.0), str(tmp_path / "out"), tiles, (str(tmp_path / "d"), "d"), {"rain": (str(tmp_path / "d"), "d")}, 1.0)
    dem = {(r.r, r.c): r.z for r in got["dem"].collect()}
    assert set(dem) == {(r, c) for r in range(-5, -2) for c in range(3, 7)} and dem[-5, 3] == -497.0 and dem[-5, 6] == 494.0
    assert {r.d for r in got["depth"].collect()} == {1.5}
    with pytest.raises(ValueError, match="overlaps"):
        tables.extract_basin(spark, (90.0, 90.0, 91.0, 91.0), str(tmp_path / "none"), tiles, ("", ""), {}, 1.0)


def test_convert(spark):
    df = spark.createDataFrame([(1500,), (-1,), (None,)], "raw int")
    assert [r.x for r in df.select(raster.convert(F.col("raw"), 1000.0, -1).alias("x")).collect()] == [1.5, None, None]


def test_rings_as_columns(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    rng = np.random.default_rng(0)
    points = [(float(x), float(y)) for x, y in rng.uniform(-1, 5, (300, 2))]
    df = spark.createDataFrame(points, "x double, y double").withColumn("ring", F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)))
    both = df.select(raster.in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("a"), raster.in_polygon(F.col("x"), F.col("y"), ring).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and 0 < sum(r.a for r in both) < 300


def test_command_lines(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(z, float(h), max(0.8 - float(h), 0.0), 1.0, 1.2, 0, 100.0) for z in (1, 2) for h in rng.uniform(0, 1.5, 200)] + [(1, math.nan, 0.0, 1.0, 1.0, 0, 100.0)]
    spark.createDataFrame(rows, "catchment_id long, hand double, d100 double, rain_p100 double, rain_pp double, depression_id long, dem double").write.parquet(str(tmp_path / "cells"))
    at = lambda *x: [str(tmp_path / p) for p in x]
    assert cli.main(["curves", *at("cells", "curves")]) == 0
    assert cli.main(["calibrate", *at("cells", "calibration")]) == 0
    assert cli.main(["run", *at("cells", "run"), "--compare"]) == 0
    assert cli.main(["gate", *at("cells", "report")]) == 0
    assert spark.read.parquet(str(tmp_path / "curves")).count() == 40
    assert "naive_depth" in spark.read.parquet(str(tmp_path / "run/depth")).columns
    spark.createDataFrame([("a", 0.0, True)], "event string, depth double, observed boolean").write.parquet(str(tmp_path / "pairs"))
    assert cli.main(["events", *at("pairs", "events")]) == 1


def test_vectors(spark, tmp_path):
    import json

    from inundate.sources import vectors

    features = [
        {"type": "Feature", "properties": {"id": 7}, "geometry": {"type": "LineString", "coordinates": [[1.0, 9.0], [2.0, 8.0], [2.0, 6.0]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 0.0]]]}},
    ]
    path = str(tmp_path / "v.json")
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    lines = vectors.read_lines(spark, path, "id", y0=10.0, cell=0.5).collect()
    assert [tuple(r) for r in lines] == [(7, 0, 2.0, 2.0, 4.0, 4.0), (7, 0, 4.0, 4.0, 8.0, 4.0)]
    rings = vectors.read_rings(spark, path)
    assert rings.first().ring == [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    assert tuple(raster.bounds(vectors.vertices(rings)).first()) == (0.0, 0.0, 4.0, 3.0)


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    from inundate.sources import store

    class Session:
        class sparkContext:  # noqa: N801
            conf: dict = {}

            @classmethod
            def getConf(cls):  # noqa: N802
                return cls.conf

    for conf, kind in (({"spark.master": "yarn"}, ValueError), ({"spark.master": "local-cluster[2,1,1024]"}, ValueError), ({"spark.master": "yarn", "spark.checkpoint.dir": "s3://x/y"}, str), ({"spark.master": "local[4]"}, str)):
        Session.sparkContext.conf = conf
        if kind is ValueError:
            with pytest.raises(ValueError, match="share"):
                store.shared_folder(Session)
        else:
            assert isinstance(store.shared_folder(Session), str)
