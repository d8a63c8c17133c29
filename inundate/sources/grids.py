"""Raster files as tables of cells: a Spark data source ``cellgrid`` in Python.

Reads (r, c, value), unknown cells as NULL, in parts of ``CHUNK_ROWS`` rows.  Text
grids (header lines, then rows of numbers) need no library; other formats go through
rasterio where it is installed.  Register it with ``register(spark)``, then
``spark.read.format("cellgrid").load(path)``; ``df.write.format("cellgrid")`` writes a
text grid of one band (rows are ordered on the way, so it is for windows, not basins).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

try:
    import rasterio
except ImportError:
    rasterio = None

CHUNK_ROWS = 2000
SCHEMA = "r int, c int, value double"


@dataclass
class Profile:
    """A grid's size and place; the cell area follows from its cell sizes."""

    rows: int
    cols: int
    x: float = 0.0
    y: float = 0.0
    cell: float = 1.0
    nodata: float | None = None

    @property
    def cell_area(self) -> float:
        return abs(self.cell * self.cell)


HEADER = {"nrows": "rows", "ncols": "cols", "xllcorner": "x", "yllcorner": "y", "cellsize": "cell", "nodata_value": "nodata"}


def text_profile(path: str) -> tuple[Profile, int]:
    """Profile and number of header lines of a text grid."""
    found, lines = {}, 0
    with open(path) as f:
        for line in f:
            words = line.split()
            if not words or words[0].lower() not in HEADER:
                break
            name = HEADER[words[0].lower()]
            found[name] = int(words[1]) if name in ("rows", "cols") else float(words[1])
            lines += 1
    return Profile(**found), lines


def profile(path: str) -> Profile:
    if rasterio is None or path.endswith(".asc"):
        return text_profile(path)[0]
    with rasterio.open(path) as src:
        return Profile(src.height, src.width, src.transform.c, src.transform.f, src.transform.a, src.nodata)


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class GridReader(DataSourceReader):
    def __init__(self, path: str, band: int):
        self.path, self.band = path, band

    def partitions(self):
        n = profile(self.path).rows
        return [Rows(a, min(a + CHUNK_ROWS, n)) for a in range(0, n, CHUNK_ROWS)]

    def read(self, partition) -> Iterator[tuple]:
        shape = profile(self.path)
        for r, values in self._rows(partition):
            for c, v in enumerate(values):
                yield r, c, None if v != v or v == shape.nodata else float(v)

    def _rows(self, part):
        if rasterio is not None and not self.path.endswith(".asc"):
            with rasterio.open(self.path) as src:
                block = src.read(self.band, window=((part.begin, part.end), (0, src.width)))
                yield from enumerate(block, part.begin)
            return
        _, skip = text_profile(self.path)
        with open(self.path) as f:
            for i, line in enumerate(f):
                r = i - skip
                if part.begin <= r < part.end:
                    yield r, [float(x) for x in line.split()]
                if r >= part.end:
                    return


class CellGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cellgrid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options["path"], int(self.options.get("band", "1")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CellGrid)


def write_text_grid(cells: DataFrame, path: str, shape: Profile, value: str = "value") -> None:
    """One band as a text grid; rows stream to the driver in order, one partition at a time."""
    nodata = -9999.0 if shape.nodata is None else shape.nodata
    with open(path, "w") as f:
        for name, field in HEADER.items():
            f.write(f"{name} {nodata if field == 'nodata' else getattr(shape, field)}\n")
        now, line = 0, [nodata] * shape.cols
        for row in cells.select("r", "c", value).orderBy("r", "c").toLocalIterator():
            while now < row[0]:
                f.write(" ".join(map(repr, line)) + "\n")
                now, line = now + 1, [nodata] * shape.cols
            if row[2] is not None:
                line[row[1]] = float(row[2])
        while now < shape.rows:
            f.write(" ".join(map(repr, line)) + "\n")
            now, line = now + 1, [nodata] * shape.cols
