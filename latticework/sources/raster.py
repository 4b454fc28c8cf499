"""Raster bands as pixel tables: binary grids of 32-bit floats with a text header (.flt and .hdr), read by windows of rows."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "px long, row long, col long, x double, y double, value double"


def grid_header(path: str) -> dict[str, float | str]:
    """ncols, nrows, xllcorner, yllcorner, cellsize, nodata_value and byteorder of the header beside a .flt file."""
    with open(os.path.splitext(path)[0] + ".hdr", encoding="ascii") as f:
        pairs = dict(line.lower().split(None, 1) for line in f if line.strip())
    out: dict[str, float | str] = {"nodata_value": "nan", "byteorder": "lsbfirst"} | {k: v.strip() for k, v in pairs.items()}
    missing = {"ncols", "nrows", "xllcorner", "yllcorner", "cellsize"} - set(out)
    if missing:
        raise ValueError(f"the header of {path} lacks {sorted(missing)}")
    return {k: v if k == "byteorder" else float(v) for k, v in out.items()}


class FloatGridSource(DataSource):
    """spark.read.format("floatgrid").load(path): a row per pixel in raster order, x and y its centre, value null at nodata or where it isn't
    finite.  Option bbox ("x0,y0,x1,y1") reads the window of pixels whose centre lies in it (lower and left edge included).

    The file must be readable by path on every executor (a shared file system).  A partition is a number of rows.
    """

    @classmethod
    def name(cls) -> str:
        return "floatgrid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FloatGridReader(self.options)


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class FloatGridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.h = options["path"], grid_header(options["path"])
        self.pixels = int(options.get("pixelsPerPartition", 1 << 22))
        rows, cols, size = int(self.h["nrows"]), int(self.h["ncols"]), self.h["cellsize"]
        self.window = (0, rows, 0, cols)
        if "bbox" in options:
            x0, y0, x1, y1 = map(float, options["bbox"].split(","))
            top = self.h["yllcorner"] + rows * size
            # Pixel centres in [x0, x1) and [y0, y1).
            left, right = (math.ceil((x - self.h["xllcorner"]) / size - 0.5) for x in (x0, x1))
            first, last = (math.floor((top - y) / size - 0.5) + 1 for y in (y1, y0))
            self.window = (max(first, 0), min(last, rows), max(left, 0), min(right, cols))

    def partitions(self) -> list[InputPartition]:
        first, last, left, right = self.window
        step = max(1, self.pixels // max(1, int(self.h["ncols"])))
        return [Rows(a, min(a + step, last)) for a in range(first, last, step)] if left < right else []

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty window has no partition
            return
        rows, cols, size = int(self.h["nrows"]), int(self.h["ncols"]), self.h["cellsize"]
        _, _, left, right = self.window
        kind = np.dtype(">f4" if self.h["byteorder"] == "msbfirst" else "<f4")
        with open(self.path, "rb") as f:
            for row in range(partition.first, partition.last):
                f.seek((row * cols + left) * 4)
                values = np.frombuffer(f.read((right - left) * 4), kind).astype(float)
                col = np.arange(left, right)
                gone = ~np.isfinite(values) | (values == self.h["nodata_value"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row * cols + col), pa.array(np.full(len(col), row)), pa.array(col), pa.array(self.h["xllcorner"] + (col + 0.5) * size),
                    pa.array(np.full(len(col), self.h["yllcorner"] + (rows - row - 0.5) * size)), pa.array(values, mask=gone),
                ], names=["px", "row", "col", "x", "y", "value"])


def raster_bands(spark: SparkSession, paths: dict[str, str], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Bands of one lattice side by side: px, row, col, x, y and a column per name; .tif files as GeoTIFF, others as float grids."""
    from .geotiff import GeoTiffSource

    spark.dataSource.register(FloatGridSource)
    spark.dataSource.register(GeoTiffSource)
    out = None
    for name, path in paths.items():
        reader = spark.read.format("geotiff" if path.lower().endswith((".tif", ".tiff")) else "floatgrid")
        band = (reader.option("bbox", ",".join(map(str, bbox))) if bbox else reader).load(path).withColumnRenamed("value", name)
        out = band if out is None else out.join(band.select("px", name), "px")
    return out


def write_grid(df: DataFrame, path: str, rows: int, cols: int, x: float, y: float, size: float, nodata: float = -9999.0) -> None:
    """A small band (row, col, value) as such a file; the driver holds rows * cols floats."""
    grid = np.full((rows, cols), nodata, "<f4")
    for r in df.select("row", "col", "value").filter(F.col("value").isNotNull()).toLocalIterator():
        grid[r["row"], r["col"]] = r["value"]
    grid.tofile(path)
    with open(os.path.splitext(path)[0] + ".hdr", "w", encoding="ascii") as f:
        f.write(f"ncols {cols}\nnrows {rows}\nxllcorner {x}\nyllcorner {y}\ncellsize {size}\nNODATA_value {nodata}\nbyteorder LSBFIRST\n")
