"""Readers: keyed and typed CSV, point-of-interest JSON, and geopackage layers through a Python data source."""

from __future__ import annotations

import csv
import io
import json
import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from latticework.functions.scalar import tag_class
from latticework.operators.merge import last_of_key


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def keyed_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All columns as strings, "" as null; of rows with the same key the last one in the file."""
    raw = spark.read.csv(path, header=True, nullValue="", emptyValue="")
    own = require_columns(raw, [key]).withColumn("_line", F.monotonically_increasing_id())
    return last_of_key(own, key, "_line")


def typed_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A projection of a CSV file under a given schema; nothing is inferred."""
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, enforceSchema=False)
    return require_columns(df, columns).select(*columns) if columns else df


#: Encodings that a text may be in, in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1254")


def _decoded(sep: str, columns: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for encoding in ENCODINGS:
                    try:
                        text = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"{path} is in none of {ENCODINGS}")
                found = list(csv.DictReader(io.StringIO(text, newline=""), delimiter=sep))
                missing = [c for c in columns if found and c not in found[0]]
                if missing:
                    raise ValueError(f"missing columns of {path}: {missing}")
                yield pa.RecordBatch.from_pydict({"source_file": [path] * len(found), "source_row": list(range(2, len(found) + 2)), **{c: [r[c] or None for r in found] for c in columns}}, schema=pa.schema([("source_file", pa.string()), ("source_row", pa.int64()), *((c, pa.string()) for c in columns)]))

    return rows


def decoded_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """CSV files whose encoding isn't told: source_file, source_row (its line, the header being 1) and columns as text.

    A file is decoded whole by the first encoding that fits, as an encoding can't be told from a part; files are spread over tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = ", ".join(["source_file string", "source_row long", *(f"`{c}` string" for c in columns)])
    return files.mapInArrow(_decoded(sep, columns), schema)


def json_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, such as feature sets and recipes, read through Spark's file systems."""
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


ELEMENTS = "elements array<struct<type:string,id:long,lon:double,lat:double,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>"
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def closed_rings(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings that lines close, alone or joined end to end; what closes nothing is left out."""
    rings, open_ = [], []
    for line in lines:
        (rings if len(line) >= 4 and line[0] == line[-1] else open_).append(line)
    ends: dict[tuple[float, float], list[int]] = {}
    for k, line in enumerate(open_):
        for p in (line[0], line[-1]):
            ends.setdefault(p, []).append(k)
    used: set[int] = set()
    for k in range(len(open_)):
        if k in used:
            continue
        chain, way = list(open_[k]), [k]
        while chain[0] != chain[-1]:
            following = [j for j in ends[chain[-1]] if j not in way and j not in used]
            if not following:
                break
            j = following[0]
            way.append(j)
            chain += open_[j][1:] if open_[j][0] == chain[-1] else open_[j][-2::-1]
        if chain[0] == chain[-1] and len(chain) >= 4:
            rings.append(chain)
            used.update(way)
    return rings


@F.pandas_udf(RINGS)
def outer_rings(members: pd.Series) -> pd.Series:
    """Rings of a relation's outer ways."""

    def one(ms) -> list:
        lines = [[(p["lon"], p["lat"]) for p in m["geometry"] if p["lon"] is not None and p["lat"] is not None] for m in (ms if ms is not None else ()) if m["type"] == "way" and m["role"] in ("outer", "", None) and m["geometry"] is not None]
        return [[{"x": x, "y": y} for x, y in r] for r in closed_rings([line for line in lines if len(line) >= 2])]

    return members.map(one, na_action=None)


def osm_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations of a cached payload whose outer ways close: osm_id, context_class, rings (one per part)."""
    e = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*").filter("type = 'relation'")
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    out = e.select(F.lit("relation").alias("osm_type"), F.col("id").alias("osm_id"), tag_class(tags).alias("context_class"), outer_rings("members").alias("rings"))
    return out.filter(F.size("rings") > 0)


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a cached payload: osm_type, osm_id, context_class, geometry kind and coordinates, centroid of the vertices.

    Nodes are points; ways are polygons if closed with four coordinates or more, else lines; elements without coordinates go.
    """
    e = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    points = F.when(F.col("type") == "node", F.array(F.struct("lon", "lat"))).otherwise(F.col("geometry"))
    e = e.withColumn("points", F.filter(F.coalesce(points, F.array().cast("array<struct<lon:double,lat:double>>")), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()))
    n = F.size("points")
    closed = (n >= 4) & (F.element_at("points", 1) == F.element_at("points", -1))
    kind = F.when(F.col("type") == "node", F.when(n == 1, "point")).when(closed, "polygon").when(n >= 2, "line")

    def mean(axis: str):
        return F.aggregate("points", F.lit(0.0), lambda a, p: a + p[axis]) / n

    out = e.withColumn("kind", kind).filter("kind IS NOT NULL")
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    return out.select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), tag_class(tags).alias("context_class"), "kind", "points", mean("lon").alias("lon"), mean("lat").alias("lat"))


class GeopackageSource(DataSource):
    """spark.read.format("geopackage").option("layer", ...).load(path): attributes and the geometry as WKB.

    The path is a file, or a folder of parts (*.gpkg) that have the layer alike, readable on every executor (a shared file system).
    Partitions are ranges of feature ids.  Option bbox
    ("x0,y0,x1,y1") reads the features whose bounds meet it: through the layer's spatial index where there is one, else by the bounds in
    each geometry's header; a geometry without bounds there is read.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _table(self, con: sqlite3.Connection) -> tuple[str, str]:
        layers = dict(con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
        layer = self.options.get("layer")
        if layer is None and len(layers) == 1:
            layer = next(iter(layers))
        if layer not in layers:
            raise ValueError(f"layer {layer!r} not found; there are {sorted(layers)}")
        return layer, layers[layer]

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "SMALLINT": "long", "TINYINT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "BLOB": "binary"}
        files = package_files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no part")
        with sqlite3.connect(f"file:{files[0]}?mode=ro", uri=True) as con:
            layer, geometry = self._table(con)
            columns = con.execute(f'PRAGMA table_info("{layer}")').fetchall()
        return ", ".join(f"`{c[1]}` {'binary' if c[1] == geometry else kinds.get(c[2].upper().split('(')[0], 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeopackageReader(self.options, schema, self)


def package_files(path: str) -> list[str]:
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".gpkg")) if os.path.isdir(path) else [path]


class Ids(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class GeopackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, source: GeopackageSource):
        self.files, self.names = package_files(options["path"]), schema.names
        self.flags = [k for k, f in enumerate(schema.fields) if isinstance(f.dataType, T.BooleanType)]
        with sqlite3.connect(f"file:{self.files[0]}?mode=ro", uri=True) as con:
            self.layer, self.geometry = source._table(con)
            index = f"rtree_{self.layer}_{self.geometry}"
            self.index = index if con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (index,)).fetchone()[0] else None
        self.rows = int(options.get("rowsPerPartition", 100_000))
        self.bbox = tuple(map(float, options["bbox"].split(","))) if "bbox" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer}"').fetchone()
            out += [] if low is None else [Ids(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: Ids | None) -> Iterator[tuple]:
        if partition is None:  # an empty layer has no partition
            return
        at = self.names.index(self.geometry)
        wanted = ", ".join(f'"{c}"' for c in self.names)
        where, values = "rowid BETWEEN ? AND ?", [partition.low, partition.high]
        if self.bbox and self.index:
            x0, y0, x1, y1 = self.bbox
            where += f' AND rowid IN (SELECT id FROM "{self.index}" WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)'
            values += [x0, x1, y0, y1]
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as con:
            for row in con.execute(f'SELECT {wanted} FROM "{self.layer}" WHERE {where}', values):
                if not self.bbox or self.index or meets(row[at], self.bbox):
                    out = [*row[:at], wkb(row[at]), *row[at + 1 :]]
                    for k in self.flags:
                        out[k] = None if out[k] is None else bool(out[k])
                    yield tuple(out)


def meets(blob: bytes | None, bbox: tuple[float, float, float, float]) -> bool:
    """Whether the bounds in a geopackage blob's header meet the box; true where it has none."""
    if blob is None or blob[:2] != b"GP" or not (blob[3] >> 1) & 7:
        return True
    x0, x1, y0, y1 = struct.unpack_from(("<" if blob[3] & 1 else ">") + "4d", blob, 8)
    return x1 >= bbox[0] and x0 <= bbox[2] and y1 >= bbox[1] and y0 <= bbox[3]


def wkb(blob: bytes | None) -> bytes | None:
    """A geopackage blob without its header (8 bytes and an envelope of 0 to 8 doubles)."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + 8 * (0, 4, 6, 6, 8)[(blob[3] >> 1) & 7] :]
