"""Writing layers: geometries as WKB, and geopackage parts with a spatial index behind a data source with commit and abort."""

from __future__ import annotations

import os
import sqlite3
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

#: Numbers of the geometry kinds (fixed values of the format), and how deep lists of points stand in each.
KINDS = {"point": 1, "linestring": 2, "polygon": 3, "multipoint": 4, "multilinestring": 5, "multipolygon": 6}
PARTS = {4: 1, 5: 2, 6: 3}


def encode(kind: int, shape: object) -> bytes:
    """WKB of nested lists of (x, y): a point, a list of points, a list of rings (closed where they aren't), or a list of such."""
    head = struct.pack("<BI", 1, kind)
    if kind == 1:
        return head + struct.pack("<2d", *shape)
    if kind in PARTS:
        return head + struct.pack("<I", len(shape)) + b"".join(encode(PARTS[kind], s) for s in shape)
    lines = [_closed(r) for r in shape] if kind == 3 else [shape]
    body = b"".join(struct.pack("<I", len(line)) + np.array(line, "<f8").tobytes() for line in lines)
    return head + (struct.pack("<I", len(lines)) if kind == 3 else b"") + body


def _closed(ring: list) -> list:
    return [*ring, ring[0]] if ring and ring[0] != ring[-1] else ring


def _points(value: object) -> object:
    """Structs of x and y as pairs, at any depth."""
    return (value["x"], value["y"]) if isinstance(value, dict) else [_points(v) for v in value]


def _encoding(kind: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                shapes = [None if v is None or (kind != 1 and not v) else encode(kind, _points(v)) for v in part.column(at).to_pylist()]
                columns = [pa.array(shapes, pa.binary()) if k == at else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def with_wkb(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The table with a column of nested lists of structs (x, y) turned into WKB; null and empty ones become null."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    at = df.columns.index(column)
    fields = ", ".join(f"`{f.name}` {'binary' if k == at else f.dataType.simpleString()}" for k, f in enumerate(df.schema.fields))
    return df.mapInArrow(_encoding(KINDS[kind], at), fields)


def bounds(wkb: bytes) -> tuple[float, float, float, float] | None:
    """x0, x1, y0, y1 of a little-endian geometry without further dimensions; None without points."""
    found: list[np.ndarray] = []

    def read(at: int) -> int:
        kind = struct.unpack_from("<I", wkb, at + 1)[0]
        at += 5
        if kind == 1:
            found.append(np.frombuffer(wkb, "<f8", 2, at).reshape(1, 2))
            return at + 16
        (n,) = struct.unpack_from("<I", wkb, at)
        at += 4
        if kind == 2:
            found.append(np.frombuffer(wkb, "<f8", 2 * n, at).reshape(-1, 2))
            return at + 16 * n
        for _ in range(n):
            if kind == 3:
                (k,) = struct.unpack_from("<I", wkb, at)
                found.append(np.frombuffer(wkb, "<f8", 2 * k, at + 4).reshape(-1, 2))
                at += 4 + 16 * k
            else:
                at = read(at)
        return at

    read(0)
    points = np.concatenate(found) if found else np.zeros((0, 2))
    if not len(points):
        return None
    low, high = points.min(axis=0), points.max(axis=0)
    return float(low[0]), float(high[0]), float(low[1]), float(high[1])


@dataclass
class Part(WriterCommitMessage):
    temporary: str
    name: str


class LayerParts(DataSource):
    """df.write.format("geopackage_parts").option("layer", ...).save(path): a geopackage per partition below path, each with the layer, its
    spatial index and its bounds.

    Options: geometry (the WKB column, ``geom``), kind (of its geometries), srs (an EPSG number, 0 if unknown).  The path must be a folder
    that all executors share.  Files have temporary names until all tasks are done, so a job that fails leaves no part; what a lost
    task leaves is removed by commit and abort alike.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage_parts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LayerWriter(self.options, schema, overwrite)


class LayerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.layer, self.geometry = options["path"], options.get("layer", "layer"), options.get("geometry", "geom")
        self.kind, self.srs, self.job, self.overwrite = options.get("kind", "geometry"), int(options.get("srs", 0)), uuid.uuid4().hex, overwrite
        types = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
        self.columns = [(f.name, types.get(f.dataType.simpleString(), "TEXT")) for f in schema.fields]
        names = [f.name for f in schema.fields if isinstance(f.dataType, BinaryType)]
        if self.geometry not in names:
            raise ValueError(f"{self.geometry!r} is no column of WKB")
        if any(c.lower() == "fid" for c, _ in self.columns):
            raise ValueError("fid is the name of the feature's own number")
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        partition = TaskContext.get().partitionId()
        temporary = f"{self.path}/.{self.job}-{partition:06d}-{uuid.uuid4().hex[:8]}"
        con = sqlite3.connect(temporary)
        con.execute("PRAGMA journal_mode = OFF")
        con.execute("PRAGMA application_id = 1196444487")
        con.execute("PRAGMA user_version = 10300")
        self._tables(con)
        at = [c for c, _ in self.columns].index(self.geometry)
        marks = ", ".join("?" * (len(self.columns) + 1))
        fid, whole = partition << 40, None
        for batch in iterator:
            rows, index = [], []
            for row in zip(*(self._values(c) for c in batch.columns), strict=True):
                fid += 1
                box = bounds(row[at]) if row[at] is not None else None
                rows.append((fid, *row[:at], self._blob(row[at], box), *row[at + 1 :]))
                if box:
                    index.append((fid, *box))
                    whole = box if whole is None else (min(whole[0], box[0]), max(whole[1], box[1]), min(whole[2], box[2]), max(whole[3], box[3]))
            con.executemany(f'INSERT INTO "{self.layer}" VALUES ({marks})', rows)
            con.executemany(f'INSERT INTO "rtree_{self.layer}_{self.geometry}" VALUES (?, ?, ?, ?, ?)', index)
        x0, x1, y0, y1 = whole or (None,) * 4
        con.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ?", (x0, y0, x1, y1))
        con.commit()
        con.close()
        return Part(temporary, f"{self.path}/part-{partition:06d}-{self.job}.gpkg")

    def _values(self, column: pa.Array) -> list:
        kind = column.type
        plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind) or pa.types.is_string(kind)
        return column.to_pylist() if plain else [None if v is None else str(v) for v in column.to_pylist()]

    def _blob(self, wkb: bytes | None, box: tuple[float, float, float, float] | None) -> bytes | None:
        """The geometry with a geopackage's header: little-endian, with its bounds, marked empty without points."""
        if wkb is None:
            return None
        if box is None:
            return b"GP\0" + struct.pack("<Bi", 0b10001, self.srs) + wkb
        return b"GP\0" + struct.pack("<Bi4d", 0b11, self.srs, *box) + wkb

    def _tables(self, con: sqlite3.Connection) -> None:
        """The tables that the format asks for (fixed names of the format)."""
        con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        known = [("undefined cartesian", -1, "NONE", -1, "undefined", None), ("undefined geographic", 0, "NONE", 0, "undefined", None)]
        known += [(f"EPSG:{self.srs}", self.srs, "EPSG", self.srs, "undefined", None)] if self.srs > 0 else []
        con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", known)
        con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (self.layer, self.layer, self.srs))
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, 0, 0)", (self.layer, self.geometry, self.kind.upper(), self.srs))
        con.execute("CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL)")
        con.execute("INSERT INTO gpkg_extensions VALUES (?, ?, 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (self.layer, self.geometry))
        fields = ", ".join(f'"{c}" {t}' for c, t in self.columns)
        con.execute(f'CREATE TABLE "{self.layer}" (fid INTEGER PRIMARY KEY, {fields})')
        con.execute(f'CREATE VIRTUAL TABLE "rtree_{self.layer}_{self.geometry}" USING rtree(id, minx, maxx, miny, maxy)')

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        old = {f for f in os.listdir(self.path) if f.endswith(".gpkg")} if self.overwrite else set()
        for m in messages:
            if isinstance(m, Part):
                os.replace(m.temporary, m.name)
        for f in old:
            os.remove(f"{self.path}/{f}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for f in os.listdir(self.path):
            if f.startswith(f".{self.job}"):
                os.remove(f"{self.path}/{f}")


def write_layer(df: DataFrame, path: str, layer: str, geometry: str = "geom", kind: str = "polygon", srs: int = 0, mode: str = "append") -> None:
    """A table with a column of nested points as geopackage parts."""
    df.sparkSession.dataSource.register(LayerParts)
    out = with_wkb(df, geometry, kind)
    out.write.format("geopackage_parts").option("layer", layer).option("geometry", geometry).option("kind", kind).option("srs", srs).mode(mode).save(path)
