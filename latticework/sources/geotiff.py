"""GeoTIFF bands as pixel tables: strips or tiles are the unit of reading, a window or a polygon decides which are opened.

Classic and big files of either byte order; no compression, LZW, Deflate or PackBits; predictors 2 and 3; whole and real samples of any
width, planes apart or interleaved.  Only the directory is read when a query is planned.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .raster import SCHEMA

#: Bytes of each field type of a directory (fixed values of the format).
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags that are used (fixed values of the format).
WIDTH, LENGTH, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_SIZE, FORMAT, SCALE, TIE, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


def directory(f: BinaryIO) -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order and tags of the first image."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    f.seek(struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0])
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    size = 20 if big else 12
    raw, tags = f.read(n * size), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * size)
        length, inline = WIDTHS.get(kind, 1) * count, 8 if big else 4
        at = k * size + size - inline
        if length <= inline:
            data = raw[at : at + length]
        else:
            f.seek(struct.unpack_from(order + ("Q" if big else "I"), raw, at)[0])
            data = f.read(length)
        tags[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", data) if kind in CODES else data
    return order, tags


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 starts a new table, 257 ends, and a width is left one code early."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(single), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


@dataclass
class Image:
    """Layout of the first image of a file."""

    order: str
    rows: int
    cols: int
    tile_rows: int
    tile_cols: int
    tiled: bool
    at: tuple
    sizes: tuple
    compression: int
    predictor: int
    samples: int
    apart: bool
    kind: np.dtype
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None

    @classmethod
    def read(cls, path: str) -> Image:
        with open(path, "rb") as f:
            order, t = directory(f)
        one = lambda tag, default: t[tag][0] if tag in t else default
        rows, cols, tiled = one(LENGTH, 0), one(WIDTH, 0), TILE_WIDTH in t
        bits, letter = one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
        if letter is None or bits not in (8, 16, 32, 64):
            raise ValueError(f"samples of format {one(FORMAT, 1)} with {bits} bits can't be read")
        tile_rows = one(TILE_LENGTH, 0) if tiled else min(one(STRIP_ROWS, rows), rows)
        scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIE, (0.0,) * 6)
        text = t.get(NODATA, b"").split(b"\0")[0].strip()
        return cls(
            order, rows, cols, tile_rows, one(TILE_WIDTH, 0) if tiled else cols, tiled, t[TILE_AT if tiled else STRIP_AT], t[TILE_SIZE if tiled else STRIP_SIZE], one(COMPRESSION, 1), one(PREDICTOR, 1),
            one(SAMPLES, 1), one(PLANAR, 1) == 2, np.dtype(f"{order}{letter}{bits // 8}"), tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], float(text) if text else None,
        )

    def tile(self, f: BinaryIO, row: int, col: int, band: int) -> np.ndarray:
        """Samples of one band in a tile (or strip), cut to the image."""
        across, down = -(-self.cols // self.tile_cols), -(-self.rows // self.tile_rows)
        k = (band * down * across if self.apart else 0) + row * across + col
        f.seek(self.at[k])
        data = f.read(self.sizes[k])
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression == 5:
            data = unpack_lzw(data)
        elif self.compression == 32773:
            data = unpack_bits(data)
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression} can't be read")
        inner, width = 1 if self.apart else self.samples, self.kind.itemsize
        height = self.tile_rows if self.tiled else min(self.tile_rows, self.rows - row * self.tile_rows)
        raw = np.frombuffer(data, np.uint8, height * self.tile_cols * inner * width)
        if self.predictor == 3:
            # Rows of bytes: all highest bytes first, each the difference to the one ``inner`` before.
            flat = np.cumsum(raw.reshape(height, -1, inner), axis=1, dtype=np.uint8).reshape(height, width, -1)
            grid = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(self.kind.newbyteorder(">")).reshape(height, self.tile_cols, inner)
        else:
            grid = raw.view(self.kind).reshape(height, self.tile_cols, inner)
            if self.predictor == 2:
                whole = np.dtype(f"u{width}")
                grid = np.cumsum(grid.astype(self.kind.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(self.kind.newbyteorder("="))
        return grid[: self.rows - row * self.tile_rows, : self.cols - col * self.tile_cols, 0 if self.apart else band]


def row_spans(rings: list[np.ndarray], y: float) -> list[tuple[float, float]]:
    """Stretches of a scan line inside a polygon, by its crossings in order."""
    xs = []
    for ring in rings:
        after = np.roll(ring, -1, axis=0)
        on = (ring[:, 1] <= y) != (after[:, 1] <= y)
        a, b = ring[on], after[on]
        xs += (a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).tolist()
    xs.sort()
    return list(zip(xs[::2], xs[1::2], strict=True))


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").load(path): a row per pixel of a band (option ``band``, from 0), x and y its centre, value null at nodata
    or where it isn't finite.

    Option bbox ("x0,y0,x1,y1") reads the pixels whose centre lies in it (lower and left edge included), option mask (rings as JSON,
    [[[x, y], ...], ...]) those whose centre lies in a polygon.  Tiles without such a pixel are never opened.  The path must be
    readable on every executor; a partition is ``tilesPerPartition`` tiles.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoTiffReader(self.options)


class Tiles(InputPartition):
    def __init__(self, tiles: list[tuple[int, int]]) -> None:
        self.tiles = tiles


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.band, self.step = options["path"], int(options.get("band", 0)), int(options.get("tilesPerPartition", 16))
        self.image = Image.read(self.path)
        if not 0 <= self.band < self.image.samples:
            raise ValueError(f"there are {self.image.samples} bands")
        self.mask = [np.array(r, float).reshape(-1, 2) for r in json.loads(options["mask"])] if "mask" in options else None
        box = tuple(map(float, options["bbox"].split(","))) if "bbox" in options else (-math.inf, -math.inf, math.inf, math.inf)
        if self.mask:
            low, high = np.min([r.min(0) for r in self.mask], axis=0), np.max([r.max(0) for r in self.mask], axis=0)
            box = (max(box[0], low[0]), max(box[1], low[1]), min(box[2], np.nextafter(high[0], math.inf)), min(box[3], np.nextafter(high[1], math.inf)))
        self.box = box

    def _near(self, value: float, most: int) -> int:
        return 0 if value == -math.inf else most if value == math.inf else max(0, min(most, math.ceil(value)))

    def window(self) -> tuple[int, int, int, int]:
        """First and last row and column (exclusive) whose centres lie in the box."""
        i, (x0, y0, x1, y1) = self.image, self.box
        cols = (self._near((x - i.x0) / i.dx - 0.5, i.cols) for x in (x0, x1))
        # Rows go down: a centre at y0 is in, one at y1 is not.
        first, last = (-math.inf if y == math.inf else math.inf if y == -math.inf else math.floor((i.y0 - y) / i.dy - 0.5) + 1 for y in (y1, y0))
        return (self._near(first, i.rows), self._near(last, i.rows), *cols)

    def partitions(self) -> list[InputPartition]:
        i, (top, bottom, left, right) = self.image, self.window()
        if top >= bottom or left >= right:
            return []
        tiles = [(r, c) for r in range(top // i.tile_rows, -(-bottom // i.tile_rows)) for c in range(left // i.tile_cols, -(-right // i.tile_cols))]
        if self.mask:
            tiles = [t for t in tiles if any(self._kept(row, t[1]).any() for row in range(max(top, t[0] * i.tile_rows), min(bottom, (t[0] + 1) * i.tile_rows)))]
        return [Tiles(tiles[k : k + self.step]) for k in range(0, len(tiles), self.step)]

    def _kept(self, row: int, tile_col: int) -> np.ndarray:
        """Columns of a tile's row that the window and the mask keep."""
        i, (_, _, left, right) = self.image, self.window()
        col = np.arange(tile_col * i.tile_cols, min(i.cols, (tile_col + 1) * i.tile_cols))
        keep = (col >= left) & (col < right)
        if self.mask:
            x = i.x0 + (col + 0.5) * i.dx
            inside = np.zeros(len(col), bool)
            for a, b in row_spans(self.mask, i.y0 - (row + 0.5) * i.dy):
                inside |= (x >= a) & (x < b)
            keep &= inside
        return keep

    def read(self, partition: Tiles | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty window has no partition
            return
        i, (top, bottom, _, _) = self.image, self.window()
        with open(self.path, "rb") as f:
            for tile_row, tile_col in partition.tiles:
                values = i.tile(f, tile_row, tile_col, self.band).astype(float)
                for k in range(len(values)):
                    row = tile_row * i.tile_rows + k
                    keep = np.flatnonzero(self._kept(row, tile_col)) if top <= row < bottom else np.zeros(0, int)
                    if not len(keep):
                        continue
                    col, v = tile_col * i.tile_cols + keep, values[k, keep]
                    gone = ~np.isfinite(v) | (v == i.nodata if i.nodata is not None else False)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row * i.cols + col), pa.array(np.full(len(col), row)), pa.array(col), pa.array(i.x0 + (col + 0.5) * i.dx),
                        pa.array(np.full(len(col), i.y0 - (row + 0.5) * i.dy)), pa.array(v, mask=gone),
                    ], names=["px", "row", "col", "x", "y", "value"])
