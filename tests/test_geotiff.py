"""GeoTIFF files made here, by layout, compression, predictor and sample kind, read back bit for bit."""

import json
import struct
import zlib

import numpy as np
import pytest

from latticework.sources import geotiff, raster


def lzw(data):
    table, width, bits, out = {bytes([k]): k for k in range(256)}, 9, [], b""
    size = 258
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    word = b""
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more], size = size, size + 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        put(table[word])
        size += 1
        if size + 1 > 1 << width:
            width = min(12, width + 1)
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def pack_bits(data):
    return b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100))


def write_tiff(path, bands, order="<", tile=None, strip=7, compression=1, predictor=1, apart=False, big=False, nodata=None):
    """bands: samples x rows x cols."""
    n, rows, cols = bands.shape
    kind = bands.dtype.newbyteorder(order)
    th, tw = tile or (strip, cols)
    chunks = []
    for group in ([bands[k : k + 1] for k in range(n)] if apart else [bands]):
        for r in range(0, rows, th):
            for c in range(0, cols, tw):
                block = group[:, r : r + th, c : c + tw].transpose(1, 2, 0)
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                block = np.ascontiguousarray(block)
                if predictor == 2:
                    whole = block.view(f"u{kind.itemsize}")
                    whole[:, 1:] -= whole[:, :-1].copy()
                data = block.astype(kind).tobytes()
                if predictor == 3:
                    high = np.frombuffer(block.astype(kind.newbyteorder(">")).tobytes(), np.uint8).reshape(block.shape[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(block.shape[0], -1, block.shape[2]).copy()
                    high[:, 1:] -= high[:, :-1].copy()
                    data = high.tobytes()
                chunks.append({1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: pack_bits}[compression](data))
    start = 16 if big else 8
    offsets = np.cumsum([start, *[len(c) for c in chunks]])[:-1].tolist()
    body = b"".join(chunks)
    long_, wide = ("Q", 16) if big else ("I", 4)
    tags = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [kind.itemsize * 8] * n), (259, 3, [compression]), (277, 3, [n]), (284, 3, [2 if apart else 1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n)]
    tags += [(322, 4, [tw]), (323, 4, [th]), (324, wide, offsets), (325, wide, [len(c) for c in chunks])] if tile else [(273, wide, offsets), (278, 4, [strip]), (279, wide, [len(c) for c in chunks])]
    tags += [(33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 1000.0, 5000.0, 0.0])]
    if nodata is not None:
        tags.append((42113, 2, f"{nodata}\0".encode()))
    inline, at, entries, extra = (8 if big else 4), start + len(body), b"", b""
    extra_at = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    for tag, code, values in sorted(tags):
        data = values if code == 2 else struct.pack(f"{order}{len(values)}{geotiff.CODES[code]}", *values)
        if len(data) > inline:
            held = struct.pack(order + long_, extra_at + len(extra))
            extra += data
        else:
            held = data.ljust(inline, b"\0")
        entries += struct.pack(order + "HH" + long_, tag, code, len(values)) + held
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    path.write_bytes(head + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + long_, 0) + extra)
    return offsets


CASES = [
    dict(kind="float32"), dict(kind="float32", tile=(16, 16), compression=8, predictor=3), dict(kind="float64", tile=(32, 16), compression=5, predictor=3, order=">"), dict(kind="uint8", compression=32773), dict(kind="int16", tile=(16, 16), compression=5, predictor=2),
    dict(kind="uint16", n=3, compression=8, predictor=2, order=">"), dict(kind="float32", n=2, apart=True, tile=(16, 16), compression=8, big=True), dict(kind="int32", n=2, tile=(16, 32), compression=5, predictor=2, big=True, order=">"), dict(kind="float32", n=3, compression=8, predictor=3),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: "-".join(map(str, c.values())))
def test_samples_come_back(case, tmp_path):
    case = dict(case)
    rng = np.random.default_rng(3)
    kind, n = np.dtype(case.pop("kind")), case.pop("n", 1)
    bands = (rng.normal(0, 50, (n, 45, 53)) if kind.kind == "f" else rng.integers(0, 120, (n, 45, 53))).astype(kind)
    bands[:, 10:30, 5:40] = bands[:, :1, :1]
    write_tiff(tmp_path / "a.tif", bands, **case)
    image = geotiff.Image.read(str(tmp_path / "a.tif"))
    with open(tmp_path / "a.tif", "rb") as f:
        for band in range(n):
            whole = np.block([[image.tile(f, r, c, band) for c in range(-(-53 // image.tile_cols))] for r in range(-(-45 // image.tile_rows))])
            assert (whole.astype(kind) == bands[band]).all()


def test_windows_masks_and_tiles_never_opened(spark, tmp_path):
    rng = np.random.default_rng(5)
    band = rng.normal(0, 9, (1, 64, 64)).astype("float32")
    band[0, 3, 4], band[0, 5, 6] = -9999, np.nan
    path = tmp_path / "b.tif"
    offsets = write_tiff(path, band, tile=(16, 16), compression=8, predictor=3, nodata=-9999)
    spark.dataSource.register(geotiff.GeoTiffSource)
    read = lambda **o: {(r.row, r.col): r for r in spark.read.format("geotiff").options(**o).load(str(path)).collect()}
    got = read(tilesPerPartition=3)
    assert len(got) == 64 * 64 and got[3, 4].value is None and got[5, 6].value is None
    assert all(np.float32(r.value) == band[0, a, b] for (a, b), r in got.items() if r.value is not None)
    assert (got[0, 0].x, got[0, 0].y, got[63, 63].x, got[63, 63].y) == (1001.0, 4998.5, 1127.0, 4809.5)
    # Only the upper left tile is needed from here on; all others are spoilt.
    data = bytearray(path.read_bytes())
    for k, at in enumerate(offsets):
        if k:
            data[at : at + 4] = b"\xff" * 4
    path.write_bytes(bytes(data))
    part = read(bbox="1001,4953.5,1021,4998.5")
    assert set(part) == {(r, c) for r in range(1, 16) for c in range(10)}
    ring = [(1004.0, 4995.0), (1024.0, 4975.0), (1004.0, 4960.0)]
    inside = read(mask=json.dumps([ring]))
    from .test_geometry import held

    x, y = np.meshgrid(1001 + 2.0 * np.arange(64), 4998.5 - 3.0 * np.arange(64))
    assert set(inside) == {tuple(v) for v in np.argwhere(held(np.array(ring), x, y)).tolist()}
    with pytest.raises(Exception, match=r"decompress|incorrect|header"):
        read()


def test_bands_side_by_side(spark, tmp_path):
    one, two = np.arange(30, dtype="float32").reshape(1, 5, 6), np.arange(30, 60, dtype="int16").reshape(1, 5, 6)
    write_tiff(tmp_path / "one.tif", one)
    write_tiff(tmp_path / "two.TIF", two, compression=8, predictor=2)
    rows = raster.raster_bands(spark, {"a": str(tmp_path / "one.tif"), "b": str(tmp_path / "two.TIF")}).collect()
    assert len(rows) == 30 and all(r.b == r.a + 30 for r in rows)


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"PK\3\4" + b"\0" * 40)
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.Image.read(str(tmp_path / "x.tif"))
