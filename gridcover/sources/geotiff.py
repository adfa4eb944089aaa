"""GeoTIFF rasters as pixel tables: metadata and digest gates, and a reader for tiles or strips of 32-bit floats (uncompressed, LZW or
deflate). Spark reads files as binary rows; one task takes a file apart into tiles as they are stored, which are then dealt out, so that all
executors decode, however few files there are."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags by number.
TAGS = {256: "width", 257: "height", 258: "bits_per_sample", 259: "compression", 262: "photometric", 273: "strip_offsets", 277: "samples_per_pixel", 278: "rows_per_strip", 279: "strip_sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_sizes", 339: "sample_format", 33550: "pixel_scale", 33922: "tiepoint", 34735: "key_directory", 34736: "double_parameters", 34737: "ascii_parameters", 42113: "nodata"}
#: What the pinned source raster must say.
EXPECTED = {
    "width": 43200, "height": 17280, "bits_per_sample": [32], "samples_per_pixel": 1, "sample_format": [3], "photometric": 1, "planar": 1, "compression": 5, "predictor": 1, "tile_width": 512, "tile_height": 512,
    "pixel_scale": [0.0083333333, 0.0083333333, 0.0], "tiepoint": [0.0, 0.0, 0.0, -180.0, 84.0, 0.0],
    "key_directory": [1, 1, 0, 7, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326, 2049, 34737, 7, 0, 2054, 0, 1, 9102, 2057, 34736, 1, 1, 2059, 34736, 1, 0],
    "double_parameters": [298.257223563, 6378137.0], "ascii_parameters": "WGS 84|", "nodata": "-99999", "additional_images": False,
}
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_LISTS = {"bits_per_sample", "sample_format", "strip_offsets", "strip_sizes", "tile_offsets", "tile_sizes", "pixel_scale", "tiepoint", "key_directory", "double_parameters"}
_DEFAULTS = {"compression": 1, "predictor": 1, "samples_per_pixel": 1, "planar": 1, "sample_format": [1]}


def metadata(data: bytes) -> dict:
    """The first image's tags by name; ValueError for what isn't a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    out: dict = {"order": order} | _DEFAULTS
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if tag not in TAGS or kind not in _KINDS:
            continue
        size = struct.calcsize(_KINDS[kind]) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        name = TAGS[tag]
        if kind == 2:
            out[name] = data[where : where + count].split(b"\0")[0].decode("ascii")
        else:
            values = list(struct.unpack_from(f"{order}{count}{_KINDS[kind]}", data, where))
            out[name] = values if name in _LISTS else values[0]
    (more,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    out["additional_images"] = more != 0
    return out


def require_metadata(found: dict, expected: dict = EXPECTED) -> None:
    """Raises for the first field that isn't as expected."""
    for name, value in expected.items():
        if found.get(name) != value:
            raise ValueError(f"GeoTIFF {name} is {found.get(name)!r}, not {value!r}")


def is_lzw(data: bytes) -> bool:
    return metadata(data)["compression"] == 5


def digest(path: str, chunk: int = 1 << 16) -> str:
    """SHA-256 of a file in lower-case hexadecimal, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def require_digest(files: DataFrame, expected: str) -> DataFrame:
    """binaryFile rows, each of which raises when its content has another SHA-256."""
    return files.where(F.assert_true(F.sha2("content", 256) == F.lit(expected), F.lit("the source has another digest")).isNull())


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, 256 clears, 257 ends."""
    out, entries, width, held, bits, last = [], [bytes([k]) for k in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del entries[258:]
            width, last = 9, b""
            continue
        if not last:
            last = entries[code]
        else:
            now = entries[code] if code < len(entries) else last + last[:1]
            entries.append(last + now[:1])
            last = now
        out.append(last)
        if len(entries) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def stored_tiles(data: bytes) -> Iterator[dict]:
    """Each tile or strip as it is stored, with its place, its shape as stored and as cut to the image, and how to decode it."""
    m = metadata(data)
    if m.get("bits_per_sample") != [32] or m["sample_format"] != [3] or m["samples_per_pixel"] != 1 or m["predictor"] != 1:
        raise ValueError("only single-band 32-bit floats without predictor are read")
    if m["compression"] not in (1, 5, 8, 32946):
        raise ValueError(f"compression {m['compression']} is not read")
    tiled = "tile_width" in m
    w, h = (m["tile_width"], m["tile_height"]) if tiled else (m["width"], m.get("rows_per_strip", m["height"]))
    across = -(-m["width"] // w)
    for k, (offset, size) in enumerate(zip(m["tile_offsets" if tiled else "strip_offsets"], m["tile_sizes" if tiled else "strip_sizes"], strict=True)):
        x, y = k % across * w, k // across * h
        high = min(h, m["height"] - y)
        yield {"x": x, "y": y, "w": w, "h": h if tiled else high, "wide": min(w, m["width"] - x), "high": high, "compression": m["compression"], "order": m["order"], "raw": data[offset : offset + size]}


def samples(t: dict) -> np.ndarray:
    """The samples of a stored tile, cut to the image."""
    raw = t["raw"]
    if t["compression"] == 5:
        raw = unpack_lzw(raw)
    elif t["compression"] != 1:
        raw = zlib.decompress(raw)
    if len(raw) < 4 * t["w"] * t["h"]:
        raise ValueError("a tile is cut short")
    return np.frombuffer(raw, t["order"] + "f4", t["w"] * t["h"]).reshape(t["h"], t["w"])[: t["high"], : t["wide"]].astype(np.float32)


def tiles(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """x, y and samples of each tile or strip, cut to the image."""
    for t in stored_tiles(data):
        yield t["x"], t["y"], samples(t)


_STORED = pa.schema([(k, pa.int32()) for k in ("x", "y", "w", "h", "wide", "high", "compression")] + [("order", pa.string()), ("raw", pa.binary())])


def read(spark: SparkSession, path: str, expected: dict | None = None, sha256: str | None = None, partitions: int | None = None) -> DataFrame:
    """pixel_x, pixel_y, population of the rasters under a path; the gates are optional. Tiles are decoded in `partitions` tasks (four a core
    if not given); what is shuffled is their stored form."""
    files = spark.read.format("binaryFile").load(path).select("content")
    if sha256:
        files = require_digest(files, sha256)

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                if expected is not None:
                    require_metadata(metadata(data), expected)
                for t in stored_tiles(data):
                    yield pa.RecordBatch.from_pylist([t], schema=_STORED)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (t,) = b.slice(k, 1).to_pylist()
                v = samples(t)
                y, x = np.mgrid[t["y"] : t["y"] + v.shape[0], t["x"] : t["x"] + v.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel(), pa.int32()), pa.array(y.ravel(), pa.int32()), pa.array(v.ravel(), pa.float32())], names=["pixel_x", "pixel_y", "population"])

    stored = files.mapInArrow(taken_apart, "x int, y int, w int, h int, wide int, high int, compression int, order string, raw binary")
    return stored.repartition(partitions or 4 * spark.sparkContext.defaultParallelism).mapInArrow(decoded, "pixel_x int, pixel_y int, population float")


def write_mock(path: str, values: np.ndarray, compression: int = 1, tile: int | None = None) -> None:
    """A small raster of one strip or of square tiles, uncompressed or deflate, with the pinned raster's scale and corner."""
    (h, w), size = values.shape, tile or 0
    if tile:
        parts = [np.pad(values, ((0, -h % size), (0, -w % size)))[y : y + size, x : x + size] for y in range(0, h, size) for x in range(0, w, size)]
    else:
        parts = [values]
    raws = [p.astype("<f4").tobytes() for p in parts]
    raws = [zlib.compress(r) if compression == 8 else r for r in raws]
    at = 8 + sum(map(len, raws))
    n = len(raws)
    starts = [8 + sum(map(len, raws[:k])) for k in range(n)]
    extra = struct.pack("<3d", *EXPECTED["pixel_scale"]) + struct.pack("<6d", *EXPECTED["tiepoint"]) + struct.pack(f"<{n}I", *starts) + struct.pack(f"<{n}I", *map(len, raws))
    where, sizes = (starts[0], len(raws[0])) if n == 1 else (at + 72, at + 72 + 4 * n)
    cut = [(322, 4, 1, size), (323, 4, 1, size), (324, 4, n, where), (325, 4, n, sizes)] if tile else [(273, 4, 1, where), (278, 4, 1, h), (279, 4, 1, sizes)]
    fields = sorted([(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (339, 3, 1, 3), (33550, 12, 3, at), (33922, 12, 6, at + 24), *cut])
    body = b"".join(struct.pack("<HHI", t, k, c) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, c, v in fields)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", at + len(extra)) + b"".join(raws) + extra + struct.pack("<H", len(fields)) + body + struct.pack("<I", 0))
