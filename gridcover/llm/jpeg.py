"""Baseline JPEG: parsing, Huffman decoding, luminance thumbnails from DC coefficients (operator 7), in numpy.

`decode` reads any baseline (SOF0, 8 bits, Huffman) JPEG: it parses the markers, decodes the scan that holds the first part
(luminance), alone or interleaved with others, and returns the DC-only luminance thumbnail, one sample per 8 x 8 block. Further scans
are parsed over; a height that only a DNL segment tells is read from there. Restart intervals of all images of a batch that share their
tables and layout are decoded in lockstep, one Huffman symbol of each interval at a time.

`encode` stores bytes losslessly: each byte is a block whose samples are all that byte. The DC quantiser is 8, so that the
coefficient is byte - 128 and the thumbnail is the payload. Rows of blocks are restart intervals. An image has 64 blocks a
row and at most 8,191 rows; longer payloads become several images, one after the other. A comment segment in the
first holds the payload's length.

Null text counts as empty. The payload is the text's UTF-8 bytes and zeros up to a positive multiple of 64.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table, tidy

BLOCKS_A_ROW, MOST_ROWS = 64, 8191
#: Payload bytes that are coded and decoded together.
BYTES_AT_ONCE = 1 << 20
#: Huffman tables of our own images, as (codes of each length, symbols): DC by size of the difference, AC with end-of-block
#: only (one code of one bit, its sibling left unused as the format asks).
DC_TABLE = ((0, 0, 6, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 3, 4, 5, 6, 7, 2, 1, 8))
AC_TABLE = ((1,) + (0,) * 15, (0,))


def canonical(table: tuple) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of each symbol of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out.append((table[1][k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def look_up(table: tuple) -> np.ndarray:
    """For every 16 bits, the length of the code that they begin with, times 256, plus its symbol; 0 where none fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, length in canonical(table):
        out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_segment(kind: int, table: tuple) -> bytes:
    return _segment(0xC4, bytes([kind, *table[0], *table[1]]))


def _code_of_difference() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: its code, size bits and end-of-block as one number, and how many bits that is."""
    codes = {s: (c, n) for s, c, n in canonical(DC_TABLE)}
    eob, eob_n = canonical(AC_TABLE)[0][1:]
    bits, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = codes[size]
        bits[d + 255] = ((c << size | (d if d >= 0 else d + (1 << size) - 1)) << eob_n) | eob
        lengths[d + 255] = n + size + eob_n
    return bits, lengths


_CODE, _LENGTH = _code_of_difference()


def _entropy_coded(samples: np.ndarray) -> list[bytes]:
    """The bits of each row of blocks (rows x 64 samples), padded with ones and stuffed."""
    value = samples.astype(np.int32) - 128
    diff = np.diff(value, axis=1, prepend=0) + 255
    length = _LENGTH[diff]
    ends = np.cumsum(length, axis=1)
    row_bytes = -(-ends[:, -1] // 8)
    base = np.concatenate([[0], np.cumsum(row_bytes)[:-1]])
    start = (base[:, None] * 8 + ends - length).ravel()
    word = (_CODE[diff].ravel().astype(np.uint64)) << (np.uint64(40) - ((start & 7) + length.ravel()).astype(np.uint64))
    out = np.zeros(int(row_bytes.sum()) + 5, np.uint64)
    at = start >> 3
    for k in range(4):  # a code has at most 21 bits, so that it ends within four bytes
        part = (word >> np.uint64(32 - 8 * k)) & np.uint64(255)
        out += np.bincount(at + k, weights=part, minlength=len(out)).astype(np.uint64)
    out = out[:-5].astype(np.uint8)
    pad = row_bytes * 8 - ends[:, -1]
    out[base + row_bytes - 1] |= ((1 << pad) - 1).astype(np.uint8)
    raw, stops = out.tobytes(), np.append(base[1:], len(out))
    if b"\xff" not in raw:
        return [raw[i:j] for i, j in zip(base.tolist(), stops.tolist(), strict=True)]
    return [raw[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip(base.tolist(), stops.tolist(), strict=True)]


_QUANT = _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1] * 63))
_TABLES = _huffman_segment(0x00, DC_TABLE) + _huffman_segment(0x10, AC_TABLE)


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as baseline JPEG images. The rows of several are coded together."""
    flat, step = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCKS_A_ROW), BYTES_AT_ONCE // BLOCKS_A_ROW
    rows = [r for k in range(0, len(flat), step) for r in _entropy_coded(flat[k : k + step])]
    out, row = [], 0
    for payload in payloads:
        n, images = len(payload) // BLOCKS_A_ROW, []
        for first in range(0, n, MOST_ROWS):
            height = min(MOST_ROWS, n - first)
            head = b"\xff\xd8" + (_segment(0xFE, struct.pack(">Q", len(payload))) if not first else b"") + _QUANT
            head += _segment(0xC0, struct.pack(">BHHB", 8, height * 8, BLOCKS_A_ROW * 8, 1) + b"\x01\x11\x00") + _TABLES
            head += _segment(0xDD, struct.pack(">H", BLOCKS_A_ROW)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
            body = [x for k, r in enumerate(rows[row : row + height]) for x in (r, bytes([0xFF, 0xD0 + k % 8]))]
            images.append(head + b"".join(body[:-1]) + b"\xff\xd9")
            row += height
        out.append(b"".join(images))
    return out


@dataclass
class Image:
    """What the markers of an image say; scan, tables, quantisers, restart and lanes are those of the scan that holds the first part."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical factor, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, tuple] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # part, DC and AC table
    restart: int = 0
    comments: list[bytes] = field(default_factory=list)
    lanes: list[bytes] = field(default_factory=list)
    end: int = 0


def _scan_end(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of entropy-coded data that begins at a byte, and where the marker behind it is."""
    lanes, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no EOI marker")
        follow = data[at + 1]
        if follow == 0:
            at += 2
        elif 0xD0 <= follow <= 0xD7:
            lanes.append(data[start:at])
            at = start = at + 2
        elif follow == 0xFF:
            at += 1
        else:
            return [*lanes, data[start:at]], at


def parse(data: bytes, at: int = 0) -> Image:
    """One image that begins at a byte. ValueError for what isn't baseline JPEG."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, at = Image(), at + 2
    tables: dict[int, tuple] = {}
    quant: dict[int, int] = {}
    restart = 0
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xd9":
            if not image.scan:
                raise ValueError("no scan of the first part")
            if not image.height:
                raise ValueError("no height")
            image.end = at + 2
            return image
        if data[at : at + 1] != b"\xff" or at + 4 > len(data):
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise ValueError("a segment ends early")
        at += 2 + size
        if marker == 0xC0:
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not image.width or not n:
                raise ValueError("not 8 bits, or empty")
            image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif marker == 0xDC:
            (image.height,) = struct.unpack_from(">H", body)
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            index = {p[0]: k for k, p in enumerate(image.parts)}
            try:
                scan = [(index[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            except (KeyError, IndexError):
                raise ValueError("a scan of parts that the frame doesn't have") from None
            lanes, at = _scan_end(data, at)
            if any(p == 0 for p, _, _ in scan):
                if image.scan:
                    raise ValueError("two scans of the first part")
                if image.parts[0][3] not in quant or any(d not in tables or 0x10 | a not in tables for _, d, a in scan):
                    raise ValueError("a table is missing")
                image.scan, image.tables, image.quant, image.restart, image.lanes = scan, dict(tables), dict(quant), restart, lanes


def _decode_lanes(lanes: list[bytes], blocks: np.ndarray, layout: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """DC differences summed within each lane: lanes x most blocks, for each block of the layout's cycle in turn.

    layout: for each block of an MCU, its part, DC look-up and AC look-up. blocks: how many blocks each lane holds.
    """
    clean = [x.replace(b"\xff\x00", b"\xff") for x in lanes]
    sizes = np.array([len(x) for x in clean], np.int64)
    buffer = np.frombuffer(b"".join(clean) + b"\x00" * 8, np.uint8).astype(np.uint64)
    word = buffer[:-4].copy()
    for k in range(1, 5):  # 40 bits from each byte on
        word = word << np.uint64(8) | buffer[k : len(buffer) - 4 + k]
    word = word.astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bit, stop = first * 8, (first + sizes) * 8
    parts = max(p for p, _, _ in layout) + 1
    last = np.zeros((parts, len(lanes)), np.int64)
    out = np.zeros((int(blocks.max()), len(lanes)), np.int16)
    live = np.arange(len(lanes))
    for n in range(int(blocks.max())):
        part, dc, ac = layout[n % len(layout)]
        if n and not (blocks[live] > n).all():
            live = live[blocks[live] > n]
        b = bit[live]
        w = word[b >> 3]
        room = 24 - (b & 7)
        code = dc[w >> room & 0xFFFF]
        length, size = code >> 8, code & 255
        if not length.all() or (size > 11).any():
            raise ValueError("a code isn't in the DC table")
        value = w >> room + 16 - length - size & (1 << size) - 1
        value = np.where(value >> np.maximum(size - 1, 0) == 0, value - (1 << size) + 1, value) * (size > 0)
        last[part][live] += value
        out[n, live] = last[part][live]
        b = b + length + size
        busy, k = np.arange(len(live)), np.ones(len(live), np.int64)
        while len(busy):  # the AC coefficients are read over
            p = b[busy]
            code = ac[word[p >> 3] >> 24 - (p & 7) & 0xFFFF]
            length, symbol = code >> 8, code & 255
            if not length.all():
                raise ValueError("a code isn't in the AC table")
            b[busy] = p + length + (symbol & 15)
            k[busy] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
            busy = busy[k[busy] < 64]
        if (b > stop[live]).any():
            raise ValueError("a scan ends too early")
        bit[live] = b
    return out.T


def _samples(m: Image) -> tuple[int, int]:
    """Width and height of the first part, which has fewer samples than the image where another part's factors are larger."""
    (_, h, v, _) = m.parts[0]
    return -(-m.width * h // max(p[1] for p in m.parts)), -(-m.height * v // max(p[2] for p in m.parts))


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image, as rows of 8-bit samples. Images alike in tables and layout go together."""
    groups: dict[tuple, list[int]] = {}
    for k, m in enumerate(images):
        frame = (max(p[1] for p in m.parts), max(p[2] for p in m.parts))
        key = (frame, tuple(m.parts[p][1:3] for p, _, _ in m.scan), tuple((p, m.tables[d], m.tables[0x10 | a]) for p, d, a in m.scan))
        groups.setdefault(key, []).append(k)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for (frame, factors, tables), members in groups.items():
        alone = len(tables) == 1
        layout = [(n, look_up(d), look_up(a)) for n, ((h, v), (_, d, a)) in enumerate(zip(factors, tables, strict=True)) for _ in range(1 if alone else h * v)]
        most_h, most_v = frame
        lanes, blocks, shapes = [], [], []
        for k in members:
            m = images[k]
            wide, high = _samples(m)
            across, down = (-(-wide // 8), -(-high // 8)) if alone else (-(-m.width // (8 * most_h)), -(-m.height // (8 * most_v)))
            units = across * down
            each = m.restart or units
            if -(-units // each) != len(m.lanes):
                raise ValueError("restart intervals don't match the size")
            lanes += m.lanes
            blocks += [min(each, units - each * n) * len(layout) for n in range(len(m.lanes))]
            shapes.append((k, len(m.lanes), across, down, each))
        counts = np.array(blocks, np.int64)
        dc = _decode_lanes(lanes, counts, layout)
        lane = 0
        for k, n, across, down, _ in shapes:
            m = images[k]
            part = dc[lane : lane + n]
            flat = part.reshape(-1, len(layout)) if (counts[lane : lane + n] == part.shape[1]).all() else np.concatenate([r[:c] for r, c in zip(part, counts[lane : lane + n], strict=True)]).reshape(-1, len(layout))
            lane += n
            luma = next(x for x, (p, _, _) in enumerate(m.scan) if p == 0)
            offset = sum(1 for p, _, _ in layout if p < luma)
            h, v = (1, 1) if alone else factors[luma]
            grid = flat[:, offset : offset + h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            q = m.quant[m.parts[0][3]]
            pixels = np.clip(np.floor(grid.astype(np.float64) * q / 8 + 128.5), 0, 255).astype(np.uint8)
            wide, high = _samples(m)
            out[k] = pixels[: -(-high // 8), : -(-wide // 8)]
    return out


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and luminance thumbnail of one image."""
    m = parse(data)
    return m.width, m.height, thumbnails([m])[0]


def read_back(media: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, np.ndarray]]]]:
    """The payload of each stored form, and width, height, thumbnail of its images."""
    images, owner = [], []
    for n, data in enumerate(media):
        at = 0
        while at < len(data):
            m = parse(data, at)
            at = m.end
            images.append(m)
            owner.append(n)
    thumbs: list[np.ndarray] = []
    held: list[Image] = []
    for m in images:
        held.append(m)
        if sum(x.width * x.height // 64 for x in held) >= BYTES_AT_ONCE:
            thumbs += thumbnails(held)
            held = []
    thumbs += thumbnails(held)
    found: list[list] = [[] for _ in media]
    for n, m, t in zip(owner, images, thumbs, strict=True):
        found[n].append((m.width, m.height, t, m.comments))
    out = []
    for f in found:
        (length,) = struct.unpack(">Q", f[0][3][0])
        payload = b"".join(t.tobytes() for _, _, t, _ in f)
        if len(payload) != length:
            raise ValueError("the payload's length isn't what its comment says")
        out.append((payload, [(w, h, t) for w, h, t, _ in f]))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid of mean luminance are above the mean of the cells."""
    rows, cols = (np.arange(9) * n // 8 for n in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    r0, r1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=thumb.shape[0])
    c0, c1 = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1).clip(max=thumb.shape[1])
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    mean = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / np.maximum(area, 1)
    return np.packbits(mean.ravel() > mean.mean()).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\x00" * (-len(raw) % 64 if raw else 64)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the stored form) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    short_batches(docs.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, start = b.column(1), 0
            while start < b.num_rows:
                stop, size, sizes, payloads = start, 0, [], []
                while stop < b.num_rows and (not size or size < BYTES_AT_ONCE):
                    n, p = payload_of(texts[stop].as_py())
                    sizes.append(n)
                    payloads.append(p)
                    size, stop = size + len(p), stop + 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array(sizes, pa.int64()), pa.array(encode_all(payloads), pa.binary())], names=["id", "n_bytes", "media"])
                start = stop

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(stored), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored forms back: payload digests, dimensions and the hashes of the thumbnails."""
    kind = media.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            while start < b.num_rows:
                stop, size, forms = start, 0, []
                while stop < b.num_rows and (not size or size < BYTES_AT_ONCE):
                    forms.append(b.column(2)[stop].as_py())
                    size, stop = size + len(forms[-1]), stop + 1
                rows = []
                for form, (payload, images) in zip(forms, read_back(forms), strict=True):
                    rows.append({
                        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                        "media_bytes": len(form), "media_sha256": hashlib.sha256(form).hexdigest(),
                        "feature": ";".join(f"{w}x{h}:{thumbnail_hash(t)}" for w, h, t in images),
                    })
                t = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), b.column(1).slice(start, stop - start), *t.columns], names=["id", "n_bytes", *t.schema.names])
                start = stop

    out = media.select(id_col, "n_bytes", "media").mapInArrow(tidy(read), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
