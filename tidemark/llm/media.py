"""Media columns: Netpbm and BMP images as binary columns.

Images are decoded to numpy arrays, resized by exact area averages taken from an
integral image, and written as NPY tiles, each with a difference hash.

:func:`store` turns texts into images that hold their bytes losslessly as 8-bit
samples, one row of 64 samples per 64 bytes: binary graymaps, or 8-bit BMP with a gray
palette.  :func:`describe` reads stored bytes back, resizes the image to a square and
cuts that into tiles; its feature is the difference hashes of all tiles in order.

Defined cases: null text is an empty text, and an empty text is one row of zeros; a
stored form that cannot be decoded gives null columns, not an error; equal neighbours
leave their bit of a difference hash clear; repeated rows get equal rows; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

ROW = 64
#: Side of the resized square, and of its tiles.
SIDE, TILE = 32, 16
#: Stored bytes that a batch gathers before it goes on.
BATCH_BYTES = 8 << 20


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """The next n numbers of a Netpbm header, comments skipped, and where the raster may start."""
    found, at = [], 2
    while len(found) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: height x width, or height x width x 3; bitmaps as 0 and 1, two-byte samples as uint16."""
    kind = data[1] - ord("0")
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    (width, height, *rest), at = _header(data, 2 if kind in (1, 4) else 3)
    most = rest[0] if rest else 1
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = int(np.prod(shape))
    if kind == 1:
        return np.array([b - 48 for b in data[at - 1 :] if b in b"01"], np.uint8)[:count].reshape(shape)
    if kind in (2, 3):
        return np.array(data[at - 1 :].split()[:count], np.int64).astype(np.uint8 if most < 256 else np.uint16).reshape(shape)
    if kind == 4:
        line = -(-width // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8, height * line, at).reshape(height, line), axis=1)[:, :width]
    wide = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    return np.frombuffer(data, wide, count, at).reshape(shape).astype(wide.newbyteorder("="))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: gray where the palette is gray, else RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    raster, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing:
        raise ValueError("compressed")
    rows, line = abs(height), -(-width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, rows * line, raster).reshape(rows, line)
    raw = raw[::-1] if height > 0 else raw
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = raw[:, :width]
    else:
        index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = (index * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)[:, :width]
    colours = (raster - 14 - head) // 4
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    gray = (palette == palette[:, :1]).all()
    return np.ascontiguousarray((palette[:, 0] if gray else palette)[index])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


_GRAYS = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
_GRAYS[:, 3] = 0


def encode_bmp(image: np.ndarray) -> bytes:
    height, width = image.shape
    line = -(-width // 4) * 4
    raster = 14 + 40 + 1024
    padded = image if line == width else np.pad(image, ((0, 0), (0, line - width)))
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", raster + height * line, 0, 0, raster, 40, width, height, 1, 8, 0, height * line, 2835, 2835, 256, 0)
    return head + _GRAYS.tobytes() + padded[::-1].tobytes()


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area average onto a grid of any size, from the integral image; channels are averaged first."""
    gray = image.mean(axis=2) if image.ndim == 3 else image
    total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def along(values: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n + 1) * ((len(values) - 1) / n)
        low = np.minimum(at.astype(int), len(values) - 2)
        part = (at - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    corners = along(along(total, height).T, width).T
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / gray.size)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: is each cell of an 8 x 9 area grid darker than its right neighbour."""
    grid = np.round(resize_area(image, 8, 9), 6)
    return int.from_bytes(np.packbits(grid[:, :-1] < grid[:, 1:]).tobytes(), "big")


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image))
    return out.getvalue()


def tiles(image: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes, int]]:
    """Row, column, NPY bytes and difference hash of every tile of an image, edge tiles cut short."""
    for y in range(0, image.shape[0], size):
        for x in range(0, image.shape[1], size):
            part = image[y : y + size, x : x + size]
            yield y // size, x // size, npy(part), difference_hash(part)


def _stored(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[pa.RecordBatch]:
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    for batch in batches:
        for part in slices(batch, limit=BATCH_BYTES):
            sizes, media = [], []
            for text in part.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(encode(np.frombuffer(raw + bytes(-len(raw) % ROW if raw else ROW), np.uint8).reshape(-1, ROW)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(documents: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes and the stored image of every text, in the one form asked for."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_stored, form=form), "doc_id long, n_bytes long, media binary")


_DESCRIBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "height long, width long, tiles array<binary>, tile_hashes array<string>"
)


def described(data: bytes | None) -> tuple:
    """What :func:`describe` tells of one stored image, from payload_bytes on."""
    try:
        image = decode(data)
    except (ValueError, IndexError, TypeError, struct.error):
        known = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        return None, None, None, *known, None, None, None, None, None
    payload = image.tobytes()
    square = np.floor(resize_area(image, SIDE, SIDE) + 0.5).astype(np.uint8)
    told = [(file, f"{hash_:016x}") for _, _, file, hash_ in tiles(square, TILE)]
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(),
        "".join(h for _, h in told), *image.shape[:2], [file for file, _ in told], [h for _, h in told],
    )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DESCRIBED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.string())]
    for batch in batches:
        rows = [described(media.as_py()) for media in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)


def describe(stored: DataFrame) -> DataFrame:
    """Read images back: payload and stored form digested, size, and the NPY tiles of the resized image with their difference hashes."""
    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(_described, _DESCRIBED)


def apply(documents: DataFrame, form: str = "pgm") -> DataFrame:
    return describe(store(documents, form))
