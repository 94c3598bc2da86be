"""Media columns: Netpbm and BMP images as arrays, area-resized, kept as NPY tiles with difference hashes.

Every image is one bytes cell; decoding, resizing and hashing run in Arrow batches inside tasks and
need no shuffle, so a lost executor costs only its own batches.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE_H, TILE_W = 24, 24


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey (2-d) or colour (3-d) Netpbm file of 8-bit samples."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of a grey or colour array."""
    rgb = np.repeat(samples[:, :, None], 3, 2) if samples.ndim == 2 else samples
    h, w = rgb.shape[:2]
    row = (3 * w + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + row * h, 0, 0, 54, 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + body.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, values = data[:2], 2, []
    need = 2 if kind in (b"P1", b"P4") else 3
    while len(values) < need:  # header numbers are apart by white space and comments
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        values.append(int(data[at:end]))
        at = end
    w, h = values[:2]
    top = values[2] if need == 3 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[: w * h * depth], np.int64)
    elif kind == b"P1":
        flat = 1 - np.frombuffer(bytes(c for c in data[at:] if c in b"01")[: w * h], np.uint8).astype(np.int64) + 48
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
        flat = 1 - bits.astype(np.int64).reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at + 1)
    if len(flat) != w * h * depth:
        raise ValueError("too few samples")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    out = flat.astype(np.uint8, copy=False)
    return out.reshape(h, w) if depth == 1 else out.reshape(h, w, 3)


def _bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packed = struct.unpack_from("<II iiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    row = (w * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    body = body[::-1] if h > 0 else body
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        table = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        return table[body[:, :w]]
    return body[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or uncompressed BMP file: (h, w) grey or (h, w, 3) colour, 8 bits."""
    image = _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    if not image.size:
        raise ValueError("no samples")
    return image


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, read off an integral image between its grid points."""
    gray = image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = gray.cumsum(0).cumsum(1)

    def along(a: np.ndarray, n: int, to: int) -> np.ndarray:
        at = np.arange(to + 1) * n / to
        lo = np.minimum(at.astype(np.int64), n - 1)
        part = (at - lo)[:, None]
        return a[lo] * (1 - part) + a[lo + 1] * part

    grid = along(along(total, h, height).T, w, width).T
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / (h * w / height / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each of 8 x 8 cells darker than its right neighbour."""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = TILE_H, width: int = TILE_W) -> bytes:
    """The resized image as the bytes of an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(image, height, width)).astype(np.uint8))
    return out.getvalue()


_FEATURES = "height int, width int, tile binary, dhash string, error string"


def media_features(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Size, NPY tile and difference hash of each image cell, next to ``keys``.

    A null, damaged or unsupported image has null features and says so in ``error``; an image without
    pixels counts as damaged. Equal bytes give equal features; repeated rows stay. Other columns,
    whatever their names, do not pass.
    """

    def batches(it):
        for batch in it:
            rows = []
            for cell in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    image = decode(cell)
                    rows.append((*image.shape[:2], npy_tile(image), difference_hash(image), None))
                except (TypeError, ValueError, IndexError, struct.error, ZeroDivisionError) as e:
                    rows.append((None, None, None, None, type(e).__name__))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*names, "height", "width", "tile", "dhash", "error"])

    names = list(keys)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(media).alias("__media")).mapInArrow(batches, f"{schema}, {_FEATURES}")


UNIT = 576


def store_payload(payload: bytes) -> bytes:
    """A payload of a multiple of 576 bytes as a grey Netpbm image, 24 samples wide."""
    return encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, TILE_W))


def _row(text: bytes) -> tuple:
    short = -len(text) % UNIT if text else UNIT
    stored = store_payload(text + b"\xff" * short)
    image = decode(stored)  # all that follows is read back from the stored bytes
    payload = image.tobytes()
    feature = f"{difference_hash(image)}:{hashlib.md5(npy_tile(image)).hexdigest()}"
    return (
        len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        len(stored), hashlib.sha256(stored).hexdigest(), feature,
    )


def text_media(docs: DataFrame) -> DataFrame:
    """Each document's text stored as an image and read back: digests and features per row.

    A null text counts as empty; an empty one is 576 bytes of padding. Equal texts have equal values;
    one row per input row, null ids included.
    """

    def batches(it):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in it:
            rows = [_row(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, "
        "tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
