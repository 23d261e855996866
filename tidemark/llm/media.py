"""Media columns: Netpbm and BMP images in binary columns, area-resized tiles (NPY) and difference hashes.

Formats: PGM and PPM in binary (P5, P6) and plain (P2, P3) form with 8-bit samples, PBM (P1, P4), and uncompressed BMP of
8 bits (with palette), 24 and 32 bits. Images decode to arrays (height, width) or (height, width, 3) of uint8.

Resizing is by area: an integral image (with bilinear look-up between its points) gives the exact mean of the input
area behind every output sample, for any ratio. The difference hash compares neighbours in the rows of an 8 x 9 tile
(64 bits, hexadecimal). All work is by row, in Arrow batches: no shuffle, memory bounded by one image.

A null image has null results; what can't be decoded has null results and the reason in `error`.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

_HEAD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(blob: bytes) -> np.ndarray:
    kind = blob[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm file")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEAD.match(blob, at)
        if not m:
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    most = head[2] if len(head) == 3 else 1
    if w < 1 or h < 1 or not 0 < most < 256:
        raise ValueError("unsupported Netpbm size or depth")
    n = w * h * (3 if kind in (b"P3", b"P6") else 1)
    if kind == b"P4":
        rows = np.frombuffer(blob, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        a = (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    elif kind == b"P1":
        a = np.array([49 - c for c in re.sub(rb"#[^\n]*|\s", b"", blob[at:])[:n]], np.int64).astype(np.uint8) * np.uint8(255)
    elif kind in (b"P2", b"P3"):
        a = np.array(re.sub(rb"#[^\n]*", b"", blob[at:]).split()[:n], np.int64).astype(np.uint8)
    else:
        a = np.frombuffer(blob, np.uint8, n, at + 1)
    a = a.reshape(h, w, 3) if kind in (b"P3", b"P6") else a.reshape(h, w)
    return a if most in (1, 255) else (a.astype(np.uint32) * 255 // most).astype(np.uint8)


def decode_bmp(blob: bytes) -> np.ndarray:
    if blob[:2] != b"BM":
        raise ValueError("not a BMP file")
    (offset,) = struct.unpack_from("<I", blob, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", blob, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(blob, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", blob, 46)[0] or 256
        palette = np.frombuffer(blob, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        a = rows[:, :w]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][a]
        return palette[a]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()


def decode(blob: bytes) -> np.ndarray:
    return decode_bmp(blob) if blob[:2] == b"BM" else decode_netpbm(blob)


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, as float64 of shape (height, width[, 3])."""
    colours = a.shape[2:] and a.shape[2]
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1, *a.shape[2:]))
    np.cumsum(np.cumsum(a, 0, dtype=np.float64), 1, out=total[1:, 1:])
    for axis, n in ((0, height), (1, width)):
        at = np.linspace(0, a.shape[axis], n + 1)
        low = np.minimum(at.astype(np.int64), a.shape[axis] - 1)
        part = (at - low).reshape((-1, *(1,) * (total.ndim - 1)) if axis == 0 else (1, -1, *((1,) if colours else ())))
        total = np.diff(np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part, axis=axis)
    return total * (height * width / (a.shape[0] * a.shape[1]))


def difference_hash(a: np.ndarray) -> str:
    grey = a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])
    tile = area_resize(grey, 8, 9).round(6)
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy_tile(a: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, area_resize(a, height, width).round(6).round().astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def _features(height: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(1):
                blob = blob.as_py()
                try:
                    a = None if blob is None else decode(blob)
                    rows.append((None,) * 5 if a is None else (a.shape[0], a.shape[1], npy_tile(a, height, width), difference_hash(a), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())))], ["id", "height", "width", "tile", "dhash", "error"])

    return run


def tiles(images: DataFrame, id_col: str, media_col: str, height: int = 16, width: int = 16) -> DataFrame:
    """(id, height, width, tile, dhash, error): the tile is an NPY file of `height` x `width` samples."""
    return images.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(_features(height, width), "id long, height int, width int, tile binary, dhash string, error string")


WIDTH = 64
_STORED = "doc_id long, n_bytes long, media binary"


def _as_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, media = [], []
        for text in batch.column(1):
            b = (text.as_py() or "").encode("utf-8", "surrogatepass")
            n.append(len(b))
            b = b.ljust(max(1, -(-len(b) // WIDTH)) * WIDTH, b"\0")
            media.append(encode_pgm(np.frombuffer(b, np.uint8).reshape(-1, WIDTH)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def texts_as_images(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded to whole rows of 64 samples (one row at least), as a PGM image in a stored media table."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(docs.mapInArrow(_as_images, _STORED), "media")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for blob in batch.column(2):
            blob = blob.as_py()
            a = decode(blob)
            payload = a.tobytes()
            for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), difference_hash(a), npy_tile(a))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", *names])


def described(media: DataFrame) -> DataFrame:
    """Reads a stored media table back: payload, checksums, difference hash and NPY tile of each row."""
    return media.mapInArrow(_describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
