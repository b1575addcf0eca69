"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

decode() reads P2, P3, P5 and P6 Netpbm (8 bit; samples of a smaller maximum are scaled to 255) and uncompressed 8-, 24-
and 32-bit BMP. resize_area() averages the exact area that each new sample covers, by those rows of the integral image
that the samples' edges need. dhash() compares neighbours of a 9 x 8 thumbnail; equal neighbours give 0.

The bytes of a text become an image of their own: grey, SIDE samples wide, one byte each, filled up with 255 to a
positive multiple of SIDE * SIDE. store() keeps it as an NPY file of its SIDE x SIDE tiles.

Cases: a null text is an empty one, whose image is one white tile; equal texts and repeated rows have equal images,
files and features; a very long text is one image, handled in a batch of its own; an image that can't be decoded, has
no sample or can't be cut has null media and features; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, text_slices, utf8

SIDE, FILL = 24, 255


def netpbm(pixels: np.ndarray) -> bytes:
    """P5 for rows x columns, P6 for rows x columns x 3."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of rows x columns x 3 (red, green, blue), or 8-bit with a grey palette of rows x columns."""
    depth = 1 if pixels.ndim == 2 else 3
    rows = pixels[::-1] if depth == 1 else pixels[::-1, :, ::-1]
    raw = np.ascontiguousarray(rows, np.uint8).reshape(pixels.shape[0], -1)
    raw = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 4))).tobytes()
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if depth == 1 else b""
    at = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + len(raw), 0, 0, at, 40, pixels.shape[1], pixels.shape[0], 1, 8 * depth, 0, len(raw), 2835, 2835, 256 if depth == 1 else 0, 0) + palette + raw


def decode(raw: bytes) -> np.ndarray:
    """rows x columns, or rows x columns x 3, of unsigned bytes; ValueError for anything else, and for images without a sample."""
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    head = re.match(rb"P([2356])" + rb"(?:\s+(?:#[^\n]*\n\s*)*(\d{1,9}))" * 3 + rb"\s", raw)
    if not head:
        raise ValueError("neither Netpbm nor BMP")
    kind, width, height, top = (int(x) for x in head.groups())
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if not 0 < top < 256:
        raise ValueError("samples of more than 8 bits")
    if not 0 < n <= len(raw):  # a sample takes a byte at least
        raise ValueError("no samples, or too few")
    samples = np.frombuffer(raw, np.uint8, n, head.end()) if kind > 3 else np.array(raw[head.end() :].split(None, n)[:n], np.int64)
    if len(samples) < n:
        raise ValueError("too few samples")
    if top < 255 or kind < 4:
        if samples.min() < 0 or samples.max() > top:
            raise ValueError("samples beyond their maximum")
        samples = ((samples.astype(np.uint32) * 510 + top) // (2 * top)).astype(np.uint8)
    return samples.reshape((height, width) if depth == 1 else (height, width, 3))


def _decode_bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise ValueError("too short a BMP")
    at, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if packing or bits not in (8, 24, 32):
        raise ValueError("a BMP of another kind")
    if width <= 0 or not height or width * abs(height) > len(raw):
        raise ValueError("no samples, or too few")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(height), at).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits > 8:
        return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", raw, 46)[0] or 256
    if used > 256 or rows.max() >= used:
        raise ValueError("samples beyond the palette")
    palette = np.frombuffer(raw, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
    out = palette[rows]
    return out[:, :, 0] if (palette == palette[:, :1]).all() else out


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area that each of height x width samples covers; pixels: rows x columns.

    Edges cross the integral image in straight lines between its rows. Of its rows only those beside an edge are made,
    2 * (height + 1) at most, each from the one before, so a long image takes no more room than a short one.
    """
    rows, columns = pixels.shape
    edges = np.linspace(0, rows, height + 1)
    low = np.minimum(edges.astype(np.int64), rows - 1)
    wanted = np.union1d(low, low + 1)
    made, total, done = {}, np.zeros(columns, np.int64), 0
    for k in wanted.tolist():
        if k > done:
            total = total + pixels[done:k].sum(0, dtype=np.int64)
            done = k
        made[k] = np.concatenate([[0], np.cumsum(total)])
    part = (edges - low)[:, None]
    lines = np.stack([made[k] for k in low.tolist()]) * (1 - part) + np.stack([made[k + 1] for k in low.tolist()]) * part
    across = np.linspace(0, columns, width + 1)
    left = np.minimum(across.astype(np.int64), columns - 1)
    part = across - left
    corners = lines[:, left] * (1 - part) + lines[:, left + 1] * part
    return np.diff(np.diff(corners, axis=0), axis=1) / (rows * columns / (height * width))


def dhash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: whether each sample of 8 x 8 is darker than the next in its row, in tenths of a level."""
    small = np.floor(resize_area(grey(pixels), 8, 9) * 10 + 0.5)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def image_of(raw: bytes, side: int = SIDE) -> np.ndarray:
    n = max(1, -(-len(raw) // (side * side))) * side * side
    return np.frombuffer(raw.ljust(n, bytes([FILL])), np.uint8).reshape(-1, side)


def tiles(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """tiles x side x side; both sides of the image are multiples of `side`."""
    rows, columns = pixels.shape
    return pixels.reshape(rows // side, side, columns // side, side).swapaxes(1, 2).reshape(-1, side, side)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and image (Netpbm) of each row's whole text."""

    def run(batches):
        for batch in text_slices(batches):
            own = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, own), pa.int64()), pa.array([netpbm(image_of(x)) for x in own], pa.binary())], ["doc_id", "n_bytes", "image"])

    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, image binary")


def store(images: DataFrame, side: int = SIDE) -> DataFrame:
    """doc_id, n_bytes, columns and media: the image's tiles as an NPY file; null where it can't be decoded or cut."""

    def run(batches):
        for batch in text_slices(batches, 2):
            media, columns = [], []
            for raw in batch.column(2):
                try:
                    pixels = decode(raw.as_py() or b"")
                    media.append(npy(tiles(grey(pixels).astype(np.uint8, copy=False), side)))
                    columns.append(pixels.shape[1])
                except ValueError:
                    media.append(None), columns.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns, pa.int32()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "columns", "media"])

    df = images.select("doc_id", "n_bytes", "image")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, columns int, media binary")


def features(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (the samples again, row by row) and feature (difference hash) of stored tiles."""
    at = stored.columns.index("media")

    def run(batches):
        for batch in text_slices(batches, at):
            payloads, hashes = [], []
            for raw, columns in zip(batch.column("media"), batch.column("columns").to_pylist(), strict=True):
                if not raw.is_valid or columns is None:
                    payloads.append(None), hashes.append(None)
                    continue
                own = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                side, across = own.shape[1], columns // own.shape[1]
                pixels = own.reshape(-1, across, side, side).swapaxes(1, 2).reshape(-1, columns)
                payloads.append(pixels.tobytes()), hashes.append(dhash(pixels))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), pa.array(payloads, pa.binary()), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return stored.mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary, payload binary, feature string")
