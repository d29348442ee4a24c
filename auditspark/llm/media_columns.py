"""Operator 3: images in columns: Netpbm and BMP bytes to numpy arrays, area-resized, as NPY tiles with difference hashes.

``decode`` reads PBM, PGM, PPM (plain and raw) and uncompressed 8-, 24- and 32-bit BMP; anything else gives None, and so
a null feature: other formats, broken headers, too few samples, samples that are no numbers or above the greatest value. ``area_resize`` averages each target cell over the exact source area through an integral image, so it
works for any pair of sizes. The difference hash compares neighbouring cells of a 9 x 8 resize: 64 bits as 16 hex digits.

``payload_images`` stores arbitrary texts losslessly as PGM images (64 samples a line), written as a media table to the
shared folder. Cases: a null text counts as empty; the payload of an empty text is one line of 64 zeros; equal texts
give equal values; texts of any length are one image each; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditspark.llm.shared import id_text, slices, written

#: Samples a line of a payload image.
WIDTH = 64
#: Side of the NPY tile of an image.
TILE = 16
_HEAD = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,9})(?:(?:\s|#[^\n]*\n)+(\d{1,9}))?(?!\d)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw PGM file of a two-dimensional uint8 array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def _netpbm(data: bytes) -> np.ndarray | None:
    head = _HEAD.match(data)
    if not head:
        return None
    kind, width, height = int(head[1][1:]), int(head[2]), int(head[3])
    if kind in (1, 4):
        head = re.match(rb"P[14](?:\s|#[^\n]*\n)+\d+(?:\s|#[^\n]*\n)+\d+", data)
    most = 1 if kind in (1, 4) else int(head[4] or 0)
    if not 0 < most < 65536:
        return None
    planes, at = (3 if kind in (3, 6) else 1), head.end() + 1
    n = width * height * planes
    if kind == 1:
        flat = np.array([int(c) for c in re.findall(rb"[01]", data[at:])[:n]], np.int64)
    elif kind in (2, 3):
        samples = re.sub(rb"#[^\n]*", b"", data[at:]).split(None, n)[:n]
        if not all(x.isdigit() and len(x) <= 9 for x in samples):
            return None
        flat = np.array(samples, np.int64)
    elif kind == 4:
        line = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, min(len(data) - at, line * height), at)
        if len(raw) < line * height:
            return None
        flat = np.unpackbits(raw.reshape(height, line), axis=1)[:, :width].ravel()
    else:
        unit = np.dtype(np.uint8 if most < 256 else ">u2")
        if len(data) - at < n * unit.itemsize:
            return None
        flat = np.frombuffer(data, unit, n, at)
    if len(flat) < n or kind not in (1, 4) and flat.size and int(flat.max()) > most:
        return None
    if kind in (1, 4):
        flat = (1 - flat) * 255
    elif most != 255:
        flat = flat.astype(np.int64) * 255 // most
    shape = (height, width, 3) if planes == 3 else (height, width)
    return flat.astype(np.uint8).reshape(shape)


def _bmp(data: bytes) -> np.ndarray | None:
    if len(data) < 54 or data[:2] != b"BM":
        return None
    number = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, head, width, height, bits, packed = number(10), number(14), number(18, signed=True), number(22, signed=True), number(28, 2), number(30)
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        return None
    line = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + line * abs(height):
        return None
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.zeros((256, 3), np.uint8)
        table = np.frombuffer(data, np.uint8, min(256, number(46) or 256, (start - 14 - head) // 4) * 4, 14 + head).reshape(-1, 4)
        colours[: len(table)] = table[:, 2::-1]
        return colours[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes | None) -> np.ndarray | None:
    """The image as uint8, (height, width) or (height, width, 3); None for null, broken or unknown bytes."""
    if not data:
        return None
    image = _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    return image if image is not None and image.size else None


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def _edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell borders as (whole sample before, whole sample after, share of the way)."""
    border = np.arange(cells + 1) * (size / cells)
    low = np.minimum(np.floor(border).astype(np.int64), size)
    return low, np.minimum(low + 1, size), border - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact source area of each target cell, as float64, from the integral image.

    The integral image is taken per row block: only its values at the cell borders are kept, so a long image needs no
    table of its own size in float64.
    """
    rows, cols = image.shape
    low, high, part = _edges(cols, width)
    across = np.zeros((rows, cols + 1), np.int64)
    np.cumsum(image, axis=1, out=across[:, 1:])
    across = np.diff(across[:, low] * (1 - part) + across[:, high] * part, axis=1)  # rows x width
    low, high, part = _edges(rows, height)
    down = np.zeros((rows + 1, width))
    np.cumsum(across, axis=0, out=down[1:])
    total = np.diff(down[low] * (1 - part)[:, None] + down[high] * part[:, None], axis=0)
    return total / (rows / height * cols / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of a 9 x 8 area resize is darker than the next one in its line."""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def tiles(df: DataFrame, id_col: str, media_col: str = "media", side: int = TILE) -> DataFrame:
    """(id, height, width, tile, feature) of each image: an NPY file of side x side grey means, and its difference hash.

    Rows whose bytes are null or no known image have nulls beside their id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for data in b.column(1).to_pylist():
                image = decode(data)
                if image is None:
                    out.append((None, None, None, None))
                    continue
                image = grey(image)
                out.append((*image.shape, npy(np.rint(area_resize(image, side, side)).astype(np.uint8)), difference_hash(image)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=[id_col, "height", "width", "tile", "feature"])

    rows = df.select(df[id_col].alias("id"), df[media_col].alias("media"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, height int, width int, tile binary, feature string")


def payload_images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text in UTF-8, padded with zeros to whole lines, as the samples of a PGM image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                data = text.encode()
                sizes.append(len(data))
                lines = max(1, -(-len(data) // WIDTH))
                media.append(encode_pgm(np.frombuffer(data.ljust(lines * WIDTH, b"\0"), np.uint8).reshape(lines, WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def payload_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored images hold: digests of payload and file, checksum of the last line, tile and difference hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in slices(batches):
            out = []
            for data in b.column(2).to_pylist():
                image = decode(data)
                payload = image.tobytes()
                tile = npy(np.rint(area_resize(image, TILE, TILE)).astype(np.uint8))
                out.append((len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), sha(data).hexdigest(), difference_hash(image), tile))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Every document as an image: stored as a media table, read back, and described."""
    media = written(payload_images(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return payload_features(media)
