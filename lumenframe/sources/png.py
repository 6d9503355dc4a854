"""PNG writing and reading: 8-bit RGBA, Paeth rows, no metadata."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROWS = 1 << 20  # bytes that the compressor takes at a time


def framed(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def frame_column(kind: str, data: Column) -> Column:
    """A chunk as a binary column: length, kind, data and their CRC-32, all built in."""
    body = F.concat(F.encode(F.lit(kind), "US-ASCII"), data)
    word = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 8, "0"))
    return F.concat(word(F.octet_length(data)), body, word(F.crc32(body)))


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    p = left + up - corner
    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _rows(rgba: np.ndarray, begin: int, end: int) -> bytes:
    """Some rows as differences from their Paeth predictors; only these rows and the one above are held twice."""
    _, w, _ = rgba.shape
    above = rgba[begin - 1 : begin] if begin else np.zeros_like(rgba[:1])
    x = np.zeros((end - begin + 1, w + 1, 4), np.int16)
    x[:1, 1:], x[1:, 1:] = above, rgba[begin:end]
    rows = np.empty((end - begin, 1 + 4 * w), np.uint8)
    rows[:, 0] = 4
    rows[:, 1:] = ((x[1:, 1:] - paeth(x[1:, :-1], x[:-1, 1:], x[:-1, :-1])) & 255).reshape(end - begin, -1)
    return rows.tobytes()


def encode(rgba: np.ndarray) -> bytes:
    """height x width x 4 bytes as PNG."""
    if rgba.ndim != 3 or rgba.shape[2] != 4 or rgba.dtype != np.uint8:
        raise ValueError("height x width x 4 bytes are needed")
    h, w, _ = rgba.shape
    packer, out, step = zlib.compressobj(6), [], max(1, ROWS // (1 + 4 * w))
    for begin in range(0, h, step):
        out.append(packer.compress(_rows(rgba, begin, min(h, begin + step))))
    out.append(packer.flush())
    return SIGNATURE + framed(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + framed(b"IDAT", b"".join(out)) + framed(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes of an 8-bit RGBA or RGB image without interlace; checks every CRC."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at, head, body = 8, b"", []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged chunk {kind!r}")
        head = part if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        at += 12 + n
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (2, 6) or interlace:
        raise ValueError("only 8-bit colour without interlace")
    n = 4 if colour == 6 else 3
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + n * w)
    out = np.zeros((h + 1, w + 1, n), np.int16)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].reshape(w, n).astype(np.int16)
        if kind in (0, 2):
            out[y + 1, 1:] = line + (out[y, 1:] if kind == 2 else 0)
            out[y + 1] &= 255
            continue
        for x in range(w):
            left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
            guess = left if kind == 1 else (left + up) // 2 if kind == 3 else paeth(left, up, corner)
            out[y + 1, x + 1] = (line[x] + guess) & 255
    image = np.full((h, w, 4), 255, np.uint8)
    image[:, :, :n] = out[1:, 1:]
    return image


def to_png(df: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, r, g, b, a) of one size -> (key, png); one Arrow pass, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [np.array(batch.column(k).to_pylist(), np.uint8).reshape(-1, height, width) for k in range(1, 5)]
            images = np.stack(planes, -1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x) for x in images], pa.binary())], names=[key, "png"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "r", "g", "b", "a").mapInArrow(run, f"{key} {kind}, png binary")


def read_images(spark, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files as path, length, modificationTime, content; the content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) -> path, width, height, rgba, error; what cannot be decoded has an error and no image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    image = decode(content or b"")
                    rows.append((image.shape[1], image.shape[0], image.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as error:
                    rows.append((None, None, None, f"decode-failed: {error}"))
            w, h, rgba, error = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgba, pa.binary()), pa.array(error, pa.string())], names=["path", "width", "height", "rgba", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, rgba binary, error string")
