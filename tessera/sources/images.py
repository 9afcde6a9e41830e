"""Image files: Spark's own image source to pixel rows, and pixel rows to one PNG file an image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of an image leave the decoder in runs of about so many.
RUN = 1 << 16

PIXELS = "image_id string, y int, x int, r int, g int, b int"


def file_name(path):
    """The last part of a path without its ending."""
    return F.regexp_replace(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1), r"\.[^.]*$", "")


def scan(spark: SparkSession, paths: str | list[str], drop_invalid: bool = False, clear: bool = True) -> DataFrame:
    """PIXELS of every image file (PNG, JPEG, BMP, GIF) under the paths, decoded by Spark; image_id is the file's name.

    A missing path raises Spark's error; a file that is no image raises unless drop_invalid is set. Gray images give three equal channels, an alpha channel is left out; without clear, pixels of alpha 0 have no row.
    """
    raw = spark.read.format("image").option("dropInvalid", "true").load(paths).select("image.*")
    if not drop_invalid:
        files = spark.read.format("binaryFile").load(paths).select("path")
        clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
        lost = files.select(clean("path").alias("p")).join(raw.select(clean("origin").alias("p")), "p", "left_anti").take(1)
        if lost:
            raise OSError(f"not an image: {lost[0].p}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w, c = r["height"], r["width"], r["nChannels"]
                data = np.frombuffer(r["data"], np.uint8).reshape(h, w, c)
                rgb = np.repeat(data[..., :1], 3, 2) if c == 1 else data[..., 2::-1]  # stored as BGR(A)
                step = max(1, RUN // max(w, 1))
                for top in range(0, h, step):
                    part = rgb[top : top + step].reshape(-1, 3).astype(np.int32)
                    y, x = np.divmod(np.arange(len(part), dtype=np.int32), w)
                    if c == 4 and not clear:
                        there = data[top : top + step, :, 3].ravel() > 0
                        part, y, x = part[there], y[there], x[there]
                    columns = [pa.array([r["image_id"]] * len(part)), pa.array((y + top).astype(np.int32)), pa.array(x.astype(np.int32)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(3))]
                    yield pa.RecordBatch.from_arrays(columns, names=["image_id", "y", "x", "r", "g", "b"])

    return raw.select(file_name("origin").alias("image_id"), "height", "width", "nChannels", "data").mapInArrow(run, PIXELS)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A scan line's bytes from what its filter left; step: the bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"no filter {kind}")
    raw, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for k in range(len(raw)):
        left, corner = (out[k - step], up[k - step]) if k >= step else (0, 0)
        if kind == 3:
            guess = (left + up[k]) >> 1
        else:
            p = left + up[k] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[k]), 1, up[k]), (abs(p - corner), 2, corner))[2]
        out[k] = raw[k] + guess & 255
    return np.array(out, np.uint8)


def png_strips(content: bytes, rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """The first row and the values (rows, width, 3) of each strip of a PNG, from a running inflate: no more than a strip is held uncompressed.

    8-bit gray, colour and palette images, with or without alpha (left out), not interlaced; others are an error.
    """
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, palette, inflate, left, top, strip = 8, None, zlib.decompressobj(), b"", 0, []
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, depth, color, *_, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced or color not in (0, 2, 3, 4, 6):
                raise ValueError("only 8-bit images that are not interlaced are read by strips")
            step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
            wide, above = w * step + 1, np.zeros(w * step, np.uint8)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            while body:
                left += inflate.decompress(body, max(wide, 1 << 16))
                body = inflate.unconsumed_tail
                while len(left) >= wide:
                    above = _unfiltered(left[0], np.frombuffer(left[1:wide], np.uint8), above, step)
                    left = left[wide:]
                    strip.append(above)
                    if len(strip) == rows or top + len(strip) == h:
                        values = np.stack(strip).reshape(len(strip), w, step)
                        yield top, palette[values[..., 0]] if color == 3 else np.repeat(values[..., :1], 3, 2) if step < 3 else values[..., :3]
                        top, strip = top + len(strip), []
    if top != h:
        raise ValueError("a cut off PNG")


def scan_strips(spark: SparkSession, paths: str | list[str], rows: int = 64) -> DataFrame:
    """PIXELS of PNG files of any size: a task holds a file as it is stored and one strip of its rows. What is no such PNG is an error that names the file."""
    files = spark.read.format("binaryFile").load(paths).select("path", file_name("path").alias("image_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                path, name, content = (batch.column(c)[k].as_py() for c in range(3))
                try:
                    for top, values in png_strips(content, rows):
                        h, w = values.shape[:2]
                        y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                        columns = [pa.array([name] * (h * w)), pa.array(y + np.int32(top)), pa.array(x), *(pa.array(values[..., c].ravel().astype(np.int32)) for c in range(3))]
                        yield pa.RecordBatch.from_arrays(columns, names=["image_id", "y", "x", "r", "g", "b"])
                except (ValueError, zlib.error, struct.error) as e:
                    raise OSError(f"{path}: {e}") from e

    return files.mapInArrow(run, PIXELS)


def png(values: np.ndarray) -> bytes:
    """An 8-bit PNG of values (h, w), (h, w, 3) or, with alpha, (h, w, 4)."""
    h, w = values.shape[:2]
    lines = np.hstack([np.zeros((h, 1), np.uint8), values.astype(np.uint8).reshape(h, -1)])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if values.ndim == 2 else 2 if values.shape[2] == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def write_png(pixels: DataFrame, folder: str, channels: tuple[str, ...] = ("r", "g", "b"), gaps: bool = False) -> DataFrame:
    """One PNG file an image in a folder of the shared store: image_id and path. channels: three of them, or one for masks and gray images.

    A file is one image, so an image meets in one task; pixels that are missing are 0; with gaps they are of alpha 0, in images that have such (these have three channels and alpha). Files are written under their final name at once, so a retried task writes the same file again.
    """

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        out = np.zeros((y.max() + 1, x.max() + 1, len(channels)), np.uint8)
        out[y, x] = np.stack([table.column(c).to_numpy() for c in channels], 1)
        if gaps and len(np.unique(y.astype(np.int64) * out.shape[1] + x)) < out.shape[0] * out.shape[1]:
            alpha = np.zeros((*out.shape[:2], 1), np.uint8)
            alpha[y, x] = 255
            out = np.concatenate([np.repeat(out, 3, 2) if len(channels) == 1 else out, alpha], 2)
        name = str(table.column("image_id")[0].as_py())
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}.png", compression=None) as f:
            f.write(png(out[..., 0] if out.shape[2] == 1 else out))
        return pa.table({"image_id": [name], "path": [f"{root}/{name}.png"]})

    return pixels.select("image_id", "y", "x", *channels).groupBy("image_id").applyInArrow(run, "image_id string, path string")
