"""PNG files: images as pixel relations (image_id, y, x, r, g, b; channels 0 to 1) in and out."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
PIXEL = "image_id int, y int, x int, r double, g double, b double"


def encode_png(grid: np.ndarray) -> bytes:
    """A file of an array (height, width, 3) of bytes."""
    height, width, _ = grid.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), grid.reshape(height, -1)], axis=1)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data)) for name, data in parts)


def decode_png(content: bytes) -> np.ndarray:
    """The array (height, width, 3) of a file of 8-bit grey, RGB or RGBA pixels without interlace; transparency is left out."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(content):
        (n,), name = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
        part = content[at + 8 : at + 8 + n]
        if zlib.crc32(name + part) != struct.unpack_from(">I", content, at + 8 + n)[0]:
            raise ValueError("a damaged PNG file")
        head, data, at = part if name == b"IHDR" else head, data + part if name == b"IDAT" else data, at + 12 + n
    width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 6: 4}.get(kind)
    if depth != 8 or not channels or interlace:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlace")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, (width + 1) * channels), np.int64)
    for y in range(height):
        line, above, here = lines[y, 1:].astype(np.int64), out[y], out[y + 1]
        if lines[y, 0] == 0:
            here[channels:] = line
        elif lines[y, 0] == 1:
            here[channels:] = np.cumsum(line.reshape(width, channels), axis=0).ravel() % 256
        elif lines[y, 0] == 2:
            here[channels:] = (line + above[channels:]) % 256
        else:
            for x in range(channels, len(here)):
                a, b, c = int(here[x - channels]), int(above[x]), int(above[x - channels])
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                here[x] = (int(line[x - channels]) + ((a + b) // 2 if lines[y, 0] == 3 else near)) % 256
    grid = out[1:, channels:].reshape(height, width, channels).astype(np.uint8)
    return np.repeat(grid, 3, axis=2) if channels == 1 else grid[:, :, :3]


def to_files(pixels: DataFrame) -> DataFrame:
    """image_id, content: a file of each image; channels are rounded to bytes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"])
        grid = np.floor(frame[["r", "g", "b"]].to_numpy() * 255 + 0.5).clip(0, 255).astype(np.uint8)
        shape = int(frame.y.max()) + 1, int(frame.x.max()) + 1, 3
        return pd.DataFrame({"image_id": [int(frame.image_id.iloc[0])], "content": [encode_png(grid.reshape(shape))]})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id int, content binary")


def from_files(files: DataFrame) -> DataFrame:
    """The pixels of image_id, content."""

    def run(frames):
        for frame in frames:
            for k, content in zip(frame.image_id, frame.content):
                grid = decode_png(content)
                y, x = np.mgrid[: grid.shape[0], : grid.shape[1]]
                yield pd.DataFrame({"image_id": np.full(x.size, k), "y": y.ravel(), "x": x.ravel(), **{c: grid[:, :, i].ravel() / 255.0 for i, c in enumerate("rgb")}})

    return files.select(F.col("image_id").cast("int").alias("image_id"), "content").mapInPandas(run, PIXEL)
