"""Elevation tiles in the TIFF format (a published specification): one band of numbers in strips or tiles, plain or
deflated. Files are read whole by Spark's ``binaryFile`` source, a file a row, and pixels leave it in slices of rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resources

# Fixed values of the format: byte orders, version, fields' tags, sizes of its types, kinds of numbers and compression.
ORDERS, VERSION = {b"II": "<", b"MM": ">"}, 42
WIDTH, LENGTH, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, KIND = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I"}
NUMBERS = {1: "u", 2: "i", 3: "f"}
PLAIN, DEFLATED, NO_PREDICTOR, DIFFERENCES = 1, (8, 32946), 1, 2

#: Rows of pixels that leave a file together.
SLICE = 64


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = ORDERS.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != VERSION:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if kind in TYPES:
            form = f"{order}{count}{TYPES[kind]}"
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(order + "I", data, place + 8)[0] - 8
            out[tag] = struct.unpack_from(form, data, place + 8)
    return order, out


def parse_raster(data: bytes) -> np.ndarray:
    """The first image of a file, as rows by columns."""
    order, f = _fields(data)

    def one(tag: int, default: int) -> int:
        return f.get(tag, (default,))[0]

    rows, columns, packing, predictor = f[LENGTH][0], f[WIDTH][0], one(COMPRESSION, PLAIN), one(PREDICTOR, NO_PREDICTOR)
    kind = np.dtype(f"{order}{NUMBERS[one(KIND, 1)]}{one(BITS, 1) // 8}") if one(BITS, 1) % 8 == 0 else None
    if kind is None or one(SAMPLES, 1) != 1 or packing not in (PLAIN, *DEFLATED) or predictor not in (NO_PREDICTOR, DIFFERENCES) or (predictor == DIFFERENCES and kind.kind == "f"):
        raise ValueError(f"a raster of {f.get(BITS)} bits in {one(SAMPLES, 1)} bands, compression {packing}, predictor {predictor} is not read")
    tiled = TILES in f
    height, width = (f[TILE_LENGTH][0], f[TILE_WIDTH][0]) if tiled else (min(one(STRIP_ROWS, rows), rows), columns)
    across = -(-columns // width)
    out = np.zeros((rows, columns), kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(*((f[TILES], f[TILE_BYTES]) if tiled else (f[STRIPS], f[STRIP_BYTES])))):
        i, j = k // across * height, k % across * width
        body = data[at : at + size] if packing == PLAIN else zlib.decompress(data[at : at + size])
        own = height if tiled else min(height, rows - i)  # the last strip is short, the last tiles are padded
        block = np.frombuffer(body, kind, own * width).reshape(own, width)
        if predictor == DIFFERENCES:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[i : i + own, j : j + width] = block[: rows - i, : columns - j]
    return out


def encode_raster(pixels: np.ndarray, strip_rows: int = 16, tile: tuple[int, int] | None = None, deflate: bool = False, differences: bool = False, order: str = "<") -> bytes:
    """A file with one image, in strips or in tiles of (rows, columns), which the format wants in multiples of 16."""
    rows, columns = pixels.shape
    kind = pixels.dtype.newbyteorder(order)
    height, width = tile or (strip_rows, columns)
    blocks = []
    for i in range(0, rows, height):
        for j in range(0, columns, width):
            block = pixels[i : i + height, j : j + width]
            if tile:
                block = np.pad(block, ((0, height - block.shape[0]), (0, width - block.shape[1])))
            if differences:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), block.dtype))
            body = block.astype(kind).tobytes()
            blocks.append(zlib.compress(body) if deflate else body)
    at = 8 + np.cumsum([0, *map(len, blocks)])
    name = {v: k for k, v in NUMBERS.items()}[pixels.dtype.kind]
    fields = {WIDTH: [columns], LENGTH: [rows], BITS: [8 * pixels.dtype.itemsize], COMPRESSION: [DEFLATED[0] if deflate else PLAIN], SAMPLES: [1], PREDICTOR: [DIFFERENCES if differences else NO_PREDICTOR], KIND: [name]}
    starts, sizes = at[:-1].tolist(), [len(b) for b in blocks]
    fields |= {TILE_WIDTH: [width], TILE_LENGTH: [height], TILES: starts, TILE_BYTES: sizes} if tile else {STRIPS: starts, STRIP_ROWS: [height], STRIP_BYTES: sizes}
    first = int(at[-1]) + int(at[-1]) % 2
    rest, entries, far = b"", b"", first + 6 + 12 * len(fields)
    for tag, values in sorted(fields.items()):
        body = struct.pack(f"{order}{len(values)}I", *values)
        if len(body) > 4:
            rest, body = rest + body, struct.pack(order + "I", far + len(rest))
        entries += struct.pack(order + "HHI", tag, 4, len(values)) + body
    head = {v: k for k, v in ORDERS.items()}[order] + struct.pack(order + "HI", VERSION, first)
    return (head + b"".join(blocks)).ljust(first, b"\0") + struct.pack(order + "H", len(fields)) + entries + bytes(4) + rest


def raster_pixels(files: DataFrame) -> DataFrame:
    """``tile, row, col, z, n_rows, n_cols`` of files ``tile, content``, as ``load_elevation`` wants them: only pixels that
    are numbers. A file is one row of Python's, many files are many tasks."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for tile, content in zip(pdf["tile"], pdf["content"]):
                image = parse_raster(bytes(content))
                rows, columns = image.shape
                for i in range(0, rows, SLICE):
                    z = image[i : i + SLICE].astype(float)
                    row, col = np.indices(z.shape, np.int32)
                    out = pd.DataFrame({"tile": tile, "row": (row + i).ravel(), "col": col.ravel(), "z": z.ravel(), "n_rows": np.int32(rows), "n_cols": np.int32(columns)})
                    yield out[out["z"].notna()]

    return files.select("tile", "content").mapInPandas(run, "tile string, row int, col int, z double, n_rows int, n_cols int")


def read_rasters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pixels of all files below a path, or of paths or patterns; a tile's name is its file's without the ending."""
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return raster_pixels(spark.read.format("binaryFile").load(path).select(name.alias("tile"), "content"))


def read_elevation(spark: SparkSession, folder: str, tiles: tuple[str, ...] = resources.ELEVATION_TILES) -> DataFrame:
    """Pixels of the named tiles in a folder; a missing file is an error, as a hole would look like the sea."""
    return read_rasters(spark, [f"{folder.rstrip('/')}/{t}.tif" for t in tiles])
