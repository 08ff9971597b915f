"""The ESRI shape format (a published specification): polylines and polygons as rows of vertices, and its table of
attributes. Files are read whole by Spark's ``binaryFile`` source, a file a row; a zip holds one of each."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: file code, version, bytes of the header, shapes with parts (lines and rings).
FILE_CODE, VERSION, HEADER, LINE, RING = 9994, 1000, 100, 3, 5


def parse_shapes(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(shape, part, vertices)``; vertices are longitude and latitude. Null shapes have no parts; the heights and
    measures of the format's other kinds stand behind the vertices and are left out."""
    if struct.unpack(">i", data[:4])[0] != FILE_CODE:
        raise ValueError("not a shape file")
    at, shape = HEADER, 0
    while at + 8 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        if kind % 10 in (LINE, RING):
            parts, points = struct.unpack("<2i", body[36:44])
            first = np.frombuffer(body, "<i4", parts, 44).tolist()
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2)
            for k, (a, z) in enumerate(zip(first, [*first[1:], points])):
                yield shape, k, xy[a:z]
        elif kind not in (0, LINE, RING):
            raise ValueError(f"shapes of kind {kind} have no parts")
        at, shape = at + 8 + 2 * words, shape + 1


def encode_shapes(shapes: list[list[np.ndarray]], kind: int = RING) -> bytes:
    """A file of shapes, each a list of parts."""
    records, box = [], [np.inf, np.inf, -np.inf, -np.inf]
    for k, parts in enumerate(shapes):
        xy = np.concatenate(parts).astype("<f8")
        own = [*xy.min(axis=0), *xy.max(axis=0)]
        box = [*np.minimum(box[:2], own[:2]), *np.maximum(box[2:], own[2:])]
        first = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype("<i4")
        body = struct.pack("<i4d2i", kind, *own, len(parts), len(xy)) + first.tobytes() + xy.tobytes()
        records.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
    size = (HEADER + sum(map(len, records))) // 2
    head = struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", VERSION, kind, *box, 0, 0, 0, 0)
    return head + b"".join(records)


def parse_attributes(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """The rows of an attribute table as text; blank values are null."""
    rows, head, size = struct.unpack("<iHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    for k in range(rows):
        row, place, out = data[head + k * size : head + (k + 1) * size], 1, {}
        for name, width in fields:
            text = row[place : place + width].decode(encoding, "replace").strip(" \0")
            out[name], place = text or None, place + width
        yield out


def _member(data: bytes, ending: str) -> bytes | None:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return data if ending == ".shp" else None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(ending)]
        return z.read(names[0]) if names else None


def shape_rows(files: DataFrame) -> DataFrame:
    """``source, shape_id, part, seq, lat, lon, attributes`` of files ``source, content``. A file is one row of
    Python's, as its records must be read in order; many files are many tasks."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for source, content in zip(pdf["source"], pdf["content"]):
                table = _member(bytes(content), ".dbf")
                attributes = list(parse_attributes(table)) if table else []
                for shape, part, xy in parse_shapes(_member(bytes(content), ".shp")):
                    own = attributes[shape] if shape < len(attributes) else {}
                    yield pd.DataFrame({"source": source, "shape_id": shape, "part": part, "seq": range(len(xy)), "lat": xy[:, 1], "lon": xy[:, 0], "attributes": [own] * len(xy)})

    return files.select("source", "content").mapInPandas(run, "source string, shape_id long, part int, seq int, lat double, lon double, attributes map<string,string>")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return shape_rows(spark.read.format("binaryFile").load(path).select(name.alias("source"), "content"))


def load_land_polygons(shapes: DataFrame) -> DataFrame:
    """``h, seq, lat, lon``: a ring per shape, its parts one after another; ``h`` numbers the shapes of a source."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source", "shape_id").orderBy("part", "seq")
    return shapes.select("source", F.col("shape_id").alias("h"), (F.row_number().over(w) - 1).alias("seq"), "lat", "lon")
