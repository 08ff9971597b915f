"""Operators on lines: rows of a key, an order and coordinates. Windows are partitioned by the line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: a projected step longer than this crosses an interruption.
SNIP = 1000.0


def _line(keys, order="seq"):
    return W.partitionBy(*keys).orderBy(order)


def _whole(keys, order="seq"):
    return _line(keys, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def segment_lengths(lines: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """With ``length`` to the previous vertex; of a closed line's first vertex, to the last; else null."""
    w = _line(keys)
    px, py = F.lag("x").over(w), F.lag("y").over(w)
    if closed:
        px, py = F.coalesce(px, F.last("x").over(_whole(keys))), F.coalesce(py, F.last("y").over(_whole(keys)))
    return lines.withColumn("length", F.hypot(F.col("x") - px, F.col("y") - py))


def split_lines(lines: DataFrame, keys: list[str], closed: bool = False, most: float = SNIP) -> DataFrame:
    """With ``piece`` and ``piece_seq``: cut at jumps; a closed line starts at its first jump; pieces of a
    cut line with one vertex go."""
    d = segment_lengths(lines, keys, closed).withColumn("jump", F.coalesce(F.col("length") > most, F.lit(False)).cast("int"))
    w, all_ = _line(keys), _whole(keys)
    d = d.withColumn("jumps", F.sum("jump").over(all_)).withColumn("piece", F.sum("jump").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("row", F.row_number().over(w)).withColumn("n", F.count("*").over(all_))
    if closed:
        first = F.min(F.when(F.col("jump") == 1, F.col("row"))).over(all_)
        d = d.withColumn("row", F.when(F.col("jumps") == 0, F.col("row")).otherwise(F.pmod(F.col("row") - first, F.col("n"))))
        d = d.withColumn("piece", F.when(F.col("jumps") == 0, 0).otherwise(F.pmod(F.col("piece") - 1, F.col("jumps"))))
    piece = W.partitionBy(*keys, "piece")
    d = d.withColumn("in_piece", F.count("*").over(piece)).where("jumps = 0 or in_piece > 1")
    return d.withColumn("piece_seq", F.row_number().over(piece.orderBy("row"))).drop("length", "jump", "jumps", "row", "n", "in_piece")


def longitude_pieces(lines: DataFrame, keys: list[str]) -> DataFrame:
    """With ``piece``, which steps up where the longitude jumps by more than 180 degrees."""
    w = _line(keys)
    jump = F.coalesce(F.abs(F.col("lon") - F.lag("lon").over(w)) > 180, F.lit(False)).cast("int")
    return lines.withColumn("jump", jump).withColumn("piece", F.sum("jump").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("jump")


def check_wrapping(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, seq, part, lat, lon``: beside a vertex at -180 whose neighbour is east, a twin at +180."""
    w = _line(keys)
    lines = lines.select(*keys, "seq", "lat", "lon", F.coalesce(F.lead("lon").over(w) > 0, F.lit(False)).alias("nxt"), F.coalesce(F.lag("lon").over(w) > 0, F.lit(False)).alias("prev"))
    nxt, prev = F.col("nxt"), F.col("prev")
    edge = F.col("lon") == -180

    def vertex(part: int, lon: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.col("lat").alias("lat"), lon.cast("double").alias("lon"))

    own = vertex(0, F.col("lon"))
    v = F.when(edge & nxt, F.array(own, vertex(1, F.lit(180.0)))).when(edge & prev, F.array(vertex(-1, F.lit(180.0)), own)).otherwise(F.array(own))
    return lines.select(*keys, "seq", F.explode(v).alias("v")).select(*keys, "seq", "v.*")


def _divided(lines: DataFrame, keys: list[str], pieces: Column, keep_jump: bool) -> DataFrame:
    """``keys, seq, part, lat, lon``: each segment in as many equal pieces, by its ``length``, named by its end."""
    w = _line(keys)
    d = lines.select(*keys, "seq", "lat", "lon", F.lag("lat").over(w).alias("plat"), F.lag("lon").over(w).alias("plon")).withColumn("length", _length())
    first = F.col("plat").isNull()
    n = F.when(first, 1).otherwise(pieces)
    d = d.select("*", n.alias("n")).where("n > 0") if not keep_jump else d.select("*", F.greatest(n, F.lit(1)).alias("n"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("part"))
    t = F.col("part") / F.col("n")
    last = first | (F.col("part") == F.col("n"))
    return d.select(*keys, "seq", "part", F.when(last, F.col("lat")).otherwise((1 - t) * F.col("plat") + t * F.col("lat")).alias("lat"), F.when(last, F.col("lon")).otherwise((1 - t) * F.col("plon") + t * F.col("lon")).alias("lon"))


def _length() -> Column:
    """As the root of a sum of squares by the library's power, which the SQL takes too: hypot, products and Java's power may
    differ in the last bit, which is a piece more or less where a length is a multiple of the resolution. So numpy does it."""

    def root(a: pd.Series, b: pd.Series) -> pd.Series:
        return np.sqrt(np.float_power(a, 2) + np.float_power(b, 2))

    return F.pandas_udf(root, "double")(F.col("lat") - F.col("plat"), F.col("lon") - F.col("plon"))


def resolve(lines: DataFrame, keys: list[str], resolution: float) -> DataFrame:
    """Segments in the least number of equal pieces that are no longer than the resolution; those that jump by
    more than 180 degrees, or have no length, are left out with their end."""
    jump = F.abs(F.col("lon") - F.col("plon")) > 180
    return _divided(lines, keys, F.when(jump, 0).otherwise(F.ceil(F.col("length") / resolution)), keep_jump=False)


def refine(lines: DataFrame, keys: list[str], resolution: float, period: float = 360.0) -> DataFrame:
    """Segments halved until none is longer than the resolution; those that jump by more than half a period stay."""
    halvings = F.array(*[F.lit(2**k) for k in range(0, 31)])
    # 2^30 pieces are more than a row's array can hold, so a finer resolution is an error there
    n = F.element_at(F.filter(halvings, lambda p: F.col("length") / p <= resolution), 1)
    jump = F.abs(F.col("lon") - F.col("plon")) > period / 2
    return _divided(lines, keys, F.when(jump, 1).otherwise(n), keep_jump=True)


def around_pole(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, seq, part, lat, lon``: at each jump of 360 degrees two vertices at the pole: north where the
    longitude falls; of exactly two jumps the northern one north, the other south."""
    w, all_ = _line(keys), W.partitionBy(*keys)
    d = lines.select(*keys, "seq", "lat", "lon", F.lag("lon").over(w).alias("plon"))
    d = d.withColumn("jump", F.coalesce(F.abs(F.col("lon") - F.col("plon")) == 360, F.lit(False)))
    d = d.withColumn("jumps", F.sum(F.col("jump").cast("int")).over(all_))
    at = F.when(F.col("jump"), F.struct("lat", (-F.col("seq")).alias("s")))
    low = F.when(F.col("jump"), F.struct("lat", "seq"))
    d = d.withColumn("north", F.max(at).over(all_)).withColumn("south", F.min(low).over(all_))
    north, south = F.col("north"), F.col("south")
    sign = F.when(F.col("lon") < F.col("plon"), 1.0).otherwise(-1.0)
    sign = F.when((F.col("jumps") == 2) & (F.col("seq") == south["seq"]), -1.0).when((F.col("jumps") == 2) & (F.col("seq") == -north["s"]), 1.0).otherwise(sign)

    def vertex(part: int, lat: Column, lon: str) -> Column:
        return F.struct(F.lit(part).alias("part"), lat.alias("lat"), F.col(lon).alias("lon"))

    own = vertex(0, F.col("lat"), "lon")
    v = F.when(F.col("jump"), F.array(vertex(-2, sign * 90, "plon"), vertex(-1, sign * 90, "lon"), own)).otherwise(F.array(own))
    return d.select(*keys, "seq", F.explode(v).alias("v")).select(*keys, "seq", "v.*")


# Operators that look at a vertex in the light of those kept before it: a line at a time, in numpy.


def decimated(path: np.ndarray, resolution: float, wrap: bool = False) -> np.ndarray:
    """Indices kept by Ramer, Douglas and Peucker. With ``wrap`` the second coordinate is a longitude, and what lies
    between jumps of more than 180 degrees is a path of its own."""
    if wrap:
        edges = [0, *(np.flatnonzero(np.abs(np.diff(path[:, 1])) > 180) + 1).tolist(), len(path)]
        return np.concatenate([a + decimated(path[a:z], resolution) for a, z in zip(edges, edges[1:])])
    keep, stack = {0, len(path) - 1}, [(0, len(path) - 1)]
    while stack:
        a, z = stack.pop()
        if z - a < 2:
            continue
        # each product by itself, as a matrix product may fuse them, and squares by the library's power, as in the SQL: the
        # last bit decides ties and what is just far enough
        (dx, dy), (u, v) = path[z] - path[a], (path[a + 1 : z] - path[a]).T
        along = (u * dx + v * dy) / (np.sqrt(np.float_power(dx, 2) + np.float_power(dy, 2)) or 1.0)
        far = np.sqrt(np.maximum(0, np.float_power(u, 2) + np.float_power(v, 2) - np.float_power(along, 2)))
        k = int(np.argmax(far))
        if far[k] >= resolution:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, z)]
    return np.array(sorted(keep))


def simplified(path: np.ndarray, cyclic: bool = False) -> np.ndarray:
    """Indices left without repeated vertices, retraced spurs and midpoints of straight lines."""

    def direction(a, b):
        d = path[b] - path[a]
        return d / (np.abs(d).max() or 1.0)

    def equal(a, b):
        return bool((path[a] == path[b]).all())

    out: list[int] = []
    for k in range(len(path)):
        if out and equal(out[-1], k):
            continue
        out.append(k)
        if len(out) > 2 and equal(out[-3], out[-1]):
            del out[-2:]
    if cyclic:
        while len(out) > 1 and equal(out[0], out[-1]):
            out.pop()
        while len(out) > 2 and equal(out[1], out[-1]):
            out = out[1:-1]
    kept: list[int] = []
    for k in out:
        while len(kept) > 1 and _parallel(direction(kept[-2], kept[-1]), direction(kept[-1], k)):
            kept.pop()
        kept.append(k)
    if cyclic and len(kept) > 3:
        if _parallel(direction(kept[-2], kept[-1]), direction(kept[-1], kept[0])):
            kept.pop()
        if len(kept) > 3 and _parallel(direction(kept[-1], kept[0]), direction(kept[0], kept[1])):
            kept.pop(0)
    return np.array(kept)


def _parallel(a, b) -> bool:
    return bool((a == b).all() or (a == -b).all())


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Indices of the strictly convex hull, counterclockwise from the lowest of the leftmost points."""
    order = np.lexsort((points[:, 1], points[:, 0]))

    def half(idx):
        out: list[int] = []
        for k in idx:
            while len(out) > 1:
                a, b = points[out[-1]] - points[out[-2]], points[k] - points[out[-1]]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(int(k))
        return out

    return np.array(half(order)[:-1] + half(order[::-1])[:-1] or [int(order[0])])


def per_line(lines: DataFrame, keys: list[str], columns: tuple[str, str], kept, renumber: bool = False) -> DataFrame:
    """The vertices ``keys, seq, columns`` whose indices ``kept(path)`` returns; with ``renumber`` seq is their place in
    that order, which is a hull's own. A line is one group, as each choice depends on the ones before it; groups are
    lines, not the table."""
    schema = ", ".join([*(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys), f"seq {lines.schema['seq'].dataType.simpleString()}", *(f"{c} double" for c in columns)])

    def run(pdf):  # pandas DataFrame in, pandas DataFrame out
        pdf = pdf.sort_values("seq")
        out = pdf.iloc[kept(pdf[list(columns)].to_numpy(float))]
        return out.assign(seq=range(len(out))) if renumber else out

    return lines.select(*keys, "seq", *columns).groupBy(*keys).applyInPandas(run, schema)


def merge_pieces(pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Rings from the pieces of cut closed lines: each end goes on to the nearest start, its own included.
    The last piece that is left starts a ring."""
    left, out = list(pieces), []
    while left:
        ring = left.pop()
        while True:
            starts = np.array([p[0] for p in left] + [ring[0]])
            k = int(np.argmin(np.hypot(*(starts - ring[-1]).T)))
            if k == len(left):
                break
            ring = np.concatenate([ring, left.pop(k)])
        out.append(ring)
    return out


def merge_closed(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ring, seq, x, y`` from ``keys, line, piece, piece_seq, x, y``, a feature at a time."""
    schema = ", ".join([*(f"{k} {pieces.schema[k].dataType.simpleString()}" for k in keys), "ring int, seq int, x double, y double"])

    def run(pdf):  # pandas DataFrame in, pandas DataFrame out
        import pandas as pd

        key = pdf.iloc[0][keys]
        parts = [g.sort_values("piece_seq")[["x", "y"]].to_numpy() for _, g in pdf.sort_values(["line", "piece"]).groupby(["line", "piece"])]
        rows = [(*key, r, s, *v) for r, ring in enumerate(merge_pieces(parts)) for s, v in enumerate(ring)]
        return pd.DataFrame(rows, columns=[*keys, "ring", "seq", "x", "y"])

    return pieces.select(*keys, "line", "piece", "piece_seq", "x", "y").groupBy(*keys).applyInPandas(run, schema)
