"""Elevation lattices, river barriers and highest paths."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

ROWS, COLUMNS, PER_DEGREE = 1801, 3600, 10


def load_elevation(pixels: DataFrame, rows: int = ROWS, columns: int = COLUMNS, per_degree: int = PER_DEGREE) -> DataFrame:
    """``i, j, z``: the least elevation, at least 0, of pixels ``tile, row, col, z`` nearest to each node with any.
    A tile's name ends in its corner, as in e020n40; tiles span 50 degrees south and 40 east in
    ``n_rows`` by ``n_cols`` pixels. Nodes of the masked quadrant are left out, as are nodes without pixels."""
    name = F.col("tile")
    lat0 = F.substring(name, -2, 2).cast("double") * F.when(F.substring(name, -3, 1) == "n", 1).otherwise(-1)
    lon0 = F.substring(name, -6, 3).cast("double") * F.when(F.substring(name, -7, 1) == "e", 1).otherwise(-1)
    lat = lat0 - (F.col("row") + 0.5) * 50.0 / F.col("n_rows")
    lon = lon0 + (F.col("col") + 0.5) * 40.0 / F.col("n_cols")
    i = F.least(F.greatest(F.floor((lat + 90.0) * per_degree + 0.5), F.lit(0)), F.lit(rows - 1)).cast("int")
    j = F.pmod(F.floor((lon + 180.0) * per_degree + 0.5), F.lit(columns)).cast("int")
    d = pixels.select(i.alias("i"), j.alias("j"), "z").groupBy("i", "j").agg(F.greatest(F.min("z"), F.lit(0.0)).alias("z"))
    la, lo = F.col("i") / per_degree - 90.0, F.col("j") / per_degree - 180.0
    return d.where(~((la > 45) & (lo > 0) & (lo < 90)))


def blocked_steps(rivers: DataFrame) -> DataFrame:
    """``i, j, di, dj``: lattice steps that a river segment meets, both ways. ``rivers``: ``river_id, part, seq, i, j``
    in lattice units. A segment looks only at the nodes of its own bounding box."""
    from pyspark.sql import Window as W

    w = W.partitionBy("river_id", "part").orderBy("seq")
    s = rivers.select(F.lag("i").over(w).alias("ai"), F.lag("j").over(w).alias("aj"), F.col("i").alias("bi"), F.col("j").alias("bj")).where("ai is not null")
    s = s.withColumn("i", F.explode(F.sequence(F.floor(F.least("ai", "bi")).cast("int"), F.ceil(F.greatest("ai", "bi")).cast("int"))))
    s = s.withColumn("j", F.explode(F.sequence(F.floor(F.least("aj", "bj")).cast("int"), F.ceil(F.greatest("aj", "bj")).cast("int"))))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("s")
    s = s.select("ai", "aj", "bi", "bj", "i", "j", step).select("*", "s.di", "s.dj")
    hit = s.where(geo.intersects(("ai", "aj"), ("bi", "bj"), ("i", "j"), (F.col("i") + F.col("di"), F.col("j") + F.col("dj"))))
    one = hit.select("i", "j", "di", "dj")
    back = hit.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (-F.col("di")).alias("di"), (-F.col("dj")).alias("dj"))
    return one.unionByName(back).distinct()


def on_water(points: DataFrame, elevation: DataFrame, rows: int, columns: int, per_degree: int) -> DataFrame:
    """Points ``..., lat, lon`` with ``water``: whether the nearest node isn't above 0 or has no elevation."""
    i = F.least(F.greatest(F.round((F.col("lat") + 90.0) * per_degree), F.lit(0)), F.lit(rows - 1)).cast("int")
    j = F.least(F.greatest(F.round((F.col("lon") + 180.0) * per_degree), F.lit(0)), F.lit(columns - 1)).cast("int")
    d = points.withColumn("i", i).withColumn("j", j).join(elevation.select("i", "j", "z"), ["i", "j"], "left")
    return d.select(*points.columns, (F.coalesce("z", F.lit(float("-inf"))) <= 0).alias("water"))


def adjacent(pairs: DataFrame, blocked: DataFrame, rows: int, columns: int) -> DataFrame:
    """Pairs ``..., ai, aj, bi, bj`` with ``adjacent``: a king's move apart, longitudes wrapped, not blocked."""
    dj = F.col("bj") - F.col("aj")
    dj = F.when(F.abs(dj) == columns - 1, -F.signum(dj)).otherwise(dj).cast("int")
    d = pairs.withColumn("di", F.col("bi") - F.col("ai")).withColumn("dj", dj)
    b = blocked.select(F.col("i").alias("ai"), F.col("j").alias("aj"), "di", "dj", F.lit(True).alias("shut"))
    d = d.join(b, ["ai", "aj", "di", "dj"], "left")
    ok = (F.abs("di") <= 1) & (F.abs("dj") <= 1) & ((F.col("di") != 0) | (F.col("dj") != 0)) & F.col("bi").between(0, rows - 1) & F.col("shut").isNull()
    return d.select(*pairs.columns, ok.alias("adjacent"))


#: Fixed order of the eight moves: of paths alike in heights and bends, the one found last goes on.
MOVES = [(di, dj) for di in (0, -1, 1) for dj in (0, -1, 1) if di or dj]


def highest_path(z: dict[tuple[int, int], float], start: tuple[int, int], ends: set[tuple[int, int]], columns: int, blocked: set[tuple[int, int, int, int]] = frozenset()) -> list[tuple[int, int]]:
    """The path of king's moves over a cropped lattice with the greatest elevations, compared in order from the
    lowest; a path that has another's and more is greater; then the one with the fewest bends of indices. Best first: each
    node is settled by the best path that reaches it. A path takes no detour: it doesn't step to a node that an open move
    joins with the node before its last. Paths share what they have in common, as links back to the start."""
    heap = [((-z[start], math.inf), 0, 0, (start, None), [z[start]])]  # least first, so elevations are negated; inf: the end
    settled, count = set(), 0
    while heap:
        _, bends, _, link, heights = heapq.heappop(heap)
        here, behind = link[0], link[1] and link[1][0]
        if here in ends:
            path = []
            while link:
                path.append(link[0])
                link = link[1]
            return path[::-1]
        if here in settled:
            continue
        settled.add(here)
        for di, dj in MOVES:
            there = here[0] + di, (here[1] + dj) % columns
            if there not in z or there in settled or (*here, di, dj) in blocked or (behind and _joined(there, behind, columns, blocked)):
                continue
            grown = list(heights)
            bisect.insort(grown, z[there])
            bend = behind is not None and (2 * here[0] - behind[0], 2 * here[1] - behind[1]) != there
            count -= 1
            heapq.heappush(heap, ((*(-v for v in grown), math.inf), bends + bend, count, (there, link), grown))
    raise ValueError("no path leads to the end")


def _joined(a: tuple[int, int], b: tuple[int, int], columns: int, blocked: set[tuple[int, int, int, int]]) -> bool:
    """Whether an open move leads from a to b."""
    di, dj = b[0] - a[0], b[1] - a[1]
    if abs(dj) == columns - 1:
        dj = -1 if dj > 0 else 1
    return abs(di) <= 1 and abs(dj) <= 1 and (di, dj) != (0, 0) and (*a, di, dj) not in blocked


def bottleneck(spark, elevation: DataFrame, starts: DataFrame, columns: int, rounds: int | None = None, blocked: DataFrame | None = None, checkpoint=None) -> DataFrame:
    """``i, j, z``: the greatest least elevation of any path from the starts to each node: labels spread to
    neighbours and only rise, until none changes, a cell a round. Labels that still rise after ``rounds``, if given, are an error. Each
    round is written by ``checkpoint(df, name)`` if given."""
    label = elevation.join(starts.select("i", "j", F.lit(True).alias("s")), ["i", "j"], "left").select("i", "j", F.col("z").alias("own"), F.when(F.col("s"), F.col("z")).alias("z"))
    move = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("m")
    for k in itertools.count():
        sent = label.where("z is not null").select("i", "j", "z", move).select("i", "j", "z", "m.di", "m.dj")
        if blocked is not None:
            sent = sent.join(blocked, ["i", "j", "di", "dj"], "left_anti")
        sent = sent.groupBy((F.col("i") + F.col("di")).alias("i"), F.pmod(F.col("j") + F.col("dj"), F.lit(columns)).cast("int").alias("j")).agg(F.max("z").alias("new"))
        # nulls are no paths: least() would skip them
        risen = F.greatest("z", F.when(F.col("new").isNotNull(), F.least("own", "new")))
        nxt = label.join(sent, ["i", "j"], "left").select("i", "j", "own", risen.alias("z"), (~risen.eqNullSafe(F.col("z"))).alias("changed"))
        nxt = checkpoint(nxt, f"round-{k}") if checkpoint else nxt.checkpoint()
        if nxt.where("changed").isEmpty():
            break
        if k + 1 == rounds:
            raise RuntimeError(f"labels still rise after {rounds} rounds")
        label = nxt.drop("changed")
    return label.select("i", "j", "z")


def drainage_divides(z: dict[tuple[int, int], float], ends: list[tuple[int, int]], columns: int, blocked: set[tuple[int, int, int, int]] = frozenset()) -> list[list[tuple[int, int]]]:
    """Cuts over a cropped lattice from ends: the highest path from the second end to the first, from the third to
    the nearest place on it (where all cuts meet), and from each further one to there. Cuts run outward from the meeting
    point to the ends in their order, without their nodes on water (elevations of 0 or less); a cut with no land is
    empty. Of two ends the one path is the cut."""
    first = highest_path(z, ends[1], {ends[0]}, columns, blocked)
    out = [first]
    if len(ends) > 2:
        second = highest_path(z, ends[2], set(first), columns, blocked)
        meet = second[-1]
        k = first.index(meet)
        out = [first[k:], first[: k + 1][::-1], second[::-1]]
        out += [highest_path(z, e, {meet}, columns, blocked)[::-1] for e in ends[3:]]
    return [[p for p in cut if z[p] > 0] for cut in out]


def _unwrapped(path: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A vertex at -180 degrees beside one of the eastern half stands at 180 degrees, too, next to that one."""
    out = []
    for k, (lat, lon) in enumerate(path):
        after = k + 1 < len(path) and path[k + 1][1] > 0
        before = k > 0 and path[k - 1][1] > 0
        ends = [(lat, 180.0), (lat, lon)] if before and not after else [(lat, lon), (lat, 180.0)]
        out += ends if lon == -180 and (before or after) else [(lat, lon)]
    return out


def divide_cuts(spark, cuts: list[list[tuple[int, int]]], per_degree: float, resolution: float | None = None, glue: tuple[float, float] = (-90.0, 0.0)) -> DataFrame:
    """``seq, cut, lat, lon`` as in a cut file: the glue point stands first, then each cut in degrees, simplified to the
    resolution (if not given, a lattice cell's diagonal) on either side of the antimeridian. Empty cuts have no rows."""
    import numpy as np

    from . import paths

    rows: list[tuple[int, float, float]] = [(0, *glue)]
    for k, cut in enumerate(cuts, 1):
        path = np.array(_unwrapped([(i / per_degree - 90.0, j / per_degree - 180.0) for i, j in cut])).reshape(-1, 2)
        if len(path):
            kept = paths.decimated(path, math.sqrt(2) / per_degree if resolution is None else resolution, wrap=True)
            rows += [(k, float(a), float(b)) for a, b in path[kept]]
    return spark.createDataFrame([(s, *r) for s, r in enumerate(rows)], "seq int, cut int, lat double, lon double")
