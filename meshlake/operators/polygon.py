"""Containment on the globe and in the plane.

Polygons are rows ``h, seq, lat, lon``. Containment has two plans: with few edges, an expression per
section that stays in code generation and moves no row; with many, edges are dealt to one-degree bands
(of longitude on the globe, of latitude in the plane) and points look up their band by an equi-join. Only hits move; sections
without a hit have a default, which a point takes from an array of sections. Edge sets and that array are
broadcast only below ``EDGE_LIMIT`` rows, which is checked. Of many sections small ones are dealt to cells of latitude and
longitude instead, and meet the points near them only: farther ones have the default. A cell that no edge is near has one
answer for all its points; only in the others a point meets the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import resources

#: Edges up to which a polygon set becomes literals; edges, and cells of sections, up to which they are broadcast.
LITERAL_EDGES, EDGE_LIMIT, CELL_LIMIT = 120, 1_000_000, 4_000_000
#: Edges of a section that are written out in an expression, which is compiled; of more, functions go through the array.
FEW_EDGES = 6
#: Sections of at most so many edges and degrees either way go to cells of so many degrees, a margin around them included.
CELL_EDGES, CELL_EXTENT, CELL, MARGIN = 64, 16.0, 1.0, 1e-6
#: Where all pairs of points and sections are asked for: sections that a point is paired with at a time, pairs of a task.
CHUNK, PAIRS = 1_000, 250_000_000


def edges(polygons: DataFrame) -> DataFrame:
    """``h, k, lat0, lon0, lat1, lon1`` of neighbouring vertices."""
    w = W.partitionBy("h").orderBy("seq")
    e = polygons.select("h", F.col("seq").alias("k"), F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    return e.where("lat0 is not null")


def _edges_by_task(polygons: DataFrame) -> DataFrame:
    """Edges by section, dealt to as many tasks as a shuffle has: the work on a section is more than its bytes tell."""
    return edges(polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h"))


def section_literals(polygons: DataFrame, limit: int = LITERAL_EDGES) -> dict[int, list[tuple[float, float]]] | None:
    """Vertices by section, if there are no more than ``limit``; at most limit + 1 rows reach the driver."""
    rows = polygons.select("h", "seq", "lat", "lon").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.seq)):
        out.setdefault(r.h, []).append((r.lat, r.lon))
    return out


def _default(ring: list[tuple[float, float]], period: float) -> bool:
    """Whether points that no edge straddles are inside: by the direction of the northernmost edge."""
    best, out = None, False
    for (lat0, lon0), (lat1, lon1) in zip(ring, ring[1:]):
        step = lon1 - lon0
        if best is None or (lat0 + lat1) / 2 > best:
            best, out = (lat0 + lat1) / 2, (-step if abs(step) == period else step) > 0
    return out


def inside_ring(lat: Column, lon: Column, ring: list[tuple[float, float]], period: float = 360.0) -> Column:
    """Whether a point is left of the nearest edge above or below it; ties go to the last edge."""
    hits = []
    for k, ((lat0, lon0), (lat1, lon1)) in enumerate(zip(ring, ring[1:])):
        if lon1 == lon0 or abs(lon1 - lon0) > period / 2:
            continue
        cross = (lon - lon0) / (lon1 - lon0) * (lat1 - lat0) + lat0
        straddles = (F.lit(lon0) <= lon) != (F.lit(lon1) <= lon)
        flag = F.lit(lon1 > lon0) != (cross > lat)
        hits.append(F.when(straddles, F.struct(F.abs(cross - lat).alias("gap"), F.lit(-k).alias("k"), flag.alias("inside"))))
    if not hits:
        return F.lit(_default(ring, period))
    return F.coalesce(F.array_min(F.array(*hits))["inside"], F.lit(_default(ring, period)))


def inside_region(points: DataFrame, polygons: DataFrame, keys: list[str], period: float = 360.0) -> DataFrame:
    """``keys, h, inside`` for each point ``keys, lat, lon`` and section. Keys identify points."""
    rings = section_literals(polygons)
    if rings is not None:
        each = [F.struct(F.lit(h).cast(polygons.schema["h"].dataType).alias("h"), inside_ring(F.col("lat"), F.col("lon"), ring, period).alias("inside")) for h, ring in sorted(rings.items())]
        return points.select(*keys, F.explode(F.array(*each)).alias("s")).select(*keys, "s.h", "s.inside")
    return _filled(points, *_region_hits(points, polygons, keys, period), keys)


def _side(live: DataFrame, band: Column) -> DataFrame | None:
    """Edges by band, broadcast if they are few; else the join on bands shuffles. None without edges."""
    banded = live.withColumn("band", F.explode(band))
    n = banded.limit(EDGE_LIMIT + 1).count()
    return None if n == 0 else F.broadcast(banded) if n <= EDGE_LIMIT else banded


def _dealt(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _lat, _lon`` dealt to all tasks: a small file is read by one, and a point may meet many sections."""
    return points.select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).repartition(*keys, "_lat", "_lon")


def _each(f, kind: str, spread: list[dict[str, Column]] | None = None) -> Column:
    """Whether ``f`` holds for all edges ``es``, for any, or for an odd number of them. Null counts as false. ``spread``: the edges as
    columns of their own, for rows in great number; there are no more, and ``_size`` tells how many."""
    size = F.size("es") if spread is None else F.col("_size")
    held = [F.coalesce(f(x), F.lit(False)) for x in (spread if spread is not None else [F.get("es", F.lit(k)) for k in range(FEW_EDGES)])]
    if kind == "odd":
        few = reduce(lambda a, b: a != b, held, F.lit(False))
    else:
        few = reduce(lambda a, b: a | b, held, F.lit(False)) if kind == "any" else reduce(lambda a, b: a & b, [(size <= k) | v for k, v in enumerate(held)], F.lit(True))
    if spread is not None:
        return few
    whole = {"all": lambda: F.forall("es", f), "any": lambda: F.exists("es", f), "odd": lambda: F.size(F.filter("es", f)) % 2 == 1}[kind]()
    return F.when(F.size("es") <= FEW_EDGES, few).otherwise(F.coalesce(whole, F.lit(False)))


def _is_small(rings: DataFrame) -> Column:
    box = (F.col("north") - F.col("south") <= CELL_EXTENT) & (F.col("east") - F.col("west") <= CELL_EXTENT)
    return F.coalesce((F.size("es") <= CELL_EDGES) & box, F.lit(False))


def _cells(points: DataFrame, rings: DataFrame, constant) -> tuple[DataFrame, DataFrame, DataFrame, str, int]:
    """Points by cell; the small ones of ``rings`` by cell, with ``constant`` of it as ``_odd``; these rings as a whole; a hint for
    tables of cells; the number of other rings."""

    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor((F.col(low) - MARGIN) / CELL), F.floor((F.col(high) + MARGIN) / CELL))

    rows, columns = cells("south", "north"), cells("west", "east")
    numbers = {"edges": F.sum(F.size("es")), "most": F.max(F.size("es")), "cells": F.sum(F.size(rows) * F.size(columns)), "rings": F.count("*")}
    size = {r["small_ring"]: r for r in rings.groupBy(F.col("small").alias("small_ring")).agg(*[v.alias(k) for k, v in numbers.items()]).collect()}
    own, large = size.get(True), size[False]["rings"] if False in size else 0
    rings, spread, flat = rings.where("small"), None, rings.where("small")
    if own is None or own["most"] <= FEW_EDGES:  # else functions go through the array, which keeps the plan from being compiled
        names, most = rings.schema["es"].dataType.elementType.names, 0 if own is None else own["most"]
        spread = [{n: F.col(f"_{n}_{k}") for n in names} for k in range(most)]
        ends = ("h", "other", "south", "north", "west", "east")
        flat = rings.select(*ends, F.size("es").alias("_size"), *[F.get("es", F.lit(k))[n].alias(f"_{n}_{k}") for k in range(most) for n in names])
    dealt = flat.withColumn("_row", F.explode(rows)).withColumn("_column", F.explode(columns))
    bounds = [F.col(c) * CELL + v for c in ("_row", "_column") for v in (-MARGIN, CELL + MARGIN)]
    dealt = dealt.select("h", "other", "_row", "_column", constant(*bounds, spread).alias("_odd"))
    lat, lon = F.col("_lat"), F.col("_lon")
    p = points.where(~F.isnan(lat) & ~F.isnan(lon)).withColumn("_row", F.floor(lat / CELL)).withColumn("_column", F.floor(lon / CELL))
    # by number, as sizes are estimated before cells and pairs are made, and the pairs might be broadcast
    per, whole = ("broadcast" if own is None or own[k] <= most else "merge" for k, most in (("cells", CELL_LIMIT), ("edges", EDGE_LIMIT)))
    return p, dealt, rings.hint(whole), per, large


def _asked(met: DataFrame, whole: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """``keys, h, inside`` of points ``keys, _lat, _lon, h``, by the section's edges where the point is in its box."""
    box = F.col("_lat").between(F.col("south") - MARGIN, F.col("north") + MARGIN) & F.col("_lon").between(F.col("west") - MARGIN, F.col("east") + MARGIN)
    return met.join(whole, "h").where(box).select(*keys, "h", test.alias("inside"))


def _near(points: DataFrame, rings: DataFrame, keys: list[str], constant, test: Column) -> tuple[DataFrame, int]:
    """``keys, h, inside`` of points ``keys, _lat, _lon`` by the small ones of rings ``h, es, other, south, north, west, east, small``,
    and the number of the rest. In a cell without an edge nearby all points are ``other``, the opposite of the default, or have
    the default: ``constant`` of the cell's south, north, west and east, margin included, is true or false. Where it is null,
    points in the box meet ``test``."""
    p, dealt, whole, hint, large = _cells(points, rings, constant)
    entry = F.when(F.coalesce("_odd", F.lit(True)), F.struct("h", F.when(F.col("_odd"), F.col("other")).alias("inside")))
    per = dealt.groupBy("_row", "_column").agg(F.collect_list(entry).alias("_cell")).hint(hint)
    met = p.join(per, ["_row", "_column"]).select(*keys, "_lat", "_lon", F.explode("_cell").alias("s")).select(*keys, "_lat", "_lon", "s.h", "s.inside")
    edge = _asked(met.where("inside is null").drop("inside"), whole, keys, test)
    return met.where("inside is not null").select(*keys, "h", "inside").unionByName(edge), large


def _near_first(points: DataFrame, rings: DataFrame, keys: list[str], constant, test: Column) -> tuple[DataFrame, int]:
    """Of these no more than the first section with a point needs, where sections are outside by default: a cell has the first
    of those that contain all its points, and of those with an edge nearby the ones before it."""
    p, dealt, whole, hint, large = _cells(points, rings, constant)
    cell = ["_row", "_column"]
    sure = dealt.groupBy(*cell).agg(F.min(F.when(F.col("_odd"), F.col("h"))).alias("_sure")).where("_sure is not null").hint(hint)
    before = dealt.where("_odd is null").join(sure, cell, "left").where("_sure is null or h < _sure").select(*cell, "h").hint(hint)
    whole_cells = p.join(sure, cell).select(*keys, F.col("_sure").alias("h"), F.lit(True).alias("inside"))
    return whole_cells.unionByName(_asked(p.join(before, cell).select(*keys, "_lat", "_lon", "h"), whole, keys, test)), large


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _closed(es: Column) -> Column:
    """Whether points above and below all edges are outside: between neighbouring longitudes of vertices, edges that
    may be the uppermost lead west and those that may be the lowest east."""

    def at(e, x):
        return (x - e["lon0"]) / (e["lon1"] - e["lon0"]) * (e["lat1"] - e["lat0"]) + e["lat0"]

    def sides(ys, top, bottom):
        return F.forall(ys, lambda y: ((y["hi"] < top - MARGIN) | ~y["east"]) & ((y["lo"] > bottom + MARGIN) | y["east"]))

    def slab(u: Column, v: Column) -> Column:
        over = F.filter(es, lambda e: (F.least(e["lon0"], e["lon1"]) <= u) & (F.greatest(e["lon0"], e["lon1"]) >= v))
        ys = F.transform(over, lambda e: F.struct(F.least(at(e, u), at(e, v)).alias("lo"), F.greatest(at(e, u), at(e, v)).alias("hi"), (e["lon1"] > e["lon0"]).alias("east")))
        ends = lambda ys: F.struct(F.array_max(F.transform(ys, lambda y: y["lo"])).alias("top"), F.array_min(F.transform(ys, lambda y: y["hi"])).alias("bottom"))
        return _let(ys, lambda ys: _let(ends(ys), lambda m: sides(ys, m["top"], m["bottom"])))

    def slabs(xs):
        return F.forall(F.arrays_zip(F.slice(xs, 1, F.size(xs) - 1).alias("u"), F.slice(xs, 2, F.size(xs) - 1).alias("v")), lambda x: slab(x["u"], x["v"]))

    def pair(e, f):
        """Two edges one above the other: a single slab."""
        lo, hi = ([m(x["lat0"], x["lat1"]) for x in (e, f)] for m in (F.least, F.greatest))
        top, bottom = F.greatest(*lo), F.least(*hi)
        return reduce(lambda a, b: a & b, [((h < top - MARGIN) | (x["lon1"] <= x["lon0"])) & ((l > bottom + MARGIN) | (x["lon1"] > x["lon0"])) for x, l, h in zip((e, f), lo, hi)])

    e, f = F.get(es, F.lit(0)), F.get(es, F.lit(1))
    whole = reduce(lambda a, b: a & b, [x[k].isNotNull() & ~F.isnan(x[k]) for x in (e, f) for k in ("lat0", "lon0", "lat1", "lon1")])
    same = (F.least(e["lon0"], e["lon1"]) == F.least(f["lon0"], f["lon1"])) & (F.greatest(e["lon0"], e["lon1"]) == F.greatest(f["lon0"], f["lon1"]))
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(es, lambda e: e["lon0"]), F.transform(es, lambda e: e["lon1"]))))
    return F.when((F.size(es) == 2) & whole & same, pair(e, f)).otherwise(_let(xs, slabs))


def _region_hits(points: DataFrame, polygons: DataFrame, keys: list[str], period: float = 360.0, first: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``keys, h, inside`` where an edge lies above or below the point, or with a null by a small section that has none, and
    ``h, default`` for all sections. With ``first`` only what the first section
    with a point needs, and null for the defaults if all are known to be outside."""
    e = _edges_by_task(polygons)
    step = F.col("lon1") - F.col("lon0")
    middle = (F.col("lat0") + F.col("lat1")) / 2
    default = F.max_by(F.when(F.abs(step) == period, -step).otherwise(step) > 0, F.struct(middle, -F.col("k"))).alias("default")
    steep = (step != 0) & (F.abs(step) <= period / 2)
    box = {"south": F.min(F.when(steep, F.least("lat0", "lat1"))), "north": F.max(F.when(steep, F.greatest("lat0", "lat1"))), "west": F.min(F.when(steep, F.least("lon0", "lon1"))), "east": F.max(F.when(steep, F.greatest("lon0", "lon1")))}
    rings = e.groupBy("h").agg(default, F.collect_list(F.when(steep, F.struct("k", "lat0", "lon0", "lat1", "lon1"))).alias("es"), *[v.alias(k) for k, v in box.items()])
    default = rings.select("h", "default")
    # a size first, so that long rings are not searched for slabs
    small = F.when(_is_small(rings) & ~F.col("default"), _closed(F.col("es"))).otherwise(False)
    rings = rings.withColumn("small", F.coalesce(small, F.lit(False)))

    def met(x):
        cross = (F.col("_lon") - x["lon0"]) / (x["lon1"] - x["lon0"]) * (x["lat1"] - x["lat0"]) + x["lat0"]
        return F.struct(F.abs(cross - F.col("_lat")).alias("gap"), (-x["k"]).alias("k"), ((x["lon1"] > x["lon0"]) != (cross > F.col("_lat"))).alias("inside"))

    def straddles(x):
        return (x["lon0"] <= F.col("_lon")) != (x["lon1"] <= F.col("_lon"))

    few = F.array(*[F.when(straddles(x), met(x)) for x in (F.get("es", F.lit(k)) for k in range(FEW_EDGES))])
    nearest = F.array_min(F.when(F.size("es") <= FEW_EDGES, few).otherwise(F.transform(F.filter("es", straddles), met)))
    points = _dealt(points, keys)

    def constant(south, north, west, east, spread):
        def apart(x):
            return (F.greatest(x["lon0"], x["lon1"]) < west) | (F.least(x["lon0"], x["lon1"]) > east)

        def says(x, inside: bool):
            above, below = F.least(x["lat0"], x["lat1"]) > north, F.greatest(x["lat0"], x["lat1"]) < south
            across = (F.least(x["lon0"], x["lon1"]) < west) & (F.greatest(x["lon0"], x["lon1"]) > east)
            return across & F.when(x["lon1"] > x["lon0"], below if inside else above).otherwise(above if inside else below)

        yes, no = _each(lambda x: apart(x) | says(x, True), "all", spread), _each(lambda x: apart(x) | says(x, False), "all", spread)
        return F.when(no, False).when(yes, True)

    near, large = (_near_first if first else _near)(points, rings.withColumn("other", ~F.col("default")), keys, constant, nearest["inside"])
    if not large:  # small ones are outside by default
        return near, None if first else default
    live = e.where(steep).join(rings.where("not small").select("h"), "h", "left_semi")
    side = _side(live, F.sequence(F.floor(F.least("lon0", "lon1")), F.floor(F.greatest("lon0", "lon1"))))
    if side is None:
        return near, default
    hit = points.withColumn("band", F.floor("_lon")).join(side, "band").where((F.col("lon0") <= F.col("_lon")) != (F.col("lon1") <= F.col("_lon")))
    cross = (F.col("_lon") - F.col("lon0")) / step * (F.col("lat1") - F.col("lat0")) + F.col("lat0")
    flag = (step > 0) != (cross > F.col("_lat"))
    found = hit.groupBy(*keys, "h").agg(F.min(F.struct(F.abs(cross - F.col("_lat")).alias("gap"), (-F.col("k")).alias("k"), flag.alias("inside"))).alias("m"))
    return near.unionByName(found.select(*keys, "h", "m.inside")), default


def _planar_hits(points: DataFrame, polygons: DataFrame, keys: list[str], tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """The same in the plane: where a ray from the point meets an edge, or the point lies on one."""
    w = W.partitionBy("h").orderBy("seq")
    here = F.struct(F.col("lat").alias("y"), F.col("lon").alias("x"))
    e = polygons.select("h", here.alias("b"), F.coalesce(F.lag(here).over(w), F.last(here).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("a")).where("a <> b")
    e = e.select("h", F.col("a.y").alias("y0"), F.col("a.x").alias("x0"), F.col("b.y").alias("y1"), F.col("b.x").alias("x1"))
    box = {"south": F.min(F.least("y0", "y1")), "north": F.max(F.greatest("y0", "y1")), "west": F.min(F.least("x0", "x1")), "east": F.max(F.greatest("x0", "x1"))}
    turn = e.groupBy("h").agg((F.sum(F.col("x0") * F.col("y1") - F.col("y0") * F.col("x1")) > 0).alias("ccw"), F.collect_list(F.struct("y0", "x0", "y1", "x1")).alias("es"), *[v.alias(k) for k, v in box.items()])
    # a ray from outside a ring's box meets none of its edges or an even number
    small = _is_small(turn) & F.lit(tolerance <= MARGIN)
    odd = _each(lambda x: _crosses(F.col("_lat"), F.col("_lon"), x), "odd")
    inside = _each(lambda x: _beside(F.col("_lat"), F.col("_lon"), x, tolerance), "any") | (odd == F.col("ccw"))
    points = _dealt(points, keys)

    def constant(south, north, west, east, spread):
        def apart(x):
            beside = (F.greatest(x["x0"], x["x1"]) < west) | (F.least(x["x0"], x["x1"]) > east)
            return beside | (F.greatest(x["y0"], x["y1"]) < south) | (F.least(x["y0"], x["y1"]) > north)

        return F.when(_each(apart, "all", spread), _each(lambda x: _crosses((south + north) / 2, (west + east) / 2, x), "odd", spread))

    turn = turn.withColumn("small", small)
    near, large = _near(points, turn.withColumn("other", F.col("ccw")), keys, constant, inside)
    default = turn.select("h", (~F.col("ccw")).alias("default"))
    if not large:
        return near, default
    e = e.join(turn.where("not small").select("h"), "h", "left_semi")
    side = _side(e, F.sequence(F.floor(F.least("y0", "y1") - tolerance), F.floor(F.greatest("y0", "y1") + tolerance)))
    turn = turn.select("h", "ccw")
    if side is None:
        return near, default
    edge = {k: F.col(k) for k in ("y0", "x0", "y1", "x1")}
    beside, crosses = _beside(F.col("_lat"), F.col("_lon"), edge, tolerance), _crosses(F.col("_lat"), F.col("_lon"), edge)
    hit = points.withColumn("band", F.floor("_lat")).join(side, "band").select(*keys, "h", beside.alias("beside"), crosses.alias("crosses")).where("beside or crosses")
    found = hit.groupBy(*keys, "h").agg(F.max("beside").alias("beside"), (F.sum(F.col("crosses").cast("int")) % 2 == 1).alias("odd")).join(turn, "h")
    found = found.select(*keys, "h", (F.col("beside") | (F.col("odd") == F.col("ccw"))).alias("inside"))
    return near.unionByName(found), default


def _sections(default: DataFrame, entry: Column) -> DataFrame:
    """One row with an array of the sections' entries, small enough to broadcast."""
    if default.limit(EDGE_LIMIT + 1).count() > EDGE_LIMIT:
        raise ValueError(f"more than {EDGE_LIMIT} sections")
    return F.broadcast(default.agg(F.sort_array(F.collect_list(entry)).alias("_every")))


def _chunks(default: DataFrame) -> DataFrame:
    """All sections in the order of ``h``, ``CHUNK`` to a row: ``_low, _high``, and ``_True, _False`` by their defaults."""
    every = _sections(default.where("default is not null"), F.struct("h", "default"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_every"), F.lit(1)), F.lit(CHUNK))
    each = every.select(F.explode(F.transform(starts, lambda k: F.slice("_every", k, F.lit(CHUNK)))).alias("_part")).where(F.size("_part") > 0)
    sides = [F.transform(F.filter("_part", lambda s: s["default"] == v), lambda s: s["h"]).alias(f"_{v}") for v in (True, False)]
    return F.broadcast(each.select(F.array_min("_part.h").alias("_low"), F.array_max("_part.h").alias("_high"), *sides))


def _filled(points: DataFrame, found: DataFrame, default: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, h, inside`` for each point and section; what isn't found has the section's default."""
    # by number, as a task's rows are few before they are filled
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() * default.count() // PAIRS))
    met = found.where("inside is not null").repartition(tasks, *keys)
    per = met.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("inside") == v, F.col("h"))).alias(f"_met{v}") for v in (True, False)])
    # never broadcast: a point's hits are estimated by the points' file and are many times larger
    d = points.select(*keys).repartition(tasks, *keys).join(per.hint("merge"), keys, "left").crossJoin(_chunks(default))
    # arrays of a chunk's sections: a look-up for each pair takes far longer, and arrays of all sections fill a task's memory
    here = [F.filter(f"_met{v}", lambda h: h.between(F.col("_low"), F.col("_high"))).alias(f"_met{v}") for v in (True, False)]
    d = d.select(*keys, "_True", "_False", *here)

    def sections(v: bool) -> Column:
        rest, other = F.array_except(f"_{v}", f"_met{not v}"), F.array_except(f"_met{v}", f"_{v}")
        hs = F.when(F.size("_metTrue") + F.size("_metFalse") > 0, F.concat(rest, other)).otherwise(F.col(f"_{v}"))
        return F.struct(F.lit(v).alias("inside"), hs.alias("hs"))

    each = d.select(*keys, F.explode(F.array(sections(True), sections(False))).alias("s"))
    return each.select(*keys, "s.inside", F.explode("s.hs").alias("h")).select(*keys, "h", "inside")


def _containing(points: DataFrame, found: DataFrame, default: DataFrame, keys: list[str]) -> DataFrame:
    """Points with ``_hs``: the sections that contain them. A point meets its hits and the sections that contain
    what no edge is near, not all sections."""
    per = found.where("inside is not null").groupBy(*keys).agg(F.collect_list(F.when(F.col("inside"), F.col("h"))).alias("_in"), F.collect_list("h").alias("_met"))
    d = points.join(per, keys, "left").crossJoin(_sections(default.where("default"), F.col("h")))
    hs = F.when(F.col("_met").isNull(), F.col("_every")).otherwise(F.concat("_in", F.array_except("_every", "_met")))
    return d.withColumn("_hs", hs).drop("_in", "_met", "_every")


def containing(points: DataFrame, polygons: DataFrame, keys: list[str], planar: bool = False) -> DataFrame:
    """``keys, h`` of the sections that contain each point, on the globe or in the plane."""
    found, default = (_planar_hits if planar else _region_hits)(points, polygons, keys)
    if default.where("default").isEmpty():
        return found.where("inside").select(*keys, "h")
    return _containing(points.select(*keys), found, default, keys).select(*keys, F.explode("_hs").alias("h"))


def first_section(points: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, section``: the first section that contains a point, or null."""
    rings = section_literals(polygons)
    if rings is not None:
        section = F.coalesce(*[F.when(inside_ring(F.col("lat"), F.col("lon"), ring), h) for h, ring in sorted(rings.items())]).cast(polygons.schema["h"].dataType)
        return points.select("*", section.alias("section"))
    found, default = _region_hits(points, polygons, keys, first=True)
    if default is None or default.where("default").isEmpty():
        return points.join(found.where("inside").groupBy(*keys).agg(F.min("h").alias("section")), keys, "left").select(*points.columns, "section")
    d = _containing(points, found, default, keys)
    return d.withColumn("section", F.array_min("_hs")).drop("_hs")


def _beside(lat: Column, lon: Column, e, tolerance: float) -> Column:
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    off = F.abs((lon - e["x0"]) * dy - (lat - e["y0"]) * dx) <= tolerance * F.hypot(dx, dy)
    across = lon.between(F.least(e["x0"], e["x1"]) - tolerance, F.greatest(e["x0"], e["x1"]) + tolerance)
    return lat.between(F.least(e["y0"], e["y1"]) - tolerance, F.greatest(e["y0"], e["y1"]) + tolerance) & across & off


def _crosses(lat: Column, lon: Column, e) -> Column:
    at = (lat - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"]) + e["x0"]
    return F.when((e["y0"] <= lat) != (e["y1"] <= lat), lon < at).otherwise(False)


def contains_ring(lat: Column, lon: Column, ring: list[tuple[float, float]], tolerance: float = 1e-9) -> Column:
    """Planar crossing parity; a clockwise ring means its outside. Points within the tolerance of an edge
    are inside."""
    each = [(a, b) for a, b in zip([ring[-1], *ring], ring) if a != b]
    edge = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("y0", "x0", "y1", "x1"), (*a, *b))]) for a, b in each])

    odd = F.size(F.filter(edge, lambda e: _crosses(lat, lon, e))) % 2 == 1
    return F.exists(edge, lambda e: _beside(lat, lon, e, tolerance)) | (odd == F.lit(signed_area(ring) > 0))


def contains(points: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, h, inside`` for each point ``keys, lat, lon`` and section, in the plane of (lat, lon)."""
    rings = section_literals(polygons)
    if rings is None:
        return _filled(points, *_planar_hits(points, polygons, keys), keys)
    each = [F.struct(F.lit(h).cast(polygons.schema["h"].dataType).alias("h"), contains_ring(F.col("lat"), F.col("lon"), ring).alias("inside")) for h, ring in sorted(rings.items())]
    return points.select(*keys, F.explode(F.array(*each)).alias("s")).select(*keys, "s.h", "s.inside")


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(lon0 * lat1 - lat0 * lon1 for (lat0, lon0), (lat1, lon1) in zip([ring[-1], *ring], ring)) / 2


def last_section(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points with ``section``: the last section that contains them, or null. With few edges no row is moved; else each
    distinct place is looked up once."""
    rings = section_literals(polygons)
    if rings is None:
        places = points.select("lat", "lon").where("lat is not null and lon is not null").distinct()
        found = _containing(places, *_planar_hits(places, polygons, ["lat", "lon"]), ["lat", "lon"])
        found = found.select("lat", "lon", F.array_max("_hs").alias("section"))
        return points.join(found, ["lat", "lon"], "left").select(*points.columns, "section")
    hits = [F.when(contains_ring(F.col("lat"), F.col("lon"), ring), h) for h, ring in sorted(rings.items(), reverse=True)]
    return points.select("*", F.coalesce(*hits).cast(polygons.schema["h"].dataType).alias("section"))


def orientation(polygons: DataFrame) -> DataFrame:
    """``h, counterclockwise``: the sign of the ring's area, with longitude to the right."""
    w = W.partitionBy("h").orderBy("seq")
    last = F.last(F.struct("lat", "lon")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    p = polygons.select("h", "lat", "lon", F.coalesce(F.lag(F.struct("lat", "lon")).over(w), last).alias("p"))
    return p.groupBy("h").agg((F.sum(F.col("p.lon") * F.col("lat") - F.col("p.lat") * F.col("lon")) > 0).alias("counterclockwise"))


def uninhabited(lat: Column, lon: Column, deserts: bool = False) -> Column:
    """Within two degrees of a remote island; with ``deserts`` also in a desert or beyond the settled latitudes."""
    out = F.lit(False)
    for a, b in resources.ISLANDS:
        out = out | ((F.abs(lat - a) < 2) & (F.abs(lon - b) < 2))
    if deserts:
        for a, b, p, q in resources.DESERTS:
            out = out | (F.pow((lat - a) / p, F.lit(2.0)) + F.pow((lon - b) / q, F.lit(2.0)) < 1)
        out = out | (lat >= resources.NORTH_LIMIT) | (lat <= resources.SOUTH_LIMIT)
    return out


def land_mask(grid: DataFrame, rings: DataFrame, exclude_antarctica: bool = False) -> DataFrame:
    """``i, j, land`` of grid points ``i, j, lat, lon`` by the parity of ring edges south of them; ``rings``:
    ``h, seq, lat, lon``, the last vertex joined to the first. Edges meet grid columns by an equi-join on j."""
    w = W.partitionBy("h").orderBy("seq")
    last = F.last(F.struct("lat", "lon")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    e = rings.select(F.coalesce(F.lag(F.struct("lat", "lon")).over(w), last).alias("a"), F.struct("lat", "lon").alias("b")).where("a.lon <> b.lon")
    columns = grid.select("j", "lon").distinct()
    lo, hi = F.least("a.lon", "b.lon"), F.greatest("a.lon", "b.lon")
    # a column's crossings, by one-degree bands
    banded = e.withColumn("band", F.explode(F.sequence(F.floor(lo), F.floor(hi))))
    hit = columns.withColumn("band", F.floor("lon")).join(banded, "band").where((F.col("a.lon") < F.col("lon")) != (F.col("b.lon") < F.col("lon")))
    cross = F.col("a.lat") + (F.col("lon") - F.col("a.lon")) / (F.col("b.lon") - F.col("a.lon")) * (F.col("b.lat") - F.col("a.lat"))
    per = hit.groupBy("j").agg(F.collect_list(cross).alias("crossings"))
    below = F.size(F.filter(F.coalesce("crossings", F.array().cast("array<double>")), lambda c: c < F.col("lat")))
    return grid.join(per, "j", "left").select("i", "j", ((below % 2 == 1) & ~uninhabited(F.col("lat"), F.col("lon"), exclude_antarctica)).alias("land"))
