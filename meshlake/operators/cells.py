"""Nodes, cells, strains and energies of a mesh, and aggregates over sections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo

#: Least weight of a cell, bounds of the aggressive energy.
MIN_WEIGHT, STEEPNESS, TOO_FAR = 0.01, 10.0, -100.0


def enumerate_nodes(mesh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mesh as ``h, i, j, node_id`` and positions ``node_id, x, y``: distinct positions in order of x, y from
    0; null for missing nodes. A rank over a mesh's nodes needs one order of them all; a mesh is of fixed size."""
    places = mesh.where("x is not null").select("x", "y").distinct()
    places = places.select((F.row_number().over(W.orderBy("x", "y")) - 1).alias("node_id"), "x", "y")
    ids = mesh.select("h", "i", "j", "x", "y").join(places, ["x", "y"], "left").select("h", "i", "j", "node_id")
    return ids, places


def restore(ids: DataFrame, places: DataFrame) -> DataFrame:
    """``h, i, j, x, y`` from ids and positions; missing nodes stay null."""
    return ids.join(places, "node_id", "left").select("h", "i", "j", "x", "y")


def enumerate_cells(ids: DataFrame, weights: DataFrame, lats: DataFrame, dlat: float, dlon: float) -> DataFrame:
    """``h, i, j, west, east, south, north`` and weights of distinct corner cells. Each quad has four, one per
    corner; equal ones count once, in the place of the first (by corner, section, row, column) with their values
    summed; those with missing or equal west and east nodes go. ``weights``: ``h, i, j, shape, scale`` per quad;
    ``lats``: ``i, lat``."""
    row, column = W.partitionBy("h", "i").orderBy("j"), W.partitionBy("h", "j").orderBy("i")
    n = F.col("node_id")
    q = ids.select("h", "i", "j", n.alias("sw"), F.lead(n).over(row).alias("se"), F.lead("j").over(row).alias("more"))
    q = q.select("h", "i", "j", "sw", "se", "more", F.lead("sw").over(column).alias("nw"), F.lead("se").over(column).alias("ne"), F.lead("i").over(column).alias("up"))
    q = q.where("more is not null and up is not null").join(weights, ["h", "i", "j"])

    def corner(di: int, dj: int) -> Column:
        west, east = ("nw", "ne") if di else ("sw", "se")
        south, north = ("se", "ne") if dj else ("sw", "nw")
        return F.struct(
            F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), "h", "i", "j").alias("ord"), F.col(west).alias("west"), F.col(east).alias("east"), F.col(south).alias("south"), F.col(north).alias("north")
        )

    c = q.select("shape", "scale", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("shape", "scale", "c.*")
    c = c.groupBy("west", "east", "south", "north").agg(F.min("ord").alias("o"), F.sum("shape").alias("shape"), F.sum("scale").alias("scale"))
    c = c.where("west is not null and east is not null and south is not null and north is not null and west <> east")
    c = c.select("o.h", (F.col("o.i") + F.col("o.di")).alias("i"), (F.col("o.j") + F.col("o.dj")).alias("j"), (F.col("o.i") + 1 - F.col("o.di")).alias("other"), "west", "east", "south", "north", "shape", "scale")
    area = lats.select("i", (geo.ellipsoid_row_height("lat", dlat) * geo.ellipsoid_column_width("lat", dlon)).alias("area"))
    c = c.join(F.broadcast(area), "i").join(F.broadcast(area.select(F.col("i").alias("other"), F.col("area").alias("area2"))), "other")  # a row per grid row
    part = (3 * F.col("area") + F.col("area2")) / 16 / (4 * math.pi * geo.EARTH.a**2)
    weight = [(part * F.least(F.lit(1.0), F.greatest(F.lit(MIN_WEIGHT), F.col(k)))).alias(f"{k}_weight") for k in ("shape", "scale")]
    return c.select("h", "i", "j", "west", "east", "south", "north", *weight)


def with_strains(cells: DataFrame, places: DataFrame, lats: DataFrame, dlat: float, dlon: float) -> DataFrame:
    """Cells with the half axes ``a, b`` of their strain."""
    size = lats.select("i", geo.ellipsoid_row_height("lat", dlat).alias("dphi"), geo.ellipsoid_column_width("lat", dlon).alias("dlam"))
    d = cells.join(F.broadcast(size), "i")  # a row per grid row
    for k in ("west", "east", "south", "north"):
        d = d.join(places.select(F.col("node_id").alias(k), F.struct("x", "y").alias(f"at_{k}")), k)
    e, n = F.col("dlam"), F.col("dphi")
    s = geo.principal_strains(
        (F.col("at_east.x") - F.col("at_west.x")) / e, (F.col("at_east.y") - F.col("at_west.y")) / e, (F.col("at_north.x") - F.col("at_south.x")) / n, (F.col("at_north.y") - F.col("at_south.y")) / n
    )
    return d.withColumn("s", s).select(*cells.columns, F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def energy_aggressive(cells: DataFrame) -> DataFrame:
    """One row ``energy``: -inf if all strains are positive, inf if one is far below, else a steep sum."""
    least = F.min(F.least("a", "b"))
    total = F.sum(F.exp(-STEEPNESS * F.greatest(F.col("a"), F.lit(TOO_FAR))) + F.exp(-STEEPNESS * F.greatest(F.col("b"), F.lit(TOO_FAR))))
    return cells.agg(F.when(least > 0, float("-inf")).when(least < TOO_FAR, float("inf")).otherwise(total).alias("energy"))


def _shape() -> Column:
    return 2 * F.pow(F.col("a") - F.col("b"), F.lit(2.0)) * F.col("shape_weight")


def energy_lenient(cells: DataFrame) -> DataFrame:
    return cells.agg(F.sum(F.pow(F.col("a") + F.col("b") - 2, F.lit(2.0)) * F.col("scale_weight") + _shape()).alias("energy"))


def energy_strict(cells: DataFrame) -> DataFrame:
    """inf if a strain isn't positive."""
    ok = (F.col("a") > 0) & (F.col("b") > 0)
    ab = F.col("a") * F.col("b")
    total = F.sum(F.when(ok, ((ab * ab - 1) / 2 - F.log(F.when(ok, ab))) * F.col("scale_weight") + _shape()))
    return cells.agg(F.when(F.min(ok), total).otherwise(float("inf")).alias("energy"))


def blend_seams(mesh: DataFrame, shared: Column) -> DataFrame:
    """Shared nodes take the mean position over the sections that have them."""
    node = W.partitionBy("i", "j")
    there = F.col("x").isNotNull() & shared
    return mesh.select(*[F.when(there, F.avg(c).over(node)).otherwise(F.col(c)).alias(c) if c in "xy" else F.col(c) for c in mesh.columns])


def identify_poles(mesh: DataFrame, shared: Column) -> DataFrame:
    """Nodes of a pole's row are one point: the mean over all sections if any node of the row is shared, else
    per section. The last column repeats the first; missing nodes stay missing."""
    last_j = F.max("j").over(W.partitionBy("h", "i"))
    rows = mesh.select("i").agg(F.max("i").alias("top"))
    d = mesh.crossJoin(F.broadcast(rows))  # one row
    pole = (F.col("i") == 0) | (F.col("i") == F.col("top"))
    row, own = W.partitionBy("i"), W.partitionBy("h", "i")
    d = d.withColumn("any_shared", F.max(shared).over(row))
    for c in "xy":
        d = d.withColumn(f"n{c}", F.when(pole & F.col("any_shared"), F.avg(c).over(row)).when(pole, F.avg(c).over(own)).otherwise(F.col(c)))
    d = d.withColumn("last", last_j)
    line = W.partitionBy("h", "i").orderBy("j")
    out = []
    for c in mesh.columns:
        if c in "xy":
            v = F.when(F.col("j") == F.col("last"), F.first(f"n{c}").over(line)).otherwise(F.col(f"n{c}"))
            out.append(F.when(F.col("x").isNotNull(), v).alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


def bounding_box(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or [])).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def center_of(polygons: DataFrame) -> DataFrame:
    """``h, lat, lon`` (radians) of the sample centre, of 25 by 48, whose farthest border vertex is nearest;
    centres whose antipode is inside don't count. Ties: first in row order. ``polygons`` in degrees."""
    from . import polygon

    spark = polygons.sparkSession
    sample = spark.range(25 * 48).select(F.col("id"), F.floor(F.col("id") / 48).alias("ci"), (F.col("id") % 48).alias("cj"))
    sample = sample.select("id", "ci", "cj", (F.col("ci") * 7.5 - 90.0).alias("clat"), (F.col("cj") * 7.5 - 180.0).alias("clon"))
    opposite = sample.select("id", (-F.col("clat")).alias("lat"), geo.wrap_angle(F.col("clon") + 180.0).alias("lon"))
    barred = polygon.inside_region(opposite, polygons, ["id"])
    # 1200 centres for each vertex of a section's border
    pair = polygons.select("h", F.radians("lat").alias("lat"), F.radians("lon").alias("lon")).distinct().crossJoin(F.broadcast(sample))
    far = pair.groupBy("h", "id", "ci", "cj", "clat", "clon").agg(F.max(geo.rotated_coordinates(F.radians("clat"), F.radians("clon"), "lat", "lon")["distance"]).alias("far"))
    far = far.join(barred, ["id", "h"]).where(~F.col("inside"))
    best = far.groupBy("h").agg(F.min(F.struct(F.round("far", 9).alias("far"), "ci", "cj", "clat", "clon")).alias("m"))
    return best.select("h", F.radians("m.clat").alias("lat"), F.radians("m.clon").alias("lon"))


def fit_in_rectangle(hulls: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rotation, dx, dy``: how to turn and shift each hull ``keys, seq, x, y`` into its smallest
    landscape rectangle about the origin; of equal ones the first edge's."""
    w = W.partitionBy(*keys).orderBy("seq")
    last = F.last(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    e = hulls.select(*keys, "seq", "x", "y", F.coalesce(F.lag(F.struct("x", "y")).over(w), last).alias("p"))
    angle = F.when(F.col("x") == F.col("p.x"), math.pi / 2).otherwise(F.atan(F.try_divide(F.col("y") - F.col("p.y"), F.col("x") - F.col("p.x"))))
    e = e.select(*keys, F.col("seq").alias("edge"), angle.alias("angle"))
    pair = e.join(hulls.select(*keys, "x", "y"), keys)  # a hull's edges by its own vertices
    turned = geo.rotate_and_shift("x", "y", -F.col("angle"))
    box = pair.withColumn("t", turned).groupBy(*keys, "edge", "angle").agg(F.min("t.x").alias("x0"), F.max("t.x").alias("x1"), F.min("t.y").alias("y0"), F.max("t.y").alias("y1"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = box.groupBy(*keys).agg(F.min(F.struct(F.round(area, 6).alias("area"), "edge", "angle", "x0", "x1", "y0", "y1")).alias("m")).select(*keys, "m.*")
    cx, cy, a = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("angle")
    tall = (F.col("x1") - F.col("x0")) < (F.col("y1") - F.col("y0"))
    # portrait boxes turn a quarter, against the sign of their angle
    s = F.when(a < 0, -1.0).otherwise(1.0)
    return best.select(*keys, F.when(tall, s * (math.pi / 2) - a).otherwise(-a).alias("rotation"), F.when(tall, s * cy).otherwise(-cx).alias("dx"), F.when(tall, -s * cx).otherwise(-cy).alias("dy"))
