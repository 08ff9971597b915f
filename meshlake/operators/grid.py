"""Meshes and masks on a uniform grid. A mesh has rows ``h, i, j, lat, lon, x, y``; absent nodes have null x and y.

Windows are partitioned by section and row or column, so they spread over the grid's lines; corners of a
cell are packed beside its south-west node, so that lookups are one equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cell_corners(mesh: DataFrame) -> DataFrame:
    """A row per cell ``h, i, j`` with its node structs ``sw, se, nw, ne`` and the ``lat, lon`` of sw.
    The mesh is dense: absent nodes have rows."""
    at = F.struct("x", "y")
    row, column = W.partitionBy("h", "i").orderBy("j"), W.partitionBy("h", "j").orderBy("i")
    d = mesh.select("h", "i", "j", "lat", "lon", at.alias("sw"), F.lead(at).over(row).alias("se"))
    d = d.select("*", F.lead("sw").over(column).alias("nw"), F.lead("se").over(column).alias("ne"), F.lead("i").over(column).alias("up"))
    return d.where("se is not null and up is not null").drop("up")


def axis(spark, n: int, low: float, high: float, name: str) -> DataFrame:
    """``index, name``: n + 1 even steps from low to high."""
    return spark.range(n + 1).select(F.col("id").cast("int").alias("index"), (F.col("id") * ((high - low) / n) + low).alias(name))


def bin_centers(edges: DataFrame, value: str) -> DataFrame:
    """``index`` and centre of each pair of neighbouring edges."""
    nxt = F.lead(value).over(W.orderBy("index"))  # one axis, as long as a grid's side
    return edges.select("index", ((F.col(value) + nxt) / 2).alias(value), nxt.alias("n")).where("n is not null").drop("n")


def bin_index(x: Column, low: float, step: float, bins: int, right: bool = False) -> Column:
    """Bin on a uniform axis: from its lower edge up, or with ``right`` up to its upper edge; below the axis
    -1, from the last edge on the last bin."""
    t = (x - low) / step
    k = (F.ceil(t) - 1) if right else F.floor(t)
    return F.when(x >= low + step * bins, bins - 1).otherwise(F.greatest(k, F.lit(-1))).cast("int")


def fractional_index(x: Column, low: float, step: float, n: int) -> Column:
    return F.least(F.greatest((x - low) / step, F.lit(0.0)), F.lit(float(n - 1)))


def dilate(rows: DataFrame, keys: list[str], order: str, flag: str, distance: int) -> DataFrame:
    """Each flag becomes whether one within ``distance`` rows is set."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-distance, distance)
    return rows.withColumn(flag, F.max(F.col(flag)).over(w))


def expand(cells: DataFrame, keys: list[str], columns: int, periodic: bool = False) -> DataFrame:
    """``keys, i, j`` of nodes that a marked cell ``i, j`` touches; ``columns``: cells in a row."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("c")
    nodes = cells.select(*keys, "i", "j", corner).select(*keys, (F.col("i") + F.col("c.a")).alias("i"), (F.col("j") + F.col("c.b")).alias("j"))
    if periodic:
        twin = F.when(F.col("j") == 0, columns).when(F.col("j") == columns, 0)
        nodes = nodes.select(*keys, "i", F.explode(F.array_compact(F.array(F.col("j"), twin))).alias("j"))
    return nodes.distinct()


def downsample(raster: DataFrame, keys: list[str], full: tuple[int, int], small: tuple[int, int], value: str) -> DataFrame:
    """Mean over the pixels whose nearest coarse index is the same."""
    i, j = F.floor(F.col("i") / F.lit(float(full[0])) * small[0]).cast("int"), F.floor(F.col("j") / F.lit(float(full[1])) * small[1]).cast("int")
    return raster.groupBy(*keys, i.alias("i"), j.alias("j")).agg(F.avg(value).alias(value))


def gradient(rows: DataFrame, keys: list[str], order: str, y: str, x: str, out: str) -> DataFrame:
    """Derivative along lines ``keys`` ordered by ``order``: centred where both neighbours are there, else of
    second order on the side that has two, else of first order, else null. Null y marks absent nodes."""
    w = W.partitionBy(*keys).orderBy(order)
    y0, x0 = F.col(y), F.col(x)
    p1, p2, n1, n2 = F.lag(y, 1).over(w), F.lag(y, 2).over(w), F.lead(y, 1).over(w), F.lead(y, 2).over(w)
    xp1, xp2, xn1, xn2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w), F.lead(x, 1).over(w), F.lead(x, 2).over(w)
    d = (
        F.when(y0.isNull(), None)
        .when(p1.isNotNull() & n1.isNotNull(), (n1 - p1) / (xn1 - xp1))
        .when(p1.isNotNull() & p2.isNotNull(), (3 * y0 - 4 * p1 + p2) / (x0 - xp2))
        .when(n1.isNotNull() & n2.isNotNull(), (3 * y0 - 4 * n1 + n2) / (x0 - xn2))
        .when(p1.isNotNull(), (y0 - p1) / (x0 - xp1))
        .when(n1.isNotNull(), (n1 - y0) / (xn1 - x0))
    )
    return rows.withColumn(out, d)


def nearest_defined(rows: DataFrame, keys: list[str], order: str, defined: Column, forward: bool, prefix: str) -> DataFrame:
    """The nearest row at or after (before) each one that is defined: its ``order`` value and how far it is."""
    w = W.partitionBy(*keys).orderBy(order)
    w = w.rowsBetween(0, W.unboundedFollowing) if forward else w.rowsBetween(W.unboundedPreceding, 0)
    ref = (F.first if forward else F.last)(F.when(defined, F.col(order)), ignorenulls=True).over(w)
    return rows.withColumn(f"{prefix}_ref", ref).withColumn(f"{prefix}_distance", F.abs(F.col(f"{prefix}_ref") - F.col(order)))


def search_order(cells: DataFrame, i0: Column, j0: Column, rows: int, columns: int, most: float) -> DataFrame:
    """Cells ``i, j`` within ``most`` of (i0, j0), with their distance: rows apart plus wrapped columns apart,
    these shortened by the sine of the row's colatitude."""
    dj = F.abs(F.col("j") - j0)
    d = F.abs(F.col("i") - i0) + F.least(dj, columns - dj) * F.sin(F.col("i") / F.lit(rows - 1.0) * F.pi())
    return cells.withColumn("distance", d).where(F.col("distance") <= most)


def histogram2d(rows: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, bins: int, weight: Column) -> DataFrame:
    """Sums of weights per square bin; the last bin holds its upper edge, values outside drop."""
    step = (high - low) / bins

    def at(c: str) -> Column:
        return F.least(F.floor((F.col(c) - low) / step), F.lit(bins - 1)).cast("int")

    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    return rows.where(inside).groupBy(*keys, at(x).alias("bin_x"), at(y).alias("bin_y")).agg(F.sum(weight).alias("weight"))
