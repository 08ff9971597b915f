"""Forward and inverse projection through a mesh ``h, i, j, lat, lon, x, y``.

Meshes have one row per node of a fixed grid; points may be many. A point's cell is computed from its
coordinates, so each lookup is an equi-join on the cell. Mesh tables are broadcast only below
``MESH_LIMIT`` rows, which is checked; beyond that the join shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import grid

MESH_LIMIT = 2_000_000


def small(df: DataFrame, limit: int = MESH_LIMIT) -> DataFrame:
    """The table with a broadcast hint if it has no more rows than the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def locate(points: DataFrame, rows: int, columns: int, clamp: bool = True) -> DataFrame:
    """With the cell ``i, j`` and the fractions ``u, v`` in it; out of range: the nearest edge (``clamp``), else
    the edge cell with fractions beyond it."""
    fi, fj = (F.col("lat") + 90.0) / (180.0 / (rows - 1)), (F.col("lon") + 180.0) / (360.0 / (columns - 1))
    if clamp:
        fi, fj = F.least(F.greatest(fi, F.lit(0.0)), F.lit(rows - 1.0)), F.least(F.greatest(fj, F.lit(0.0)), F.lit(columns - 1.0))
    i, j = F.least(F.greatest(F.floor(fi), F.lit(0)), F.lit(rows - 2)).cast("int"), F.least(F.greatest(F.floor(fj), F.lit(0)), F.lit(columns - 2)).cast("int")
    return points.select("*", i.alias("i"), j.alias("j"), (fi - i).alias("u"), (fj - j).alias("v"))


def project_bilinear(points: DataFrame, mesh: DataFrame, rows: int, columns: int, clamp: bool = True, fill: float | None = None) -> DataFrame:
    """Points ``..., section, lat, lon`` with ``x, y``: null where a corner is missing (or ``fill``)."""
    cells = grid.cell_corners(mesh).select(F.col("h").alias("section"), "i", "j", "sw", "se", "nw", "ne")
    d = locate(points, rows, columns, clamp).join(small(cells), ["section", "i", "j"], "left")
    out = {c: geo.bilinear("u", "v", *[F.col(f"{k}.{c}") for k in ("sw", "se", "nw", "ne")]) for c in "xy"}
    if fill is not None:
        out = {c: F.coalesce(v, F.lit(fill)) for c, v in out.items()}
    return d.select(*points.columns, *[v.alias(c) for c, v in out.items()])


def with_gradients(mesh: DataFrame) -> DataFrame:
    """With ``x_lat, y_lat, x_lon, y_lon``; at nodes that two sections share (equal in sections h and h-1) the
    mean over all sections, so that seams are smooth."""
    from pyspark.sql import Window as W

    d = mesh
    for c in "xy":
        d = grid.gradient(d, ["h", "j"], "i", c, "lat", f"{c}_lat")
        d = grid.gradient(d, ["h", "i"], "j", c, "lon", f"{c}_lon")
    node = W.partitionBy("i", "j")
    here = F.struct("x", "y")
    before = F.coalesce(F.lag(here).over(node.orderBy("h")), F.last(here).over(node.orderBy("h").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    d = d.withColumn("same", (F.col("x").isNotNull() & (here == before)))
    d = d.withColumn("shared", F.max("same").over(node))
    names = ["x_lat", "y_lat", "x_lon", "y_lon"]
    blended = [F.when(F.col("shared"), F.avg(c).over(node)).otherwise(F.col(c)).alias(c) for c in names]
    return d.select(*mesh.columns, *blended)


def project_hermite(points: DataFrame, mesh: DataFrame, rows: int, columns: int, differentiate: int | None = None) -> DataFrame:
    """Points ``..., section, lat, lon`` with ``x, y`` by cubic interpolation of values and both derivatives
    (without the mixed one); with ``differentiate`` their derivatives by latitude (0) or longitude (1), in degrees."""
    from pyspark.sql import Window as W

    node = F.struct("x", "y", "x_lat", "y_lat", "x_lon", "y_lon")
    row, column = W.partitionBy("h", "i").orderBy("j"), W.partitionBy("h", "j").orderBy("i")
    c = with_gradients(mesh).select(F.col("h"), "i", "j", node.alias("sw"), F.lead(node).over(row).alias("se"))
    c = c.select(F.col("h").alias("section"), "i", "j", "sw", "se", F.lead("sw").over(column).alias("nw"), F.lead("se").over(column).alias("ne"))
    d = locate(points, rows, columns).join(small(c), ["section", "i", "j"], "left")
    dlat, dlon = 180.0 / (rows - 1), 360.0 / (columns - 1)
    u, v = F.col("u"), F.col("v")

    def weights(t: Column, step: float, axis: int) -> tuple:
        if axis == differentiate:
            return (6 * t * t - 6 * t) / step, (6 * t - 6 * t * t) / step, (3 * t * t - 4 * t + 1) / step, (3 * t * t - 2 * t) / step
        return 2 * t * t * t - 3 * t * t + 1, 3 * t * t - 2 * t * t * t, t * t * t - 2 * t * t + t, t * t * t - t * t

    a0, a1, s0, s1 = weights(u, dlat, 0)
    b0, b1, t0, t1 = weights(v, dlon, 1)

    def value(c: str) -> Column:
        corner = {("0", "0"): "sw", ("0", "1"): "se", ("1", "0"): "nw", ("1", "1"): "ne"}
        out = F.lit(0.0)
        for (p, q), k in corner.items():
            a, s = (a0, s0) if p == "0" else (a1, s1)
            b, t = (b0, t0) if q == "0" else (b1, t1)
            out = out + a * b * F.col(f"{k}.{c}") + s * dlat * b * F.col(f"{k}.{c}_lat") + a * t * dlon * F.col(f"{k}.{c}_lon")
        return out

    return d.select(*points.columns, value("x").alias("x"), value("y").alias("y"))


def bilinear_weights(points: DataFrame, rows: int, columns: int) -> DataFrame:
    """``id, h, i, j, weight``: the projection of points ``id, section, lat, lon`` as weights of nodes, so that a
    sum over nodes projects them for any positions."""
    d = locate(points, rows, columns)
    u, v = F.col("u"), F.col("v")
    corner = [(0, 0, (1 - u) * (1 - v)), (0, 1, (1 - u) * v), (1, 0, u * (1 - v)), (1, 1, u * v)]
    w = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), c.alias("weight")) for a, b, c in corner])).alias("w")
    return d.select("id", F.col("section").alias("h"), w).select("id", "h", "w.*")


def apply_weights(weights: DataFrame, mesh: DataFrame) -> DataFrame:
    """``id, x, y``; null where a node with a weight is missing."""
    d = weights.where("weight <> 0").join(small(mesh.select("h", "i", "j", "x", "y")), ["h", "i", "j"], "left")
    gone = F.max(F.col("x").isNull())
    return d.groupBy("id").agg(*[F.when(~gone, F.sum(F.col(c) * F.col("weight"))).alias(c) for c in "xy"])


#: Fixed value: how far from the nearest node a containing cell is looked for, in cells.
REACH = 6
#: How far outside a cell's edge, in fractions of it, rounding may put a point.
SLACK = 1e-9


def invert_cells(rows: DataFrame, dlat: float, dlon: float) -> DataFrame:
    """Rows ``..., x, y, sw, se, nw, ne, clat, clon`` with ``lat, lon``, whose bilinear image in the cell is (x, y).

    The row fraction solves a quadratic, of whose roots one in (0, 1) is preferred, then one in [0, 1]; a
    parallelogram has a linear equation. Null outside. Each step is a column of its own, since nested
    expressions would repeat the roots many times over."""
    c = F.col

    def cross(px: Column, py: Column, qx: Column, qy: Column) -> Column:
        return px * qy - py * qx

    def step(d: DataFrame, **new: Column) -> DataFrame:
        return d.select("*", *[v.alias(f"_{k}") for k, v in new.items()])

    # a point at row fraction t lies on the line from sw + t (nw - sw) to se + t (ne - se)
    d = step(
        rows, lx=c("nw.x") - c("sw.x"), ly=c("nw.y") - c("sw.y"), ex=c("se.x") - c("sw.x"), ey=c("se.y") - c("sw.y"), px=c("x") - c("sw.x"), py=c("y") - c("sw.y"),
        rx=c("ne.x") - c("se.x") - c("nw.x") + c("sw.x"), ry=c("ne.y") - c("se.y") - c("nw.y") + c("sw.y"),
    )
    k = {n: c(f"_{n}") for n in ("lx", "ly", "ex", "ey", "px", "py", "rx", "ry")}
    d = step(d, a=cross(k["rx"], k["ry"], -k["lx"], -k["ly"]), b=cross(k["rx"], k["ry"], k["px"], k["py"]) + cross(k["ex"], k["ey"], -k["lx"], -k["ly"]), c=cross(k["ex"], k["ey"], k["px"], k["py"]))
    under = c("_b") * c("_b") - 4 * c("_a") * c("_c")
    d = step(d, root=F.sqrt(F.greatest(under, F.lit(0.0))), real=under >= -SLACK * c("_b") * c("_b"), flat=F.abs("_a") <= 1e-12 * (F.abs("_b") + F.abs("_c")))
    line = F.try_divide(-c("_c"), c("_b"))
    d = step(d, one=F.when(c("_flat"), line).when(c("_real"), F.try_divide(-c("_b") + c("_root"), 2 * c("_a"))), two=F.when(c("_flat"), line).when(c("_real"), F.try_divide(-c("_b") - c("_root"), 2 * c("_a"))))
    one, two = c("_one"), c("_two")
    d = step(d, t=F.when((one > 0) & (one < 1), one).when((two > 0) & (two < 1), two).when(one.between(-SLACK, 1 + SLACK), one).when(two.between(-SLACK, 1 + SLACK), two))
    d = step(d, wx=k["ex"] + c("_t") * k["rx"], wy=k["ey"] + c("_t") * k["ry"])
    s = F.when(F.abs("_wx") >= F.abs("_wy"), F.try_divide(k["px"] - c("_t") * k["lx"], c("_wx"))).otherwise(F.try_divide(k["py"] - c("_t") * k["ly"], c("_wy")))
    d = step(d, s=s)
    ok = c("_s").between(-SLACK, 1 + SLACK)
    return d.select(*rows.columns, F.when(ok, c("clat") + c("_t") * dlat).alias("lat"), F.when(ok, c("clon") + c("_s") * dlon).alias("lon"))


#: Bins of the raster that nodes are dealt to, along each axis.
NEAR_BINS = 48


def nearest_nodes(targets: DataFrame, mesh: DataFrame, bins: int = NEAR_BINS) -> DataFrame:
    """``id, x, y, h, i, j, d2``: of each section the nearest node to each target ``id, x, y``; the first in row
    order on ties. A raster over the mesh's box lists, per bin and section, the nodes that can be nearest to a place in
    the bin: no nearer end of a node's distances from the bin lies beyond the least of the farther ends. That table is made
    from the mesh alone; targets look up their bin by an equi-join. Targets outside the box meet all nodes."""
    nodes = mesh.where("x is not null").select("h", "i", "j", F.col("x").alias("nx"), F.col("y").alias("ny"))
    box = nodes.agg(F.min("nx").alias("x0"), F.max("nx").alias("x1"), F.min("ny").alias("y0"), F.max("ny").alias("y1")).first()
    t = targets.select("id", "x", "y")
    d2 = F.pow(F.col("x") - F.col("nx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ny"), F.lit(2.0))
    near = F.min(F.struct(d2.alias("d2"), "i", "j")).alias("m")
    if box.x0 is None or box.x0 == box.x1 or box.y0 == box.y1:
        pairs = t.crossJoin(small(nodes))
    else:
        dx, dy = (box.x1 - box.x0) / bins, (box.y1 - box.y0) / bins
        bx, by = F.least(F.floor((F.col("x") - box.x0) / dx), F.lit(bins - 1)), F.least(F.floor((F.col("y") - box.y0) / dy), F.lit(bins - 1))
        inside = F.col("x").between(box.x0, box.x1) & F.col("y").between(box.y0, box.y1)
        raster = mesh.sparkSession.range(bins * bins).select(F.floor(F.col("id") / bins).alias("bx"), (F.col("id") % bins).alias("by"))
        cx, cy = box.x0 + (F.col("bx") + 0.5) * dx, box.y0 + (F.col("by") + 0.5) * dy
        ax, ay = F.abs(F.col("nx") - cx), F.abs(F.col("ny") - cy)
        # a bin is taken a little larger, so that rounding at its edge loses nothing
        hx, hy = dx * (0.5 + 1e-6), dy * (0.5 + 1e-6)
        least = F.pow(F.greatest(ax - hx, F.lit(0.0)), F.lit(2.0)) + F.pow(F.greatest(ay - hy, F.lit(0.0)), F.lit(2.0))
        most = F.pow(ax + hx, F.lit(2.0)) + F.pow(ay + hy, F.lit(2.0))
        reach = raster.crossJoin(small(nodes)).select("bx", "by", "h", "i", "j", "nx", "ny", least.alias("least"), most.alias("most"))  # of the mesh's size
        bound = reach.groupBy("bx", "by", "h").agg(F.min("most").alias("bound"))
        listed = reach.join(bound, ["bx", "by", "h"]).where(F.col("least") <= F.col("bound")).select("bx", "by", "h", "i", "j", "nx", "ny")
        pairs = t.where(inside).select("id", "x", "y", bx.alias("bx"), by.alias("by")).join(small(listed), ["bx", "by"]).drop("bx", "by")
        pairs = pairs.select("id", "x", "y", "h", "i", "j", "nx", "ny").unionByName(t.where(~inside).crossJoin(small(nodes)))
    best = pairs.groupBy("id", "x", "y", "h").agg(near)
    return best.select("id", "x", "y", "h", "m.i", "m.j", "m.d2")


def inverse_project(targets: DataFrame, mesh: DataFrame, polygons: DataFrame, rows: int, columns: int, bins: tuple | None = None) -> DataFrame:
    """``id, lat, lon`` of planar targets ``id, x, y``: in each section the containing cell nearest to the nearest
    node inverts exactly; else that node, kept off the mesh's edge, stands in. The closest section counts,
    unless an exact one contains the result. ``bins``: ``(x0, dx, nx, y0, dy, ny)`` of a raster whose points
    are nowhere near a node and become null."""
    from . import polygon

    near = nearest_nodes(targets, mesh)
    node = mesh.select("h", "i", "j", "lat", "lon", F.col("x").isNotNull().alias("there"))
    side = {(-1, 0): "s", (1, 0): "n", (0, -1): "w", (0, 1): "e"}
    guess = near.join(small(node.drop("there")), ["h", "i", "j"])
    for (di, dj), k in side.items():
        beside = node.where("there").select("h", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(True).alias(k))
        guess = guess.join(small(beside), ["h", "i", "j"], "left")
    up = F.when(F.col("s").isNull(), 0.1).when(F.col("n").isNull(), -0.1).otherwise(0.0)
    over = F.when(F.col("w").isNull(), 0.1).when(F.col("e").isNull(), -0.1).otherwise(0.0)
    guess = guess.select("id", "x", "y", "h", "i", "j", "d2", (F.col("lat") + up).alias("glat"), (F.col("lon") + over).alias("glon"))
    cells = grid.cell_corners(mesh).where("sw.x is not null and se.x is not null and nw.x is not null and ne.x is not null")
    cells = cells.select("h", F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), "sw", "se", "nw", "ne")
    # only cells of rows within reach
    around = guess.withColumn("ci", F.explode(F.sequence(F.col("i") - REACH, F.col("i") + REACH)))
    pair = around.join(small(cells), ["h", "ci"])
    dj = F.abs(F.col("cj") - F.col("j"))
    dist = F.abs(F.col("ci") - F.col("i")) + F.least(dj, (columns - 1) - dj) * F.sin(F.col("ci") / F.lit(rows - 2.0) * F.pi())
    ring = [("ne", "nw"), ("nw", "sw"), ("sw", "se"), ("se", "ne")]
    inside = F.lit(True)
    for a, b in ring:
        inside = inside & ((F.col("x") - F.col(f"{a}.x")) * (F.col("y") - F.col(f"{b}.y")) - (F.col("x") - F.col(f"{b}.x")) * (F.col("y") - F.col(f"{a}.y")) >= 0)
    hit = pair.withColumn("dist", dist).where((F.col("dist") <= REACH) & inside)
    # the nearest containing cell is chosen first, so one is inverted for each target and section
    first = hit.groupBy("id", "h").agg(F.min(F.struct("dist", "ci", "cj")).alias("m")).select("id", "h", "m.ci", "m.cj")
    best = invert_cells(hit.join(first, ["id", "h", "ci", "cj"]), 180.0 / (rows - 1), 360.0 / (columns - 1)).select("id", "h", F.struct("lat", "lon").alias("e"))
    d = guess.join(best, ["id", "h"], "left").select(
        "id", "h", F.when(F.col("e.lat").isNotNull(), 0.0).otherwise(F.col("d2")).alias("closeness"), F.coalesce("e.lat", "glat").alias("lat"), F.coalesce("e.lon", "glon").alias("lon"), F.col("e.lat").isNotNull().alias("exact")
    )
    point = d.select(F.struct("id", "h").alias("key"), "lat", "lon", F.col("h").alias("own"))
    within = polygon.inside_region(point, polygons, ["key"]).where("inside and h = key.h").select("key.id", "key.h", F.lit(True).alias("within"))
    d = d.join(within, ["id", "h"], "left")
    out = d.groupBy("id").agg(F.max(F.when(F.col("exact") & F.col("within"), F.struct("h", "lat", "lon"))).alias("own"), F.min(F.struct("closeness", "h", "lat", "lon")).alias("near"))
    out = out.select("id", F.coalesce("own.lat", "near.lat").alias("lat"), F.coalesce("own.lon", "near.lon").alias("lon"))
    if bins is None:
        return out
    used = used_bins(mesh, *bins)
    x0, dx, _, y0, dy, _ = bins
    at = targets.select("id", F.round((F.col("x") - x0) / dx).cast("int").alias("i"), F.round((F.col("y") - y0) / dy).cast("int").alias("j"))
    near_mesh = at.join(small(used), ["i", "j"], "left_semi").select("id", F.lit(True).alias("used"))
    out = out.join(near_mesh, "id", "left")
    return out.select("id", F.when(F.col("used"), F.col("lat")).alias("lat"), F.when(F.col("used"), F.col("lon")).alias("lon"))


def occupancy(mesh: DataFrame, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int) -> DataFrame:
    """``i, j, n``: nodes per raster bin; the last bin of an axis holds its edge."""
    def at(c: str, low: float, step: float, n: int) -> Column:
        return F.least(F.floor((F.col(c) - low) / step), F.lit(n - 1)).cast("int")

    inside = F.col("x").between(x0, x0 + dx * nx) & F.col("y").between(y0, y0 + dy * ny)
    return mesh.where(inside).groupBy(at("x", x0, dx, nx).alias("i"), at("y", y0, dy, ny).alias("j")).agg(F.count("*").alias("n"))


def used_bins(mesh: DataFrame, *bins) -> DataFrame:
    return grid.expand(occupancy(mesh, *bins).select("i", "j"), [], bins[5])
