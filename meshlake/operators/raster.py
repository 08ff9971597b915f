"""Cells of a uniform grid that polylines touch.

Axis 0 is latitude (not periodic), axis 1 longitude (periodic). Paths are rows ``h, seq, lat, lon``; masks
are rows ``h, i, j``. ``n`` rows of cells of ``180 / n`` degrees, twice as many columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from . import grid, polygon

#: Fixed value: the margin around a section, in degrees.
MARGIN = 1.0


def _settled(df: DataFrame) -> DataFrame:
    """The same rows with their columns computed once: later steps would else repeat their expressions."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def _segments(paths: DataFrame) -> DataFrame:
    w = W.partitionBy("h").orderBy("seq")
    s = paths.select("h", "seq", F.lag("lat").over(w).alias("x0"), F.lag("lon").over(w).alias("y0"), F.col("lat").alias("x1"), F.col("lon").alias("y1"))
    return s.where("x0 is not null")


def _crossings(s: DataFrame, along: tuple[float, float, int, bool], across: tuple[float, float, int, bool]) -> DataFrame:
    """``h, line, bin``: grid lines of the first axis that segments ``a0, b0, a1, b1`` cross, and the bin of the
    second where they do. An axis: low end, step, bins, periodic. On a periodic axis a step of more than half
    the period goes the other way round, so it is shifted before and after."""
    (low, step, n, _), (low2, step2, n2, _) = along, across
    for axis, (lo, st, bins, periodic) in (("a", along), ("b", across)):
        if periodic:
            far = F.abs(F.col(f"{axis}1") - F.col(f"{axis}0")) > 180
            shift = F.when(far, grid.bin_index(F.greatest(f"{axis}0", f"{axis}1"), lo, st, bins)).otherwise(0)
            s = s.withColumn(f"shift_{axis}", shift)
            s = s.select("*", *[F.when(far, geo.wrap_angle(F.col(f"{axis}{k}") - st * F.col(f"shift_{axis}"))).otherwise(F.col(f"{axis}{k}")).alias(f"m{axis}{k}") for k in (0, 1)])
        else:
            s = s.select("*", F.lit(0).alias(f"shift_{axis}"), F.col(f"{axis}0").alias(f"m{axis}0"), F.col(f"{axis}1").alias(f"m{axis}1"))
    s = _settled(s)
    flip = F.col("ma1") < F.col("ma0")
    s = s.select("h", "shift_a", "shift_b", *[F.when(flip, F.col(f"m{a}{1 - k}")).otherwise(F.col(f"m{a}{k}")).alias(f"m{a}{k}") for a in "ab" for k in (0, 1)])
    s = _settled(s).where("ma1 > ma0")
    first, last = grid.bin_index(F.col("ma0"), low, step, n) + 1, grid.bin_index(F.col("ma1"), low, step, n, right=True)
    s = _settled(s.withColumn("first", first).withColumn("last", last)).where("last >= first").withColumn("line", F.explode(F.sequence("first", "last")))
    at = geo.interp(F.col("line") * step + low, "ma0", "ma1", "mb0", "mb1")
    s = s.withColumn("bin", grid.bin_index(at, low2, step2, n2))
    # a periodic axis of n bins has n + 1 lines, and counts round by them
    line = F.pmod(F.col("line") + F.col("shift_a"), F.lit(n + 1)) if along[3] else F.col("line")
    other = F.pmod(F.col("bin") + F.col("shift_b"), F.lit(n2 + 1)) if across[3] else F.col("bin")
    return s.select("h", line.cast("int").alias("line"), other.cast("int").alias("bin"))


def _on_edge(x: Column, low: float, step: float) -> Column:
    t = (x - low) / step
    return F.abs(t - F.round(t)) < 1e-9


def cells_touched_by(paths: DataFrame, n: int, radius: float = 0.0) -> DataFrame:
    """``h, i, j`` of cells that a path of the given half width crosses; touching at an edge doesn't count."""
    step = 180.0 / n
    rows, columns = (-90.0, step, n, False), (-180.0, step, 2 * n, True)
    s = _segments(paths)
    out = []
    offsets = F.explode(F.array(F.lit(-radius), F.lit(radius))).alias("d") if radius else F.lit(0.0).alias("d")
    up = s.where("x0 <> x1").select("h", offsets, "x0", "y0", "x1", "y1").select("h", F.col("x0").alias("a0"), (F.col("y0") + F.col("d")).alias("b0"), F.col("x1").alias("a1"), (F.col("y1") + F.col("d")).alias("b1"))
    c = _crossings(up, rows, columns)
    for k in (0, 1):
        out.append(c.select("h", F.pmod(F.col("line") - k, F.lit(n)).alias("i"), F.pmod("bin", F.lit(2 * n)).alias("j")))
    over = s.where("y0 <> y1").select("h", offsets, "x0", "y0", "x1", "y1").select("h", F.col("y0").alias("a0"), (F.col("x0") + F.col("d")).alias("b0"), F.col("y1").alias("a1"), (F.col("x1") + F.col("d")).alias("b1"))
    c = _crossings(over, columns, rows).where(F.col("bin").between(0, n - 1))
    for k in (0, 1):
        out.append(c.select("h", F.col("bin").alias("i"), F.pmod(F.col("line") - k, F.lit(2 * n)).alias("j")))
    inner = paths.where(~(_on_edge(F.col("lat"), -90.0, step) | _on_edge(F.col("lon"), -180.0, step)))
    out.append(inner.select("h", grid.bin_index(F.col("lat"), -90.0, step, n).alias("i"), grid.bin_index(F.col("lon"), -180.0, step, 2 * n).alias("j")))
    if radius:
        w, whole = W.partitionBy("h").orderBy("seq"), W.partitionBy("h").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        here = F.struct("lat", "lon")
        closed = F.first(here).over(whole) == F.last(here).over(whole)
        last = F.max("seq").over(W.partitionBy("h"))
        b = paths.select("h", "seq", "lat", "lon", F.lag(here).over(w).alias("a"), F.lead(here).over(w).alias("c"), closed.alias("closed"), (F.col("seq") == last).alias("end"), F.nth_value(here, 2).over(whole).alias("second"))
        b = b.withColumn("c", F.when(F.col("end") & F.col("closed"), F.col("second")).otherwise(F.col("c"))).where("a is not null and c is not null")
        b = _settled(b.select("h", geo.offset_from_angle(("a.lat", "a.lon"), ("lat", "lon"), ("c.lat", "c.lon"), radius).alias("o")))
        i, j = grid.bin_index(F.col("o.x"), -90.0, step, n), grid.bin_index(F.col("o.y"), -180.0, step, 2 * n)
        out.append(_settled(b.select("h", i.alias("i"), F.pmod(j, F.lit(2 * n)).alias("j"))).where(F.col("i").between(0, n - 1)))
    out = [_settled(o) for o in out]
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.select("h", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).distinct()


def cells_approached_by(paths: DataFrame, n: int) -> DataFrame:
    """``h, i, j`` of cells beside and behind a path's end that lies on a grid line."""
    step = 180.0 / n
    w = W.partitionBy("h").orderBy("seq")
    here = F.struct("lat", "lon")
    d = paths.select("h", "lat", "lon", F.lag(here).over(w).alias("p"), F.lead(here).over(w).alias("q"))
    d = d.where("p is null or q is null").withColumn("q", F.coalesce("p", "q")).withColumn("d", F.explode(F.array(F.lit(-step), F.lit(step))))
    x, y, px, py, off = F.col("lat"), F.col("lon"), F.col("q.lat"), F.col("q.lon"), F.col("d")

    def ahead(v: Column, pv: Column, low: float, bins: int) -> Column:
        return F.when(pv < v, grid.bin_index(v, low, step, bins, right=True)).otherwise(grid.bin_index(v, low, step, bins))

    one = d.where(_on_edge(x, -90.0, step) & (px != x)).select("h", ahead(x, px, -90.0, n).alias("i"), grid.bin_index(y + off, -180.0, step, 2 * n).alias("j"))
    two = d.where(_on_edge(y, -180.0, step) & (py != y)).select("h", grid.bin_index(x + off, -90.0, step, n).alias("i"), ahead(y, py, -180.0, 2 * n).alias("j"))
    return one.unionByName(two).select("h", F.pmod("i", F.lit(n)).cast("int").alias("i"), F.pmod("j", F.lit(2 * n)).cast("int").alias("j")).distinct()


def cell_centers(spark, n: int) -> DataFrame:
    step = 180.0 / n
    c = spark.range(2 * n * n).select(F.floor(F.col("id") / (2 * n)).cast("int").alias("i"), (F.col("id") % (2 * n)).cast("int").alias("j"))
    return c.select("i", "j", ((F.col("i") + 0.5) * step - 90.0).alias("lat"), ((F.col("j") + 0.5) * step - 180.0).alias("lon"))


def cells_inside_of(borders: DataFrame, n: int) -> DataFrame:
    """Touched by the border, a margin wide, or with the centre inside."""
    centers = cell_centers(borders.sparkSession, n).withColumn("key", F.struct("i", "j"))
    inside = polygon.inside_region(centers.select("key", "lat", "lon"), borders, ["key"]).where("inside").select("h", "key.i", "key.j")
    return cells_touched_by(borders, n, MARGIN).unionByName(inside).distinct()


def cells_shared_by(glue: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    """Touched by the glue border, and neither touched nor approached by the cut border."""
    out = cells_touched_by(glue, n, MARGIN)
    for other in (cells_touched_by(cut, n), cells_approached_by(cut, n)):
        out = out.join(other, ["h", "i", "j"], "left_anti")
    return out


def trim_to_grid(paths: DataFrame, n: int) -> DataFrame:
    """Paths cut where they first enter the cell they end in, unless they end on a grid line."""
    step = 180.0 / n
    w = W.partitionBy("h").orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    i, j = grid.bin_index(F.col("lat"), -90.0, step, n, right=True), grid.bin_index(F.col("lon"), -180.0, step, 2 * n, right=True)
    d = paths.select("h", "seq", "lat", "lon", i.alias("i"), j.alias("j"), F.lag("lat").over(w).alias("px"), F.lag("lon").over(w).alias("py"))
    d = d.withColumn("fi", F.last("i").over(whole)).withColumn("fj", F.last("j").over(whole))
    d = d.withColumn("ready", F.last(_on_edge(F.col("lat"), -90.0, step) | _on_edge(F.col("lon"), -180.0, step)).over(whole))
    d = d.withColumn("cut", F.min(F.when((F.col("i") == F.col("fi")) & (F.col("j") == F.col("fj")), F.col("seq"))).over(W.partitionBy("h")))
    d = d.where("ready or seq <= cut")
    # of the cell's four sides, that which the segment meets first on its way in, seen from inside
    x0, x1 = F.col("fi") * step - 90.0, (F.col("fi") + 1) * step - 90.0
    y0, y1 = F.col("fj") * step - 180.0, (F.col("fj") + 1) * step - 180.0

    def enter(p: Column, q: Column, low: Column, high: Column) -> Column:
        return F.when(p < low, F.try_divide(low - p, q - p)).when(p > high, F.try_divide(high - p, q - p)).otherwise(F.lit(0.0))

    t = F.greatest(enter(F.col("px"), F.col("lat"), x0, x1), enter(F.col("py"), F.col("lon"), y0, y1))
    last = ~F.col("ready") & (F.col("seq") == F.col("cut")) & F.col("px").isNotNull()
    return d.select("h", "seq", F.when(last, F.col("px") + t * (F.col("lat") - F.col("px"))).otherwise(F.col("lat")).alias("lat"), F.when(last, F.col("py") + t * (F.col("lon") - F.col("py"))).otherwise(F.col("lon")).alias("lon"))
