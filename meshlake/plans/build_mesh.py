"""Building an interrupted mesh from a cut file: sections, masks, conformal coordinates, blended seams.

Cut files have tens of lines; the polygons they make are tables of as many rows. Masks and nodes are tables
of a grid's size, made for all sections in one plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..operators import cells, grid, paths, raster
from ..sources import resources

Point = tuple[float, float]
#: Vertices of a cut file that are put together on the driver.
CUT_LIMIT = 1_000_000


def path_through(start: Point, middle: Point, end: Point) -> list[Point]:
    """The seam from one cut to the next: by way of a plain point along its meridian, or round a pole
    clockwise, with a break at the antimeridian."""
    if abs(middle[0]) < 90:
        return [start, (start[0], middle[1]), middle, (end[0], middle[1]), end]
    pole = math.copysign(90, middle[0])
    sign = math.copysign(1, middle[0])
    out = [start, (pole, start[1])]
    if math.copysign(1, start[1] - end[1]) != sign or start[1] == end[1]:
        out += [(pole, -sign * 180), (pole, sign * 180)]
    out += [(pole, end[1]), end]
    clear = [out[0]]
    for p in out[1:]:
        step = abs(p[1] - clear[-1][1])
        if step > 180 and step != 360:
            clear.append((pole, 0.0))
        if p != clear[-1]:
            clear.append(p)
    return clear


def section_borders(cuts: DataFrame) -> DataFrame:
    """``h, part, seq, lat, lon`` of trimmed cuts ``cut, seq, lat, lon`` (cut 0: the glue point): parts ``cut``
    and ``glue``, and ``border``, both in one ring. Section h lies between cuts h-1 and h."""
    spark = cuts.sparkSession
    if cuts.limit(CUT_LIMIT + 1).count() > CUT_LIMIT:
        raise ValueError(f"more than {CUT_LIMIT} vertices of cuts")
    lines: dict[int, list[Point]] = {}
    for r in sorted(cuts.select("cut", "seq", "lat", "lon").collect(), key=lambda r: (r.cut, r.seq)):  # a cut file's lines
        lines.setdefault(r.cut, []).append((r.lat, r.lon))
    glue, ordered = lines[0][0], [lines[k] for k in sorted(lines) if k]
    rows = []
    for h, after in enumerate(ordered):
        before = ordered[h - 1]
        if before[0] != after[0]:
            raise ValueError("cuts start at different points")
        cut = before[:0:-1] + after
        seam = path_through(cut[-1], glue, cut[0])
        for part, ring in (("cut", cut), ("glue", seam), ("border", cut[:-1] + seam)):
            rows += [(h, part, k, float(a), float(b)) for k, (a, b) in enumerate(ring)]
    return spark.createDataFrame(rows, "h int, part string, seq int, lat double, lon double")


def near_straits(cut_borders: DataFrame, n: int) -> DataFrame:
    """``h, i, j`` of cells around straits that a section's cut border passes."""
    spark, radius = cut_borders.sparkSession, math.degrees(resources.STRAIT_KM / geo.EARTH.a)
    straits = F.broadcast(spark.createDataFrame([(float(a), float(b)) for a, b in resources.STRAITS], "slat double, slon double"))  # ten rows
    fine = paths.resolve(cut_borders, ["h"], radius)

    def close(d: DataFrame, reach: float):
        return d.where((F.abs(F.col("lat") - F.col("slat")) < reach) & (F.abs(geo.wrap_angle(F.col("lon") - F.col("slon"))) < reach / F.cos(F.radians("slat"))))

    passed = close(fine.crossJoin(straits), radius / 2).select("h", "slat", "slon").distinct()
    return close(raster.cell_centers(spark, n).crossJoin(F.broadcast(passed)), radius).select("h", "i", "j").distinct()


def _poles(include: DataFrame, shared: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Cells of fine meshes: a section on the antimeridian has all of it, unless it touches both poles; one that
    touches a pole has all of its row; a pole that is shared in part is shared whole."""
    spark = include.sparkSession
    columns = spark.range(2 * n).select(F.col("id").cast("int").alias("j"))
    rows = spark.range(n).select(F.col("id").cast("int").alias("i"))
    inner = F.col("i").between(1, n - 2) & F.col("j").isin(0, 2 * n - 1)
    flags = include.groupBy("h").agg(F.max(inner).alias("edge"), F.max(F.col("i") == 0).alias("south"), F.max(F.col("i") == n - 1).alias("north"))
    sides = F.explode(F.array(F.lit(0), F.lit(2 * n - 1))).alias("j")
    edge = flags.where("edge and not (south and north)").crossJoin(F.broadcast(rows)).select("h", "i", sides)
    whole = include.unionByName(edge)
    polar = whole.where(F.col("i").isin(0, n - 1)).select("h", "i").distinct().crossJoin(F.broadcast(columns))
    shared_polar = shared.where(F.col("i").isin(0, n - 1)).select("i").distinct().crossJoin(F.broadcast(columns))
    return whole.unionByName(polar.select("h", "i", "j")).distinct(), shared.unionByName(shared_polar.select("i", "j")).distinct()


def build_mesh(spark: SparkSession, cuts: DataFrame, resolution: int) -> tuple[DataFrame, DataFrame]:
    """The mesh ``h, i, j, lat, lon, x, y`` and the sections' borders ``h, seq, lat, lon``; ``resolution``: cells
    from the equator to a pole. ``cuts``: ``cut, seq, lat, lon``, cut 0 the glue point."""
    n = 2 * resolution
    glue = cuts.where("cut = 0").select("cut", "seq", "lat", "lon")
    trimmed = raster.trim_to_grid(cuts.where("cut > 0").withColumnRenamed("cut", "h"), n).withColumnRenamed("h", "cut")
    borders = section_borders(glue.unionByName(trimmed.select("cut", "seq", "lat", "lon")))
    part = {p: borders.where(F.col("part") == p).drop("part") for p in ("cut", "glue", "border")}
    shared = raster.cells_shared_by(part["glue"], part["cut"], n).select("i", "j").distinct()
    include = raster.cells_inside_of(part["border"], n)
    if resolution > 6:
        include, shared = _poles(include, shared, n)
    include = include.unionByName(near_straits(part["cut"], n)).distinct()
    nodes = grid.expand(include, ["h"], 2 * n)
    share = grid.expand(shared, [], 2 * n, periodic=True).withColumn("shared", F.lit(True))
    step = 180.0 / n
    center = cells.center_of(part["border"]).select("h", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    g = glue.select(F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    dense = center.crossJoin(F.broadcast(g)).crossJoin(spark.range((n + 1) * (2 * n + 1)).select(F.floor(F.col("id") / (2 * n + 1)).cast("int").alias("i"), (F.col("id") % (2 * n + 1)).cast("int").alias("j")))
    dense = dense.withColumn("lat", F.col("i") * step - 90.0).withColumn("lon", F.col("j") * step - 180.0)
    dense = dense.select("h", "i", "j", "lat", "lon", geo.oblique_stereographic("lat", "lon", ("clat", "clon"), ("glat", "glon")).alias("p"))
    d = dense.join(nodes.withColumn("there", F.lit(True)), ["h", "i", "j"], "left").join(share, ["i", "j"], "left")
    d = d.select("h", "i", "j", "lat", "lon", F.when(F.col("there"), F.col("p.x")).alias("x"), F.when(F.col("there"), F.col("p.y")).alias("y"), F.coalesce("shared", F.lit(False)).alias("shared"))
    d = cells.identify_poles(cells.blend_seams(d, F.col("shared")), F.col("shared"))
    return d.select("h", "i", "j", "lat", "lon", "x", "y"), part["border"]


def dilate_mesh(mesh: DataFrame) -> DataFrame:
    """Missing nodes guessed from those near: a quadratic surface fitted to the nodes within three steps, with
    a slight pull of its curvatures to zero; with fewer than five, still missing. One group per section."""
    import numpy as np

    def run(pdf):  # pandas DataFrame in, pandas DataFrame out
        out = pdf.set_index(["i", "j"]).sort_index()
        n, m = out.index.max()
        for c in "xy":
            z = out[c].unstack().to_numpy(float)
            new = z.copy()
            for i, j in np.argwhere(np.isnan(z)):
                di, dj = np.mgrid[max(0, i - 3) : min(n, i + 3) + 1, max(0, j - 3) : min(m, j + 3) + 1]
                v = z[di, dj]
                ok = (abs(di - i) + abs(dj - j) <= 3) & np.isfinite(v)
                if ok.sum() >= 5:
                    u, w = (di - i)[ok], (dj - j)[ok]
                    rows = np.stack([np.ones(len(u)), u, w, u * u, u * w, w * w], axis=1)
                    rows = np.vstack([rows, np.eye(6)[3:]])
                    new[i, j] = np.linalg.lstsq(rows, np.append(v[ok], [0, 0, 0]), rcond=None)[0][0]
            out[c] = new.ravel()
        return out.reset_index()[list(pdf.columns)]

    schema = mesh.schema
    return mesh.groupBy("h").applyInPandas(run, schema)


def find_boundaries(mask) -> list[list[Point]]:
    """Outlines of a mask (an array of booleans): closed walks along the inside edge of each region's outer
    border and holes, the region on the left, from cells whose west neighbour is out and east one in."""
    import numpy as np

    inside = np.pad(np.asarray(mask, bool), 1)
    walls = {(i, j) for i, j in np.argwhere(inside[1:-1, 1:-1] & ~inside[1:-1, :-2] & inside[1:-1, 2:]).tolist()}
    out = []
    while walls:
        first = min(walls)
        here, gap, line = first, (0, -1), []
        while True:
            if gap == (0, -1):
                walls.discard(here)
            # ahead: the gap's direction turned, so that the way out stays on the right
            ahead = (-gap[1], gap[0])
            side = here[0] + gap[0] + ahead[0], here[1] + gap[1] + ahead[1]
            front = here[0] + ahead[0], here[1] + ahead[1]
            if inside[side[0] + 1, side[1] + 1]:
                line += [front, side]
                here, gap = side, (-ahead[0], -ahead[1])
            elif inside[front[0] + 1, front[1] + 1]:
                line.append(front)
                here = front
            else:
                gap = ahead
            if here == first and gap == (0, -1):
                break
        out.append([(float(a), float(b)) for a, b in line])
    return out


def skeleton(mesh_ids: DataFrame, factor: float, rows: int, columns: int) -> DataFrame:
    """``h, i, j, row_key, node_key``: which rows and which nodes of them define the rest: every so many rows,
    along each as many nodes as its length deserves, and all beside a missing node."""
    if factor >= 1.5:
        k = max(3, math.floor((rows - 1) / factor))
        important = sorted({round(180.0 / k * a * (rows - 1) / 180) for a in range(k)})
    else:
        important = list(range(rows))
    per_row = []
    for i in range(rows):
        k = max(4, round((columns - 1) / factor * math.cos(math.radians(180.0 / (rows - 1) * i - 90))))
        js = sorted({round(a * (columns - 1) / k) for a in range(k)}) if k <= columns / 1.5 else list(range(columns))
        per_row.append((i, i in important, js))
    keys = F.broadcast(mesh_ids.sparkSession.createDataFrame(per_row, "i int, row_key boolean, js array<int>"))  # a row per grid row
    row, column = W.partitionBy("h", "i").orderBy("j"), W.partitionBy("h", "j").orderBy("i")
    n = F.col("node_id")
    d = mesh_ids.select("h", "i", "j", "node_id", F.lag(n).over(column).isNull().alias("no_s"), F.lead(n).over(column).isNull().alias("no_n"), F.lag(n).over(row).alias("west"), F.lead(n).over(row).alias("east"))
    d = d.join(keys, "i").where("node_id is not null")
    d = d.select("h", "i", "j", "node_id", "west", "east", (F.col("row_key") | F.col("no_s") | F.col("no_n")).alias("row_key"), F.array_contains("js", F.col("j")).alias("col_key"))
    beside = W.partitionBy("h", "i").orderBy("j")
    lone = F.col("west").isNull() | F.col("east").isNull() | ~F.coalesce(F.lag("row_key").over(beside), F.lit(False)) | ~F.coalesce(F.lead("row_key").over(beside), F.lit(False))
    return d.select("h", "i", "j", "row_key", (F.col("row_key") & (F.col("col_key") | lone)).alias("node_key"))
