"""Geographic features: nested or exploded lines, projected, split and styled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import interpolation, paths, polygon


def clamp_vertices(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon))


def load_features(shapes: DataFrame) -> DataFrame:
    """``feature_id, category, width, line, seq, lat, lon`` from ``feature_id, biome, strokeweig, part, seq, lat,
    lon``: the biome's class or else the feature's number, half the stroke weight or else 1, clamped vertices."""
    lat, lon = clamp_vertices(F.col("lat"), F.col("lon"))
    category = F.coalesce(F.least(F.lit(15), F.col("biome")) - 1, F.col("feature_id")).cast("long")
    return shapes.select("feature_id", category.alias("category"), F.coalesce(0.5 * F.col("strokeweig"), F.lit(1.0)).alias("width"), F.col("part").alias("line"), "seq", lat.alias("lat"), lon.alias("lon"))


def load_coastlines(shapes: DataFrame, reduction: int = 2) -> DataFrame:
    """Every ``reduction``-th vertex of shapes with more than three times as many."""
    from pyspark.sql import Window as W

    shape = W.partitionBy("feature_id")
    d = shapes.select("feature_id", "seq", "lat", "lon", F.count("*").over(shape).alias("n"), (F.row_number().over(shape.orderBy("seq")) - 1).alias("k"))
    return d.where((F.col("n") > 3 * reduction) & (F.col("k") % reduction == 0)).select("feature_id", "seq", "lat", "lon")


def project_features(features: DataFrame, mesh: DataFrame, polygons: DataFrame, rows: int, columns: int) -> DataFrame:
    """Vertices ``..., lat, lon`` with ``section, x, y`` by the last section that contains them; null outside all."""
    return interpolation.project_bilinear(polygon.last_section(features, polygons), mesh, rows, columns)


def nest(vertices: DataFrame) -> DataFrame:
    """``feature_id, category, width, lines``: an array of lines of vertices."""
    point = F.struct("seq", "x", "y")
    line = vertices.groupBy("feature_id", "category", "width", "line").agg(F.sort_array(F.collect_list(point)).alias("points"))
    return line.groupBy("feature_id", "category", "width").agg(F.sort_array(F.collect_list(F.struct("line", "points"))).alias("lines"))


def create_map(features: DataFrame, mesh: DataFrame, polygons: DataFrame, rows: int, columns: int, colors: int) -> DataFrame:
    """What a map layer draws: projected lines cut at interruptions, with their colour and width."""
    d = project_features(features, mesh, polygons, rows, columns).where("x is not null")
    d = paths.split_lines(d, ["feature_id", "line"])
    return d.select("feature_id", "line", "piece", "piece_seq", "x", "y", F.pmod("category", F.lit(colors)).alias("color"), "width")


def load_rivers(shapes: DataFrame, canal: str = "運河") -> DataFrame:
    """``river_id, part, seq, i, j``: fractional places on a lattice of ten nodes a degree; canals are left out."""
    from . import grid

    d = shapes.where(~F.coalesce(F.col("name_ja").contains(canal), F.lit(False)))
    return d.select("river_id", "part", "seq", grid.fractional_index(F.col("lat"), -90.0, 0.1, 1801).alias("i"), grid.fractional_index(F.col("lon"), -180.0, 0.1, 3600).alias("j"))


def thin_coast(vertices: DataFrame, precision: float, n_parts: int | None = None) -> DataFrame:
    """``source, shape_id, seq, lat, lon`` kept: each more than the precision from the last one kept, by shapes in
    order. The choice runs through a source from its start, so a source is one task's; it streams in Spark's order, which
    spills, and only the last vertex kept is held."""
    import math

    names = ["source", "shape_id", "seq", "lat", "lon"]

    def run(batches):  # pandas DataFrames in, pandas DataFrames out
        now, last = None, None
        for pdf in batches:
            keep = []
            for source, lat, lon in zip(pdf["source"].tolist(), pdf["lat"].tolist(), pdf["lon"].tolist()):
                if source != now:
                    now, last = source, None
                far = last is None or math.hypot(lat - last[0], (lon - last[1]) * math.cos(math.radians((lat + last[0]) / 2))) > precision
                keep.append(far)
                last = (lat, lon) if far else last
            yield pdf[keep]

    rows = vertices.select(*names)
    n = n_parts or int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.repartition(n, "source").sortWithinPartitions("source", "shape_id", "seq").mapInPandas(run, rows.schema)
    return kept.where(~polygon.uninhabited(F.col("lat"), F.col("lon")))


def project_section_boundaries(borders: DataFrame, mesh: DataFrame, rows: int, columns: int, resolution: float) -> DataFrame:
    """``h, seq, part, lat, lon, x, y``: the closed borders ``h, seq, lat, lon``, turned so that they start and end at a
    shared point (their third last vertex), without vertices that move along a pole, refined and projected by their
    own section. ``paths.simplified`` then drops what neighbours retrace."""
    from pyspark.sql import Window as W

    from . import grid

    whole = W.partitionBy("h")
    n = F.max("seq").over(whole) + 1
    d = borders.select("h", "seq", "lat", "lon", n.alias("n"))
    # the last three vertices, then those from the second up to the third last
    place = F.explode(F.filter(F.array(F.when(F.col("seq") >= F.col("n") - 3, F.col("seq") - F.col("n") + 3), F.when(F.col("seq").between(1, F.col("n") - 3), F.col("seq") + 2)), lambda p: p.isNotNull()))
    d = d.select("h", place.alias("seq"), "lat", "lon").withColumn("off", F.abs("lat") != 90)
    d = grid.dilate(d, ["h"], "seq", "off", 1).select("h", "seq", "off").join(d.drop("off"), ["h", "seq"]).where("off").drop("off")
    fine = paths.refine(d, ["h"], resolution).withColumn("section", F.col("h"))
    return interpolation.project_hermite(fine, mesh, rows, columns).drop("section")
