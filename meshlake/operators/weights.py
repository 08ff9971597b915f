"""Importance rasters: distance to the nearest coast inside a section, and the land mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import polygon


def coast_distance(grid: DataFrame, coast: DataFrame, reach: float = geo.COAST_WIDTH) -> DataFrame:
    """``h, i, j, distance`` of the nearest coast vertex within ``reach`` degrees; grid points ``i, j, lat, lon`` and
    vertices ``h, lat, lon``. Both are dealt to bands of latitude as wide as the reach, so each point meets
    the vertices of three bands only, by an equi-join; beyond the reach importance is 0 anyway."""
    band = F.floor(F.col("lat") / reach)
    p = grid.select("i", "j", "lat", "lon", band.alias("band"))
    v = coast.select("h", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), F.explode(F.array(*[F.floor(F.col("lat") / reach) + k for k in (-1, 0, 1)])).alias("band"))
    d = p.join(v, "band").where(F.abs(F.col("lat") - F.col("vlat")) <= reach)
    d = d.select("h", "i", "j", geo.angular_distance("lat", "lon", "vlat", "vlon").alias("distance")).where(F.col("distance") <= reach)
    return d.groupBy("h", "i", "j").agg(F.min("distance").alias("distance"))


def calculate_weights(grid: DataFrame, coast: DataFrame, rings: DataFrame, polygons: DataFrame, value_land: bool, exclude_antarctica: bool) -> DataFrame:
    """``h, i, j, value``: importance of each pixel for each section, all sections in one plan."""
    keyed = grid.withColumn("key", F.struct("i", "j"))
    inside = polygon.inside_region(keyed.select("key", "lat", "lon"), polygons, ["key"]).select("h", "key.i", "key.j", "inside")
    land = polygon.land_mask(grid, rings, exclude_antarctica).select("i", "j", (F.col("land") if value_land else ~F.col("land")).alias("wanted"))
    own = coast.withColumn("key", F.struct("lat", "lon")).where(~polygon.uninhabited(F.col("lat"), F.col("lon"), exclude_antarctica))
    own = polygon.inside_region(own.select("key", "lat", "lon").distinct(), polygons, ["key"]).where("inside").select("h", "key.lat", "key.lon")
    d = inside.join(land, ["i", "j"]).join(coast_distance(grid, own), ["h", "i", "j"], "left")
    return d.select("h", "i", "j", geo.importance(F.col("inside") & F.col("wanted"), "distance").alias("value"))


def calculate_rasters(grid: DataFrame, coast: DataFrame, rings: DataFrame, sets: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """``cut_set, kind, crop, h, i, j, value``: the rasters of all cut sets ``name: (polygons, whether land counts)``, with
    and without Antarctica (not where the sea counts), in one plan."""
    out = None
    for name, (polygons, land) in sets.items():
        for crop in (False, True) if land else (False,):
            own = calculate_weights(grid, coast, rings, polygons, land, crop)
            own = own.select(F.lit(name).alias("cut_set"), F.lit("land" if land else "sea").alias("kind"), F.lit(crop).alias("crop"), "h", "i", "j", "value")
            out = own if out is None else out.unionByName(own)
    return out
