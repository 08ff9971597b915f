"""Readers of the small text formats. Files are read whole by Spark, so any store it reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of each file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def texts(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(named.items()), "name string, text string")


def parse_cuts(files: DataFrame) -> DataFrame:
    """``name, seq, cut, lat, lon``: cut 0 is the glue point, cut k the k-th cut. A file is one window."""
    rows = files.select("name", F.posexplode(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")).alias("seq", "line"))
    v = F.split(F.trim("line"), r"\s+")
    rows = rows.select("name", "seq", v[0].cast("double").alias("lat"), v[1].cast("double").alias("lon"))
    file = W.partitionBy("name").orderBy("seq")
    first = F.max(F.when(F.col("seq") == 1, F.struct("lat", "lon"))).over(W.partitionBy("name"))
    start = ((F.col("seq") > 0) & (F.struct("lat", "lon") == first)).cast("int")
    return rows.select("name", "seq", F.sum(start).over(file).cast("int").alias("cut"), "lat", "lon")


def parse_options(files: DataFrame) -> DataFrame:
    """``name, key, value``; a line has one colon."""
    rows = files.select("name", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    v = F.split("line", ":", 2)
    return rows.select("name", F.trim(v[0]).alias("key"), F.trim(v[1]).alias("value"))


def closed_sections(cuts: DataFrame) -> DataFrame:
    """``name, h, seq, lat, lon``: rings of two neighbouring cuts and the glue point, closed; the form that
    weights are made from. Cuts h-1 (reversed) and h bound section h, cyclically."""
    n = cuts.groupBy("name").agg(F.max("cut").alias("n"))
    glue = cuts.where("cut = 0").select("name", F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    rows = cuts.where("cut > 0").groupBy("name", "cut").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"))
    left = rows.join(n, "name").select("name", (F.pmod(F.col("cut"), F.col("n"))).cast("int").alias("h"), F.reverse("line").alias("before"))
    rite = rows.select("name", (F.col("cut") - 1).alias("h"), F.col("line").alias("after"))
    d = left.join(rite, ["name", "h"]).join(glue, "name").select("name", "h", F.concat("before", "after").alias("s"), "glat", "glon")
    a, z = F.col("s")[0], F.element_at("s", -1)

    def at(lat, lon):
        return F.struct(F.lit(lat).cast("double").alias("lat") if not hasattr(lat, "cast") else lat.alias("lat"), lon.alias("lon"))

    g, sign = F.col("glat"), F.signum("glat")
    straight = (a["lon"] - z["lon"]) * sign < 0
    pole = F.when(straight, F.array(at(g, z["lon"]), at(g, a["lon"]))).otherwise(F.array(at(g, z["lon"]), at(g, -180.0 * sign), at(g, 180.0 * sign), at(g, a["lon"])))
    plain = F.array(at(z["lat"], F.col("glon")), at(g, F.col("glon")), at(a["lat"], F.col("glon")))
    ring = F.concat("s", F.when(F.abs(g) == 90, pole).otherwise(plain), F.array(a))
    return d.select("name", "h", F.posexplode(ring).alias("seq", "p")).select("name", "h", "seq", "p.lat", "p.lon")


def parse_colormaps(files: DataFrame) -> DataFrame:
    """``name, seq, r, g, b``."""
    rows = files.select("name", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda s: F.trim(s) != "")).alias("seq", "line"))
    v = F.split("line", ",")
    return rows.select("name", "seq", *[v[k].cast("double").alias(c) for k, c in enumerate("rgb")])


def read_colormaps(spark: SparkSession, path: str) -> DataFrame:
    return parse_colormaps(read_whole(spark, path))


def parse_languages(files: DataFrame) -> DataFrame:
    """``lang, key, value`` of a nested JSON file; values that are no strings stay JSON."""
    rows = files.select(F.explode(F.from_json("text", "map<string, map<string, string>>")).alias("lang", "labels"))
    return rows.select("lang", F.explode("labels").alias("key", "value"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return parse_languages(read_whole(spark, path))
