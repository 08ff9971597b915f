"""Writers: partitioned columnar tables, and the text forms of cut files and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_mesh(mesh: DataFrame, borders: DataFrame, path: str) -> None:
    mesh.write.mode("overwrite").partitionBy("h").parquet(f"{path}/mesh")
    borders.write.mode("overwrite").parquet(f"{path}/border")


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/mesh"), spark.read.parquet(f"{path}/border")


def save_weights(weights: DataFrame, path: str) -> None:
    """Rows ``cut_set, h, kind, crop, i, j, value``."""
    weights.write.mode("overwrite").partitionBy("cut_set", "h", "kind", "crop").parquet(path)


def load_weights(spark: SparkSession, path: str | None, cut_set: str = "", kind: str = "", crop: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """``h, i, j, value`` of one raster set: only its partitions are read. Without a path the weights are uniform:
    1 in each of ``cells`` ``h, i, j``."""
    if path is None:
        return cells.select("h", "i", "j", F.lit(1.0).alias("value"))
    w = spark.read.parquet(path)
    return w.where((F.col("cut_set") == cut_set) & (F.col("kind") == kind) & (F.col("crop") == crop)).select("h", "i", "j", "value")


def cut_lines(paths: DataFrame) -> DataFrame:
    """``seq, value``: lines of a cut file."""
    return paths.select("seq", F.format_string("%.1f %.1f", "lat", "lon").alias("value"))


def save_cuts(paths: DataFrame, path: str) -> None:
    """One small ordered file."""
    cut_lines(paths).coalesce(1).sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)


def projection_lines(mesh: DataFrame) -> DataFrame:
    """``h, i, value``: per section and latitude its nodes as text, missing ones as NaN."""
    pair = F.format_string("%9.2f,%9.2f", F.coalesce("x", F.lit(float("nan"))), F.coalesce("y", F.lit(float("nan"))))
    line = mesh.groupBy("h", "i").agg(F.sort_array(F.collect_list(F.struct("j", pair.alias("s")))).alias("nodes"))
    return line.select("h", "i", F.concat_ws(",", F.transform("nodes", lambda n: n["s"])).alias("value"))


def save_projection(tables: dict[str, DataFrame], path: str) -> None:
    """The tables ``boundary, bbox, sections, inverse, mesh, border``, those there are."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_projection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Mesh, section borders, outer boundary, and the aspect ratio of the bounding box."""
    box = spark.read.parquet(f"{path}/bbox").first()
    return spark.read.parquet(f"{path}/mesh"), spark.read.parquet(f"{path}/border"), spark.read.parquet(f"{path}/boundary"), (box.x_max - box.x_min) / (box.y_max - box.y_min)


def load_diagram(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What diagrams are drawn from: mesh, section borders, and the list ``h, name`` of sections."""
    return spark.read.parquet(f"{path}/mesh"), spark.read.parquet(f"{path}/border"), spark.read.parquet(f"{path}/sections")


def filled(template: Column, *values) -> Column:
    """A template with its fields in braces replaced, one after another."""
    part = F.split(template, r"\{[^}]*\}")
    out = [F.get(part, F.lit(0))]
    for k, v in enumerate(values):
        out += [(F.col(v) if isinstance(v, str) else v).cast("string"), F.coalesce(F.get(part, F.lit(k + 1)), F.lit(""))]
    return F.rtrim(F.concat(*out), F.lit("\n"))


def _numeral(number: int) -> Column:
    return F.get(F.from_json("numerals", "array<string>"), F.lit(number))


def _by_language(labels: DataFrame) -> DataFrame:
    """``lang`` and a map ``t`` of its texts, and ``numerals``: a row per language."""
    d = labels.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("t"))
    return F.broadcast(d.withColumn("numerals", F.col("t")["numerals"]))


def projection_text(mesh: DataFrame, borders: DataFrame, boundary: DataFrame, inverse: DataFrame, labels: DataFrame, number: int) -> DataFrame:
    """``lang, block, h, place, value``: the lines of a projection's text form per language, in order of block, section and
    place. ``borders``: ``h, seq, lat, lon``; ``boundary``: ``seq, x, y``; ``inverse``: ``ix, iy, x, y, lat, lon``;
    ``labels``: ``lang, key, value`` with the headers' templates. Within a section its header (block 1, place 0), its border (1),
    the header of its points (2) and these (3); before all the projection's header (block 0), behind them the boundary (2)
    and the inverse raster (3). Missing numbers are NaN."""
    lang = _by_language(labels)
    nan, t = F.lit(float("nan")), lambda key: F.col("t")[key]

    def pair(a: str, b: str, form: str) -> Column:
        return F.format_string(f"{form},{form}", F.coalesce(a, nan), F.coalesce(b, nan))

    def lines(d: DataFrame, block: int, h: Column | int, part: int, seq: Column | int, value: Column) -> DataFrame:
        col = lambda v: v if isinstance(v, Column) else F.lit(v)
        place = F.struct(F.lit(part).alias("part"), col(seq).cast("long").alias("seq"))
        return d.select("lang", F.lit(block).alias("block"), col(h).cast("int").alias("h"), place.alias("place"), value.alias("value"))

    size = mesh.agg(F.countDistinct("h").alias("sections"))
    shape = mesh.groupBy("h").agg(F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("columns"))
    length = borders.groupBy("h").agg(F.count("*").alias("n"))
    raster = inverse.agg(F.countDistinct("iy").alias("rows"), F.countDistinct("ix").alias("columns"))
    box = inverse.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    row = inverse.groupBy("iy").agg(F.sort_array(F.collect_list(F.struct("ix", pair("lat", "lon", "%6.1f").alias("s")))).alias("p"))
    h, each = F.col("h"), lambda d: d.crossJoin(lang)
    out = [
        lines(each(size), 0, -1, 0, 0, filled(t("projection header"), _numeral(number), "sections")),
        lines(each(length), 1, h, 0, 0, filled(t("section header"), "h")),
        lines(each(length), 1, h, 0, 1, filled(t("section boundary header"), "n")),
        lines(each(borders), 1, h, 1, F.col("seq"), pair("lat", "lon", "%6.1f")),
        lines(each(shape), 1, h, 2, 0, filled(t("section points header"), "rows", "columns", F.lit(2))),
        lines(each(projection_lines(mesh)), 1, h, 3, F.col("i"), F.col("value")),
        lines(each(boundary.agg(F.count("*").alias("n"))), 2, -1, 0, 0, filled(t("boundary header"), "n")),
        lines(each(boundary), 2, -1, 1, F.col("seq"), pair("x", "y", "%9.2f")),
        lines(each(raster), 3, -1, 0, 0, filled(t("inverse header"), "rows", "columns", F.lit(2))),
        lines(each(box), 3, -1, 1, 0, F.format_string("%9.2f,%9.2f,%9.2f,%9.2f", "x0", "y0", "x1", "y1")),
        lines(each(row), 3, -1, 2, F.col("iy"), F.concat_ws(",", F.transform("p", lambda p: p["s"]))),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def save_projection_text(lines: DataFrame, path: str) -> None:
    """A folder per language with one ordered file: a projection has as many lines as its mesh has rows and border vertices."""
    lines.repartition(1).sortWithinPartitions("lang", "block", "h", "place").select("lang", "value").write.mode("overwrite").partitionBy("lang").text(path)


def projection_attributes(labels: DataFrame, names: DataFrame, number: int, title: str = "title") -> DataFrame:
    """``lang, item, attribute, value``: what the structured form says about its tables in each language: title and
    description, units, and the sections' names (``names``: ``h, name``, where the name is a key of the language). ``title``: what
    the language's keys of the title's template and of the descriptions begin with."""
    lang, t = _by_language(labels), lambda key: F.col("t")[key]
    units = [("projected boundary", "km"), ("bounding box", "km"), ("inverse points", "\u00b0"), ("boundary", "\u00b0"), ("projected points", "km")]
    rows = [F.struct(F.lit("").alias("item"), t("name").alias("attribute"), filled(t(f"{title} #"), _numeral(number)).alias("value")), F.struct(F.lit("").alias("item"), t("descript").alias("attribute"), t(f"{title} {number} descript").alias("value"))]
    for key, unit in units:
        rows += [F.struct(t(key).alias("item"), t("units").alias("attribute"), F.lit(unit).alias("value")), F.struct(t(key).alias("item"), t("descript").alias("attribute"), t(f"{key} descript").alias("value"))]
    own = lang.select("lang", F.explode(F.array(*rows)).alias("r")).select("lang", "r.*")
    sections = names.crossJoin(lang).select("lang", filled(t("section #"), "h").alias("item"), t("name").alias("attribute"), F.col("t")[F.col("name")].alias("value"))
    return own.unionByName(sections)
