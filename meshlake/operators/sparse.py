"""Sparse arrays as rows ``row, col, val``. Products are equi-joins and sums; partial sums come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_coordinates(rows: DataFrame) -> DataFrame:
    """Repeated coordinates summed, zeros dropped."""
    return rows.groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def from_dense(rows: DataFrame, values: str = "values") -> DataFrame:
    """Rows with an array of values."""
    return rows.select("row", F.posexplode(values).alias("col", "val")).where("val <> 0").select("row", F.col("col").cast("long").alias("col"), "val")


def to_dense(a: DataFrame, n_cols: int) -> DataFrame:
    """``row, values``; a row's entries meet in one array."""
    m = a.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    return m.select("row", F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0.0))).alias("values"))


def combine(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor * b."""
    return from_coordinates(a.unionByName(b.withColumn("val", F.col("val") * factor)))


def scale(a: DataFrame, factor: float | Column) -> DataFrame:
    return a.withColumn("val", F.col("val") * factor).where("val <> 0")


def absolute(a: DataFrame) -> DataFrame:
    return a.withColumn("val", F.abs("val"))


def power(a: DataFrame, exponent: float) -> DataFrame:
    """Of stored entries."""
    return a.withColumn("val", F.pow("val", F.lit(float(exponent))))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entry by entry."""
    return a.join(b.select("row", "col", F.col("val").alias("other")), ["row", "col"]).select("row", "col", (F.col("val") * F.col("other")).alias("val"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("row").alias("col"), F.col("col").alias("to"), F.col("val").alias("other"))
    return from_coordinates(a.join(right, "col").select("row", F.col("to").alias("col"), (F.col("val") * F.col("other")).alias("val")))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """``row, val`` for a vector ``index, x``."""
    return a.join(x.withColumnRenamed("index", "col"), "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def outer(a: DataFrame, b: DataFrame, n_cols: int) -> DataFrame:
    """Products of entries of the same row; their column is col_a * n_cols + col_b."""
    right = b.select("row", F.col("col").alias("c2"), F.col("val").alias("other"))
    return a.join(right, "row").select("row", (F.col("col") * n_cols + F.col("c2")).alias("col"), (F.col("val") * F.col("other")).alias("val"))


def repeat_diagonally(a: DataFrame, times_: int, n_rows: int, n_cols: int) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(times_ - 1))).alias("k")
    return a.select("row", "col", "val", k).select((F.col("row") + F.col("k") * n_rows).alias("row"), (F.col("col") + F.col("k") * n_cols).alias("col"), "val")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def gram(a: DataFrame) -> DataFrame:
    """Transpose times itself."""
    return matmul(transpose(a), a)


def reshape(a: DataFrame, old_cols: int, new_cols: int) -> DataFrame:
    at = F.col("row") * old_cols + F.col("col")
    return a.select(F.floor(at / new_cols).cast("long").alias("row"), F.pmod(at, F.lit(new_cols)).alias("col"), "val")


def take_rows(a: DataFrame, low: int, high: int) -> DataFrame:
    return a.where((F.col("row") >= low) & (F.col("row") < high)).withColumn("row", F.col("row") - low)


def stack(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Arrays one under the other; each with its number of rows."""
    out, shift = None, 0
    for a, n in parts:
        moved = a.withColumn("row", F.col("row") + shift)
        out, shift = moved if out is None else out.unionByName(moved), shift + n
    return out


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("row = col").select(F.col("row").alias("index"), "val")


def reduce_rows(a: DataFrame, n_cols: int) -> DataFrame:
    """``row, total, least, most, norm`` of rows with entries; absent entries are zeros."""
    some = F.count("*") < n_cols
    return a.groupBy("row").agg(
        F.sum("val").alias("total"), F.when(some, F.least(F.min("val"), F.lit(0.0))).otherwise(F.min("val")).alias("least"), F.when(some, F.greatest(F.max("val"), F.lit(0.0))).otherwise(F.max("val")).alias("most"), F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")
    )
