"""Geographic inputs derived from the test tables by integer arithmetic, and analytic meshes.
Each has a DataFrame form and, for DuckDB, a SQL form that gives the same doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(k: Column) -> Column:
    return F.pmod(k.cast("long") * 7919, F.lit(1799)) / F.lit(10.0) - F.lit(89.953)


def lon_of(k: Column) -> Column:
    return F.pmod(k.cast("long") * 104729, F.lit(3599)) / F.lit(10.0) - F.lit(179.953)


def lat_sql(k: str) -> str:
    return f"(((({k})::bigint * 7919) % 1799) / 10e0 - 89.953e0)"


def lon_sql(k: str) -> str:
    return f"(((({k})::bigint * 104729) % 3599) / 10e0 - 179.953e0)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, lat, lon, category, width`` of customers."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), lat_of(F.col("c_custkey")).alias("lat"), lon_of(F.col("c_custkey")).alias("lon"), F.col("c_nationkey").alias("category"), F.col("c_acctbal").alias("width"))


POINTS = f"(select c_custkey id, {lat_sql('c_custkey')} lat, {lon_sql('c_custkey')} lon, c_nationkey category, c_acctbal width from customer)"


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature_id, seq, lat, lon``: each customer's orders as a line."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("feature_id"), F.col("o_orderkey").alias("seq"), lat_of(F.col("o_orderkey")).alias("lat"), lon_of(F.col("o_orderkey")).alias("lon"))


LINES = f"(select o_custkey feature_id, o_orderkey seq, {lat_sql('o_orderkey')} lat, {lon_sql('o_orderkey')} lon from orders)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature_id, seq, x, y``: planar lines with short steps and rare jumps."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("feature_id"), k.alias("seq"), (F.pmod(k * 37, F.lit(1301)) * 2.0).alias("x"), (F.pmod(k * 91, F.lit(907)) * 1.5).alias("y"))


STEPS = "(select o_custkey feature_id, o_orderkey seq, ((o_orderkey::bigint * 37) % 1301) * 2e0 x, ((o_orderkey::bigint * 91) % 907) * 1.5e0 y from orders)"


def mesh(spark: SparkSession, half: int = 4, sections: int = 3) -> DataFrame:
    """``h, i, j, lat, lon, x, y``: an analytic mesh with ``2 half + 1`` rows; nodes of section 1 are missing
    where (7i + 3j) % 11 = 0."""
    n, m = 2 * half + 1, 4 * half + 1
    d = spark.range(sections * n * m).select((F.col("id") / (n * m)).cast("int").alias("h"), (F.pmod(F.floor(F.col("id") / m), F.lit(n))).cast("int").alias("i"), F.pmod("id", F.lit(m)).cast("int").alias("j"))
    d = d.select("h", "i", "j", (F.col("i") * (180.0 / (n - 1)) - 90.0).alias("lat"), (F.col("j") * (360.0 / (m - 1)) - 180.0).alias("lon"))
    there = (F.col("h") != 1) | (F.pmod(7 * F.col("i") + 3 * F.col("j"), F.lit(11)) != 0)
    x = F.col("lon") * (1.0 - F.col("lat") * F.col("lat") / 16384.0) * 64.0 + F.col("h") * 128.0
    y = F.col("lat") * 64.0 + F.col("h") * F.col("lon") * F.col("lon") / 512.0
    return d.select("*", F.when(there, x).alias("x"), F.when(there, y).alias("y"))


def mesh_sql(half: int = 4, sections: int = 3) -> str:
    n, m = 2 * half + 1, 4 * half + 1
    return f"""(select h, i, j, lat, lon,
  case when h <> 1 or (7 * i + 3 * j) % 11 <> 0 then lon * (1e0 - lat * lat / 16384e0) * 64e0 + h * 128e0 end x,
  case when h <> 1 or (7 * i + 3 * j) % 11 <> 0 then lat * 64e0 + h * lon * lon / 512e0 end y
  from (select h::int h, i::int i, j::int j, i * {180.0 / (n - 1)}e0 - 90e0 lat, j * {360.0 / (m - 1)}e0 - 180e0 lon
    from range({sections}) a(h), range({n}) b(i), range({m}) c(j)))"""


MESH = mesh_sql()
