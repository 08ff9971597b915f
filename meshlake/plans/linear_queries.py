"""Queries for sparse arrays, features, rasters, lattices, sinks and optimisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import divides, features, sparse, weights
from ..sources import sinks
from ..sources.scratch import drop_path, shared_path
from ..sources.fixtures import MESH, POINTS, lat_of, lat_sql, lon_of, lon_sql, mesh, points, table
from .line_queries import _GRID, _ISLES, _RINGS, grid, region_sql, rings, sections, sections_sql
from .registry import query

R = geo.rounded


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0"


# sparse matrices of all orders
A_SQL = "(select o_custkey % 2000 \"row\", o_orderkey % 1600 col, sum((o_orderkey % 7 - 3)::double) val from orders group by 1, 2 having sum(o_orderkey % 7 - 3) <> 0)"
B_SQL = "(select o_orderkey % 1600 \"row\", o_custkey % 1200 col, sum((o_custkey % 5 - 2)::double) val from orders group by 1, 2 having sum(o_custkey % 5 - 2) <> 0)"


def _a(spark, sf):
    o = table(spark, sf, "orders")
    return sparse.from_coordinates(o.select((F.col("o_custkey") % 2000).alias("row"), (F.col("o_orderkey") % 1600).alias("col"), (F.col("o_orderkey") % 7 - 3).cast("double").alias("val")))


def _b(spark, sf):
    o = table(spark, sf, "orders")
    return sparse.from_coordinates(o.select((F.col("o_orderkey") % 1600).alias("row"), (F.col("o_custkey") % 1200).alias("col"), (F.col("o_custkey") % 5 - 2).cast("double").alias("val")))


@query(f"select * from {A_SQL}")
def l06_from_coordinates(spark, sf):
    return _a(spark, sf)


@query(f"select \"row\", col, sum(val) val from (select * from {A_SQL} union all select \"row\", col, -0.5e0 * val from {B_SQL}) group by \"row\", col having sum(val) <> 0")
def l01_combine(spark, sf):
    return sparse.combine(_a(spark, sf), _b(spark, sf), -0.5)


@query(f"select \"row\", col, pow(abs(val * 3e0), 2) val from {A_SQL}")
def l01_scale_abs_power(spark, sf):
    return sparse.power(sparse.absolute(sparse.scale(_a(spark, sf), 3.0)), 2)


@query(f"select \"row\", col, a.val * b.val val from {A_SQL} a join {B_SQL} b using (\"row\", col)")
def l02_times(spark, sf):
    return sparse.times(_a(spark, sf), _b(spark, sf))


@query(f"select a.\"row\", b.col, sum(a.val * b.val) val from {A_SQL} a join {B_SQL} b on a.col = b.\"row\" group by 1, 2 having sum(a.val * b.val) <> 0")
def l03_matmul(spark, sf):
    return sparse.matmul(_a(spark, sf), _b(spark, sf))


@query(f"select \"row\", sum(val * col / 4e0) val from {A_SQL} group by 1")
def l03_matvec(spark, sf):
    x = spark.range(1600).select(F.col("id").alias("index"), (F.col("id") / 4.0).alias("x"))
    return sparse.matvec(_a(spark, sf), x)


@query(f"select \"row\", a.col * 1200 + b.col col, a.val * b.val val from {A_SQL} a join {B_SQL} b using (\"row\")")
def l04_outer(spark, sf):
    return sparse.outer(_a(spark, sf), _b(spark, sf), 1200)


@query(f"select \"row\" + k * 2000 \"row\", col + k * 1600 col, val from {A_SQL}, (values (0), (1), (2)) t(k)")
def l05_repeat_diagonally(spark, sf):
    return sparse.repeat_diagonally(_a(spark, sf), 3, 2000, 1600)


@query(f"select a.col \"row\", b.col col, sum(a.val * b.val) val from {A_SQL} a join {A_SQL} b using (\"row\") group by 1, 2 having sum(a.val * b.val) <> 0")
def l06_transpose_matmul_self(spark, sf):
    return sparse.gram(_a(spark, sf))


@query(f"select (\"row\" * 1600 + col) // 1000 \"row\", (\"row\" * 1600 + col) % 1000 col, val from {A_SQL}")
def l06_reshape(spark, sf):
    return sparse.reshape(_a(spark, sf), 1600, 1000)


@query(f"select \"row\" - 10 \"row\", col, val from {A_SQL} where \"row\" between 10 and 19 union all select \"row\" + 10, col, val from {B_SQL} union all select k + 1610, k, 1e0 from range(5) t(k)")
def l06_slice_and_stack(spark, sf):
    return sparse.stack([(sparse.take_rows(_a(spark, sf), 10, 20), 10), (_b(spark, sf), 1600), (sparse.identity(spark, 5), 5)])


@query(f"select \"row\" \"index\", val from {A_SQL} where \"row\" = col")
def l06_diagonal(spark, sf):
    return sparse.diagonal(_a(spark, sf))


@query(f"select \"row\", sum(val) total, case when count(*) < 1600 then least(min(val), 0) else min(val) end least, case when count(*) < 1600 then greatest(max(val), 0) else max(val) end most, {r('sqrt(sum(val * val))')} norm from {A_SQL} group by 1")
def a19_sparse_reductions(spark, sf):
    return sparse.reduce_rows(_a(spark, sf), 1600).withColumn("norm", R(F.col("norm")))


@query(f"select col, sum(val) total from {A_SQL} group by col")
def a20_sum_over_rows(spark, sf):
    return _a(spark, sf).groupBy("col").agg(F.sum("val").alias("total"))


@query("select k::int id, product x from (select k, product(v) product from (select k, unnest([1.5e0, k / 2e0, -2e0]) v from range(1, 20) t(k)) group by k)")
def t10_product(spark, sf):
    v = F.array(F.lit(1.5), F.col("id") / 2.0, F.lit(-2.0))
    return spark.range(1, 20).select(F.col("id").cast("int").alias("id"), F.aggregate(v, F.lit(1.0), lambda a, x: a * x).alias("x"))


@query(f"select coalesce(min(case when lat = {lat_sql('1001')} and lon = {lon_sql('1001')} then id end), -1) hit, coalesce(min(case when lat = 91e0 then id end), -1) miss from {POINTS}")
def t09_index_of_pair(spark, sf):
    k = F.lit(1001)
    p = points(spark, sf)
    return p.agg(F.coalesce(F.min(F.when((F.col("lat") == lat_of(k)) & (F.col("lon") == lon_of(k)), F.col("id"))), F.lit(-1)).alias("hit"), F.coalesce(F.min(F.when(F.col("lat") == 91.0, F.col("id"))), F.lit(-1)).alias("miss"))


# multi-part shapes out of the orders and their lines
_SHAPES = f"""(select o_custkey feature_id, case when o_custkey % 3 <> 0 then o_custkey % 20 end biome, case when o_custkey % 4 <> 0 then (o_custkey % 9)::double end strokeweig, l_orderkey part, l_linenumber seq,
  {lat_sql('l_partkey + l_linenumber')} * 1.02e0 lat, {lon_sql('l_partkey')} * 1.02e0 lon from (select l_orderkey, l_linenumber, min(l_partkey) l_partkey from lineitem group by 1, 2) join orders on l_orderkey = o_orderkey)"""


def _shapes(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    d = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("o_custkey")
    return d.select(k.alias("feature_id"), F.when(k % 3 != 0, k % 20).alias("biome"), F.when(k % 4 != 0, (k % 9).cast("double")).alias("strokeweig"), F.col("l_orderkey").alias("part"), F.col("l_linenumber").alias("seq"), (lat_of(F.col("l_partkey") + F.col("l_linenumber")) * 1.02).alias("lat"), (lon_of(F.col("l_partkey")) * 1.02).alias("lon"))


_FEATURES = f"(select feature_id, coalesce(least(15, biome) - 1, feature_id) category, coalesce(0.5e0 * strokeweig, 1e0) width, part line, seq, greatest(-90e0, least(90e0, lat)) lat, greatest(-180e0, least(180e0, lon)) lon from {_SHAPES})"


@query(f"select feature_id, category, width, line, seq, {r('lat')} lat, {r('lon')} lon from {_FEATURES}")
def s08_load_geographic_data(spark, sf):
    d = features.load_features(_shapes(spark, sf))
    return d.withColumn("lat", R(F.col("lat"))).withColumn("lon", R(F.col("lon")))


@query(f"select feature_id, seq from (select o_custkey feature_id, o_orderkey seq, count(*) over (partition by o_custkey) n, row_number() over (partition by o_custkey order by o_orderkey) - 1 k from orders) where n > 6 and k % 2 = 0")
def s07_load_coastlines(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return features.load_coastlines(o.select(F.col("o_custkey").alias("feature_id"), k.alias("seq"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))).select("feature_id", "seq")


@query(f"select o_custkey river_id, 0 part, o_orderkey seq, {r(f'least(greatest(({lat_sql('o_orderkey')} + 90) / 0.1e0, 0), 1800)')} i, {r(f'least(greatest(({lon_sql('o_orderkey')} + 180) / 0.1e0, 0), 3599)')} j from orders where o_custkey % 5 <> 0")
def s09_load_rivers(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = o.select(F.col("o_custkey").alias("river_id"), F.when(F.col("o_custkey") % 5 == 0, "北運河").alias("name_ja"), F.lit(0).alias("part"), k.alias("seq"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    return features.load_rivers(d).withColumn("i", R(F.col("i"))).withColumn("j", R(F.col("j")))


_TILE = "(select tile, r::int \"row\", c::int col, ((r * 7919 + c * 104729 + length(tile)) % 4001) - 500e0 z from (values ('gt30e020n40'), ('gt30w100s10'), ('gt30e020n90')) t(tile), range(25) a(r), range(20) b(c))"


def _tiles(spark):
    d = spark.range(1500).select(F.array(*map(F.lit, ("gt30e020n40", "gt30w100s10", "gt30e020n90")))[F.floor(F.col("id") / 500).cast("int")].alias("tile"), F.floor(F.col("id") % 500 / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    return d.select("tile", "row", "col", (F.pmod(F.col("row") * 7919 + F.col("col") * 104729 + F.length("tile"), F.lit(4001)) - 500.0).alias("z"), F.lit(25).alias("n_rows"), F.lit(20).alias("n_cols"))


_ELEV = f"""(select i, j, greatest(min(z), 0e0) z from (select z, least(greatest(floor((lat + 90) / 5e0 + 0.5e0), 0), 36)::int i, (((floor((lon + 180) / 5e0 + 0.5e0)::int) % 72) + 72) % 72 j from (
  select z, case substr(tile, -3, 1) when 'n' then 1 else -1 end * right(tile, 2)::double - ("row" + 0.5e0) * 2 lat, case substr(tile, -7, 1) when 'e' then 1 else -1 end * substr(tile, -6, 3)::double + (col + 0.5e0) * 2 lon from {_TILE}))
  where not (i * 5 - 90 > 45 and j * 5 - 180 > 0 and j * 5 - 180 < 90) group by i, j)"""


@query(f"select i, j, z from {_ELEV}")
def s10_load_elevation(spark, sf):
    return divides.load_elevation(_tiles(spark), 37, 72, 0.2)


def _elevation(spark, rows=12, columns=18):
    d = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("j"))
    return d.select("i", "j", (F.pmod(F.col("i") * 7919 + F.col("j") * 104729, F.lit(4001)) - 500.0).alias("z"))


_LATTICE = "(select i::int i, j::int j, ((i * 7919 + j * 104729) % 4001) - 500e0 z from range(12) a(i), range(18) b(j))"


@query(f"""with recursive e as (select * from {_LATTICE}), r as (select i, j, z from e where i = 2 and j = 3
  union select e.i, e.j, least(e.z, r.z) from r join e on abs(e.i - r.i) <= 1 and (abs(e.j - r.j) <= 1 or abs(e.j - r.j) = 17) and (e.i <> r.i or e.j <> r.j))
select e.i, e.j, max(r.z) z from e left join r using (i, j) group by e.i, e.j""")
def l15_bottleneck(spark, sf):
    start = spark.createDataFrame([(2, 3)], "i int, j int")
    return divides.bottleneck(spark, _elevation(spark), start, 18, checkpoint=_checkpoint(spark))


def _checkpoint(spark):
    """Rounds are written below the folder that the cluster shares; a round goes when the next but one is written."""
    root, names = shared_path(spark, "rounds"), []

    def write(df, name):
        df.write.parquet(f"{root}/{name}")
        names.append(name)
        if len(names) > 2:
            drop_path(spark, f"{root}/{names[-3]}")
        return spark.read.parquet(f"{root}/{name}")

    return write


@query(f"select p.id, coalesce(z, -1e9) <= 0 water from {POINTS} p left join {_LATTICE} e on e.i = least(greatest(round((lat + 90) / 10e0), 0), 11) and e.j = least(greatest(round((lon + 180) / 20e0), 0), 17)")
def p08_on_water(spark, sf):
    # a lattice of 10 by 20 degrees: longitudes are halved to share the step
    p = points(spark, sf).withColumn("lon", (F.col("lon") + 180.0) / 2 - 180.0)
    return divides.on_water(p, _elevation(spark), 12, 18, 0.1).select("id", "water")


_RIVERS = "(select c_custkey river_id, k seq, 1 + ((c_custkey * 7 + k * 5) % 97) / 10e0 + 0.033e0 i, 1 + ((c_custkey * 11 + k * 3) % 143) / 10e0 + 0.047e0 j from customer, (values (1), (2), (3)) t(k))"


def _rivers(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("river_id"), F.lit(0).alias("part"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seq"))
    k, s = F.col("river_id"), F.col("seq")
    return c.select("river_id", "part", "seq", ((k * 7 + s * 5) % 97 / 10.0 + 1.033).alias("i"), ((k * 11 + s * 3) % 143 / 10.0 + 1.047).alias("j"))


_BLOCKED = f"""(with s as (select lag(i) over w ai, lag(j) over w aj, i bi, j bj from {_RIVERS} window w as (partition by river_id order by seq)),
n as (select *, unnest(generate_series(floor(least(ai, bi))::int, ceil(greatest(ai, bi))::int)) i from s where ai is not null),
m as (select *, unnest(generate_series(floor(least(aj, bj))::int, ceil(greatest(aj, bj))::int)) j from n),
d as (select *, (ai - bi) * -dj + (aj - bj) * di den from m, (values (-1), (0), (1)) x(di), (values (-1), (0), (1)) y(dj) where di <> 0 or dj <> 0),
h as (select i, j, di, dj from d where den <> 0 and ((ai - i) * -dj + (aj - j) * di) / den between 0 and 1 and ((ai - i) * (aj - bj) - (aj - j) * (ai - bi)) / den between 0 and 1)
select i::int i, j::int j, di, dj from h union select (i + di)::int, (j + dj)::int, -di, -dj from h)"""


@query(f"select i, j, di, dj from {_BLOCKED}")
def j08_blocked_steps(spark, sf):
    return divides.blocked_steps(_rivers(spark, sf))


@query(f"""select id, abs(p.di) <= 1 and abs(p.dj) <= 1 and (p.di <> 0 or p.dj <> 0) and bi between 0 and 11 and b.i is null adjacent from (select *, bi - ai di, case when abs(bj - aj) = 17 then -sign(bj - aj) else bj - aj end dj from (
  select c_custkey id, c_custkey % 12 ai, c_custkey % 18 aj, c_custkey % 12 + c_custkey % 3 - 1 bi, (c_custkey % 18 + c_custkey % 5 - 2 + 18) % 18 bj from customer)) p left join {_BLOCKED} b on (ai, aj, p.di, p.dj) = (b.i, b.j, b.di, b.dj)""")
def p09_adjacent(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(k.alias("id"), (k % 12).cast("int").alias("ai"), (k % 18).cast("int").alias("aj"), (k % 12 + k % 3 - 1).cast("int").alias("bi"), F.pmod(k % 18 + k % 5 - 2, F.lit(18)).cast("int").alias("bj"))
    return divides.adjacent(d, divides.blocked_steps(_rivers(spark, sf)), 12, 18).select("id", "adjacent")


_COAST = f"(select s_suppkey h, lat, lon from (select s_suppkey % 3 s_suppkey, {lat_sql('s_suppkey')} lat, {lon_sql('s_suppkey')} lon from supplier))"


@query(f"""select h, i, j, {r('min(d)')} distance from (select h, i, j, degrees(acos(greatest(-1e0, least(1e0, cos(radians(g.lat)) * cos(radians(c.lat)) * cos(radians(g.lon - c.lon)) + sin(radians(g.lat)) * sin(radians(c.lat)))))) d from {_GRID} g, {_COAST} c) where d <= 6 group by h, i, j""")
def j06_coast_distance(spark, sf):
    k = F.col("s_suppkey")
    coast = table(spark, sf, "supplier").select((k % 3).alias("h"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    return weights.coast_distance(grid(spark), coast).select("h", "i", "j", R(F.col("distance")).alias("distance"))


_DES = "(select lat, lon from " + _COAST + f" where not ({_ISLES}))"


@query(f"""with e as (select coalesce(lag(lat) over w, last_value(lat) over u) lat0, coalesce(lag(lon) over w, last_value(lon) over u) lon0, lat lat1, lon lon1 from {_RINGS}
  window w as (partition by h order by seq), u as (partition by h order by seq rows between unbounded preceding and unbounded following)),
x as (select i, j, count(*) n from {_GRID} g join e on (lon0 < lon) <> (lon1 < lon) and lat0 + (lon - lon0) / (lon1 - lon0) * (lat1 - lat0) < lat where lon0 <> lon1 group by i, j),
l as (select i, j, coalesce(n, 0) % 2 = 1 and not ({_ISLES}) land from {_GRID} left join x using (i, j)),
s as (select h, inside, g.* from {region_sql('(select i * 100 + j id, lat, lon from ' + _GRID + ')', sections_sql('example'), 'id')} q join {_GRID} g on q.id = g.i * 100 + g.j),
c as (select v.h, d.lat, d.lon from (select row_number() over () id, lat, lon from (select distinct lat, lon from {_DES})) d join {region_sql('(select row_number() over () id, lat, lon from (select distinct lat, lon from ' + _DES + '))', sections_sql('example'), 'id')} v using (id) where inside),
m as (select s.h, i, j, min(degrees(acos(greatest(-1e0, least(1e0, cos(radians(s.lat)) * cos(radians(c.lat)) * cos(radians(s.lon - c.lon)) + sin(radians(s.lat)) * sin(radians(c.lat))))))) d from s join c on s.h = c.h group by s.h, i, j)
select s.h, s.i, s.j, {r('case when inside and land then 1e0 else coalesce(pow(greatest(0e0, 1 - d / 6e0), 2), 0e0) end')} "value" from s join l using (i, j) left join m on (m.h, m.i, m.j) = (s.h, s.i, s.j)""")
def g10_calculate_weights(spark, sf):
    k = F.col("s_suppkey")
    coast = table(spark, sf, "supplier").select(lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    d = weights.calculate_weights(grid(spark), coast, rings(spark, sf), sections(spark, "example"), True, False)
    return d.select("h", "i", "j", R(F.col("value")).alias("value"))


@query(f"select seq, printf('%.1f %.1f', lat, lon) \"value\" from {sections_sql('example')} where h = 1")
def k03_cut_lines(spark, sf):
    return sinks.cut_lines(sections(spark, "example").where("h = 1"))


@query(f"select h, i, string_agg(printf('%9.2f,%9.2f', coalesce(x, 'nan'::double), coalesce(y, 'nan'::double)), ',' order by j) \"value\" from {MESH} where h <> 1 group by h, i")
def k05_projection_lines(spark, sf):
    return sinks.projection_lines(mesh(spark).where("h <> 1"))
