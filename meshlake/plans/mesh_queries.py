"""Queries for interpolation, cells, aggregates and grid windows over the analytic mesh and test points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells, grid, interpolation, paths, polygon
from ..sources.fixtures import MESH, POINTS, STEPS, mesh, points, steps
from .line_queries import planar_sql, region_sql, sections, sections_sql
from .registry import query

R = geo.rounded
ROWS, COLUMNS = 9, 17
_A, _E2 = repr(geo.EARTH.a), repr(geo.EARTH.e2)


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0"


_SECTION = f"(select p.*, s.section from {POINTS} p join (select id, max(case when inside then h end) section from {planar_sql(POINTS, sections_sql('example'))} group by id) s using (id))"
_FIRST = f"(select p.*, s.section from {POINTS} p left join (select id, min(h) section from {region_sql(POINTS, sections_sql('example'), 'id')} where inside group by id) s using (id))"


def _cell(src: str) -> str:
    return f"(select *, fi - i u, fj - j v from (select *, least(floor(fi), 7)::int i, least(floor(fj), 15)::int j from (select *, least(greatest((lat + 90) / 22.5e0, 0), 8) fi, least(greatest((lon + 180) / 22.5e0, 0), 16) fj from {src})))"


def bilinear_sql(src: str, cols: str, fill: str | None = None) -> str:
    def v(c):
        x = f"(1 - u) * (1 - v) * a.{c} + (1 - u) * v * b.{c} + u * (1 - v) * c.{c} + u * v * d.{c}"
        return f"coalesce({x}, {fill})" if fill else x

    return f"""select {cols}, {r(v('x'))} x, {r(v('y'))} y from {_cell(src)} p left join {MESH} a on (p.section, p.i, p.j) = (a.h, a.i, a.j) left join {MESH} b on (p.section, p.i, p.j + 1) = (b.h, b.i, b.j)
  left join {MESH} c on (p.section, p.i + 1, p.j) = (c.h, c.i, c.j) left join {MESH} d on (p.section, p.i + 1, p.j + 1) = (d.h, d.i, d.j)"""


def _in_sections(spark, sf):
    return polygon.last_section(points(spark, sf), sections(spark, "example"))


def _xy(d, *keys):
    return d.select(*keys, R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


@query(f"select section, count(*) n, count(x) projected, min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max from ({bilinear_sql(_SECTION, 'id, section')}) group by section")
def flagship_project_points(spark, sf):
    d = _xy(interpolation.project_bilinear(_in_sections(spark, sf), mesh(spark), ROWS, COLUMNS), "id", "section")
    return d.groupBy("section").agg(F.count("*").alias("n"), F.count("x").alias("projected"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query(f"select id, i, j, {r('u')} u, {r('v')} v from {_cell(POINTS)}")
def j03_locate_cell(spark, sf):
    return interpolation.locate(points(spark, sf), ROWS, COLUMNS).select("id", "i", "j", R(F.col("u")).alias("u"), R(F.col("v")).alias("v"))


@query(bilinear_sql(_SECTION, "id, section"))
def i01_project_bilinear(spark, sf):
    return _xy(interpolation.project_bilinear(_in_sections(spark, sf), mesh(spark), ROWS, COLUMNS), "id", "section")


@query(bilinear_sql(_SECTION, "id, section", "0e0"))
def i02_bilinear_filled(spark, sf):
    return _xy(interpolation.project_bilinear(_in_sections(spark, sf), mesh(spark), ROWS, COLUMNS, fill=0.0), "id", "section")


def gradient_sql(src: str, c: str, x: str, keys: str, order: str) -> str:
    return f"""(select *, case when {c} is null then null when p1 is not null and n1 is not null then (n1 - p1) / (xn1 - xp1) when p1 is not null and p2 is not null then (3 * {c} - 4 * p1 + p2) / ({x} - xp2)
  when n1 is not null and n2 is not null then (3 * {c} - 4 * n1 + n2) / ({x} - xn2) when p1 is not null then ({c} - p1) / ({x} - xp1) when n1 is not null then (n1 - {c}) / (xn1 - {x}) end g
  from (select *, lag({c}, 1) over w p1, lag({c}, 2) over w p2, lead({c}, 1) over w n1, lead({c}, 2) over w n2, lag({x}, 1) over w xp1, lag({x}, 2) over w xp2, lead({x}, 1) over w xn1, lead({x}, 2) over w xn2 from {src} window w as (partition by {keys} order by {order})))"""


@query(f"select a.h, a.i, a.j, {r('a.g')} x_lat, {r('b.g')} y_lon from {gradient_sql(MESH, 'x', 'lat', 'h, j', 'i')} a join {gradient_sql(MESH, 'y', 'lon', 'h, i', 'j')} b on (a.h, a.i, a.j) = (b.h, b.i, b.j)")
def w01_gradient(spark, sf):
    d = grid.gradient(mesh(spark), ["h", "j"], "i", "x", "lat", "x_lat")
    d = grid.gradient(d, ["h", "i"], "j", "y", "lon", "y_lon")
    return d.select("h", "i", "j", R(F.col("x_lat")).alias("x_lat"), R(F.col("y_lon")).alias("y_lon"))


# a mesh whose sections 0 and 2 meet in some nodes
_SEAM = f"(select h, i, j, lat, lon, case when h = 2 and j < 4 then lon * 64e0 * (1e0 - lat * lat / 16384e0) else x end x, case when h = 2 and j < 4 then lat * 64e0 else y end y from {MESH})"


def _seam(spark):
    meets = (F.col("h") == 2) & (F.col("j") < 4)
    x, y = F.col("lon") * 64.0 * (1.0 - F.col("lat") * F.col("lat") / 16384.0), F.col("lat") * 64.0
    return mesh(spark).select("h", "i", "j", "lat", "lon", F.when(meets, x).otherwise(F.col("x")).alias("x"), F.when(meets, y).otherwise(F.col("y")).alias("y"))


_GRADS = f"""(with m as (select * from {_SEAM}), g as (select m.*, a.g x_lat, b.g y_lat, c.g x_lon, d.g y_lon from m join {gradient_sql('m', 'x', 'lat', 'h, j', 'i')} a using (h, i, j) join {gradient_sql('m', 'y', 'lat', 'h, j', 'i')} b using (h, i, j)
  join {gradient_sql('m', 'x', 'lon', 'h, i', 'j')} c using (h, i, j) join {gradient_sql('m', 'y', 'lon', 'h, i', 'j')} d using (h, i, j)),
s as (select a.i, a.j, bool_or(a.x is not null and a.x = b.x and a.y = b.y) shared from m a join m b on a.i = b.i and a.j = b.j and b.h = (a.h + 2) % 3 group by a.i, a.j)
select h, i, j, lat, lon, x, y, case when shared then avg(x_lat) over n else x_lat end x_lat, case when shared then avg(y_lat) over n else y_lat end y_lat, case when shared then avg(x_lon) over n else x_lon end x_lon, case when shared then avg(y_lon) over n else y_lon end y_lon
  from g left join s using (i, j) window n as (partition by i, j))"""


@query(f"select h, i, j, {r('x_lat')} x_lat, {r('y_lat')} y_lat, {r('x_lon')} x_lon, {r('y_lon')} y_lon from {_GRADS}")
def a07_blend_gradients(spark, sf):
    d = interpolation.with_gradients(_seam(spark))
    return d.select("h", "i", "j", *[R(F.col(c)).alias(c) for c in ("x_lat", "y_lat", "x_lon", "y_lon")])


def _hermite_sql(c: str) -> str:
    def part(k, u, v, su, sv):
        return f"{u} * {v} * {k}.{c} + {su} * 22.5e0 * {v} * {k}.{c}_lat + {u} * {sv} * 22.5e0 * {k}.{c}_lon"

    a = {0: ("(2 * u * u * u - 3 * u * u + 1)", "(u * u * u - 2 * u * u + u)"), 1: ("(3 * u * u - 2 * u * u * u)", "(u * u * u - u * u)")}
    b = {k: tuple(x.replace("u", "v") for x in v) for k, v in a.items()}
    return " + ".join(part(k, a[p][0], b[q][0], a[p][1], b[q][1]) for k, p, q in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)))


@query(f"""with g as (select * from {_GRADS}) select id, section, {r(_hermite_sql('x'), 4)} x, {r(_hermite_sql('y'), 4)} y from {_cell(_FIRST)} p left join g a on (p.section, p.i, p.j) = (a.h, a.i, a.j) left join g b on (p.section, p.i, p.j + 1) = (b.h, b.i, b.j)
  left join g c on (p.section, p.i + 1, p.j) = (c.h, c.i, c.j) left join g d on (p.section, p.i + 1, p.j + 1) = (d.h, d.i, d.j)""")
def i04_project_hermite(spark, sf):
    p = polygon.first_section(points(spark, sf), sections(spark, "example"), ["id"])
    d = interpolation.project_hermite(p, _seam(spark), ROWS, COLUMNS)
    return d.select("id", "section", R(F.col("x"), 4).alias("x"), R(F.col("y"), 4).alias("y"))


_W = f"""(select id, section h, i + k // 2 i, j + k % 2 j, case k when 0 then (1 - u) * (1 - v) when 1 then (1 - u) * v when 2 then u * (1 - v) else u * v end w from (select *, unnest([0, 1, 2, 3]) k from {_cell(_SECTION)}))"""


@query(f"select id, h, i, j, {r('w')} weight from {_W}")
def i05_symbolic_weights(spark, sf):
    d = interpolation.bilinear_weights(_in_sections(spark, sf), ROWS, COLUMNS)
    return d.select("id", "h", "i", "j", R(F.col("weight")).alias("weight"))


@query(f"select id, {r('case when count(x) = count(*) then sum(x * w) end')} x, {r('case when count(x) = count(*) then sum(y * w) end')} y from (select * from {_W} where w <> 0) left join {MESH} m using (h, i, j) group by id")
def i05_apply_weights(spark, sf):
    d = interpolation.apply_weights(interpolation.bilinear_weights(_in_sections(spark, sf), ROWS, COLUMNS), mesh(spark))
    return _xy(d, "id")


_TARGETS = "(select k::int id, -9000e0 + 1801e0 * (k // 11) x, -5500e0 + 1103e0 * (k % 11) y from range(121) t(k))"


def _targets(spark):
    k = F.col("id")
    return spark.range(121).select(k.cast("int").alias("id"), (F.floor(k / 11) * 1801.0 - 9000.0).alias("x"), ((k % 11) * 1103.0 - 5500.0).alias("y"))


@query(f"select id, h, i, j, {r('d2')} d2 from (select t.id, h, i, j, pow(t.x - m.x, 2) + pow(t.y - m.y, 2) d2, row_number() over (partition by t.id, h order by pow(t.x - m.x, 2) + pow(t.y - m.y, 2), i, j) rn from {_TARGETS} t, {MESH} m where m.x is not null) where rn = 1")
def t01_nearest_node(spark, sf):
    d = interpolation.nearest_nodes(_targets(spark), mesh(spark))
    return d.select("id", "h", "i", "j", R(F.col("d2")).alias("d2"))


@query("select id, round(lat, 5) + 0 lat, round(lon, 5) + 0 lon from (select k::int id, 10e0 + (k % 7) * 2e0 lat, 20e0 + (k // 7) * 3e0 lon from range(49) t(k))")
def i09_inverse_in_tetragon(spark, sf):
    """The bilinear image of known coordinates, inverted: they come back."""
    d = spark.range(49).select(F.col("id").cast("int").alias("id"), ((F.col("id") % 7) / 6.0).alias("u"), (F.floor(F.col("id") / 7) / 6.0).alias("v"))
    sw, se, nw, ne = (0.0, 0.0), (10.0, 1.0), (-1.0, 8.0), (12.0, 11.0)
    d = d.select("id", *[geo.bilinear("u", "v", sw[k], se[k], nw[k], ne[k]).alias(c) for k, c in enumerate("xy")])
    at = [F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y")).alias(k) for k, p in (("sw", sw), ("se", se), ("nw", nw), ("ne", ne))]
    d = interpolation.invert_cells(d.select("id", "x", "y", *at, F.lit(10.0).alias("clat"), F.lit(20.0).alias("clon")), 12.0, 18.0)
    return d.select("id", R(F.col("lat"), 5).alias("lat"), R(F.col("lon"), 5).alias("lon"))


_BINS = (-12000.0, 1200.0, 20, -6000.0, 600.0, 20)
_OCC = f"(select least(floor((x + 12000e0) / 1200e0), 19)::int i, least(floor((y + 6000e0) / 600e0), 19)::int j, count(*) n from {MESH} where x between -12000 and 12000 and y between -6000 and 6000 group by 1, 2)"


@query(f"select i, j, n from {_OCC}")
def a15_occupancy(spark, sf):
    return interpolation.occupancy(mesh(spark), *_BINS)


@query(f"select distinct i + a i, j + b j from {_OCC}, (values (0), (1)) s(a), (values (0), (1)) t(b)")
def w13_expand(spark, sf):
    return interpolation.used_bins(mesh(spark), *_BINS)


@query(f"select distinct i + a i, unnest(case when j + b = 0 then [0, 20] when j + b = 20 then [20, 0] else [j + b] end) j from {_OCC}, (values (0), (1)) s(a), (values (0), (1)) t(b)")
def w13_expand_periodic(spark, sf):
    return grid.expand(interpolation.occupancy(mesh(spark), *_BINS).select("i", "j"), [], 20, periodic=True)


_LINES = "(select o_custkey k, row_number() over (partition by o_custkey order by o_orderkey)::int s, o_orderkey % 13 = 0 f from orders)"


@query(f"select k, s, bool_or(f) over (partition by k order by s rows between 2 preceding and 2 following) f from {_LINES}")
def w12_dilate(spark, sf):
    from pyspark.sql import Window as W

    from ..sources.fixtures import table

    o = table(spark, sf, "orders")
    d = o.select(F.col("o_custkey").alias("k"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("s"), (F.col("o_orderkey") % 13 == 0).alias("f"))
    return grid.dilate(d, ["k"], "s", "f", 2)


@query(f"select h, i, j, (min(case when x is not null then j end) over (partition by h, i order by j rows between current row and unbounded following))::int east_ref, (min(case when x is not null then j end) over (partition by h, i order by j rows between current row and unbounded following) - j)::int east_distance from {MESH}")
def j13_nearest_defined(spark, sf):
    return grid.nearest_defined(mesh(spark), ["h", "i"], "j", F.col("x").isNotNull(), True, "east").select("h", "i", "j", "east_ref", "east_distance")


_IDS = f"(with p as (select x, y, (row_number() over (order by x, y) - 1)::int node_id from (select distinct x, y from {_SEAM} where x is not null)) select h, i, j, node_id, m.x, m.y from {_SEAM} m left join p using (x, y))"


@query(f"select h, i, j, node_id from {_IDS}")
def a01_enumerate_nodes(spark, sf):
    return cells.enumerate_nodes(_seam(spark))[0]


@query(f"select h, i, j, x, y from {_SEAM}")
def j02_restore_coordinates(spark, sf):
    return cells.restore(*cells.enumerate_nodes(_seam(spark)))


_WEIGHTS = "(select h::int h, i::int i, j::int j, ((h * 5 + i * 3 + j) % 10) / 10e0 shape, ((h + i + j * 7) % 13) / 10e0 scale from range(3) a(h), range(8) b(i), range(16) c(j))"


def _weights(spark):
    d = spark.range(384).select(F.floor(F.col("id") / 128).cast("int").alias("h"), F.floor(F.col("id") % 128 / 16).cast("int").alias("i"), (F.col("id") % 16).cast("int").alias("j"))
    h, i, j = F.col("h"), F.col("i"), F.col("j")
    return d.select("h", "i", "j", ((h * 5 + i * 3 + j) % 10 / 10.0).alias("shape"), ((h + i + j * 7) % 13 / 10.0).alias("scale"))


_AREA = f"{_A} * radians(22.5e0) * (1 - {_E2}) * pow(1 - {_E2} * sin(radians({{0}})) * sin(radians({{0}})), 1.5e0) * {_A} * radians(22.5e0) * pow(1 + (1 - {_E2}) * tan(radians({{0}})) * tan(radians({{0}})), -0.5e0)"
_CELLS = f"""(with n as (select h, i, j, node_id from {_IDS}),
q as (select a.h, a.i, a.j, a.node_id sw, b.node_id se, c.node_id nw, d.node_id ne, shape, scale from n a join n b on (a.h, a.i, a.j + 1) = (b.h, b.i, b.j) join n c on (a.h, a.i + 1, a.j) = (c.h, c.i, c.j)
  join n d on (a.h, a.i + 1, a.j + 1) = (d.h, d.i, d.j) join {_WEIGHTS} w on (a.h, a.i, a.j) = (w.h, w.i, w.j)),
c as (select di, dj, h, i, j, case di when 0 then sw else nw end west, case di when 0 then se else ne end east, case dj when 0 then sw else se end south, case dj when 0 then nw else ne end north, shape, scale from q, (values (0), (1)) s(di), (values (0), (1)) t(dj)),
g as (select west, east, south, north, min((di, dj, h, i, j)) o, sum(shape) shape, sum(scale) scale from c where west is not null and east is not null and south is not null and north is not null and west <> east group by west, east, south, north),
p as (select o[3] h, o[4] + o[1] i, o[5] + o[2] j, -90 + 22.5e0 * (o[4] + o[1]) lat, -90 + 22.5e0 * (o[4] + 1 - o[1]) lat2, west, east, south, north, shape, scale from g)
select h, i, j, lat, west, east, south, north, a * least(1, greatest(0.01, shape)) shape_weight, a * least(1, greatest(0.01, scale)) scale_weight from (select *, (3 * {_AREA.format('lat')} + {_AREA.format('lat2')}) / 16 / (4 * pi() * {_A} * {_A}) a from p))"""


def _cells(spark):
    ids, places = cells.enumerate_nodes(_seam(spark))
    lats = _seam(spark).where("h = 0 and j = 0").select("i", "lat")
    return cells.enumerate_cells(ids, _weights(spark), lats, 22.5, 22.5), places, lats


@query(f"select h, i, j, west, east, south, north, {r('shape_weight', 9)} shape_weight, {r('scale_weight', 9)} scale_weight from {_CELLS}")
def a02_enumerate_cells(spark, sf):
    c = _cells(spark)[0]
    return c.select("h", "i", "j", "west", "east", "south", "north", R(F.col("shape_weight"), 9).alias("shape_weight"), R(F.col("scale_weight"), 9).alias("scale_weight"))


_PHI, _LAM = f"({_A} * radians(22.5e0) * (1 - {_E2}) * pow(1 - {_E2} * sin(radians(lat)) * sin(radians(lat)), 1.5e0))", f"({_A} * radians(22.5e0) * pow(1 + (1 - {_E2}) * tan(radians(lat)) * tan(radians(lat)), -0.5e0))"
_STRAINS = f"""(with c as (select * from {_CELLS} where abs(lat) < 89), p as (select distinct node_id, x, y from {_IDS} where node_id is not null)
select h, i, j, west, east, south, north, shape_weight, scale_weight, t + s a, t - s b from (select *, sqrt((xe + yn) * (xe + yn) + (xn - ye) * (xn - ye)) / 2 t, sqrt((xe - yn) * (xe - yn) + (xn + ye) * (xn + ye)) / 2 s from (
  select c.*, (e.x - w.x) / {_LAM} xe, (e.y - w.y) / {_LAM} ye, (n.x - s.x) / {_PHI} xn, (n.y - s.y) / {_PHI} yn from c join p w on west = w.node_id join p e on east = e.node_id join p s on south = s.node_id join p n on north = n.node_id)))"""


def _strains(spark):
    c, places, lats = _cells(spark)
    return cells.with_strains(c.where("i between 1 and 7"), places, lats, 22.5, 22.5)


@query(f"select h, i, j, west, east, south, north, {r('a')} a, {r('b')} b from {_STRAINS}")
def a10_principal_strains(spark, sf):
    return _strains(spark).select("h", "i", "j", "west", "east", "south", "north", R(F.col("a")).alias("a"), R(F.col("b")).alias("b"))


@query(f"select {r('case when min(least(a, b)) > 0 then null when min(least(a, b)) < -100 then null else sum(exp(-10 * a) + exp(-10 * b)) end', 4)} energy from (select a + 0.001e0 a, b + 0.001e0 b from {_STRAINS})")
def a11_energy_aggressive(spark, sf):
    d = _strains(spark).withColumn("a", F.col("a") + 0.001).withColumn("b", F.col("b") + 0.001)
    e = cells.energy_aggressive(d)
    return e.select(R(F.when(F.abs("energy") < float("inf"), F.col("energy")), 4).alias("energy"))


@query(f"select {r('sum(pow(a + b - 2, 2) * scale_weight + 2 * pow(a - b, 2) * shape_weight)', 7)} energy from {_STRAINS}")
def a12_energy_lenient(spark, sf):
    return cells.energy_lenient(_strains(spark)).select(R(F.col("energy"), 7).alias("energy"))


@query(f"select {r('sum(((a * b * a * b - 1) / 2 - ln(a * b)) * scale_weight + 2 * pow(a - b, 2) * shape_weight)', 7)} energy from {_STRAINS} where a > 0.001 and b > 0.001")
def a13_energy_strict(spark, sf):
    return cells.energy_strict(_strains(spark).where("a > 0.001 and b > 0.001")).select(R(F.col("energy"), 7).alias("energy"))


_HIST = f"(select a x, b y, scale_weight w from {_STRAINS} union all select b, a, scale_weight from {_STRAINS})"


@query(f"select least(floor(x / 0.05e0), 39)::int bin_x, least(floor(y / 0.05e0), 39)::int bin_y, {r('sum(w)', 9)} weight from {_HIST} where x between 0 and 2 and y between 0 and 2 group by 1, 2")
def a14_strain_histogram(spark, sf):
    s = _strains(spark)
    both = s.select(F.col("a").alias("x"), F.col("b").alias("y"), "scale_weight").unionByName(s.select(F.col("b").alias("x"), F.col("a").alias("y"), "scale_weight"))
    h = grid.histogram2d(both, [], "x", "y", 0.0, 2.0, 40, F.col("scale_weight"))
    return h.select("bin_x", "bin_y", R(F.col("weight"), 9).alias("weight"))


@query(f"select h, i, j, {r('avg(shape)')} shape from (select h, floor(i / 8e0 * 3)::int i, floor(j / 16e0 * 5)::int j, shape from {_WEIGHTS}) group by h, i, j")
def a03_downsample(spark, sf):
    return grid.downsample(_weights(spark), ["h"], (8, 16), (3, 5), "shape").select("h", "i", "j", R(F.col("shape")).alias("shape"))


_SHARE = "(i + j) % 3 = 0"


@query(f"select h, i, j, {r(f'case when x is not null and {_SHARE} then avg(x) over (partition by i, j) else x end')} x, {r(f'case when x is not null and {_SHARE} then avg(y) over (partition by i, j) else y end')} y from {MESH}")
def a05_blend_seams(spark, sf):
    return _xy(cells.blend_seams(mesh(spark), F.expr(_SHARE)), "h", "i", "j")


@query(f"""with s as (select *, bool_or(i = 0 and j = 3) over (partition by i) sh from {MESH}),
p as (select *, case when i in (0, 8) then case when sh then avg(x) over (partition by i) else avg(x) over (partition by h, i) end else x end nx, case when i in (0, 8) then case when sh then avg(y) over (partition by i) else avg(y) over (partition by h, i) end else y end ny from s),
f as (select *, first_value(nx) over w fx, first_value(ny) over w fy from p window w as (partition by h, i order by j))
select h, i, j, {r('case when x is not null then case when j = 16 then fx else nx end end')} x, {r('case when x is not null then case when j = 16 then fy else ny end end')} y from f""")
def a06_identify_poles(spark, sf):
    return _xy(cells.identify_poles(mesh(spark), (F.col("i") == 0) & (F.col("j") == 3)), "h", "i", "j")


@query(f"select h, min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max from {MESH} group by h")
def a08_bounding_box(spark, sf):
    return cells.bounding_box(mesh(spark), ["h"])


@query("select k i, j, round(abs(k - 4) + least(abs(j - 3), 16 - abs(j - 3)) * sin(k / 7e0 * pi()), 6) + 0 distance from (select k::int k, j::int j from range(8) a(k), range(16) b(j)) where abs(k - 4) + least(abs(j - 3), 16 - abs(j - 3)) * sin(k / 7e0 * pi()) <= 6")
def t02_search_order(spark, sf):
    c = spark.range(128).select(F.floor(F.col("id") / 16).cast("int").alias("i"), (F.col("id") % 16).cast("int").alias("j"))
    d = grid.search_order(c, F.lit(4), F.lit(3), 8, 16, 6)
    return d.select("i", "j", R(F.col("distance")).alias("distance"))


@query(f"""with b as (select id, case when lat >= 60 then 9 else greatest(floor((lat + 60e0) / 12e0), -1)::int end "left", case when lat >= 60 then 9 else greatest(ceil((lat + 60e0) / 12e0) - 1, -1)::int end "right",
  least(greatest((lat + 60e0) / 12e0, 0), 10) frac from {POINTS}) select id, "left", "right", {r('frac')} frac from b""")
def g05_bin_index(spark, sf):
    x = F.col("lat")
    return points(spark, sf).select("id", grid.bin_index(x, -60.0, 12.0, 10).alias("left"), grid.bin_index(x, -60.0, 12.0, 10, right=True).alias("right"), R(grid.fractional_index(x, -60.0, 12.0, 11)).alias("frac"))


@query("select k::int \"index\", round((-90 + 22.5e0 * k + -90 + 22.5e0 * (k + 1)) / 2, 6) + 0 lat from range(8) t(k)")
def g05_bin_centers(spark, sf):
    return grid.bin_centers(grid.axis(spark, 8, -90.0, 90.0, "lat"), "lat").select("index", R(F.col("lat")).alias("lat"))


@query(f"select feature_id, round(quantile_cont(abs(x), 0.01), 6) + 0 q from {STEPS} group by feature_id")
def a18_damping_quantile(spark, sf):
    return steps(spark, sf).groupBy("feature_id").agg(R(F.percentile(F.abs("x"), F.lit(0.01))).alias("q"))


@query(f"select id, ((category % 8) + 8) % 8 color, case when width < 0 then 1e0 else 0.5e0 * width end width from {POINTS}")
def i11_feature_style(spark, sf):
    return points(spark, sf).select("id", F.pmod("category", F.lit(8)).alias("color"), F.when(F.col("width") < 0, 1.0).otherwise(F.col("width") * 0.5).alias("width"))
