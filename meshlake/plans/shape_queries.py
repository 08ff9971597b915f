"""Queries for hulls and rectangles, polygons of many edges, inverse projection, tables that are written and read back,
rasters of several cut sets, and the solvers. The twins state results in closed form or by recursion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..operators import cells, divides, features, interpolation, optimize, paths, polygon, sparse, weights
from ..sources import shape_files, sinks
from ..sources.fixtures import LINES, MESH, POINTS, STEPS, lat_of, lat_sql, lon_of, lon_sql, mesh, points, polylines, steps, table
from ..sources.scratch import shared_path
from .composed_queries import _inner, _INNER
from .line_queries import _GRID, _ISLES, _RINGS, _UNINHABITED, grid, planar_sql, region_sql, rings, sections, sections_sql
from .linear_queries import _a, _COAST as _NEAR, _elevation, _LATTICE, A_SQL
from .mesh_queries import _BINS, _cell, _FIRST, _GRADS, _OCC, _seam, _TARGETS, _WEIGHTS, COLUMNS, ROWS, _targets, _weights, bilinear_sql
from .raster_queries import refined_sql
from .registry import query

R = geo.rounded


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0"


# hulls: directed edges with all other vertices on their left
_HULL = f"""(with recursive p as (select feature_id, seq, x, y from {STEPS}),
e as (select a.feature_id, a.seq, b.seq nxt from p a join p b on a.feature_id = b.feature_id and a.seq <> b.seq join p c on a.feature_id = c.feature_id group by a.feature_id, a.seq, b.seq
  having bool_and(c.seq in (a.seq, b.seq) or (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0
    or ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 and (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) between 0 and pow(b.x - a.x, 2) + pow(b.y - a.y, 2)))),
s as (select feature_id, arg_min(seq, (x, y)) seq from p group by feature_id),
h as (select feature_id, seq, seq start, 0 k from s union all select h.feature_id, e.nxt, start, k + 1 from h join e on h.feature_id = e.feature_id and h.seq = e.seq where e.nxt <> start)
select feature_id, k, p.seq, x, y from h join p using (feature_id, seq))"""


@query(f"select feature_id, k::bigint seq, x, y from {_HULL}")
def t05_convex_hull(spark, sf):
    return paths.per_line(steps(spark, sf), ["feature_id"], ("x", "y"), paths.convex_hull, renumber=True)


@query(f"""with e as (select feature_id, k, x, y, coalesce(lag(x) over w, last_value(x) over u) px, coalesce(lag(y) over w, last_value(y) over u) py from {_HULL}
  window w as (partition by feature_id order by k), u as (partition by feature_id order by k rows between unbounded preceding and unbounded following)),
a as (select feature_id, k, case when x = px then pi() / 2 else atan((y - py) / (x - px)) end a from e),
b as (select feature_id, a.k, a, min(x * cos(-a) - y * sin(-a)) x0, max(x * cos(-a) - y * sin(-a)) x1, min(x * sin(-a) + y * cos(-a)) y0, max(x * sin(-a) + y * cos(-a)) y1 from a join e using (feature_id) group by feature_id, a.k, a),
m as (select feature_id, arg_min({{'a': a, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}}, (round((x1 - x0) * (y1 - y0), 6), k)) m from b group by feature_id),
t as (select feature_id, m.a a, (m.x0 + m.x1) / 2 cx, (m.y0 + m.y1) / 2 cy, m.x1 - m.x0 < m.y1 - m.y0 tall, case when m.a < 0 then -1e0 else 1e0 end s from m)
select feature_id, {r('case when tall then s * pi() / 2 - a else -a end')} rotation, {r('case when tall then s * cy else -cx end')} dx, {r('case when tall then -s * cx else -cy end')} dy from t""")
def a17_fit_in_rectangle(spark, sf):
    hull = paths.per_line(steps(spark, sf), ["feature_id"], ("x", "y"), paths.convex_hull, renumber=True)
    d = cells.fit_in_rectangle(hull, ["feature_id"])
    return d.select("feature_id", *[R(F.col(c)).alias(c) for c in ("rotation", "dx", "dy")])


@query(f"""with recursive p as (select o_custkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 i, row_number() over (partition by o_custkey order by (o_orderkey * 7919) % 1009, o_orderkey) - 1 v from orders),
r as (select k, i, i cur from p union all select r.k, r.i, p.v from r join p on r.k = p.k and r.cur = p.i where p.v <> r.i),
c as (select k, i, min(cur) m from r group by k, i) select k id, (count(*) - count(distinct m))::int swaps from c group by k""")
def t11_minimum_swaps(spark, sf):
    w = W.partitionBy("k")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderkey") * 7919 % 1009).alias("v"))
    d = o.select("k", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("i"), (F.row_number().over(w.orderBy("v", "o_orderkey")) - 1).alias("v"))
    d = d.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p")).select("k", F.transform("p", lambda x: x["v"]).alias("p"))  # one customer's orders

    def run(batches):
        for pdf in batches:
            yield pdf.assign(swaps=[optimize.minimum_swaps([int(v) for v in p]) for p in pdf["p"]])[["k", "swaps"]].rename(columns={"k": "id"})

    return d.mapInPandas(run, "id long, swaps int")


# sections whose edges are cut to half a degree: thousands of edges
_FINE = f"(select h, (row_number() over (partition by h order by seq, part) - 1)::int seq, lat, lon from {refined_sql(sections_sql('example'), 0.5)})"


def fine(spark):
    d = paths.refine(sections(spark, "example"), ["h"], 0.5)
    return d.select("h", (F.row_number().over(W.partitionBy("h").orderBy("seq", "part")) - 1).alias("seq"), "lat", "lon")


@query("select id, h, inside from " + planar_sql(POINTS, _FINE))
def p04_contains_many_edges(spark, sf):
    return polygon.contains(points(spark, sf), fine(spark), ["id"])


@query("select id, h from " + planar_sql(POINTS, _RINGS) + " where inside")
def p04_contained_in_many(spark, sf):
    return polygon.containing(points(spark, sf), rings(spark, sf), ["id"], planar=True)


_TURNED = f"(select h, case when h % 3 = 0 then 6 - seq else seq end seq, lat, lon from {_RINGS})"


@query("select id, h, inside from " + planar_sql(POINTS, _TURNED))
def p04_contains_many_turned(spark, sf):
    """Rings of either direction; a clockwise one contains what is outside."""
    d = rings(spark, sf).withColumn("seq", F.when(F.col("h") % 3 == 0, 6 - F.col("seq")).otherwise(F.col("seq")))
    return polygon.contains(points(spark, sf), d, ["id"])


@query(f"select id, max(case when inside then h end) section from {planar_sql(POINTS, _TURNED)} group by id")
def j05_last_of_many(spark, sf):
    d = rings(spark, sf).withColumn("seq", F.when(F.col("h") % 3 == 0, 6 - F.col("seq")).otherwise(F.col("seq")))
    return polygon.last_section(points(spark, sf), d).select("id", "section")


@query(f"select p.id, section from (select id from {POINTS}) p left join (select id, min(h) section from {region_sql(POINTS, _RINGS, 'id')} where inside group by id) using (id)")
def j04_first_of_many(spark, sf):
    return polygon.first_section(points(spark, sf), rings(spark, sf), ["id"]).select("id", "section")


_IN_FINE = f"(select p.*, s.section from {POINTS} p join (select id, max(case when inside then h end) section from {planar_sql(POINTS, _FINE)} group by id) s using (id))"


@query(bilinear_sql(_IN_FINE, "id, section"))
def i01_project_many_edges(spark, sf):
    d = interpolation.project_bilinear(polygon.last_section(points(spark, sf), fine(spark)), mesh(spark), ROWS, COLUMNS)
    return d.select("id", "section", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


_VERTICES = f"(select feature_id * 1000000000 + line * 10 + seq id, lat, lon from {_INNER})"


@query(bilinear_sql(f"(select f.*, s.section from (select feature_id * 1000000000 + line * 10 + seq id, * from {_INNER}) f join (select id, max(case when inside then h end) section from {planar_sql(_VERTICES, _FINE)} group by id) s using (id))", "feature_id, line, seq, section"))
def i06_project_features_many_edges(spark, sf):
    d = features.project_features(_inner(spark, sf), mesh(spark), fine(spark), ROWS, COLUMNS)
    return d.select("feature_id", "line", "seq", "section", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


# inverse projection
_CELL = f"""(select a.h, a.i ci, a.j cj, a.lat clat, a.lon clon, a.x swx, a.y swy, b.x sex, b.y sey, c.x nwx, c.y nwy, d.x nex, d.y ney from {MESH} a join {MESH} b on (b.h, b.i, b.j) = (a.h, a.i, a.j + 1) join {MESH} c on (c.h, c.i, c.j) = (a.h, a.i + 1, a.j)
  join {MESH} d on (d.h, d.i, d.j) = (a.h, a.i + 1, a.j + 1) where a.x is not null and b.x is not null and c.x is not null and d.x is not null)"""


def _left_of(a: str, b: str) -> str:
    return f"(x - {a}x) * (y - {b}y) - (x - {b}x) * (y - {a}y) >= 0"


_S = "1e-9"
_INVERSE = f"""(with n as (select id, x, y, h, i, j, d2 from (select t.id, t.x, t.y, h, i, j, pow(t.x - m.x, 2) + pow(t.y - m.y, 2) d2, row_number() over (partition by t.id, h order by pow(t.x - m.x, 2) + pow(t.y - m.y, 2), i, j) rn from {_TARGETS} t, {MESH} m where m.x is not null) where rn = 1),
v as (select h, i, j, x is not null there from {MESH}),
g as (select n.*, m.lat + case when not coalesce(s.there, false) then 0.1e0 when not coalesce(u.there, false) then -0.1e0 else 0 end glat, m.lon + case when not coalesce(w.there, false) then 0.1e0 when not coalesce(e.there, false) then -0.1e0 else 0 end glon from n join {MESH} m on (m.h, m.i, m.j) = (n.h, n.i, n.j)
  left join v s on (s.h, s.i, s.j) = (n.h, n.i - 1, n.j) left join v u on (u.h, u.i, u.j) = (n.h, n.i + 1, n.j) left join v w on (w.h, w.i, w.j) = (n.h, n.i, n.j - 1) left join v e on (e.h, e.i, e.j) = (n.h, n.i, n.j + 1)),
c as (select g.id, g.x, g.y, q.*, abs(ci - i) + least(abs(cj - j), 16 - abs(cj - j)) * sin(ci / 7e0 * pi()) dist from g join {_CELL} q on g.h = q.h),
f as (select * from (select *, row_number() over (partition by id, h order by dist, ci, cj) rn from c where dist <= 6 and {_left_of('ne', 'nw')} and {_left_of('nw', 'sw')} and {_left_of('sw', 'se')} and {_left_of('se', 'ne')}) where rn = 1),
k as (select *, nwx - swx lx, nwy - swy ly, sex - swx ex, sey - swy ey, x - swx px, y - swy py, nex - sex - nwx + swx rx, ney - sey - nwy + swy ry from f),
q as (select *, rx * -ly - ry * -lx a, (rx * py - ry * px) + (ex * -ly - ey * -lx) b, ex * py - ey * px c from k),
t as (select *, case when abs(a) <= 1e-12 * (abs(b) + abs(c)) then -c / b when b * b - 4 * a * c >= -{_S} * b * b then (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) end one,
  case when abs(a) <= 1e-12 * (abs(b) + abs(c)) then -c / b when b * b - 4 * a * c >= -{_S} * b * b then (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) end two from q),
u as (select *, case when one > 0 and one < 1 then one when two > 0 and two < 1 then two when one between -{_S} and 1 + {_S} then one when two between -{_S} and 1 + {_S} then two end t from t),
z as (select *, case when abs(ex + t * rx) >= abs(ey + t * ry) then (px - t * lx) / (ex + t * rx) else (py - t * ly) / (ey + t * ry) end s from u),
e as (select id, h, clat + t * 22.5e0 lat, clon + s * 22.5e0 lon from z where s between -{_S} and 1 + {_S}),
d as (select g.id, g.h, case when e.lat is not null then 0e0 else d2 end closeness, coalesce(e.lat, glat) lat, coalesce(e.lon, glon) lon, e.lat is not null exact from g left join e on (e.id, e.h) = (g.id, g.h)),
i as (select id // 10 id, id % 10 h from {region_sql('(select id * 10 + h id, lat, lon from d)', sections_sql('example'), 'id')} w where inside and w.h = id % 10)
select d.id, arg_max((d.lat, d.lon), (d.h, d.lat, d.lon)) filter (exact and i.id is not null) own, arg_min((d.lat, d.lon), (closeness, d.h, d.lat, d.lon)) near from d left join i on (i.id, i.h) = (d.id, d.h) group by d.id)"""


@query(f"select id, {r('coalesce(own, near)[1]', 5)} lat, {r('coalesce(own, near)[2]', 5)} lon from {_INVERSE}")
def i08_inverse_project(spark, sf):
    d = interpolation.inverse_project(_targets(spark), mesh(spark), sections(spark, "example"), ROWS, COLUMNS)
    return d.select("id", R(F.col("lat"), 5).alias("lat"), R(F.col("lon"), 5).alias("lon"))


@query(f"""with u as (select distinct i + a i, j + b j from {_OCC}, (values (0), (1)) s(a), (values (0), (1)) t(b)), t as (select id, round((x + 12000e0) / 1200e0)::int i, round((y + 6000e0) / 600e0)::int j from {_TARGETS})
select id, case when u.i is not null then {r('coalesce(own, near)[1]', 5)} end lat, case when u.i is not null then {r('coalesce(own, near)[2]', 5)} end lon from {_INVERSE} join t using (id) left join u on (u.i, u.j) = (t.i, t.j)""")
def i08_inverse_raster(spark, sf):
    """Targets far from all nodes are null."""
    d = interpolation.inverse_project(_targets(spark), mesh(spark), sections(spark, "example"), ROWS, COLUMNS, _BINS)
    return d.select("id", R(F.col("lat"), 5).alias("lat"), R(F.col("lon"), 5).alias("lon"))


# what is written and read back
@query(f"select h, i, j, lat, lon, x, y from {MESH}")
def k01_saved_mesh(spark, sf):
    path = shared_path(spark, "mesh")
    sinks.save_mesh(mesh(spark), sections(spark, "example"), path)
    return sinks.load_mesh(spark, path)[0].select("h", "i", "j", "lat", "lon", "x", "y")


@query(f"select h, seq, lat, lon from {sections_sql('example')}")
def s11_saved_borders(spark, sf):
    path = shared_path(spark, "mesh")
    sinks.save_mesh(mesh(spark), sections(spark, "example"), path)
    return sinks.load_mesh(spark, path)[1]


def _saved_weights(spark):
    path = shared_path(spark, "weights")
    w = _weights(spark)
    sets = [("a", "land", False, "shape"), ("a", "land", True, "scale"), ("b", "sea", False, "scale")]
    rows = None
    for name, kind, crop, value in sets:
        own = w.select(F.lit(name).alias("cut_set"), "h", F.lit(kind).alias("kind"), F.lit(crop).alias("crop"), "i", "j", F.col(value).alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    sinks.save_weights(rows, path)
    return path


@query(f"select h, i, j, scale \"value\" from {_WEIGHTS}")
def s04_load_pixel_values(spark, sf):
    return sinks.load_weights(spark, _saved_weights(spark), "a", "land", True)


@query(f"select h, i, j, shape \"value\" from {_WEIGHTS}")
def k02_saved_weights(spark, sf):
    return sinks.load_weights(spark, _saved_weights(spark), "a", "land", False)


@query(f"select h, i, j, 1e0 \"value\" from {_WEIGHTS}")
def s04_uniform_weights(spark, sf):
    return sinks.load_weights(spark, None, cells=_weights(spark))


@query(f"select h, count(x) nodes, min(x) x_min, max(y) y_max, {r('(select (max(x) - min(x)) / (max(y) - min(y)) from ' + MESH + ')', 9)} aspect from {MESH} group by h")
def s12_saved_projection(spark, sf):
    path = shared_path(spark, "projection")
    m = mesh(spark)
    sinks.save_projection({"mesh": m, "border": sections(spark, "example"), "boundary": sections(spark, "example").where("h = 0"), "bbox": cells.bounding_box(m)}, path)
    got, _, _, aspect = sinks.load_projection(spark, path)
    return got.groupBy("h").agg(F.count("x").alias("nodes"), F.min("x").alias("x_min"), F.max("y").alias("y_max")).withColumn("aspect", R(F.lit(aspect), 9))


@query(f"select h::bigint h, (seq - 1)::int seq, lat, lon from (select h % 7 source, (row_number() over (partition by h % 7 order by h, seq) - 1) // 5 h, seq, lat, lon from {_RINGS}) where source = 3")
def s06_load_land_polygons(spark, sf):
    """Rings written as shape files, a file for a seventh of them, and read back."""
    d = rings(spark, sf).withColumn("file", F.col("h") % 7)

    def encode(pdf):  # pandas DataFrame in, pandas DataFrame out: one file
        import pandas as pd

        shapes = [[g.sort_values("seq")[["lon", "lat"]].to_numpy()] for _, g in pdf.groupby("h")]
        return pd.DataFrame({"source": [str(pdf["file"].iloc[0])], "content": [shape_files.encode_shapes(shapes)]})

    files = d.groupBy("file").applyInPandas(encode, "source string, content binary")
    return shape_files.load_land_polygons(shape_files.shape_rows(files)).where("source = '3'").select("h", "seq", "lat", "lon")


_COAST = f"(select (o_custkey % 10)::varchar source, o_custkey shape_id, o_orderkey seq, {lat_sql('o_orderkey')} lat, {lon_sql('o_orderkey')} lon from orders)"


@query(f"""with recursive v as (select *, row_number() over (partition by source order by shape_id, seq) rn from {_COAST}),
k as (select source, shape_id, seq, lat, lon, rn, true far, lat klat, lon klon from v where rn = 1
  union all select source, shape_id, seq, lat, lon, rn, far, case when far then lat else klat end, case when far then lon else klon end from (
    select v.*, k.klat, k.klon, sqrt(pow(v.lat - k.klat, 2) + pow((v.lon - k.klon) * cos(radians((v.lat + k.klat) / 2)), 2)) > 25e0 far from k join v on v.source = k.source and v.rn = k.rn + 1))
select source, shape_id, seq, lat, lon from k where far and not ({_ISLES})""")
def s05_load_coast_vertices(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = o.select((F.col("o_custkey") % 10).cast("string").alias("source"), F.col("o_custkey").alias("shape_id"), k.alias("seq"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    return features.thin_coast(d, 25.0)


# rasters of several cut sets, with and without Antarctica
_SEEN = {False: f"({_ISLES})", True: f"({_UNINHABITED})"}
_VERTEX = f"(select distinct {lat_sql('s_suppkey')} lat, {lon_sql('s_suppkey')} lon from supplier)"


def _raster_sql(name: str, land: bool, crop: bool) -> str:
    polys, seen = sections_sql(name), f"(select * from {_VERTEX} where not {_SEEN[crop]})"
    keyed = f"(select row_number() over (order by lat, lon) id, lat, lon from {seen})"
    return f"""(with e as (select coalesce(lag(lat) over w, last_value(lat) over u) lat0, coalesce(lag(lon) over w, last_value(lon) over u) lon0, lat lat1, lon lon1 from {_RINGS} window w as (partition by h order by seq), u as (partition by h order by seq rows between unbounded preceding and unbounded following)),
x as (select i, j, count(*) n from {_GRID} g join e on (lon0 < lon) <> (lon1 < lon) and lat0 + (lon - lon0) / (lon1 - lon0) * (lat1 - lat0) < lat where lon0 <> lon1 group by i, j),
l as (select i, j, {'' if land else 'not '}(coalesce(n, 0) % 2 = 1 and not {_SEEN[crop]}) land from {_GRID} left join x using (i, j)),
s as (select h, inside, g.* from {region_sql('(select i * 100 + j id, lat, lon from ' + _GRID + ')', polys, 'id')} q join {_GRID} g on q.id = g.i * 100 + g.j),
c as (select v.h, d.lat, d.lon from {keyed} d join {region_sql(keyed, polys, 'id')} v using (id) where inside),
m as (select s.h, i, j, min(degrees(acos(greatest(-1e0, least(1e0, cos(radians(s.lat)) * cos(radians(c.lat)) * cos(radians(s.lon - c.lon)) + sin(radians(s.lat)) * sin(radians(c.lat))))))) d from s join c on s.h = c.h group by s.h, i, j)
select '{name}' cut_set, '{'land' if land else 'sea'}' kind, {str(crop).lower()} crop, s.h, s.i, s.j, {r('case when inside and land then 1e0 else coalesce(pow(greatest(0e0, 1 - d / 6e0), 2), 0e0) end')} "value" from s join l using (i, j) left join m on (m.h, m.i, m.j) = (s.h, s.i, s.j))"""


_SETS = {"basic": True, "oceans": True, "example": False}


@query(" union all ".join(f"select * from {_raster_sql(n, land, crop)}" for n, land in _SETS.items() for crop in ((False, True) if land else (False,))))
def g10_calculate_rasters(spark, sf):
    k = F.col("s_suppkey")
    coast = table(spark, sf, "supplier").select(lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    d = weights.calculate_rasters(grid(spark), coast, rings(spark, sf), {n: (sections(spark, n), land) for n, land in _SETS.items()})
    return d.withColumn("value", R(F.col("value")))


# drainage: the lowest place of the highest path
@query(f"""with recursive e as (select * from {_LATTICE}), r as (select i, j, z from e where i = 9 and j = 13
  union select e.i, e.j, least(e.z, r.z) from r join e on abs(e.i - r.i) <= 1 and (abs(e.j - r.j) <= 1 or abs(e.j - r.j) = 17) and (e.i <> r.i or e.j <> r.j))
select 0 cut, 9 i0, 13 j0, 2 i1, 3 j1, max(z) lowest from r where i = 2 and j = 3""")
def l16_drainage_divides(spark, sf):
    z = {(x.i, x.j): x.z + 501.0 for x in _elevation(spark).collect()}  # a cropped lattice of 216 nodes, lifted above water
    cuts = divides.drainage_divides(z, [(2, 3), (9, 13)], 18)
    rows = [(k, *c[0], *c[-1], float(min(z[p] for p in c)) - 501.0) for k, c in enumerate(cuts)]
    return spark.createDataFrame(rows, "cut int, i0 int, j0 int, i1 int, j1 int, lowest double")


# solvers, fed by aggregates of the points of each nation
@query("""with n as (select k rows, greatest(floor(ln(k / 10e0))::int + 1, 1) m from (values (10), (21), (49), (97), (200), (1801)) t(k)),
f as (select rows, m, s, case when s = m - 1 and m > 1 then 1 else round(pow(10, log10(rows / 10e0) * (1 - s / greatest(m - 1, 1)::double))) end::int f from (select rows, m, unnest(generate_series(0, m - 1)) s from n))
select rows, 0 pass, f factor, 0 bound, false strict from f where s = 0 union all select rows, 1, f, 0, true from f where s = 0 union all select rows, (2 + s)::int, f, f, true from f union all select rows, (2 + m)::int, 0, 1, true from n""")
def l14_schedule(spark, sf):
    rows = [(n, k, a, b, c) for n in (10, 21, 49, 97, 200, 1801) for k, (a, b, c) in enumerate(optimize.schedule(n))]
    return spark.createDataFrame(rows, "rows int, pass int, factor int, bound int, strict boolean")


_MOMENTS = f"""(select category k, count(*) n, avg(lat) ma, avg(lon) mb, avg(width) mz, sum((lat - a) * (lat - a)) / 1e4 saa, sum((lon - b) * (lon - b)) / 1e4 sbb, sum((lat - a) * (lon - b)) / 1e4 sab, sum((lat - a) * (width - z)) / 1e4 saz, sum((lon - b) * (width - z)) / 1e4 sbz
  from (select *, avg(lat) over (partition by category) a, avg(lon) over (partition by category) b, avg(width) over (partition by category) z from {POINTS}) group by category)"""


def _moments(spark, sf):
    w = W.partitionBy("category")
    p = points(spark, sf).select(F.col("category").alias("k"), "lat", "lon", "width", *[F.avg(c).over(w).alias(n) for c, n in (("lat", "a"), ("lon", "b"), ("width", "z"))])
    a, b, z = F.col("lat") - F.col("a"), F.col("lon") - F.col("b"), F.col("width") - F.col("z")
    sums = [(F.sum(x) / 1e4).alias(n) for x, n in ((a * a, "saa"), (b * b, "sbb"), (a * b, "sab"), (a * z, "saz"), (b * z, "sbz"))]
    return p.groupBy("k").agg(F.count("*").alias("n"), F.avg("lat").alias("ma"), F.avg("lon").alias("mb"), F.avg("width").alias("mz"), *sums)


def _solved(d, solve, names: str):
    """``k`` and what ``solve`` makes of each row of moments: a row per nation."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            got = [solve(row) for row in pdf.itertuples()]
            yield pd.DataFrame([(int(row.k), *g) for row, g in zip(pdf.itertuples(), got)], columns=["k", *[n.split()[0] for n in names.split(", ")]])

    return d.mapInPandas(run, "k long, " + names)


@query(f"select k::bigint k, {r('(saz * sbb - sbz * sab) / (saa * sbb - sab * sab)', 4)} slope_lat, {r('(sbz * saa - saz * sab) / (saa * sbb - sab * sab)', 4)} slope_lon from {_MOMENTS}")
def l10_minimize(spark, sf):
    """Per nation the plane nearest to the widths, by damped Newton steps over aggregated moments."""

    def solve(m):
        h, g = np.array([[m.saa, m.sab], [m.sab, m.sbb]]), np.array([m.saz, m.sbz])
        got = optimize.minimize(lambda x: (x @ h @ x / 2 - g @ x, h @ x - g, h), np.zeros(2), 1e-9)
        return round(float(got.state[0]), 4) + 0.0, round(float(got.state[1]), 4) + 0.0

    return _solved(_moments(spark, sf), solve, "slope_lat double, slope_lon double")


@query(f"select k::bigint k, {r('least(ma, 5e0)', 2)} a, {r('least(mb, 8e0)', 2)} b from {_MOMENTS}")
def l11_minimize_with_bounds(spark, sf):
    """Per nation the point nearest to the mean place inside bounds, by the barrier method."""

    def solve(m):
        t = np.array([m.ma, m.mb])
        got = optimize.minimize_with_bounds(lambda x: (float((x - t) @ (x - t)) / 2, x - t, np.eye(2)), np.array([-120.0, -200.0]), 1e-6, np.eye(2), np.array([5.0, 8.0]), 1e-5)
        return tuple(round(float(v), 2) + 0.0 for v in got.state)

    return _solved(_moments(spark, sf), solve, "a double, b double")


@query(f"select k::bigint k, {r('((saz) * (sbb + 1) - (sbz) * sab) / ((saa + 1) * (sbb + 1) - sab * sab)', 5)} a, {r('((sbz) * (saa + 1) - (saz) * sab) / ((saa + 1) * (sbb + 1) - sab * sab)', 5)} b from {_MOMENTS}")
def l07_inverse_matmul(spark, sf):
    def solve(m):
        got = optimize.inverse_matmul(np.array([[m.saa + 1, m.sab], [m.sab, m.sbb + 1]]), np.array([m.saz, m.sbz]))
        return tuple(round(float(v), 5) + 0.0 for v in got)

    return _solved(_moments(spark, sf), solve, "a double, b double")


@query(f"select k::bigint k, saa - k * n / 100 > 0 and (saa - k * n / 100) * (sbb - k * n / 100) - sab * sab > 0 definite from {_MOMENTS}")
def l08_is_positive_definite(spark, sf):
    def solve(m):
        t = m.k * m.n / 100
        return (optimize.is_positive_definite(np.array([[m.saa - t, m.sab], [m.sab, m.sbb - t]])),)

    return _solved(_moments(spark, sf), solve, "definite boolean")


_X, _Y = "lat", "(lon + 200e0)"
_DERIVED = {
    "f": f"exp({_X} / 50) * sqrt({_Y}) + pow({_X}, 3) / {_Y}", "fx": f"exp({_X} / 50) / 50 * sqrt({_Y}) + 3 * {_X} * {_X} / {_Y}", "fy": f"exp({_X} / 50) / (2 * sqrt({_Y})) - pow({_X}, 3) / ({_Y} * {_Y})",
    "fxx": f"exp({_X} / 50) / 2500 * sqrt({_Y}) + 6 * {_X} / {_Y}", "fxy": f"exp({_X} / 50) / (100 * sqrt({_Y})) - 3 * {_X} * {_X} / ({_Y} * {_Y})", "fyy": f"-exp({_X} / 50) / (4 * pow({_Y}, 1.5e0)) + 2 * pow({_X}, 3) / pow({_Y}, 3)",
}


@query(f"select id, {', '.join(f'{r(v)} {k}' for k, v in _DERIVED.items())} from {POINTS}")
def l09_autodiff(spark, sf):
    """Value, gradient and Hessian of a function of each point's place, from the function alone."""

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            x, y = (optimize.Variable(v.to_numpy(float), np.tile(np.eye(2)[k], (n, 1)), np.zeros((n, 2, 2))) for k, v in enumerate((pdf["lat"], pdf["lon"] + 200.0)))
            f = (x * (1 / 50)).exp() * y.sqrt() + x**3 / y
            g, h = f.gradient, f.hessian
            yield pdf[["id"]].assign(f=f.value, fx=g[:, 0], fy=g[:, 1], fxx=h[:, 0, 0], fxy=h[:, 0, 1], fyy=h[:, 1, 1])

    d = points(spark, sf).select("id", "lat", "lon").mapInPandas(run, "id long, f double, fx double, fy double, fxx double, fxy double, fyy double")
    return d.select("id", *[R(F.col(c)).alias(c) for c in _DERIVED])


@query(f"select id, {r('greatest(-60e0, least(60e0, lat))', 5)} lat, {r('greatest(-100e0, least(100e0, lon))', 5)} lon from {POINTS}")
def l12_polytope_project(spark, sf):
    """Points moved to the nearest place of a box."""
    box, limits = np.array([[1.0, 0], [-1, 0], [0, 1], [0, -1]]), np.array([60.0, 60, 100, 100])

    def run(batches):
        for pdf in batches:
            got = np.array([optimize.polytope_project(p, box, limits) for p in pdf[["lat", "lon"]].to_numpy(float)]).reshape(-1, 2)
            yield pdf[["id"]].assign(lat=got[:, 0], lon=got[:, 1])

    d = points(spark, sf).select("id", "lat", "lon").mapInPandas(run, "id long, lat double, lon double")
    return d.select("id", R(F.col("lat"), 5).alias("lat"), R(F.col("lon"), 5).alias("lon"))


# the farthest vertex of a stretch parts it, until none is far
_PIECES = f"(select feature_id f, seq, lat, lon, sum(jump) over (partition by feature_id order by seq) piece, row_number() over (partition by feature_id order by seq) k from (select *, case when abs(lon - lag(lon) over (partition by feature_id order by seq)) > 180 then 1 else 0 end jump from {LINES}))"


@query(f"""with recursive p as (select * from {_PIECES}), r as (select f, piece, min(k) a, max(k) z from p group by f, piece
  union all select f, piece, unnest([a, m]) a, unnest([m, z]) z from (select f, piece, a, z, arg_max(k, (far, -k)) m, max(far) far from (
    select r.f, r.piece, r.a, r.z, c.k, sqrt(greatest(0, pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2) - pow(((c.lat - s.lat) * (e.lat - s.lat) + (c.lon - s.lon) * (e.lon - s.lon))
      / case when s.lat = e.lat and s.lon = e.lon then 1 else sqrt(pow(e.lat - s.lat, 2) + pow(e.lon - s.lon, 2)) end, 2))) far
    from r join p s on s.f = r.f and s.k = r.a join p e on e.f = r.f and e.k = r.z join p c on c.f = r.f and c.k > r.a and c.k < r.z) group by f, piece, a, z) where far >= 20e0)
select f feature_id, seq, lat, lon from p semi join (select f, a k from r union select f, z from r) using (f, k)""")
def w10_decimate_path(spark, sf):
    return paths.per_line(polylines(spark, sf), ["feature_id"], ("lat", "lon"), lambda p: paths.decimated(p, 20.0, wrap=True))


def _slope_sql(c: str, axis: int) -> str:
    def part(k, p, q):
        value = {0: "(2 * {t} * {t} * {t} - 3 * {t} * {t} + 1)", 1: "(3 * {t} * {t} - 2 * {t} * {t} * {t})"}
        slope = {0: "({t} * {t} * {t} - 2 * {t} * {t} + {t})", 1: "({t} * {t} * {t} - {t} * {t})"}
        dvalue = {0: "((6 * {t} * {t} - 6 * {t}) / 22.5e0)", 1: "((6 * {t} - 6 * {t} * {t}) / 22.5e0)"}
        dslope = {0: "((3 * {t} * {t} - 4 * {t} + 1) / 22.5e0)", 1: "((3 * {t} * {t} - 2 * {t}) / 22.5e0)"}
        u, su = ((dvalue, dslope) if axis == 0 else (value, slope))
        v, sv = ((dvalue, dslope) if axis == 1 else (value, slope))
        u, su, v, sv = u[p].format(t="u"), su[p].format(t="u"), v[q].format(t="v"), sv[q].format(t="v")
        return f"{u} * {v} * {k}.{c} + {su} * 22.5e0 * {v} * {k}.{c}_lat + {u} * {sv} * 22.5e0 * {k}.{c}_lon"

    return " + ".join(part(k, p, q) for k, p, q in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)))


@query(f"""with g as (select * from {_GRADS}) select id, section, {r(_slope_sql('x', 0), 4)} x_lat, {r(_slope_sql('y', 0), 4)} y_lat, {r(_slope_sql('x', 1), 4)} x_lon, {r(_slope_sql('y', 1), 4)} y_lon from {_cell(_FIRST)} p left join g a on (p.section, p.i, p.j) = (a.h, a.i, a.j)
  left join g b on (p.section, p.i, p.j + 1) = (b.h, b.i, b.j) left join g c on (p.section, p.i + 1, p.j) = (c.h, c.i, c.j) left join g d on (p.section, p.i + 1, p.j + 1) = (d.h, d.i, d.j)""")
def i03_derivatives(spark, sf):
    p = polygon.first_section(points(spark, sf), sections(spark, "example"), ["id"])
    by_lat, by_lon = (interpolation.project_hermite(p, _seam(spark), ROWS, COLUMNS, k) for k in (0, 1))
    d = by_lat.select("id", "section", F.col("x").alias("x_lat"), F.col("y").alias("y_lat")).join(by_lon.select("id", F.col("x").alias("x_lon"), F.col("y").alias("y_lon")), "id")
    return d.select("id", "section", *[R(F.col(c), 4).alias(c) for c in ("x_lat", "y_lat", "x_lon", "y_lon")])


@query(f"select \"row\", col, val from {A_SQL} union all select \"row\" + 2000, col, -val from {A_SQL}")
def u06_both_signs(spark, sf):
    """Constraints from above and from below."""
    return sparse.stack([(_a(spark, sf), 2000), (sparse.scale(_a(spark, sf), -1.0), 2000)])


@query(f"""select h, i, j, {r('min(d)')} distance from (select h, i, j, degrees(acos(greatest(-1e0, least(1e0, cos(radians(g.lat)) * cos(radians(c.lat)) * cos(radians(g.lon - c.lon)) + sin(radians(g.lat)) * sin(radians(c.lat)))))) d from {_GRID} g, {_NEAR} c) group by h, i, j""")
def j06_coast_distance_everywhere(spark, sf):
    """Every pixel of every section, however far its coast."""
    k = F.col("s_suppkey")
    coast = table(spark, sf, "supplier").select((k % 3).alias("h"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    return weights.coast_distance(grid(spark), coast, 180.0).select("h", "i", "j", R(F.col("distance")).alias("distance"))
