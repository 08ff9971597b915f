"""Queries for scalar geometry and predicates, over points of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..sources.fixtures import POINTS, mesh, mesh_sql, points
from .registry import query

R = geo.rounded
_A, _E2 = repr(geo.EARTH.a), repr(geo.EARTH.e2)


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0"


@query(f"select id, {r('x - floor((x + 180e0) / 360e0) * 360e0')} wrapped, {r('x - floor((x + 3e0) / 6e0) * 6e0')} small from (select id, lon * 3e0 + lat x from {POINTS})")
def m01_wrap_angle(spark, sf):
    p = points(spark, sf).withColumn("x", F.col("lon") * 3.0 + F.col("lat"))
    return p.select("id", R(geo.wrap_angle("x")).alias("wrapped"), R(geo.wrap_angle("x", 6.0)).alias("small"))


@query(f"select id, {r('cos(radians(lat)) * cos(radians(lon))')} x, {r('cos(radians(lat)) * sin(radians(lon))')} y, {r('sin(radians(lat))')} z from {POINTS}")
def m02_to_cartesian(spark, sf):
    p = points(spark, sf).select("id", geo.to_cartesian("lat", "lon").alias("c"))
    return p.select("id", *[R(F.col(f"c.{k}")).alias(k) for k in "xyz"])


_ROT = """(select id, sin(p0) * cos(p) * cos(q - q0) - cos(p0) * sin(p) x, cos(p) * sin(q - q0) y, cos(p0) * cos(p) * cos(q - q0) + sin(p0) * sin(p) z
  from (select id, radians(lat) p, radians(lon) q, 0.4e0 p0, -1.1e0 q0 from {t}))"""


@query(f"select id, {r('pi() / 2 - atan2(z, sqrt(x * x + y * y))')} distance, {r('atan2(y, x)')} bearing from {_ROT.format(t=POINTS)}")
def m03_rotated_coordinates(spark, sf):
    p = points(spark, sf).select("id", geo.rotated_coordinates(0.4, -1.1, F.radians("lat"), F.radians("lon")).alias("c"))
    return p.select("id", R(F.col("c.distance")).alias("distance"), R(F.col("c.bearing")).alias("bearing"))


def _rot_sql(p0: str, q0: str, p: str, q: str) -> tuple[str, str]:
    x = f"(sin({p0}) * cos({p}) * cos({q} - {q0}) - cos({p0}) * sin({p}))"
    y = f"(cos({p}) * sin({q} - {q0}))"
    z = f"(cos({p0}) * cos({p}) * cos({q} - {q0}) + sin({p0}) * sin({p}))"
    return f"(pi() / 2 - atan2({z}, sqrt({x} * {x} + {y} * {y})))", f"atan2({y}, {x})"


_D, _T = _rot_sql("p0", "q0", "p", "q")
_D0, _T0 = _rot_sql("p0", "q0", "gp", "gq")
_, _BETA = _rot_sql("gp", "gq", "p0", "q0")


@query(f"""select id, {r('s * (x * cos(w) - y * sin(w))', 4)} x, {r('s * (x * sin(w) + y * cos(w))', 4)} y from (
  select id, tan(d / 2) * sin(t) - tan(d0 / 2) * sin(t0) x, tan(d0 / 2) * cos(t0) - tan(d / 2) * cos(t) y, 3 * {_A} * cos(d0 / 2) * cos(d0 / 2) s, beta - t0 - pi() w from (
    select id, {_D} d, {_T} t, {_D0} d0, {_T0} t0, {_BETA} beta from (
      select id, radians(lat) p, radians(lon) q, 0.3e0 p0, 0.9e0 q0, radians(5e0) gp, radians(20e0) gq from {POINTS} where abs(lat - 17e0) < 60 and abs(lon - 51e0) < 60)))""")
def m04_oblique_stereographic(spark, sf):
    p = points(spark, sf).where((F.abs(F.col("lat") - 17.0) < 60) & (F.abs(F.col("lon") - 51.0) < 60))
    p = p.select("id", geo.oblique_stereographic("lat", "lon", (0.3, 0.9), (5.0, 20.0)).alias("c"))
    return p.select("id", R(F.col("c.x"), 4).alias("x"), R(F.col("c.y"), 4).alias("y"))


@query(f"select id, {r('case when lat <> category then (7e0 - category) / (lat - category) * (lon - width) + width end')} y from {POINTS}")
def m05_interp(spark, sf):
    return points(spark, sf).select("id", R(geo.interp(7.0, "category", "lat", "width", "lon")).alias("y"))


@query(f"select id, {r('lat / greatest(abs(lat), abs(lon))')} a, {r('lon / greatest(abs(lat), abs(lon))')} b, {r('0e0')} zero from {POINTS}")
def m06_normalize(spark, sf):
    p = points(spark, sf).select("id", geo.normalize("lat", "lon").alias("v"), geo.normalize(0.0, 0.0).alias("z"))
    return p.select("id", R(F.col("v")[0]).alias("a"), R(F.col("v")[1]).alias("b"), R(F.col("z")[0]).alias("zero"))


@query(f"select id, {r('lat / sqrt(lat * lat + lon * lon)')} x, {r('lon / sqrt(lat * lat + lon * lon)')} y from {POINTS}")
def m07_vector_normalize(spark, sf):
    p = points(spark, sf).select("id", geo.vector_normalize("lat", "lon").alias("v"))
    return p.select("id", R(F.col("v.x")).alias("x"), R(F.col("v.y")).alias("y"))


@query(f"select id, {r('lat * cos(0.7e0) - lon * sin(0.7e0) + 3e0')} x, {r('lat * sin(0.7e0) + lon * cos(0.7e0) - 2e0')} y from {POINTS}")
def m08_rotate_and_shift(spark, sf):
    p = points(spark, sf).select("id", geo.rotate_and_shift("lat", "lon", 0.7, 3.0, -2.0).alias("v"))
    return p.select("id", R(F.col("v.x")).alias("x"), R(F.col("v.y")).alias("y"))


@query(f"select id, {r('((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2 + ((x2 - x0) * (y3 - y0) - (y2 - y0) * (x3 - x0)) / 2', 4)} area from (select id, lat x0, lon y0, lat + 3e0 x1, lon - 1e0 y1, lat + category x2, lon + 5e0 y2, lat - 2e0 x3, lon + width / 997e0 y3 from {POINTS})")
def m09_polygon_area(spark, sf):
    c = F.col
    corners = [("lat", "lon"), (c("lat") + 3.0, c("lon") - 1.0), (c("lat") + c("category"), c("lon") + 5.0), (c("lat") - 2.0, c("lon") + c("width") / 997.0)]
    return points(spark, sf).select("id", R(geo.polygon_area(corners), 4).alias("area"))


@query(f"""with v as (select id, lat bx, lon by_, category - lat px, 3e0 py, width / 1e3 - lat qx, 10e0 - lon qy from {POINTS}),
u as (select id, bx, by_, qx / sqrt(qx * qx + qy * qy) ox, qy / sqrt(qx * qx + qy * qy) oy, -px / sqrt(px * px + py * py) ix, -py / sqrt(px * px + py * py) iy from v),
w as (select *, ox - ix dx, oy - iy dy, sqrt((ox - ix) * (ox - ix) + (oy - iy) * (oy - iy)) n from u)
select id, {r('bx - 2e0 * case when n > 1e-4 then dx / n else -oy end')} x, {r('by_ - 2e0 * case when n > 1e-4 then dy / n else ox end')} y from w""")
def m10_offset_from_angle(spark, sf):
    c = F.col
    before, after = (c("lat") + (c("category") - c("lat")), c("lon") + 3.0), (c("width") / 1e3, F.lit(10.0))
    p = points(spark, sf).select("id", geo.offset_from_angle(before, ("lat", "lon"), after, 2.0).alias("v"))
    return p.select("id", R(F.col("v.x")).alias("x"), R(F.col("v.y")).alias("y"))


def _rows(spark):
    return mesh(spark).where("h = 0 and j = 0 and i between 1 and 7")


_ROWS = f"(select * from {mesh_sql()} where h = 0 and j = 0 and i between 1 and 7)"


@query(f"""select i, {r(f'{_A} * radians(22.5e0) * (1 - {_E2}) * pow(1 - {_E2} * sin(radians(lat)) * sin(radians(lat)), 1.5e0)')} row_height,
  {r(f'{_A} * radians(22.5e0) * pow(1 + (1 - {_E2}) * tan(radians(lat)) * tan(radians(lat)), -0.5e0)')} column_width from {_ROWS}""")
def m11_ellipsoid_cells(spark, sf):
    return _rows(spark).select("i", R(geo.ellipsoid_row_height("lat", 22.5)).alias("row_height"), R(geo.ellipsoid_column_width("lat", 22.5)).alias("column_width"))


@query(f"select i, {r(f'{_A} * {_A} * (sin(radians(lat + 22.5e0)) - sin(radians(lat))) * radians(22.5e0)', 2)} area from {_ROWS}")
def m12_spherical_cell_area(spark, sf):
    return _rows(spark).select("i", R(geo.spherical_cell_area("lat", F.col("lat") + 22.5, 22.5), 2).alias("area"))


@query(f"""select id, {r('degrees(acos(greatest(-1e0, least(1e0, cos(p) * cos(q) * cos(p0) * cos(q0) + cos(p) * sin(q) * cos(p0) * sin(q0) + sin(p) * sin(p0)))))')} distance
  from (select id, radians(lat) p, radians(lon) q, radians(12.5e0) p0, radians(-33e0) q0 from {POINTS})""")
def m13_angular_distance(spark, sf):
    return points(spark, sf).select("id", R(geo.angular_distance("lat", "lon", 12.5, -33.0)).alias("distance"))


@query(f"select id, {r('case when category = 3 then 1e0 else coalesce(pow(greatest(0e0, 1 - d / 6e0), 2), 0e0) end')} importance from (select id, category, case when category <> 5 then abs(lat) / 10e0 end d from {POINTS})")
def m14_importance(spark, sf):
    p = points(spark, sf).withColumn("d", F.when(F.col("category") != 5, F.abs("lat") / 10.0))
    return p.select("id", R(geo.importance(F.col("category") == 3, "d")).alias("importance"))


@query(f"""select id, {r('t + s')} a, {r('t - s')} b from (select id, sqrt((xe + yn) * (xe + yn) + (xn - ye) * (xn - ye)) / 2 t, sqrt((xe - yn) * (xe - yn) + (xn + ye) * (xn + ye)) / 2 s
  from (select id, lat / 90e0 xe, lon / 180e0 ye, width / 1e4 xn, category / 25e0 yn from {POINTS}))""")
def m15_principal_strains(spark, sf):
    c = F.col
    p = points(spark, sf).select("id", geo.principal_strains(c("lat") / 90.0, c("lon") / 180.0, c("width") / 1e4, c("category") / 25.0).alias("s"))
    return p.select("id", R(F.col("s.a")).alias("a"), R(F.col("s.b")).alias("b"))


_CORNERS = f"""(select a.h, a.i, a.j, a.lat, a.lon, a.x ax, a.y ay, b.x bx, b.y by_, c.x cx, c.y cy, d.x dx, d.y dy from {mesh_sql()} a join {mesh_sql()} b on (a.h, a.i, a.j + 1) = (b.h, b.i, b.j)
  join {mesh_sql()} c on (a.h, a.i + 1, a.j + 1) = (c.h, c.i, c.j) join {mesh_sql()} d on (a.h, a.i + 1, a.j) = (d.h, d.i, d.j))"""


@query(f"""select h, i, j, {r(f'(((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2 + ((cx - ax) * (dy - ay) - (cy - ay) * (dx - ax)) / 2) / ({_A} * {_A} * (sin(radians(lat + 22.5e0)) - sin(radians(lat))) * radians(22.5e0))', 9)} scale from {_CORNERS}""")
def m16_areal_scale(spark, sf):
    from ..operators.grid import cell_corners

    c = cell_corners(mesh(spark))
    area = geo.polygon_area([("sw.x", "sw.y"), ("se.x", "se.y"), ("ne.x", "ne.y"), ("nw.x", "nw.y")])
    return c.select("h", "i", "j", R(area / geo.spherical_cell_area("lat", F.col("lat") + 22.5, 22.5), 9).alias("scale"))


@query(f"select h, i, j, case when x is not null then lon end x, case when x is not null then lat end y from {mesh_sql()}")
def m17_equirectangular(spark, sf):
    there = F.col("x").isNotNull()
    return mesh(spark).select("h", "i", "j", F.when(there, F.col("lon")).alias("x"), F.when(there, F.col("lat")).alias("y"))


@query(f"select h, i, j, {r('x / 1e3')} x, {r('y / 1e3')} y from {mesh_sql()}")
def m18_unit_scaling(spark, sf):
    return mesh(spark).select("h", "i", "j", R(F.col("x") / 1e3).alias("x"), R(F.col("y") / 1e3).alias("y"))


@query(f"""select id, bottom <> 0 and coalesce(u between 0 and 1 and v between 0 and 1, false) meets from (
  select id, bottom, case when bottom <> 0 then ((ax - cx) * (cy - dy) - (ay - cy) * (cx - dx)) / bottom end u, case when bottom <> 0 then ((ax - cx) * (ay - by_) - (ay - cy) * (ax - bx)) / bottom end v from (
    select *, (ax - bx) * (cy - dy) - (ay - by_) * (cx - dx) bottom from (
      select id, lat ax, lon ay, -lat / 2e0 + 3e0 bx, -lon / 3e0 by_, -40e0 cx, -55.5e0 cy, 61e0 dx, 80.25e0 dy from {POINTS})))""")
def p07_intersects(spark, sf):
    a, b = ("lat", "lon"), (-F.col("lat") / 2.0 + 3.0, -F.col("lon") / 3.0)
    return points(spark, sf).select("id", geo.intersects(a, b, (-40.0, -55.5), (61.0, 80.25)).alias("meets"))


@query(f"""select id, (lat + 50e0) * (lon + 70e0) - (lat - 10e0) * (lon + 70e0) >= 0 and (lat - 10e0) * (lon - 60e0) - (lat - 60e0) * (lon + 70e0) >= 0
  and (lat - 60e0) * (lon - 90e0) - (lat + 20e0) * (lon - 60e0) >= 0 and (lat + 20e0) * (lon + 70e0) - (lat + 50e0) * (lon - 90e0) >= 0 inside from {POINTS}""")
def p03_inside_convex(spark, sf):
    return points(spark, sf).select("id", geo.inside_convex("lat", "lon", [(-50.0, -70.0), (10.0, -70.0), (60.0, 60.0), (-20.0, 90.0)]).alias("inside"))
