"""Queries for cells that paths touch, section borders and what follows from them. The twins compute the same
crossings as joins of segments and grid lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells, features, raster
from ..sources import resources, text_files
from ..sources.fixtures import LINES, MESH, mesh, polylines
from . import build_mesh as plan
from .line_queries import CUT_ROWS, region_sql, sections, sections_sql
from .mesh_queries import _GRADS, _cell, _hermite_sql, _seam
from .registry import query

R = geo.rounded
N = 8


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0"


def bin_sql(x: str, low: float, step: float, bins: int, right: bool = False) -> str:
    t = f"(({x}) - ({low}e0)) / {step}e0"
    return f"(case when {x} >= {low + step * bins}e0 then {bins - 1} else greatest({f'ceil({t}) - 1' if right else f'floor({t})'}, -1) end)::int"


def wrap_sql(x: str) -> str:
    return f"({x} - floor(({x} + 180e0) / 360e0) * 360e0)"


def edge_sql(x: str, low: float, step: float) -> str:
    t = f"(({x} - ({low}e0)) / {step}e0)"
    return f"(abs({t} - round({t})) < 1e-9)"


def _crossings_sql(src: str, n: int, radius: float, over: bool) -> str:
    """Cells on both sides of the lines of latitude (or, with ``over``, of longitude) that segments cross."""
    step = 180.0 / n
    lat, lon = (-90.0, step, n), (-180.0, step, 2 * n)
    (low, _, bins), (low2, _, bins2) = (lon, lat) if over else (lat, lon)
    offsets = f"(values ({-radius}e0), ({radius}e0))" if radius else "(values (0e0))"
    far = "abs(y1 - y0) > 180"
    seg = f"""(select h, x0, y0, x1, y1, d, {far} far, case when {far} then {bin_sql('greatest(y0, y1)', -180.0, step, 2 * n)} else 0 end shift from (
      select h, x0 {'+ d' if over else ''} x0, y0 {'' if over else '+ d'} y0, x1 {'+ d' if over else ''} x1, y1 {'' if over else '+ d'} y1, d from (
        select h, lag(lat) over w x0, lag(lon) over w y0, lat x1, lon y1 from {src} window w as (partition by h order by seq)) s, {offsets} o(d) where x0 is not null and {'y0 <> y1' if over else 'x0 <> x1'}))"""
    moved = f"(select *, case when far then {wrap_sql(f'(y0 - {step}e0 * shift)')} else y0 end m0, case when far then {wrap_sql(f'(y1 - {step}e0 * shift)')} else y1 end m1 from {seg})"
    a, b = (("m0", "m1"), ("x0", "x1")) if over else (("x0", "x1"), ("m0", "m1"))
    flip = f"{a[1]} < {a[0]}"
    ends = ", ".join(f"case when {flip} then {p[1 - k]} else {p[k]} end {name}{k}" for p, name in ((a, "a"), (b, "b")) for k in (0, 1))
    lines = f"(select *, unnest(generate_series({bin_sql('a0', low, step, bins)} + 1, {bin_sql('a1', low, step, bins, True)})) line from (select h, shift, {ends} from {moved}) where a1 > a0)"
    at = f"(({step}e0 * line + ({low}e0)) - a0) / (a1 - a0) * (b1 - b0) + b0"
    got = f"(select h, shift, line, {bin_sql('v', low2, step, bins2)} bin from (select *, {at} v from {lines}))"
    k = "(values (0), (1)) t(k)"
    if over:
        return f"select h, bin i, (((line + shift) % {2 * n + 1} - k) % {2 * n} + {2 * n}) % {2 * n} j from {got}, {k} where bin between 0 and {n - 1}"
    return f"select h, ((line - k) % {n} + {n}) % {n} i, ((bin + shift + {2 * n + 1}) % {2 * n + 1}) % {2 * n} j from {got}, {k}"


def touched_sql(src: str, n: int, radius: float = 0.0) -> str:
    step = 180.0 / n
    parts = [_crossings_sql(src, n, radius, False), _crossings_sql(src, n, radius, True)]
    parts.append(f"select h, {bin_sql('lat', -90.0, step, n)} i, {bin_sql('lon', -180.0, step, 2 * n)} j from {src} where not ({edge_sql('lat', -90.0, step)} or {edge_sql('lon', -180.0, step)})")
    if radius:
        bends = f"""(select h, lat bx, lon blon, plat ax, plon ay, case when seq = last and closed then two else nlat end cx, case when seq = last and closed then two_lon else nlon end cy from (
          select *, lag(lat) over w plat, lag(lon) over w plon, lead(lat) over w nlat, lead(lon) over w nlon, max(seq) over (partition by h) last, first_value(lat) over u = last_value(lat) over u and first_value(lon) over u = last_value(lon) over u closed,
          nth_value(lat, 2) over u two, nth_value(lon, 2) over u two_lon from {src} window w as (partition by h order by seq), u as (partition by h order by seq rows between unbounded preceding and unbounded following)))"""
        unit = lambda x, y: f"case when sqrt({x} * {x} + {y} * {y}) = 0 then {x} else {x} / sqrt({x} * {x} + {y} * {y}) end"
        norm = f"(select *, {unit('(cx - bx)', '(cy - blon)')} ox, {unit('(cy - blon)', '(cx - bx)')} oy, {unit('(bx - ax)', '(blon - ay)')} px, {unit('(blon - ay)', '(bx - ax)')} py from {bends} where ax is not null and cx is not null)"
        off = f"(select *, ox - px dx, oy - py dy from {norm})"
        u = f"(select h, bx, blon, case when sqrt(dx * dx + dy * dy) > 1e-4 then dx / sqrt(dx * dx + dy * dy) else -oy end ux, case when sqrt(dx * dx + dy * dy) > 1e-4 then dy / sqrt(dx * dx + dy * dy) else ox end uy from {off})"
        o = f"(select h, {bin_sql(f'(bx - {radius}e0 * ux)', -90.0, step, n)} i, {bin_sql(f'(blon - {radius}e0 * uy)', -180.0, step, 2 * n)} j from {u})"
        parts.append(f"select h, i, ((j % {2 * n}) + {2 * n}) % {2 * n} j from {o} where i between 0 and {n - 1}")
    return "(select distinct h, i::int i, j::int j from (" + " union all ".join(parts) + "))"


def approached_sql(src: str, n: int) -> str:
    step = 180.0 / n
    ends = f"(select h, lat x, lon y, coalesce(plat, nlat) px, coalesce(plon, nlon) py, d from (select *, lag(lat) over w plat, lag(lon) over w plon, lead(lat) over w nlat, lead(lon) over w nlon from {src} window w as (partition by h order by seq)), (values ({-step}e0), ({step}e0)) t(d) where plat is null or nlat is null)"

    def ahead(v, low, bins):
        return f"case when p{v} < {v} then {bin_sql(v, low, step, bins, True)} else {bin_sql(v, low, step, bins)} end"

    one = f"select h, {ahead('x', -90.0, n)} i, {bin_sql('(y + d)', -180.0, step, 2 * n)} j from {ends} where {edge_sql('x', -90.0, step)} and px <> x"
    two = f"select h, {bin_sql('(x + d)', -90.0, step, n)} i, {ahead('y', -180.0, 2 * n)} j from {ends} where {edge_sql('y', -180.0, step)} and py <> y"
    return f"(select distinct h, (i % {n} + {n}) % {n} i, (j % {2 * n} + {2 * n}) % {2 * n} j from ({one} union all {two}))"


def centers_sql(n: int) -> str:
    step = 180.0 / n
    return f"(select i * {2 * n} + j id, i::int i, j::int j, (i + 0.5e0) * {step}e0 - 90e0 lat, (j + 0.5e0) * {step}e0 - 180e0 lon from range({n}) a(i), range({2 * n}) b(j))"


def inside_sql(src: str, n: int) -> str:
    return f"(select h, i, j from {touched_sql(src, n, raster.MARGIN)} union select h, i, j from {region_sql(centers_sql(n), src, 'id')} q join {centers_sql(n)} c using (id) where inside)"


_EXAMPLE = sections_sql("example")


@query(f"select h, i, j from {touched_sql(_EXAMPLE, N)}")
def g01_cells_touched_by(spark, sf):
    return raster.cells_touched_by(sections(spark, "example"), N)


_BY_LINE = f"(select feature_id h, seq, lat, lon from {LINES})"


def _by_line(spark, sf):
    return polylines(spark, sf).withColumnRenamed("feature_id", "h")


@query(f"select h, i, j from {touched_sql(_BY_LINE, 24)}")
def g01_cells_touched_by_lines(spark, sf):
    return raster.cells_touched_by(_by_line(spark, sf), 24)


@query(f"select h, i, j from {touched_sql(_EXAMPLE, N, 1.0)}")
def g02_cells_touched_by_wide_paths(spark, sf):
    return raster.cells_touched_by(sections(spark, "example"), N, 1.0)


@query(f"select h, i::int i, j::int j from {approached_sql(_EXAMPLE, 9)}")
def g03_cells_approached_by(spark, sf):
    return raster.cells_approached_by(sections(spark, "example"), 9)


@query(f"select h, i, j from {inside_sql(_EXAMPLE, N)}")
def u01_cells_inside_of(spark, sf):
    return raster.cells_inside_of(sections(spark, "example"), N)


def trimmed_sql(src: str, n: int) -> str:
    step = 180.0 / n
    enter = lambda p, q, lo, hi: f"case when {p} < {lo} then ({lo} - {p}) / ({q} - {p}) when {p} > {hi} then ({hi} - {p}) / ({q} - {p}) else 0e0 end"
    d = f"""(select *, last_value(i) over u fi, last_value(j) over u fj, last_value(edge) over u ready from (
      select h, seq, lat, lon, {bin_sql('lat', -90.0, step, n, True)} i, {bin_sql('lon', -180.0, step, 2 * n, True)} j, lag(lat) over w px, lag(lon) over w py, {edge_sql('lat', -90.0, step)} or {edge_sql('lon', -180.0, step)} edge
      from {src} window w as (partition by h order by seq)) window u as (partition by h order by seq rows between unbounded preceding and unbounded following))"""
    c = f"(select *, min(case when i = fi and j = fj then seq end) over (partition by h) cut from {d})"
    t = f"(select *, not ready and seq = cut and px is not null last, fi * {step}e0 - 90e0 x0, (fi + 1) * {step}e0 - 90e0 x1, fj * {step}e0 - 180e0 y0, (fj + 1) * {step}e0 - 180e0 y1 from {c} where ready or seq <= cut)"
    s = f"(select *, greatest({enter('px', 'lat', 'x0', 'x1')}, {enter('py', 'lon', 'y0', 'y1')}) t from {t})"
    return f"(select h, seq, case when last then px + t * (lat - px) else lat end lat, case when last then py + t * (lon - py) else lon end lon from {s})"


@query(f"select h, seq, {r('lat')} lat, {r('lon')} lon from {trimmed_sql(_BY_LINE, N)}")
def g04_trim_to_grid(spark, sf):
    d = raster.trim_to_grid(_by_line(spark, sf), N)
    return d.select("h", "seq", R(F.col("lat")).alias("lat"), R(F.col("lon")).alias("lon"))


# borders: two cuts and the seam between their ends
def borders_sql(cuts: str) -> str:
    return f"""(with c as (select cut, seq, lat, lon from {cuts}), n as (select max(cut) n from c), g as (select lat glat, lon glon, case when lat < 0 then -1 else 1 end sg from c where cut = 0),
k as (select *, row_number() over (partition by cut order by seq) - 1 k from c where cut > 0),
u as (select (cut % n)::int h, 0 part, -k ord, lat, lon from k, n where k > 0 union all select cut - 1, 1, k, lat, lon from k),
cut as (select h, (row_number() over (partition by h order by part, ord) - 1)::int seq, lat, lon, count(*) over (partition by h) m from u),
e as (select h, arg_max(lat, seq) slat, arg_max(lon, seq) slon, arg_min(lat, seq) elat, arg_min(lon, seq) elon from cut group by h),
s as (select h, unnest([0, 1, 2, 3, 4, 5]) ord, unnest(case when abs(glat) < 90 then [{{'a': slat, 'o': slon}}, {{'a': slat, 'o': glon}}, {{'a': glat, 'o': glon}}, {{'a': elat, 'o': glon}}, {{'a': elat, 'o': elon}}]
  else [{{'a': slat, 'o': slon}}, {{'a': 90e0 * sg, 'o': slon}}] || case when slon = elon or case when slon - elon < 0 then -1 else 1 end <> sg then [{{'a': 90e0 * sg, 'o': -180e0 * sg}}, {{'a': 90e0 * sg, 'o': 180e0 * sg}}] else [] end
    || [{{'a': 90e0 * sg, 'o': elon}}, {{'a': elat, 'o': elon}}] end) p from e, g),
v as (select h, ord * 2 + 1 ord, p.a lat, p.o lon, lag(p.a) over w plat, lag(p.o) over w plon from s where p is not null window w as (partition by h order by ord)),
z as (select h, ord, lat, lon from v where plat is null or plat <> lat or plon <> lon union all select h, ord - 1, 90e0 * sg, 0e0 from v, g where abs(glat) = 90 and abs(lon - plon) > 180 and abs(lon - plon) <> 360),
glue as (select h, (row_number() over (partition by h order by ord) - 1)::int seq, lat, lon from z)
select h, 'cut' part, seq, lat, lon from cut union all select h, 'glue', seq, lat, lon from glue
union all select h, 'border', seq, lat, lon from cut where seq < m - 1 union all select h, 'border', (m - 1 + seq)::int, lat, lon from glue join (select distinct h, m from cut) using (h))"""


_CUTS = f"(select * from {CUT_ROWS} where name = 'example')"
BORDERS = borders_sql(_CUTS)


def _borders(spark):
    cuts = text_files.parse_cuts(text_files.texts(spark, {"example": resources.CUTS["example"]})).drop("name")
    return plan.section_borders(cuts)


@query(f"select h, part, seq, lat::double lat, lon::double lon from {BORDERS}")
def g07_section_borders(spark, sf):
    return _borders(spark)


def _part(name: str, borders: str = BORDERS) -> str:
    return f"(select h, seq, lat, lon from {borders} where part = '{name}')"


@query(f"select h, i, j from {touched_sql(_part('glue'), N, raster.MARGIN)} except select h, i, j from {touched_sql(_part('cut'), N)} except select h, i, j from {approached_sql(_part('cut'), N)}")
def u02_cells_shared_by(spark, sf):
    b = _borders(spark)
    return raster.cells_shared_by(b.where("part = 'glue'").drop("part"), b.where("part = 'cut'").drop("part"), N)


_REACH = repr(math.degrees(resources.STRAIT_KM / geo.EARTH.a))
_STRAITS = "(values " + ", ".join(f"({a}e0, {b}e0)" for a, b in resources.STRAITS) + ") s(slat, slon)"


def _close_sql(reach: str) -> str:
    return f"abs(lat - slat) < {reach} and abs({wrap_sql('(lon - slon)')}) < {reach} / cos(radians(slat))"


def straits_sql(src: str, n: int) -> str:
    return f"""(with a as (select *, lag(lat) over w plat, lag(lon) over w plon from {src} window w as (partition by h order by seq)),
b as (select *, case when plat is null then 1 when abs(lon - plon) > 180 then 0 else ceil(sqrt(pow(lat - plat, 2) + pow(lon - plon, 2)) / {_REACH}) end n from a),
f as (select h, case when part = n or plat is null then lat else (1 - part / n::double) * plat + part / n::double * lat end lat, case when part = n or plat is null then lon else (1 - part / n::double) * plon + part / n::double * lon end lon
  from (select *, unnest(generate_series(1, n::int)) part from b where n > 0)),
p as (select distinct h, slat, slon from f, {_STRAITS} where {_close_sql(f'({_REACH} / 2)')})
select distinct h, i, j from p, {centers_sql(n)} where {_close_sql(_REACH)})"""


@query(f"select h, i, j from {straits_sql(_BY_LINE, 24)}")
def p10_near_straits(spark, sf):
    return plan.near_straits(_by_line(spark, sf), 24)


_MASK = f"(select h::int h, i::int i, j::int j from range(3) a(h), range({N}) b(i), range({2 * N}) c(j) where (h * 5 + i * 3 + j * 7) % 6 = 0 and (h <> 1 or i < 6) and (h <> 2 or i between 2 and 5))"
_SHARED = f"(select i::int i, j::int j from range({N}) b(i), range({2 * N}) c(j) where (i * 5 + j) % 9 = 0 and i < 5)"


@query(f"""with m as {_MASK}, s as {_SHARED}, f as (select h, bool_or(i between 1 and {N - 2} and j in (0, {2 * N - 1})) edge, bool_or(i = 0) south, bool_or(i = {N - 1}) north from m group by h),
w as (select h, i, j from m union select h, i::int, j from f, range({N}) b(i), (values (0), ({2 * N - 1})) t(j) where edge and not (south and north))
select h, i, j from (select h, i, j from w union select h, i, c.j::int from (select distinct h, i from w where i in (0, {N - 1})), range({2 * N}) c(j))
union all select -1, i, j from (select i, j from s union select i, c.j::int from (select distinct i from s where i in (0, {N - 1})), range({2 * N}) c(j))""")
def w16_whole_poles(spark, sf):
    """Cells of sections, and as section -1 those that are shared."""
    d = spark.range(3 * N * 2 * N).select((F.col("id") / (2 * N * N)).cast("int").alias("h"), (F.floor(F.col("id") / (2 * N)) % N).cast("int").alias("i"), (F.col("id") % (2 * N)).cast("int").alias("j"))
    there = "(h * 5 + i * 3 + j * 7) % 6 = 0 and (h <> 1 or i < 6) and (h <> 2 or i between 2 and 5)"
    whole, shared = plan._poles(d.where(there), d.where("h = 0 and (i * 5 + j) % 9 = 0 and i < 5").select("i", "j"), N)
    return whole.unionByName(shared.select(F.lit(-1).alias("h"), "i", "j"))


def center_sql(src: str) -> str:
    """``h, lat, lon`` in degrees."""
    return f"""(with p as (select * from {src}), s as (select k id, k // 48 ci, k % 48 cj, (k // 48) * 7.5e0 - 90e0 clat, (k % 48) * 7.5e0 - 180e0 clon from range(1200) t(k)),
o as (select id, -clat lat, {wrap_sql('(clon + 180e0)')} lon from s), b as (select id, h from {region_sql('o', 'p', 'id')} where inside),
v as (select distinct h, radians(lat) q, radians(lon) w from p),
x as (select h, id, ci, cj, clat, clon, sin(a) * cos(q) * cos(w - c) - cos(a) * sin(q) x, cos(q) * sin(w - c) y, cos(a) * cos(q) * cos(w - c) + sin(a) * sin(q) z from v, (select *, radians(clat) a, radians(clon) c from s)),
f as (select h, id, ci, cj, clat, clon, max(pi() / 2 - atan2(z, sqrt(x * x + y * y))) far from x group by all),
m as (select h, arg_min((clat, clon), (round(far, 9), ci, cj)) m from f anti join b using (h, id) group by h)
select h, m[1] lat, m[2] lon from m)"""


@query(f"select h, {r('radians(lat)', 9)} lat, {r('radians(lon)', 9)} lon from {center_sql(_EXAMPLE)}")
def a09_center_of(spark, sf):
    return cells.center_of(sections(spark, "example")).select("h", R(F.col("lat"), 9).alias("lat"), R(F.col("lon"), 9).alias("lon"))


@query(f"""with n as (select h, i, j, x is not null there, lag(x is not null) over c s, lead(x is not null) over c nn, lag(x is not null) over w wst, lead(x is not null) over w est from {MESH} window c as (partition by h, j order by i), w as (partition by h, i order by j)),
k as (select i, greatest(4, round(16 / 2e0 * cos(radians(22.5e0 * i - 90)))) k from range(9) t(i)), c as (select i, list(distinct round(a * 16 / k)) js from k, range(17) t(a) where a < k group by i),
imp as (select distinct round(180 / 4e0 * a * 8 / 180)::int i from range(4) t(a)),
d as (select h, n.i, j, imp.i is not null or not coalesce(s, false) or not coalesce(nn, false) row_key, list_contains(js, j) col_key, not coalesce(wst, false) or not coalesce(est, false) alone from n join c using (i) left join imp on imp.i = n.i where there),
l as (select *, alone or not coalesce(lag(row_key) over w, false) or not coalesce(lead(row_key) over w, false) lone from d window w as (partition by h, i order by j))
select h, i, j, row_key, row_key and (col_key or lone) node_key from l""")
def l13_skeleton(spark, sf):
    return plan.skeleton(cells.enumerate_nodes(mesh(spark))[0], 2.0, 9, 17)


def refined_sql(src: str, resolution: float) -> str:
    """``h, seq, part, lat, lon`` with halved segments."""
    halvings = ", ".join(str(2**k) for k in range(12))
    return f"""(with a as (select *, lag(lat) over w plat, lag(lon) over w plon from {src} window w as (partition by h order by seq)),
b as (select *, case when plat is null or abs(lon - plon) > 180 then 1 else list_min(list_filter([{halvings}], lambda p: sqrt(pow(lat - plat, 2) + pow(lon - plon, 2)) / p <= {resolution}e0)) end n from a),
c as (select *, unnest(generate_series(1, n::int)) part from b)
select h, seq, part::int part, case when part = n or plat is null then lat else (1 - part / n::double) * plat + part / n::double * lat end lat, case when part = n or plat is null then lon else (1 - part / n::double) * plon + part / n::double * lon end lon from c)"""


_TURNED = f"""(with b as (select h, seq, lat, lon, max(seq) over (partition by h) + 1 n from {_EXAMPLE}),
t as (select h, seq - n + 3 seq, lat, lon from b where seq >= n - 3 union all select h, seq + 2, lat, lon from b where seq between 1 and n - 3),
o as (select *, bool_or(abs(lat) <> 90) over (partition by h order by seq rows between 1 preceding and 1 following) kept from t)
select h, seq, lat, lon from o where kept)"""
_REFINED = f"(select h, h section, seq, part, lat, lon from {refined_sql(_TURNED, 5.0)})"


@query(f"""with g as (select * from {_GRADS}) select p.h, seq, part, {r('p.lat')} lat, {r('p.lon')} lon, {r(_hermite_sql('x'), 4)} x, {r(_hermite_sql('y'), 4)} y from {_cell(_REFINED)} p
  left join g a on (p.section, p.i, p.j) = (a.h, a.i, a.j) left join g b on (p.section, p.i, p.j + 1) = (b.h, b.i, b.j) left join g c on (p.section, p.i + 1, p.j) = (c.h, c.i, c.j) left join g d on (p.section, p.i + 1, p.j + 1) = (d.h, d.i, d.j)""")
def i10_project_section_boundaries(spark, sf):
    d = features.project_section_boundaries(sections(spark, "example"), _seam(spark), 9, 17, 5.0)
    return d.select("h", "seq", "part", R(F.col("lat")).alias("lat"), R(F.col("lon")).alias("lon"), R(F.col("x"), 4).alias("x"), R(F.col("y"), 4).alias("y"))




# a whole mesh: masks from the trimmed borders, conformal coordinates about each section's centre, blended
_TRIMMED = f"(select 0 cut, seq, lat, lon from {_CUTS} where cut = 0 union all select h, seq, lat, lon from {trimmed_sql('(select cut h, seq, lat, lon from ' + _CUTS + ' where cut > 0)', N)})"
_TB = "tb"


def _bearing_sql(ref: tuple[str, str], at: tuple[str, str]) -> tuple[str, str]:
    """Distance and bearing in radians."""
    (a, c), (q, w) = ref, at
    x, y, z = f"(sin({a}) * cos({q}) * cos({w} - {c}) - cos({a}) * sin({q}))", f"(cos({q}) * sin({w} - {c}))", f"(cos({a}) * cos({q}) * cos({w} - {c}) + sin({a}) * sin({q}))"
    return f"(pi() / 2 - atan2({z}, sqrt({x} * {x} + {y} * {y})))", f"atan2({y}, {x})"


_FAR, _TURN = _bearing_sql(("cla", "clo"), ("la", "lo"))
_GFAR, _GTURN = _bearing_sql(("cla", "clo"), ("gla", "glo"))
_BACK = _bearing_sql(("gla", "glo"), ("cla", "clo"))[1]


@query(f"""with tb as materialized (select * from {borders_sql(_TRIMMED)}),
sh as (select distinct i, j from (select h, i, j from {touched_sql(_part('glue', _TB), N, raster.MARGIN)} except select h, i, j from {touched_sql(_part('cut', _TB), N)} except select h, i, j from {approached_sql(_part('cut', _TB), N)})),
inc as (select h, i, j from {inside_sql(_part('border', _TB), N)} union select h, i, j from {straits_sql(_part('cut', _TB), N)}),
nodes as (select distinct h, i + a i, j + b j from inc, (values (0), (1)) s(a), (values (0), (1)) t(b)),
share as (select distinct i + a i, unnest(case when j + b = 0 then [0, {2 * N}] when j + b = {2 * N} then [{2 * N}, 0] else [j + b] end) j from sh, (values (0), (1)) s(a), (values (0), (1)) t(b)),
ctr as (select h, radians(lat) cla, radians(lon) clo from {center_sql(_part('border', _TB))}), g as (select radians(lat) gla, radians(lon) glo from {_CUTS} where cut = 0),
d as (select h, i::int i, j::int j, i * {180.0 / N}e0 - 90 lat, j * {180.0 / N}e0 - 180 lon, cla, clo, gla, glo, radians(i * {180.0 / N}e0 - 90) la, radians(j * {180.0 / N}e0 - 180) lo from ctr, g, range({N + 1}) a(i), range({2 * N + 1}) b(j)),
e as (select *, {_FAR} far, {_TURN} turn, {_GFAR} gfar, {_GTURN} gturn, {_BACK} - {_GTURN} - pi() spin from d),
f as (select *, tan(far / 2) * sin(turn) - tan(gfar / 2) * sin(gturn) px, tan(gfar / 2) * cos(gturn) - tan(far / 2) * cos(turn) py, 3 * {geo.EARTH.a!r} * pow(cos(gfar / 2), 2) size from e),
q as (select f.h, f.i, f.j, nodes.h is not null there, share.i is not null shared, size * (px * cos(spin) - py * sin(spin)) x, size * (px * sin(spin) + py * cos(spin)) y from f left join nodes on (nodes.h, nodes.i, nodes.j) = (f.h, f.i, f.j) left join share on (share.i, share.j) = (f.i, f.j)),
m as (select h, i, j, shared, case when there then x end x, case when there then y end y from q),
b as (select h, i, j, shared, case when x is not null and shared then avg(x) over (partition by i, j) else x end x, case when x is not null and shared then avg(y) over (partition by i, j) else y end y from m),
s as (select *, bool_or(shared) over (partition by i) any_shared from b),
p as (select *, case when i in (0, {N}) then case when any_shared then avg(x) over (partition by i) else avg(x) over (partition by h, i) end else x end nx, case when i in (0, {N}) then case when any_shared then avg(y) over (partition by i) else avg(y) over (partition by h, i) end else y end ny from s),
z as (select *, first_value(nx) over w fx, first_value(ny) over w fy from p window w as (partition by h, i order by j))
select h, i, j, {r(f'case when x is not null then case when j = {2 * N} then fx else nx end end', 3)} x, {r(f'case when x is not null then case when j = {2 * N} then fy else ny end end', 3)} y from z""")
def g08_build_mesh(spark, sf):
    cuts = text_files.parse_cuts(text_files.texts(spark, {"example": resources.CUTS["example"]})).drop("name")
    d, _ = plan.build_mesh(spark, cuts, N // 2)
    return d.select("h", "i", "j", R(F.col("x"), 3).alias("x"), R(F.col("y"), 3).alias("y"))
