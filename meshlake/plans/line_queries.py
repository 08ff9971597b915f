"""Queries for text sources, polygons and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import paths, polygon
from ..sources import resources, text_files
from ..sources.fixtures import LINES, POINTS, STEPS, lat_of, lat_sql, lon_of, lon_sql, points, polylines, steps, table
from .registry import query

R = geo.rounded


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0"


def _values(named: dict[str, str]) -> str:
    return "(values " + ", ".join(f"('{k}', '{v}')" for k, v in named.items()) + ") f(name, text)"


CUT_ROWS = f"""(select name, seq::int seq, lat, lon, sum(start) over (partition by name order by seq)::int cut from (
  select *, case when seq > 0 and lat = first_value(lat) over w and lon = first_value(lon) over w then 1 else 0 end start from (
    select name, k - 1 seq, split_part(trim(line), ' ', 1)::double lat, trim(substr(trim(line), length(split_part(trim(line), ' ', 1)) + 1))::double lon
    from (select name, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from {_values(resources.CUTS)}))
  window w as (partition by name, seq > 0 order by seq)))"""


@query(f"select name, seq, cut, lat, lon from {CUT_ROWS}")
def s01_load_interruptions(spark, sf):
    return text_files.parse_cuts(text_files.texts(spark, resources.CUTS))


SECTIONS = f"""(with c as (select * from {CUT_ROWS}), n as (select name, max(cut) n from c group by name),
g as (select name, lat glat, lon glon from c where cut = 0),
s as (select c.name, (cut % n)::int h, 0 part, -seq ord, lat, lon from c join n using (name) where cut > 0 union all select name, cut - 1, 1, seq, lat, lon from c where cut > 0),
e as (select name, h, arg_min(lat, (part, ord)) alat, arg_min(lon, (part, ord)) alon, arg_max(lat, (part, ord)) zlat, arg_max(lon, (part, ord)) zlon from s group by name, h),
x as (select e.*, glat, glon, sign(glat) sg, abs(glat) = 90 pole, (alon - zlon) * sign(glat) < 0 straight from e join g using (name)),
y as (select name, h, 2 part, unnest(case when not pole then [{{'lat': zlat, 'lon': glon}}, {{'lat': glat, 'lon': glon}}, {{'lat': alat, 'lon': glon}}, {{'lat': alat, 'lon': alon}}]
    when straight then [{{'lat': glat, 'lon': zlon}}, {{'lat': glat, 'lon': alon}}, {{'lat': alat, 'lon': alon}}]
    else [{{'lat': glat, 'lon': zlon}}, {{'lat': glat, 'lon': -180 * sg}}, {{'lat': glat, 'lon': 180 * sg}}, {{'lat': glat, 'lon': alon}}, {{'lat': alat, 'lon': alon}}] end) p,
    unnest([1, 2, 3, 4, 5]) ord from x),
z as (select name, h, part, ord, lat, lon from s union all select name, h, part, ord, p.lat, p.lon from y where p is not null)
select name, h, (row_number() over (partition by name, h order by part, ord) - 1)::int seq, lat::double lat, lon::double lon from z)"""


def sections(spark, name: str):
    return text_files.closed_sections(text_files.parse_cuts(text_files.texts(spark, {name: resources.CUTS[name]}))).drop("name")


def sections_sql(name: str) -> str:
    return f"(select h, seq, lat, lon from {SECTIONS} where name = '{name}')"


@query(f"select name, h, seq, lat, lon from {SECTIONS}")
def s02_load_cut_file(spark, sf):
    return text_files.closed_sections(text_files.parse_cuts(text_files.texts(spark, resources.CUTS)))


@query(f"select name, trim(split_part(line, ':', 1)) \"key\", trim(split_part(line, ':', 2)) \"value\" from (select name, unnest(string_split(text, chr(10))) line from {_values(resources.OPTIONS)})")
def s03_load_options(spark, sf):
    return text_files.parse_options(text_files.texts(spark, resources.OPTIONS))


_ISLES = " or ".join(f"(abs(lat - {a}e0) < 2 and abs(lon - {b}e0) < 2)" for a, b in resources.ISLANDS)
_DESERTS = " or ".join(f"pow((lat - {a}e0) / {p}e0, 2) + pow((lon - {b}e0) / {q}e0, 2) < 1" for a, b, p, q in resources.DESERTS)
_UNINHABITED = f"({_ISLES} or {_DESERTS} or lat >= 78 or lat <= -56)"


@query(f"select id, ({_ISLES}) remote, {_UNINHABITED} uninhabited from {POINTS}")
def p01_uninhabited(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    return points(spark, sf).select("id", polygon.uninhabited(lat, lon).alias("remote"), polygon.uninhabited(lat, lon, True).alias("uninhabited"))


def region_sql(pts: str, polys: str, keys: str) -> str:
    return f"""(with pts as (select * from {pts}), e as (select h, seq k, lag(lat) over w lat0, lag(lon) over w lon0, lat lat1, lon lon1 from {polys} window w as (partition by h order by seq)),
d as (select h, arg_max(case when abs(lon1 - lon0) = 360 then lon0 - lon1 else lon1 - lon0 end > 0, ((lat0 + lat1) / 2, -k)) dflt from e where lat0 is not null group by h),
x as (select {keys}, h, k, (lon - lon0) / (lon1 - lon0) * (lat1 - lat0) + lat0 cross_lat, lat, lon1 > lon0 east from pts join e on (lon0 <= lon) <> (lon1 <= lon) where lon1 <> lon0 and abs(lon1 - lon0) <= 180),
m as (select {keys}, h, arg_min(east <> (cross_lat > lat), (abs(cross_lat - lat), -k)) inside from x group by {keys}, h)
select {keys}, h, coalesce(inside, dflt) inside from (select {keys}, d.h, dflt from pts, d) left join m using ({keys}, h))"""


@query("select id, h, inside from " + region_sql(POINTS, sections_sql("example"), "id"))
def p02_inside_region(spark, sf):
    return polygon.inside_region(points(spark, sf), sections(spark, "example"), ["id"])


_RINGS = f"(select s_suppkey h, k seq, {lat_sql('s_suppkey')} * 0.9e0 + [-3, -3, 3, 3, -3][k] lat, {lon_sql('s_suppkey')} * 0.9e0 + [-3, 3, 3, -3, -3][k] lon from (select s_suppkey, unnest([1, 2, 3, 4, 5]) k from supplier))"


def rings(spark, sf):
    """Squares around the suppliers: many edges."""
    k = F.col("s_suppkey")
    lat = F.array(*[F.lit(float(v)) for v in (-3, -3, 3, 3, -3)])
    lon = F.array(*[F.lit(float(v)) for v in (-3, 3, 3, -3, -3)])
    d = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seq"))
    return d.select(k.alias("h"), "seq", (lat_of(k) * 0.9 + lat[F.col("seq") - 1]).alias("lat"), (lon_of(k) * 0.9 + lon[F.col("seq") - 1]).alias("lon"))


@query("select id, h from " + region_sql(POINTS, _RINGS, "id") + " where inside")
def p02_inside_many_regions(spark, sf):
    return polygon.containing(points(spark, sf), rings(spark, sf), ["id"])


def planar_sql(pts: str, polys: str) -> str:
    return f"""(with e as (select h, coalesce(lag(lat) over w, last_value(lat) over u) lat0, coalesce(lag(lon) over w, last_value(lon) over u) lon0, lat lat1, lon lon1 from {polys}
  window w as (partition by h order by seq), u as (partition by h order by seq rows between unbounded preceding and unbounded following)),
a as (select h, sum(lon0 * lat1 - lat0 * lon1) > 0 ccw from e group by h),
c as (select id, h, sum(case when (lat0 <= lat) <> (lat1 <= lat) and lon < (lat - lat0) / (lat1 - lat0) * (lon1 - lon0) + lon0 then 1 else 0 end) % 2 = 1 odd from {pts} p, e where true group by id, h)
select id, h, odd = ccw inside from c join a using (h))"""


@query("select id, h, inside from " + planar_sql(POINTS, sections_sql("example")))
def p04_section_contains(spark, sf):
    return polygon.contains(points(spark, sf), sections(spark, "example"), ["id"])


@query(f"select h, sum(lon0 * lat - lat0 * lon) > 0 counterclockwise from (select h, lat, lon, coalesce(lag(lat) over w, last_value(lat) over u) lat0, coalesce(lag(lon) over w, last_value(lon) over u) lon0 from {_RINGS} window w as (partition by h order by seq), u as (partition by h order by seq rows between unbounded preceding and unbounded following)) group by h")
def p05_is_counterclockwise(spark, sf):
    return polygon.orientation(rings(spark, sf))


_GRID = "(select i::int i, j::int j, -87.3e0 + 6e0 * i lat, -178.7e0 + 6e0 * j lon from range(30) a(i), range(60) b(j))"


def grid(spark):
    d = spark.range(1800).select(F.floor(F.col("id") / 60).cast("int").alias("i"), (F.col("id") % 60).cast("int").alias("j"))
    return d.select("i", "j", (F.col("i") * 6.0 - 87.3).alias("lat"), (F.col("j") * 6.0 - 178.7).alias("lon"))


@query(f"""with e as (select coalesce(lag(lat) over w, last_value(lat) over u) lat0, coalesce(lag(lon) over w, last_value(lon) over u) lon0, lat lat1, lon lon1 from {_RINGS}
  window w as (partition by h order by seq), u as (partition by h order by seq rows between unbounded preceding and unbounded following)),
c as (select i, j, count(*) n from {_GRID} g join e on (lon0 < lon) <> (lon1 < lon) and lat0 + (lon - lon0) / (lon1 - lon0) * (lat1 - lat0) < lat where lon0 <> lon1 group by i, j)
select i, j, coalesce(n, 0) % 2 = 1 and not {_UNINHABITED} land from {_GRID} left join c using (i, j)""")
def p06_land_mask(spark, sf):
    return polygon.land_mask(grid(spark), rings(spark, sf), exclude_antarctica=True)


@query(f"select id, min(h) section from {region_sql(POINTS, sections_sql('example'), 'id')} where inside group by id union all select id, null from {POINTS} where id not in (select id from {region_sql(POINTS, sections_sql('example'), 'id')} where inside)")
def j04_first_section(spark, sf):
    return polygon.first_section(points(spark, sf), sections(spark, "example"), ["id"]).select("id", "section")


@query(f"select id, max(case when inside then h end) section from {planar_sql(POINTS, sections_sql('example'))} group by id")
def j05_last_section(spark, sf):
    return polygon.last_section(points(spark, sf), sections(spark, "example")).select("id", "section")


@query(f"select id from {POINTS} where not ({_ISLES})")
def j09_island_exclusion(spark, sf):
    return points(spark, sf).where(~polygon.uninhabited(F.col("lat"), F.col("lon"))).select("id")


@query(f"""select feature_id, seq, {r('sqrt((x - px) * (x - px) + (y - py) * (y - py))')} length from (select *, coalesce(lag(x) over w, last_value(x) over u) px, coalesce(lag(y) over w, last_value(y) over u) py from {STEPS}
  window w as (partition by feature_id order by seq), u as (partition by feature_id order by seq rows between unbounded preceding and unbounded following))""")
def w03_segment_lengths(spark, sf):
    return paths.segment_lengths(steps(spark, sf), ["feature_id"], closed=True).select("feature_id", "seq", R(F.col("length")).alias("length"))


_JUMPS = f"(select *, case when sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) > 1000 then 1 else 0 end jump from {STEPS} window w as (partition by feature_id order by seq))"


@query(f"""select feature_id, seq, piece, (row_number() over (partition by feature_id, piece order by seq))::int piece_seq from (
  select *, count(*) over (partition by feature_id, piece) n, sum(jump) over (partition by feature_id) jumps from (select *, (sum(jump) over (partition by feature_id order by seq))::bigint piece from {_JUMPS})) where n > 1 or jumps = 0""")
def w04_split_open_lines(spark, sf):
    return paths.split_lines(steps(spark, sf), ["feature_id"]).select("feature_id", "seq", "piece", "piece_seq")


@query(f"""with a as (select *, row_number() over w rn, count(*) over (partition by feature_id) n, sqrt(pow(x - coalesce(lag(x) over w, last_value(x) over u), 2) + pow(y - coalesce(lag(y) over w, last_value(y) over u), 2)) > 1000 jump from {STEPS}
  window w as (partition by feature_id order by seq), u as (partition by feature_id order by seq rows between unbounded preceding and unbounded following)),
b as (select *, min(case when jump then rn end) over (partition by feature_id) f, count(*) filter (jump) over (partition by feature_id) jumps from a),
c as (select *, case when f is null then rn else (rn - f + n) % n end pos from b),
d as (select *, (case when f is null then 0 else sum(jump::int) over (partition by feature_id order by pos) - 1 end)::bigint piece from c),
e as (select *, count(*) over (partition by feature_id, piece) m from d)
select feature_id, seq, piece, (row_number() over (partition by feature_id, piece order by pos))::int piece_seq from e where m > 1 or jumps = 0""")
def w04_split_closed_lines(spark, sf):
    return paths.split_lines(steps(spark, sf), ["feature_id"], closed=True).select("feature_id", "seq", "piece", "piece_seq")


@query(f"select feature_id, seq, (sum(jump) over (partition by feature_id order by seq))::bigint piece from (select *, case when abs(lon - lag(lon) over (partition by feature_id order by seq)) > 180 then 1 else 0 end jump from {LINES})")
def w05_longitude_pieces(spark, sf):
    return paths.longitude_pieces(polylines(spark, sf), ["feature_id"]).select("feature_id", "seq", "piece")


_SNAP = f"(select feature_id, seq, lat, case when seq % 7 = 0 then -180e0 else lon end lon from {LINES})"


@query(f"""with a as (select *, coalesce(lead(lon) over w > 0, false) nx, coalesce(lag(lon) over w > 0, false) pv from {_SNAP} window w as (partition by feature_id order by seq))
select feature_id, seq, 0 part, lat, lon from a union all select feature_id, seq, case when nx then 1 else -1 end, lat, 180e0 from a where lon = -180 and (nx or pv)""")
def w06_check_wrapping(spark, sf):
    d = polylines(spark, sf).withColumn("lon", F.when(F.col("seq") % 7 == 0, -180.0).otherwise(F.col("lon")))
    return paths.check_wrapping(d, ["feature_id"]).select("feature_id", "seq", "part", "lat", "lon")


def _divided_sql(pieces: str, first: str) -> str:
    return f"""with a as (select *, lag(lat) over w plat, lag(lon) over w plon from {LINES} window w as (partition by feature_id order by seq)),
b as (select *, case when plat is null then 1 else {pieces} end n from (select *, sqrt(pow(lat - plat, 2) + pow(lon - plon, 2)) len from a)),
c as (select *, unnest(generate_series(1, n::int)) part from b {first})
select feature_id, seq, part::int part, {r('case when part = n or plat is null then lat else (1 - part / n::double) * plat + part / n::double * lat end')} lat,
  {r('case when part = n or plat is null then lon else (1 - part / n::double) * plon + part / n::double * lon end')} lon from c"""


@query(_divided_sql("case when abs(lon - plon) > 180 then 0 else ceil(len / 10e0) end", "where n > 0"))
def w07_resolve_path(spark, sf):
    d = paths.resolve(polylines(spark, sf), ["feature_id"], 10.0)
    return d.select("feature_id", "seq", "part", R(F.col("lat")).alias("lat"), R(F.col("lon")).alias("lon"))


@query(_divided_sql("case when abs(lon - plon) > 180 then 1 else list_min(list_filter([1, 2, 4, 8, 16, 32, 64, 128, 256], lambda p: len / p <= 10e0)) end", ""))
def w08_refine_path(spark, sf):
    d = paths.refine(polylines(spark, sf), ["feature_id"], 10.0)
    return d.select("feature_id", "seq", "part", R(F.col("lat")).alias("lat"), R(F.col("lon")).alias("lon"))


_EDGES = f"(select feature_id, seq, lat, case when seq % 3 = 0 then 180e0 when seq % 3 = 1 then -180e0 else lon end lon from {LINES})"


@query(f"""with a as (select *, lag(lon) over (partition by feature_id order by seq) plon from {_EDGES}), b as (select *, coalesce(abs(lon - plon) = 360, false) jump from a),
c as (select *, count(*) filter (jump) over (partition by feature_id) jumps, max(case when jump then (lat, -seq) end) over (partition by feature_id) n, min(case when jump then (lat, seq) end) over (partition by feature_id) s from b),
d as (select *, case when jumps = 2 and s[2] = seq then -1 when jumps = 2 and -n[2] = seq then 1 when lon < plon then 1 else -1 end sg from c)
select feature_id, seq, 0 part, lat, lon from d union all select feature_id, seq, -1, sg * 90e0, lon from d where jump union all select feature_id, seq, -2, sg * 90e0, plon from d where jump""")
def w11_around_pole(spark, sf):
    d = polylines(spark, sf).withColumn("lon", F.when(F.col("seq") % 3 == 0, 180.0).when(F.col("seq") % 3 == 1, -180.0).otherwise(F.col("lon")))
    return paths.around_pole(d, ["feature_id"]).select("feature_id", "seq", "part", "lat", "lon")


# a stack per line: first vertices that repeat the last and spurs, then midpoints of straight lines
_DIRECTION = "(select [(y.lat - x.lat) / s, (y.lon - x.lon) / s] from (select case when x.lat = y.lat and x.lon = y.lon then 1e0 else greatest(abs(y.lat - x.lat), abs(y.lon - x.lon)) end s))"


def _turn(x: str, y: str, z: str) -> str:
    a, b = (_DIRECTION.replace("x.", f"({p}).").replace("y.", f"({q}).") for p, q in ((x, y), (y, z)))
    return f"({a} = {b} or {a} = list_transform({b}, lambda c: -c))"


@query(f"""with recursive l as (select o_custkey feature_id, list({{'seq': o_orderkey, 'lat': (o_orderkey % 3)::double, 'lon': (o_orderkey // 3 % 4)::double}} order by o_orderkey) v from orders group by o_custkey),
s as (select feature_id, 1 k, v[1:0] t from l union all
  select feature_id, k + 1, case when t[-1].lat = v[k].lat and t[-1].lon = v[k].lon then t when t[-2].lat = v[k].lat and t[-2].lon = v[k].lon then t[:-2] else list_append(t, v[k]) end from s join l using (feature_id) where k <= len(v)),
m as (select feature_id, t v from s join l using (feature_id) where k = len(l.v) + 1),
q as (select feature_id, 1 k, v[1:0] t from m union all
  select feature_id, case when straight then k else k + 1 end, case when straight then t[:-2] else list_append(t, v[k]) end
  from (select feature_id, k, t, v, len(t) > 1 and {_turn("t[-2]", "t[-1]", "v[k]")} straight from q join m using (feature_id) where k <= len(v)))
select feature_id, p.seq seq, p.lat lat, p.lon lon from (select feature_id, unnest(t) p from q join m using (feature_id) where k = len(v) + 1)""")
def w09_simplify_path(spark, sf):
    """Lines over few places, so that vertices repeat, turn back and go straight on."""
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("feature_id"), k.alias("seq"), (k % 3).cast("double").alias("lat"), (F.floor(k / 3) % 4).cast("double").alias("lon"))
    return paths.per_line(d, ["feature_id"], ("lat", "lon"), paths.simplified)


@query()
def j14_merge_closed_pieces(spark, sf):
    pieces = paths.split_lines(steps(spark, sf), ["feature_id"], closed=True).withColumn("line", F.lit(0))
    return paths.merge_closed(pieces, ["feature_id"])
