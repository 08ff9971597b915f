"""Queries for whole plans: meshes from cut files, map layers, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import features
from ..sources import sinks, text_files
from ..sources.fixtures import MESH, lat_sql, lon_sql, mesh, table
from ..streaming import projection
from . import build_mesh as plan
from .line_queries import region_sql, sections, sections_sql
from .linear_queries import _FEATURES, _shapes
from .mesh_queries import COLUMNS, ROWS, bilinear_sql, planar_sql, r
from .registry import query

R = geo.rounded


def _guessed_sql() -> str:
    """The constant terms ``gx, gy`` of surfaces near each missing node: normal equations, whose unknowns are
    eliminated one by one, the constant last."""
    terms, pulled = ["u", "w", "u * u", "u * w", "w * w", "1e0"], (2, 3, 4)
    pairs = [(a, b) for a in range(6) for b in range(a, 6)]
    sums = [f"sum(({terms[a]}) * ({terms[b]})) + {int(a == b and a in pulled)} m{a}{b}" for a, b in pairs]
    sums += [f"sum(({t}) * {z}) {z}{a}" for a, t in enumerate(terms) for z in "xy"]
    steps = [f"e0 as (select h, i, j, {', '.join(sums)} from near group by h, i, j having count(*) >= 5)"]
    for k in range(5):
        def less(value: str, a: int, other: str, k: int = k) -> str:
            return f"{value} - case when abs(m{k}{k}) < 1e-9 then 0 else m{k}{a} / m{k}{k} * {other} end {value}"

        kept = [less(f"m{a}{b}", a, f"m{k}{b}") for a, b in pairs if a > k] + [less(f"{z}{a}", a, f"{z}{k}") for a in range(k + 1, 6) for z in "xy"]
        steps.append(f"e{k + 1} as (select h, i, j, {', '.join(kept)} from e{k})")
    return f"""near as (select a.h, a.i, a.j, (b.i - a.i)::double u, (b.j - a.j)::double w, b.x, b.y from {MESH} a join {MESH} b on a.h = b.h and abs(a.i - b.i) + abs(a.j - b.j) <= 3 where a.x is null and b.x is not null),
{", ".join(steps)}, guessed as (select h, i, j, x5 / m55 gx, y5 / m55 gy from e5)"""


@query(f"with {_guessed_sql()} select h, i, j, lat, lon, {r('coalesce(x, gx)')} x, {r('coalesce(y, gy)')} y from {MESH} left join guessed using (h, i, j)")
def w14_dilate_mesh(spark, sf):
    d = plan.dilate_mesh(mesh(spark))
    return d.withColumns({c: R(F.col(c)) for c in "xy"})


_INNER = f"(select * replace (lat * 0.97e0 as lat, lon * 0.97e0 as lon) from {_FEATURES})"


def _inner(spark, sf):
    """Features whose vertices are on no edge of a section."""
    return features.load_features(_shapes(spark, sf)).withColumn("lat", F.col("lat") * 0.97).withColumn("lon", F.col("lon") * 0.97)


_PROJECTED = f"""(select f.*, s.section from (select feature_id * 1000000000 + line * 10 + seq id, * from {_INNER}) f join
  (select id, max(case when inside then h end) section from {planar_sql('(select feature_id * 1000000000 + line * 10 + seq id, lat, lon from ' + _INNER + ')', sections_sql('example'))} group by id) s using (id))"""


@query(bilinear_sql(_PROJECTED, "feature_id, line, seq, section"))
def i06_project_features(spark, sf):
    d = features.project_features(_inner(spark, sf), mesh(spark), sections(spark, "example"), ROWS, COLUMNS)
    return d.select("feature_id", "line", "seq", "section", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


@query(f"""with p as ({bilinear_sql(_PROJECTED, 'feature_id, line, seq, category, width')}), q as (select * from p where x is not null),
j as (select *, case when sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) > 1000 then 1 else 0 end jump from q window w as (partition by feature_id, line order by seq)),
k as (select *, (sum(jump) over (partition by feature_id, line order by seq))::bigint piece, sum(jump) over (partition by feature_id, line) jumps from j),
m as (select *, count(*) over (partition by feature_id, line, piece) n from k)
select feature_id, line, piece, (row_number() over (partition by feature_id, line, piece order by seq))::int piece_seq, x, y, ((category % 8) + 8) % 8 color, width from m where n > 1 or jumps = 0""")
def i07_create_map(spark, sf):
    d = features.create_map(_inner(spark, sf), mesh(spark), sections(spark, "example"), ROWS, COLUMNS, 8)
    return d.withColumn("x", R(F.col("x"))).withColumn("y", R(F.col("y")))


_EVENTS = f"(select event_id id, event_id, ts, value, {lat_sql('user_id')} lat, {lon_sql('user_id')} lon from events)"


@query(f"""select date_trunc('hour', ts) "start", section, count(*) n, round(sum(value), 4) + 0 total from {_EVENTS} e left join (select id, min(h) section from {region_sql(_EVENTS, sections_sql('example'), 'id')} where inside group by id) s using (id) group by 1, 2""")
def x01_event_windows(spark, sf):
    d = projection.windowed_counts(projection.project_events(table(spark, sf, "events"), mesh(spark), sections(spark, "example"), ROWS, COLUMNS))
    return d.withColumn("total", R(F.col("total"), 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


_MAPS = {"one": "0,0.25,0.5\n1,1,0.75", "two": "0.125,0,1"}
_LABELS = """{"en": {"title": "Map", "units": "km"}, "es": {"title": "Mapa"}}"""


@query("select name, (k - 1)::int seq, split_part(line, ',', 1)::double r, split_part(line, ',', 2)::double g, split_part(line, ',', 3)::double b from (select name, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from (values " + ", ".join(f"('{k}', '{v}')" for k, v in _MAPS.items()) + ") f(name, text))")
def s14_colormaps(spark, sf):
    return text_files.parse_colormaps(text_files.texts(spark, _MAPS))


@query(f"""select lang, key "key", json_extract_string(j, '$.' || lang || '.' || key) "value" from (select lang, unnest(json_keys(j, '$.' || lang)) key, j from (select unnest(json_keys(j)) lang, j from (select '{_LABELS}'::json j)))""")
def s15_languages(spark, sf):
    return text_files.parse_languages(text_files.texts(spark, {"lang": _LABELS}))


@query(f"select h, i, j, (sum(case when x is not null then 1 else 0 end) over (partition by h order by i, j) - 1)::bigint \"index\" from {MESH}")
def w02_running_reindex(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("h").orderBy("i", "j").rowsBetween(W.unboundedPreceding, 0)
    return mesh(spark).select("h", "i", "j", (F.sum(F.col("x").isNotNull().cast("int")).over(w) - 1).alias("index"))


@query()
def l11_fit_mesh(spark, sf):
    from .fit import fit_mesh
    from .mesh_queries import _weights

    fitted, _ = fit_mesh(spark, mesh(spark, sections=1), _weights(spark).where("h = 0"), 22.5, 22.5, 1e-6, 30)
    return fitted.select("h", "i", "j", R(F.col("x"), 1).alias("x"), R(F.col("y"), 1).alias("y"))


# a language file with the templates of the text form and the names of the structured one
_TERMS = {
    "en": {
        "numerals": ["0", "I", "II"], "name": "name", "descript": "about", "units": "units", "title #": "Map {}", "title 2 descript": "Second of the maps", "section #": "Section {}", "projection header": "Map {} of {} sections:\n",
        "section header": "  Section {}:\n", "section boundary header": "    Border ({} vertices):\n", "section points header": "    Points ({}x{}x{}):\n", "boundary header": "  Outline ({} vertices):\n", "inverse header": "  Raster ({}x{}x{}):\n",
        "projected boundary": "outline", "bounding box": "box", "inverse points": "raster", "boundary": "border", "projected points": "points", "Africa": "Africa", "Australia": "Australia", "America": "the Americas",
        **{f"{k} descript": f"What {k} holds" for k in ("projected boundary", "bounding box", "inverse points", "boundary", "projected points")},
    },
}
_TERMS["es"] = {k: v if isinstance(v, list) else v.replace("Map", "Mapa").replace("Section", "Secci\u00f3n").replace("Border", "Borde") for k, v in _TERMS["en"].items()}


def _terms(spark):
    import json

    return text_files.parse_languages(text_files.texts(spark, {"lang": json.dumps(_TERMS)}))


def _term(key: str) -> str:
    return "case lang " + " ".join(f"when '{k}' then '{v[key]}'" for k, v in _TERMS.items()) + " end"


def _filled_sql(key: str, *values: str) -> str:
    parts = {k: v[key].rstrip("\n").split("{}") for k, v in _TERMS.items()}
    one = lambda p: " || ".join([f"'{p[0]}'", *(f"({v})::varchar || '{p[k + 1]}'" for k, v in enumerate(values))])
    return "case lang " + " ".join(f"when '{k}' then {one(p)}" for k, p in parts.items()) + " end"


_LANG = "(values ('en'), ('es')) l(lang)"
_RASTER = "(select a::int ix, b::int iy, -900e0 + 600e0 * a x, -300e0 + 300e0 * b y, case when (a + b) % 4 <> 1 then 10e0 * a - 7.5e0 * b end lat, case when (a + b) % 4 <> 1 then 20e0 * b - 15.5e0 * a end lon from range(4) a(a), range(3) b(b))"


def _raster(spark):
    a, b = F.col("id") % 4, F.floor(F.col("id") / 4)
    there = (a + b) % 4 != 1
    return spark.range(12).select(a.cast("int").alias("ix"), b.cast("int").alias("iy"), (600.0 * a - 900.0).alias("x"), (300.0 * b - 300.0).alias("y"), F.when(there, 10.0 * a - 7.5 * b).alias("lat"), F.when(there, 20.0 * b - 15.5 * a).alias("lon"))


_N = "'nan'::double"


@query(f"""with m as {MESH}, b as {sections_sql('example')}, o as (select j seq, x, y from m where h = 0 and i = 4),
lines as (select 0 block, -1 h, 0 part, 0 seq, {_filled_sql('projection header', "'II'", '(select count(distinct h) from m)')} "value", lang from {_LANG}
union all select 1, h, 0, 0, {_filled_sql('section header', 'h')}, lang from (select distinct h from b), {_LANG}
union all select 1, h, 0, 1, {_filled_sql('section boundary header', 'n')}, lang from (select h, count(*) n from b group by h), {_LANG}
union all select 1, h, 1, seq, printf('%6.1f,%6.1f', lat, lon), lang from b, {_LANG}
union all select 1, h, 2, 0, {_filled_sql('section points header', '9', '17', '2')}, lang from (select distinct h from m), {_LANG}
union all select 1, h, 3, i, s, lang from (select h, i, string_agg(replace(printf('%9.2f,%9.2f', coalesce(x, {_N}), coalesce(y, {_N})), 'nan', 'NaN'), ',' order by j) s from m group by h, i), {_LANG}
union all select 2, -1, 0, 0, {_filled_sql('boundary header', '(select count(*) from o)')}, lang from {_LANG}
union all select 2, -1, 1, seq, printf('%9.2f,%9.2f', x, y), lang from o, {_LANG}
union all select 3, -1, 0, 0, {_filled_sql('inverse header', '3', '4', '2')}, lang from {_LANG}
union all select 3, -1, 1, 0, printf('%9.2f,%9.2f,%9.2f,%9.2f', min(x), min(y), max(x), max(y)), lang from {_RASTER}, {_LANG} group by lang
union all select 3, -1, 2, iy, string_agg(replace(printf('%6.1f,%6.1f', coalesce(lat, {_N}), coalesce(lon, {_N})), 'nan', 'NaN'), ',' order by ix), lang from {_RASTER}, {_LANG} group by iy, lang)
select lang, block, h, part, seq::bigint seq, "value" from lines""")
def k05_projection_text(spark, sf):
    m = mesh(spark)
    outline = m.where("h = 0 and i = 4").select(F.col("j").alias("seq"), "x", "y")
    d = sinks.projection_text(m, sections(spark, "example"), outline, _raster(spark), _terms(spark), 2)
    return d.select("lang", "block", "h", "place.part", "place.seq", "value")


_NAMES = ("Africa", "Australia", "America")
_UNITS = {"projected boundary": "km", "bounding box": "km", "inverse points": "\u00b0", "boundary": "\u00b0", "projected points": "km"}


@query(f"""select lang, '' item, {_term('name')} attribute, {_filled_sql('title #', "'II'")} "value" from {_LANG} union all select lang, '', {_term('descript')}, {_term('title 2 descript')} from {_LANG}
""" + "".join(f" union all select lang, {_term(k)}, {_term('units')}, '{u}' from {_LANG} union all select lang, {_term(k)}, {_term('descript')}, {_term(k + ' descript')} from {_LANG}" for k, u in _UNITS.items())
    + "".join(f" union all select lang, {_filled_sql('section #', str(h))}, {_term('name')}, {_term(n)} from {_LANG}" for h, n in enumerate(_NAMES)))
def k04_projection_attributes(spark, sf):
    return sinks.projection_attributes(_terms(spark), spark.createDataFrame(list(enumerate(_NAMES)), "h int, name string"), 2)


@query(f"select s.h, name, count(x) nodes from (values (0, 'Africa'), (1, 'Australia'), (2, 'America')) s(h, name) join {MESH} m using (h) group by s.h, name")
def s13_diagram_sections(spark, sf):
    from ..sources.scratch import shared_path

    path = shared_path(spark, "projection")
    sinks.save_projection({"mesh": mesh(spark), "border": sections(spark, "example"), "sections": spark.createDataFrame(list(enumerate(_NAMES)), "h int, name string")}, path)
    m, _, names = sinks.load_diagram(spark, path)
    return m.join(names, "h").groupBy("h", "name").agg(F.count("x").alias("nodes"))
