"""Closed forms, brute force and round trips for what has no SQL twin."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import geo
from meshlake.operators import cells, divides, interpolation, optimize, paths, polygon, raster
from meshlake.plans import build_mesh as plan
from meshlake.sources import fixtures, resources, sinks, text_files

ROWS, COLUMNS = 9, 17


def cuts(spark, name):
    return text_files.parse_cuts(text_files.texts(spark, {name: resources.CUTS[name]})).drop("name")


def test_glue_point_is_the_origin(spark):
    d = spark.range(1).select(geo.oblique_stereographic(20.0, 30.0, (0.3, 0.9), (20.0, 30.0)).alias("o"), geo.oblique_stereographic(20.001, 30.0, (0.3, 0.9), (20.0, 30.0)).alias("n")).first()
    assert math.hypot(d.o.x, d.o.y) < 1e-6
    assert abs(d.n.x) < 1e-3 and math.isclose(d.n.y, 1.5 * geo.EARTH.a * math.radians(0.001), rel_tol=1e-3)


def test_isometry_has_unit_strains(spark):
    s = spark.range(1).select(geo.principal_strains(math.cos(1.0), math.sin(1.0), -math.sin(1.0), math.cos(1.0)).alias("s")).first().s
    assert math.isclose(s.a, 1) and math.isclose(s.b, 1)


def test_nodes_project_to_themselves(spark):
    m = fixtures.mesh(spark).where("h <> 1")
    p = m.select(F.monotonically_increasing_id().alias("id"), F.col("h").alias("section"), "lat", "lon", F.col("x").alias("wx"), F.col("y").alias("wy"))
    for project in (interpolation.project_bilinear, interpolation.project_hermite):
        d = project(p, fixtures.mesh(spark), ROWS, COLUMNS)
        assert d.where((F.abs(F.col("x") - F.col("wx")) > 1e-6) | (F.abs(F.col("y") - F.col("wy")) > 1e-6) | F.col("x").isNull()).count() == 0


def test_weights_apply_as_projection(spark):
    p = fixtures.points(spark, "/root/testdata/sf0.001").withColumn("section", (F.col("id") % 3).cast("int"))
    a = {r.id: (r.x, r.y) for r in interpolation.project_bilinear(p, fixtures.mesh(spark), ROWS, COLUMNS).where("x is not null").collect()}
    b = {r.id: (r.x, r.y) for r in interpolation.apply_weights(interpolation.bilinear_weights(p, ROWS, COLUMNS), fixtures.mesh(spark)).where("x is not null").collect()}
    assert a.keys() <= b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_inverse_brings_points_back(spark):
    ring = spark.createDataFrame([(0, k, a, b) for k, (a, b) in enumerate([(-80.0, -170.0), (-80.0, 0.0), (-80.0, 170.0), (80.0, 170.0), (80.0, 0.0), (80.0, -170.0), (-80.0, -170.0)])], "h int, seq int, lat double, lon double")
    m = fixtures.mesh(spark, sections=1)
    p = spark.createDataFrame([(k, 0, -60.0 + 7.3 * k, -150.0 + 19.1 * k) for k in range(16)], "id int, section int, lat double, lon double")
    t = interpolation.project_bilinear(p, m, ROWS, COLUMNS).select("id", "x", "y")
    got = {r.id: (r.lat, r.lon) for r in interpolation.inverse_project(t, m, ring, ROWS, COLUMNS).collect()}
    for r in p.collect():
        assert np.allclose(got[r.id], (r.lat, r.lon), atol=1e-6)


def test_decimation_stays_close():
    rng = np.random.default_rng(0)
    path = np.cumsum(rng.normal(size=(200, 2)), axis=0)
    kept = paths.decimated(path, 2.0)
    for a, z in zip(kept, kept[1:]):
        d = path[z] - path[a]
        for p in path[a + 1 : z]:
            along = (p - path[a]) @ d / np.hypot(*d)
            assert (p - path[a]) @ (p - path[a]) - along**2 < 4.0 + 1e-9


def test_simplified_paths():
    square = np.array([(0, 0), (0, 1), (0, 1), (0, 2), (0, 3), (0, 2), (2, 2), (2, 0), (1, 0)], float)
    assert square[paths.simplified(square)].tolist() == [[0, 0], [0, 2], [2, 2], [2, 0], [1, 0]]
    assert square[paths.simplified(square, cyclic=True)].tolist() == [[0, 0], [0, 2], [2, 2], [2, 0]]


def test_hull_contains_all():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(60, 2))
    hull = p[paths.convex_hull(p)]
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        d = b - a
        assert (d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0]) >= -1e-12).all()


def test_rectangle_is_landscape_and_centred(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(12):
        a = rng.uniform(0, 2 * math.pi)
        p = rng.uniform(-1, 1, (30, 2)) * (5, 2) @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + rng.normal(size=2) * 9
        rows += [(f, k, *map(float, v)) for k, v in enumerate(p)]
    d = spark.createDataFrame(rows, "f int, seq int, x double, y double")
    fit = cells.fit_in_rectangle(paths.per_line(d, ["f"], ("x", "y"), paths.convex_hull), ["f"])
    t = d.join(fit, "f").withColumn("p", geo.rotate_and_shift("x", "y", "rotation", "dx", "dy"))
    for r in t.groupBy("f").agg(F.min("p.x").alias("a"), F.max("p.x").alias("b"), F.min("p.y").alias("c"), F.max("p.y").alias("d")).collect():
        assert math.isclose(r.a, -r.b, abs_tol=1e-6) and math.isclose(r.c, -r.d, abs_tol=1e-6) and r.b >= r.d


@pytest.mark.parametrize("name", ["example", "basic", "oceans"])
def test_touched_cells(spark, name):
    """Against fine sampling of the borders."""
    n = 8
    border = plan.section_borders(cuts(spark, name)).where("part = 'border'")
    got = {(r.h, r.i, r.j) for r in raster.cells_touched_by(border.drop("part"), n).collect()}
    step, want = 180 / n, set()
    rows = sorted(border.collect(), key=lambda r: (r.h, r.seq))
    for a, b in zip(rows, rows[1:]):
        if a.h != b.h or abs(a.lon - b.lon) > 180:
            continue
        for t in np.linspace(0, 1, 2001)[1:-1]:
            i, j = (a.lat + t * (b.lat - a.lat) + 90) / step, (a.lon + t * (b.lon - a.lon) + 180) / step
            if min(i % 1, 1 - i % 1) > 1e-3 and min(j % 1, 1 - j % 1) > 1e-3:
                want.add((a.h, math.floor(i), math.floor(j)))
    assert want <= got
    assert len(got - want) <= 0.8 * len(got) + 8


def test_build_mesh(spark):
    m, borders = plan.build_mesh(spark, cuts(spark, "example"), 4)
    rows = m.collect()
    assert len(rows) == 3 * 9 * 17 and borders.select("h").distinct().count() == 3
    there = [r for r in rows if r.x is not None]
    assert 0.3 < len(there) / len(rows) < 1
    north = {(round(r.x, 6), round(r.y, 6)) for r in there if r.i == 8}
    assert len(north) == 1 and abs(next(iter(north))[0]) < 1e-3  # the glue point, shared by all
    west = {(r.h, r.i): (r.x, r.y) for r in rows if r.j == 0}
    assert all((r.x, r.y) == west[r.h, r.i] for r in there if r.j == 16)


def test_dilate_mesh(spark):
    d = plan.dilate_mesh(fixtures.mesh(spark))
    assert d.where("x is null").count() == 0
    old = fixtures.mesh(spark).select("h", "i", "j", F.col("x").alias("ox"))
    assert d.join(old, ["h", "i", "j"]).where("ox is not null and x <> ox").count() == 0


def test_find_boundaries():
    mask = np.zeros((6, 7), bool)
    mask[1:5, 1:6] = True
    (line,) = plan.find_boundaries(mask)
    assert {(1, 1), (4, 1), (4, 5), (1, 5)} <= set(line)
    assert all(mask[int(a), int(b)] or (a, b) == () for a, b in line)
    assert len(plan.find_boundaries(np.zeros((3, 3), bool))) == 0


def test_minimize():
    a = np.array([[1.0, -0.9], [-0.9, 1.0]])
    seen = []

    def f(x):
        v = optimize.Variable.independent(x)
        d = v - np.array([2.0, -3.0])
        q = (d * d).sum() + (d[0] * d[1]) * 0.5 + (v * v * v * v).sum() * 0.1
        return float(q.value), q.gradient, q.hessian

    got = optimize.minimize(f, np.array([1.0, -1.0]), 1e-8, lambda x, v, g, s: seen.append(v))
    assert got.reason == "optimal" and all(b <= a_ for a_, b in zip(seen, seen[1:])) and np.linalg.norm(f(got.state)[1]) < 1e-8
    bounded = optimize.minimize_with_bounds(lambda x: (float((x - 5) @ a @ (x - 5)), 2 * a @ (x - 5), 2 * a), np.zeros(2), 1e-6, np.eye(2), np.array([1.0, np.inf]), 1e-4)
    assert bounded.state[0] <= 1 and bounded.state[0] > 0.98
    assert optimize.minimize(lambda x: (-np.inf, x, a), np.ones(2), 1e-6).reason == "feasible"


def test_variable_derivatives():
    rng = np.random.default_rng(3)
    x0 = rng.uniform(0.5, 2, 3)

    def f(v):
        return ((v * v + 2) / v).sqrt().sum() + (v[0] * v[1]).exp() - (v[2] + 1).log() * 3 + 1 / v[1] + (np.array([1.0, 2, 3]) @ v)

    q, e = f(optimize.Variable.independent(x0)), 1e-5
    grad = [(f(optimize.Variable.independent(x0 + e * d)).value - f(optimize.Variable.independent(x0 - e * d)).value) / (2 * e) for d in np.eye(3)]
    hess = [(f(optimize.Variable.independent(x0 + e * d)).gradient - f(optimize.Variable.independent(x0 - e * d)).gradient) / (2 * e) for d in np.eye(3)]
    assert np.allclose(q.gradient, grad, atol=1e-7) and np.allclose(q.hessian, hess, atol=1e-6)
    assert (optimize.Variable.independent(x0) > 0.1).all()


def test_polytope():
    b = np.array([[1.0, 0], [-1, 0], [0, 1], [0, -1], [1, 1]])
    x = optimize.polytope_project(np.array([-2.0, -1.6]), b, np.ones(5))
    assert np.allclose(x, [-1, -1], atol=1e-6)
    assert (b @ optimize.crudely_polytope_project(np.array([3.0, 2.0]), b, np.ones(5)) <= 1 + 1e-6).all()
    assert optimize.is_positive_definite(np.eye(2)) and not optimize.is_positive_definite(-np.eye(2))
    assert optimize.minimum_swaps([1, 2, 0, 3]) == 2 and np.allclose(optimize.inverse_matmul(np.eye(2) * 2, np.ones(2)), 0.5)
    assert len(optimize.schedule(21)) == 4 and len(optimize.schedule(49)) == 5


def test_highest_path_has_the_best_bottleneck(spark):
    rng = np.random.default_rng(5)
    z = {(i, j): float(v) for (i, j), v in np.ndenumerate(rng.integers(0, 50, (8, 10)))}
    path = divides.highest_path(z, (1, 1), {(6, 6)}, 10)
    assert path[0] == (1, 1) and path[-1] == (6, 6)
    assert all(abs(a[0] - b[0]) <= 1 and (abs(a[1] - b[1]) <= 1 or abs(a[1] - b[1]) == 9) for a, b in zip(path, path[1:]))
    reach = {k: -1.0 for k in z}
    reach[1, 1] = z[1, 1]
    for _ in range(80):
        for (i, j), v in list(reach.items()):
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    k = i + di, (j + dj) % 10
                    if k in z:
                        reach[k] = max(reach[k], min(v, z[k]))
    assert min(z[p] for p in path) == reach[6, 6]


def test_bottleneck_follows_long_paths(spark, tmp_path):
    # a ring of 70 cells with a low one beside the start: the best path to those behind it goes round, 64 steps
    z = [1.0 if j == 5 else 100.0 - j for j in range(70)]
    ring = spark.createDataFrame([(0, j, v) for j, v in enumerate(z)], "i int, j int, z double").coalesce(1)
    start = spark.createDataFrame([(0, 0)], "i int, j int")

    def write(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = {r.j: r.z for r in divides.bottleneck(spark, ring, start, 70, checkpoint=write).collect()}
    assert got == {j: max(min(z[: j + 1]), min([z[0], *z[j:]])) for j in range(70)}
    with pytest.raises(RuntimeError):
        divides.bottleneck(spark, ring, start, 70, rounds=5, checkpoint=write)


def test_round_trips(spark, tmp_path):
    m, ring = fixtures.mesh(spark), spark.createDataFrame([(0, 0, 1.0, 2.0)], "h int, seq int, lat double, lon double")
    sinks.save_mesh(m, ring, f"{tmp_path}/mesh")
    back, _ = sinks.load_mesh(spark, f"{tmp_path}/mesh")
    assert back.select(m.columns).exceptAll(m).count() == 0 and back.count() == m.count()
    w = spark.createDataFrame([("basic", h, kind, crop, i, 0, float(i)) for h in (0, 1) for kind in ("land", "sea") for crop in (False, True) for i in range(3)], "cut_set string, h int, kind string, crop boolean, i int, j int, value double")
    sinks.save_weights(w, f"{tmp_path}/w")
    assert sinks.load_weights(spark, f"{tmp_path}/w", "basic", "land", True).count() == 6
    assert sinks.load_weights(spark, None, cells=w).agg(F.min("value"), F.max("value"), F.count("h")).first()[:] == (1.0, 1.0, w.count())
    line = text_files.parse_cuts(text_files.texts(spark, {"oceans": resources.CUTS["oceans"]}))
    sinks.save_cuts(line, f"{tmp_path}/cuts")
    again = text_files.parse_cuts(text_files.read_whole(spark, f"{tmp_path}/cuts/part*"))
    assert [(r.lat, r.lon, r.cut) for r in again.orderBy("seq").collect()] == [(r.lat, r.lon, r.cut) for r in line.orderBy("seq").collect()]
    box = cells.bounding_box(m)
    sinks.save_projection({"mesh": m, "border": ring, "boundary": ring, "bbox": box}, f"{tmp_path}/p")
    *_, aspect = sinks.load_projection(spark, f"{tmp_path}/p")
    assert aspect > 0
    (tmp_path / "lang.json").write_text('{"en": {"a": "x"}, "es": {"a": "y", "n": [1, 2]}}')
    assert {(r.lang, r.key, r.value) for r in text_files.read_languages(spark, f"{tmp_path}/lang.json").collect()} == {("en", "a", "x"), ("es", "a", "y"), ("es", "n", "[1,2]")}
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps/speed.csv").write_text("0.1,0.2,0.3\n1,1,1\n")
    assert [(r.name, r.seq, r.b) for r in text_files.read_colormaps(spark, f"{tmp_path}/maps").orderBy("seq").collect()] == [("speed", 0, 0.3), ("speed", 1, 1.0)]


def test_event_stream(spark, tmp_path):
    from meshlake.plans.line_queries import sections
    from meshlake.streaming import projection

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    d = projection.windowed_counts(projection.project_events(stream, fixtures.mesh(spark), sections(spark, "example"), ROWS, COLUMNS))
    q = d.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == src.count()


def test_planar_orientation():
    assert polygon.signed_area([(0, 0), (0, 1), (1, 1), (1, 0)]) > 0


def test_fit_lowers_the_energy(spark):
    from meshlake.plans.fit import fit_mesh
    from meshlake.plans.mesh_queries import _weights

    start = fixtures.mesh(spark, sections=1)
    fitted, log = fit_mesh(spark, start, _weights(spark).where("h = 0"), 22.5, 22.5, 1e-6, 30)
    assert len(log) > 2 and all(b <= a for a, b in zip(log, log[1:])) and log[-1] < 0.5 * log[0]
    assert fitted.count() == start.count() and fitted.where("x is null").count() == 0


def test_fit_reports_what_is_not_fitted(spark):
    from meshlake.plans.fit import Infeasible, fit_mesh
    from meshlake.plans.mesh_queries import _weights

    start, w = fixtures.mesh(spark, sections=1), _weights(spark).where("h = 0")
    with pytest.raises(Infeasible):  # mirrored, so all areas are negative
        fit_mesh(spark, start.withColumn("x", -F.col("x")), w, 22.5, 22.5, 1e-6, 1)
    with pytest.raises(optimize.TooManySteps):
        fit_mesh(spark, start, w, 22.5, 22.5, 1e-12, 3)


def test_drainage_divides_meet():
    rng = np.random.default_rng(6)
    z = {(i, j): float(v) for (i, j), v in np.ndenumerate(rng.integers(1, 50, (9, 12)))}
    cuts = divides.drainage_divides(z, [(1, 1), (7, 2), (2, 9), (7, 9)], 12)
    assert len(cuts) == 4 and len({c[0] for c in cuts}) == 1
    assert [c[-1] for c in cuts] == [(1, 1), (7, 2), (2, 9), (7, 9)]  # in the order of the ends
    wet = {p: 0.0 if p in {cuts[0][1], cuts[2][-1]} else v for p, v in z.items()}
    assert all(wet[p] > 0 for c in divides.drainage_divides(wet, [(1, 1), (7, 2), (2, 9), (7, 9)], 12) for p in c)
    assert divides.drainage_divides(dict.fromkeys(z, 0.0), [(1, 1), (7, 2)], 12) == [[]]


def test_highest_paths_take_no_detours():
    plain = {(i, j): 1.0 for i in range(5) for j in range(7)}
    # a longer path has all of a shorter one's heights and more, so only the rule against detours keeps it from winding
    path = divides.highest_path(plain, (2, 1), {(2, 5)}, 100)
    assert path[0] == (2, 1) and path[-1] == (2, 5)
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 1 for a, b in zip(path, path[2:]))
    # higher ground beside the way is no detour if the direct move is shut
    z = {(0, 0): 5.0, (0, 1): 5.0, (1, 0): 9.0, (1, 1): 9.0}
    assert divides.highest_path(z, (0, 0), {(0, 1)}, 100) == [(0, 0), (0, 1)]
    shut = {(0, 0, 0, 1), (0, 1, 0, -1)}
    assert divides.highest_path(z, (0, 0), {(0, 1)}, 100, shut) in ([(0, 0), (1, 0), (0, 1)], [(0, 0), (1, 1), (0, 1)])
    # one path's heights and more are the greater ones
    z = {(0, 0): 3.0, (0, 1): 7.0, (0, 2): 3.0, (1, 0): 8.0, (2, 1): 8.0, (1, 2): 8.0}
    shut = {(0, 1, 1, -1), (1, 0, -1, 1), (0, 1, 1, 1), (1, 2, -1, -1)}
    assert divides.highest_path(z, (0, 0), {(0, 2)}, 100, shut) == [(0, 0), (1, 0), (2, 1), (1, 2), (0, 2)]
    with pytest.raises(ValueError):
        divides.highest_path({(0, 0): 1.0, (0, 2): 1.0}, (0, 0), {(0, 2)}, 100)


def test_fit_inside_a_size(spark):
    from meshlake.plans import fit
    from meshlake.plans.mesh_queries import _weights

    m, w = fixtures.mesh(spark, sections=1), _weights(spark).where("h = 0")
    ring = [(0, k, float(a), float(b)) for k, (a, b) in enumerate([*((-67.5, x) for x in range(-170, 171, 10)), *((y, 170.0) for y in range(-60, 61, 10)), *((67.5, x) for x in range(170, -171, -10)), *((y, -170.0) for y in range(60, -61, -10))])]
    border = spark.createDataFrame(ring, "h int, seq int, lat double, lon double")
    free, _ = fit.fit_mesh(spark, m, w, 22.5, 22.5, 1e-6, 60)
    points = border.select("seq", F.col("h").alias("section"), "lat", "lon")
    extent = lambda mesh: interpolation.project_bilinear(points, mesh, ROWS, COLUMNS).agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    wide = extent(free)
    size = (0.8 * wide.w, 0.8 * wide.w)  # a square, as the energy does not change when a map is turned
    bound, _ = fit.fit_mesh(spark, m, w, 22.5, 22.5, 1e-6, 60, size=size, border=border, rest=10.0)
    got = extent(bound)
    assert got.x < size[0] / 2 and got.y < size[1] / 2 and max(got.w, got.h) > 0.9 * size[0]


def test_shape_files(spark, tmp_path):
    import io
    import zipfile

    from meshlake.sources import shape_files

    rng = np.random.default_rng(3)
    shapes = [[rng.uniform(-90, 90, (k + 3, 2)) for k in range(parts)] for parts in (1, 3, 2)]
    names, fields = ["first", "", "third"], b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
    table = b"\x03" + bytes(3) + (3).to_bytes(4, "little") + (65).to_bytes(2, "little") + (9).to_bytes(2, "little") + bytes(20) + fields + b"\r" + b"".join(b" " + n.encode().ljust(8) for n in names)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.shp", shape_files.encode_shapes(shapes))
        z.writestr("a.dbf", table)
    (tmp_path / "some.zip").write_bytes(packed.getvalue())
    (tmp_path / "more.shp").write_bytes(shape_files.encode_shapes(shapes[:1], shape_files.LINE))
    got = shape_files.read_shapes(spark, str(tmp_path))
    want = {(s, k, p, q, float(v[1]), float(v[0])) for s, own in (("some", shapes), ("more", shapes[:1])) for k, parts in enumerate(own) for p, xy in enumerate(parts) for q, v in enumerate(xy)}
    assert {tuple(r)[:6] for r in got.collect()} == want
    assert {(r.shape_id, r.n) for r in got.where("source = 'some'").selectExpr("shape_id", "attributes['name'] n").collect()} == {(0, "first"), (1, None), (2, "third")}
    land = shape_files.load_land_polygons(got.where("source = 'some'"))
    assert land.groupBy("h").agg(F.max("seq").alias("m")).orderBy("h").collect() == [(0, 2), (1, 11), (2, 6)]
    with pytest.raises(ValueError):
        list(shape_files.parse_shapes(bytes(120)))


def test_both_plans_of_planar_containment(spark, monkeypatch):
    """Points on edges and vertices, and rings of either direction."""
    square = [(-10.0, -10.0), (-10.0, 10.0), (10.0, 10.0), (10.0, -10.0), (-10.0, -10.0)]
    inner = [(-3.5, -3.5), (3.5, -3.5), (3.5, 3.5), (-3.5, 3.5), (-3.5, -3.5)]
    d = spark.createDataFrame([(h, k, *p) for h, ring in ((0, square), (1, inner)) for k, p in enumerate(ring)], "h int, seq int, lat double, lon double")
    p = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate((a, b) for a in (-11, -10, -3.5, 0, 3.5, 9, 10) for b in (-10.5, -10, -3.5, 0, 3.5, 10))], "id int, lat double, lon double")
    few = [polygon.contains(p, d, ["id"]).orderBy("id", "h").collect(), polygon.last_section(p, d).orderBy("id").collect(), polygon.first_section(p, d, ["id"]).select("id", "section").orderBy("id").collect()]
    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    assert [polygon.contains(p, d, ["id"]).orderBy("id", "h").collect(), polygon.last_section(p, d).orderBy("id").collect(), polygon.first_section(p, d, ["id"]).select("id", "section").orderBy("id").collect()] == few
    assert {(r.id, r.h) for r in polygon.containing(p, d, ["id"], planar=True).collect()} == {(r.id, r.h) for r in few[0] if r.inside}


def test_nearest_nodes_in_and_outside_the_box(spark):
    rng = np.random.default_rng(5)
    m = fixtures.mesh(spark)
    nodes = [r for r in m.collect() if r.x is not None]
    t = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(-16000, 16000, (300, 2)))] + [(900 + k, r.x, r.y) for k, r in enumerate(nodes[::40])]
    got = {(r.id, r.h): r.d2 for r in interpolation.nearest_nodes(spark.createDataFrame(t, "id int, x double, y double"), m, 7).collect()}
    for i, x, y in t:
        for h in {n.h for n in nodes}:
            assert math.isclose(got[i, h], min((n.x - x) ** 2 + (n.y - y) ** 2 for n in nodes if n.h == h), rel_tol=1e-12, abs_tol=1e-12)


def test_decimation_across_the_antimeridian():
    path = np.array([(0, 170), (0.1, 175), (0, 179), (0, -179), (5, -175), (0, -170), (0, 178)], float)
    assert paths.decimated(path, 1.0, wrap=True).tolist() == [0, 2, 3, 4, 5, 6]
    assert paths.decimated(path[:3], 1.0).tolist() == [0, 2]


def test_divides_as_cut_files(spark):
    cuts = [[(9, 13), (9, 14), (9, 15), (9, 16)], [(9, 13), (8, 12), (7, 13)], []]
    d = divides.divide_cuts(spark, cuts, 0.1, 0.5)
    assert [tuple(r) for r in d.orderBy("seq").collect()] == [(0, 0, -90.0, 0.0), (1, 1, 0.0, -50.0), (2, 1, 0.0, -20.0), (3, 2, 0.0, -50.0), (4, 2, -10.0, -60.0), (5, 2, -20.0, -50.0)]
    # over the antimeridian, either way: the vertex at its border stands on both sides
    d = divides.divide_cuts(spark, [[(9, 34), (9, 35), (9, 0), (9, 1)], [(9, 1), (9, 0), (9, 35)]], 0.1, 0.5, glue=(0.0, 0.0))
    assert [(r.cut, r.lon) for r in d.orderBy("seq").collect()] == [(0, 0.0), (1, 160.0), (1, 180.0), (1, -180.0), (1, -170.0), (2, -170.0), (2, -180.0), (2, 180.0), (2, 170.0)]


def test_only_a_missing_subpackage_is_passed_over(tmp_path):
    """Without the training-data subpackage the entry imports; without what it needs it does not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(plan.__file__).parents[2]
    shutil.copytree(root / "meshlake", tmp_path / "meshlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)

    def runs() -> bool:
        return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"], cwd=tmp_path, capture_output=True).returncode == 0

    assert runs()
    (tmp_path / "meshlake" / "llm").mkdir()
    (tmp_path / "meshlake" / "llm" / "__init__.py").touch()
    assert runs()
    (tmp_path / "meshlake" / "llm" / "queries.py").write_text("import what_is_not_there")
    assert not runs()


@pytest.mark.parametrize("kind", ["<i2", "<u1", "<f4", "<i4"])
def test_rasters_come_back(kind):
    from meshlake.sources import raster_files

    rng = np.random.default_rng(8)
    image = rng.integers(0, 200, (50, 37)).astype(kind)
    for order in "<>":
        for form in ({}, {"strip_rows": 50}, {"tile": (16, 32)}):
            for deflate in (False, True):
                for differences in (False, True)[: 1 if kind == "<f4" else 2]:
                    data = raster_files.encode_raster(image, deflate=deflate, differences=differences, order=order, **form)
                    assert (raster_files.parse_raster(data) == image).all()
    for bad in (b"", b"GIF89a", b"II\x2b\0" + bytes(8)):
        with pytest.raises(ValueError):
            raster_files.parse_raster(bad)


def test_elevation_from_files(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from meshlake.sources import raster_files

    rng = np.random.default_rng(9)
    tiles = {f"gt30{n}": rng.integers(-400, 4000, (100, 80)).astype("<i2") for n in ("e020n40", "w100s10")}
    for name, image in tiles.items():
        (tmp_path / f"{name}.tif").write_bytes(raster_files.encode_raster(image, deflate=name.endswith("10")))
    pixels = raster_files.read_elevation(spark, str(tmp_path), tuple(tiles))
    assert raster_files.read_rasters(spark, str(tmp_path)).count() == pixels.count()
    with pytest.raises(AnalysisException):
        raster_files.read_elevation(spark, str(tmp_path))
    assert pixels.count() == 2 * 100 * 80 and {tuple(r) for r in pixels.select("tile", "n_rows", "n_cols").distinct().collect()} == {(n, 100, 80) for n in tiles}
    got = {(r.i, r.j): r.z for r in divides.load_elevation(pixels, 181, 360, 1).collect()}
    want: dict = {}
    for name, image in tiles.items():
        north, west = (40.0, 20.0) if name.endswith("n40") else (-10.0, -100.0)
        for (i, j), z in np.ndenumerate(image):
            k = int(np.floor(north - (i + 0.5) / 2 + 90.5)), int(np.floor(west + (j + 0.5) / 2 + 180.5)) % 360
            want[k] = min(want.get(k, np.inf), max(0.0, float(z)))
    assert got == want


def test_skeletons_restore_planes(spark):
    """What is linear along rows and columns comes back from its key nodes; keys are themselves; the transpose fits."""
    from meshlake.plans import fit

    rows, columns = 19, 37
    grid = spark.range(rows * columns).select(F.lit(0).alias("h"), F.floor(F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("j"))
    hole = (F.col("i").between(8, 10) & F.col("j").between(5, 9)) | ((F.col("i") > 14) & (F.col("j") == 20))
    d = grid.where(~hole).toPandas().sort_values(["i", "j"], ignore_index=True)
    d["node_id"] = d.index
    ids = spark.createDataFrame(d).join(grid, ["h", "i", "j"], "right").select(*[F.col(c).cast("int").alias(c) for c in ("h", "i", "j", "node_id")])
    rng = np.random.default_rng(10)
    for factor in (1, 2, 3):
        got = fit.collect_skeleton(ids, factor, rows, columns)
        assert len(got.keys) < len(d) and np.allclose(got.weights.sum(axis=1), 1) and (got.weights >= 0).all()
        i, j = d["i"].to_numpy(float), d["j"].to_numpy(float)
        plane = np.stack([3 * i - 2 * j + 1, i + 5 * j], axis=1)
        assert np.allclose(got.restore(plane[got.keys]), plane)
        own, v = rng.normal(size=(len(got.keys), 2)), rng.normal(size=(len(d), 2))
        assert np.allclose(got.restore(own)[got.keys], own)
        assert np.isclose((got.restore(own) * v).sum(), (own * got.spread(v)).sum())


def line_of(spark, keys):
    """A line through the places of some keys."""
    d = spark.createDataFrame([(1, k) for k in keys], "f int, seq long")
    return d.select("f", "seq", fixtures.lat_of(F.col("seq")).alias("lat"), fixtures.lon_of(F.col("seq")).alias("lon"))


def test_pieces_of_lengths_at_the_resolution(spark):
    """A length just above 150 degrees by the root of a sum of squares."""
    (lat0, lon0), (lat1, lon1) = ((k * 7919 % 1799 / 10 - 89.953, k * 104729 % 3599 / 10 - 179.953) for k in (100665, 107579))
    n = math.ceil(math.sqrt((lat1 - lat0) ** 2 + (lon1 - lon0) ** 2) / 10)
    assert paths.resolve(line_of(spark, (100665, 107579)), ["f"], 10.0).where("seq = 107579").count() == n


def test_halvings_of_lengths_at_the_resolution(spark):
    """A length of 160 degrees, up to the last bit."""
    (lat0, lon0), (lat1, lon1) = ((k * 7919 % 1799 / 10 - 89.953, k * 104729 % 3599 / 10 - 179.953) for k in (40039342, 40074713))
    assert math.sqrt((lat1 - lat0) ** 2 + (lon1 - lon0) ** 2) == 160
    assert paths.refine(line_of(spark, (40039342, 40074713)), ["f"], 10.0).where("seq = 40074713").count() == 16


@pytest.mark.parametrize("name", ["w07_resolve_path", "w08_refine_path"])
def test_squares_are_those_of_the_sql(spark, tmp_path, name):
    """A length of 160 degrees by the library's power, and just above by products."""
    import duckdb

    from meshlake import catalog

    spark.createDataFrame([(1, 956), (1, 1476630)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"select feature_id, seq, part, lat, lon from ({catalog.oracle_sql()[name]})").fetchall()
    got = catalog.queries()[name](spark, str(tmp_path)).select("feature_id", "seq", "part", "lat", "lon").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_decimation_on_ties():
    """Distances that are equal but for the last bit are parted as by the SQL, a product at a time."""
    keys = [1679433, 1680887, 1680898, 1724143, 1745127, 1745248, 1752204, 1759039, 1762553, 1763820, 1765723, 1774790, 1787281]
    path = np.array([(k * 7919 % 1799 / 10 - 89.953, k * 104729 % 3599 / 10 - 179.953) for k in keys])
    assert keys.index(1745248) in paths.decimated(path, 20.0, wrap=True)


def many_rings(spark, rng, n=60):
    """Small rings of three to six vertices in either direction, some not convex, and one that is large."""
    rows = []
    for h in range(n):
        c, m = rng.uniform(-60, 60, 2), int(rng.integers(3, 7))
        turns = np.sort(rng.uniform(0, 2 * np.pi, m))[:: 1 if h % 3 else -1]
        ring = np.round(c + (rng.uniform(1, 7, (m, 1)) if h else 50.0) * np.stack([np.sin(turns), np.cos(turns)], 1), int(h % 2))
        rows += [(h, k, *map(float, ring[k % m])) for k in range(m + 1)]
    return spark.createDataFrame(rows, "h int, seq int, lat double, lon double").coalesce(1)


def test_small_sections_go_to_cells(spark, monkeypatch):
    """The same from cells and from bands alone, on points at random and at vertices."""
    rng = np.random.default_rng(5)
    d = many_rings(spark, rng).cache()
    at = [(float(a), float(b)) for a, b in rng.uniform(-70, 70, (150, 2))] + [(r.lat, r.lon) for r in d.limit(60).collect()]
    p = spark.createDataFrame([(k, *v) for k, v in enumerate(at)], "id int, lat double, lon double").coalesce(1)

    def all_of():
        whole = [polygon.inside_region(p, d, ["id"]), polygon.contains(p, d, ["id"])]
        some = [polygon.containing(p, d, ["id"]), polygon.containing(p, d, ["id"], planar=True), polygon.first_section(p, d, ["id"]).select("id", "section")]
        return [sorted(map(tuple, x.collect()), key=repr) for x in whole + some]

    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    cells_ = all_of()
    monkeypatch.setattr(polygon, "CELL_EXTENT", -1.0)
    assert cells_ == all_of()


def test_points_meet_only_near_sections(spark):
    """Squares all over the globe: a point meets those around it, not all of its longitude or latitude."""
    d = spark.range(400).selectExpr("int(id) h", "explode(sequence(0, 4)) seq", "id % 20 * 8 - 80 y", "id div 20 * 17 - 165 x")
    d = d.selectExpr("h", "seq", "double(y + array(0, 0, 5, 5, 0)[seq]) lat", "double(x + array(0, 5, 5, 0, 0)[seq]) lon")
    p = spark.range(400).selectExpr("id", "id % 20 * 8 - 79d lat", "id div 20 * 17 - 163d lon")
    for hits in (polygon._region_hits, polygon._planar_hits):
        found = hits(p, d, ["id"])[0].collect()
        assert sorted((r.id, r.h) for r in found) == [(k, k) for k in range(400)] and all(r.inside for r in found)


def test_all_pairs_of_points_and_sections(spark, monkeypatch):
    """The same rows as from literals, where sections come in chunks; a point's hits are joined without a broadcast, and pairs are
    dealt to tasks by their number, at the session's own threshold and few partitions."""
    d = spark.range(20).selectExpr("int(id) h", "explode(sequence(0, 4)) seq", "id % 5 * 8 - 20 y", "id div 5 * 17 - 30 x")
    d = d.selectExpr("h", "if(h % 3 = 0, 4 - seq, seq) seq", "double(y + array(0, 0, 9, 9, 0)[seq]) lat", "double(x + array(0, 19, 19, 0, 0)[seq]) lon")
    p = spark.range(400).selectExpr("id", "if(id = 7, null, id % 20 * 3 - 29.5d) lat", "id div 20 * 5 - 41.5d lon")
    few = {f: sorted(map(tuple, f(p, d, ["id"]).collect())) for f in (polygon.contains, polygon.inside_region)}
    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    for f, want in few.items():
        plan = f(p, d, ["id"])._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftOuter" in line]
    monkeypatch.setattr(polygon, "CHUNK", 7)
    monkeypatch.setattr(polygon, "PAIRS", 1_000)
    for f, want in few.items():
        got = f(p, d, ["id"]).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.id, r.h, r.inside) for r in got if r.id != 7) == [r for r in want if r[0] != 7]
        assert [r.h for r in sorted(got) if r.id == 7] == list(range(20)) and len({r.task for r in got}) > 4


def test_first_of_near_sections(spark, monkeypatch):
    """Sections that contain no far point are not looked up for it: no array of all sections."""
    d = spark.createDataFrame([(h, k, 10.0 * h + a, b) for h in (1, 2) for k, (a, b) in enumerate(((0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (5.0, 0.0), (0.0, 0.0)))], "h int, seq int, lat double, lon double")
    p = spark.createDataFrame([(1, 11.0, 1.0), (2, 22.0, 2.0), (3, 1.0, 1.0), (4, None, 1.0)], "id int, lat double, lon double")
    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    monkeypatch.setattr(polygon, "_sections", None)
    assert {r.id: r.section for r in polygon.first_section(p, d, ["id"]).collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_inner_cells_meet_no_edge_in_the_plane(spark, monkeypatch):
    """Points in cells that no edge is near are answered by the cell: the test by edges, here an error, isn't asked."""
    near = polygon._near
    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    monkeypatch.setattr(polygon, "_near", lambda p, rings, keys, constant, test: near(p, rings, keys, constant, F.raise_error(F.concat(F.col("_lat").cast("string"), F.size("es").cast("string"))).cast("boolean")))
    d = spark.createDataFrame([(h, k, *(v if h == 1 else v[::-1])) for h in (1, 2) for k, v in enumerate(((0.5, 0.5), (0.5, 9.5), (9.5, 9.5), (9.5, 0.5), (0.5, 0.5)))], "h int, seq int, lat double, lon double")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 8.9), (3, 11.5, 5.0), (4, float("nan"), float("nan")), (5, None, 5.0)], "id int, lat double, lon double")
    got = {(r.id, r.h): r.inside for r in polygon.contains(p, d, ["id"]).collect()}
    assert got == {(k, h): (k < 3) == (h == 1) for k in range(1, 6) for h in (1, 2)}


def test_sections_of_several_edges_by_cells(spark, monkeypatch):
    """The same from cells, dealt or broadcast, and from bands alone, for rings written out and for longer ones of either
    direction, with points in them."""
    rng = np.random.default_rng(8)
    rows, at = [], []
    for h in range(24):
        c, m = rng.uniform(-50, 50, 2), int(rng.integers(4, 13))
        turns = np.linspace(0, 2 * np.pi, m, endpoint=False)[:: 1 if h % 3 else -1]
        ring = c + (rng.uniform(3, 7, (m, 1)) if h % 2 else 6.0) * np.stack([np.sin(turns), np.cos(turns)], 1)
        rows += [(h, k, *map(float, ring[k % m])) for k in range(m + 1)]
        at += [tuple(map(float, v)) for v in c + rng.uniform(-7, 7, (20, 2))]
    d = spark.createDataFrame(rows, "h int, seq int, lat double, lon double").coalesce(1).cache()
    p = spark.createDataFrame([(k, *v) for k, v in enumerate(at)], "id int, lat double, lon double").coalesce(1)

    def all_of():
        each = [polygon.containing(p, d, ["id"]), polygon.contains(p, d, ["id"]), polygon.first_section(p, d, ["id"]).select("id", "section")]
        return [sorted(map(tuple, x.collect()), key=repr) for x in each]

    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    got = all_of()
    for name in ("CELL_LIMIT", "CELL_EXTENT"):
        monkeypatch.setattr(polygon, name, -1)
        assert got == all_of()


def test_first_section_in_inner_cells(spark, monkeypatch):
    """On the globe a cell that no edge is near has one answer too, and overlapping sections give the first."""
    near = polygon._near
    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    monkeypatch.setattr(polygon, "_near", lambda p, rings, keys, constant, test: near(p, rings, keys, constant, F.raise_error(F.concat(F.col("_lat").cast("string"), F.size("es").cast("string"))).cast("boolean")))
    ring = ((0.5, 0.5), (0.5, 9.5), (9.5, 9.5), (9.5, 0.5), (0.5, 0.5))
    d = spark.createDataFrame([(h, k, a + 4 * h, b) for h in (1, 2) for k, (a, b) in enumerate(ring)], "h int, seq int, lat double, lon double")
    p = spark.createDataFrame([(1, 5.7, 5.0), (2, 10.0, 1.0), (3, 15.5, 5.0), (4, 40.0, 5.0), (5, 5.7, None)], "id int, lat double, lon double")
    assert {r.id: r.section for r in polygon.first_section(p, d, ["id"]).collect()} == {1: 1, 2: 1, 3: 2, 4: None, 5: None}


def test_first_section_asks_none_behind_a_sure_one(spark):
    """Where a whole cell is in a section, later ones, which have edges in the cell, are not met; earlier ones are."""
    ring = ((0.5, 0.5), (0.5, 9.5), (9.5, 9.5), (9.5, 0.5), (0.5, 0.5))
    tops = {1: (20.0, 20.0), 2: (0.0, 0.0), 3: (4.0, 0.0), 4: (0.0, 4.0)}
    d = spark.createDataFrame([(h, k, a + tops[h][0], b + tops[h][1]) for h in tops for k, (a, b) in enumerate(ring)], "h int, seq int, lat double, lon double")
    p = spark.createDataFrame([(1, 4.7, 4.7), (2, 0.7, 5.0), (3, 10.0, 5.0), (4, 25.0, 25.0), (5, -5.0, 5.0)], "id int, lat double, lon double")
    found, default = polygon._region_hits(p, d, ["id"], first=True)
    assert sorted((r.id, r.h) for r in found.where("inside").collect()) == [(1, 2), (2, 2), (2, 4), (3, 3), (4, 1)] and default is None
    assert found.where("id = 1").count() == 1


def test_first_section_of_general_rings(spark, monkeypatch):
    """Rings that overlap, of up to six edges and of more: the first section from cells is that from bands alone."""
    rng = np.random.default_rng(21)
    at = rng.uniform(-25, 25, (400, 2)).tolist()
    p = spark.createDataFrame([(k, *v) for k, v in enumerate(at)], "id int, lat double, lon double").coalesce(1)
    monkeypatch.setattr(polygon, "section_literals", lambda *_: None)
    for most in (4, 9):
        rows = []
        for h in range(40):
            c, m = rng.uniform(-20, 20, 2), int(rng.integers(3, most + 1))
            turns = np.linspace(0, 2 * np.pi, m, endpoint=False) + (np.pi / 4 if h % 2 else 0.3)
            ring = c + 7 * np.stack([np.sin(turns), np.cos(turns)], 1) * (1 if h % 5 else -1)
            ring = ring if h % 7 else np.array([c, c + (0, 6), c + (6, 6), c + (6, 0)])
            rows += [(h, k, *map(float, ring[k % len(ring)])) for k in range(len(ring) + 1)]
        d = spark.createDataFrame(rows, "h int, seq int, lat double, lon double").coalesce(1)
        got = {r.id: r.section for r in polygon.first_section(p, d, ["id"]).collect()}
        with monkeypatch.context() as only_bands:
            only_bands.setattr(polygon, "CELL_EXTENT", -1.0)
            assert got == {r.id: r.section for r in polygon.first_section(p, d, ["id"]).collect()}
