"""Scalar geometry and geodesy. Angles are degrees unless a name says radians; null in, null out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float


def col(x: Num | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


@dataclass(frozen=True)
class Ellipsoid:
    """A spheroid by its larger half axis (km) and flattening."""

    a: float
    f: float

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2


#: The WGS 84 figure of the earth.
EARTH = Ellipsoid(6378.137, 1 / 298.257223563)


def wrap_angle(x, period: float = 360.0) -> Column:
    """Into [-period/2, period/2)."""
    x = col(x)
    return x - F.floor((x + period / 2) / period) * period


def to_cartesian(lat, lon) -> Column:
    p, q = F.radians(col(lat)), F.radians(col(lon))
    return F.struct((F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z"))


def rotated_coordinates(lat_ref, lon_ref, lat, lon) -> Column:
    """Distance from and bearing about an oblique pole; all in radians."""
    r, s, p, q = map(col, (lat_ref, lon_ref, lat, lon))
    x = F.sin(r) * F.cos(p) * F.cos(q - s) - F.cos(r) * F.sin(p)
    y = F.cos(p) * F.sin(q - s)
    z = F.cos(r) * F.cos(p) * F.cos(q - s) + F.sin(r) * F.sin(p)
    return F.struct((F.pi() / 2 - F.atan2(z, F.hypot(x, y))).alias("distance"), F.atan2(y, x).alias("bearing"))


def oblique_stereographic(lat, lon, center: tuple, glue: tuple) -> Column:
    """Conformal image with the glue point at the origin, north up there. ``center`` in radians, ``glue``
    in degrees: columns or numbers. The scale factor is 3."""
    clat, clon = map(col, center)
    glat, glon = (F.radians(col(v)) for v in glue)
    at, own = rotated_coordinates(clat, clon, F.radians(col(lat)), F.radians(col(lon))), rotated_coordinates(clat, clon, glat, glon)
    r, r0 = F.tan(at["distance"] / 2), F.tan(own["distance"] / 2)
    x = r * F.sin(at["bearing"]) - r0 * F.sin(own["bearing"])
    y = r0 * F.cos(own["bearing"]) - r * F.cos(at["bearing"])
    scale = 3 * EARTH.a * F.pow(F.cos(own["distance"] / 2), F.lit(2.0))
    turn = rotated_coordinates(glat, glon, clat, clon)["bearing"] - own["bearing"] - F.pi()
    return F.struct((scale * (x * F.cos(turn) - y * F.sin(turn))).alias("x"), (scale * (x * F.sin(turn) + y * F.cos(turn))).alias("y"))


def interp(x, x0, x1, y0, y1) -> Column:
    """Straight-line interpolation in either direction; null where x0 = x1."""
    x, x0, x1, y0, y1 = map(col, (x, x0, x1, y0, y1))
    return F.try_divide(x - x0, x1 - x0) * (y1 - y0) + y0


def normalize(*v) -> Column:
    """Over the largest absolute component; a zero vector stays."""
    v = [col(c) for c in v]
    most = F.greatest(*[F.abs(c) for c in v]) if len(v) > 1 else F.abs(v[0])
    return F.array(*[F.when(most == 0, c).otherwise(F.try_divide(c, most)) for c in v])


def vector_normalize(x, y) -> Column:
    """Over the length; a zero vector stays."""
    x, y = col(x), col(y)
    n = F.hypot(x, y)
    return F.struct(F.when(n == 0, x).otherwise(F.try_divide(x, n)).alias("x"), F.when(n == 0, y).otherwise(F.try_divide(y, n)).alias("y"))


def rotate_and_shift(x, y, angle, dx=0.0, dy=0.0) -> Column:
    x, y, a, dx, dy = map(col, (x, y, angle, dx, dy))
    return F.struct((x * F.cos(a) - y * F.sin(a) + dx).alias("x"), (x * F.sin(a) + y * F.cos(a) + dy).alias("y"))


def polygon_area(points: list[tuple]) -> Column:
    """Signed area as a fan of triangles; counterclockwise is positive."""
    p = [(col(x), col(y)) for x, y in points]
    (x0, y0), rest = p[0], p[1:]
    parts = [((bx - x0) * (cy - y0) - (by - y0) * (cx - x0)) / 2 for (bx, by), (cx, cy) in zip(rest, rest[1:])]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def offset_from_angle(a: tuple, b: tuple, c: tuple, offset) -> Column:
    """The point beside bend b, on its outer side; beside a straight line, to the right of travel."""
    (ax, ay), (bx, by), (cx, cy) = [tuple(map(col, p)) for p in (a, b, c)]
    onward, before = vector_normalize(cx - bx, cy - by), vector_normalize(bx - ax, by - ay)
    dx, dy = onward["x"] - before["x"], onward["y"] - before["y"]
    bent = F.hypot(dx, dy) > 1e-4
    unit = vector_normalize(dx, dy)
    ux, uy = F.when(bent, unit["x"]).otherwise(-onward["y"]), F.when(bent, unit["y"]).otherwise(onward["x"])
    return F.struct((bx - col(offset) * ux).alias("x"), (by - col(offset) * uy).alias("y"))


def ellipsoid_row_height(lat, step_degrees, meridian_exponent: float = 1.5, earth: Ellipsoid = EARTH) -> Column:
    """Length of a step in latitude (km). The geodetic meridian radius has exponent -1.5; parity needs 1.5."""
    s = F.sin(F.radians(col(lat)))
    return F.lit(earth.a) * F.radians(col(step_degrees)) * (1 - earth.e2) * F.pow(1 - earth.e2 * s * s, F.lit(meridian_exponent))


def ellipsoid_column_width(lat, step_degrees, earth: Ellipsoid = EARTH) -> Column:
    """Length of a step in longitude (km)."""
    t = F.tan(F.radians(col(lat)))
    return F.lit(earth.a) * F.radians(col(step_degrees)) * F.pow(1 + (1 - earth.e2) * t * t, F.lit(-0.5))


def spherical_cell_area(lat0, lat1, step_degrees, radius: float = EARTH.a) -> Column:
    return F.lit(radius * radius) * (F.sin(F.radians(col(lat1))) - F.sin(F.radians(col(lat0)))) * F.radians(col(step_degrees))


def angular_distance(lat0, lon0, lat1, lon1) -> Column:
    """Degrees between two points; the dot product is clamped."""
    a, b = to_cartesian(lat0, lon0), to_cartesian(lat1, lon1)
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


#: Fixed value: degrees over which importance falls off from the coast.
COAST_WIDTH = 6.0


def importance(inside, distance) -> Column:
    """1 inside, else the squared linear fall-off; 0 where the distance is null."""
    fall = F.pow(F.greatest(F.lit(0.0), 1 - col(distance) / COAST_WIDTH), F.lit(2.0))
    return F.when(col(inside), 1.0).otherwise(F.coalesce(fall, F.lit(0.0)))


def principal_strains(xe, ye, xn, yn) -> Column:
    """Half axes of the strain ellipse from the derivatives eastward (xe, ye) and northward (xn, yn)."""
    xe, ye, xn, yn = map(col, (xe, ye, xn, yn))
    t = F.sqrt((xe + yn) * (xe + yn) + (xn - ye) * (xn - ye)) / 2
    s = F.sqrt((xe - yn) * (xe - yn) + (xn + ye) * (xn + ye)) / 2
    return F.struct((t + s).alias("a"), (t - s).alias("b"))


def intersects(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether closed segments a-b and c-d meet; parallel ones don't."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = [tuple(map(col, p)) for p in (a, b, c, d)]
    bottom = (ax - bx) * (cy - dy) - (ay - by) * (cx - dx)
    ab, cd = ax * by - ay * bx, cx * dy - cy * dx
    out = bottom != 0
    for p, q, r, s in ((ax, bx, cx, dx), (ay, by, cy, dy)):
        at = F.when(p == q, p).when(r == s, r).otherwise(F.try_divide(ab * (r - s) - (p - q) * cd, bottom))
        out = out & at.between(F.least(p, q), F.greatest(p, q)) & at.between(F.least(r, s), F.greatest(r, s))
    return F.coalesce(out, F.lit(False))


def inside_convex(x, y, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is in or on a convex counterclockwise polygon."""
    x, y = col(x), col(y)
    sides = [(x - x0) * (y - y1) - (x - x1) * (y - y0) >= 0 for (x0, y0), (x1, y1) in zip([polygon[-1], *polygon], polygon)]
    return reduce(lambda p, q: p & q, sides)


def bilinear(u, v, sw, se, nw, ne) -> Column:
    """Over the fractions u northward and v eastward; null if a corner is null."""
    u, v, sw, se, nw, ne = map(col, (u, v, sw, se, nw, ne))
    return (1 - u) * (1 - v) * sw + (1 - u) * v * se + u * (1 - v) * nw + u * v * ne


def hermite(t, y0, y1, d0, d1) -> Column:
    """Cubic over [0, 1] with end slopes d0, d1."""
    t, y0, y1, d0, d1 = map(col, (t, y0, y1, d0, d1))
    return y0 * (2 * t * t * t - 3 * t * t + 1) + y1 * (3 * t * t - 2 * t * t * t) + d0 * (t * t * t - 2 * t * t + t) + d1 * (t * t * t - t * t)


def rounded(c: Column, digits: int = 6) -> Column:
    """For comparisons: rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
