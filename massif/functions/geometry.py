"""Columns on points, triangles and convex polygons. A point is a struct of x, y and z; a polygon is an array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massif.functions.octree import let


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def sub(p: Column, q: Column) -> Column:
    return point(*[p[c] - q[c] for c in "xyz"])


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def along(p: Column, q: Column, t: Column) -> Column:
    """The point a share t of the way from p to q."""
    return point(*[p[c] + t * (q[c] - p[c]) for c in "xyz"])


def box_planes(lo: tuple[float, float, float], hi: tuple[float, float, float]) -> list[tuple[float, float, float, float]]:
    """The six half-spaces n . p >= d of a box."""
    unit = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    return [(*n, a) for n, a in zip(unit, lo, strict=True)] + [(*[-c for c in n], -b) for n, b in zip(unit, hi, strict=True)]


_PLANES = "array<struct<nx:double,ny:double,nz:double,d:double>>"


def _cut(poly: Column, plane: Column) -> Column:
    """What one half-space leaves of a convex polygon."""
    def side(p: Column) -> Column:
        return p["x"] * plane["nx"] + p["y"] * plane["ny"] + p["z"] * plane["nz"] - plane["d"]

    def step(p: Column, q: Column) -> Column:
        d, e = side(p), side(q)
        cross = F.when((d >= 0) != (e >= 0), F.array(along(p, q, d / (d - e))))
        return F.concat(F.coalesce(cross, F.slice(F.array(p), 1, 0)), F.when(e >= 0, F.array(q)).otherwise(F.slice(F.array(q), 1, 0)))

    following = F.concat(F.slice(poly, 2, F.greatest(F.size(poly), F.lit(1))), F.slice(poly, 1, 1))
    return F.flatten(F.zip_with(poly, following, step))


def clip(polygon: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """A convex polygon cut by half-spaces n . p >= d, one after another; empty if nothing is left. Points on a plane are
    inside. A plane with no z part clips in two dimensions."""
    cuts = F.array(*[F.struct(*[F.lit(float(v)) for v in p]) for p in planes]).cast(_PLANES)
    return F.aggregate(cuts, polygon.cast("array<struct<x:double,y:double,z:double>>"), _cut)


def fan(polygon: Column) -> Column:
    """The triangles (arrays of three points) of a convex polygon."""
    some = F.when(F.size(polygon) >= 3, F.sequence(F.lit(1), F.size(polygon) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(some, lambda i: F.array(polygon[0], polygon[i], polygon[i + 1]))


def pad(lo: Column, hi: Column, *, absolute: float = 0.0, relative: float = 0.0) -> tuple[Column, Column]:
    """An interval widened on both sides by a length and by a share of its size."""
    by = F.lit(absolute) + (hi - lo) * relative
    return lo - by, hi + by


def orient_2d(a: Column, b: Column, p: Column) -> Column:
    """Twice the signed area of a, b, p in the plane: positive if they turn counter-clockwise."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def winding(a: Column, b: Column, c: Column) -> Column:
    """1 counter-clockwise, -1 clockwise, 0 neither."""
    return F.signum(orient_2d(a, b, c)).cast("int")


def barycentric_2d(a: Column, b: Column, c: Column, p: Column) -> Column:
    """Weights (u, v, w) of p in a triangle of the plane; null for a triangle without area."""
    whole = orient_2d(a, b, c)
    u, v = orient_2d(b, c, p) / whole, orient_2d(c, a, p) / whole
    return F.when(whole != 0, F.struct(u.alias("u"), v.alias("v"), (1 - u - v).alias("w")))


def interpolate(weights: Column, a: Column, b: Column, c: Column) -> Column:
    return weights["u"] * a + weights["v"] * b + weights["w"] * c


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point to a segment; a segment of no length is its end."""
    size = dot(sub(b, a), sub(b, a))
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, a), sub(b, a)) / size))).otherwise(F.lit(0.0))
    return let(sub(p, along(a, b, t)), lambda d: F.sqrt(dot(d, d)))


def cross(p: Column, q: Column) -> Column:
    return point(p["y"] * q["z"] - p["z"] * q["y"], p["z"] * q["x"] - p["x"] * q["z"], p["x"] * q["y"] - p["y"] * q["x"])


def unit(p: Column) -> Column:
    return let(F.sqrt(dot(p, p)), lambda n: point(*[p[c] / n for c in "xyz"]))


def triangle_distance(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Distance of a point to a triangle: to its plane if the foot is inside, else to the nearest edge."""
    n = cross(sub(b, a), sub(c, a))
    size = dot(n, n)
    edge = F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, c, a))
    inside = F.lit(True)
    for u, v in ((a, b), (b, c), (c, a)):
        inside = inside & (dot(cross(sub(v, u), sub(p, u)), n) >= 0)
    return F.when((size > 0) & inside, F.abs(dot(sub(p, a), n)) / F.sqrt(size)).otherwise(edge)


def separates(a: Column, b: Column, others: list[Column], third: Column) -> Column:
    """Whether the line through an edge a, b of a triangle in the plane has its third corner on one side and all other
    points on the other, or on the line."""
    side = F.signum(orient_2d(a, b, third))
    out = F.lit(True)
    for o in others:
        out = out & (orient_2d(a, b, o) * side <= 0)
    return out


def triangles_overlap(t: list[Column], s: list[Column]) -> Column:
    """Whether two triangles of the plane share area: no edge of either separates them."""
    apart = F.lit(False)
    for own, other in ((t, s), (s, t)):
        for i in range(3):
            apart = apart | separates(own[i], own[(i + 1) % 3], other, own[(i + 2) % 3])
    return ~apart


def normalised(p: Column, lo: Column, hi: Column) -> Column:
    """A point relative to the centre of bounds, over half their largest side."""
    half = F.greatest(*[hi[c] - lo[c] for c in "xyz"]) / 2
    return point(*[((p[c] - (lo[c] + hi[c]) / 2) / half).cast("float") for c in "xyz"])


def plane_frame(a: Column, b: Column, c: Column) -> Column:
    """Frame (origin, u, v, n) of a triangle: u along its first edge, n its normal."""
    n = unit(cross(sub(b, a), sub(c, a)))
    u = unit(sub(b, a))
    return let(n, lambda n: let(u, lambda u: F.struct(a.alias("origin"), u.alias("u"), cross(n, u).alias("v"), n.alias("n"))))


def project(frame: Column, p: Column) -> Column:
    """Coordinates (x, y, z) of a point in a frame: z is its distance to the plane."""
    d = sub(p, frame["origin"])
    return point(dot(d, frame["u"]), dot(d, frame["v"]), dot(d, frame["n"]))


def unproject(frame: Column, q: Column) -> Column:
    """The point of coordinates in a frame."""
    return point(*[frame["origin"][c] + q["x"] * frame["u"][c] + q["y"] * frame["v"][c] + q["z"] * frame["n"][c] for c in "xyz"])


# Fixed point: coordinates in steps of 2**-16 as longs, products as 38-digit decimals, so signs are exact.

FIXED_BITS = 16


def to_fixed(x: Column) -> Column:
    return F.round(x * float(1 << FIXED_BITS)).cast("long")


def from_fixed(q: Column) -> Column:
    return q / float(1 << FIXED_BITS)


def fixed_orient(a: Column, b: Column, p: Column) -> Column:
    """1, 0 or -1 by the side of p of the line a, b, exactly (structs of x and y in fixed point, below 2**40 each)."""
    def wide(v: Column) -> Column:
        return v.cast("decimal(19,0)")

    det = wide(b["x"] - a["x"]) * wide(p["y"] - a["y"]) - wide(b["y"] - a["y"]) * wide(p["x"] - a["x"])
    return F.signum(det).cast("int")


def fixed_on_segment(a: Column, b: Column, p: Column) -> Column:
    box = p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return (fixed_orient(a, b, p) == 0) & box


def fixed_segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments share a point, ends included."""
    crossing = (fixed_orient(a, b, c) * fixed_orient(a, b, d) < 0) & (fixed_orient(c, d, a) * fixed_orient(c, d, b) < 0)
    return crossing | fixed_on_segment(a, b, c) | fixed_on_segment(a, b, d) | fixed_on_segment(c, d, a) | fixed_on_segment(c, d, b)


def fixed_lerp(a: Column, b: Column, t: Column) -> Column:
    """The fixed value a share t (in fixed point) of the way from a to b."""
    return a + F.shiftright((b - a) * t, FIXED_BITS)


def edge_planes(corners: list[Column], *, outside: int | None = None) -> Column:
    """The half-planes of a counter-clockwise convex polygon of the plane, as an array for clip_by(). With `outside` = k: the
    outside of edge k and the inside of the edges before it, so that these parts, over all k, are what the polygon leaves
    of the plane, each point once."""
    def plane(a: Column, b: Column, sign: float) -> Column:
        nx, ny = -(b["y"] - a["y"]) * sign, (b["x"] - a["x"]) * sign
        return F.struct(nx.alias("nx"), ny.alias("ny"), F.lit(0.0).alias("nz"), (nx * a["x"] + ny * a["y"]).alias("d"))

    n = len(corners)
    edges = [(corners[i], corners[(i + 1) % n]) for i in range(n)]
    if outside is None:
        return F.array(*[plane(a, b, 1.0) for a, b in edges])
    return F.array(*[plane(a, b, 1.0) for a, b in edges[:outside]], plane(*edges[outside], -1.0))


def clip_by(polygon: Column, planes: Column) -> Column:
    """clip() by half-spaces in an array column."""
    return F.aggregate(planes.cast(_PLANES), polygon.cast("array<struct<x:double,y:double,z:double>>"), _cut)


def polygon_area_2d(polygon: Column) -> Column:
    """Signed area of a polygon of the plane."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon), F.lit(1))), F.slice(polygon, 1, 1))
    return F.aggregate(F.zip_with(polygon, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x) / 2


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column, lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column) -> Column:
    """Whether a segment of the plane meets a box, borders included: the shares of it within each pair of lines overlap."""
    first, last, out = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, lo, hi in ((x1, x2, lo_x, hi_x), (y1, y2, lo_y, hi_y)):
        d = b - a
        t, u = (lo - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
        first, last = F.greatest(first, F.least(t, u)), F.least(last, F.greatest(t, u))
        out = out & ((d != 0) | a.between(lo, hi))
    return out & (first <= last)
