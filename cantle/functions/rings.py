"""Planar geometry over rings, arrays of (x, y) without the closing point, as JVM-side columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantle.constants import DIRECTIONS, STEP_M

BIN = 2 * math.pi / DIRECTIONS


def rotated(ring: Column, k: Column | int = 1) -> Column:
    """The ring from its k-th vertex (from 0) on."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.concat(F.slice(ring, k + 1, F.size(ring)), F.slice(ring, F.lit(1), k))


def edges(ring: Column) -> Column:
    """Structs (dx, dy, len) of each vertex to the next."""
    return F.zip_with(ring, rotated(ring), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")))


def signed_area(ring: Column) -> Column:
    cross = F.zip_with(ring, rotated(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["len"])


def oriented(ring: Column) -> Column:
    """Counter-clockwise."""
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def vertex_count(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, lambda r: F.size(r)), F.lit(0), lambda s, x: s + x)


def vertex_bucket(n: Column) -> Column:
    return F.when(n <= 4, "4").when(n <= 8, "5-8").when(n <= 16, "9-16").otherwise("17+")


def quantize_direction(dx: Column, dy: Column) -> Column:
    return F.pmod(F.round(F.atan2(dy, dx) / BIN).cast("int"), F.lit(DIRECTIONS))


def quantize_length(length: Column) -> Column:
    return F.greatest(F.lit(1), F.round(length / STEP_M).cast("int"))


def direction_radians(token: Column) -> Column:
    return token * F.lit(BIN)


def longest_edge(ring: Column) -> Column:
    """Struct (len, idx, angle_deg): the first longest edge, in whole nanometres for stable ties."""
    e = F.transform(edges(ring), lambda e, i: F.struct(F.round(e["len"], 9).alias("len"), (-i).alias("back"), F.degrees(F.atan2(e["dy"], e["dx"])).alias("angle")))
    top = F.array_max(F.filter(e, lambda x: x["len"] > 1e-12))
    return F.struct(top["len"].alias("len"), (-top["back"]).alias("idx"), top["angle"].alias("angle_deg"))


def closest_vertex(ring: Column, x: Column, y: Column) -> Column:
    """Index of the first nearest vertex."""
    return F.array_min(F.transform(ring, lambda p, i: F.struct(F.round(F.hypot(p["x"] - x, p["y"] - y), 9).alias("d"), i.alias("i"))))["i"]


def unary_tokens(ring: Column, start: Column | int = 0) -> Column:
    """Each edge as its direction, repeated per step of length; zero edges are skipped."""
    walk = F.filter(edges(rotated(ring, start)), lambda e: e["len"] > 1e-12)
    return F.flatten(F.transform(walk, lambda e: F.array_repeat(quantize_direction(e["dx"], e["dy"]), quantize_length(e["len"]))))


def merge_edges(runs: Column) -> Column:
    """Neighbouring runs (d, n) of one direction become one."""
    kind = "array<struct<d:int,n:int>>"

    def step(out: Column, e: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(e["d"].alias("d"), (last["n"] + e["n"]).alias("n"))))
        return F.when(last["d"] == e["d"], joined).otherwise(F.concat(out, F.array(e)))

    return F.aggregate(runs.cast(kind), F.array().cast(kind), step)


def walk(runs: Column, x0: Column, y0: Column) -> Column:
    """Points of a path of runs (d, n), start included; the end snaps to the start within half a step."""
    kind = "array<struct<x:double,y:double>>"
    start = F.struct(x0.cast("double").alias("x"), y0.cast("double").alias("y"))

    def step(out: Column, e: Column) -> Column:
        p, r, m = F.element_at(out, -1), direction_radians(e["d"]), e["n"] * F.lit(STEP_M)
        return F.concat(out, F.array(F.struct((p["x"] + F.cos(r) * m).alias("x"), (p["y"] + F.sin(r) * m).alias("y"))))

    path = F.aggregate(runs, F.array(start).cast(kind), step)
    end = F.element_at(path, -1)
    close = F.hypot(end["x"] - x0, end["y"] - y0) <= STEP_M * 0.5
    return F.when(close, F.concat(F.slice(path, F.lit(1), F.size(path) - 1), F.array(start))).otherwise(F.concat(path, F.array(start)))


def rotate_about(ring: Column, degrees: Column, x0: Column, y0: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(ring, lambda p: F.struct((x0 + (p["x"] - x0) * c - (p["y"] - y0) * s).alias("x"), (y0 + (p["x"] - x0) * s + (p["y"] - y0) * c).alias("y")))


def angle_degrees(a: Column, b: Column, c: Column) -> Column:
    """Angle at b; 0 where an arm has no length."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    arms = F.hypot(ux, uy) * F.hypot(vx, vy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / F.when(arms > 1e-12, arms)))
    return F.coalesce(F.degrees(F.acos(cosine)), F.lit(0.0))


def angle_error(a: Column, b: Column) -> Column:
    """Difference of two undirected angles in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def parallel_error(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    one, two = F.pmod(F.degrees(F.atan2(dy1, dx1)), F.lit(180.0)), F.pmod(F.degrees(F.atan2(dy2, dx2)), F.lit(180.0))
    return F.least(F.abs(one - two), F.lit(180.0) - F.abs(one - two))


def simple_rectangle(ring: Column, angle_tolerance: float = 5.0, parallel_tolerance: float = 5.0, fill: float = 0.98) -> Column:
    """Four right corners, parallel sides, and nearly all of the least box; for rings without holes."""
    p = [F.try_element_at(ring, F.lit(i + 1)) for i in range(4)]
    side = [(p[(i + 1) % 4]["x"] - p[i]["x"], p[(i + 1) % 4]["y"] - p[i]["y"]) for i in range(4)]
    right = [F.abs(angle_degrees(p[i - 1], p[i], p[(i + 1) % 4]) - 90.0) <= angle_tolerance for i in range(4)]
    boxes = []
    for dx, dy in side:  # the least enclosing rectangle has a side on an edge
        m = F.hypot(dx, dy)
        along, across = [(q["x"] * dx + q["y"] * dy) / m for q in p], [(q["y"] * dx - q["x"] * dy) / m for q in p]
        boxes.append(F.when(m > 1e-12, (F.greatest(*along) - F.least(*along)) * (F.greatest(*across) - F.least(*across))))
    box = F.least(*boxes)
    whole = right[0] & right[1] & right[2] & right[3]
    sides = (parallel_error(*side[0], *side[2]) <= parallel_tolerance) & (parallel_error(*side[1], *side[3]) <= parallel_tolerance)
    return F.coalesce((F.size(ring) == 4) & whole & sides & (box > 1e-12) & (area(ring) >= box * fill), F.lit(False))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """WGS84 degrees to northern UTM metres, by Krueger's series to the third order."""
    a, f = 6378137.0, 1 / 298.257223563  # fixed values: the WGS84 ellipsoid
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    ecc = 2 * math.sqrt(n) / (1 + n)
    half_ln = lambda z: F.lit(0.5) * F.ln((F.lit(1.0) + z) / (F.lit(1.0) - z))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(half_ln(s) - F.lit(ecc) * half_ln(F.lit(ecc) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = half_ln(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, v in enumerate(alpha, 1):
        east = east + F.lit(v) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(v) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(0.9996 * big) * east, F.lit(0.9996 * big) * north


def compression_band(scale: int) -> tuple[float, float]:
    """Wanted share of removed vertices."""
    return (0.16, 0.20) if scale == 5000 else (0.20, 0.23)


def band_distance(v: Column, scale: int) -> Column:
    low, high = compression_band(scale)
    return F.greatest(F.lit(low) - v, v - F.lit(high), F.lit(0.0))


def candidate_score(model: Column, raw_vertices: Column, vertices: Column, area_ratio: Column, scale: int) -> Column:
    """Model score less penalties for compression outside the band, changed area, and too few vertices."""
    compression = F.when(raw_vertices > 0, (raw_vertices - vertices) / raw_vertices).otherwise(0.0)
    return model - 6.0 * band_distance(compression, scale) - 0.8 * F.abs(F.ln(F.greatest(area_ratio, F.lit(1e-6)))) - F.when(vertices < 4, 1.0).otherwise(0.0)


def failure_category(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: [F.contains(m, F.lit(w)) for w in words]
    any_of = lambda c: c[0] if len(c) == 1 else c[0] | any_of(c[1:])
    return (
        F.when(any_of(has("empty", "zero area")), "empty_geometry")
        .when(any_of(has("not polygon", "no polygon")), "non_polygon")
        .when(any_of(has("invalid", "self-intersection")), "invalid_geometry")
        .when(any_of(has("ring", "token", "candidate")), "decode_error")
        .otherwise("other_error")
    )
