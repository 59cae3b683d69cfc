"""Areas, distances and least boxes between polygons as JVM-side columns.

A polygon column is parts of rings of points (``operators.geometry.PARTS_DDL``). Polygons are taken to be valid, as
cleaning leaves them. ``boundary`` gives their edges; all else is folds over edges, so that a plan has no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantle.functions.rings import rotated, signed_area

_POINT = "struct<x:double,y:double>"


def boundary(parts: Column, turn: bool = True) -> Column:
    """Edges (ax, ay, bx, by) of all rings, as they stand or, with ``turn``, outer rings counter-clockwise and holes clockwise."""

    def ring(r: Column) -> Column:
        return F.zip_with(r, rotated(r), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    # all rings turned first, so that each is looked at once
    turned = F.transform(parts, lambda p: F.transform(p, lambda r, i: F.when((signed_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r))) if turn else parts
    return F.flatten(F.transform(F.flatten(turned), ring))


def shifted(edges: Column, x: Column, y: Column) -> Column:
    """Edges with (x, y) as their origin, which keeps digits where coordinates are large."""
    return F.transform(edges, lambda e: F.struct((e["ax"] - x).alias("ax"), (e["ay"] - y).alias("ay"), (e["bx"] - x).alias("bx"), (e["by"] - y).alias("by")))


def length(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def enclosed(edges: Column) -> Column:
    """The area within a boundary."""
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]))) / 2


# -- common area ----------------------------------------------------------------------------------
def spans(edges: Column) -> Column:
    """Edges as lines over stretches of x: from l to r, y at l, slope, and direction (1 or -1); upright ones are left out."""
    slanted = F.filter(edges, lambda e: e["ax"] != e["bx"])
    right = lambda e: e["ax"] < e["bx"]
    return F.transform(
        slanted,
        lambda e: F.struct(
            F.least(e["ax"], e["bx"]).alias("l"),
            F.greatest(e["ax"], e["bx"]).alias("r"),
            F.when(right(e), e["ay"]).otherwise(e["by"]).alias("y"),
            ((e["by"] - e["ay"]) / (e["bx"] - e["ax"])).alias("m"),
            F.when(right(e), 1.0).otherwise(-1.0).alias("s"),
        ),
    )


def common_area(p: Column, q: Column) -> Column:
    """The area that two polygons share, from the ``spans`` of their boundaries.

    A polygon is the sum of the strips below its edges, signed by direction, and two strips share what lies below
    the lower edge, min(e, f) = (e + f - |e - f|) / 2. At every x the signs of a closed boundary cancel, and with them all
    but the last term: what remains is minus half the sum of s_e s_f times the integral of |e - f| over the stretch
    that both edges have.
    """

    def gap(e: Column, f: Column) -> Column:
        left, right = F.greatest(e["l"], f["l"]), F.least(e["r"], f["r"])
        at = lambda x: (e["y"] + e["m"] * (x - e["l"])) - (f["y"] + f["m"] * (x - f["l"]))
        ends = F.transform(F.array(left, right), at)
        # one struct, so that both ends are computed once
        mean = F.aggregate(F.array(F.struct(ends[0].alias("a"), ends[1].alias("b"))), F.lit(0.0), lambda _, d: F.when(d["a"] * d["b"] >= 0, F.abs(d["a"] + d["b"]) / 2).otherwise((d["a"] * d["a"] + d["b"] * d["b"]) / (2 * (F.abs(d["a"]) + F.abs(d["b"])))))
        return F.when(left < right, e["s"] * f["s"] * (right - left) * mean).otherwise(0.0)

    total = F.aggregate(p, F.lit(0.0), lambda s, e: F.aggregate(q, s, lambda t, f: t + gap(e, f)))
    return F.greatest(F.lit(0.0), total * -0.5)


def overlap(common: Column, a: Column, b: Column) -> Column:
    """Common area over united area; 0 without any."""
    union = a + b - common
    return F.when(union > 1e-12, common / union).otherwise(0.0)


# -- distances ------------------------------------------------------------------------------------
def segments(edges: Column) -> Column:
    """Edges as start, direction, and squared length."""
    return F.transform(edges, lambda e: F.struct(e["ax"].alias("x"), e["ay"].alias("y"), (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy"), ((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"])).alias("n")))


def square_distance(x: Column, y: Column, s: Column) -> Column:
    """From a point to one of the ``segments``, squared."""
    px, py = x - s["x"], y - s["y"]
    t = F.when(s["n"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * s["dx"] + py * s["dy"]) / s["n"]))).otherwise(0.0)
    return (px - t * s["dx"]) * (px - t * s["dx"]) + (py - t * s["dy"]) * (py - t * s["dy"])


def spaced(edges: Column, n: int) -> Column:
    """n points at equal distances along a boundary, ring after ring.

    Lengths add up along the edges; an edge from a to b of the whole holds the points of the numbers from ceil(n a) up to,
    not with, ceil(n b). It starts at the very number that the edge before ends at, so no point is missed or taken twice.
    """
    kind = "array<struct<x:double,y:double,dx:double,dy:double,n:double,start:double,end:double>>"

    def add(out: Column, e: Column) -> Column:
        before = F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(0.0))
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        size = F.hypot(dx, dy)
        return F.concat(out, F.array(F.struct(e["ax"].alias("x"), e["ay"].alias("y"), dx.alias("dx"), dy.alias("dy"), size.alias("n"), before.alias("start"), (before + size).alias("end"))))

    placed = F.aggregate(edges, F.array().cast(kind), add)
    total = lambda row: F.element_at(row, -1)["end"]

    def points(row: Column, e: Column) -> Column:
        low, high = F.ceil(F.lit(n) * e["start"] / total(row)).cast("int"), F.ceil(F.lit(n) * e["end"] / total(row)).cast("int") - 1
        at = lambda k: (k / F.lit(float(n)) * total(row) - e["start"]) / e["n"]
        one = lambda k: F.struct((e["x"] + at(k) * e["dx"]).alias("x"), (e["y"] + at(k) * e["dy"]).alias("y"))
        return F.when((e["n"] > 0) & (high >= low), F.transform(F.sequence(low, high), one)).otherwise(F.array().cast(f"array<{_POINT}>"))

    # folded over one element, so that the edges are placed once
    return F.aggregate(F.array(placed), F.array().cast(f"array<{_POINT}>"), lambda _, row: F.flatten(F.transform(row, lambda e: points(row, e))))


def vertices(edges: Column) -> Column:
    return F.transform(edges, lambda e: F.struct(e["ax"].alias("x"), e["ay"].alias("y")))


# -- least boxes ----------------------------------------------------------------------------------
def _chain(points: Column) -> Column:
    """One side of the hull of sorted points, without its last point. Before a point goes on the chain, the chain is cut
    after the last place where it still turns left."""

    def add(out: Column, p: Column) -> Column:
        def turns(k: Column) -> Column:
            a, b = F.get(out, k - 2), F.get(out, k - 1)
            return (k < 2) | ((b["x"] - a["x"]) * (p["y"] - a["y"]) > (b["y"] - a["y"]) * (p["x"] - a["x"]))

        keep = F.array_max(F.filter(F.sequence(F.lit(1), F.size(out)), turns))
        return F.when(F.size(out) < 2, F.concat(out, F.array(p))).otherwise(F.concat(F.slice(out, F.lit(1), keep), F.array(p)))

    whole = F.aggregate(points, F.array().cast(f"array<{_POINT}>"), add)
    return F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))


def hull(ring: Column) -> Column:
    """The convex hull of a ring, counter-clockwise from its leftmost, then lowest point."""
    points = F.array_sort(F.array_distinct(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return F.when(F.size(points) > 2, F.concat(_chain(points), _chain(F.reverse(points)))).otherwise(points)


def least_box(hull: Column) -> Column:
    """The rectangle of least area around a ``hull``: struct of corner (x, y), direction (ux, uy), its two sides, and area.

    It has a side on a hull edge; of equal areas (to 1e-12) the first edge counts.
    """
    kind = "struct<area:double,x:double,y:double,ux:double,uy:double,along:double,across:double>"

    def box(a: Column, b: Column) -> Column:
        size = F.greatest(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(1e-300))
        ux, uy = (b["x"] - a["x"]) / size, (b["y"] - a["y"]) / size
        put = F.struct(ux.alias("ux"), uy.alias("uy"), *[F.lit(v).alias(n) for n, v in (("s0", float("inf")), ("s1", float("-inf")), ("t0", float("inf")), ("t1", float("-inf")))])

        def widen(w: Column, p: Column) -> Column:
            s, t = p["x"] * w["ux"] + p["y"] * w["uy"], p["y"] * w["ux"] - p["x"] * w["uy"]
            return F.struct(w["ux"].alias("ux"), w["uy"].alias("uy"), F.least(w["s0"], s).alias("s0"), F.greatest(w["s1"], s).alias("s1"), F.least(w["t0"], t).alias("t0"), F.greatest(w["t1"], t).alias("t1"))

        def made(w: Column) -> Column:
            along, across = w["s1"] - w["s0"], w["t1"] - w["t0"]
            return F.struct((along * across).alias("area"), (w["ux"] * w["s0"] - w["uy"] * w["t0"]).alias("x"), (w["uy"] * w["s0"] + w["ux"] * w["t0"]).alias("y"), w["ux"].alias("ux"), w["uy"].alias("uy"), along.alias("along"), across.alias("across"))

        return F.aggregate(hull, put, widen, made)

    boxes = F.zip_with(hull, rotated(hull), box)
    better = lambda best, b: F.when(best["area"].isNull() | (b["area"] < best["area"] - 1e-12), b).otherwise(best)
    return F.aggregate(boxes, F.lit(None).cast(kind), better)


def box_ring(box: Column) -> Column:
    """The corners of a ``least_box``, counter-clockwise."""
    point = lambda s, t: F.struct((box["x"] + box["ux"] * s - box["uy"] * t).alias("x"), (box["y"] + box["uy"] * s + box["ux"] * t).alias("y"))
    zero = F.lit(0.0)
    return F.array(point(zero, zero), point(box["along"], zero), point(box["along"], box["across"]), point(zero, box["across"]))


def box_angle(box: Column) -> Column:
    """Degrees, below 180, of the longer side."""
    along = F.degrees(F.atan2(box["uy"], box["ux"]))
    return F.pmod(F.when(box["along"] >= box["across"], along).otherwise(along + 90.0), F.lit(180.0))


def relative(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(b, F.lit(1e-12))
