"""Expressions over rings and polygons, in projected metres.

A ring is a closed array of points struct<x, y>. A polygon of any shape is an array of struct<part, hole, ring>: each part
has one outer ring and any number of holes, in either direction of turn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """Array of struct<p, q> of neighbouring points."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def area(ring: Column) -> Column:
    """F10, G1. Shoelace."""
    return F.abs(signed_area(ring))


def edge_length(e: Column) -> Column:
    return F.sqrt(F.pow(e["q"]["x"] - e["p"]["x"], 2) + F.pow(e["q"]["y"] - e["p"]["y"], 2))


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), edge_length))


def centroid(ring: Column) -> Column:
    """P30, F10. The point itself for a ring of one point."""
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    a = signed_area(ring) * 6
    x = _sum(F.transform(edges(ring), lambda e: (e["p"]["x"] + e["q"]["x"]) * cross(e))) / a
    y = _sum(F.transform(edges(ring), lambda e: (e["p"]["y"] + e["q"]["y"]) * cross(e))) / a
    return F.when(F.size(ring) == 1, F.struct(ring[0]["x"].alias("x"), ring[0]["y"].alias("y"))).otherwise(F.struct(x.alias("x"), y.alias("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right."""
    return F.size(F.filter(edges(ring), lambda e: _crossings(e, x, y))) % 2 == 1


def box(ring: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def cells(b: Column, size: float) -> Column:
    """Grid cells that a box covers, as array<struct<cx, cy>>."""
    span = lambda lo, hi: F.sequence(cell(b[lo], size), cell(b[hi], size))
    return F.flatten(F.transform(span("x0", "x1"), lambda cx: F.transform(span("y0", "y1"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


RINGS = "array<struct<part: int, hole: boolean, ring: array<struct<x: double, y: double>>>>"


def as_rings(ring: Column) -> Column:
    """A ring as a polygon of one part without holes."""
    return F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), ring.alias("ring")))


def rings_edges(rings: Column) -> Column:
    """All edges of all rings, as struct<p, q>."""
    return F.flatten(F.transform(rings, lambda r: edges(r["ring"])))


def rings_area(rings: Column) -> Column:
    """F10, G1. Outer rings less holes."""
    return _sum(F.transform(rings, lambda r: F.when(r["hole"], -area(r["ring"])).otherwise(area(r["ring"]))))


def rings_perimeter(rings: Column) -> Column:
    return _sum(F.transform(rings, lambda r: perimeter(r["ring"])))


def rings_centroid(rings: Column) -> Column:
    """P30, F10. Centroids of the rings by their areas, holes taken off."""
    parts = F.transform(rings, lambda r: F.struct(centroid(r["ring"]).alias("c"), F.when(r["hole"], -area(r["ring"])).otherwise(area(r["ring"])).alias("a")))
    mean = lambda k: _sum(F.transform(parts, lambda m: m["c"][k] * m["a"])) / _sum(F.transform(parts, lambda m: m["a"]))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def _crossings(e: Column, x: Column, y: Column) -> Column:
    return ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])


def rings_contain(rings: Column, x: Column, y: Column) -> Column:
    """Ray casting over all rings: inside a part and in none of its holes."""
    return F.size(F.filter(rings_edges(rings), lambda e: _crossings(e, x, y))) % 2 == 1


def rings_box(rings: Column) -> Column:
    """struct<x0, y0, x1, y1> of all parts."""
    boxes = F.transform(rings, lambda r: box(r["ring"]))
    low = lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))
    high = lambda k: F.array_max(F.transform(boxes, lambda b: b[k]))
    return F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def edge_distance(e: Column, x: Column, y: Column) -> Column:
    """Distance of a point to an edge struct<p, q>."""
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    along = ((x - e["p"]["x"]) * dx + (y - e["p"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.hypot(x - e["p"]["x"] - t * dx, y - e["p"]["y"] - t * dy)


def rings_distance(rings: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polygon: 0 inside, else to the nearest edge."""
    return F.when(rings_contain(rings, x, y), 0.0).otherwise(F.array_min(F.transform(rings_edges(rings), lambda e: edge_distance(e, x, y))))


def directed(rings: Column) -> Column:
    """The edges as a flat array x, y, x, y, ...; outer rings turn left, holes right, so the inside is always on the left."""
    turned = F.transform(rings, lambda r: F.when((signed_area(r["ring"]) > 0) != r["hole"], r["ring"]).otherwise(F.reverse(r["ring"])))
    flat = lambda e: F.array(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])
    return F.flatten(F.flatten(F.transform(turned, lambda r: F.transform(edges(r), flat))))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371000.0) -> Column:
    """F9. Great-circle distance in metres."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(d / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def hilbert_key(x: Column, y: Column, x0: Column, y0: Column, side: Column, bits: int = 10) -> Column:
    """K11. Place of a point on a Hilbert curve over the square at (x0, y0)."""
    top = (1 << bits) - 1
    grid = lambda v, lo: F.least(F.lit(top), F.greatest(F.lit(0), F.floor((v - lo) / side * (top + 1)))).cast("int")
    start = F.struct(grid(x, x0).alias("x"), grid(y, y0).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), level)
        rx, ry = (s["x"].bitwiseAND(size) > 0).cast("int"), (s["y"].bitwiseAND(size) > 0).cast("int")
        d = s["d"] + size.cast("long") * size * (3 * rx).bitwiseXOR(ry)
        # turn the quadrant so that the curve enters and leaves it as the whole does
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, size - 1 - s["x"]).otherwise(s["x"]), F.when(flip, size - 1 - s["y"]).otherwise(s["y"])
        low = size - 1
        fx, fy = fx.bitwiseAND(low), fy.bitwiseAND(low)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])
