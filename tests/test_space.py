"""Polygons of any shape, boundaries without common corners, and nearest nodes, against plain geometry."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import geometry as geo
from tesserae.operators import network as net
from tesserae.operators import spatial
from tesserae.sources import tables

RING = "array<struct<x: double, y: double>>"
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
ELL = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]


def closed(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def frame(spark, rows, key="area"):
    """rows of (key, [(part, hole, corners)])."""
    return spark.createDataFrame([(k, [(p, h, closed(c)) for p, h, c in rings]) for k, rings in rows], f"{key} string, rings {geo.RINGS}")


def clipped(subject, triangle):
    """Area of a convex polygon within a triangle that turns left, by half-plane cuts."""
    for p, q in zip(triangle, triangle[1:] + triangle[:1], strict=True):
        side = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for x, y in subject]
        out = []
        for k, (x, y) in enumerate(subject):
            x2, y2 = subject[(k + 1) % len(subject)]
            a, b = side[k], side[(k + 1) % len(subject)]
            if a >= 0:
                out.append((x, y))
            if a * b < 0:
                out.append((x + a / (a - b) * (x2 - x), y + a / (a - b) * (y2 - y)))
        subject = out
        if not subject:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(subject, subject[1:] + subject[:1], strict=True))) / 2


def brute_overlap(a, b):
    """Signed triangles from the origin to each edge, pair by pair."""

    def fans(rings):
        for _, hole, ring in rings:
            area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
            ring = ring if (area > 0) != hole else ring[::-1]
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                turn = p[0] * q[1] - q[0] * p[1]
                if turn:
                    yield math.copysign(1, turn), [(0.0, 0.0), p, q] if turn > 0 else [(0.0, 0.0), q, p]

    return sum(s * t * clipped(x, y) for s, x in fans(a) for t, y in fans(b))


def star(rng, x, y, low, high, n):
    turns = [(k + rng.uniform(-0.3, 0.3)) * 2 * math.pi / n for k in range(n)]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [rng.uniform(low, high)]]


def shape(rng):
    x, y = rng.uniform(-2, 2), rng.uniform(-2, 2)
    rings = [(0, False, star(rng, x, y, 1.5, 4, rng.randint(8, 16))), (0, True, star(rng, x, y, 0.2, 0.5, 8))]
    if rng.random() < 0.5:
        rings.append((1, False, star(rng, x + 9, y, 0.5, 2, 8)))
    return [(p, h, r[:: rng.choice([1, -1])]) for p, h, r in rings]


def test_overlaps_of_any_shape(spark):
    rng = random.Random(2)
    a, b = [(f"a{i}", shape(rng)) for i in range(12)], [(f"b{i}", shape(rng)) for i in range(12)]
    got = {(r["area"], r["target"]): r["overlap"] for r in spatial.overlay(frame(spark, a), frame(spark, b, "target"), 3.0).collect()}
    for x, s in a:
        for y, t in b:
            assert abs(got.get((x, y), 0.0) - brute_overlap(s, t)) < 1e-9


def test_concave_targets_holes_and_touching(spark):
    a = frame(spark, [("square", [(0, False, SQUARE)]), ("far", [(0, False, [(20, 0), (30, 0), (30, 10)])]), ("beside", [(0, False, [(10, 0), (20, 0), (20, 10), (10, 10)])]), ("flat", [(0, False, [(0, 0), (1, 1), (2, 2)])])])
    b = frame(spark, [("ell", [(0, False, ELL)]), ("frame", [(0, False, SQUARE[::-1]), (0, True, [(1, 1), (9, 1), (9, 9), (1, 9)])]), ("hole", [(0, False, [(1, 1), (9, 1), (9, 9), (1, 9)])])], "target")
    got = {(r["area"], r["target"]): round(r["overlap"], 9) for r in spatial.overlay(a, b, 4.0).collect()}
    assert got == {("square", "ell"): 36.0, ("square", "frame"): 36.0, ("square", "hole"): 64.0}
    assert spatial.overlay(a, b.withColumnRenamed("target", "t").withColumn("target", F.col("t")).where("t = 'frame'"), 4.0).count() == 1
    assert {tuple(r) for r in spatial.intersects_join(b.withColumnRenamed("target", "area").where("area <> 'ell'"), b.where("target <> 'ell'"), 4.0).collect()} == {("frame", "frame"), ("hole", "hole")}


def test_overlap_far_from_the_origin_keeps_its_digits(spark):
    shift = lambda ring: [(x + 530_000, y + 180_000) for x, y in ring]
    out = spatial.overlay(frame(spark, [("s", [(0, False, shift(SQUARE))])]), frame(spark, [("e", [(0, False, shift(ELL))])], "target"), 50.0).first()
    assert abs(out["overlap"] - 36) < 1e-6 and abs(out["weight"] - 0.36) < 1e-8


def test_many_edges():
    turn = np.linspace(0, 2 * np.pi, 3001)
    ring = np.stack((np.cos(turn), np.sin(turn)), axis=1)
    edges = np.concatenate((ring[:-1], ring[1:]), axis=1).ravel()
    own = abs(np.sum(ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1])) / 2
    assert abs(spatial.overlap_area(edges, edges) - own) < 1e-9
    half = np.array([[0, -2, 2, -2], [2, -2, 2, 2], [2, 2, 0, 2], [0, 2, 0, -2]], float).ravel()
    assert abs(spatial.overlap_area(edges, half) - own / 2) < 1e-9


def test_measures_of_parts_and_holes(spark):
    df = frame(spark, [("a", [(0, False, SQUARE), (0, True, [(2, 2), (2, 4), (4, 4), (4, 2)]), (1, False, [(20, 0), (22, 0), (22, 2), (20, 2)])])])
    r = F.col("rings")
    row = df.select(geo.rings_area(r), geo.rings_perimeter(r), geo.rings_box(r), geo.rings_centroid(r)).first()
    assert row[0] == 100 - 4 + 4 and row[1] == 40 + 8 + 8 and list(row[2]) == [0, 0, 22, 10]
    assert abs(row[3]["x"] - (100 * 5 - 4 * 3 + 4 * 21) / 100) < 1e-9 and abs(row[3]["y"] - (100 * 5 - 4 * 3 + 4 * 1) / 100) < 1e-9
    points = spark.createDataFrame([("in", 1.0, 5.0), ("hole", 3.0, 3.0), ("part", 21.0, 1.5), ("between", 15.0, 1.0), ("close", 10.3, 5.0), ("edge", 3.0, 2.4), (None, None, None)], "point string, x double, y double")
    assert {x["point"] for x in spatial.pip_join(points, df, 4.0).collect()} == {"in", "part"}
    assert {x["point"] for x in spatial.pip_join(points, df, 4.0, tolerance=0.5).collect()} == {"in", "part", "close", "edge"}


def test_geojson(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    kinds = [("Polygon", [square]), ("Polygon", [square, hole]), ("MultiPolygon", [[square, hole], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]), ("Point", [1, 2]), ("MultiPolygon", [])]
    features = [{"type": "Feature", "properties": {"name": f"{i}"}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(kinds)] + [{"type": "Feature", "properties": {"name": "none"}, "geometry": None}]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)))
    for name, lines in (("a.json", False), ("lines.json", True)):
        rows = tables.read_geojson(spark, str(tmp_path / name), lines).select(F.col("properties")["name"].alias("name"), geo.rings_area(F.col("rings")).alias("size"), F.size("rings").alias("n"), F.transform("rings", lambda r: r["part"]).alias("parts")).collect()
        assert {r["name"]: (r["size"], r["n"], r["parts"]) for r in rows} == {"0": (16.0, 1, [0]), "1": (15.0, 2, [0, 0]), "2": (15.5, 3, [0, 0, 1]), "4": (0.0, 0, [])}


def test_corners_on_sides(spark):
    """A T: the corner of two areas lies on the long side of a third, which has no corner there."""
    rows = [("low", [(0, 0), (4, 0), (4, 1), (0, 1)]), ("left", [(0, 1), (2, 1), (1.5, 3), (0, 3)]), ("right", [(2, 1), (3, 1), (3, 3), (1.5, 3)]), ("alone", [(7, 7), (8, 7), (8, 8)])]
    areas = frame(spark, [(k, [(0, False, c)]) for k, c in rows])
    assert {tuple(sorted(r)) for r in spatial.adjacency(areas).collect()} == {("left", "right"), ("left", "low")}  # by corners alone
    pairs = {tuple(r) for r in spatial.adjacency(areas, size=1.5).collect()}
    assert pairs == {(a, b) for p in (("low", "left"), ("low", "right"), ("left", "right")) for a, b in (p, p[::-1])}
    shared = {r["area"]: round(r["shared_length"], 6) for r in spatial.shared_length(areas, size=1.5).collect()}
    slant = math.hypot(0.5, 2)
    assert shared == {"low": 3.0, "left": round(2 + slant, 6), "right": round(1 + slant, 6), "alone": 0.0}


def test_sides_as_corners_on_a_grid(spark):
    from tesserae.plans import frames
    from tests.conftest import SF

    plots = frames.plots(spark, SF)
    assert {tuple(r) for r in spatial.adjacency(plots).collect()} == {tuple(r) for r in spatial.adjacency(plots, size=1.0).collect()}
    assert sorted(spatial.shared_length(plots).collect()) == sorted(spatial.shared_length(plots, size=1.0).collect())


@pytest.mark.parametrize("keys", [(), ("ward",)])
def test_nearest_by_density(spark, keys):
    rng = random.Random(9)
    nodes = [(i, i % 3, rng.random(), rng.random()) for i in range(300)]
    nodes += [(1000 + i, 1, 5 + rng.random() / 1000, 5 + rng.random() / 1000) for i in range(500)]  # a dense place
    nodes += [(2000 + i, 2, 7.0, 7.0) for i in range(100)]  # many nodes at one place
    nodes += [(3000, 0, 90.0, -40.0), (3001, 1, None, 2.0), (3002, 0, nodes[0][2], nodes[0][3])]
    points = [(i, i % 3, rng.uniform(-1, 8), rng.uniform(-1, 8)) for i in range(120)] + [(500, 0, nodes[0][2], nodes[0][3]), (501, 1, None, 1.0), (502, 9, 1.0, 1.0), (503, 0, 1e5, 1e5)]
    df, sf = spark.createDataFrame(points, "point int, ward int, x double, y double"), spark.createDataFrame(nodes, "node int, ward int, x double, y double")
    got = {r["point"]: (r["node"], r["distance"]) for r in spatial.nearest(df, sf, keys).collect()}
    assert len(got) == len(points)
    for p, w, x, y in points:
        own = [] if x is None else [(math.hypot(x - a, y - b), n) for n, v, a, b in nodes if a is not None and (not keys or v == w)]
        if not own:
            assert got[p] == (None, None)
        else:
            d, n = min(own)
            assert got[p][0] == n and abs(got[p][1] - d) < 1e-9
    cells, placed = spatial.cells_by_density(sf.where("x is not null").groupBy("ward", "x", "y").agg(F.min("node").alias("node")), ["ward"], (-1.0, -40.0, 131.0))
    assert placed.groupBy("ward", "level", "cx", "cy").count().agg(F.max("count")).first()[0] <= spatial.LEAF
    assert spatial.nearest(df, sf.where("false"), keys).count() == len(points)


def test_waypoints_stay_in_their_ward(spark):
    square = lambda x: closed([(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)])
    areas = spark.createDataFrame([(w, 10 * w, square(w), 250000.0, 0.5) for w in (0, 1)], f"ward int, area int, ring {RING}, size double, rate double")
    nodes = spark.createDataFrame([(0, 1, 0.1, 0.5), (1, 2, 1.01, 0.5), (1, 3, 1.9, 0.5)], "ward int, node int, x double, y double")
    out = net.select_waypoints(areas, nodes, "ward").collect()
    assert len(out) == 10 and all((r["node"] == 1) == (r["ward"] == 0) for r in out)


def test_a_box_reads_few_row_groups(spark, tmp_path):
    """Of a table written by place, a box of a hundredth of the ground meets under a tenth of the row groups."""
    import pyarrow.parquet as pq

    rng = random.Random(6)
    rows = [(i, rng.random() * 1000, rng.random() * 1000) for i in range(20000)] + [(-1, None, 5.0), (-2, 1.0, None)]
    path = str(tmp_path / "points")
    tables.write_by_place(spark.createDataFrame(rows, "id int, x double, y double"), path, files=60)
    box = (420.0, 610.0, 520.0, 710.0)
    groups = [m.row_group(k) for f in tmp_path.rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    spans = [[(c.statistics.min, c.statistics.max) for c in map(g.column, (1, 2))] for g in groups]
    met = [s for s in spans if s[0][0] <= box[2] and s[0][1] >= box[0] and s[1][0] <= box[3] and s[1][1] >= box[1]]
    assert len(spans) >= 50 and len(met) < len(spans) / 10
    got = {r["id"] for r in tables.read_box(spark, path, *box).collect()}
    assert got == {i for i, x, y in rows if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert spark.read.parquet(path).count() == len(rows)


def test_overlay_of_tables_in_one_file_takes_all_cores(spark):
    """The cut of polygons is dealt out, however few bytes they have."""
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    a = spark.createDataFrame([(i, square(i % 5 + 0.0, i // 5 + 0.0, 1.0)) for i in range(50)], "area int, ring array<struct<x: double, y: double>>").coalesce(1)
    b = spark.createDataFrame([(i, square(i * 2 - 0.5, -0.5, 2.0)) for i in range(3)], "target int, ring array<struct<x: double, y: double>>").coalesce(1)
    out = spatial.overlay(a, b)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r["area"], r["target"], round(r["overlap"], 9)) for r in out.collect())[:3] == [(0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5)]
