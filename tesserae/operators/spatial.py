"""Spatial joins and features (J15-J19, G1-G8) as equality joins over grid cells, cells by density and shared vertices.

Areas are rows (area, ring) or (area, rings): a closed array of points in projected metres, or a polygon of several parts
with holes (tesserae.functions.geometry). Neighbouring areas share their boundary points exactly, or adjacency and
shared lengths are told a cell size and look for corners along sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry as geo
from tesserae.functions.stats import uniform
from tesserae.sources.shared import materialise


#: Overlaps under this share of the smaller polygon come from rounding.
SLIVER = 1e-9
#: Pairs of edges that a task looks at together.
EDGE_PAIRS = 1 << 18
#: Tasks for each core over which pairs of polygons are dealt.
DEALT = 3
#: Nodes of a cell that isn't cut any further, bits of a coordinate that a level adds, and levels at most.
LEAF, LEVEL_BITS, LEVELS = 16, 2, 13


def with_rings(areas: DataFrame) -> DataFrame:
    """areas with a column rings, made of ring where there is none."""
    return areas if "rings" in areas.columns else areas.withColumn("rings", geo.as_rings(F.col("ring")))


def pip_join(points: DataFrame, areas: DataFrame, size: float = 1.0, tolerance: float = 0.0) -> DataFrame:
    """J15. points (with x, y) joined to the areas that contain them, or with a tolerance lie as near as that."""
    b = geo.rings_box(F.col("rings"))
    wide = F.struct(*((b[k] + sign * tolerance).alias(k) for k, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
    dealt = with_rings(areas).select("area", "rings").withColumn("_cell", F.explode(geo.cells(wide, size)))
    at = (geo.cell(F.col("x"), size) == F.col("_cell.cx")) & (geo.cell(F.col("y"), size) == F.col("_cell.cy"))
    inside = geo.rings_distance(F.col("rings"), F.col("x"), F.col("y")) <= tolerance if tolerance else geo.rings_contain(F.col("rings"), F.col("x"), F.col("y"))
    return points.join(dealt, at).where(inside).drop("rings", "_cell")


def _meeting(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of rows whose boxes _a and _b meet, each once: in the cell of the corner of what they share."""
    left = left.withColumn("_cell", F.explode(geo.cells(F.col("_a"), size)))
    right = right.withColumn("_cell", F.explode(geo.cells(F.col("_b"), size)))
    meet = (F.col("_a.x0") <= F.col("_b.x1")) & (F.col("_b.x0") <= F.col("_a.x1")) & (F.col("_a.y0") <= F.col("_b.y1")) & (F.col("_b.y0") <= F.col("_a.y1"))
    corner = (geo.cell(F.greatest("_a.x0", "_b.x0"), size) == F.col("_cell.cx")) & (geo.cell(F.greatest("_a.y0", "_b.y0"), size) == F.col("_cell.cy"))
    return left.join(right, "_cell").where(meet & corner).drop("_cell", "_a", "_b")


def _under(e: np.ndarray, x: float, y: float) -> tuple[np.ndarray, ...]:
    """Directed edges as signed strips under lines: left end, right end, height at the left end, slope, sign; upright ones have no strip."""
    e = e.reshape(-1, 4) - np.array([x, y, x, y])
    e = e[e[:, 0] != e[:, 2]]
    sign = np.where(e[:, 2] < e[:, 0], 1.0, -1.0)  # the inside is on the left, so below an edge that runs to the left
    e = np.where(sign[:, None] > 0, e[:, [2, 3, 0, 1]], e)
    return e[:, 0], e[:, 2], e[:, 1], (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]), sign


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two polygons share, from their directed edges. A polygon is the signed sum of the strips between its edges and
    a base line, so the shared area is the sum over pairs of edges of what two strips share: the integral of the lower line over their common
    range. Shape, parts and holes make no difference, and the base line cancels out."""
    a, b = a.reshape(-1, 4), b.reshape(-1, 4)
    low, high = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 0].max(), b[:, 0].max())  # all edges' first points are all corners
    if low >= high:
        return 0.0
    meets = lambda e: e[(np.minimum(e[:, 0], e[:, 2]) < high) & (np.maximum(e[:, 0], e[:, 2]) > low)]
    x, y = (low + high) / 2, float(np.mean([a[:, 1].mean(), b[:, 1].mean()]))
    a, b = _under(meets(a), x, y), _under(meets(b), x, y)
    total, step = 0.0, max(1, EDGE_PAIRS // max(1, len(b[0])))
    for at in range(0, len(a[0]), step):
        own = [v[at : at + step, None] for v in a]
        left, right = np.maximum(own[0], b[0]), np.minimum(own[1], b[1])
        i, j = np.nonzero(right > left)
        left, width = left[i, j], (right - left)[i, j]
        ea = own[2][i, 0] + own[3][i, 0] * (left - own[0][i, 0])
        eb = b[2][j] + b[3][j] * (left - b[0][j])
        fa, fb = ea + own[3][i, 0] * width, eb + b[3][j] * width
        d, e = np.abs(ea - eb), np.abs(fa - fb)
        crossed = (ea - eb) * (fa - fb) < 0
        gap = np.where(crossed, (d * d + e * e) / np.where(crossed, d + e, 1.0), d + e)
        total += float(np.sum(own[4][i, 0] * b[4][j] * width * (ea + eb + fa + fb - gap))) / 4
    return max(0.0, total)


def overlay(a: DataFrame, b: DataFrame, size: float = 1.0) -> DataFrame:
    """J17. area, target, overlap (area of the intersection), weight (its share of the area's size), for polygons of any shape.
    a: (area, ring or rings), b: (target, ring or rings). Polygons that only touch aren't paired."""

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            left, right = (rows.column(c) for c in ("edges", "target_edges"))
            values = [np.asarray(c.values) for c in (left, right)]
            ends = [np.asarray(c.offsets) for c in (left, right)]
            own = [overlap_area(*(v[e[i] : e[i + 1]] for v, e in zip(values, ends, strict=True))) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("area", "target", "size", "target_size")), pa.array(own, pa.float64())], names=["area", "target", "size", "target_size", "overlap"])

    kinds = dict(a.dtypes)["area"], dict(b.dtypes)["target"]
    shape = lambda df, key, edges, area, box: with_rings(df).select(key, geo.directed(F.col("rings")).alias(edges), geo.rings_area(F.col("rings")).alias(area), geo.rings_box(F.col("rings")).alias(box))
    pairs = _meeting(shape(a, "area", "edges", "size", "_a"), shape(b, "target", "target_edges", "target_size", "_b"), size)
    pairs = pairs.where("size > 0 and target_size > 0").select("area", "target", "size", "target_size", "edges", "target_edges")
    # few bytes and much work: without a number of tasks, small tables would stay in the one task that read them
    dealt = pairs.repartition(DEALT * pairs.sparkSession.sparkContext.defaultParallelism)
    found = dealt.mapInArrow(clip, f"area {kinds[0]}, target {kinds[1]}, size double, target_size double, overlap double")
    return found.where(F.col("overlap") > SLIVER * F.least("size", "target_size")).select("area", "target", "overlap", (F.col("overlap") / F.col("size")).alias("weight"))


def intersects_join(a: DataFrame, b: DataFrame, size: float = 1.0) -> DataFrame:
    """J16. area, target whose interiors meet."""
    return overlay(a, b, size).select("area", "target")


def _sides(areas: DataFrame) -> DataFrame:
    """area, e, _box: all edges of all rings."""
    e = lambda f, k: f(F.col("e.p")[k], F.col("e.q")[k]).alias(f"{k}{int(f is F.greatest)}")
    return with_rings(areas).select("area", F.explode(geo.rings_edges(F.col("rings"))).alias("e")).select("area", "e", F.struct(e(F.least, "x"), e(F.least, "y"), e(F.greatest, "x"), e(F.greatest, "y")).alias("_box"))


def adjacency(areas: DataFrame, digits: int = 6, size: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """J18, G4. area, neighbour: areas that share a boundary point, both ways. Without a size, areas whose corners are the same to so
    many digits. With the size of a cell, corners that lie on another's side count too: where boundaries touch, a corner
    of one of them is within tolerance of a side of the other."""
    if size is None:
        point = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
        rings = F.flatten(F.transform("rings", lambda r: r["ring"]))
        corners = with_rings(areas).select("area", F.explode(F.array_distinct(F.transform(rings, point))).alias("corner"))
        other = corners.select(F.col("area").alias("neighbour"), "corner")
        return corners.join(other, "corner").where("area <> neighbour").select("area", "neighbour").distinct()
    sides = _sides(areas)
    corners = sides.select("area", F.col("e.p").alias("corner")).distinct()
    around = F.struct(*((F.col("corner")[k[0]] + sign * tolerance).alias(k) for k, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
    near = _meeting(corners.withColumn("_a", around), sides.select(F.col("area").alias("neighbour"), "e", F.col("_box").alias("_b")), size)
    pairs = near.where((F.col("area") != F.col("neighbour")) & (geo.edge_distance(F.col("e"), F.col("corner.x"), F.col("corner.y")) <= tolerance)).select("area", "neighbour")
    return pairs.union(pairs.select("neighbour", "area")).distinct()


def _box_of(nodes: DataFrame, points: DataFrame) -> tuple[float, float, float] | None:
    """Corner and side of the square around all nodes and points; one row to the driver."""
    both = nodes.select("x", "y").unionByName(points.select("x", "y"))
    x0, y0, x1, y1 = both.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if x0 is None else (x0, y0, max(x1 - x0, y1 - y0) or 1.0)


def cells_by_density(nodes: DataFrame, keys: list[str], square: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """A quadtree of nodes (keys, node, x, y; no two of a key at one place), LEVEL_BITS bits a level: its cells (keys, level, cx, cy, leaf),
    and the nodes with their leaf. Cells of more than LEAF nodes are cut, so no cell is a hot key however dense it is."""
    x0, y0, side = square
    left, cells, placed = nodes, None, None
    for level in range(1, LEVELS + 1):
        n = 1 << (LEVEL_BITS * level)
        grid = lambda v, lo, n=n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(v) - lo) / side * n))).cast("int")
        here = left.withColumns({"cx": grid("x", x0), "cy": grid("y", y0)})
        own = here.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("c"))
        own = materialise(own.select(*keys, F.lit(level).alias("level"), "cx", "cy", (F.col("c") <= LEAF if level < LEVELS else F.lit(True)).alias("leaf")), "cells")
        done = here.join(own, [*keys, "cx", "cy"])
        cells = own if cells is None else cells.unionByName(own)
        settled = done.where("leaf").drop("leaf")
        placed = settled if placed is None else placed.unionByName(settled)
        if own.where("not leaf").isEmpty():
            break
        left = materialise(done.where("not leaf").select(*nodes.columns), "crowded-nodes")
    return cells, placed


def nearest(points: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """J19, G8. Each point (point, x, y) with its nearest node (node, x, y) among those with equal keys, and the distance; ties
    go to the smaller node. Null where there is none, or a coordinate is.

    The nodes' cells are gone down level by level, for all points at once: of a point's cells those stay whose nearest
    corner isn't farther than the farthest corner of another one, which holds a node. A point keeps a few cells a level,
    whatever lies in them, and meets the nodes of leaves only."""
    keys = list(keys)
    kind = dict(nodes.dtypes)["node"]
    some = nodes.where("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.min("node").alias("node"))
    square = _box_of(some, points)
    if square is None or some.isEmpty():
        return points.select("point", F.lit(None).cast(kind).alias("node"), F.lit(None).cast("double").alias("distance"))
    x0, y0, side = square
    cells, placed = cells_by_density(some, keys, square)
    cells, placed = materialise(cells, "cells"), materialise(placed.withColumnsRenamed({"x": "nx", "y": "ny"}), "placed-nodes")
    width = F.lit(side) / F.pow(F.lit(2.0), F.col("level") * LEVEL_BITS)
    gaps = []
    for v, c, lo in (("x", "cx", x0), ("y", "cy", y0)):
        low = F.lit(lo) + F.col(c) * width
        gaps.append((F.greatest(F.lit(0.0), low - F.col(v), F.col(v) - low - width), F.greatest(F.abs(F.col(v) - low), F.abs(F.col(v) - low - width))))
    near, far = F.hypot(gaps[0][0], gaps[1][0]), F.hypot(gaps[0][1], gaps[1][1])
    own = points.where("x is not null and y is not null").select("point", *keys, "x", "y")

    def pruned(rows: DataFrame) -> DataFrame:
        bound = F.min(far).over(Window.partitionBy("point")) * (1 + 1e-9) + side * 1e-12  # few rows a point
        return rows.withColumn("_bound", bound).where(near <= F.col("_bound")).drop("_bound")

    top = cells.where("level = 1")
    open_ = pruned(own.join(top, keys) if keys else own.crossJoin(F.broadcast(top)))  # 16 cells at most
    while True:
        open_ = materialise(open_, "open-cells")
        if open_.where("not leaf").isEmpty():
            break
        up = lambda c: F.shiftright(c, LEVEL_BITS)
        below = cells.select(*keys, (F.col("level") - 1).alias("level"), up(F.col("cx")).alias("cx"), up(F.col("cy")).alias("cy"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("leaf").alias("_leaf"))
        down = open_.where("not leaf").join(below, [*keys, "level", "cx", "cy"])
        down = down.select("point", *keys, "x", "y", (F.col("level") + 1).alias("level"), F.col("_x").alias("cx"), F.col("_y").alias("cy"), F.col("_leaf").alias("leaf"))
        open_ = pruned(open_.where("leaf").unionByName(down, allowMissingColumns=False))
    gap = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
    best = open_.join(placed, [*keys, "level", "cx", "cy"]).groupBy("point").agg(F.min(F.struct(gap.alias("distance"), "node")).alias("b"))
    return points.select("point").join(best, "point", "left").select("point", "b.node", "b.distance")


def with_area(areas: DataFrame) -> DataFrame:
    """G1."""
    return with_rings(areas).withColumn("size", geo.rings_area(F.col("rings"))).select(*areas.columns, "size")


def neighbour_count(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """G2. Areas without neighbours have 0."""
    counts = edges.groupBy("area").agg(F.count(F.lit(1)).alias("neighbours"))
    return areas.select("area").join(counts, "area", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def shared_length(areas: DataFrame, digits: int = 6, size: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """G3. Length of the boundary that an area shares with others. Without a size, edges that occur in more than one area, to
    so many digits. With the size of a cell, parts of sides count too: what two sides have in common that lie on one line."""
    if size is None:
        point = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
        edges = with_rings(areas).select("area", F.explode(geo.rings_edges(F.col("rings"))).alias("e"))
        keyed = edges.select("area", F.array_sort(F.array(point(F.col("e.p")), point(F.col("e.q")))).alias("edge"), geo.edge_length(F.col("e")).alias("length"))
        sides = keyed.groupBy("edge").agg(F.collect_set("area").alias("areas"), F.first("length").alias("length")).where(F.size("areas") > 1)  # two areas, as a rule
        shared = sides.select(F.explode("areas").alias("area"), "length")
    else:
        sides = _sides(areas)
        wide = F.struct(*((F.col("_box")[k] + sign * tolerance).alias(k) for k, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
        pairs = _meeting(sides.select("area", "e", wide.alias("_a")), sides.select(F.col("area").alias("other"), F.col("e").alias("f"), F.col("_box").alias("_b")), size).where("area <> other")
        length = geo.edge_length(F.col("e"))
        along = lambda p: ((p["x"] - F.col("e.p.x")) * (F.col("e.q.x") - F.col("e.p.x")) + (p["y"] - F.col("e.p.y")) * (F.col("e.q.y") - F.col("e.p.y"))) / length
        off = lambda p: F.abs((p["x"] - F.col("e.p.x")) * (F.col("e.q.y") - F.col("e.p.y")) - (p["y"] - F.col("e.p.y")) * (F.col("e.q.x") - F.col("e.p.x"))) / length
        p, q = F.col("f.p"), F.col("f.q")
        pairs = pairs.where(length > tolerance).withColumns({"_t": along(p), "_u": along(q), "_d": off(p), "_e": off(q), "_l": length})
        common = F.least(F.col("_l"), F.greatest("_t", "_u")) - F.greatest(F.lit(0.0), F.least("_t", "_u"))
        # the other side's distance where the common part begins and ends
        at = lambda t: F.abs(F.col("_d") + (F.col("_e") - F.col("_d")) * (t - F.col("_t")) / (F.col("_u") - F.col("_t")))
        begin, end = F.greatest(F.lit(0.0), F.least("_t", "_u")), F.least(F.col("_l"), F.greatest("_t", "_u"))
        shared = pairs.where((F.abs(F.col("_u") - F.col("_t")) > tolerance)).where((common > tolerance) & (at(begin) <= tolerance) & (at(end) <= tolerance)).select("area", common.alias("length"))
    total = shared.groupBy("area").agg(F.sum("length").alias("shared_length"))
    return areas.select("area").join(total, "area", "left").withColumn("shared_length", F.coalesce("shared_length", F.lit(0.0)))


def majority_filter(over: DataFrame, threshold: float, mode: str = "borough") -> DataFrame:
    """G5. over: (area, target, weight). borough: weight > threshold. ward: weight >= threshold, any area where the
    target has one candidate only, and all candidates of a target of which none passes. Weights are compared to nine places."""
    weight = F.round("weight", 9)
    if mode == "borough":
        return over.where(weight > threshold)
    per = Window.partitionBy("target")
    rows = over.withColumns({"_n": F.count(F.lit(1)).over(per), "_passed": F.count_if(weight >= threshold).over(per)})
    return rows.where((weight >= threshold) | (F.col("_n") == 1) | (F.col("_passed") == 0)).drop("_n", "_passed")


def sample_points(areas: DataFrame, n: Column, seed: int = 0, tries: int = 100) -> DataFrame:
    """G6. Up to n points within each area: uniform in its box, those outside left out, at most `tries` draws a point."""
    b = geo.rings_box(F.col("rings"))
    draws = with_rings(areas).select("area", "rings", n.cast("int").alias("_n"), b.alias("_b")).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n") * tries)))
    u = lambda axis: uniform(F.col("area"), seed, F.col("_i"), axis)
    drawn = draws.withColumns({"x": F.col("_b.x0") + u("x") * (F.col("_b.x1") - F.col("_b.x0")), "y": F.col("_b.y0") + u("y") * (F.col("_b.y1") - F.col("_b.y0"))})
    inside = drawn.where(geo.rings_contain(F.col("rings"), F.col("x"), F.col("y")))
    place = F.row_number().over(Window.partitionBy("area").orderBy("_i"))
    return inside.withColumn("point_no", place).where(F.col("point_no") <= F.col("_n")).select("area", "point_no", "x", "y")


def add_neighbour_lags(panel: DataFrame, edges: DataFrame, value: str = "n") -> DataFrame:
    """G7. Sum and median of the neighbours' values one month before, joined by key; 0 where there is none."""
    before = panel.select(F.col("area").alias("neighbour"), F.add_months("month", 1).alias("month"), F.col(value).alias("_v"))
    stats = edges.join(before, "neighbour").groupBy("area", "month").agg(F.sum("_v").cast("double").alias("neighbour_sum"), F.percentile("_v", F.lit(0.5)).alias("neighbour_median"))
    cols = ("neighbour_sum", "neighbour_median")
    return panel.join(stats, ["area", "month"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
