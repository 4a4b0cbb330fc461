"""Queries of road networks and patrol allocation. Wards are nations; a ward's roads run along its customers: node i is
joined to nodes i + 1, i + 7 and i + 49, mostly both ways, and its last node is a dead end that leads nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import network as net
from tesserae.plans import frames as fr
from tesserae.plans.frames import Query
from tesserae.sources.shared import materialise
from tesserae.sources.tables import read_table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col
#: Road classes in the order of their numbers.
ROADS = ["primary", "secondary", "residential", "service", "trunk", "cycleway"]


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf, q=query: fr.finish(q(spark, sf))
    if sql:
        SQL[name] = sql


def nodes(s: SparkSession, d: str) -> DataFrame:
    """ward, node, x, y within the ward's square, i (the node's place in its ward), k (the ward's nodes)."""
    w = Window.partitionBy("c_nationkey")
    rows = read_table(s, d, "customer").select(
        c("c_nationkey").alias("ward"), c("c_custkey").alias("node"), (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("k")
    )
    return rows.withColumns({"x": c("ward") % 5 + (c("i") * 7 % 97 + 0.5) / 97, "y": F.floor(c("ward") / 5) + (c("i") * 31 % 89 + 0.5) / 89})


def edges(s: SparkSession, d: str) -> DataFrame:
    """ward, u, v, length, highway."""
    own = nodes(s, d).select("ward", "node", "i", "k")
    step = own.withColumn("step", F.explode(F.array(*map(F.lit, (1, 7, 49)))))
    ahead = step.select("ward", c("node").alias("u"), (c("i") + c("step")).alias("i"), "k", "step").join(own.select("ward", c("node").alias("v"), "i"), ["ward", "i"])
    both = ahead.select("ward", "u", "v", "i", "k", "step", F.explode(F.array(F.lit(True), F.lit(False))).alias("way")).where("way or i < k - 1")
    u, v = F.when(c("way"), c("u")).otherwise(c("v")), F.when(c("way"), c("v")).otherwise(c("u"))
    kind = lambda salt: F.element_at(F.array(*map(F.lit, ROADS)), ((c("u") + c("v") * 3 + salt) % 6 + 1).cast("int"))
    highway = F.when((c("u") + c("v")) % 7 == 0, F.array(kind(0), kind(2))).otherwise(F.array(kind(0)))
    return both.select("ward", u.alias("u"), v.alias("v"), (100.0 + (c("u") * 13 + c("v") * 7) % 400).alias("length"), highway.alias("highway"))


_EDGES = f"""nodes AS (SELECT c_nationkey AS ward, c_custkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS k FROM customer),
    raw AS (SELECT a.ward, a.node AS u, b.node AS v, b.i, a.k, way FROM nodes a, (VALUES (1), (7), (49)) t(step), (VALUES (true), (false)) w(way), nodes b
            WHERE b.ward = a.ward AND b.i = a.i + step AND (way OR b.i < a.k - 1)),
    edges AS (SELECT ward, CASE WHEN way THEN u ELSE v END AS u, CASE WHEN way THEN v ELSE u END AS v, 100.0::DOUBLE + (u * 13 + v * 7) % 400 AS length,
              CASE WHEN (u + v) % 7 = 0 THEN [{ROADS!r}[(u + v * 3) % 6 + 1], {ROADS!r}[(u + v * 3 + 2) % 6 + 1]] ELSE [{ROADS!r}[(u + v * 3) % 6 + 1]] END AS highway FROM raw)"""


def _waypoints(s: SparkSession, d: str, n: int = 4) -> DataFrame:
    own = nodes(s, d)
    return own.where(c("i") % F.greatest(F.lit(1), F.floor(c("k") / n)) == 0).where("i < k - 1").select("ward", "node", "x", "y")


_WAY = "way AS (SELECT ward, node FROM nodes WHERE i % greatest(1, k // 4) = 0 AND i < k - 1)"


def _areas(s: SparkSession, d: str) -> DataFrame:
    """ward, area, ring, size, rate: a ward is one area here, of 40,000 to 340,000 square metres."""
    rates = fr.panel(s, d).where("month = '2001-11-01'").join(fr.areas(s, d).select("area", "ward"), "area").groupBy("ward").agg((F.avg("n") / 3).alias("rate"))
    own = fr.squares(s, d).withColumn("ward", c("area")).join(rates, "ward", "left")
    return own.withColumn("size", (40000 + c("area") * 12500).cast("double")).select("ward", "area", "ring", "size", "rate")


_AREAS = "areas AS (SELECT n_nationkey AS ward, n_nationkey AS area, (40000 + n_nationkey * 12500)::DOUBLE AS size, rate FROM nation LEFT JOIN (SELECT ward, avg(n) / 3 AS rate FROM panel WHERE month = DATE '2001-11-01' GROUP BY ward) r ON r.ward = n_nationkey)"


def _table(s: SparkSession, d: str) -> DataFrame:
    way = materialise(_waypoints(s, d), "waypoints")
    return net.distance_table(net.multi_source_dist(edges(s, d), way, targets=way), way)


def k10(s: SparkSession, d: str) -> DataFrame:
    return net.select_waypoints(_areas(s, d), nodes(s, d).select("ward", "node", "x", "y"), "ward")


def k12(s: SparkSession, d: str) -> DataFrame:
    return net.route_length(net.visit_order(_waypoints(s, d)), _table(s, d))


def k13(s: SparkSession, d: str) -> DataFrame:
    wards = read_table(s, d, "nation").select(c("n_nationkey").alias("ward"), c("n_regionkey").alias("borough"))
    return net.route_coverage(wards, _areas(s, d).where(net.flag_high(c("rate"))), "borough")


def k14(s: SparkSession, d: str) -> DataFrame:
    own = nodes(s, d).select("ward", "node", c("ward").alias("area"))
    return net.mean_closeness(materialise(edges(s, d).select("ward", "u", "v", "length"), "roads"), own)


_cost = lambda rule: lambda s, d: net.edge_cost(edges(s, d), rule).select("ward", "u", "v", "cost")
_has = lambda roads: f"list_has_any(highway, {roads!r})"
add("k1_edge_cost_main", _cost("main"), f"WITH {_EDGES} SELECT ward, u, v, length * CASE WHEN {_has(net.MAIN_ROADS)} THEN 3 ELSE 1 END AS cost FROM edges")
add("k2_edge_cost_quiet", _cost("quiet"), f"WITH {_EDGES} SELECT ward, u, v, length * CASE WHEN {_has(net.QUIET_ROADS)} THEN 1 ELSE 30 END AS cost FROM edges")
add("k3_residential", lambda s, d: net.residential(edges(s, d)).select("ward", "u", "v"), f"WITH {_EDGES} SELECT ward, u, v FROM edges WHERE {_has(['residential'])}")
_REACH = f"""RECURSIVE {_EDGES},
    reach(ward, a, b) AS (SELECT ward, node, node FROM nodes UNION SELECT r.ward, r.a, e.v FROM reach r JOIN edges e ON e.ward = r.ward AND e.u = r.b),
    component AS (SELECT x.ward, x.a AS node, min(x.b) AS head FROM reach x JOIN reach y ON y.ward = x.ward AND y.a = x.b AND y.b = x.a GROUP BY x.ward, x.a),
    largest AS (SELECT ward, arg_min(head, (-n, head)) AS head FROM (SELECT ward, head, count(*) AS n FROM component GROUP BY ALL) GROUP BY ward),
    kept AS (SELECT node FROM component c JOIN largest l ON l.ward = c.ward AND l.head = c.head)"""
add("k4_largest_scc", lambda s, d: net.largest_scc(edges(s, d)).select("ward", "u", "v"), f"WITH {_REACH} SELECT ward, u, v FROM edges WHERE u IN (FROM kept) AND v IN (FROM kept)")
_DIST = f"""RECURSIVE {_EDGES}, {_WAY}, both_ways AS (SELECT ward, a AS u, b AS v, min(length) AS w FROM (SELECT ward, u AS a, v AS b, length FROM edges UNION ALL SELECT ward, v, u, length FROM edges) GROUP BY ALL),
    dist(ward, source, node, dist) USING KEY (ward, source, node) AS (
        SELECT ward, node, node, 0.0::DOUBLE FROM way
        UNION
        SELECT d.ward, d.source, b.v, min(d.dist + b.w) FROM dist d JOIN both_ways b ON b.ward = d.ward AND b.u = d.node
        LEFT JOIN recurring.dist r ON r.ward = d.ward AND r.source = d.source AND r.node = b.v
        WHERE r.dist IS NULL OR d.dist + b.w < r.dist GROUP BY d.ward, d.source, b.v)"""
add("k5_multi_source_dist", lambda s, d: net.multi_source_dist(edges(s, d), _waypoints(s, d)), f"WITH {_DIST} SELECT ward, source, node, dist FROM dist")
add("k6_distance_table", _table, f"WITH {_DIST} SELECT d.ward, source, node AS target, dist FROM dist d WHERE node IN (SELECT node FROM way)")
_PANEL = fr.PANEL
add("k7_points_by_rate", lambda s, d: _areas(s, d).select("area", net.points_by_rate(c("size"), c("rate")).alias("points")), f"WITH {_PANEL}, {_AREAS} SELECT area, CASE WHEN rate > 0 THEN least(25, greatest(0, floor((1 + sqrt(size / 150000)) * (1 + 0.5 * rate))))::INT END AS points FROM areas")
add("k8_points_by_size", lambda s, d: _areas(s, d).select("area", net.points_by_size(c("size")).alias("points")), f"WITH {_PANEL}, {_AREAS} SELECT area, least(5, greatest(1, floor(size / 50000)))::INT AS points FROM areas")
add("k9_flag_high", lambda s, d: _areas(s, d).select("area", net.flag_high(c("rate")).alias("high")), f"WITH {_PANEL}, {_AREAS} SELECT area, coalesce(rate >= 0.40, false) AS high FROM areas")
_U = lambda i, axis: f"('0x' || substr(md5(concat_ws('|', area, 0, {i}, '{axis}')), 1, 8))::BIGINT / 4294967296.0"
add(
    "k10_select_waypoints",
    k10,
    f"""WITH {_PANEL}, {_AREAS}, {_EDGES},
        spots AS (SELECT ward, area, rate, i::INT AS point_no, ward % 5 + {_U('i', 'x')} AS x, ward // 5 + {_U('i', 'y')} AS y FROM areas, range(1, 6) t(i) WHERE i <= least(5, greatest(1, floor(size / 50000)))),
        places AS (SELECT ward, node, ward % 5 + (i * 7 % 97 + 0.5::DOUBLE) / 97 AS nx, ward // 5 + (i * 31 % 89 + 0.5::DOUBLE) / 89 AS ny FROM nodes),
        gaps AS (SELECT s.*, node, sqrt((x - nx) ** 2 + (y - ny) ** 2) AS distance FROM spots s LEFT JOIN places p ON p.ward = s.ward),
        snapped AS (SELECT ward, area, point_no, any_value(rate) AS rate, arg_min(node, (distance, node)) AS node, min(distance) AS distance FROM gaps GROUP BY ALL),
        picked AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY (point_no = 1) DESC, coalesce(rate, 0) DESC, area || '|' || point_no) AS place FROM snapped)
        SELECT ward, area, point_no, node, round(distance, 6) AS distance FROM picked WHERE point_no = 1 OR place <= 20""",
)
_ORDER = """spot AS (SELECT nodes.ward, nodes.node, nodes.ward % 5 + (i * 7 % 97 + 0.5::DOUBLE) / 97 AS x, nodes.ward // 5 + (i * 31 % 89 + 0.5::DOUBLE) / 89 AS y FROM nodes JOIN way ON way.ward = nodes.ward AND way.node = nodes.node),
    frame AS (SELECT ward, min(x) AS x0, min(y) AS y0, coalesce(nullif(greatest(max(x) - min(x), max(y) - min(y)), 0), 1) AS side FROM spot GROUP BY ward),
    curve(ward, node, x, y, d, level) AS (
        SELECT ward, node, least(1023, greatest(0, floor((x - x0) / side * 1024)))::BIGINT, least(1023, greatest(0, floor((y - y0) / side * 1024)))::BIGINT, 0::BIGINT, 9 FROM spot JOIN frame USING (ward)
        UNION ALL
        SELECT ward, node,
               CASE WHEN NOT up THEN (CASE WHEN ahead THEN size - 1 - y ELSE y END) & (size - 1) ELSE x & (size - 1) END,
               CASE WHEN NOT up THEN (CASE WHEN ahead THEN size - 1 - x ELSE x END) & (size - 1) ELSE y & (size - 1) END,
               d + size * size * xor(3 * ahead::BIGINT, up::BIGINT), level - 1
        FROM (SELECT *, (1::BIGINT << level) AS size, x & (1::BIGINT << level) > 0 AS ahead, y & (1::BIGINT << level) > 0 AS up FROM curve WHERE level >= 0)),
    visits AS (SELECT ward, node, row_number() OVER (PARTITION BY ward ORDER BY d, node) AS place FROM curve WHERE level = -1)"""
add("k11_visit_order", lambda s, d: net.visit_order(_waypoints(s, d)).select("ward", "node", "place"), f"WITH RECURSIVE {_EDGES}, {_WAY}, {_ORDER} SELECT ward, node, place FROM visits")
add(
    "k12_route_length",
    k12,
    f"""WITH {_DIST}, {_ORDER}, legs AS (SELECT ward, node AS source, coalesce(lead(node) OVER w, first(node) OVER w) AS target FROM visits WINDOW w AS (PARTITION BY ward ORDER BY place))
        SELECT l.ward, count(*) AS legs, round(sum(dist), 6) AS length FROM legs l JOIN dist d ON d.ward = l.ward AND d.source = l.source AND d.node = l.target GROUP BY l.ward""",
)
add("k13_route_coverage", k13, f"WITH {_PANEL}, {_AREAS} SELECT n_regionkey AS borough, count(*) AS wards, count_if(NOT coalesce(rate >= 0.4, false))::BIGINT AS missing, round(avg(coalesce(rate >= 0.4, false)::INT) * 100, 6) AS covered_pct FROM nation JOIN areas ON ward = n_nationkey GROUP BY n_regionkey")
_ALL = "way AS (SELECT ward, node FROM nodes)"
add(
    "k14_mean_closeness",
    k14,
    f"""WITH {_DIST.replace(_WAY, _ALL)}, close AS (SELECT ward, node, count(*) / sum(dist) AS closeness FROM dist WHERE dist > 0 GROUP BY ALL)
        SELECT ward AS area, round(avg(closeness), 6) AS closeness FROM close GROUP BY ward""",
)
