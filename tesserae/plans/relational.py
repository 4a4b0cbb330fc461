"""Queries of sources, cleaning, joins, aggregations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import clean as fn
from tesserae.functions import geometry as geo
from tesserae.functions import stats
from tesserae.operators import aggregate as agg
from tesserae.operators import clean, joins, panel, reshape
from tesserae.plans import frames as fr
from tesserae.plans.frames import ATTRS, DAY, INC, LOOKUP, MONTHS, PANEL, Query
from tesserae.sources import tables
from tesserae.sources.shared import new_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf, q=query: fr.finish(q(spark, sf))
    if sql:
        SQL[name] = sql


def t(name: str):
    return lambda s, d: tables.read_table(s, d, name)


# --- sources and sinks: the incident extract is written and read back -----------------------------------------------

_COLS = "id bigint, area bigint, qty double, status string"


def _extract(s: SparkSession, d: str) -> DataFrame:
    return fr.incidents(s, d).select("id", "area", "qty", "status")


def s1(s: SparkSession, d: str) -> DataFrame:
    root = new_path(s, "extracts")
    for status in ("F", "O"):
        tables.write_csv(_extract(s, d).where(F.col("status") == status), f"{root}/2001/{status}-street.csv")
    rows = tables.read_extracts(s, root, "part", _COLS)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


def s2(s: SparkSession, d: str) -> DataFrame:
    src, dst = new_path(s, "csv"), new_path(s, "parquet")
    _extract(s, d).write.option("header", True).option("sep", ";").csv(src)
    return tables.csv_to_parquet(s, src, dst, _COLS, ";", ("status", ["F"]))


def s4(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "sorted")
    tables.write_sorted(_extract(s, d), path, "area", "id")
    return s.read.parquet(path)


def s4_place(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "by-place")
    tables.write_by_place(fr.points(s, d), path)
    return tables.read_box(s, path, 1.0, 2.0, 3.5, 9.0)


def s5(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "summary")
    tables.write_csv(agg.count_sparse(fr.incidents(s, d), ["area"]), path)
    return s.read.schema("area bigint, n bigint").option("header", True).csv(path)


def _geojson(s: SparkSession, d: str, path: str, lines: bool) -> None:
    """Plots as polygons of one ring, shapes with holes and several parts, and points, which a boundary scan leaves out."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    part = lambda k: F.transform(F.filter("rings", lambda r: r["part"] == k), lambda r: ring(r["ring"]))
    several = F.exists("rings", lambda r: r["part"] > 0)
    plots = fr.plots(s, d).select(F.concat(F.lit("p"), "area").alias("name"), F.lit("Polygon").alias("type"), F.to_json(F.array(ring("ring"))).alias("text"))
    shapes = fr.shapes(s, d).select(
        F.concat(F.lit("s"), "target").alias("name"), F.when(several, "MultiPolygon").otherwise("Polygon").alias("type"),
        F.when(several, F.to_json(F.array(part(0), part(1)))).otherwise(F.to_json(part(0))).alias("text"),
    )
    points = fr.points(s, d).select(F.concat(F.lit("x"), "point").alias("name"), F.lit("Point").alias("type"), F.to_json(F.array("x", "y")).alias("text"))
    rows = plots.unionByName(shapes).unionByName(points)
    feature = F.format_string('{"type": "Feature", "properties": {"name": "%s"}, "geometry": {"type": "%s", "coordinates": %s}}', "name", "type", "text")
    if lines:
        rows.select(feature.alias("value")).write.text(path)
    else:  # a document for each hundred or so features
        file = rows.groupBy(F.pmod(F.xxhash64("name"), F.floor(F.lit(rows.count() / 100)) + 1).alias("k")).agg(F.concat_ws(", ", F.collect_list(feature)).alias("all"))
        file.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "all", F.lit("]}")).alias("value")).repartitionByRange(8, "value").write.option("maxRecordsPerFile", 1).text(path)


def _read_geojson(lines: bool):
    def query(s: SparkSession, d: str) -> DataFrame:
        path = new_path(s, "geojson")
        _geojson(s, d, path, lines)
        r, middle = F.col("rings"), geo.rings_centroid(F.col("rings"))
        return tables.read_geojson(s, path, lines).select(
            F.col("properties")["name"].alias("name"), geo.rings_area(r).alias("size"), geo.rings_perimeter(r).alias("outline"), middle["x"].alias("x"), middle["y"].alias("y"),
            F.size(r).alias("rings"), (F.array_max(F.transform(r, lambda q: q["part"])) + 1).alias("parts"), F.size(F.filter(r, lambda q: q["hole"])).alias("holes"),
            F.size(geo.rings_edges(r)).alias("edges"),
        )

    return query


def s7(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "lookup")
    tables.write_csv(fr.lookup(s, d), path)
    return tables.read_lookup(s, path, "old bigint, new bigint", ["new"])


def s8(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "predictions")
    tables.write_predictions(fr.panel(s, d).groupBy("area").agg(F.percentile("n", F.lit(0.5)).alias("median")), path)
    return tables.read_predictions(s, path)


orders, events, part, customer = t("orders"), t("events"), t("part"), t("customer")
_EX = f"WITH {INC} SELECT id, area, round(qty, 6) AS qty, status FROM inc"
add("s1_read_extracts", s1, f"WITH {INC} SELECT status, count(*) AS n, round(sum(qty), 6) AS qty FROM inc GROUP BY status")
add("s2_csv_to_parquet", s2, _EX + " WHERE status = 'F'")
add("s3_read_table", lambda s, d: customer(s, d), "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
add("s4_write_sorted", s4, _EX)
add("s4_write_by_place", s4_place, f"WITH {fr.POINTS} SELECT point, round(x, 6) AS x, round(y, 6) AS y FROM points WHERE x BETWEEN 1 AND 3.5 AND y BETWEEN 2 AND 9")
add("s5_write_csv", s5, f"WITH {INC} SELECT area, count(*) AS n FROM inc GROUP BY area")
_outline = {k: sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for r in fr.SHAPE_RINGS if r[0] == k for a, b in zip(r[3], [*r[3][1:], r[3][0]], strict=True)) for k in range(5)}
_RINGS = ", ".join(f"({k}, {_outline[k]}, {len(own)}, {max(r[1] for r in own) + 1}, {sum(r[2] for r in own)}, {sum(len(r[3]) for r in own)})" for k in range(5) for own in [[r for r in fr.SHAPE_RINGS if r[0] == k]])
_GEO = f"""WITH {fr.PLOTS}, {fr.SHAPES_SQL}, w AS (SELECT *, sign * (x2 - x1) * (y2 - y1) AS a FROM boxes),
    size AS (SELECT target, sum(a) AS size, sum(a * (x1 + x2) / 2) / sum(a) AS x, sum(a * (y1 + y2) / 2) / sum(a) AS y FROM w GROUP BY target)
    SELECT 'p' || area AS name, 1.0::DOUBLE AS size, 4.0::DOUBLE AS outline, x0 + 0.5 AS x, y0 + 0.5 AS y, 1::INT AS rings, 1::INT AS parts, 0::INT AS holes, 4::INT AS edges FROM squares
    UNION ALL SELECT 's' || target, round(size, 6)::DOUBLE, round(outline, 6)::DOUBLE, round(x, 6)::DOUBLE, round(y, 6)::DOUBLE, rings::INT, parts::INT, holes::INT, edges::INT
    FROM size JOIN (VALUES {_RINGS}) v(kind, outline, rings, parts, holes, edges) ON kind = target % 10"""
add("s6_read_geojson", _read_geojson(False), _GEO)
add("s6_read_geojson_lines", _read_geojson(True), _GEO)
add("s7_read_lookup", s7, f"WITH {LOOKUP} SELECT DISTINCT new FROM lookup")
add("s8_predictions", s8, f"WITH {PANEL} SELECT area, quantile_cont(n, 0.5)::DOUBLE AS median FROM panel GROUP BY area")

# --- cleaning -------------------------------------------------------------------------------------------------------

c = F.col

add("p1_filter_eq", lambda s, d: clean.filter_eq(t("lineitem")(s, d), "l_returnflag", "R").select("l_orderkey", "l_linenumber", "l_suppkey"), "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
add(
    "p2_to_month",
    lambda s, d: orders(s, d).select("o_orderkey", *(fn.to_month(F.date_format("o_orderdate", f), f).alias(n) for f, n in (("yyyy-MM", "a"), ("MM-yyyy", "b"), ("yyyy", "y")))),
    "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS b, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y FROM orders",
)
add(
    "p3_to_ts_lenient",
    lambda s, d: events(s, d).select("event_id", F.date_format(fn.to_ts_lenient(F.when(c("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), "yyyy-MM-dd HH:mm:ss").alias("ts")),
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts FROM events",
)
add(
    "p4_to_num_lenient",
    lambda s, d: part(s, d).select("p_partkey", fn.to_num_lenient(F.split("p_brand", "#")[1], "int").alias("brand"), fn.to_num_lenient(c("p_type"), "double").alias("bad")),
    "SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INT) AS brand, try_cast(p_type AS DOUBLE) AS bad FROM part",
)
add(
    "p5_coerce_numeric",
    lambda s, d: clean.coerce_numeric(part(s, d).select(c("p_type").alias("type"), c("p_size").cast("string").alias("size"), c("p_name").alias("Area name")).withColumn("key", c("size"))),
    "SELECT coalesce(try_cast(p_type AS DOUBLE), 0) AS type, coalesce(p_size::DOUBLE, 0) AS size, p_name AS \"Area name\", coalesce(p_size::DOUBLE, 0) AS key FROM part",
)
_point = lambda s, d: fr.points(s, d).select("point", fn.make_point(F.when(c("point") % 7 != 0, c("x")), c("y")).alias("p"))
_POINT = "SELECT s_suppkey AS point, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 37 % 50) / 10 + 0.05 END AS x0, (s_suppkey // 5) + (s_suppkey * 13 % 10) / 10 + 0.05 AS y0 FROM supplier"
add("p6_make_point", lambda s, d: _point(s, d).select("point", c("p.x").alias("x"), c("p.y").alias("y")), f"SELECT point, round(x0, 6) AS x, CASE WHEN x0 IS NOT NULL THEN round(y0, 6) END AS y FROM ({_POINT})")
_gaps = lambda s, d: orders(s, d).select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.when(c("o_orderkey") % 3 != 0, c("o_totalprice")).alias("price"))
_GAPS = "gaps AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price FROM orders)"
add("p7_drop_null", lambda s, d: clean.drop_null(_gaps(s, d), ["priority"]), f"WITH {_GAPS} SELECT o_orderkey, priority, round(price, 6) AS price FROM gaps WHERE priority IS NOT NULL")
add("p8_complete_cases", lambda s, d: clean.complete_cases(_gaps(s, d)), f"WITH {_GAPS} SELECT o_orderkey, priority, round(price, 6) AS price FROM gaps WHERE priority IS NOT NULL AND price IS NOT NULL")
add("p9_fill_map", lambda s, d: clean.fill_map(_gaps(s, d), {"priority": "Not stated"}), f"WITH {_GAPS} SELECT o_orderkey, coalesce(priority, 'Not stated') AS priority, round(price, 6) AS price FROM gaps")
add("p10_fill_zero", lambda s, d: clean.fill_zero(_gaps(s, d), ["price"]), f"WITH {_GAPS} SELECT o_orderkey, priority, round(coalesce(price, 0), 6) AS price FROM gaps")
add("p11_cast_cols", lambda s, d: clean.cast_cols(orders(s, d).select("o_orderkey", "o_custkey", "o_totalprice"), {"o_orderkey": "string", "o_custkey": "int"}), "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::INT AS o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
add("p12_flag_contains", lambda s, d: events(s, d).select("event_id", fn.flag_contains(F.nullif("event_type", F.lit("view")), "i").alias("has")), "SELECT event_id, coalesce(contains(nullif(event_type, 'view'), 'i'), false) AS has FROM events")
add(
    "p13_to_flag",
    lambda s, d: events(s, d).select("event_id", *(fn.to_flag(F.when(c("event_type") == "click", "true").when(c("event_type") == "view", "false"), n).alias(str(n).lower() + "_as_null") for n in (True, False))),
    "SELECT event_id, coalesce(f, true) AS true_as_null, coalesce(f, false) AS false_as_null FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN false END AS f FROM events)",
)
add("p14_drop_if_exists", lambda s, d: clean.drop_if_exists(customer(s, d), ["c_acctbal", "c_name", "absent"]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
add("p15_drop_like", lambda s, d: clean.drop_like(customer(s, d), "key"), "SELECT c_name, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
add("p16_rename", lambda s, d: clean.rename(customer(s, d).select("c_custkey", "c_mktsegment"), {"c_mktsegment": "borough", "absent": "x"}), "SELECT c_custkey, c_mktsegment AS borough FROM customer")
add("p17_resolve_col", lambda s, d: clean.resolve_col(clean.resolve_col(customer(s, d).select("c_custkey", "c_name"), "code", ["LSOA", "C_CUSTKEY"]), "label", ["absent"], "c_name"), "SELECT c_custkey AS code, c_name, c_name AS label FROM customer")
add("p18_tag", lambda s, d: clean.tag(customer(s, d).select("c_custkey", "c_nationkey"), "year", 2019), "SELECT c_custkey, c_nationkey, 2019::INT AS year FROM customer")
add(
    "p19_rank_to_int",
    lambda s, d: orders(s, d).select("o_orderkey", fn.rank_to_int(F.concat(F.floor("o_totalprice").cast("string"), F.lit(",00"))).alias("a"), fn.rank_to_int(F.concat(F.lit("1."), F.lpad((c("o_orderkey") % 1000).cast("string"), 3, "0")), "dot").alias("b")),
    "SELECT o_orderkey, floor(o_totalprice)::INT AS a, (1000 + o_orderkey % 1000)::INT AS b FROM orders",
)
_wide = lambda s, d: orders(s, d).groupBy(F.year("o_orderdate").alias("year"), (c("o_custkey") % 25).alias("nation")).agg(F.floor(F.sum("o_totalprice") * 100).alias("cents"))
_text = lambda: F.concat(
    F.regexp_replace(F.floor(c("cents") / 100).cast("string"), r"(?<=\d)(?=(\d{3})+$)", "."), F.lit(","), F.lpad((c("cents") % 100).cast("string"), 2, "0"), F.lit(" %"))
_WIDE = "wide AS (SELECT year(o_orderdate)::INT AS year, o_custkey % 25 AS nation, floor(sum(o_totalprice) * 100)::BIGINT AS cents FROM orders GROUP BY ALL)"
_exact = lambda s, d: orders(s, d).select("o_orderkey", F.floor(c("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
_EXACT = "SELECT o_orderkey, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents FROM orders"
add("p20_eu_number", lambda s, d: _exact(s, d).select("o_orderkey", fn.eu_number(_text()).alias("v"), fn.eu_number(F.concat(F.lit("-"), _text()), True).alias("strict")), f"SELECT o_orderkey, round(cents / 100, 6) AS v, round(-cents / 100, 6) AS strict FROM ({_EXACT})")
add("p21_simple_number", lambda s, d: _exact(s, d).select("o_orderkey", fn.simple_number(F.concat(F.floor(c("cents") / 100).cast("string"), F.lit(","), F.lpad((c("cents") % 100).cast("string"), 2, "0"))).alias("v")), f"SELECT o_orderkey, round(cents / 100, 6) AS v FROM ({_EXACT})")
add("p22_split_label", lambda s, d: orders(s, d).select("o_orderkey", *(x.alias(n) for x, n in zip(fn.split_label(F.concat("o_orderstatus", F.lit("|"), F.year("o_orderdate"))), ("name", "year"), strict=True))), "SELECT o_orderkey, o_orderstatus AS name, year(o_orderdate)::INT AS year FROM orders")
add("p23_split_label_any", lambda s, d: orders(s, d).select("o_orderkey", *(x.alias(n) for x, n in zip(fn.split_label_any(F.concat(F.lit("All ("), F.year("o_orderdate"), F.lit(") "), "o_orderstatus")), ("name", "year"), strict=True))), "SELECT o_orderkey, 'All ' || o_orderstatus AS name, year(o_orderdate)::INT AS year FROM orders")
add("p24_norm_name", lambda s, d: part(s, d).select("p_partkey", fn.norm_name(F.concat(F.lit("  É"), "p_name", F.lit("--"), "p_type")).alias("name")), "SELECT p_partkey, 'e' || lower(p_name) || ' ' || lower(p_type) AS name FROM part")
add("p25_slug", lambda s, d: part(s, d).select("p_partkey", fn.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
add("p26_match_name", lambda s, d: clean.match_name(customer(s, d).select("c_custkey", "c_mktsegment"), "c_mktsegment", "Building"), "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
add("p27_since", lambda s, d: clean.since(fr.incidents(s, d), "2000-01-01").select("id", "area", "month"), f"WITH {INC} SELECT id, area, {DAY} FROM inc WHERE month >= DATE '2000-01-01'")
add("p28_period_flags", lambda s, d: fr.panel(s, d).select("area", "month", fn.in_period(c("month"), "1998-03-01", "1999-07-01").alias("during"), fn.in_period(c("month"), "1999-08-01").alias("after")), f"WITH {PANEL} SELECT area, {DAY}, (month BETWEEN DATE '1998-03-01' AND DATE '1999-07-01')::INT AS during, (month >= DATE '1999-08-01')::INT AS after FROM panel")
add(
    "p29_poi_group",
    lambda s, d: part(s, d).select("p_partkey", fn.poi_group(F.when(c("p_size") % 4 == 0, F.create_map(F.lit("shop"), c("p_name"))).when(c("p_size") % 4 == 1, F.create_map(F.lit("amenity"), F.lit("cafe"), F.lit("leisure"), F.lit("x"))).when(c("p_size") % 4 == 2, F.create_map(F.lit("other"), c("p_name"))).when(c("p_size") % 4 == 3, F.create_map(F.lit("amenity"), F.lit("parking"), F.lit("shop"), F.lit("x")))).alias("grp")),
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'shop' WHEN 1 THEN 'food' WHEN 3 THEN 'shop' END AS grp FROM part",
)
add("p30_rep_point", lambda s, d: fr.plots(s, d).select("area", clean.rep_point(c("ring")).alias("p")).select("area", "p.x", "p.y"), "SELECT s_suppkey AS area, s_suppkey % 5 + 0.5::DOUBLE AS x, s_suppkey // 5 + 0.5::DOUBLE AS y FROM supplier")
add("p31_shrink_numeric", lambda s, d: clean.shrink_numeric(orders(s, d).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))).selectExpr("cast(o_orderkey as bigint) o_orderkey", "cast(o_custkey as bigint) o_custkey", "cast(year as int) year"), "SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS year FROM orders")
add("p32_scale_bounds", lambda s, d: clean.scale_bounds(fr.panel(s, d), "n"), f"WITH {PANEL} SELECT min(n)::DOUBLE AS low, CASE WHEN quantile_cont(n, 0.99) = min(n) THEN min(n) + 1 ELSE quantile_cont(n, 0.99) END::DOUBLE AS high FROM panel")
add("p33_query", lambda s, d: clean.query(fr.panel(s, d), "n > 3 and month > '2000-06-01'"), f"WITH {PANEL} SELECT area, {DAY}, n FROM panel WHERE n > 3 AND month > DATE '2000-06-01'")
add("p34_interact", lambda s, d: clean.interact(fr.panel(s, d).withColumn("flag", fn.in_period(c("month"), "1999-08-01")), ["n"], "flag"), f"WITH {PANEL} SELECT area, {DAY}, n, (month >= DATE '1999-08-01')::INT AS flag, n * (month >= DATE '1999-08-01')::INT AS n_x_flag FROM panel")
add("p35_pick_cols", lambda s, d: orders(s, d).select(*clean.pick_cols(orders(s, d), "key", ["order", "none"])), "SELECT o_orderkey FROM orders")

# --- joins ----------------------------------------------------------------------------------------------------------

_areas = "areas AS (SELECT s_suppkey AS area, s_nationkey AS ward FROM supplier)"
_ward = lambda s, d: fr.areas(s, d).select("area", "ward")
_counts = lambda s, d: agg.count_sparse(fr.incidents(s, d), ["area", "month"])
_old = lambda s, d: agg.count_sparse(fr.incidents(s, d), ["area"]).withColumnRenamed("area", "old")
add("j1_with_lookup", lambda s, d: joins.with_lookup(_old(s, d), fr.lookup(s, d).where("old % 4 <> 0"), "old"), f"WITH {INC}, {LOOKUP} SELECT area AS old, n, new FROM (SELECT area, count(*) AS n FROM inc GROUP BY area) LEFT JOIN (SELECT * FROM lookup WHERE old % 4 <> 0) ON old = area")
add("j2_require_match", lambda s, d: joins.require_match(_counts(s, d), _ward(s, d), "area"), f"WITH {INC}, {_areas} SELECT area, {DAY}, n, ward FROM (SELECT area, month, count(*) AS n FROM inc GROUP BY ALL) JOIN areas USING (area)")
add("j3_join_inner", lambda s, d: joins.join_inner(_old(s, d), fr.lookup(s, d), "old").select("old", "new", "n"), f"WITH {INC}, {LOOKUP} SELECT old, new, n FROM (SELECT area AS old, count(*) AS n FROM inc GROUP BY area) JOIN lookup USING (old)")
add("j4_attach_counts", fr.panel, f"WITH {PANEL} SELECT area, {DAY}, n FROM panel")
add("j5_attach_attrs", lambda s, d: joins.attach_attrs(fr.panel(s, d), fr.attrs_monthly(s, d)), f"WITH {PANEL}, {ATTRS} SELECT p.area, {DAY}, n, round(qty, 6) AS qty, parts FROM panel p LEFT JOIN attrs a ON a.area = p.area AND make_date(a.year, 1, 1) = p.month")
add("j6_keep_known", lambda s, d: joins.keep_known(orders(s, d).select(c("o_orderkey").alias("id"), "o_orderstatus"), fr.incidents(s, d), "id"), f"WITH {INC} SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT id FROM inc)")
add("j7_missing_keys", lambda s, d: joins.missing_keys(orders(s, d).select(c("o_orderkey").alias("id")), fr.incidents(s, d), "id"), f"WITH {INC}, m AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM inc)) SELECT count(*) AS n_missing, list_sort(list(id ORDER BY id)[:5]) AS sample FROM m")
add("j8_keep_in", lambda s, d: joins.keep_in(customer(s, d).select("c_custkey", "c_nationkey"), "c_nationkey", [1, 3]), "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 3)")
add("j9_lookup_code", lambda s, d: joins.lookup_code(customer(s, d).select("c_custkey", "c_nationkey"), "c_nationkey", t("nation")(s, d).where("n_nationkey % 5 <> 2").withColumnRenamed("n_name", "code"), "n_nationkey", "code"), "SELECT c_custkey, c_nationkey, n_name AS code FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 2")
add("j10_map_index", lambda s, d: joins.map_index(fr.areas(s, d).select("area"), panel.index_keys(fr.areas(s, d), "area"), "area"), f"WITH {_areas} SELECT area, dense_rank() OVER (ORDER BY area) - 1 AS idx FROM areas")
add("j12_panel_grid", lambda s, d: joins.panel_grid(fr.areas(s, d), fr.START, fr.END), f"WITH {_areas}, {MONTHS} SELECT area, {DAY} FROM areas CROSS JOIN months")


def _bands(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("one", "1996-03-01", "1997-02-01"), ("two", "1999-01-01", "1999-01-01")], "label string, start string, finish string").select("label", c("start").cast("date").alias("start"), c("finish").cast("date").alias("finish"))


add("j13_label_events", lambda s, d: joins.label_events(agg.monthly_total(fr.panel(s, d)), _bands(s)), f"WITH {PANEL} SELECT {DAY}, sum(n)::BIGINT AS total, CASE WHEN month BETWEEN DATE '1996-03-01' AND DATE '1997-02-01' THEN 'one' WHEN month = DATE '1999-01-01' THEN 'two' END AS label FROM panel GROUP BY panel.month")
add(
    "j14_compare",
    lambda s, d: joins.compare(_counts(s, d).where("month < '1999-01-01'").withColumnRenamed("n", "predicted"), _counts(s, d).where("month > '1997-12-01'").withColumnRenamed("n", "actual"), ["area", "month"]),
    f"WITH {INC}, k AS (SELECT area, month, count(*) AS n FROM inc GROUP BY ALL) SELECT coalesce(p.area, a.area) AS area, strftime(coalesce(p.month, a.month), '%Y-%m-%d') AS month, p.n AS predicted, a.n AS actual, p.n - a.n AS difference FROM (SELECT * FROM k WHERE month < DATE '1999-01-01') p FULL JOIN (SELECT * FROM k WHERE month > DATE '1997-12-01') a ON p.area = a.area AND p.month = a.month",
)

# --- aggregations ---------------------------------------------------------------------------------------------------

add("a1_count_sparse", _counts, f"WITH {INC} SELECT area, {DAY}, count(*) AS n FROM inc GROUP BY area, inc.month")
add("a2_count_dense", lambda s, d: agg.count_dense(fr.incidents(s, d), "area", "month", "id"), f"WITH {INC}, k AS (SELECT area, month, count(id) AS n FROM inc GROUP BY ALL) SELECT a.area, strftime(m.month, '%Y-%m-%d') AS month, coalesce(n, 0) AS n FROM (SELECT DISTINCT area FROM inc) a CROSS JOIN (SELECT DISTINCT month FROM inc) m LEFT JOIN k ON k.area = a.area AND k.month = m.month")
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_poi = lambda s, d: fr.incidents(s, d).join(part(s, d).select(c("p_partkey").alias("part"), c("p_type").alias("grp")), "part")
add("a3_count_pivot", lambda s, d: agg.count_pivot(_poi(s, d), "area", "grp", _TYPES), f"WITH {INC} SELECT area, {', '.join(f'''count(*) FILTER (p_type = '{x}') AS {x}''' for x in _TYPES)} FROM inc JOIN part ON p_partkey = part GROUP BY area")
add("a4_duplicate_keys", lambda s, d: agg.duplicate_keys(fr.lookup(s, d), ["new"]), f"WITH {LOOKUP} SELECT new, count(*) AS n FROM lookup GROUP BY new HAVING count(*) > 1")


def a5(s: SparkSession, d: str) -> DataFrame:
    rows = fr.lookup(s, d).join(fr.attrs(s, d), c("old") == c("area")).select("new", "year", "old", c("qty").alias("IMD_Rank"), c("parts").alias("food_locations"), c("parts").alias("incident_amount"), c("area").alias("name"))
    return agg.merge_areas(rows, ["new", "year"], "old")


add("a5_merge_areas", a5, f"WITH {LOOKUP}, {ATTRS} SELECT new, year, round(avg(qty), 6) AS \"IMD_Rank\", sum(parts)::BIGINT AS food_locations, sum(parts)::BIGINT AS incident_amount, min(area) AS name FROM lookup JOIN attrs ON old = area GROUP BY new, year")
add("a6_n_distinct", lambda s, d: agg.n_distinct(fr.incidents(s, d), "area", "month"), f"WITH {INC} SELECT count(DISTINCT area) AS n_area, count(DISTINCT month) AS n_month FROM inc")
add("a7_value_shares", lambda s, d: agg.value_shares(_gaps(s, d), "priority"), f"WITH {_GAPS} SELECT priority AS value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM gaps WHERE priority IS NOT NULL GROUP BY priority")
add("a8_missing_profile", lambda s, d: agg.missing_profile(_gaps(s, d), ["priority", "price"], ("priority", "price")), f"WITH {_GAPS} SELECT count(*) AS rows, count_if(priority IS NULL)::BIGINT AS missing_priority, round(avg((priority IS NULL)::INT) * 100, 6) AS pct_priority, count_if(price IS NULL)::BIGINT AS missing_price, round(avg((price IS NULL)::INT) * 100, 6) AS pct_price, count_if(priority IS NULL AND price IS NULL)::BIGINT AS both_missing, count_if((priority IS NULL) <> (price IS NULL))::BIGINT AS one_missing, count_if((priority IS NULL) <> (price IS NULL)) = 0 AS consistent FROM gaps")
add("a9_sentinel_audit", lambda s, d: agg.sentinel_audit(_gaps(s, d).withColumn("status", F.coalesce("priority", F.lit("none"))), "status", "none", ["price", "priority"]), f"WITH {_GAPS} SELECT count_if(priority IS NULL)::BIGINT AS n_sentinel, count_if(priority IS NULL AND price IS NOT NULL)::BIGINT AS with_price, 0::BIGINT AS with_priority FROM gaps")
add("a10_mismatch", lambda s, d: agg.mismatch(t("lineitem")(s, d), "l_linestatus", "l_returnflag"), "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus <> l_returnflag GROUP BY ALL")
add("a11_unmatched_share", lambda s, d: agg.unmatched_share(fr.incidents(s, d), fr.areas(s, d).where("area % 4 <> 0"), "area"), f"WITH {INC} SELECT round(avg((area % 4 = 0)::INT) * 100, 6) AS unmatched_pct FROM inc")
add("a12_by_year", lambda s, d: agg.by_year(fr.incidents(s, d)), f"WITH {INC} SELECT year(month)::INT AS year, count(*) AS n FROM inc GROUP BY ALL")
add("a12_by_month", lambda s, d: agg.by_month(fr.incidents(s, d)), f"WITH {INC} SELECT month(month)::INT AS month_of_year, count(*) AS n FROM inc GROUP BY ALL")
add("a13_by_parent", lambda s, d: agg.by_parent(fr.incidents(s, d), _ward(s, d), "area", "ward"), f"WITH {INC}, {_areas} SELECT ward, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM inc JOIN areas USING (area) GROUP BY ward")
add("a14_top_areas", lambda s, d: agg.top_areas(fr.panel(s, d), 10), f"WITH {PANEL} SELECT area, sum(n)::BIGINT AS total FROM panel GROUP BY area ORDER BY total DESC, area LIMIT 10")
add("a15_top_areas_in_year", lambda s, d: agg.top_areas_in_year(fr.panel(s, d), 10, 1999), f"WITH {PANEL}, top AS (SELECT area, sum(n) AS total FROM panel GROUP BY area ORDER BY total DESC, area LIMIT 10) SELECT area, sum(n)::BIGINT AS total FROM panel WHERE year(month) = 1999 AND area IN (SELECT area FROM top) GROUP BY area")
_sparse = lambda s, d: fr.panel(s, d).withColumn("v", F.when(c("n") > 2, c("n")))
_SPARSE = f"{PANEL}, sparse AS (SELECT area, month, n, CASE WHEN n > 2 THEN n END AS v FROM panel)"
add("a16_first_valid", lambda s, d: agg.first_valid(_sparse(s, d), "area", 1998, ["v"]), f"WITH {_SPARSE} SELECT area, arg_min(v, month) FILTER (v IS NOT NULL) AS v FROM sparse WHERE year(month) = 1998 GROUP BY area")
_monthly = lambda s, d: joins.attach_attrs(fr.panel(s, d), fr.attrs_monthly(s, d))
add("a17_empty_in_year", lambda s, d: agg.empty_in_year(_monthly(s, d), ["qty", "n"], 1997), "SELECT true AS qty, false AS n")
add("a18_split_static", lambda s, d: agg.split_static(_monthly(s, d).join(_ward(s, d), "area").withColumn("none", F.lit(None).cast("int")), "area", ["ward", "n", "none"]), "SELECT 'ward' AS \"column\", 'static' AS kind UNION ALL SELECT 'n', 'dynamic' UNION ALL SELECT 'none', 'neither'")
add("a20_monthly_total", lambda s, d: agg.monthly_total(fr.panel(s, d)), f"WITH {PANEL} SELECT {DAY}, sum(n)::BIGINT AS total FROM panel GROUP BY panel.month")
add("a21_zero_share", lambda s, d: agg.zero_share(fr.panel(s, d)), f"WITH {PANEL} SELECT {DAY}, round_even(avg((n = 0)::INT) * 100, 2) AS zero_share FROM panel GROUP BY panel.month")
add("a22_rollup_parent", lambda s, d: agg.rollup_parent(fr.panel(s, d), _ward(s, d), "area", "ward", "n"), f"WITH {PANEL} SELECT ward, sum(n)::BIGINT AS n FROM panel GROUP BY ward")
_num = lambda s, d: t("lineitem")(s, d).select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("a24_target_corr", lambda s, d: agg.target_corr(_num(s, d), _NUM[1:], "l_quantity"), " UNION ALL ".join(f"SELECT '{x}' AS \"column\", round(corr({x}, l_quantity), 6) AS r FROM lineitem" for x in _NUM[1:]))
add("a25_corr_matrix", lambda s, d: agg.corr_matrix(_num(s, d), _NUM), " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM lineitem" for i, a in enumerate(_NUM) for j, b in enumerate(_NUM)))
_WIDE = {"quantity_sq": "l_quantity * l_quantity", "charge": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice * (1 + l_tax)"}
add("a26_high_corr_pairs", lambda s, d: agg.high_corr_pairs(_num(s, d).withColumns({k: F.expr(v) for k, v in _WIDE.items()}), [*_NUM, *_WIDE], 0.9), "WITH w AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _WIDE.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM w) WHERE r > 0.9" for i, a in enumerate([*_NUM, *_WIDE]) for b in [*_NUM, *_WIDE][i + 1 :]))
add("a27_describe", lambda s, d: agg.describe(_num(s, d), _NUM[:2]), " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.75), 6) AS q3, max({x}) AS max FROM lineitem" for x in _NUM[:2]))
add("a28_extent", lambda s, d: agg.extent(fr.points(s, d)), f"WITH {fr.POINTS} SELECT round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM points")
add("a29_empty_share", lambda s, d: agg.empty_share(_point(s, d).select(c("p").alias("point"))), f"SELECT round(avg((x0 IS NULL)::INT) * 100, 6) AS empty_pct FROM ({_POINT})")
add("a30_scale_time", lambda s, d: agg.scale_time(fr.panel(s, d).withColumn("t", fn.month_index(c("month"), F.lit(fr.START).cast("date"))), "t").select("area", "month", "t", "t_s"), f"WITH {PANEL}, x AS (SELECT area, month, datediff('month', DATE '{fr.START}', month)::INT AS t FROM panel) SELECT area, {DAY}, t, round((t - avg(t) OVER ()) / stddev_samp(t) OVER (), 6) AS t_s FROM x")
add("a31_dedup", lambda s, d: agg.dedup(fr.incidents(s, d).select("area", "month", "part"), ["area", "month"], ["part"]), f"WITH {INC} SELECT area, {DAY}, min(part) AS part FROM inc GROUP BY area, inc.month")
add("a31_distinct", lambda s, d: agg.dedup(fr.incidents(s, d).select("area", "status")), f"WITH {INC} SELECT DISTINCT area, status FROM inc")

# --- reshape --------------------------------------------------------------------------------------------------------

_yearly = lambda s, d: fr.attrs(s, d).withColumn("label", F.concat(F.lit("qty|"), c("year")))
_YEARS = ["qty|1996", "qty|1998", "qty|2000", "qty|2003"]
_wider = lambda s, d: reshape.widen(_yearly(s, d), ["area"], "label", "qty", _YEARS)
_WIDER = ", ".join(f"round(min(qty) FILTER ('qty|' || year = '{y}'), 6) AS \"{y}\"" for y in _YEARS)
add("r2_widen", _wider, f"WITH {ATTRS} SELECT area, {_WIDER} FROM attrs GROUP BY area")
add("r1_melt", lambda s, d: reshape.melt(_wider(s, d), ["area"]), f"WITH {ATTRS}, w AS (SELECT area, {_WIDER} FROM attrs GROUP BY area), l AS (SELECT unnest({_YEARS!r}) AS label) SELECT area, label, CASE label {' '.join(f'''WHEN '{y}' THEN "{y}"''' for y in _YEARS)} END AS value FROM w CROSS JOIN l".replace('["', "['").replace('"]', "']"))
add("r3_composition", lambda s, d: reshape.composition(fr.attrs_monthly(s, d), 3, ["qty", "parts"]), f"WITH {ATTRS}, l AS (SELECT * FROM attrs WHERE area = 3 ORDER BY year DESC LIMIT 1) SELECT 'qty' AS label, round(qty, 6) AS value FROM l UNION ALL SELECT 'parts', parts::DOUBLE FROM l")
add("r4_last_row_fields", lambda s, d: reshape.last_row_fields(fr.attrs_monthly(s, d).select("area", "month", "parts")), f"WITH {ATTRS}, l AS (SELECT area, max(year) AS year, arg_max(parts, year) AS parts FROM attrs GROUP BY area) SELECT area, 'month' AS field, year || '-01-01' AS value FROM l UNION ALL SELECT area, 'parts', parts::VARCHAR FROM l")
add("r5_sort_by", lambda s, d: reshape.sort_by(_counts(s, d), "area", "month"), f"WITH {INC} SELECT area, {DAY}, count(*) AS n FROM inc GROUP BY area, inc.month")
add("r6_top_k", lambda s, d: reshape.top_k(_counts(s, d), "n", 25, "area", "month"), f"WITH {INC}, k AS (SELECT area, month, count(*) AS n FROM inc GROUP BY ALL) SELECT area, {DAY}, n FROM k ORDER BY n DESC, area, k.month LIMIT 25")
add("r7_month_labels", lambda s, d: reshape.month_labels(fr.incidents(s, d)), f"WITH {INC} SELECT DISTINCT {DAY}, strftime(inc.month, '%Y-%B') AS label FROM inc")

# --- functions ------------------------------------------------------------------------------------------------------

_m0 = lambda: F.lit(fr.START).cast("date")
add("f1_month_index", lambda s, d: fr.incidents(s, d).select("id", "part", fn.month_index(c("month"), _m0()).alias("t")), f"WITH {INC} SELECT id, part, datediff('month', DATE '{fr.START}', month)::INT AS t FROM inc")
add("f2_trend", lambda s, d: fr.panel(s, d).select("area", "month", F.log1p("n").alias("l"), F.pow("n", F.lit(2)).alias("sq"), fn.seasonal(c("month")).alias("season")), f"WITH {PANEL} SELECT area, {DAY}, round(ln(1 + n), 6) AS l, round(n * n::DOUBLE, 6) AS sq, round(sin(2 * pi() * month(panel.month) / 12), 6) + 0.0 AS season FROM panel")
add("f3_rate", lambda s, d: fr.areas(s, d).select("area", fn.rate_of(c("balance") / 1000).alias("rate")), "SELECT s_suppkey AS area, round(exp(greatest(-4, least(4, s_acctbal / 1000))), 6) AS rate FROM supplier")
add("f4_clamp", lambda s, d: fr.areas(s, d).select("area", fn.clamp(F.floor(F.sqrt(F.abs("balance"))), 10, 90).alias("v")), "SELECT s_suppkey AS area, least(90, greatest(10, floor(sqrt(abs(s_acctbal)))))::BIGINT AS v FROM supplier")
add("f5_arithmetic", lambda s, d: orders(s, d).select("o_orderkey", F.abs(c("o_totalprice") - 100000).alias("d"), (c("o_totalprice") / 70000).alias("r"), (c("o_totalprice") * 100 / 300000).alias("p")), "SELECT o_orderkey, round(abs(o_totalprice - 100000), 6) AS d, round(o_totalprice / 70000, 6) AS r, round(o_totalprice * 100 / 300000, 6) AS p FROM orders")
_z = lambda: c("balance") / 3000 - 1
_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))"
add("f6_normal", lambda s, d: fr.areas(s, d).select("area", stats.normal_pdf(_z()).alias("pdf"), stats.normal_cdf(_z()).alias("cdf")), f"WITH z AS (SELECT s_suppkey AS area, s_acctbal / 3000 - 1 AS z FROM supplier), e AS (SELECT area, z, z / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z / sqrt(2))) AS t FROM z) SELECT area, round(exp(-z * z / 2) / sqrt(2 * pi()), 6) AS pdf, round((1 + sign(x) * {_ERF}) / 2, 6) AS cdf FROM e")
add("f7_text", lambda s, d: part(s, d).select("p_partkey", F.regexp_replace("p_name", "[aeiou]", "").alias("a"), F.trim(F.lower(F.concat(F.lit(" "), "p_type"))).alias("b"), c("p_name").contains("ring").alias("c"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("d")), "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS a, lower(p_type) AS b, contains(p_name, 'ring') AS c, regexp_extract(p_brand, '(\\d+)', 1) AS d FROM part")
add("f8_dates", lambda s, d: orders(s, d).select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.add_months(F.trunc("o_orderdate", "MM"), 3).alias("later"), F.date_format("o_orderdate", "yyyy-MM").alias("label")), "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, '%Y-%m-%d') AS later, strftime(o_orderdate, '%Y-%m') AS label FROM orders")
add("f9_haversine", lambda s, d: fr.points(s, d).select("point", geo.haversine(c("x"), c("y") % 30 + 50, F.lit(0.0), F.lit(51.5)).alias("d")), f"WITH {fr.POINTS}, h AS (SELECT point, pow(sin((radians(51.5) - radians(y % 30 + 50)) / 2), 2) + cos(radians(y % 30 + 50)) * cos(radians(51.5)) * pow(sin(radians(0.0 - x) / 2), 2) AS h FROM points) SELECT point, round(2 * 6371000.0 * asin(sqrt(h)), 6) AS d FROM h")
add("f10_ring_measures", lambda s, d: fr.plots(s, d).select("area", geo.area(c("ring")).alias("size"), geo.perimeter(c("ring")).alias("length"), geo.centroid(c("ring"))["x"].alias("cx")), "SELECT s_suppkey AS area, 1.0::DOUBLE AS size, 4.0::DOUBLE AS length, s_suppkey % 5 + 0.5::DOUBLE AS cx FROM supplier")
add("f11_has_any", lambda s, d: orders(s, d).select("o_orderkey", fn.has_any(F.array("o_orderstatus", "o_orderpriority"), ["F", "1-URGENT"]).alias("has")), "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS has FROM orders")
