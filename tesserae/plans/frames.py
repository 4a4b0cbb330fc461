"""Stand-in frames over the driver tables, as DataFrames and as DuckDB common table expressions of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.aggregate import count_sparse
from tesserae.operators.clean import filter_eq
from tesserae.operators.joins import attach_counts, panel_grid
from tesserae.sources.tables import read_table

START, END = "1995-01-01", "2001-11-01"
Query = Callable[[SparkSession, str], DataFrame]


def finish(df: DataFrame) -> DataFrame:
    """Dates as text and doubles rounded to six places, so that any engine gives the same values."""
    kinds = {"date": lambda c: F.date_format(c, "yyyy-MM-dd"), "double": lambda c: F.round(c, 6) + F.lit(0.0), "float": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0)}
    return df.select(*(kinds[t](F.col(f"`{c}`")).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """id, area, month, part, qty, discount, status: the incident type is one return flag, filtered in the scan."""
    rows = filter_eq(read_table(spark, sf, "lineitem"), "l_returnflag", "R")
    return rows.select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("area"), F.trunc("l_shipdate", "MM").alias("month"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_linestatus").alias("status"),
    )


def areas(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("area"), F.col("s_nationkey").alias("ward"), F.col("s_acctbal").alias("balance"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """area, month, n: every area in every month."""
    counts = count_sparse(incidents(spark, sf), ["area", "month"])
    return attach_counts(panel_grid(areas(spark, sf), START, END), counts)


def attrs(spark: SparkSession, sf: str) -> DataFrame:
    """area, year, qty, price: even years only."""
    rows = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("area"), F.year("l_shipdate").alias("year"), "l_quantity", "l_partkey")
    return rows.where("year % 2 = 0").groupBy("area", "year").agg(F.sum("l_quantity").alias("qty"), F.count_distinct("l_partkey").alias("parts"))


def attrs_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return attrs(spark, sf).select("area", F.make_date("year", F.lit(1), F.lit(1)).alias("month"), "qty", "parts")


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    """old, new: areas below 50 merge in pairs, those that end in 9 split in two."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("old"))
    new = F.when(F.col("old") < 50, F.expr("old div 2")).otherwise(F.col("old"))
    return s.select("old", F.explode(F.when(F.col("old") % 10 == 9, F.array(new, new + 100000)).otherwise(F.array(new))).alias("new"))


def squares(spark: SparkSession, sf: str) -> DataFrame:
    """area (nation), ring: the wards' squares."""
    return _on_grid(read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("area")))


def plots(spark: SparkSession, sf: str) -> DataFrame:
    """area (supplier), ring: the areas' squares."""
    return _on_grid(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("area")))


def _on_grid(keys: DataFrame) -> DataFrame:
    """Unit squares on a grid five wide, as high as there are keys for."""
    x, y = (F.col("area") % 5).cast("double"), F.floor(F.col("area") / 5).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return keys.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """point (supplier), x, y: as dense as the plots, never on an edge of one."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point"))
    return s.withColumns({"x": (F.col("point") * 37 % 50) / 10 + 0.05, "y": F.floor(F.col("point") / 5) + (F.col("point") * 13 % 10) / 10 + 0.05})


#: X bounds of the blocks that cover the plots.
STRIPS = [0.0, 0.9, 1.9, 2.9, 3.9, 4.9, 5.0]


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """target, ring: six blocks for each two rows of plots, half a row lower, so that they cover all plots."""
    k = F.floor(F.col("s_suppkey") / 10)
    rows = read_table(spark, sf, "supplier").select(F.explode(F.array(k, k + 1)).alias("row")).distinct()
    bounds = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(zip(STRIPS, STRIPS[1:], strict=False)))))
    p = lambda x, up: F.struct(F.col(x).alias("x"), (F.col("row") * 2 + up).alias("y"))
    ring = F.array(p("s.lo", -0.5), p("s.hi", -0.5), p("s.hi", 1.5), p("s.lo", 1.5), p("s.lo", -0.5))
    return rows.select("row", bounds.alias("s")).select((F.col("row") * 10 + F.col("s.i")).alias("target"), ring.alias("ring"))


#: Targets that cover the same ground as the blocks, as disjoint boxes x0, y0, x1, y1 over two rows of plots: an L, a U,
#: two parts that fill them up, a frame and what stands in its hole. Kind, box, and 1 or -1 for a hole.
SHAPES = [
    (0, 0.0, 0.0, 0.6, 2.0, 1), (0, 0.6, 0.0, 1.8, 0.7, 1), (1, 1.8, 0.0, 2.2, 2.0, 1), (1, 2.2, 0.0, 3.2, 0.5, 1), (1, 3.2, 0.0, 3.6, 2.0, 1),
    (2, 0.6, 0.7, 1.8, 2.0, 1), (2, 2.2, 0.5, 3.2, 2.0, 1), (3, 3.6, 0.0, 5.0, 2.0, 1), (3, 4.0, 0.4, 4.6, 1.5, -1), (4, 4.0, 0.4, 4.6, 1.5, 1),
]
#: Their rings: kind, part, hole, corners.
SHAPE_RINGS = [
    (0, 0, False, [(0, 0), (1.8, 0), (1.8, 0.7), (0.6, 0.7), (0.6, 2), (0, 2)]),
    (1, 0, False, [(1.8, 0), (3.6, 0), (3.6, 2), (3.2, 2), (3.2, 0.5), (2.2, 0.5), (2.2, 2), (1.8, 2)]),
    (2, 0, False, [(0.6, 0.7), (0.6, 2), (1.8, 2), (1.8, 0.7)]),
    (2, 1, False, [(2.2, 0.5), (3.2, 0.5), (3.2, 2), (2.2, 2)]),
    (3, 0, False, [(3.6, 0), (5, 0), (5, 2), (3.6, 2)]),
    (3, 0, True, [(4, 0.4), (4.6, 0.4), (4.6, 1.5), (4, 1.5)]),
    (4, 0, False, [(4, 0.4), (4.6, 0.4), (4.6, 1.5), (4, 1.5)]),
]


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """target, rings: five targets for each two rows of plots, half a row lower: concave, in two parts, with a hole."""
    k = F.floor(F.col("s_suppkey") / 10)
    rows = read_table(spark, sf, "supplier").select(F.explode(F.array(k, k + 1)).alias("row")).distinct()
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), (F.col("row") * 2 - 0.5 + F.lit(float(y))).alias("y"))
    ring = lambda part, hole, corners: F.struct(F.lit(part).alias("part"), F.lit(hole).alias("hole"), F.array(*(point(*q) for q in [*corners, corners[0]])).alias("ring"))
    kinds = sorted({r[0] for r in SHAPE_RINGS})
    all_ = F.array(*(F.struct(F.lit(i).alias("kind"), F.array(*(ring(*r[1:]) for r in SHAPE_RINGS if r[0] == i)).alias("rings")) for i in kinds))
    return rows.withColumn("s", F.explode(all_)).select((F.col("row") * 10 + F.col("s.kind")).alias("target"), "s.rings")


def bricks(spark: SparkSession, sf: str) -> DataFrame:
    """area (supplier), ring: five bricks a row, every second row half a brick to the right, so corners lie on others' sides."""
    x = (F.col("area") % 5) + F.floor(F.col("area") / 5) % 2 * F.lit(0.5)
    y = F.floor(F.col("area") / 5).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    keys = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("area"))
    return keys.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))


def draws(spark: SparkSession, sf: str, n: int = 50) -> DataFrame:
    """area, month, draw, value: uniform draws of [0, 2 * rate], reproducible in any engine."""
    from tesserae.functions.stats import uniform

    rows = panel(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = uniform(F.col("area"), F.date_format("month", "yyyy-MM-dd"), F.col("draw"))
    return rows.select("area", "month", "draw", F.floor(u * 2 * F.greatest(F.col("n").cast("double"), F.lit(0.1)) + 0.5).alias("value"))


# Common table expressions.
INC = """inc AS (
    SELECT l_orderkey AS id, l_suppkey AS area, date_trunc('month', l_shipdate)::DATE AS month, l_partkey AS part,
           l_quantity AS qty, l_discount AS discount, l_linestatus AS status
    FROM lineitem WHERE l_returnflag = 'R')"""
MONTHS = f"months AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH))::DATE AS month)"
PANEL = f"""{INC}, {MONTHS}, panel AS (
    SELECT a.area, a.ward, m.month, coalesce(c.n, 0) AS n
    FROM (SELECT s_suppkey AS area, s_nationkey AS ward FROM supplier) a CROSS JOIN months m
    LEFT JOIN (SELECT area, month, count(*) AS n FROM inc GROUP BY ALL) c ON c.area = a.area AND c.month = m.month)"""
ATTRS = """attrs AS (
    SELECT l_suppkey AS area, year(l_shipdate)::INT AS year, sum(l_quantity) AS qty, count(DISTINCT l_partkey) AS parts
    FROM lineitem WHERE year(l_shipdate) % 2 = 0 GROUP BY ALL)"""
LOOKUP = """lookup AS (
    SELECT s_suppkey AS old, unnest(CASE WHEN s_suppkey % 10 = 9 THEN [CASE WHEN s_suppkey < 50 THEN s_suppkey // 2 ELSE s_suppkey END,
        CASE WHEN s_suppkey < 50 THEN s_suppkey // 2 ELSE s_suppkey END + 100000]
        ELSE [CASE WHEN s_suppkey < 50 THEN s_suppkey // 2 ELSE s_suppkey END] END) AS new
    FROM supplier)"""
SQUARES = "squares AS (SELECT n_nationkey AS area, (n_nationkey % 5)::DOUBLE AS x0, (n_nationkey // 5)::DOUBLE AS y0 FROM nation)"
TOUCH = "touch AS (SELECT a.area, b.area AS neighbour FROM squares a JOIN squares b ON a.area <> b.area AND abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1)"
POINTS = "points AS (SELECT s_suppkey AS point, (s_suppkey * 37 % 50) / 10 + 0.05 AS x, (s_suppkey // 5) + (s_suppkey * 13 % 10) / 10 + 0.05 AS y FROM supplier)"
PLOTS = "squares AS (SELECT s_suppkey AS area, (s_suppkey % 5)::DOUBLE AS x0, (s_suppkey // 5)::DOUBLE AS y0 FROM supplier)"
OVERLAY = f"""blocks AS (SELECT row * 10 + i AS target, lo, hi, row * 2 - 0.5 AS low, row * 2 + 1.5 AS high
    FROM (SELECT DISTINCT unnest([s_suppkey // 10, s_suppkey // 10 + 1]) AS row FROM supplier), (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(zip(STRIPS, STRIPS[1:], strict=False)))}) v(i, lo, hi)),
over AS (
    SELECT area, target, ((least(x0 + 1, hi) - greatest(x0, lo)) * (least(y0 + 1, high) - greatest(y0, low)))::DOUBLE AS overlap
    FROM squares JOIN blocks ON least(x0 + 1, hi) - greatest(x0, lo) > 1e-9 AND least(y0 + 1, high) - greatest(y0, low) > 1e-9)"""
SHAPES_SQL = f"""boxes AS (
    SELECT row * 10 + kind AS target, a AS x1, row * 2 - 0.5::DOUBLE + b AS y1, c AS x2, row * 2 - 0.5::DOUBLE + d AS y2, sign
    FROM (SELECT DISTINCT unnest([s_suppkey // 10, s_suppkey // 10 + 1]) AS row FROM supplier), (VALUES {', '.join(map(str, SHAPES))}) v(kind, a, b, c, d, sign)),
over AS (
    SELECT area, target, sum(sign * (least(x0 + 1, x2) - greatest(x0, x1)) * (least(y0 + 1, y2) - greatest(y0, y1)))::DOUBLE AS overlap
    FROM squares JOIN boxes ON x0 < x2 AND x1 < x0 + 1 AND y0 < y2 AND y1 < y0 + 1 GROUP BY area, target HAVING overlap > 1e-9)"""
BRICKS = """bricks AS (SELECT s_suppkey AS area, s_suppkey // 5 AS r, s_suppkey % 5 + (s_suppkey // 5) % 2 * 0.5::DOUBLE AS x0 FROM supplier),
beside AS (
    SELECT a.area, b.area AS neighbour, CASE WHEN a.r = b.r THEN 1.0::DOUBLE ELSE 1 - abs(a.x0 - b.x0) END AS length
    FROM bricks a JOIN bricks b ON (a.r = b.r AND abs(a.x0 - b.x0) = 1) OR (abs(a.r - b.r) = 1 AND abs(a.x0 - b.x0) <= 1))"""
DRAWS = f"""{PANEL}, draws AS (
    SELECT area, month, draw::INT AS draw,
           floor(('0x' || substr(md5(concat_ws('|', area, strftime(month, '%Y-%m-%d'), draw)), 1, 8))::BIGINT / 4294967296.0 * 2 * greatest(n, 0.1::DOUBLE) + 0.5)::BIGINT AS value
    FROM panel, range(1, 51) t(draw))"""
DAY = "strftime(month, '%Y-%m-%d') AS month"
