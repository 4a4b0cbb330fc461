"""Queries of the panel, of spatial joins and features, of evaluation on draws and of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import aggregate as agg
from tesserae.operators import evaluate as ev
from tesserae.operators import features as ft
from tesserae.operators import joins, model, panel, spatial
from tesserae.plans import frames as fr
from tesserae.plans.frames import ATTRS, BRICKS, DAY, DRAWS, INC, MONTHS, OVERLAY, PANEL, PLOTS, POINTS, SHAPES_SQL, SQUARES, TOUCH, Query
from tesserae.sources.shared import materialise
from tesserae.sources.tables import read_table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf, q=query: fr.finish(q(spark, sf))
    if sql:
        SQL[name] = sql


# --- windows and panel ----------------------------------------------------------------------------------------------

_OVER = "OVER (PARTITION BY area ORDER BY panel.month"
_roll = lambda k: f"CASE WHEN count(n) {_OVER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN round(avg(n) {_OVER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 6) END AS roll_{k}"
add("w1_lags", lambda s, d: panel.add_lags(fr.panel(s, d), [1, 2, 3, 12]), f"WITH {PANEL} SELECT area, {DAY}, n, {', '.join(f'lag(n, {k}) {_OVER}) AS lag_{k}' for k in (1, 2, 3, 12))} FROM panel")
add("w2_rolling", lambda s, d: panel.add_rolling(fr.panel(s, d), [3, 6, 12]), f"WITH {PANEL} SELECT area, {DAY}, n, {', '.join(map(_roll, (3, 6, 12)))} FROM panel")
_sparse = lambda s, d: fr.panel(s, d).withColumn("v", F.when(c("n") > 2, c("n")))
_SPARSE = f"{PANEL}, sparse AS (SELECT area, month, n, CASE WHEN n > 2 THEN n END AS v FROM panel)"
_FILL = "coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY area ORDER BY x.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY area ORDER BY x.month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
add("w3_fill_both", lambda s, d: panel.fill_both(_sparse(s, d), ["v"]), f"WITH {_SPARSE} SELECT area, {DAY}, n, {_FILL} AS v FROM sparse x")
_counts = lambda s, d: agg.count_sparse(fr.incidents(s, d), ["area", "month"])
_K = f"{INC}, k AS (SELECT area, month, count(*) AS n FROM inc GROUP BY ALL)"
add("w4_latest_per", lambda s, d: panel.latest_per(_counts(s, d)), f"WITH {_K} SELECT area, {DAY}, n FROM k QUALIFY row_number() OVER (PARTITION BY area ORDER BY k.month DESC) = 1")
add("w5_earliest_per", lambda s, d: panel.earliest_per(_counts(s, d)), f"WITH {_K} SELECT area, {DAY}, n FROM k QUALIFY row_number() OVER (PARTITION BY area ORDER BY k.month) = 1")
add("w6_group_mean", lambda s, d: panel.group_mean(fr.panel(s, d), "n"), f"WITH {PANEL} SELECT area, {DAY}, n, round(avg(n) OVER (PARTITION BY panel.month), 6) AS mean_n FROM panel")
add("w7_index_keys", lambda s, d: panel.index_keys(fr.incidents(s, d), "part"), f"WITH {INC} SELECT part, row_number() OVER (ORDER BY part) - 1 AS idx FROM (SELECT DISTINCT part FROM inc)")
_budget = lambda s, d: fr.areas(s, d).withColumn("sure", c("area") % 5 == 0)
add("w7_index_appearance", lambda s, d: panel.index_keys(read_table(s, d, "lineitem"), "l_partkey", order=F.expr("-l_orderkey * 10 + l_linenumber")), "SELECT l_partkey, row_number() OVER (ORDER BY min(-l_orderkey * 10 + l_linenumber), l_partkey) - 1 AS idx FROM lineitem GROUP BY l_partkey")
add("w8_budget_pick", lambda s, d: panel.budget_pick(_budget(s, d), 3, "ward", "sure", "balance", "area"), "SELECT s_suppkey AS area, s_nationkey AS ward, round(s_acctbal, 6) AS balance, s_suppkey % 5 = 0 AS sure FROM supplier QUALIFY s_suppkey % 5 = 0 OR row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 5 = 0) DESC, s_acctbal DESC, s_suppkey) <= 3")
add("n1_replicate", lambda s, d: panel.replicate(fr.areas(s, d).select("area"), "2015-01-01", "2019-01-01"), "SELECT s_suppkey AS area, strftime(m, '%Y-%m-%d') AS month FROM supplier, (SELECT unnest(generate_series(DATE '2015-01-01', DATE '2018-12-01', INTERVAL 1 MONTH)) AS m)")
_am = lambda s, d: fr.attrs_monthly(s, d)
_AM = f"{ATTRS}, am AS (SELECT area, make_date(year, 1, 1) AS month, round(qty, 6) AS qty, parts FROM attrs)"
add("n2_extend_forward", lambda s, d: panel.extend_forward(_am(s, d), "2002-06-01"), f"WITH {_AM}, last AS (SELECT * FROM am QUALIFY row_number() OVER (PARTITION BY area ORDER BY am.month DESC) = 1), u AS (SELECT * FROM am UNION ALL SELECT area, unnest(generate_series(last.month + INTERVAL 1 MONTH, DATE '2002-06-01', INTERVAL 1 MONTH))::DATE, qty, parts FROM last) SELECT area, strftime(u.month, '%Y-%m-%d') AS month, qty, parts FROM u")
add("n3_extend_backward", lambda s, d: panel.extend_backward(_am(s, d), "1994-06-01"), f"WITH {_AM}, first AS (SELECT * FROM am QUALIFY row_number() OVER (PARTITION BY area ORDER BY am.month) = 1), u AS (SELECT * FROM am UNION ALL SELECT area, unnest(generate_series(DATE '1994-06-01', first.month - INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE, qty, parts FROM first) SELECT area, strftime(u.month, '%Y-%m-%d') AS month, qty, parts FROM u")
add("n4_year_to_months", lambda s, d: panel.year_to_months(_am(s, d), 1998), f"WITH {_AM}, u AS (SELECT area, unnest(CASE WHEN year(am.month) <= 1998 THEN generate_series(am.month, am.month + INTERVAL 11 MONTH, INTERVAL 1 MONTH) ELSE [am.month::TIMESTAMP] END) AS month, qty, parts FROM am) SELECT area, {DAY}, qty, parts FROM u")
add(
    "n5_yearly_to_grid",
    lambda s, d: panel.yearly_to_grid(fr.attrs(s, d), fr.START, fr.END, ["parts"]).select("area", "month", "parts"),
    f"WITH {ATTRS}, {MONTHS}, g AS (SELECT a.area, m.month, t.parts AS v FROM (SELECT DISTINCT area FROM attrs) a CROSS JOIN months m LEFT JOIN attrs t ON t.area = a.area AND t.year = year(m.month)) SELECT area, {DAY}, {_FILL} AS parts FROM g x",
)
_half = lambda s, d: fr.panel(s, d).withColumn("v", F.when(F.year("month") != 1999, c("n")))
add("n6_populate_from", lambda s, d: panel.populate_from(_half(s, d), ["v"], 1998, 1999), f"WITH {PANEL}, b AS (SELECT area, arg_min(n, panel.month) AS base FROM panel WHERE year(panel.month) = 1998 GROUP BY area) SELECT area, {DAY}, n, CASE WHEN year(panel.month) = 1999 THEN base ELSE n END AS v FROM panel JOIN b USING (area)")
add("n7_missing_months", lambda s, d: panel.missing_months(_counts(s, d), fr.START, fr.END).select("area", "n_missing", F.transform("months", lambda m: F.date_format(m, "yyyy-MM-dd")).alias("months")), f"WITH {_K}, {MONTHS} SELECT area, count(*) AS n_missing, list(strftime(m.month, '%Y-%m-%d') ORDER BY m.month) AS months FROM (SELECT DISTINCT area FROM k) a CROSS JOIN months m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.area = a.area AND k.month = m.month) GROUP BY area")
add(
    "n8_complete_panel",
    lambda s, d: panel.complete_panel(_counts(s, d).withColumn("v", c("n")), fr.START, fr.END, ["v"], "n"),
    f"WITH {_K}, {MONTHS}, g AS (SELECT a.area, m.month, k.n, k.n AS v FROM (SELECT DISTINCT area FROM k) a CROSS JOIN months m LEFT JOIN k ON k.area = a.area AND k.month = m.month) SELECT area, {DAY}, coalesce(n, 0) AS n, {_FILL} AS v FROM g x",
)
add("n9_stack", lambda s, d: panel.stack([_counts(s, d).where("month < '1996-01-01'"), fr.areas(s, d).select("area", "ward")]), f"WITH {_K} SELECT area, {DAY}, n, NULL::INT AS ward FROM k WHERE k.month < DATE '1996-01-01' UNION ALL SELECT s_suppkey, NULL, NULL, s_nationkey FROM supplier")

# --- space ----------------------------------------------------------------------------------------------------------

_edges = lambda s, d: spatial.adjacency(fr.squares(s, d))
_wards = lambda s, d: fr.panel(s, d).join(fr.areas(s, d).select("area", "ward"), "area").groupBy(c("ward").alias("area"), "month").agg(F.sum("n").alias("n"))
_WARDS = f"{PANEL}, {SQUARES}, {TOUCH}, wards AS (SELECT ward AS area, month, sum(n)::BIGINT AS n FROM panel GROUP BY ward, month)"
_plot_edges = lambda s, d: spatial.adjacency(fr.plots(s, d))
_over = lambda s, d: spatial.overlay(fr.plots(s, d), fr.blocks(s, d))
add("j11_neighbour_join", lambda s, d: joins.neighbour_join(_wards(s, d), _edges(s, d), "n"), f"WITH {_WARDS} SELECT t.area, neighbour, {DAY}, n AS neighbour_n FROM touch t JOIN wards w ON w.area = neighbour")
add("j15_pip_join", lambda s, d: spatial.pip_join(fr.points(s, d), fr.plots(s, d)), f"WITH {POINTS} SELECT point, round(x, 6) AS x, round(y, 6) AS y, s_suppkey AS area FROM points JOIN supplier ON s_suppkey = floor(x) + 5 * floor(y) AND x < 5")
add("j16_intersects_join", lambda s, d: spatial.intersects_join(fr.plots(s, d), fr.blocks(s, d)), f"WITH {PLOTS}, {OVERLAY} SELECT area, target FROM over")
add("j17_overlay", _over, f"WITH {PLOTS}, {OVERLAY} SELECT area, target, round(overlap, 6) AS overlap, round(overlap, 6) AS weight FROM over")
_shaped = lambda s, d: spatial.overlay(fr.plots(s, d), fr.shapes(s, d))
_totals = lambda s, d: fr.panel(s, d).groupBy("area").agg(F.sum("n").alias("n"))
_ROLLED = "SELECT target, round_even(round(sum(n * round(overlap, 9)), 6), 0)::BIGINT AS n FROM over JOIN (SELECT area, sum(n) AS n FROM panel GROUP BY area) USING (area) GROUP BY target"
add("j15_pip_join_parts", lambda s, d: spatial.pip_join(fr.points(s, d), fr.shapes(s, d).withColumnRenamed("target", "area")).select("point", "area"), f"WITH {POINTS}, {PLOTS}, {SHAPES_SQL} SELECT point, target AS area FROM points JOIN boxes ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY ALL HAVING sum(sign) = 1")
add("j15_pip_join_near", lambda s, d: spatial.pip_join(fr.points(s, d), fr.plots(s, d), tolerance=0.1).select("point", "area"), f"WITH {POINTS}, {PLOTS} SELECT point, area FROM points JOIN squares ON x BETWEEN x0 - 0.1 AND x0 + 1.1 AND y BETWEEN y0 - 0.1 AND y0 + 1.1 WHERE greatest(x0 - x, x - x0 - 1, 0) ** 2 + greatest(y0 - y, y - y0 - 1, 0) ** 2 <= 0.01")
add("j16_intersects_shapes", lambda s, d: spatial.intersects_join(fr.plots(s, d), fr.shapes(s, d)), f"WITH {PLOTS}, {SHAPES_SQL} SELECT area, target FROM over")
add("j17_overlay_shapes", _shaped, f"WITH {PLOTS}, {SHAPES_SQL} SELECT area, target, round(overlap, 6) AS overlap, round(overlap, 6) AS weight FROM over")
add("j17_overlay_of_shapes", lambda s, d: spatial.overlay(fr.shapes(s, d).withColumnRenamed("target", "area"), fr.plots(s, d).withColumnRenamed("area", "target")), f"WITH {PLOTS}, {SHAPES_SQL}, size AS (SELECT target, sum(sign * (x2 - x1) * (y2 - y1)) AS size FROM boxes GROUP BY target) SELECT target AS area, area AS target, round(overlap, 6) AS overlap, round(overlap / size, 6) AS weight FROM over JOIN size USING (target)")
add("a23_rollup_shapes", lambda s, d: agg.rollup_weighted(_totals(s, d), _shaped(s, d), "area", "target", "n"), f"WITH {PANEL}, {PLOTS}, {SHAPES_SQL} {_ROLLED}")
add("g1_area_shapes", lambda s, d: spatial.with_area(fr.shapes(s, d)).select("target", "size"), f"WITH {PLOTS}, {SHAPES_SQL} SELECT target, round(sum(sign * (x2 - x1) * (y2 - y1)), 6)::DOUBLE AS size FROM boxes GROUP BY target")
add("g5_majority_shapes", lambda s, d: spatial.majority_filter(_shaped(s, d), 0.3).select("area", "target"), f"WITH {PLOTS}, {SHAPES_SQL} SELECT area, target FROM over WHERE round(overlap, 9) > 0.3")
add("g5_majority_shapes_ward", lambda s, d: spatial.majority_filter(_shaped(s, d), 0.1, "ward").select("area", "target"), f"WITH {PLOTS}, {SHAPES_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY target) AS k, count_if(round(overlap, 9) >= 0.1) OVER (PARTITION BY target) AS p FROM over) SELECT area, target FROM w WHERE round(overlap, 9) >= 0.1 OR k = 1 OR p = 0")
_bricks = lambda s, d: spatial.adjacency(fr.bricks(s, d), size=1.0)
add("j18_adjacency_sides", _bricks, f"WITH {BRICKS} SELECT area, neighbour FROM beside")
add("g2_neighbour_count_sides", lambda s, d: spatial.neighbour_count(fr.bricks(s, d), _bricks(s, d)), f"WITH {BRICKS} SELECT bricks.area, count(neighbour) AS neighbours FROM bricks LEFT JOIN beside ON beside.area = bricks.area GROUP BY bricks.area")
add("g3_shared_length_sides", lambda s, d: spatial.shared_length(fr.bricks(s, d), size=1.0), f"WITH {BRICKS} SELECT bricks.area, coalesce(sum(length), 0)::DOUBLE AS shared_length FROM bricks LEFT JOIN beside ON beside.area = bricks.area GROUP BY bricks.area")
add("j18_adjacency", _plot_edges, f"WITH {PLOTS}, {TOUCH} SELECT area, neighbour FROM touch")
_nodes = lambda s, d: fr.points(s, d).where("point % 3 = 0").select(c("point").alias("node"), "x", "y")
_NEAR = f"WITH {POINTS}, p AS (SELECT * FROM points WHERE point % 3 <> 0), x AS (SELECT p.point, n.point AS node, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) AS distance FROM p, points n WHERE n.point % 3 = 0) SELECT point, arg_min(node, (round(distance, 9), node)) AS node, round(min(distance), 6) AS distance FROM x GROUP BY point"
_near = lambda s, d: spatial.nearest(fr.points(s, d).where("point % 3 <> 0"), _nodes(s, d).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)}))
add("j19_nearest", lambda s, d: _near(s, d).select("point", "distance"), f"SELECT point, distance FROM ({_NEAR})")
add("a19_neighbour_stats", lambda s, d: agg.neighbour_stats(joins.neighbour_join(_wards(s, d), _edges(s, d), "n"), "neighbour_n"), f"WITH {_WARDS} SELECT t.area, strftime(w.month, '%Y-%m-%d') AS month, sum(n)::BIGINT AS neighbour_sum, round(avg(n), 6) AS neighbour_mean, quantile_cont(n, 0.5)::DOUBLE AS neighbour_median FROM touch t JOIN wards w ON w.area = neighbour GROUP BY t.area, w.month")
add("a23_rollup_weighted", lambda s, d: agg.rollup_weighted(_totals(s, d), _over(s, d), "area", "target", "n"), f"WITH {PANEL}, {PLOTS}, {OVERLAY} {_ROLLED}")
add("g1_with_area", lambda s, d: spatial.with_area(fr.plots(s, d)).select("area", "size"), "SELECT s_suppkey AS area, 1.0::DOUBLE AS size FROM supplier")
add("g2_neighbour_count", lambda s, d: spatial.neighbour_count(fr.plots(s, d), _plot_edges(s, d)), f"WITH {PLOTS}, {TOUCH} SELECT area, count(*) AS neighbours FROM touch GROUP BY area")
add("g3_shared_length", lambda s, d: spatial.shared_length(fr.plots(s, d)), f"WITH {PLOTS} SELECT a.area, count(*)::DOUBLE AS shared_length FROM squares a JOIN squares b ON abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 1 GROUP BY a.area")
add("g4_neighbour_edges", _plot_edges, f"WITH {PLOTS}, {TOUCH} SELECT area, neighbour FROM touch")
add("g5_majority_borough", lambda s, d: spatial.majority_filter(_over(s, d), 0.5).select("area", "target"), f"WITH {PLOTS}, {OVERLAY} SELECT area, target FROM over WHERE overlap > 0.5")
add("g5_majority_ward", lambda s, d: spatial.majority_filter(_over(s, d), 0.8, "ward").select("area", "target"), f"WITH {PLOTS}, {OVERLAY}, w AS (SELECT *, count(*) OVER (PARTITION BY target) AS k, count_if(overlap >= 0.8) OVER (PARTITION BY target) AS p FROM over) SELECT area, target FROM w WHERE overlap >= 0.8 OR k = 1 OR p = 0")
_sized = lambda s, d: fr.squares(s, d).join(_wards(s, d).groupBy("area").agg((F.sum("n") % 4 + 1).alias("k")), "area")
add(
    "g6_sample_points",
    lambda s, d: spatial.sample_points(_sized(s, d), c("k")),
    f"""WITH {_WARDS}, k AS (SELECT area, (sum(n) % 4 + 1)::INT AS k FROM wards GROUP BY area)
        SELECT k.area, i::INT AS point_no,
               round(x0 + ('0x' || substr(md5(concat_ws('|', k.area, 0, i, 'x')), 1, 8))::BIGINT / 4294967296.0, 6) AS x,
               round(y0 + ('0x' || substr(md5(concat_ws('|', k.area, 0, i, 'y')), 1, 8))::BIGINT / 4294967296.0, 6) AS y
        FROM k JOIN squares USING (area), range(1, 5) t(i) WHERE i <= k.k""",
)
add(
    "g7_neighbour_lags",
    lambda s, d: spatial.add_neighbour_lags(_wards(s, d), _edges(s, d)),
    f"""WITH {_WARDS}, x AS (SELECT t.area, w.month + INTERVAL 1 MONTH AS month, sum(n)::DOUBLE AS s, quantile_cont(n, 0.5)::DOUBLE AS m FROM touch t JOIN wards w ON w.area = neighbour GROUP BY t.area, w.month)
        SELECT w.area, strftime(w.month, '%Y-%m-%d') AS month, n, coalesce(s, 0) AS neighbour_sum, coalesce(m, 0) AS neighbour_median FROM wards w LEFT JOIN x ON x.area = w.area AND x.month = w.month""",
)
add("g8_snap", lambda s, d: _near(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total")), f"SELECT count(*) AS n, round(sum(distance), 6) AS total FROM ({_NEAR.replace('round(min(distance), 6)', 'min(distance)')})")

# --- draws ----------------------------------------------------------------------------------------------------------

_obs = fr.panel
_CELLS = f"{DRAWS}, q AS (SELECT area, month, avg(value) AS mean, quantile_disc(value, 0.5) AS median, stddev_samp(value) AS sd FROM draws GROUP BY area, month)"
add("e1_draws_wide", lambda s, d: ev.draws_wide(fr.draws(s, d, 10)), f"WITH {DRAWS} SELECT area, {DAY}, list(value ORDER BY draw) AS draws FROM draws WHERE draw <= 10 GROUP BY area, draws.month")
add("e2_post_mean", lambda s, d: ev.post_mean(fr.draws(s, d)), f"WITH {_CELLS} SELECT area, {DAY}, round(mean, 6) AS mean FROM q")
add("e3_post_median", lambda s, d: ev.post_median(fr.draws(s, d)), f"WITH {_CELLS} SELECT area, {DAY}, median::DOUBLE AS median FROM q")
add("e4_post_interval", lambda s, d: ev.post_interval(fr.draws(s, d)), f"WITH {DRAWS} SELECT area, {DAY}, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM draws GROUP BY area, draws.month")
add("e5_rmse", lambda s, d: ev.rmse(fr.draws(s, d), _obs(s, d)), f"WITH {_CELLS} SELECT round(sqrt(avg((median - n) ** 2)), 6) AS rmse FROM q JOIN panel p ON p.area = q.area AND p.month = q.month")
add("e6_mae", lambda s, d: ev.mae(fr.draws(s, d), _obs(s, d)), f"WITH {_CELLS} SELECT round(avg(abs(median - n)), 6) AS mae FROM q JOIN panel p ON p.area = q.area AND p.month = q.month")
_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))"
_CRPS = f"""WITH {_CELLS}, z AS (SELECT greatest(sd, 1e-6) AS s, (y - mean) / greatest(sd, 1e-6) AS z FROM (SELECT q.*, Y AS y FROM q JOIN panel p ON p.area = q.area AND p.month = q.month)),
    e AS (SELECT s, z, z / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z / sqrt(2))) AS t FROM z)
    SELECT round(avg(s * (z * sign(x) * {_ERF} + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps FROM e"""
add("e7_crps", lambda s, d: ev.crps(fr.draws(s, d), _obs(s, d)), _CRPS.replace("Y AS y", "n AS y"))
add("e7_crps_median", lambda s, d: ev.crps(fr.draws(s, d), _obs(s, d), "median"), _CRPS.replace("Y AS y", "median AS y"))
_ALPHAS = ", ".join(f"({round(0.05 * i, 2)})" for i in range(1, 20))
add(
    "e8_coverage_curve",
    lambda s, d: ev.coverage_curve(fr.draws(s, d), _obs(s, d)),
    f"""WITH {DRAWS}, v AS (SELECT area, month, list_sort(list(value)) AS v FROM draws GROUP BY area, month), a(alpha) AS (VALUES {_ALPHAS}),
        b AS (SELECT v.area, v.month, alpha::DOUBLE AS alpha, v, alpha::DOUBLE / 2 * (len(v) - 1) AS lo, (1 - alpha::DOUBLE / 2) * (len(v) - 1) AS hi FROM v, a),
        i AS (SELECT area, month, alpha, v[floor(lo)::INT + 1] + (lo - floor(lo)) * (v[ceil(lo)::INT + 1] - v[floor(lo)::INT + 1]) AS low,
                     v[floor(hi)::INT + 1] + (hi - floor(hi)) * (v[ceil(hi)::INT + 1] - v[floor(hi)::INT + 1]) AS high FROM b)
        SELECT alpha, round(avg((n BETWEEN low AND high)::INT) * 100, 6) AS coverage, round(avg(high - low), 6) AS width FROM i JOIN panel p ON p.area = i.area AND p.month = i.month GROUP BY alpha""",
)
add("e9_worst", lambda s, d: ev.worst(fr.draws(s, d), _obs(s, d), 10), f"WITH {_CELLS} SELECT q.area, strftime(q.month, '%Y-%m-%d') AS month, median::DOUBLE AS median, n, (median - n)::DOUBLE AS difference FROM q JOIN panel p ON p.area = q.area AND p.month = q.month ORDER BY median - n DESC, q.area, q.month LIMIT 10")
add("e10_interval_table", lambda s, d: ev.interval_table(ev.post_interval(fr.draws(s, d)).join(ev.post_mean(fr.draws(s, d)), ["area", "month"])).select("area", "month", "error_low", "error_high", "contains_zero"), f"WITH {DRAWS}, x AS (SELECT area, month, avg(value) AS mean, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM draws GROUP BY area, month) SELECT area, {DAY}, round(mean - low, 6) AS error_low, round(high - mean, 6) AS error_high, low <= 0 AND high >= 0 AS contains_zero FROM x")
add("e11_median_counts", lambda s, d: ev.median_counts(fr.draws(s, d)), f"WITH {_CELLS} SELECT median::DOUBLE AS value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM q GROUP BY median")

# --- models: wards are the areas, so that the squares give neighbours ---------------------------------------------------


def _features(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[str]]]:
    counts = materialise(_wards(s, d), "ward-months")  # read by each step of the build, which would otherwise count the incidents again
    rows = counts.withColumn("region", (c("area") % 5).cast("double")).withColumn("orders", ((c("area") * 31 + F.month("month") * 7 + F.year("month")) % 100).cast("double"))
    return ft.build_features(rows, fr.squares(s, d), _edges(s, d), ["region"], ["orders"])


_CROSSED = ["orders", *(f"lag_{k}" for k in (1, 2, 3, 12)), *(f"roll_{k}" for k in (3, 6, 12)), "neighbour_sum", "neighbour_median"]
_ALONE = ["region", "size", "neighbours", "season", "t_s", "t_log", "t_sq"]
_BY_AREA = "OVER (PARTITION BY area ORDER BY month"
_FEATURES = f"""{_WARDS},
    t0 AS (SELECT w.*, datediff('month', min(month) OVER (), month)::DOUBLE AS t FROM wards w),
    t1 AS (SELECT t0.*, coalesce((t - avg(t) OVER ()) / nullif(stddev_samp(t) OVER (), 0), 0) AS t_s FROM t0),
    before AS (SELECT e.area, w.month + INTERVAL 1 MONTH AS month, sum(n)::DOUBLE AS s, quantile_cont(n, 0.5)::DOUBLE AS m FROM touch e JOIN wards w ON w.area = e.neighbour GROUP BY e.area, w.month),
    own AS (
        SELECT area, month, n, (area % 5)::DOUBLE AS region, ((area * 31 + month(month) * 7 + year(month)) % 100)::DOUBLE AS orders, 1.0::DOUBLE AS size,
               sin(2 * pi() * month(month) / 12) AS season, t_s, ln(1 + t) AS t_log, t_s * t_s AS t_sq,
               (month BETWEEN DATE '1998-03-01' AND DATE '1999-07-01')::INT AS during, (month >= DATE '1999-08-01')::INT AS after,
               {', '.join(f'lag(n, {k}) {_BY_AREA}) AS lag_{k}' for k in (1, 2, 3, 12))},
               {', '.join(f'CASE WHEN count(n) {_BY_AREA} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN avg(n) {_BY_AREA} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS roll_{k}' for k in (3, 6, 12))}
        FROM t1),
    degree AS (SELECT area, count(*) AS neighbours FROM touch GROUP BY area),
    joined AS (
        SELECT o.*, neighbours, coalesce(s, 0) AS neighbour_sum, coalesce(m, 0) AS neighbour_median
        FROM own o JOIN degree d ON d.area = o.area LEFT JOIN before b ON b.area = o.area AND b.month = o.month),
    features AS (
        SELECT area, month, n, {', '.join(_ALONE + _CROSSED)}, {', '.join(f'{x} * {p} AS {x}_x_{p}' for p in ('during', 'after') for x in _CROSSED)}
        FROM joined WHERE lag_12 IS NOT NULL AND roll_12 IS NOT NULL)"""
_WIDE_COLS = [*_ALONE, *_CROSSED, *(f"{x}_x_{p}" for p in ("during", "after") for x in _CROSSED)]
_GROUP_OF = {**dict.fromkeys(("region", "size", "neighbours"), "static"), "season": "seasonal", **dict.fromkeys(("t_s", "t_log", "t_sq"), "time_trend")}


def _group_of(col: str) -> str:
    base = col.split("_x_")[0]
    return _GROUP_OF.get(base) or ("dynamic" if base == "orders" else "spatial" if base.startswith("neighbour") else "temporal")


SMALL = ["season", "t_s", "lag_1", "roll_3", "neighbour_sum"]


def m2(s: SparkSession, d: str) -> DataFrame:
    df, groups = _features(s, d)
    return model.as_array(df, ft.select_groups(df, groups)).select("area", "month", "n", F.size("x").alias("width"))


def m3(s: SparkSession, d: str) -> DataFrame:
    train, test = ft.split_last(fr.panel(s, d))
    return ft.apply_scaler(test, ft.fit_scaler(train, ["n"]))


def m4(s: SparkSession, d: str) -> DataFrame:
    return ft.ward_map(fr.panel(s, d).join(fr.areas(s, d).select("area", "ward"), "area"))


def m7(s: SparkSession, d: str) -> DataFrame:
    out = [
        a.agg(F.count(F.lit(1)).alias("train"), F.max("month").alias("last")).crossJoin(b.agg(F.count(F.lit(1)).alias("test"), F.min("month").alias("month")))  # one row each
        for a, b in ft.rolling_splits(fr.panel(s, d), 3)
    ]
    return panel.stack(out)


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Rows to learn from, the last three months, and the groups. The frame is written once, so no fit runs its feature plan again."""
    df, groups = _features(s, d)
    train, test = ft.split_last_n(materialise(df, "features"), 3)
    return train, test, groups


def _fitted(s: SparkSession, d: str, cols: list[str] = SMALL):
    train, test, groups = _split(s, d)
    return train, test, groups, model.fit_rate(train, cols, 0.01)


def _areas_of(df: DataFrame) -> DataFrame:
    """area, ward: five wards of the panel's areas."""
    return df.select("area", (c("area") % 5).alias("ward")).distinct()


def m8(s: SparkSession, d: str) -> DataFrame:
    fit = _fitted(s, d)[3]
    return s.createDataFrame([("intercept", fit.intercept), *zip(fit.cols, fit.coefficients, strict=True)], "column string, b double")


def m9(s: SparkSession, d: str) -> DataFrame:
    rows = fr.panel(s, d).join(fr.areas(s, d).select("area", "ward"), "area")
    mean = rows.agg(F.avg("n").alias("mu"))
    return model.pooled_effects(rows.crossJoin(mean))  # one row


def m10(s: SparkSession, d: str) -> DataFrame:
    train, test, _, fit = _fitted(s, d)
    return model.predict_rate(test, fit).select("area", "month", "n", "rate")


def m11(s: SparkSession, d: str) -> DataFrame:
    return model.draw_counts(fr.panel(s, d).withColumn("rate", F.greatest(c("n").cast("double"), F.lit(0.1))), 20)


def m11_predictive(s: SparkSession, d: str) -> DataFrame:
    train, test, _, fit = _fitted(s, d)
    effects = model.pooled_effects(model.predict_rate(train, fit).withColumnRenamed("rate", "mu").withColumn("ward", c("area") % 5))
    return model.predictive_draws(test, fit, 20, effects)


def m12(s: SparkSession, d: str) -> DataFrame:
    _, _, groups, fit = _fitted(s, d)
    return model.coef_summary(s, fit, groups)


def m9_joint(s: SparkSession, d: str) -> DataFrame:
    train, _, _ = _split(s, d)
    fit, effects = model.fit_joint(train, SMALL, _areas_of(train), 0.01)
    out = s.createDataFrame([("intercept", fit.intercept), *zip(fit.cols, fit.coefficients, strict=True)], "name string, b double")
    return out.unionByName(effects.select(F.concat(F.lit("area "), "area").alias("name"), F.log("effect").alias("b")))


def m14(s: SparkSession, d: str) -> DataFrame:
    train, test, groups = _split(s, d)
    return model.grid_search(train, test, ft.select_groups(train, groups), [0.0, 0.001, 0.01, 0.1, 1.0], ["log", "sqrt"])


def m15(s: SparkSession, d: str) -> DataFrame:
    df = materialise(_features(s, d)[0], "features")
    return model.cross_validate(df, SMALL, 12, wards=_areas_of(df))


def m16(s: SparkSession, d: str) -> DataFrame:
    train, test, _ = _split(s, d)
    return model.train_eval(train, test, SMALL, wards=_areas_of(train))


def m17(s: SparkSession, d: str) -> DataFrame:
    train, test, groups = _split(s, d)
    return model.select_forward(train, test, ft.select_groups(train, groups), 5)


def m18(s: SparkSession, d: str) -> DataFrame:
    df, groups = _features(s, d)
    return model.select_by_corr(df, groups, 6)


def m19(s: SparkSession, d: str) -> DataFrame:
    train, _, groups = _split(s, d)
    return model.select_projection(train, ft.select_groups(train, groups), 5)


def m20(s: SparkSession, d: str) -> DataFrame:
    df, groups = _features(s, d)
    out, kept = model.filter_and_interact(df, {g: groups[g] for g in ("temporal", "spatial")}, 0.05, "season")
    cols = [x for own in kept.values() for x in own]
    return out.select("area", "month", *(c(x).cast("double").alias(x) for x in cols)).unpivot(["area", "month"], cols, "column", "value")


_MS = f"{PANEL}, cut AS (SELECT max(month) AS last FROM panel)"
add(
    "m1_build_features",
    lambda s, d: _features(s, d)[0],
    f"WITH {_FEATURES} SELECT area, {DAY}, n, {', '.join(f'round({x}, 6) AS {x}' for x in _WIDE_COLS)} FROM features",
)
add("m2_select_groups", m2, f"WITH {_FEATURES} SELECT area, {DAY}, n, {len(_WIDE_COLS)}::INT AS width FROM features")
add("m3_scaler", m3, f"WITH {_MS}, t AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM panel, cut WHERE panel.month < last) SELECT area, {DAY}, round((n - m) / s, 6) AS n FROM panel, cut, t WHERE panel.month = last")
add("m4_ward_map", m4, "SELECT s_suppkey AS area, s_nationkey AS ward FROM supplier")
add("m5_split_last", lambda s, d: ft.split_last(fr.panel(s, d))[1], f"WITH {_MS} SELECT area, {DAY}, n FROM panel, cut WHERE panel.month = last")
add("m6_split_last_n", lambda s, d: ft.split_last_n(fr.panel(s, d), 4)[1], f"WITH {_MS} SELECT area, {DAY}, n FROM panel, cut WHERE panel.month > last - INTERVAL 4 MONTH")
add("m7_rolling_splits", m7, f"WITH {PANEL}, k(m) AS (VALUES (DATE '2001-09-01'), (DATE '2001-10-01'), (DATE '2001-11-01')) SELECT count(*) FILTER (panel.month < m) AS train, strftime(max(panel.month) FILTER (panel.month < m), '%Y-%m-%d') AS last, count(*) FILTER (panel.month = m) AS test, strftime(m, '%Y-%m-%d') AS month FROM panel, k GROUP BY m")
add("m8_fit_rate", m8)
_K = "CASE WHEN sum((Y - M) ** 2 - M) > 0 THEN least(1e6, sum(M * M) / sum((Y - M) ** 2 - M)) ELSE 1e6 END"
add(
    "m9_pooled_effects",
    m9,
    f"""WITH {PANEL}, a AS (SELECT area, ward, sum(n)::DOUBLE AS y, count(*) * (SELECT avg(n) FROM panel) AS mu FROM panel GROUP BY ALL),
        w AS (SELECT ward, sum(y) AS wy, sum(mu) AS wmu FROM a GROUP BY ward), k AS (SELECT {_K.replace('Y', 'wy').replace('M', 'wmu')} AS k FROM w),
        e AS (SELECT ward, wy, wmu, (wy + k) / (wmu + k) AS e FROM w, k), i AS (SELECT a.*, e, mu * wy / wmu AS m FROM a JOIN e ON e.ward = a.ward),
        o AS (SELECT ward, {_K.replace('Y', 'y').replace('M', 'm')} AS k FROM i GROUP BY ward)
        SELECT area, i.ward, round(e, 6) AS ward_effect, round((y + k * e) / (mu + k), 6) AS effect, round(1 / sqrt(y + k * e), 6) AS spread FROM i JOIN o ON o.ward = i.ward""",
)
add("m9_joint_fit", m9_joint)
add("m10_predict_rate", m10)
add(
    "m11_draw_counts",
    m11,
    f"""WITH {PANEL}, r AS (SELECT area, month, greatest(n, 0.1::DOUBLE)::DOUBLE AS rate FROM panel),
        f AS (SELECT rate, list(c ORDER BY k) AS c FROM (SELECT rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY rate ORDER BY k) AS c
              FROM (SELECT DISTINCT rate FROM r), range(0, (SELECT (max(rate) * 2 + 80)::BIGINT FROM r)) t(k)) GROUP BY rate)
        SELECT area, {DAY}, draw::INT AS draw,
               len(list_filter(c, lambda x: x <= ('0x' || substr(md5(concat_ws('|', area, strftime(month, '%Y-%m-%d'), draw)), 1, 8))::BIGINT / 4294967296.0))::BIGINT AS value
        FROM r JOIN f ON f.rate = r.rate, range(1, 21) t(draw)""",
)
add("m11_predictive_draws", m11_predictive)
add("m12_coef_summary", m12)
add("m13_significant", lambda s, d: model.significant(m12(s, d)))
add("m14_grid_search", m14)
add("m15_cross_validate", m15)
add("m16_train_eval", m16)
add("m17_select_forward", m17)
_RS = " UNION ALL ".join(f"SELECT '{_group_of(x)}' AS grp, '{x}' AS \"column\", CASE WHEN stddev_pop({x}) > 0 THEN abs(corr({x}, n)) END AS r FROM features" for x in _WIDE_COLS)
add("m18_select_by_corr", m18, f"WITH {_FEATURES}, rs AS ({_RS}) SELECT grp, \"column\", round(r, 6) AS r FROM rs WHERE r IS NOT NULL ORDER BY rs.r DESC, \"column\" LIMIT 6")
add("m19_select_projection", m19)
_STRONG = " UNION ALL ".join(f"SELECT '{x}' AS \"column\", corr({x}, n) AS r FROM features" for x in _WIDE_COLS if _group_of(x) in ("temporal", "spatial"))
_LONG = " UNION ALL ".join(f"SELECT area, month, '{x}' AS base, '{x}{e}' AS \"column\", ({x}{f})::DOUBLE AS value FROM features" for x in _WIDE_COLS if _group_of(x) in ("temporal", "spatial") for e, f in (("", ""), ("_x_season", " * season")))
add("m20_filter_and_interact", m20, f"WITH {_FEATURES}, strong AS ({_STRONG}), long AS ({_LONG}) SELECT area, {DAY}, long.\"column\", round(value, 6) AS value FROM long JOIN strong ON strong.\"column\" = base WHERE abs(r) >= 0.05")
