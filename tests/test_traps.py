"""Small frames for the semantic traps, and properties of operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.functions import clean as fn
from tesserae.functions import geometry as geo
from tesserae.operators import aggregate as agg
from tesserae.operators import clean, evaluate, joins, panel, spatial
from tesserae.operators import network as net
from tesserae.sources import tables

D = datetime.date


def month(i):
    return D(2020, i, 1)


def test_null_keys_are_left_out(spark):
    assert agg.count_sparse(spark.createDataFrame([("a",), (None,)], "k string"), ["k"]).collect() == [("a", 1)]


def test_nulls_do_not_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 7), ("x", 8)], "k string, w int")
    assert {r["w"] for r in joins.with_lookup(a, b, "k").collect()} == {None, 8}


def test_dense_and_sparse_counts(spark):
    rows = spark.createDataFrame([("a", month(1), 1), ("b", month(2), 2)], "area string, month date, id int")
    assert agg.count_sparse(rows, ["area", "month"]).count() == 2
    assert [r["n"] for r in agg.count_dense(rows, "area", "month", "id").collect()] == [1, 0, 0, 1]


def test_flags(spark):
    rows = spark.createDataFrame([(None,), ("true",), ("false",)], "f string")
    assert [r[0] for r in rows.select(fn.to_flag(F.col("f"))).collect()] == [True, True, False]
    assert [r[0] for r in rows.select(fn.to_flag(F.col("f"), False)).collect()] == [False, True, False]


def test_split_area_keeps_attributes_and_counts_zero(spark):
    rows = spark.createDataFrame([("n1", month(1), 5, 3), ("n2", month(1), 5, 3)], "area string, month date, rank int, n int")
    out = panel.complete_panel(rows, "2020-01-01", "2020-03-01", ["rank"], "n").orderBy("area", "month").collect()
    assert [(r["area"], r["rank"], r["n"]) for r in out] == [(a, 5, n) for a in ("n1", "n2") for n in (3, 0, 0)]
    again = panel.complete_panel(spark.createDataFrame(out), "2020-01-01", "2020-03-01", ["rank"], "n")
    assert sorted(again.collect()) == sorted(spark.createDataFrame(out).select(*again.columns).collect())


def test_neighbours_are_joined_by_key(spark):
    rows = spark.createDataFrame([(a, month(m), n) for a, n in (("a", 1), ("b", 2), ("c", 3)) for m in (1, 2)], "area string, month date, n int")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "area string, neighbour string")
    out = {(r["area"], r["month"].month): (r["neighbour_sum"], r["neighbour_median"]) for r in spatial.add_neighbour_lags(rows, edges).collect()}
    assert out == {("a", 1): (0, 0), ("b", 1): (0, 0), ("c", 1): (0, 0), ("a", 2): (2, 2), ("b", 2): (4, 2), ("c", 2): (2, 2)}


def test_lower_median_and_quantile(spark):
    draws = spark.createDataFrame([("a", month(1), i, i) for i in (1, 2, 3, 4)], "area string, month date, draw int, value int")
    assert evaluate.post_median(draws).first()["median"] == 2
    assert round(evaluate.post_interval(draws).first()["low"], 3) == 1.075


def test_rolling_needs_a_full_window(spark):
    rows = spark.createDataFrame([("a", month(i), i) for i in range(1, 6)], "area string, month date, n int")
    out = panel.add_rolling(rows, [3]).orderBy("month").collect()
    assert [r["roll_3"] for r in out] == [None, None, None, 2.0, 3.0]


def test_half_to_even(spark):
    assert list(spark.range(1).select(*(F.bround(F.lit(v)).cast("int") for v in (0.5, 1.5, 2.5))).first()) == [0, 2, 2]


def test_numbers(spark):
    rows = spark.createDataFrame([("1.234,5 %",), ("-",), ("N/A",), ("12.5",), ("-3,5",), (None,)], "v string")
    assert [r[0] for r in rows.select(fn.eu_number(F.col("v"))).collect()] == [1234.5, None, None, 125.0, 3.5, None]
    assert rows.select(fn.eu_number(F.col("v"), strict=True)).collect()[4][0] == -3.5
    assert [r[0] for r in rows.select(fn.simple_number(F.col("v"))).collect()][3:5] == [12.5, -3.5]


def test_names(spark):
    row = spark.createDataFrame([(" Château-Rouge  2 ", "a|2011", "Jobs (2012) all")], "n string, l string, m string")
    assert row.select(fn.norm_name(F.col("n")), fn.slug(F.col("n"))).first()[0] == "chateau rouge 2"
    assert list(row.select(*fn.split_label(F.col("l"))).first()) == ["a", 2011]
    assert list(row.select(*fn.split_label_any(F.col("m"))).first()) == ["Jobs all", 2012]


def test_points_rules(spark):
    sizes = spark.createDataFrame([(600000.0, 2.0), (10000.0, None), (120000.0, 0.0), (900000.0, 1.0)], "s double, r double")
    out = sizes.select(net.points_by_rate(F.col("s"), F.col("r")).alias("a"), net.points_by_size(F.col("s")).alias("b")).collect()
    assert [r["a"] for r in out] == [6, None, None, 5]
    assert [r["b"] for r in out] == [5, 1, 2, 5]


def test_merge_rules(spark):
    rows = spark.createDataFrame([("a", 1, 10, 1, 2), ("a", 2, 20, 1, 3)], "area string, o int, IMD_Rank int, food_locations int, incident_amount int")
    assert agg.merge_areas(rows, ["area"], "o").collect() == [("a", 15.0, 2, 5)]


def test_months(spark):
    one = spark.createDataFrame([("a", 1)], "area string, v int")
    assert panel.replicate(one, "2015-01-01", "2019-01-01").count() == 48
    assert joins.panel_grid(one, "2010-12-01", "2025-03-01").count() == 172


def test_interval_join(spark):
    rows = spark.createDataFrame([(month(i),) for i in (1, 2, 3)], "month date")
    bands = spark.createDataFrame([("x", month(2), month(2))], "label string, start date, finish date")
    assert [r["label"] for r in joins.label_events(rows, bands).orderBy("month").collect()] == [None, "x", None]


def test_adjacency_is_symmetric_and_weights_sum(spark):
    from tesserae.plans import frames
    from tests.conftest import SF

    pairs = {tuple(r) for r in spatial.adjacency(frames.plots(spark, SF)).collect()}
    assert pairs == {(b, a) for a, b in pairs} and pairs
    sums = spatial.overlay(frames.plots(spark, SF), frames.blocks(spark, SF)).groupBy("area").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in sums)


def test_clip_of_slanted_shapes(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    kind = "ring array<struct<x: double, y: double>>"
    a = spark.createDataFrame([(1, p((0, 0), (2, 0), (0, 2), (0, 0)))], f"area int, {kind}")
    b = spark.createDataFrame([(7, p((0, 0), (0, 1), (1, 1), (1, 0), (0, 0)))], f"target int, {kind}")
    row = spatial.overlay(a, b).first()
    assert abs(row["overlap"] - 1) < 1e-9 and abs(row["weight"] - 0.5) < 1e-9


def test_nearest_far_away(spark):
    points = spark.createDataFrame([("p", 0.0, 0.0), ("q", 900.0, 0.0)], "point string, x double, y double")
    nodes = spark.createDataFrame([(1, 500.0, 0.0), (2, 905.0, 0.0)], "node int, x double, y double")
    assert {tuple(r) for r in spatial.nearest(points, nodes).collect()} == {("p", 1, 500.0), ("q", 2, 5.0)}


def test_geometry(spark):
    ring = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 1.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}],)], "r array<struct<x: double, y: double>>")
    c = geo.centroid(F.col("r"))
    assert list(ring.select(geo.area(F.col("r")), geo.perimeter(F.col("r")), c["x"], c["y"], geo.contains(F.col("r"), F.lit(1.5), F.lit(0.5)), geo.contains(F.col("r"), F.lit(2.5), F.lit(0.5))).first()) == [2, 6, 1, 0.5, True, False]


def test_largest_component_and_distances(spark):
    e = [("w", 1, 2), ("w", 2, 3), ("w", 3, 1), ("w", 3, 4), ("w", 4, 5), ("w", 5, 4), ("v", 9, 8)]
    edges = spark.createDataFrame([(*x, 1.0) for x in e], "ward string, u int, v int, length double")
    assert {(r["u"], r["v"]) for r in net.largest_scc(edges).where("ward = 'w'").collect()} == {(1, 2), (2, 3), (3, 1)}
    way = spark.createDataFrame([("w", 1), ("w", 5), ("v", 9), ("v", 7)], "ward string, node int")
    out = {(r["source"], r["target"]): r["dist"] for r in net.distance_table(net.multi_source_dist(edges, way), way).collect()}
    assert out[1, 5] == 3 and out[5, 1] == 3 and out[9, 7] == 1e9 and out[9, 9] == 0


def test_networks_are_followed_to_their_end(spark, monkeypatch):
    # a bound on rounds, whatever its height, would be a small one here
    monkeypatch.setattr(net, "range", lambda n: range(min(n, 3)), raising=False)
    chain = spark.createDataFrame([(1, i, i + 1, 1.0) for i in range(8)], "ward int, u long, v long, length double")
    out = net.multi_source_dist(chain, spark.createDataFrame([(1, 0)], "ward int, node long"))
    assert {r["node"]: r["dist"] for r in out.collect()} == {i: float(i) for i in range(9)}
    with pytest.raises(ValueError):
        net.multi_source_dist(chain.withColumn("length", F.lit(-1.0)), spark.createDataFrame([(1, 0)], "ward int, node long"))
    ring = [(1, 8, 9), (1, 9, 10), (1, 10, 8)]  # behind a chain of one way, with ascending ids
    out = net.largest_scc(spark.createDataFrame([(1, i, i + 1) for i in range(8)] + ring, "ward int, u long, v long"))
    assert {(r["ward"], r["u"], r["v"]) for r in out.collect()} == set(ring)
    # of components of one size the one with the least node
    tied = [(1, 1, 3), (1, 3, 4), (1, 4, 3), (1, 7, 8), (1, 8, 7)]
    assert {(r["u"], r["v"]) for r in net.largest_scc(spark.createDataFrame(tied, "ward int, u long, v long")).collect()} == {(3, 4), (4, 3)}


def test_hilbert_order_visits_every_point_once(spark):
    pts = spark.createDataFrame([("w", 10 * i + j, float(i), float(j)) for i in range(4) for j in range(4)], "ward string, node int, x double, y double")
    rows = sorted((r["place"], r["x"], r["y"]) for r in net.visit_order(pts).collect())
    steps = [abs(a[1] - b[1]) + abs(a[2] - b[2]) for a, b in zip(rows, rows[1:], strict=False)]
    assert [r[0] for r in rows] == list(range(1, 17)) and set(steps) == {1}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.write_csv(rows, f"{tmp_path}/x/street.d")
    assert tables.read_extracts(spark, str(tmp_path), "nothing", "k int, v string").count() == 0
    assert tables.read_extracts(spark, str(tmp_path), "part", "k int, v string").count() == 2
    (tmp_path / "g.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    out = tables.read_geojson(spark, f"{tmp_path}/g.json").first()
    assert out["properties"]["n"] == "a" and len(out["ring"]) == 4


def test_shrink_and_resolve(spark):
    out = clean.shrink_numeric(spark.createDataFrame([(1, 70000, 0.5)], "a bigint, b bigint, c double"))
    assert [t for _, t in out.dtypes] == ["tinyint", "int", "float"]
    assert clean.resolve_col(out, "key", ["zz", "A"]).columns[0] == "key"


def test_keys_are_numbered_by_appearance(spark):
    """Over several ranges, with adaptive execution, ties and nulls; and in their own order without one."""
    n = 3000
    rows = spark.range(n).selectExpr("(id * 7919) % 997 AS k", "id % 500 AS o").repartition(7).unionByName(spark.createDataFrame([(None, 1)], "k long, o long"))
    seen = {}
    for i in range(n):
        k, o = (i * 7919) % 997, i % 500
        seen[k] = min(o, seen.get(k, o))
    want = {k: i for i, (_, k) in enumerate(sorted((o, k) for k, o in seen.items()))}
    assert {r["k"]: r["idx"] for r in panel.index_keys(rows, "k", order=F.col("o")).collect()} == want
    assert {r["k"]: r["idx"] for r in panel.index_keys(rows, "k", 5).collect()} == {k: i + 5 for i, k in enumerate(sorted(seen))}
    assert panel.index_keys(rows.where("false"), "k").count() == 0


def test_quartiles_without_a_task_that_holds_a_column(spark):
    """The values of percentile(), from counted ranges; no aggregate holds all values."""
    rows = [(i * 37 % 101 / 4 - 9, None if i % 3 else i % 7, None) for i in range(250)] + [(float("inf"), 3, None), (float("nan"), 3, None)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(5)
    out = agg.describe(df, ["a", "b", "c"])
    assert "percentile" not in out._jdf.queryExecution().toString()
    want = df.agg(*(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(c) for c in "abc")).first()
    got = {r["column"]: [r["q1"], r["median"], r["q3"]] for r in out.collect()}
    assert got == {"a": want["a"], "b": want["b"], "c": [None] * 3}
    ends = clean.scale_bounds(df.where("a < 100"), "a").first()
    assert (ends["low"], ends["high"]) == df.where("a < 100").agg(F.min("a"), F.percentile("a", F.lit(0.99))).first()
    assert clean.scale_bounds(df, "c").collect() == [(None, None)]
