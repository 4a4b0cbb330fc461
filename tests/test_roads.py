"""Distances and components of road graphs against plain searches; rounds of long roads."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from tesserae.operators import network as net

EDGES = "ward int, u int, v int, length double"


def dijkstra(edges, ward, source):
    near = defaultdict(list)
    for w, u, v, d in edges:
        if w == ward and d is not None:
            near[u].append((v, d))
            near[v].append((u, d))
    best, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for v, x in near[u]:
                heapq.heappush(heap, (d + x, v))
    return best


def expected(edges, sources):
    return {(w, s, n): d for w, s in sources for n, d in dijkstra(edges, w, s).items()}


def found(spark, edges, sources):
    out = net.multi_source_dist(spark.createDataFrame(edges, EDGES), spark.createDataFrame(sources, "ward int, node int")).collect()
    got = {(r["ward"], r["source"], r["node"]): r["dist"] for r in out}
    assert len(got) == len(out)
    return got


def towns(rng):
    """Two wards of crossings joined by long roads, with dead ends, loops, rings, double roads and roads without a length."""
    edges = []
    for ward in (0, 1):
        n = 1000
        for a in range(12):
            for b in rng.sample(range(12), 2):
                last = a
                for _ in range(rng.choice([0, 1, 5, 40])):
                    n += 1
                    edges.append((ward, last, n, rng.randint(1, 9) / 2))
                    last = n
                edges.append((ward, last, b, rng.randint(1, 9) / 2))
        edges += [(ward, 3, 3, 1.0), (ward, 0, 1, 50.0), (ward, 1, 0, 3.5), (ward, 2, 5, None)]
        edges += [(ward, 5000 + k, 5000 + (k + 1) % 6, 1.0) for k in range(6)]  # a ring of its own
        edges += [(ward, 6000 + k, 6001 + k, 1.0) for k in range(20)]  # a road of its own
    return edges


@pytest.mark.parametrize("shortcuts", [0, 64])
def test_distances(spark, monkeypatch, shortcuts):
    monkeypatch.setattr(net, "SHORTCUTS", shortcuts)
    monkeypatch.setattr(net, "COMPACT", 3)
    edges = towns(random.Random(3))
    sources = [(0, 0), (0, 7), (1, 4), (1, 1003), (1, 5002), (0, 6010), (0, 99999)]
    got = found(spark, edges, sources)
    want = expected(edges, sources)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_strip_takes_few_rounds(spark, monkeypatch):
    """A road of 10,000 nodes: rounds, and rows written over all of them, not hops times nodes."""
    written = []
    real = net.materialise
    monkeypatch.setattr(net, "materialise", lambda df, name: written.append(name) or real(df, name))
    edges = spark.range(9999).selectExpr("0 AS ward", "int(id) AS u", "int(id + 1) AS v", "1.0D AS length")
    sources = spark.createDataFrame([(0, 0), (0, 5000)], "ward int, node int")
    out = net.multi_source_dist(edges, sources)
    assert out.count() == 20000
    assert out.where("dist <> abs(node - source)").count() == 0
    assert written.count("ways") <= 16 and written.count("distances") <= 6


def test_negative_costs_are_an_error(spark):
    with pytest.raises(ValueError):
        found(spark, [(0, 1, 2, -1.0)], [(0, 1)])
    assert found(spark, [(0, 1, 2, 1.0)], [(5, 1)]) == {(5, 1, 1): 0.0}


def largest(edges):
    """Kosaraju by ward; ties to the least node."""
    out = {}
    for ward in {w for w, _, _ in edges}:
        ahead, back, nodes = defaultdict(list), defaultdict(list), set()
        for w, u, v in edges:
            if w == ward:
                ahead[u].append(v)
                back[v].append(u)
                nodes |= {u, v}

        def walk(start, near, seen, order):
            todo = [(start, iter(near[start]))]
            seen.add(start)
            while todo:
                u, it = todo[-1]
                for v in it:
                    if v not in seen:
                        seen.add(v)
                        todo.append((v, iter(near[v])))
                        break
                else:
                    order.append(u)
                    todo.pop()

        order, seen = [], set()
        for u in nodes:
            if u not in seen:
                walk(u, ahead, seen, order)
        parts, seen = [], set()
        for u in reversed(order):
            if u not in seen:
                part = []
                walk(u, back, seen, part)
                parts.append(set(part))
        out[ward] = min(parts, key=lambda p: (-len(p), min(p)))
    return sorted(e for e in edges if e[1] in out[e[0]] and e[2] in out[e[0]])


def scc(spark, edges):
    return sorted(tuple(r) for r in net.largest_scc(spark.createDataFrame(edges, "ward int, u int, v int")).select("ward", "u", "v").collect())


def test_components(spark):
    rng = random.Random(5)
    edges = [(w, rng.randrange(60), rng.randrange(60)) for w in range(3) for _ in range(75)]
    edges += [(7, i, i + 1) for i in range(30)] + [(8, 5, 6), (8, 6, 5), (8, 1, 2), (8, 2, 1), (8, 2, 5), (9, 4, 4), (9, 4, 5)]
    assert scc(spark, edges) == largest(edges)


def test_closeness_from_landmarks(spark):
    rng = random.Random(11)
    at = lambda x, y: 8 * x + y
    edges = [(0, at(x, y), at(x + a, y + b), rng.randint(2, 9) / 2) for x in range(8) for y in range(8) for a, b in ((0, 1), (1, 0)) if x + a < 8 and y + b < 8]
    exact = {n: 63 / sum(dijkstra(edges, 0, n).values()) for n in range(64)}
    roads = spark.createDataFrame(edges, EDGES)
    nodes = spark.createDataFrame([(0, n, n) for n in range(64)], "ward int, node int, area int")
    for landmarks, bound in ((64, 1e-9), (16, 0.25)):
        got = {r["area"]: r["closeness"] for r in net.mean_closeness(roads, nodes, landmarks).collect()}
        assert got.keys() == exact.keys()
        off = [abs(got[n] - c) / c for n, c in exact.items()]
        print(landmarks, max(off), sum(off) / len(off))
        assert max(off) <= 1e-9 if landmarks == 64 else sum(off) / len(off) <= bound


@pytest.mark.parametrize("inside", [0.0, 2.0])
def test_distances_by_small_blocks(spark, monkeypatch, inside):
    """Blocks of a few nodes, with and without going by them."""
    monkeypatch.setattr(net, "BLOCK", 8)
    monkeypatch.setattr(net, "INSIDE", inside)
    edges = towns(random.Random(4))
    sources = [(0, 0), (1, 4), (1, 1003), (1, 5002), (0, 6010), (0, 99999)]
    got = found(spark, edges, sources)
    want = expected(edges, sources)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def strip(n):
    """A ward as the queries have it: node i to i + 1, i + 7 and i + 49."""
    return [(0, i, i + step, 100.0 + (i * 13 + (i + step) * 7) % 400) for i in range(n) for step in (1, 7, 49) if i + step < n]


def test_wide_strip_takes_few_rounds(spark, monkeypatch):
    """Hundreds of roads from end to end, none in a chain: rounds go with the blocks."""
    written = []
    real = net.materialise
    monkeypatch.setattr(net, "materialise", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(net, "BLOCK", 2000)
    edges = strip(8000)
    got = found(spark, edges, [(0, 0), (0, 4000)])
    want = expected(edges, [(0, 0), (0, 4000)])
    assert got == want
    assert written.count("distances") <= 24


@pytest.fixture
def blocks(monkeypatch):
    """Names of written tables, with blocks of 700 nodes."""
    written = []
    real = net.materialise
    monkeypatch.setattr(net, "materialise", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(net, "BLOCK", 700)
    return written


def test_route_and_table_over_a_wide_strip(spark, blocks):
    """K6 and K12: all pairs of waypoints, and a loop over them, in few rounds."""
    edges, stops = strip(2800), [0, 700, 1400, 2100]
    points = spark.createDataFrame([(0, n) for n in stops], "ward int, node int")
    table = net.distance_table(net.multi_source_dist(spark.createDataFrame(edges, EDGES), points), points)
    want = {(s, t): dijkstra(edges, 0, s)[t] for s in stops for t in stops}
    assert {(r["source"], r["target"]): r["dist"] for r in table.collect()} == want
    order = spark.createDataFrame([(0, n, k + 1) for k, n in enumerate(stops)], "ward int, node int, place int")
    row = net.route_length(order, table).first()
    assert (row["legs"], row["length"]) == (4, sum(want[a, b] for a, b in zip(stops, [*stops[1:], 0], strict=True)))
    assert blocks.count("distances") <= 20


def test_closeness_over_a_wide_strip(spark, blocks):
    """K14 in few rounds."""
    nodes = spark.range(2800).selectExpr("0 AS ward", "int(id) AS node", "0 AS area")
    assert net.mean_closeness(spark.createDataFrame(strip(2800), EDGES), nodes, 2).first()["closeness"] > 0
    assert blocks.count("distances") <= 20


@pytest.mark.parametrize("block", [8, 8192])
@pytest.mark.parametrize("inside", [0.0, 2.0])
def test_distances_to_targets_alone(spark, monkeypatch, inside, block):
    """The rows of the whole search that end at a target: crossings, nodes of chains and rings, sources, and nodes that no graph has."""
    monkeypatch.setattr(net, "BLOCK", block)
    monkeypatch.setattr(net, "INSIDE", inside)
    edges, sources = towns(random.Random(6)), [(0, 0), (1, 4), (1, 1003), (1, 5002), (0, 6010), (0, 99999)]
    targets = [(0, 0), (0, 7), (0, 1001), (0, 1005), (1, 1002), (1, 4), (1, 5004), (0, 6015), (0, 99999), (1, 88888)]
    out = net.multi_source_dist(spark.createDataFrame(edges, EDGES), spark.createDataFrame(sources, "ward int, node int"), targets=spark.createDataFrame(targets, "ward int, node int")).collect()
    want = {k: d for k, d in expected(edges, sources).items() if (k[0], k[2]) in targets}
    got = {(r["ward"], r["source"], r["node"]): r["dist"] for r in out}
    assert len(out) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_components_by_small_blocks(spark, monkeypatch):
    """Blocks of a few nodes: components that cross them, ties, chains one way, and ids that don't follow place."""
    monkeypatch.setattr(net, "BLOCK", 8)
    rng = random.Random(9)
    edges = [(0, i, j) for i in range(40) for j in (i + 1, i - 1) if j >= 0] + [(0, 40, 41), (0, 41, 42)]
    edges += [(1, rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(2, 7 * i % 41, 7 * (i + 1) % 41) for i in range(41)]
    edges += [(3, a + i, a + (i + 1) % 6) for a in (10, 30) for i in range(6)] + [(3, 12, 33), (4, 5, 5)]
    assert scc(spark, edges) == largest(sorted(set(edges)))


def test_components_of_a_strip_take_few_tables(spark, monkeypatch):
    """What goes through the driver or a round grows with the blocks: a long strip becomes a few nodes at once, and no table of nodes is broadcast."""
    written, real = [], net.materialise
    monkeypatch.setattr(net, "materialise", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(net, "BLOCK", 500)
    both = [(0, a, b) for _, u, v, _ in strip(2000) for a, b in ((u, v), (v, u))] + [(0, 1999, 2000)]
    out = net.largest_scc(spark.createDataFrame(both, "ward int, u int, v int"))
    assert out.count() == len(both) - 1
    assert "reach" not in written and len(written) <= 16


def test_blocks_are_not_searched_again(spark, monkeypatch):
    """what a search of a block has reached is kept, so nodes that come nearer over all rounds are hardly more than the result, which
    takes no search of its own."""
    written, real = [], net.materialise
    monkeypatch.setattr(net, "materialise", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    monkeypatch.setattr(net, "BLOCK", 500)
    edges, sources = strip(2500), [(0, 0), (0, 1300)]
    assert found(spark, edges, sources) == expected(edges, sources)
    nearer = sum(df.selectExpr("sum(length(places) / 4)").first()[0] or 0 for name, df in written if name == "reached")
    assert 5000 <= nearer <= 7500


def test_landmarks_are_drawn_once(spark, monkeypatch):
    """the draw over all nodes is no part of what each use of the landmarks reads."""
    plans, real = [], net.multi_source_dist
    monkeypatch.setattr(net, "multi_source_dist", lambda edges, marks: plans.append(marks._jdf.queryExecution().optimizedPlan().toString()) or real(edges, marks))
    nodes = spark.range(60).selectExpr("0 AS ward", "int(id) AS node", "0 AS area")
    got = net.mean_closeness(spark.createDataFrame(strip(60), EDGES), nodes, 60).first()["closeness"]
    assert abs(got - sum(59 / sum(dijkstra(strip(60), 0, n).values()) for n in range(60)) / 60) < 1e-9
    assert len(plans) == 1 and "Window" not in plans[0]


def all_sums(edges):
    """(ward, node): nodes that it reaches at a distance above 0, and the sum of their distances."""
    every = {(w, n): [d for d in dijkstra(edges, w, n).values() if d > 0] for w, n in {(e[0], n) for e in edges for n in e[1:3]}}
    return {k: (len(d), sum(d)) for k, d in every.items() if d}


def ragged(rng):
    """Roads of which some have no length or lead nowhere, a star, a row, and a strip whose ids don't follow place."""
    edges = [(4, rng.randrange(60), rng.randrange(60), rng.choice([0.0, 0.0, 1.0, 0.3, 2.7, None])) for _ in range(110)]
    edges += [(5, 0, i, 1.0) for i in range(1, 50)] + [(6, i, i + 1, 0.1) for i in range(80)]
    return edges + [(7, 37 * a % 127, 37 * b % 127, w) for _, a, b, w in strip(120)] + [(8, 1, 2, None), (9, 3, 3, 1.0)]


def assert_sums(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and abs(got[k][1] - d) <= 1e-9 * d for k, (n, d) in want.items())


@pytest.mark.parametrize("cells", [64, 1 << 25])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_sums_of_a_part(monkeypatch, leaf, cells):
    """halves and cuts give the sums of searches from each node, on graphs of all kinds."""
    monkeypatch.setattr(net, "LEAF", leaf)
    monkeypatch.setattr(net, "CELLS", cells)
    rng = random.Random(leaf)
    edges, got = towns(rng) + ragged(rng), {}
    for ward in {e[0] for e in edges}:
        least = {}
        for _, a, b, d in (e for e in edges if e[0] == ward and e[3] is not None and e[1] != e[2]):
            for way in ((a, b), (b, a)):
                least[way] = min(least.get(way, d), d)
        if least:
            u, v = map(np.array, zip(*least, strict=True))
            n = np.unique(u)
            sums = net._sums(len(n), np.searchsorted(n, u), np.searchsorted(n, v), np.array([*least.values()]))
            got |= {(ward, int(x)): (r, d) for x, r, d in zip(n, *sums, strict=True) if r}
    assert_sums(got, all_sums(edges))


@pytest.mark.parametrize(("part", "cut"), [(131072, 512), (100, 512), (100, 40)])
def test_closeness_takes_all_nodes(spark, monkeypatch, part, cut):
    """every pair of a ward's nodes counts, none is drawn: in one task, in halves of large wards, and where no cut is small."""
    monkeypatch.setattr(net, "PART", part)
    monkeypatch.setattr(net, "CUT", cut)
    monkeypatch.setattr(net, "MEET", 30)
    monkeypatch.setattr(net, "PAIRS", 12000)
    edges = [(0, u, v, d) for _, u, v, d in strip(150)] + ragged(random.Random(3))
    want = all_sums(edges)
    roads = spark.createDataFrame(edges, EDGES)
    assert_sums({(r["ward"], r["node"]): (r["reached"], r["dist"]) for r in net.distance_sums(roads).collect()}, want)
    if part > 100:
        nodes = spark.createDataFrame([(*k, k[0]) for k in want], "ward int, node int, area int")
        got = {r["area"]: r["closeness"] for r in net.mean_closeness(roads, nodes).collect()}
        for ward in {w for w, _ in want}:
            each = [n / d for (w, _), (n, d) in want.items() if w == ward]
            assert abs(got[ward] - sum(each) / len(each)) < 1e-9


def test_far_from_a_cut_nodes_are_few_classes(monkeypatch):
    """the pairs that meet grow far slower than the pairs of nodes."""
    met, real = [], net._meet
    monkeypatch.setattr(net, "_meet", lambda a, b: met.append(len(a[0]) * len(b[0])) or real(a, b))
    for n in (1000, 4000):
        _, u, v, w = map(np.array, zip(*strip(n), strict=True))
        net._sums(n, np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]).astype(float))
        met.append(-1)
    cut = met.index(-1)
    assert sum(met[cut + 1 : -1]) < 8 * sum(met[:cut])
