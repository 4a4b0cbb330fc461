"""Road network and patrol allocation (K1-K14), for all wards in one job: every graph and route is keyed by ward.

Nodes are (ward, node, x, y), edges (ward, u, v, length, highway array<string>). Iterations write their state to the
shared folder each round, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry as geo
from tesserae.functions.clean import clamp, has_any
from tesserae.functions.stats import uniform
from tesserae.operators.panel import budget_pick
from tesserae.operators.spatial import nearest, sample_points
from tesserae.sources.shared import materialise

#: Road classes of the two cost rules.
MAIN_ROADS = ["motorway", "trunk", "primary", "secondary"]
QUIET_ROADS = ["residential", "living_street", "tertiary", "unclassified"]
#: Chains are contracted from this share of nodes on; rows that a search for shortcuts has for each road; tables of new distances that
#: are read together before they become one.
CHAINS, SHORTCUTS, COMPACT = 0.1, 64, 8
#: Nodes of a block, roads a node that it may have, and the share of roads inside blocks from which distances go by blocks; bits of a place in one.
BLOCK, DENSE, INSIDE, PLACE = 32768, 16, 0.5, 33
#: Nodes of a part whose pairs one task adds up, and of one that is searched from each node, from SOME at a time; distances that a task holds at once; nodes that there is a task for.
PART, LEAF, SOME, CELLS, SHARE = 262144, 128, 64, 1 << 25, 2048
#: Nodes at a cut between halves of a larger part; classes of nodes that meet in a task; distances written at once where cuts have more nodes.
CUT, MEET, PAIRS = 512, 4096, 1 << 28


def edge_cost(edges: DataFrame, rule: str) -> DataFrame:
    """K1 (main): main roads cost 3 times their length. K2 (quiet): all but quiet roads cost 30 times theirs."""
    if rule == "main":
        factor = F.when(has_any(F.col("highway"), MAIN_ROADS), 3.0).otherwise(1.0)
    else:
        factor = F.when(has_any(F.col("highway"), QUIET_ROADS), 1.0).otherwise(30.0)
    return edges.withColumn("cost", F.col("length") * factor)


def residential(edges: DataFrame) -> DataFrame:
    """K3."""
    return edges.where(has_any(F.col("highway"), ["residential"]))


def _shuffled(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the nodes: no side is collected for a broadcast, which each round would send to the driver anew."""
    return df.join(other.hint("merge"), on, how)


def _reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ward, node, label: the least node from which each node can be reached along edges (ward, u, v)."""
    labels = nodes.select("ward", "node", F.col("node").alias("label"))
    while True:
        along = _shuffled(edges, labels.select("ward", F.col("node").alias("u"), "label"), ["ward", "u"]).groupBy("ward", F.col("v").alias("node")).agg(F.min("label").alias("near"))
        # whatever reaches a node's label reaches the node
        jump = labels.select("ward", F.col("node").alias("label"), F.col("label").alias("far"))
        step = _shuffled(_shuffled(labels, along, ["ward", "node"], "left"), jump, ["ward", "label"], "left")
        new = materialise(step.select("ward", "node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed")), "reach")
        labels = new.select("ward", "node", "label")
        if new.where("changed").isEmpty():
            return labels


def _strong(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the component that it is in, by edges from u to v (Tarjan)."""
    order = np.argsort(u, kind="stable")
    near, first = v[order].tolist(), np.searchsorted(u[order], np.arange(n + 1)).tolist()
    at, low, component, stack = [0] * n, [0] * n, [-1] * n, []
    seen = 0
    for start in range(n):
        if at[start]:
            continue
        path = [start]
        nxt = {start: first[start]}
        seen += 1
        at[start] = low[start] = seen
        stack.append(start)
        while path:
            p = path[-1]
            if nxt[p] < first[p + 1]:
                q = near[nxt[p]]
                nxt[p] += 1
                if not at[q]:
                    seen += 1
                    at[q] = low[q] = seen
                    stack.append(q)
                    path.append(q)
                    nxt[q] = first[q]
                elif component[q] < 0:
                    low[p] = min(low[p], at[q])
            else:
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[p])
                if low[p] == at[p]:
                    while True:
                        q = stack.pop()
                        component[q] = p
                        if q == p:
                            break
    return np.array(component, np.int64)


def _components_in_blocks(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """ward, node, label: nodes (ward, node) that are strongly connected within a block (a range of nodes, as for distances) have its least
    node as their label; and how many blocks there are."""
    blocks = max(1, -(-nodes.count() // BLOCK), -(-edges.count() // (BLOCK * DENSE)))
    numbered = materialise(nodes.repartitionByRange(blocks, "ward", "node").select("ward", "node", F.monotonically_increasing_id().alias("n")), "numbered")
    ends = _shuffled(edges, numbered.select("ward", F.col("node").alias("u"), F.col("n").alias("_u")), ["ward", "u"])
    ends = _shuffled(ends, numbered.select("ward", F.col("node").alias("v"), F.col("n").alias("_v")), ["ward", "v"])
    inner = ends.where(_block("_u") == _block("_v")).select(F.col("_u").alias("u"), F.col("_v").alias("v"))

    def run(t: pa.Table) -> pa.Table:
        both, places = np.unique(np.concatenate([t.column(k).to_numpy() for k in ("u", "v")]), return_inverse=True)
        u, v = places[: t.num_rows], places[t.num_rows :]
        return pa.table({"n": both, "c": both[_strong(u, v, len(both))]})

    # as many tasks as blocks, as for distances
    found = materialise(inner.withColumn("block", _block("u")).repartition(blocks, "block").groupBy("block").applyInArrow(run, "n long, c long"), "block-components")
    # nodes without an edge in their block are alone
    of = _shuffled(numbered, found, ["n"], "left").select("ward", "node", F.coalesce("c", "n").alias("c"))
    names = of.groupBy("c").agg(F.min("node").alias("label"))
    return materialise(_shuffled(of, names, ["c"]).select("ward", "node", "label"), "block-labels"), blocks


def largest_scc(edges: DataFrame) -> DataFrame:
    """K4. The edges within each ward's largest strongly connected component; ties go to the one with the least node.

    First, what is strongly connected within blocks of nodes becomes one node, named by its least, again and again while that halves the
    nodes: where ids follow place, few are left, and where all fit one block these are the components. In a round over the rest, nodes whose
    least source and least target agree form components; they are set aside and the rest goes on until every ward's rest is smaller
    than its best component. Nodes of one component have the same least source and target, so edges between nodes that differ in them are
    cut. Each round sets aside one component of every open ward at least.
    """
    flat = materialise(edges.select("ward", "u", "v").distinct(), "edges")
    nodes = materialise(flat.select("ward", F.col("u").alias("node")).union(flat.select("ward", "v")).distinct(), "nodes")
    member = nodes.select("ward", "node", F.col("node").alias("label"))
    n = nodes.count()
    while True:
        own, blocks = _components_in_blocks(nodes, flat)
        member = materialise(_shuffled(member.withColumnRenamed("label", "_l"), own.select("ward", F.col("node").alias("_l"), "label"), ["ward", "_l"]).select("ward", "node", "label"), "members")
        cut = _shuffled(flat, own.select("ward", F.col("node").alias("u"), F.col("label").alias("_u")), ["ward", "u"])
        cut = _shuffled(cut, own.select("ward", F.col("node").alias("v"), F.col("label").alias("_v")), ["ward", "v"])
        flat = materialise(cut.where("_u <> _v").select("ward", F.col("_u").alias("u"), F.col("_v").alias("v")).distinct(), "edges")
        nodes = materialise(own.select("ward", F.col("label").alias("node")).distinct(), "nodes")
        before, n = n, nodes.count()
        if blocks == 1 or n > before / 2:
            break
    weight = materialise(member.groupBy("ward", F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    done = nodes.select("ward", "node", F.col("node").alias("label")) if blocks == 1 else None
    while blocks > 1:
        ahead = _reach(nodes, flat)
        back = _reach(nodes, flat.select("ward", F.col("v").alias("u"), F.col("u").alias("v"))).withColumnRenamed("label", "target")
        both = materialise(_shuffled(ahead, back, ["ward", "node"]), "components")
        found = both.where("label = target").select("ward", "node", "label")
        done = found if done is None else done.unionByName(found)
        rest = both.where("label <> target").select("ward", "node", "label", "target")
        best = _shuffled(done, weight, ["ward", "node"]).groupBy("ward", "label").agg(F.sum("size").alias("size")).groupBy("ward").agg(F.max("size").alias("best"))
        open_ = _shuffled(rest, weight, ["ward", "node"]).groupBy("ward").agg(F.sum("size").alias("size")).join(best, "ward", "left").where(F.col("size") >= F.coalesce("best", F.lit(0))).select("ward")
        rest = materialise(rest.join(open_, "ward", "left_semi"), "rest")
        if rest.isEmpty():
            break
        nodes = rest.select("ward", "node")
        flat = _shuffled(_shuffled(flat, rest.withColumnRenamed("node", "u"), ["ward", "u"]), rest.withColumnRenamed("node", "v"), ["ward", "v", "label", "target"], "left_semi")
        flat = materialise(flat.select("ward", "u", "v"), "edges")
    sizes = _shuffled(done, weight, ["ward", "node"]).groupBy("ward", "label").agg(F.sum("size").alias("size"))
    top = sizes.groupBy("ward").agg(F.min_by("label", F.struct(-F.col("size"), F.col("label"))).alias("label"))
    chosen = done.join(top, ["ward", "label"], "left_semi").select("ward", F.col("node").alias("label"))
    keep = materialise(_shuffled(member, chosen, ["ward", "label"], "left_semi").select("ward", "node"), "largest")
    return _shuffled(_shuffled(edges, keep.withColumnRenamed("node", "u"), ["ward", "u"], "left_semi"), keep.withColumnRenamed("node", "v"), ["ward", "v"], "left_semi")


def _shortest(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy("ward", "u", "v").agg(F.min("w").alias("w"))


def _both_ways(edges: DataFrame, cost: str) -> DataFrame:
    """ward, u, v, w: the least cost of edges that have one, each taken both ways."""
    one = edges.select("ward", "u", "v", F.col(cost).cast("double").alias("w")).where("w is not null")
    both = materialise(_shortest(one.select("ward", F.inline(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))))), "roads")
    if not both.where("w < 0").isEmpty():
        raise ValueError("edges with a cost below 0")
    return both


def contracted(roads: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """roads between the nodes that are a source or have other than two neighbours, chains of nodes with two as one edge each; their nodes; and
    (ward, node, end, w) for the nodes of chains: both ends, and how far they are. None where few nodes are in chains.

    Each edge into a chain points to the last edge of what is known of its way; pointers double each round, so rounds grow
    with the logarithm of the longest chain. Rings that no other road meets are left out, since no source reaches them."""
    degree = roads.groupBy("ward", "u").agg(F.count(F.lit(1)).alias("c")).join(sources.select("ward", F.col("node").alias("u"), F.lit(True).alias("s")).distinct(), ["ward", "u"], "left")
    inner = materialise(degree.select("ward", "u", ((F.col("c") == 2) & F.col("s").isNull()).alias("inner")), "chain-nodes")
    n = inner.agg(F.count_if("inner").alias("inner"), F.count(F.lit(1)).alias("all")).first()
    if n["inner"] < n["all"] * CHAINS:
        return roads, inner.select("ward", F.col("u").alias("node")), None
    chain = inner.where("inner").select("ward", F.col("u").alias("node"))
    ends = lambda df, c, name: df.join(chain.select("ward", F.col("node").alias(c), F.lit(True).alias(name)), ["ward", c], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    ways = ends(roads.withColumns({"a": F.col("u"), "b": F.col("v")}), "b", "open")
    ways = materialise(ways.select("ward", "u", "v", "a", "b", "w", "open"), "ways")
    for _ in range(max(1, int(n["inner"]).bit_length()) + 1):
        if ways.where("open").isEmpty():
            break
        on = ways.select("ward", F.col("u").alias("b"), F.col("v").alias("_v"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("w").alias("_w"), F.col("open").alias("_open"))
        moved = ways.where("open").join(on, ["ward", "b"]).where("_v <> a").select("ward", "u", "v", F.col("_a").alias("a"), F.col("_b").alias("b"), (F.col("w") + F.col("_w")).alias("w"), F.col("_open").alias("open"))
        ways = materialise(ways.where("not open").unionByName(moved), "ways")
    ways = ends(ways.where("not open"), "u", "from_chain")
    kept = _shortest(ways.where("not from_chain").select("ward", "u", F.col("b").alias("v"), "w"))
    inside = ways.where("from_chain").groupBy("ward", F.col("u").alias("node"), F.col("b").alias("end")).agg(F.min("w").alias("w"))
    kept = materialise(kept, "contracted")
    return kept, materialise(kept.select("ward", F.col("u").alias("node")).distinct(), "nodes"), materialise(inside, "inside-chains")


def with_shortcuts(roads: DataFrame) -> DataFrame:
    """roads, and edges for ways of two, then of four of them, as long as the join that finds them has SHORTCUTS times as many rows as
    there are roads at most. A round over these goes as far as several over roads."""
    first = roads.count()
    for _ in range(2):
        pairs = roads.groupBy("ward", "u").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if pairs > SHORTCUTS * first:
            break
        two = roads.select("ward", F.col("u").alias("m"), "v", F.col("w").alias("_w")).join(roads.select("ward", "u", F.col("v").alias("m"), "w"), ["ward", "m"])
        roads = materialise(_shortest(roads.unionByName(two.select("ward", "u", "v", (F.col("w") + F.col("_w")).alias("w")))), "shortcuts")
    return roads


def _in_blocks(roads: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (ward, node) as (ward, node, n), and their roads by blocks. Blocks are ranges of (ward, node) of BLOCK nodes or so, fewer
    where roads are dense; n is the block in its high bits and the place within it. Written, so that all uses see the same numbers."""
    blocks = max(1, -(-nodes.count() // BLOCK), -(-roads.count() // (BLOCK * DENSE)))
    # the id is the partition and the row's place in it
    nodes = materialise(nodes.repartitionByRange(blocks, "ward", "node").select("ward", "node", F.monotonically_increasing_id().alias("n")), "numbered")
    ends = roads.join(nodes.select("ward", F.col("node").alias("u"), F.col("n").alias("_u")), ["ward", "u"]).join(nodes.select("ward", F.col("node").alias("v"), F.col("n").alias("_v")), ["ward", "v"])
    return nodes, _packed(ends.select(F.col("_u").alias("u"), F.col("_v").alias("v"), "w"), blocks)


def _block(n: str) -> Column:
    return F.shiftright(n, PLACE)


def _packed(roads: DataFrame, blocks: int) -> DataFrame:
    """A row a block: its inner roads by the places of their ends, as bytes, those from place p at first[p] to first[p + 1]; over: its roads to
    other blocks; border: where they start; inside, roads: how many of its roads stay inside, and all."""

    def pack(t: pa.Table) -> pa.Table:
        u, v, w = (t.column(k).to_numpy() for k in ("u", "v", "w"))
        order = np.argsort(u, kind="stable")
        u, v, w = u[order], v[order], w[order]
        inner, place = u >> PLACE == v >> PLACE, (1 << PLACE) - 1
        first = np.searchsorted(u[inner] & place, np.arange((u[-1] & place) + 2)).astype(np.int32)
        leave = pa.StructArray.from_arrays([u[~inner], v[~inner], w[~inner]], names=["u", "v", "w"])
        row = {"block": [int(u[0] >> PLACE)], "first": [first.tobytes()], "v": [(v[inner] & place).astype(np.int32).tobytes()], "w": [w[inner].tobytes()]}
        row["border"] = pa.array([(np.unique(u[~inner]) & place).tolist()], pa.list_(pa.int32()))
        return pa.table({**row, "inside": [int(inner.sum())], "roads": [len(u)], "over": pa.ListArray.from_arrays(pa.array([0, len(leave)], pa.int32()), leave)})

    # few rows, each of much work: as many tasks as blocks, which adaptive execution would join by their bytes
    dealt = roads.withColumn("block", _block("u")).repartition(blocks, "block")
    return materialise(dealt.groupBy("block").applyInArrow(pack, "block long, first binary, v binary, w binary, border array<int>, inside long, roads long, over array<struct<u: long, v: long, w: double>>"), "blocks")


def _least(best: list[float | None], start: list[tuple[float, int]], near: list[tuple[int, float]], first: list[int]) -> list[int]:
    """Lowers the least distances of places in best by those to start from, along near; the places that have become nearer."""
    heap, nearer = [], []
    for d, u in start:
        if best[u] is None or d < best[u]:
            best[u] = d
            heap.append((d, u))
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        nearer.append(u)
        for v, w in near[first[u] : first[u + 1]]:
            to, known = d + w, best[v]
            if known is None or to < known:
                best[v] = to
                heapq.heappush(heap, (to, v))
    return nearer


#: What a search of a block gives for a source: the places that have become nearer and their distances, as bytes; of them, by n, those with roads to other blocks.
_NEARER = "block long, s long, places binary, dists binary, leave array<struct<n: long, dist: double>>"


def _within(packed: DataFrame, tasks: int, front: DataFrame, reached: DataFrame | None) -> DataFrame:
    """The front's distances (s, n, dist) carried on inside each block, where they lower those that earlier searches have reached."""

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("block", "s", "places", "dists", "leave")}
        if block.num_rows and rows.num_rows:
            number, first, v, w, border = (block.column(k)[0].as_py() for k in ("block", "first", "v", "w", "border"))
            first = np.frombuffer(first, np.int32).tolist()
            near = list(zip(np.frombuffer(v, np.int32).tolist(), np.frombuffer(w).tolist(), strict=True))
            base, border = number << PLACE, set(border)
            before, starts = defaultdict(list), defaultdict(list)
            for s, n, d, places, dists in zip(*(rows.column(k).to_pylist() for k in ("s", "n", "dist", "places", "dists")), strict=True):
                if places is None:
                    starts[s].append((d, n - base))
                else:
                    before[s].append((places, dists))
            for s, start in starts.items():
                best: list[float | None] = [None] * (len(first) - 1)
                for places, dists in before.pop(s, ()):
                    for p, d in zip(np.frombuffer(places, np.int32).tolist(), np.frombuffer(dists).tolist(), strict=True):
                        if best[p] is None or d < best[p]:
                            best[p] = d
                nearer = _least(best, start, near, first)
                row = (number, s, np.array(nearer, np.int32).tobytes(), np.array([best[p] for p in nearer], np.float64).tobytes(), [{"n": base + p, "dist": best[p]} for p in nearer if p in border])
                for k, value in zip(out, row, strict=True):
                    out[k].append(value)
        leave = pa.list_(pa.struct([("n", pa.int64()), ("dist", pa.float64())]))
        return pa.table(out, pa.schema([("block", pa.int64()), ("s", pa.int64()), ("places", pa.binary()), ("dists", pa.binary()), ("leave", leave)]))

    at = front.withColumn("block", _block("n"))
    rows = at.select("block", "s", "n", "dist", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("dists"))
    if reached is not None:
        again = reached.join(at.select("block", "s").distinct(), ["block", "s"], "left_semi")
        rows = rows.unionByName(again.select("block", "s", "places", "dists"), allowMissingColumns=True)
    roads = packed.join(at.select("block").distinct(), "block", "left_semi").select("block", "first", "v", "w", "border")
    dealt = lambda df: df.repartition(tasks, "block").groupBy("block")
    return dealt(roads).cogroup(dealt(rows)).applyInArrow(run, _NEARER)


def _gathered(reached: DataFrame) -> DataFrame:
    """s, n, dist: the least of all distances that searches have reached; of the places in column to alone, where there is one."""

    def run(t: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(t.column("places").to_pylist()), np.int32)
        dists = np.frombuffer(b"".join(t.column("dists").to_pylist()))
        if "to" in t.column_names:
            wanted = np.isin(places, t.column("to")[0].as_py())
            places, dists = places[wanted], dists[wanted]
        order = np.lexsort((dists, places))
        places, dists = places[order], dists[order]
        least = np.diff(places, prepend=-1) > 0
        n = places[least].astype(np.int64) + (t.column("block")[0].as_py() << PLACE)
        return pa.table({"s": pa.array([t.column("s")[0].as_py()] * len(n), pa.int64()), "n": n, "dist": dists[least]})

    return reached.drop("leave").groupBy("block", "s").applyInArrow(run, "s long, n long, dist double")


def _by_blocks(nodes: DataFrame, packed: DataFrame, sources: DataFrame, targets: DataFrame | None) -> DataFrame:
    """ward, source, node, dist from sources that have roads, to targets or all. A round carries distances through whole blocks and over one road to the next, so rounds
    grow with the blocks that a path crosses, not with its roads. What a search of a block has reached is kept: the next one of the same
    source goes on only where it comes nearer, and the rows kept are the result."""
    blocks = packed.count()
    over = materialise(packed.select(F.inline("over")), "between-blocks")
    begin = sources.select("ward", F.col("node")).distinct().join(nodes, ["ward", "node"]).select(F.col("n").alias("s"), "n", F.lit(0.0).alias("dist"))
    front, written = materialise(begin, "distances"), []
    reached = None
    while not front.isEmpty():
        last = materialise(_within(packed, blocks, front, reached), "reached")
        written.append(last)
        reached = reduce(DataFrame.unionByName, written)
        step = last.select("s", F.inline("leave")).join(over.withColumnRenamed("u", "n"), "n").groupBy("s", F.col("v").alias("n")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        # roads go both ways: a node that another block leads to leads there
        known = reached.select("s", F.inline("leave")).groupBy("s", "n").agg(F.min("dist").alias("_d"))
        front = materialise(step.join(known, ["s", "n"], "left").where("_d is null or dist < _d").drop("_d"), "distances")
    if reached is None:
        return sources.select("ward", F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")).where("false")
    if targets is not None:
        own = targets.join(nodes, ["ward", "node"]).groupBy(_block("n").alias("block")).agg(F.collect_list(F.col("n").bitwiseAND((1 << PLACE) - 1).cast("int")).alias("to"))
        reached = reached.join(own, "block")
    found = _gathered(reached).join(nodes, "n")
    return found.join(nodes.select(F.col("n").alias("s"), F.col("node").alias("source")), "s").select("ward", "source", "node", "dist")


def _relax(front: DataFrame, key: list[str], step) -> DataFrame:
    """The least dist by key of front and all that step(front) leads to, again and again, with what has just become smaller as the front."""
    written = [front]
    known = front
    while not front.isEmpty():
        better = step(front).join(known.withColumnRenamed("dist", "_d"), key, "left").where("_d is null or dist < _d").drop("_d")
        front = materialise(better, "distances")
        written.append(front)
        if len(written) > COMPACT:
            written = [materialise(reduce(DataFrame.unionByName, written).groupBy(*key).agg(F.min("dist").alias("dist")), "distances")]
        known = reduce(DataFrame.unionByName, written).groupBy(*key).agg(F.min("dist").alias("dist"))
    return known


def multi_source_dist(edges: DataFrame, sources: DataFrame, cost: str = "length", targets: DataFrame | None = None) -> DataFrame:
    """K5. ward, source, node, dist: least cost from each source (ward, node), edges taken both ways; to targets (ward, node) alone where
    they are given. Long roads become one edge. Where most
    roads stay within ranges of nodes, distances go by these blocks; elsewhere ways of a few edges become shortcuts, and each round
    only distances that have just become smaller go on. Edges without a cost lead nowhere; costs below 0 are an error, since distances
    would have no end."""
    both = _both_ways(edges, cost)
    start = materialise(sources.select("ward", F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")).distinct(), "distances")
    sources = start.select("ward", "node")  # written, so that all uses read a few rows
    roads, nodes, inside = contracted(both, sources)
    key = ["ward", "source", "node"]
    wanted = via = None
    if targets is not None:
        wanted = via = materialise(targets.select("ward", "node").distinct(), "targets")
        if inside is not None:  # inside a chain, from its ends
            via = wanted.union(inside.join(wanted, ["ward", "node"], "left_semi").select("ward", "end")).distinct()
    nodes, packed = _in_blocks(roads, nodes)
    n = packed.agg(F.sum("inside").alias("inside"), F.sum("roads").alias("roads")).first()
    if n["roads"] and n["inside"] >= INSIDE * n["roads"]:
        found = _by_blocks(nodes, packed, sources, via)
        known = found.unionByName(start.join(nodes, ["ward", "node"], "left_anti"))  # sources without roads
    else:
        ways = with_shortcuts(roads)
        known = _relax(start, key, lambda front: front.withColumnRenamed("node", "u").join(ways, ["ward", "u"]).groupBy("ward", "source", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist")))
    if inside is not None:
        known = materialise(known, "reached")
        along = (inside if wanted is None else inside.join(wanted, ["ward", "node"], "left_semi")).join(known.withColumnRenamed("node", "end"), ["ward", "end"]).groupBy(*key).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        known = known.unionByName(along)
    if wanted is not None:
        known = known.join(wanted, ["ward", "node"], "left_semi").select(*key, "dist")
    return materialise(known, "distances")


def distance_table(dist: DataFrame, waypoints: DataFrame) -> DataFrame:
    """K6. ward, source, target, dist of all pairs of a ward's waypoints (ward, node; few per ward). Pairs without a
    path have twice the ward's largest distance, or 1e9 where there is none."""
    pairs = waypoints.select("ward", F.col("node").alias("source")).join(waypoints.select("ward", F.col("node").alias("target")), "ward")
    known = pairs.join(dist.withColumnRenamed("node", "target"), ["ward", "source", "target"], "left")
    most = F.max("dist").over(Window.partitionBy("ward"))
    return known.select("ward", "source", "target", F.coalesce("dist", F.when(most > 0, most * 2).otherwise(1e9)).alias("dist"))


def points_by_rate(size: Column, rate: Column) -> Column:
    """K7. Borough rule; areas with no rate are skipped (null)."""
    n = F.floor((1 + F.sqrt(size / 150000)) * (1 + 0.5 * rate))
    return F.when(rate > 0, clamp(n, 0, 25).cast("int"))


def points_by_size(size: Column) -> Column:
    """K8. Ward rule."""
    return clamp(F.floor(size / 50000), 1, 5).cast("int")


def flag_high(rate: Column, threshold: float = 0.40) -> Column:
    """K9."""
    return F.coalesce(rate >= threshold, F.lit(False))


def select_waypoints(areas: DataFrame, nodes: DataFrame, rule: str, cap: int = 20, seed: int = 0) -> DataFrame:
    """K10. areas: (ward, area, ring, size, rate), nodes: (ward, node, x, y). ward, area, point_no, node, distance: random points per
    area, snapped to the nearest node of the ward's own graph (null where it has none); by the ward rule the first point of an
    area is sure, and others fill up to cap by rate."""
    n = points_by_rate(F.col("size"), F.col("rate")) if rule == "borough" else points_by_size(F.col("size"))
    points = sample_points(areas, n, seed).join(areas.select("area", "ward", "rate"), "area")
    points = points.withColumn("point", F.concat_ws("|", "area", "point_no"))
    snapped = points.join(nearest(points, nodes, ("ward",)), "point").withColumn("first", F.col("point_no") == 1)
    if rule != "borough":
        snapped = budget_pick(snapped.withColumn("rate", F.coalesce("rate", F.lit(0.0))), cap, "ward", "first", "rate", "point")
    return snapped.select("ward", "area", "point_no", "node", "distance")


def visit_order(points: DataFrame) -> DataFrame:
    """K11. points (ward, node, x, y): adds place, the order along a Hilbert curve over the ward's square; a closed loop."""
    own = points.groupBy("ward").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_s"))
    side = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    keyed = points.join(own, "ward").withColumn("_key", geo.hilbert_key(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"), side))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("ward").orderBy("_key", "node"))).drop("_x", "_y", "_s", "_key")


def route_length(order: DataFrame, dist: DataFrame) -> DataFrame:
    """K12. ward, legs, length: the sum over the legs of a loop, the closing one too."""
    w = Window.partitionBy("ward").orderBy("place")
    first = F.first("node").over(w)
    legs = order.select("ward", F.col("node").alias("source"), F.coalesce(F.lead("node").over(w), first).alias("target"))
    return legs.join(dist, ["ward", "source", "target"], "left").groupBy("ward").agg(F.count(F.lit(1)).alias("legs"), F.sum(F.coalesce("dist", F.lit(0.0))).alias("length"))


def route_coverage(wards: DataFrame, routes: DataFrame, parent: str) -> DataFrame:
    """K13. Per parent: wards, those without a route, and the per cent that have one."""
    has = wards.join(routes.select("ward", F.lit(1).alias("_hit")).distinct(), "ward", "left")
    return has.groupBy(parent).agg(F.count(F.lit(1)).alias("wards"), F.count_if(F.col("_hit").isNull()).alias("missing"), (F.avg(F.col("_hit").isNotNull().cast("int")) * 100).alias("covered_pct"))


def _near(first: np.ndarray, v: np.ndarray, w: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Distances of all places (rows) from sources (columns); the roads from place p are those from first[p] to first[p + 1]. A round goes on
    from the places whose new distances begin within a mean road of the least."""
    n = len(first) - 1
    dist, least, is_open = np.full((n, len(sources)), np.inf), np.full(n, np.inf), np.zeros(n, bool)
    dist[sources, np.arange(len(sources))], least[sources], is_open[sources] = 0, 0, True
    step = w.mean() if len(w) else 0
    while is_open.any():
        front = np.flatnonzero(is_open)
        front = front[least[front] <= least[front].min() + step]
        least[front], is_open[front] = np.inf, False
        c = first[front + 1] - first[front]
        road = np.repeat(first[front] - np.cumsum(c) + c, c) + np.arange(c.sum())
        order = np.argsort(v[road], kind="stable")
        road = road[order]
        begin = np.flatnonzero(np.diff(v[road], prepend=-1))
        if not len(begin):
            continue
        along = dist[np.repeat(front, c)[order]]
        along += w[road][:, None]
        to, along = v[road][begin], np.minimum.reduceat(along, begin, axis=0)
        less = along < dist[to]
        nearer = less.any(axis=1)
        to, along, less = to[nearer], along[nearer], less[nearer]
        dist[to] = np.minimum(dist[to], along)
        least[to], is_open[to] = np.minimum(least[to], np.where(less, along, np.inf).min(axis=1)), True
    return dist


def _meet(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Two sides' classes: rows of distances to the nodes of a cut, how many nodes each has, the sum of their offsets, and how many have none. For
    both, by class: nodes of the other side that are reached, the sum of what is between and of their offsets, nodes at no distance."""
    out = [np.zeros((3, len(side[0]))) for side in (left, right)]
    for i in range(0, len(left[0]), 128):
        a = [x[i : i + 128] for x in left]
        for j in range(0, len(right[0]), 256):
            b = [x[j : j + 256] for x in right]
            between = np.full((len(a[0]), len(b[0])), np.inf)
            along = np.empty_like(between)
            for x, y in zip(a[0].T, b[0].T, strict=True):
                np.minimum(between, np.add.outer(x, y, out=along), out=between)
            reached, none = np.isfinite(between).astype(float), (between == 0).astype(float)
            between[reached == 0] = 0
            out[0][:, i : i + 128] += reached @ b[1], between @ b[1] + reached @ b[2], none @ b[3]
            out[1][:, j : j + 256] += a[1] @ reached, a[1] @ between + a[2] @ reached, a[3] @ none
    return out


def _across(dist: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of distances to the nodes of a cut, of those before half on one side: for each, nodes of the other side that it reaches, and
    the sum of their distances. Rows that differ by an offset alone are one class; far from a cut nearly all are."""
    off = dist.min(axis=1)
    off[np.isinf(off)] = 0
    sides = []
    for own in (slice(0, half), slice(half, None)):
        rows, of = np.unique(dist[own] - off[own, None], axis=0, return_inverse=True)
        of = of.ravel()
        sides.append((of, (rows, np.bincount(of).astype(float), np.bincount(of, off[own]), np.bincount(of, off[own] == 0))))
    met = [by[:, of] for (of, _), by in zip(sides, _meet(sides[0][1], sides[1][1]), strict=True)]
    reached, between, none = np.concatenate(met, axis=1)
    return reached - none * (off == 0), off * reached + between


def _round_about(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of distances to the nodes of a cut: roads between rows by way of these, without those that two shorter ones make up."""
    way = np.full((len(dist), len(dist)), np.inf)
    for x in dist.T:
        np.minimum(way, np.add.outer(x, x), out=way)
    keep = np.isfinite(way) & ~np.eye(len(way), dtype=bool)
    for x in way:
        keep &= ~((np.add.outer(x, x) <= way) & (x[:, None] < way) & (x < way))
    u, v = np.nonzero(keep)
    return u, v, way[u, v]


def _sums(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places 0 to n - 1, with roads both ways: how many places each reaches at a distance above 0, and the sum of their distances.

    A part is cut in halves, by place or, where that cuts more, by distance from its end. Ways across lead through the nodes at the cut;
    then each half is a part of its own, with roads for the ways between these nodes that leave it. Parts with no small cut are searched from
    each node."""
    reached, total = np.zeros(n), np.zeros(n)
    todo = [(np.arange(n), u, v, w)]
    while todo:
        own, u, v, w = todo.pop()
        m, half = len(own), len(own) // 2
        ends = None
        for by_place in (True, False):
            order = np.argsort(u, kind="stable")
            u, v, w = u[order], v[order], w[order]
            first = np.searchsorted(u, np.arange(m + 1))
            if m <= LEAF:
                break
            over = (u < half) & (v >= half)
            ends = np.unique(u[over]), np.unique(v[over])
            most = max(map(len, ends))
            if most <= (4 * m**0.5 if by_place else m / 4) and most * m <= CELLS:
                break
            ends = None
            if by_place:
                start = _near(first, v, w, np.array([0]))[:, 0]
                start = np.where(np.isinf(start), -1, start).argmax()
                order = np.argsort(_near(first, v, w, np.array([start]))[:, 0], kind="stable")
                place = np.empty(m, np.int64)
                place[order] = np.arange(m)
                own, u, v = own[order], place[u], place[v]
        if ends is None:
            some = max(1, min(SOME, CELLS // m))
            for i in range(0, m, some):
                dist = _near(first, v, w, np.arange(i, min(m, i + some)))
                far = np.isfinite(dist) & (dist > 0)
                reached[own[i : i + some]] += far.sum(axis=0)
                total[own[i : i + some]] += np.where(far, dist, 0).sum(axis=0)
            continue
        dist = _near(first, v, w, ends[0])
        if len(ends[0]):
            add = _across(dist, half)
            reached[own] += add[0]
            total[own] += add[1]
        for low, high, end in ((0, half, ends[0]), (half, m, ends[1])):
            inner = (u >= low) & (u < high) & (v >= low) & (v < high)
            a, b, c = _round_about(dist[end])
            todo.append((own[low:high], np.concatenate([u[inner], end[a]]) - low, np.concatenate([v[inner], end[b]]) - low, np.concatenate([w[inner], c])))
    return reached, total


_SUMS = "n long, reached double, dist double"


def _in_parts(roads: DataFrame, tasks: int) -> DataFrame:
    """n, reached, dist: _sums of parts that fit a task."""

    def run(t: pa.Table) -> pa.Table:
        u, v, w = (t.column(k).to_numpy() for k in ("u", "v", "w"))
        n = np.unique(u)
        reached, dist = _sums(len(n), np.searchsorted(n, u), np.searchsorted(n, v), w)
        return pa.table({"n": n, "reached": reached, "dist": dist})

    return roads.repartition(tasks, "part").groupBy("part").applyInArrow(run, _SUMS)


def _from_each(nodes: DataFrame, roads: DataFrame) -> list[DataFrame]:
    """n, reached, dist of parts that are searched from each node, of so many at once that PAIRS distances are written at most."""
    pairs = nodes.groupBy("part").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    batches, out = -(-pairs // PAIRS), []
    for i in range(batches):
        some = nodes.where(F.pmod(F.xxhash64("n"), F.lit(batches)) == i).select(F.col("part").alias("ward"), F.col("n").alias("node"))
        dist = multi_source_dist(roads.where("u < v").withColumnRenamed("part", "ward"), some, "w").where("dist > 0")
        out.append(materialise(dist.groupBy(F.col("source").alias("n")).agg(F.count(F.lit(1)).cast("double").alias("reached"), F.sum("dist").alias("dist")), "sums"))
    return out


def _across_halves(dist: DataFrame, halves: DataFrame) -> DataFrame:
    """n, reached, dist: what _across gives, for parts (part, mid) of any size and distances (ward, source, node, dist) from the nodes of their cuts."""
    # the nodes of a cut that a node reaches are those of its component, which the least of them names
    key, row = ["part", "at", "side", "row"], F.array_sort(F.collect_list(F.struct("source", "dist")))
    seen = dist.groupBy(F.col("ward").alias("part"), F.col("node").alias("n")).agg(F.min("source").alias("at"), F.min("dist").alias("off"), row.alias("row"))
    seen = seen.withColumn("row", F.transform("row", lambda x: x["dist"] - F.col("off"))).join(halves, "part").withColumn("side", (F.col("n") > F.col("mid")).cast("int")).drop("mid")
    seen = materialise(seen, "seen")
    found = seen.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("nodes"), F.sum("off").alias("offs"), F.count_if(F.col("off") == 0).cast("double").alias("nones"))
    found = materialise(found.withColumn("id", F.monotonically_increasing_id()), "classes")
    chunks = found.groupBy("part", "at", "side").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("chunks"))
    dealt = found.join(chunks, ["part", "at", "side"]).withColumn("own", F.pmod(F.xxhash64("id"), "chunks"))
    dealt = dealt.join(chunks.select("part", "at", (1 - F.col("side")).alias("side"), F.col("chunks").alias("others")), ["part", "at", "side"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    dealt = dealt.withColumns({"left": F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), "right": F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))})

    def run(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        rows = np.array(t.column("row").combine_chunks().flatten()).reshape(t.num_rows, -1)
        columns = [rows, *(t.column(k).to_numpy() for k in ("nodes", "offs", "nones"))]
        met = _meet(*(tuple(c[side == k] for c in columns) for k in (0, 1)))
        reached, between, none = np.concatenate(met, axis=1)
        return pa.table({"id": np.concatenate([ids[side == k] for k in (0, 1)]), "reached": reached, "between": between, "none": none})

    dealt = dealt.select("part", "at", "left", "right", "side", "id", "row", "nodes", "offs", "nones")
    met = dealt.groupBy("part", "at", "left", "right").applyInArrow(run, "id long, reached double, between double, none double")
    by = met.groupBy("id").agg(F.sum("reached").alias("reached"), F.sum("between").alias("between"), F.sum("none").alias("none"))
    own = _shuffled(seen, found.select(*key, "id"), key).join(by, "id")
    none = F.when(F.col("off") == 0, F.col("none")).otherwise(0.0)
    return materialise(own.select("n", (F.col("reached") - none).alias("reached"), (F.col("off") * F.col("reached") + F.col("between")).alias("dist")), "sums")


def distance_sums(edges: DataFrame, cost: str = "length") -> DataFrame:
    """ward, node, reached, dist: how many nodes each node reaches at a distance above 0 along edges taken both ways, and the sum of their distances;
    every pair counts. Nodes that reach none are left out.

    A ward that is too large for a task is cut in halves as in _sums, with a distributed search from the nodes at the cut; where
    these are many, since ids don't follow place, the ward is searched from each node instead."""
    both = _both_ways(edges, cost)
    nodes = both.select("ward", F.col("u").alias("node")).distinct()
    n = nodes.count()
    order = nodes.repartitionByRange(max(1, -(-n // BLOCK)), "ward", "node").sortWithinPartitions("ward", "node")
    numbered = materialise(order.select("ward", "node", F.monotonically_increasing_id().alias("n")), "numbered")
    parts = numbered.groupBy("ward").agg(F.min("n").cast("string").alias("part"))
    ends = _shuffled(both, numbered.select("ward", F.col("node").alias("u"), F.col("n").alias("_u")), ["ward", "u"])
    ends = _shuffled(ends, numbered.select("ward", F.col("node").alias("v"), F.col("n").alias("_v")), ["ward", "v"])
    roads = materialise(ends.join(parts, "ward").select("part", F.col("_u").alias("u"), F.col("_v").alias("v"), "w"), "roads")
    sums, tasks = [], max(1, -(-n // SHARE))
    while True:
        nodes = roads.select("part", F.col("u").alias("n")).distinct()
        size = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("nodes"), F.percentile_approx("n", 0.5).alias("mid")).join(roads.groupBy("part").agg(F.count(F.lit(1)).alias("roads")), "part")
        halves = materialise(size.where((F.col("nodes") > PART) | (F.col("roads") > PART * DENSE)).select("part", "mid"), "halves")
        sums.append(materialise(_in_parts(roads.join(halves, "part", "left_anti"), tasks), "sums"))
        if halves.isEmpty():
            break
        roads = materialise(roads.join(halves, "part"), "roads")
        over = materialise(roads.where("u <= mid and v > mid"), "over")
        cut = over.groupBy("part").agg(F.greatest(F.count_distinct("u"), F.count_distinct("v")).alias("cut"))
        wide = materialise(cut.where(F.col("cut") > CUT).select("part"), "wide")
        if not wide.isEmpty():
            sums += _from_each(nodes.join(wide, "part", "left_semi"), roads.join(wide, "part", "left_semi").drop("mid"))
            roads, over, halves = (materialise(df.join(wide, "part", "left_anti"), "narrow") for df in (roads, over, halves))
        dist = multi_source_dist(roads.where("u < v").withColumnRenamed("part", "ward"), over.select(F.col("part").alias("ward"), F.col("u").alias("node")).distinct(), "w")
        sums.append(_across_halves(dist, halves))
        end = over.select("part", F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit("0").alias("side")), F.struct(F.col("v").alias("n"), F.lit("1").alias("side")))).alias("e")).select(F.col("part").alias("ward"), F.col("e.n").alias("node"), F.concat("part", F.lit("."), "e.side").alias("part")).distinct()
        end = materialise(dist.join(end, ["ward", "node"]), "ends")
        about = end.select("part", "source", F.col("node").alias("u"), "dist").join(end.select("part", "source", F.col("node").alias("v"), F.col("dist").alias("_d")), ["part", "source"]).select("part", "u", "v", (F.col("dist") + F.col("_d")).alias("w"))
        inner = roads.where("(u <= mid) = (v <= mid)").select(F.concat("part", F.lit("."), F.when(F.col("u") <= F.col("mid"), "0").otherwise("1")).alias("part"), "u", "v", "w")
        roads = materialise(_shortest(inner.unionByName(about).withColumnRenamed("part", "ward")).withColumnRenamed("ward", "part"), "roads")
    total = reduce(DataFrame.unionByName, sums).groupBy("n").agg(F.sum("reached").alias("reached"), F.sum("dist").alias("dist")).where("reached > 0")
    return materialise(_shuffled(numbered, total, ["n"]).select("ward", "node", "reached", "dist"), "distance-sums")


def mean_closeness(edges: DataFrame, nodes_in_areas: DataFrame, landmarks: int | None = None, seed: int = 0) -> DataFrame:
    """K14. area, closeness: mean over its nodes of nodes reached / their summed distance, over all nodes of the ward. With landmarks, an approximation: distances go
    to as many nodes per ward only, chosen by a hash. nodes_in_areas: (ward, node, area)."""
    if landmarks is None:
        close = distance_sums(edges).select("ward", "node", (F.col("reached") / F.col("dist")).alias("c"))
    else:
        nodes = edges.select("ward", F.col("u").alias("node")).union(edges.select("ward", "v")).distinct()
        draw = F.row_number().over(Window.partitionBy("ward").orderBy(uniform(F.col("ward"), F.col("node"), seed), "node"))
        marks = materialise(nodes.withColumn("_i", draw).where(F.col("_i") <= landmarks).select("ward", "node"), "landmarks")
        dist = multi_source_dist(edges, marks)
        close = dist.where("dist > 0").groupBy("ward", "node").agg((F.count(F.lit(1)) / F.sum("dist")).alias("c"))
    return nodes_in_areas.join(close, ["ward", "node"]).groupBy("area").agg(F.avg("c").alias("closeness"))
