import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, jaccard
from tesserae.llm.components import components
from tesserae.llm.exact_dedup import _rows, content_runs, drop_exact_copies, exact_groups
from tesserae.llm.jaccard import drop_near_copies, jaccard_components
from tesserae.llm.line_dedup import line_dedup, verified, within_edits, without_dropped_lines
from tesserae.llm.queries import oracle_sql, queries
from tesserae.llm.signature_trees import Forest
from tests.compare import same
from tests.conftest import SF
from tests.llm.fixtures import DOCS, edge_rows, prose, table


@pytest.mark.parametrize("name", ["op3_extendible_sharding", "op5_jaccard_join", "op9_line_dedup", "op10_exact_dedup"])
def test_sql(spark, duck, name):
    same(queries()[name](spark, SF), duck.sql(oracle_sql()[name]))


def test_exact_edges(spark):
    rows = edge_rows()
    out = exact_groups(table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for i, t in rows:
        by[hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()].append(i)
    for r in out:
        own = by[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == min((i for i in own if i is not None), default=None)
    assert sum(r["kept"] for r in out) == len(by)
    kept = drop_exact_copies(table(spark, rows))
    assert kept.count() == len(by) and kept.columns == table(spark, []).columns
    assert exact_groups(table(spark, [])).count() == 0 and drop_exact_copies(table(spark, [])).count() == 0


def test_neighbours_find_every_copy(spark):
    """All copies of the given table come out of comparisons of neighbours in the content sort."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.count() - docs.select(exact_dedup.normalised(F.col("text"))).distinct().count()
    assert copies > 0
    assert content_runs(_rows(docs, "doc_id", "text"), "lead", "hash").where("run_place > 1").count() == copies


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_crowded_texts_are_split_and_meet_again(spark, monkeypatch, crowd):
    monkeypatch.setattr(exact_dedup, "CROWD", crowd)
    rows = [(i, "many  copies") for i in range(500, 540)] + [(None, "many copies")] * 25 + [(None, "only nulls")] * 30 + [(7, "same id")] * 9 + [(i, f"t{i % 4}") for i in range(600, 616)] + edge_rows()
    docs = table(spark, rows).repartition(5)
    out = exact_groups(docs).collect()
    by = defaultdict(list)
    for i, t in rows:
        by[hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()].append(i)
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(by)
    for r in out:
        own = by[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == min((i for i in own if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    kept = drop_exact_copies(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(min((i for i in own if i is not None), default=None)) for own in by.values())


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is None:
            continue
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
        parent[i] = i
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def near_rows():
    rng = random.Random(3)
    base = prose(5, 80).split()
    rows = []
    for i in range(60):  # a group of near copies whose members differ in their own places
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    shared = prose(6, 40)
    rows += [(200 + i, shared + " " + prose(300 + i, 60)) for i in range(30)]  # a passage that many hold
    return rows + edge_rows()


def test_jaccard_brute_force(spark, monkeypatch):
    rows = near_rows()
    expected = brute_components(rows)
    for block in (1024, 16):  # 16: buckets are cut into blocks, and dealt as pairs of them
        monkeypatch.setattr(jaccard, "BLOCK", block)
        out = jaccard_components(table(spark, rows)).collect()
        assert len(out) == len(rows)
        assert all(r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]]) for r in out)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)  # every join by shuffle
    out = jaccard_components(table(spark, rows)).collect()
    assert all(r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]]) for r in out)
    kept = [r["doc_id"] for r in drop_near_copies(table(spark, rows)).collect()]
    assert Counter(kept) == Counter(i for i, _ in rows if i is None or expected[i] == i)


def test_jaccard_takes_rows_in_any_order(spark):
    rows = [(i, t) for i, t in near_rows() if i is not None]
    rows += [(i + 1000, t) for i, t in rows if i >= 100]  # copies with larger ids, met before their representatives
    expected = brute_components(rows)
    mixed = random.Random(7).sample(rows, len(rows))
    for own, parts in ((sorted(rows, key=lambda r: -r[0]), 1), (mixed, 1), (mixed, 3)):
        frame = table(spark, own)
        out = jaccard_components(frame.coalesce(1) if parts == 1 else frame.repartition(parts)).collect()
        assert len(out) == len(rows) and all(r["component_id"] == expected[r["doc_id"]] for r in out)


def some_sets():
    rng = random.Random(1)
    sets = []
    for _ in range(8):
        base = [rng.randrange(2**63) for _ in range(rng.randint(1, 200))]
        sets += [np.array(sorted(rng.sample(base, max(1, int(len(base) * rng.uniform(0.7, 1))))), np.uint64) for _ in range(25)]
    return rng.sample(sets, len(sets))


def joined_by(links, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]


def test_trees_find_what_all_pairs_find():
    sets = some_sets()
    n = len(sets)
    linked = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    ids = np.arange(n)
    found = Forest(np.zeros(n, int), np.zeros(n, int), ids, ids, sets).search()
    assert set(found) <= linked and len(found) < n and joined_by(found, n) == joined_by(linked, n)
    across = {p for p in linked if (p[0] + p[1]) % 2}
    found = Forest(np.zeros(n, int), ids % 2, ids, ids, sets).search()
    assert set(found) <= across and joined_by(found, n) == joined_by(across, n)
    run = ids % 3  # three runs at a time, of which one is one component already
    inside = {p for p in linked if run[p[0]] == run[p[1]] != 0}
    found = Forest(run, np.zeros(n, int), ids, np.where(run == 0, -1, ids), sets).search()
    assert set(found) <= inside and joined_by(found, n) == joined_by(inside, n)


def test_links_come_through_trees(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "tree_links", lambda source, places: source.select(F.col("doc").alias("a"), F.col("doc").alias("b")).where("false"))
    rows = [r for r in near_rows() if r[0] is not None and r[0] >= 100]
    first: dict[str, int] = {}
    own = {i: first.setdefault(t, i) for i, t in rows}  # equal texts are one class without any tree
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(table(spark, rows)).collect()} == own


def test_empty_tables(spark):
    assert jaccard_components(table(spark, [])).count() == 0
    assert line_dedup(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (101, 99), (5, 5)]
    out = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {(i, 0) for i in range(41)} | {(i, 99) for i in (99, 100, 101)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_copy_that_only_a_null_id_holds(spark):
    rows = [(None, "a line of more than twenty characters"), (1, "a line of more than twenty characterz"), (2, "something else altogether, and longer")]
    out = {r["doc_id"]: list(r["dropped"]) for r in line_dedup(table(spark, rows)).collect()}
    assert out == {None: [], 1: [0], 2: []}


def test_banded_distance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abç🤗") for _ in range(rng.randint(3, 24)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        if len(b) > 2:
            pairs.append((a, "".join(b)))
    for places in ((5,), (5, 290), (0, 150, 299), ()):  # long lines whose edits stand far apart
        b = list("ab" * 150)
        for at in places:
            b[at] = "z"
        pairs += [("ab" * 150, "".join(b)), ("ab" * 150, "".join(b[1:]) + "q"), ("".join(b), "x" + "ab" * 150)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    x, y = F.split("a", ""), F.split("b", "")
    for k in (1, 2):
        out = rows.select("a", "b", within_edits(x, y, k).alias("bits"), verified(x, y, k).alias("trimmed")).collect()
        assert all(r["bits"] == r["trimmed"] == (edits(r["a"], r["b"]) <= k) for r in out)


def test_lines_brute_force(spark):
    rng = random.Random(4)
    base = [prose(i, 8) for i in range(6)] + ["nineteen characters", "twelve of it", "tenletters", "nine char", prose(20, 120)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 3))):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "Y", "🤗"])
            lines.append("".join(x))
        docs.append((i, "\n".join([*lines, "short", ""])))
    docs += [(50, None), (51, "")]
    lines = [(i, p, x) for i, t in docs if t is not None for p, x in enumerate(t.split("\n")) if x.strip()]
    head = {x: x for _, _, x in lines}
    texts = sorted(head)
    changed = True
    near = [(a, b) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, min(len(a), len(b)) // 10)]
    assert any(len(a) < 20 for a, _ in near) and any(len(a) > 500 for a, _ in near)
    while changed:
        changed = False
        for a, b in near:
            low = min(head[a], head[b])
            changed |= head[a] != low or head[b] != low
            head[a] = head[b] = low
    seen, dropped = set(), defaultdict(list)
    for i, p, x in sorted(lines):
        if head[x] in seen:
            dropped[i].append(p)
        seen.add(head[x])
    source = spark.createDataFrame([(i, t, "", "", 0, "", 0, "", "") for i, t in docs], DOCS)
    out = {r["doc_id"]: r for r in line_dedup(source).collect()}
    assert len(out) == len(docs)
    assert all(out[i]["dropped"] == dropped[i] and out[i]["n_dropped"] == len(dropped[i]) for i, _ in docs)
    assert out[50]["n_lines"] == 0 and out[51]["n_lines"] == 1
    assert sum(map(len, dropped.values())) > 10
    left = {r["doc_id"]: r["text"] for r in without_dropped_lines(source).collect()}
    assert all(left[i] == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in dropped[i]) for i, t in docs if t is not None)


def test_edge_rows_of_lines(spark):
    out = line_dedup(table(spark, edge_rows())).collect()
    assert len(out) == len({i for i, _ in edge_rows()})
