"""The LSH forest against its SQL and against comparing all pairs, with regions and blocks so small that all are cut."""

import random
import re

import numpy as np
import pytest

from tesserae.llm import lsh_forest
from tesserae.llm.lsh_forest import group_links, near_components, signatures
from tesserae.llm.queries import oracle_sql, queries
from tests.compare import same
from tests.conftest import SF
from tests.llm.fixtures import edge_rows, prose, table


def test_sql(spark, duck):
    same(queries()["op12_near_dedup"](spark, SF), duck.sql(oracle_sql()["op12_near_dedup"]))


def brute(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is None:
            continue
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        parent[i] = i
        sets.setdefault(i, []).append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    rng = random.Random(7)
    base = prose(5, 100).split()
    rows = [(100 + i, edited(rng, base, rng.randint(0, 9))) for i in range(90)]  # some link to none, some only to a few
    drift = list(base)
    for i in range(60):  # a chain: neighbours are alike, ends aren't
        drift[rng.randrange(len(drift))] = f"y{i}"
        rows.append((300 + i, " ".join(drift)))
    rows += [(400 + i, prose(6, 60) + " " + prose(500 + i, 60)) for i in range(30)]  # a passage that many hold
    rows += [(600 + i, w) for i, w in enumerate(["hot", "hot", "hot pot", "hot pot pot", "Hot POT"])]
    return rows + edge_rows()


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("REGION", 6), ("BLOCK", 5), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(lsh_forest, name, value)
    rows = near_rows()
    random.Random(1).shuffle(rows)
    out = near_components(table(spark, rows).repartition(3)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    by = {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] not in (None, 8)}
    assert by[1] == by[2] == by[3] == 0 and by[4] == by[5] == 1 and by[600] == 1 and by[603] == 2


def test_empty_table(spark):
    assert near_components(table(spark, [])).count() == 0
    assert [tuple(r) for r in near_components(table(spark, [(3, None), (None, None)])).orderBy("doc_id").collect()] == [(None, 0, None, True), (3, 0, 3, True)]


def test_group_links_and_labels():
    rng = np.random.default_rng(0)
    base = rng.choice(1 << 40, 200, replace=False).astype(np.uint64)
    sets = [np.sort(np.concatenate((base[: 200 - k], rng.choice(1 << 40, k).astype(np.uint64)))) for k in (0, 5, 10, 90, 95, 200)]

    def joined(found):
        label = list(range(len(sets)))
        for i, j in found:
            label = [label[i] if x == label[j] else x for x in label]
        return [[a == b for b in label] for a in label]

    all_pairs = [(i, j) for i in range(6) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert joined(group_links(sets, np.arange(6))) == joined(all_pairs)
    assert group_links(sets, np.zeros(6, int)) == []


def test_signature_agreement():
    """Values agree as often as sets are alike, so that CUTOFF is more than five deviations away from the threshold."""
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, 20, dtype=np.uint64)))) for _ in range(2))  # 160 of 200
        sig = signatures(np.concatenate((a, b)), np.array([0, len(a)]))
        agree.append(int((sig[0] == sig[1]).sum()))
    assert abs(np.mean(agree) - 102.4) < 1.5 and min(agree) >= lsh_forest.CUTOFF
