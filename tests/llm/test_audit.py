"""The filter audit against its SQL and against applying every order to every document."""

import re
from collections import defaultdict
from itertools import permutations

from tesserae.llm.filter_audit import FILTERS, filter_audit, intervals, rank_of
from tesserae.llm.queries import oracle_sql, queries
from tests.compare import same
from tests.conftest import SF
from tests.llm.fixtures import prose


def test_sql(spark, duck):
    same(queries()["op11_filter_audit"](spark, SF), duck.sql(oracle_sql()["op11_filter_audit"]))


def test_ranks_and_intervals():
    orders = list(permutations(FILTERS))
    assert [rank_of("".join(o)) for o in orders] == list(range(120))
    for mask in range(1, 32):
        for rank, order in enumerate(orders):
            first = next(k + 1 for k, c in enumerate(order) if mask >> FILTERS.index(c) & 1)
            assert [s for m, s, a, b in intervals() if m == mask and a <= rank < b] == [first]


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        own = {c for c, f in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if f}
        if i is not None and i > least[t]:
            own.add("E")
        out.append((part or "", own, i))
    return out


def brute(rows, good, toxic):
    failing, out = fails(rows), {}
    parts = {p for p, _, _ in failing}
    shapley = defaultdict(int)
    for part in parts:
        own = [(f, i) for p, f, i in failing if p == part]
        for order in map("".join, permutations(FILTERS)):
            left = list(own)
            for step, c in enumerate(order, 1):
                lost = [(f, i) for f, i in left if c in f]
                left = [(f, i) for f, i in left if c not in f]
                redundant = sum(c in f for f, _ in own) - len(lost)
                out[part, order, step] = [len(left), len(lost), redundant, sum(f == {c} for f, _ in own), sum(i in good for _, i in lost), sum(i in toxic for _, i in lost)]
                shapley[part, c] += len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_brute_force_with_edges(spark):
    base = prose(1, 250)
    rows = [
        (1, base, "x"), (2, base, "x"), (3, base, "y"), (None, base, "y"), (None, base, None), (4, None, "x"), (5, "", "x"), (6, "ABC d", "y"), (6, "ABC d", "y"),
        (7, base + " 50%", "x"), (8, "a b " * 200, "x"), (8, "a b " * 200, "y"), (9, "q" * 100_000, None), (10, "  \n ", ""), (11, prose(2, 300).upper() + "#", "y"), (11, base, "x"),
    ]
    docs = spark.createDataFrame([(*r, 1, "m", True, 0) for r in rows], "doc_id long, text string, source string, mask int, digest string, good boolean, rank int")
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (6, None, 1), (8, 0, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = filter_audit(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == brute(rows, {1, 2}, {2, 6, 8})
    assert len(got) == 3 * 600
    assert filter_audit(docs.where("false"), labels).count() == 0
    assert filter_audit(docs, labels.where("false")).agg({"good_lost": "max"}).first()[0] == 0
