"""Phrase mining against its SQL and against counting every run of words."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tesserae.llm import phrases
from tesserae.llm.phrases import collocations, flow, paths
from tesserae.llm.queries import oracle_sql, queries
from tests.compare import same
from tests.conftest import SF

LEAST = 4


def test_sql(spark, duck):
    same(queries()["op13_collocations"](spark, SF), duck.sql(oracle_sql()["op13_collocations"]))


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    out = []
    for lang, own in f.items():
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        most = Counter()
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    most[g[i : i + k]] = max(most[g[i : i + k]], a)
        found = []
        for g, a in cand.items():
            if 100 * most[g] < 80 * a:
                score, k = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    vocab = [f"W{i}" for i in range(12)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(" ".join(rng.choice(vocab) + rng.choice(["", "", "", "", ".", "!\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for _ in range(60)]
    rows += [(f"{rng.choice(vocab)} {passage} {rng.choice(vocab)}", "en") for _ in range(9)]  # one long path
    rows += [("a b c a b c a b c a b c a b c", "fr"), ("loop " * 40, "fr"), (passage[:40], "fr")]  # runs that meet themselves
    rows += [(None, "en"), ("", "en"), (" \t,;", None), ("lone", "xx"), ("z" * 70000 + " z", "en"), ("straße ÜBER straße ÜBER " * 5, "de"), ("same text twice", "en"), ("same text twice", "en")]
    return rows


@pytest.mark.parametrize("dictionary", [1 << 21, 0])
def test_brute_force_with_edges(spark, monkeypatch, dictionary):
    monkeypatch.setattr(phrases, "DICTIONARY", dictionary)
    rows = corpus()
    docs = spark.createDataFrame([(i % 5, t, x, 1, "m") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, n long, word string").repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, least=LEAST, top=15).collect())
    assert got == brute(rows, LEAST, 15)
    assert collocations(docs.where("false")).count() == 0
    assert collocations(docs, least=10**6).count() == 0


def test_flow_and_paths(spark):
    """Counts of shorter runs come from edges alone; a passage becomes one path whose inner nodes carry its whole flow."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string")
    source = phrases._source(docs, "text", "lang")
    vocab = {r["id"]: (r["lang"], r["word"]) for r in phrases.vocabulary(source).collect()}
    heavy = flow(phrases.edges(source, None), LEAST)
    f, _ = counted(rows)
    want = {(x, g): a for x, own in f.items() for g, a in own.items() if len(g) in (2, 3) and a >= LEAST}
    shorter = heavy.where(f"d = {phrases.ANY}").collect()
    got = {(vocab[r["a"]][0], tuple(vocab[r[k]][1] for k in "abc" if r[k] != phrases.ANY)): r["w"] for r in shorter}
    assert got == want
    chains = [([vocab[i][1] for i in r["words"]], r["w"]) for r in paths(heavy).collect()]
    assert ([f"p{i}" for i in range(30)], 9) in chains
    fours = Counter(tuple(w[i : i + 4]) for w, _ in chains for i in range(len(w) - 3))
    assert max(fours.values()) == 1 or len({vocab[r["a"]][0] for r in heavy.collect()}) > 1
