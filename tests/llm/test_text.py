import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, pieces, words
from tesserae.llm.decontaminate import benchmark_matches, drop_contaminated
from tesserae.llm.html_extract import extract_main_text, main_text, templates
from tesserae.llm.license_scan import NOTICES, PHRASES, license_scan
from tesserae.llm.quality import RIDGE, SHRINK, feature_rows, fit, keep_quality, quality_scores, statistics
from tesserae.llm.queries import queries
from tesserae.llm.sentencepiece_codec import decode_documents, encode, encode_documents
from tesserae.llm.sharding import extendible_shards, write_shards
from tesserae.llm.token_counts import token_counts, trie_counts
from tests.conftest import SF
from tests.llm.fixtures import edge_rows, prose, table


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_words_are_hashed_alike_everywhere():
    text = ("Ünï ONE two\tone " + prose(1, 50)).encode()
    for kind, split in ((words.SPACED, lambda t: t.lower().split()), (words.ALNUM, lambda t: [w.encode() for w in alnum(t.decode())])):
        own, first = words.word_hashes(text, kind)
        plain = split(text)
        assert len(own) == len(plain) and len(set(own.tolist())) == len(set(plain))
        assert [text[a : a + len(w)].lower() for a, w in zip(first, plain, strict=True)] == plain
    big = b"aa bb " * 300_000
    assert len(set(words.word_hashes(big, words.SPACED)[0].tolist())) == 2
    texts = [b"", b"a b", b"", b"b"]
    hashes, edges = words.batch_words(texts, words.SPACED)
    assert edges.tolist() == [0, 0, 2, 2, 3] and hashes[1] == hashes[2]


def license_rows():
    filler = prose(9, 30)
    near = NOTICES[0][0].split()
    return [
        *edge_rows(), (20, "Released under the MIT License."), (21, f"{filler} CC BY-NC 4.0 {filler} cc-by.nc! under THE mit license under the mit license"),
        (22, "Licensed under the Apache License, Version 2.0."), (23, " ".join(near[:8] + ["kindly"] + near[8:])), (24, " ".join(near[:6])), (25, "under the mitt license"),
    ]


def test_license_brute_force(spark):
    rows = license_rows() + [(None, "cc by nc"), (None, "cc by nc"), (None, None), (None, "")]
    out = license_scan(table(spark, rows)).collect()
    assert len(out) == len(rows)
    expected = Counter()
    for i, t in rows:  # repeated rows and rows with a null id have a result each
        w = alnum(t)
        hits = [(p, label) for phrase, label in PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in hits]
        expected[i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == expected
    by = {r["doc_id"]: r for r in out}
    assert by[23]["labels"] == "mit" and by[23]["n_base"] == 0 and 0.8 <= by[23]["score"] <= 1
    assert by[24]["labels"] == "" and by[24]["score"] == 0 and by[21]["labels"] == "cc-by-nc,mit"
    assert license_scan(table(spark, [])).count() == 0


def test_license_templates_of_any_length(spark):
    whole = prose(21, 400).split()  # seven masks
    changed = whole[:100] + ["new", "words"] + whole[100:300] + whole[301:]
    rows = [(1, " ".join(whole)), (2, " ".join(["so"] * 9 + changed)), (3, " ".join(whole[:300])), (4, " ".join(whole[80:] + whole[:80])), (5, "short words here too"), (5, "short words here too")]
    own = spark.createDataFrame([(" ".join(whole), "long", False), ("short words here", "short", True), ("short words here", "other", True)], "text string, label string, exact boolean")
    out = sorted((r["doc_id"], r["labels"], r["n_base"], round(r["score"] * 400)) for r in license_scan(table(spark, rows), templates=own).collect())
    # a cut leaves the words beside it covered by grams of one side each
    assert out == [(1, "long", 0, 400), (2, "long", 0, 399), (3, "", 0, 0), (4, "long", 0, 320), (5, "other,short", 2, 400), (5, "other,short", 2, 400)]
    with pytest.raises(Exception, match="a template needs 3 words"):
        license_scan(table(spark, rows), templates=spark.createDataFrame([("mit license", "mit", True)], "text string, label string, exact boolean")).collect()


def test_license_on_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries()["op1_license_scan"](spark, SF).collect():
        w = " ".join(alnum(docs[r["doc_id"]]))
        assert r["n_base"] == sum(len(re.findall(rf"(?<!\S)(?={p}(?!\S))", w)) for p in PHRASES)


def test_html(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>'
        '<article><h1>Head  &amp; more</h1><p>One<b>two</b>\n three<p>Four<br>five<script>x("</p>")</script><div class="comments"><p>No</p></div>'
        "<form>Sign</form><ul><li>a<li>b</ul></article><aside>Side</aside><footer>&copy; x</footer></body></html>"
    )
    text = "Head & more\nOnetwo three\nFour five\na\nb"
    assert main_text(page, None) == text
    rows = [(i, f"https://h.example/{i}", page.replace("three", f"w{i}")) for i in range(6)] + [(7, None, None), (8, "x", ""), (9, "http://one.example", "<p>only"), (9, "http://one.example", "<p>only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = extract_main_text(pages).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in out) == Counter(
        [(i, text.replace("three", f"w{i}"), len(text) - 5 + 2) for i in range(6)] + [(7, "", 0), (8, "", 0), (9, "only", 4), (9, "only", 4)]
    )
    from tesserae.llm.html_extract import host

    own = templates(pages.select(F.col("page_id").alias("page"), host(F.col("url")).alias("host"), "html"))
    assert {r["host"] for r in own.collect()} == {"h.example"}
    assert extract_main_text(pages.limit(0)).count() == 0


def test_html_comments_and_teasers_are_no_article(spark):
    inner = (
        '<article><h1>Head</h1><p>Text {}</p></article><section class="comments"><article class="comment"><p>Reply {}</p></article></section>'
        '<aside class="related"><article><p>Teaser {}</p></article></aside>'
    )
    nested = '<article><p>Text {}</p><div class="comments"><article><p>Reply {}</p></article></div><aside><div class="post"><p>Teaser {}</p></div></aside></article>'
    for page, text in ((inner, "Head\nText {}"), (nested, "Text {}"), (f'<div class="page-sidebar"><main>{inner}</main></div>', "Head\nText {}")):
        page = f'<html><body class="has-sidebar">{page}</body></html>'
        assert main_text(page.format(1, 2, 3), None) == text.format(1)
        # a host whose pages have the same number of comments and teasers, all of them in its template
        rows = [(i, f"https://h.example/{i}", page.format(f"a{i}", f"b{i}", f"c{i}")) for i in range(5)]
        out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {i: text.format(f"a{i}") for i in range(5)}


def test_html_slots_and_names_of_one_page(spark):
    plain = "<html><body><div><p>Welcome to the site</p></div><div><p>Text {0}</p><p>More {0}</p></div><div><p>All rights</p></div><p>See also</p></body></html>"
    named = '<html><body class="postid-{0} slug-{0}"><div class="box"><p>Hint {0}</p></div><article id="post-{0}"><h1>Head</h1><p>Text {0}</p></article><p>End</p></body></html>'
    empty = '<html><body><div class="entry"><p>Fixed words</p></div><div><p>Text {0}</p></div><p>End</p></body></html>'
    for page, text in ((plain, "Text {0}\nMore {0}"), (named, "Head\nText {0}"), (empty, "Text {0}")):
        rows = [(i, f"https://h.example/{i}", page.format(f"w{i}")) for i in range(5)]
        out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {i: text.format(f"w{i}") for i in range(5)}


def test_html_names_count_on_containers_only():
    for inner, text in (
        ('<p class="market share">Prices rose', "Prices rose"), ('<section id="notice-board"><p>News</section>', "News"), ('<h1 class="banner">Title</h1>', "Title"),
        ('<p class="tags-explained">On tags', "On tags"), ('<p>Text <span class="ad">Buy now</span>goes on', "Text goes on"), ("<p>Text <button>Subscribe</button>goes on", "Text goes on"),
        ("<label>Mail<input></label><p>Text", "Text"), ('<p>whole paragraph <b class="promo">x<p>next', "whole paragraph x\nnext"), ('<div class="share-box-2">Share</div><p>Text', "Text"),
        ('<p class="advert">Buy</p><p>Text', "Text"), ('<div class="post-comments"><p>Reply</div><p>Text', "Text"),
    ):
        assert main_text(f'<body><div class="layout has-sidebar"><article>{inner}</article></div><div class="td-cookie-law">Cookies</div></body>', None) == text


def test_html_repeated_blocks_of_a_large_host(spark):
    page = '<html><body><div class="x1">Menu</div><article><h2>Story {0}</h2><div class="x9">Share this story with friends</div><p>Text {0} and more of it</p><p>{1}</p></article><p>End</p></body></html>'
    linked = '<html><body><div class="m"><p>Home</p></div><div class="r"><a href="/{0}">Read next: story {0}</a></div><div class="t"><p>Text {0}</p></div><p>All rights</p></body></html>'
    rows = [(i, "http://a.example/x", page.format(f"w{i}", "A passage that half of the pages share" if i % 2 else f"v{i}")) for i in range(30)]
    rows += [(100 + i, "http://b.example/x", "<html><body><div>Menu</div><article><p>One and the same article</p></article><p>End</p></body></html>") for i in range(12)]
    rows += [(200 + i, "http://c.example/x", linked.format(f"w{i}")) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("names", F.lit("x")).withColumn("steady", F.lit("y"))
    out = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    for i in range(30):  # the template takes the repeated block out; a passage of half of the pages stays
        last = "A passage that half of the pages share" if i % 2 else f"v{i}"
        assert out[i] == f"Story w{i}\nText w{i} and more of it\n{last}"
        assert main_text(rows[i][2], None) == f"Story w{i}\nShare this story with friends\nText w{i} and more of it\n{last}"
    assert {out[100 + i] for i in range(12)} == {"One and the same article"}
    assert [out[200 + i] for i in range(9)] == [f"Text w{i}" for i in range(9)]


def plain_template(pages):
    """The template's tokens of one host's pages, by whole occurrence vectors."""
    from tesserae.llm.html_extract import CLASS_PAGES, CLASS_SHARE, CLASS_TOKENS, Roles, walk

    role = Roles(None)
    rows = [[t for kind, _, text, path in walk(p) if (t := role(kind, path, text)) is not None] for p in pages]
    vectors = {t: tuple(r.count(t) for r in rows) for r in rows for t in r}
    classes = {}
    for t, v in vectors.items():
        if sum(map(bool, v)) >= max(CLASS_PAGES, CLASS_SHARE * len(pages)):
            classes.setdefault(v, []).append(t)
    ordered = {
        v: own for v, own in classes.items()
        if len(own) >= CLASS_TOKENS and len({tuple(dict.fromkeys(t for t in r if t in own)) for r in rows if own[0] in r}) == 1
    }
    if not ordered:
        return set()
    frame = max(ordered, key=lambda v: (sum(map(bool, v)), len(ordered[v])))
    out = set(ordered[frame])
    for v, own in ordered.items():
        slots = {sum(t in ordered[frame] for t in dict.fromkeys(r[: r.index(x)])) for r in rows for x in own if x in r and ordered[frame][0] in r}
        if v != frame and len(slots) == 1:
            out |= set(own)
    return out


def test_html_classes_brute_force(spark):
    rng = random.Random(5)
    hosts = {}
    for h in range(6):
        part = lambda i, h=h: "".join(f"<p>{w} {i}</p>" for w in rng.sample("abcdef", rng.randint(1, 4)))
        box = lambda: rng.choice(["", "<ul><li>one</li><li>two</li></ul>"])
        hosts[f"h{h}"] = [f"<html><body><div><h2>Top</h2></div>{box()}<section>{part(i)}<h3>Mid</h3>{part(i)}</section>{'<ol><li>x' if i % 3 else ''}<h4>End</h4></body></html>" for i in range(rng.randint(3, 9))]
    rows = [(j * 100 + i, h, p) for j, (h, pages) in enumerate(hosts.items()) for i, p in enumerate(pages)]
    out = {r["host"]: set(r["template"]) for r in templates(spark.createDataFrame(rows, "page long, host string, html string")).collect()}
    assert any(out.values()) and {h: out.get(h, set()) for h in hosts} == {h: plain_template(pages) for h, pages in hosts.items()}


def test_alignment_is_a_longest_run():
    from tesserae.llm.html_extract import aligned

    assert aligned([14, 10, None, 11, 99, 12, 11, 13], {10: 0, 11: 1, 12: 2, 13: 3, 14: 4}) == {10, 11, 12, 13}
    assert aligned([], {1: 0}) == set()


def test_html_on_pages(spark):
    from html import unescape

    for r in queries()["op2_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_written_shards(spark, tmp_path):
    rows = edge_rows() + [(None, "no id"), (None, "no id"), (3, "again " * 30), (3, "again " * 30)]
    docs = table(spark, rows).withColumn("shard", F.lit("own"))
    write_shards(docs, f"{tmp_path}/out", 200)
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    assert [r[0] for r in back.select("shard_").distinct().collect()] == ["own"]
    sizes = back.groupBy("shard", "part").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["b"] <= 200 or r["n"] == 1 for r in sizes)


def test_shards(spark):
    rows = edge_rows() + [(100 + i, prose(i, 100)) for i in range(200)] + [(7, "z" * 900)] * 20
    for limit in (2000, 10**9):
        out = extendible_shards(table(spark, rows), limit).collect()
        assert len(out) == len(rows)
        size, count = Counter(), Counter()
        for r in out:
            size[r["shard"], r["part"]] += r["bytes"]
            count[r["shard"], r["part"]] += 1
        assert all(size[k] <= limit or count[k] == 1 for k in size)
        names = {r["shard"] for r in out}
        assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert extendible_shards(table(spark, []), 10).count() == 0


def brute_matches(docs, items):
    out = {}
    own = [(i, alnum(t)) for i, t in items]
    for d, t in docs:
        w = alnum(t)
        for i, x in own:
            k = min(5, len(x))
            if not x or d is None:
                continue
            a = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            g = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            span = min(len(g), len(x) - k + 1)
            for s in range(len(g) - span + 1) if g else ():
                b = Counter(g[s : s + span])
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.75:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_contamination(spark, monkeypatch):
    items = [(1, prose(50, 30)), (2, prose(51, 18)), (3, None), (4, "!!"), (5, "Three Words only"), (6, prose(50, 30)), (None, prose(52, 20))]
    x = prose(50, 30).split()
    docs = edge_rows() + [
        (30, prose(60, 40) + " " + prose(50, 30).upper() + ", " + prose(61, 40)), (31, " ".join(x[:27] + ["new"] + x[27:])), (32, " ".join(x[:15])),
        (33, " ".join(x[2:])), (34, "so three words, only!"), (35, prose(51, 18) + ". " + prose(50, 30)), (None, prose(50, 30)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (2000, 0):  # 0: index and items are joined by shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_ITEMS", limit)
        monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", limit)
        monkeypatch.setattr(decontaminate, "MOST_SLOTS", 26 if limit else 8)  # 8: bitmaps too small to tell grams apart
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in benchmark_matches(table(spark, docs), bench).collect()}
        assert got == pytest.approx(brute_matches(docs, items))
    gone = {d for d, _ in got}
    assert gone == {30, 31, 33, 34, 35}
    left = drop_contaminated(table(spark, docs), bench)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in docs if i not in gone)
    assert benchmark_matches(table(spark, docs), bench.limit(0)).count() == 0 and benchmark_matches(table(spark, []), bench).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()


def test_quality_equals_a_plain_discriminant(spark):
    """Densities of two normal distributions from rows in memory, with inverse matrices and determinants."""
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    x = {r["doc_id"]: statistics((r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    own = [np.stack([x[i] for i in y if y[i] == c and i in x]) for c in (0, 1)]
    n = [len(o) for o in own]
    pooled = np.diag(sum(len(o) * o.var(axis=0) for o in own) / sum(n)) + 1e-6 * np.eye(own[0].shape[1])
    covariance = [(1 - SHRINK) * np.cov(o.T, bias=True) + (SHRINK + RIDGE) * pooled for o in own]

    def density(v, c):
        d = v - own[c].mean(axis=0)
        return -0.5 * (d @ np.linalg.inv(covariance[c]) @ d + np.log(np.linalg.det(covariance[c]))) + np.log(n[c])

    for r in quality_scores(docs, labels).collect():
        v = x[r["doc_id"]]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -500, 500))), abs=1e-6)


def test_quality_learns_from_its_rows_only(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from tesserae.llm.quality import held_out

    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fit(feature_rows(docs), x) for x in (labels, other))
    assert np.allclose(a.means, b.means) and np.isclose(a.odds, b.odds)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_scores(table(spark, edge_rows()), none).collect()
    assert len(out) == len(edge_rows()) and {r["score"] for r in out} == {0.5}
    assert quality_scores(table(spark, []), none).count() == 0
    some = spark.createDataFrame([(i, i % 2, None) for i in range(1, 9)] + [(9, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality_scores(table(spark, edge_rows()), some).collect()) == len(edge_rows())


def strings():
    rng = random.Random(5)
    kinds = string.ascii_letters + "     ..,,\n\n\t'\"日本é🤗ß-=*#/_<>0123456789"
    own = ["".join(rng.choice(kinds) for _ in range(rng.randint(1, 150))) for _ in range(500)]
    return own + [" " * k for k in range(1, 40)] + ["=" * k for k in range(1, 60)] + ["ab" * 400, "", "<s>", "<0x0A>", "x" * 3000 + " y"]


def test_pieces_equal_the_library():
    import sentencepiece

    path = pieces.default_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = pieces.vocabulary(path)
    split = lambda t: pieces.SEGMENT.findall(pieces.prepared(t))
    counts = {w: (n, score) for w, n, score in trie_counts(vocab, [s for t in strings() for s in split(t)])}
    for t in strings():
        ids = encode(t, path).tolist()
        assert ids == library.encode(t)
        assert sum(counts[s][0] for s in split(t)) == len(ids)
        if all(c in vocab.id_of for c in pieces.prepared(t)):
            assert sum(counts[s][1] for s in split(t)) == pytest.approx(sum(vocab.score[i] for i in ids))


def test_memory_keeps_what_comes_up_again():
    known = words.Memory(entries=3)
    for k in ("a", "b", "c", "d", "e"):
        known.put(k, k)
        assert known.missing(["a", k]) == []
    assert known.missing("abcdef") == ["f"] and len(known.young) <= 6
    long = words.Memory(characters=10)
    for k in ("x" * 20, "y" * 20, "z" * 20):
        long.put(k, 1)
    assert long.missing(["x" * 20]) == ["x" * 20]


def test_stream_commits_what_the_whole_text_gives():
    vocab = pieces.vocabulary(pieces.default_path())
    text = " " + prose(3, 400).replace(" ", "")
    parts = list(vocab.stream(text))
    assert len(parts) > 20 and sum(parts, []) == vocab.merge(text)
    assert max(map(len, parts)) < 4 * vocab.longest


def test_stream_commits_on_documents(spark):
    """Pre-tokens of the table itself are longer than the window, and equal the library's pieces."""
    import sentencepiece

    vocab = pieces.vocabulary(pieces.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("text is not null").collect()]
    commits = sum(len(list(vocab.stream(s))) - 1 for s in {s for t in texts for s in pieces.SEGMENT.findall(pieces.prepared(t))})
    assert commits > 0
    for t in texts:
        assert encode(t, pieces.default_path()).tolist() == library.encode(t)


def test_unigram_rule():
    vocab = pieces.Vocabulary(pieces.default_path(), "unigram")
    vocab.id_of = {" ": 0, "a": 1, "b": 2, "ab": 3, "abab": 4, "ba": 5}
    vocab.score = [-1.0, -2.0, -2.0, -3.0, -7.0, -2.5] + [0.0] * vocab.size
    vocab.longest = 4

    def best(text):
        top = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            top[j] = max(top[i] + vocab.score[vocab.id_of[text[i:j]]] for i in range(max(0, j - 4), j) if text[i:j] in vocab.id_of)
        return top[-1]

    rng = random.Random(1)
    for _ in range(100):
        text = " " + "".join(rng.choice("ab") for _ in range(rng.randint(1, 120)))
        ids = [i for part in vocab.stream(text) for i in part]
        assert sum(vocab.score[i] for i in ids) == pytest.approx(best(text))
        ((_, n, score),) = trie_counts(vocab, [text])
        assert n == len(ids) and score == pytest.approx(best(text))


def test_encode_documents(spark):
    rows = edge_rows() + [(40, "a▁b")]
    out = encode_documents(table(spark, rows), with_text=True).collect()
    assert len(out) == len(rows)
    assert all(r["round_trip"] == (r["doc_id"] != 40) and r["n_tokens"] == len(r["ids"]) for r in out)
    assert Counter(r["decoded"] for r in out if r["doc_id"] != 40) == Counter(t or "" for i, t in rows if i != 40)
    back = decode_documents(encode_documents(table(spark, rows)))
    assert Counter(r["text"] for r in back.collect()) == Counter((t or "").replace("▁", " ") for _, t in rows)
    counts = {(r["doc_id"], r["n_tokens"]) for r in token_counts(table(spark, rows)).collect()}
    assert counts == {(r["doc_id"], r["n_tokens"]) for r in out}
    assert encode_documents(table(spark, [])).count() == 0 and token_counts(table(spark, [])).count() == 0
