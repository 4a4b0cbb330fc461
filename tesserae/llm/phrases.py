"""Phrase collocations from a weighted de Bruijn graph of words, per language.

1. Vocabulary. Words and their counts; only words that occur MIN_COUNT times can stand in a phrase, so pieces end at others.
2. Edges. An edge is a run of four words, from the node of its first three to the node of its last three. A run that a piece
   ends is filled up with END, so the edges of END are what pieces that end take out of the flow. Equal edges become one
   with a weight before they are shuffled, by node.
3. Flow. What leaves a node, END included, is the count of its three words; what leaves all nodes with the same first two
   words is the count of these two. No shorter run is counted in the texts. Nodes and edges under MIN_COUNT only add to these sums.
4. Paths. An edge has a successor if it carries all of the flow of the node between them and so does the successor. Such
   chains become one path with one weight. No chain is closed: each occurrence begins somewhere, and where it begins
   the flow is more than what comes in. Pointers double each round, so rounds grow with the logarithm of the longest path.
5. Phrases. Runs of four are windows of paths; runs of two and three come from the flow. A path tells once for each shorter
   run in it that a longer one has its weight, which decides what is dropped; then cuts are scored in decimals.

Counts of words, and words themselves, are joined by 64-bit hashes of language and word; two words with the same hash would
count as one. Where more than DICTIONARY words are frequent, they aren't sent to the tasks: hashes stand for words, and
pieces go on over rare words; the result is the same.

Defined cases: a null text is empty, a null language is `und`; ids aren't used, so repeated rows count each time; an empty table,
or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.storage import materialise, short_batches

#: A phrase occurs at least so often; the first TOP of each language are reported.
MIN_COUNT, TOP = 30, 2000
#: A phrase goes if a longer one has DOMINATED per cent of its count.
DOMINATED = 80
#: At most so many frequent words (16 MB of hashes) are sent to the tasks.
DICTIONARY = 1 << 21
#: Bytes of text whose edges are summed up before they leave a task, and words that a task holds.
PARCEL, HELD = 1 << 21, 1 << 18
#: Parts of a language that are ranked on their own before the parts' first rows are.
SALTS = 64
#: In the place of a word: the piece has ended; the sum over all words that can stand here. No word has these numbers.
END, ANY = -(1 << 63), -(1 << 63) + 1

_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
BREAK = np.zeros(256, bool)
BREAK[_BREAKS] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return short_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


class Parcel:
    """The words of some texts: key (hash of language and word), first byte, piece, language."""

    def __init__(self, rows: pa.RecordBatch, texts: list[bytes]):
        self.text = b"\n".join(texts).lower()
        hashes, self.first = words.word_hashes(self.text, WORD)
        raw = np.frombuffer(self.text, np.uint8)
        self.piece = np.searchsorted(np.flatnonzero(BREAK[raw]), self.first)
        coded = rows.column("lang").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.lang = coded.indices.to_numpy()[np.searchsorted(ends, self.first, side="right")] if len(self.first) else np.empty(0, np.int64)
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.key = np.maximum(words.mix(hashes ^ salts[self.lang]).view(np.int64), ANY + 1)

    def word(self, place: int) -> str:
        return _WORD.match(self.text, place)[0].decode()


def vocabulary(source: DataFrame) -> DataFrame:
    """id (hash), lang, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, named = [], {}

        def rows() -> pa.RecordBatch:
            own, n = (np.concatenate([x[k] for x in seen]) if seen else np.empty(0, np.int64) for k in (0, 1))
            keys, back = np.unique(own, return_inverse=True)
            told = [named[k] for k in keys.tolist()]
            counts = np.bincount(back, n, len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.string()), pa.array(counts)], names=["id", "lang", "word", "n"])

        for batch, texts in words.parcels(batches, size=PARCEL):
            p = Parcel(batch, texts)
            own, at, n = np.unique(p.key, return_index=True, return_counts=True)
            seen.append((own, n))
            for k, i in zip(own.tolist(), at.tolist(), strict=True):
                if k not in named:
                    named[k] = (p.langs[p.lang[i]], p.word(p.first[i]))
            if len(named) > HELD or len(seen) > 64:
                yield rows()
                seen, named = [], {}
        yield rows()

    rows = source.mapInArrow(run, "id long, lang string, word string, n long")
    return rows.groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"))


def edges(source: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """a, b, c, d, w: weighted runs of four words, by their places among the frequent ones (sorted) or, without these, by
    their hashes; END where the piece ends. Runs of one word are left out, as the vocabulary counts them."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in words.parcels(batches, size=PARCEL):
            p = Parcel(batch, texts)
            ids, some = p.key, np.ones(len(p.key), bool)
            if known is not None:
                ids = np.searchsorted(known, p.key)
                ids[ids == len(known)] = 0
                some = known[ids] == p.key if len(known) else np.zeros(len(ids), bool)
            n = len(ids)
            on = np.zeros(n + 3, bool)  # whether the next word goes on with the piece
            on[: max(0, n - 1)] = some[:-1] & some[1:] & (p.piece[:-1] == p.piece[1:])
            ids = np.concatenate((ids, np.full(3, END)))
            at = np.flatnonzero(on[:n])
            third = on[at + 1]
            fourth = third & on[at + 2]
            cols = [ids[at], ids[at + 1], np.where(third, ids[at + 2], END), np.where(fourth, ids[np.minimum(at + 3, n + 2)], END)]
            mixed = np.zeros(len(at), np.uint64)
            for c in cols:
                mixed = words.mix(mixed + c.view(np.uint64))
            _, one, w = np.unique(mixed, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[one]) for c in cols), pa.array(w)], names=["a", "b", "c", "d", "w"])

    return source.mapInArrow(run, "a long, b long, c long, d long, w long")


def flow(rows: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """a, b, c, d, w of at least `least`: edges, and the counts of runs of three (d: ANY) and two words (c and d: ANY).
    One shuffle by node gives edges and nodes; sums by the first two words are combined before theirs."""
    any_, end = F.lit(ANY), F.lit(END)
    c, d, heavy = F.col("c"), F.col("d"), F.col("w") >= least
    told = lambda *parts: F.explode(F.array(*parts)).alias("x")
    edge_rows = rows.repartition("a", "b", "c").groupBy("a", "b", "c", "d").agg(F.sum("w").alias("w"))
    # a node's columns pass as they are, so its sum needs no other shuffle
    of_node = told(F.struct(any_.alias("d"), "w"), F.when(heavy & (d != end), F.struct("d", "w")))
    nodes = edge_rows.select("a", "b", "c", of_node).where("x is not null").select("a", "b", "c", "x.d", "x.w").groupBy("a", "b", "c", "d").agg(F.sum("w").alias("w"))
    row = lambda c, d: F.struct(c.alias("c"), d.alias("d"), "w")
    edge = d != any_
    of_two = told(F.when(edge, row(c, d)), F.when(~edge, row(any_, any_)), F.when(~edge & heavy & (c != end), row(c, any_)))
    return nodes.select("a", "b", of_two).where("x is not null").select("a", "b", "x.*").groupBy("a", "b", "c", "d").agg(F.sum("w").alias("w")).where(heavy)


def paths(heavy: DataFrame) -> DataFrame:
    """words, w: the maximal chains of edges that carry all of the flow between them. heavy: a, b, c, d, w, as of flow()."""
    nodes = heavy.where((F.col("c") != ANY) & (F.col("d") == ANY)).select("a", "b", "c", F.col("w").alias("f"))
    own = materialise(heavy.where(F.col("d") != ANY).withColumn("id", F.xxhash64("a", "b", "c", "d")), "heavy-edges")
    # edges that bring all of the flow into their second node, and those that take all of it away
    into = own.join(nodes.toDF("b", "c", "d", "f"), ["b", "c", "d"]).where("w = f").select("b", "c", "d", F.col("id").alias("before"))
    away = own.join(nodes, ["a", "b", "c"]).where("w = f").select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), "id")
    before = into.join(away, ["b", "c", "d"]).select("id", "before")
    at = own.select("id").join(before, "id", "left").select("id", F.coalesce("before", "id").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("place"))
    at = materialise(at, "path-places")
    while True:
        jump = at.select(F.col("id").alias("head"), F.col("head").alias("to"), F.col("place").alias("by"))
        new = at.join(jump, "head").select("id", F.col("to").alias("head"), (F.col("place") + F.col("by")).alias("place"), (F.col("by") > 0).alias("moved"))
        new = materialise(new, "path-places")
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    tails = own.join(at, "id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "d"))).alias("tail"), F.first("w").alias("w"))
    heads = own.select(F.col("id").alias("head"), "a", "b", "c")
    return tails.join(heads, "head").select(F.concat(F.array("a", "b", "c"), F.col("tail.d")).alias("words"), "w")


def windows(run: Column, k: int) -> Column:
    """The runs of k neighbours in an array."""
    return F.transform(F.sequence(F.lit(1), F.size(run) - k + 1), lambda i: F.slice(run, i, k))


def candidates(heavy: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, a) of all runs of two to four words that are frequent enough, and those of them that no longer run dominates."""
    shorter = heavy.where(F.col("d") == ANY).select(F.when(F.col("c") == ANY, F.array("a", "b")).otherwise(F.array("a", "b", "c")).alias("gram"), F.col("w").alias("a"))
    fours = chains.select(F.explode(windows(F.col("words"), 4)).alias("gram"), F.col("w").alias("a"))
    grams = materialise(shorter.unionByName(fours), "phrases")
    inside = chains.select(F.explode(F.array_distinct(F.concat(windows(F.col("words"), 3), windows(F.col("words"), 2)))).alias("gram"), F.col("w").alias("f"))
    pairs = grams.where("size(gram) = 3").select(F.explode(windows(F.col("gram"), 2)).alias("gram"), F.col("a").alias("f"))
    above = inside.unionByName(pairs).groupBy("gram").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = grams.join(above, "gram", "left").where(F.col("most").isNull() | (100 * wide("most") < DOMINATED * wide("a")))
    return grams, left.select("gram", "a")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, a, l, r, score of the lowest-scoring cut; ties go to the smallest k. counts: (gram, a) of runs of one word and more."""
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    cut = cut.withColumns({"left": F.slice("gram", 1, F.col("k")), "right": F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k"))})
    both = cut.join(counts.toDF("left", "l"), "left").join(counts.toDF("right", "r"), "right")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    return both.groupBy("gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("gram", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    source = _source(docs, text_col, lang_col)
    vocab = materialise(vocabulary(source), "vocabulary")
    frequent = vocab.where(F.col("n") >= least)
    known = None
    if (size := frequent.count()) <= DICTIONARY:
        known = np.sort(np.fromiter((r[0] for r in frequent.select("id").toLocalIterator()), np.int64, size))  # 16 MB at most
        keys = docs.sparkSession.sparkContext.broadcast(known)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.set_column(0, "id", pa.array(np.searchsorted(keys.value, b.column("id").to_numpy())))

        frequent = frequent.mapInArrow(places, "id long, lang string, word string, n long")
    frequent = materialise(frequent, "frequent-words")
    heavy = materialise(flow(edges(source, known), least), "flow")
    chains = materialise(paths(heavy), "paths")
    grams, left = candidates(heavy, chains)
    counts = grams.unionByName(frequent.select(F.array("id").alias("gram"), F.col("n").alias("a")))
    found = materialise(scored(left, counts), "scored-phrases")

    spelled = found.select("gram", F.posexplode("gram").alias("place", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("gram").agg(F.min("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])).alias("phrase"))
    rows = found.join(spelled, "gram").drop("gram").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for part in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
