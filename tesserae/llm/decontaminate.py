"""Benchmark decontamination by SimHash windows and a multi-index.

A benchmark item of w words is compared with windows of w words (of the whole text where that is shorter).
Windows in which fewer than 3/4 of the item's number of shingles belong to any item of that size can't reach a
similarity of 3/4 and are left out; the others get a SimHash. Fingerprints are split into eight blocks, and the
items' blocks are indexed with all their variants of up to two changed bits: a window and an item at most RADIUS =
8 * 3 - 1 bits apart agree with a variant in some block, so the index finds all of them. The weighted Jaccard
similarity (shingles weigh as often as they occur) of each candidate is then computed exactly.

All texts are read once, whatever the size of the benchmark. Tasks hold bitmaps of its grams, of bounded size, for the
first tests; the index and the items' grams are broadcast up to a checked size and joined by shuffle beyond it.

Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z become a-z. A shingle has five words; items
with fewer are one shingle and match equal words only.

Defined cases: null and empty texts and items without words match nothing; equal items match separately; rows that
repeat an id are one document; rows with a null id can't be named and are neither reported nor dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.storage import materialise, short_batches

K = 5
SIMILARITY = 0.75
RADIUS = 23
#: A bitmap has at most 2 ** MOST_SLOTS bits (8 MB).
MOST_SLOTS = 26
#: Items whose index (296 entries each) and grams that are broadcast at most (25 MB and 32 MB).
BROADCAST_ITEMS, BROADCAST_GRAMS = 2000, 4_000_000
_FLIPS = [0, *(1 << i for i in range(8)), *((1 << i) | (1 << j) for i, j in combinations(range(8), 2))]


def size_of_shingle(w: int, k: int = K) -> int:
    return min(w, k)


def signs(grams: np.ndarray) -> np.ndarray:
    """A row of 64 values, 1 or -1, for each gram."""
    return np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger numbers of occurrences."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    least = np.minimum(ca[ia], cb[ib]).sum()
    return float(least / (len(a) + len(b) - least))


def item_rows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, w, grams, print of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            own = [words.word_hashes(t, words.ALNUM)[0] for t in texts]
            keep = [i for i, x in enumerate(own) if len(x)]
            grams = [words.grams(own[i], size_of_shingle(len(own[i]))) for i in keep]
            prints = [fingerprints(signs(g).sum(axis=0)[None, :])[0] for g in grams]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("item").take(pa.array(keep, pa.int64())),
                    pa.array([len(own[i]) for i in keep], pa.int32()),
                    pa.array([words.signed(g).tolist() for g in grams], pa.list_(pa.int64())),
                    pa.array(words.signed(np.array(prints, np.uint64))),
                ],
                names=["item", "w", "grams", "print"],
            )

    source = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "item long, w int, grams array<long>, print long")


def slot_bits(n_grams: int) -> int:
    """log2 of the slots of a bitmap: 64 per gram up to MOST_SLOTS; beyond it more windows pass the first tests, and none is lost."""
    return min(MOST_SLOTS, max(16, (64 * n_grams - 1).bit_length()))


def _of_size(grams: np.ndarray, w: int) -> np.ndarray:
    return words.mix(grams ^ np.uint64(w * 0x9E3779B97F4A7C15 % 2**64))


def slot_maps(items: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Bitmaps of the slots that items' grams use: one per shingle size, and under 0 one of grams with their item's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, grams in zip(b.column("w").to_pylist(), b.column("grams"), strict=True):
                g = grams.values.to_numpy().view(np.uint64)
                for kind, x in ((size_of_shingle(w), g), (0, _of_size(g, w))):
                    slots = (x & np.uint64((1 << bits) - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), kind, np.int32)), pa.array(slots)], names=["kind", "slot"])

    used = items.select("w", "grams").mapInArrow(run, "kind int, slot long").groupBy("kind", F.expr("shiftright(slot, 6)").alias("word"))
    maps = {k: np.zeros(1 << (bits - 6), np.uint64) for k in (0, *range(1, K + 1))}
    for r in used.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toLocalIterator():  # at most 2 ** (bits - 6) rows a map
        maps[r["kind"]][r["word"]] = r["bits"] & (2**64 - 1)
    return {k: m for k, m in maps.items() if m.any()}


def windows(source: DataFrame, maps: dict[int, np.ndarray], sizes: list[int], bits: int) -> DataFrame:
    """doc, first, w, print, grams of the windows that may match an item of one of the sizes."""
    by_k = {k: [w for w in sizes if size_of_shingle(w) == k] for k in sorted(maps) if k}
    low = np.uint64((1 << bits) - 1)

    def among(used: np.ndarray, x: np.ndarray) -> np.ndarray:
        slot = x & low
        return (used[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def of_text(own: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for k, of_k in by_k.items():
            grams = words.grams(own, k)
            at = np.flatnonzero(among(maps[k], grams))
            if len(at) >= SIMILARITY * (min(of_k) - k + 1):
                for w in of_k:
                    yield from of_size(grams, at, w, k)

    def of_size(grams: np.ndarray, at: np.ndarray, w: int, k: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        least = SIMILARITY * (w - k + 1)
        if len(at) >= least:
            at = at[among(maps[0], _of_size(grams[at], w))]
        if len(at) >= least:
            span = min(w - k + 1, len(grams))
            hits = np.zeros(len(grams) + 1, np.int64)
            hits[at + 1] = 1
            hits = np.cumsum(hits)
            firsts = np.flatnonzero(hits[span:] - hits[: len(hits) - span] >= least)
            for run in np.split(firsts, np.flatnonzero(np.diff(firsts) > span) + 1) if len(firsts) else []:
                near = grams[run[0] : run[-1] + span]
                total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs(near), axis=0)))
                prints = fingerprints(total[run - run[0] + span] - total[run - run[0]])
                for first, value in zip(run.tolist(), prints, strict=True):
                    yield first, w, value, grams[first : first + span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            hashes, edges = words.batch_words(texts, words.ALNUM)
            found = [(doc, *x) for doc, a, b in zip(rows.column("doc").to_pylist(), edges[:-1], edges[1:], strict=True) if doc is not None for x in of_text(hashes[a:b])]
            if found:
                doc, first, w, value, grams = zip(*found, strict=True)
                ends = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in grams]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(w, pa.int32()), pa.array(words.signed(np.array(value, np.uint64))), pa.ListArray.from_arrays(ends, pa.array(words.signed(np.concatenate(grams))))],
                    names=["doc", "first", "w", "print", "grams"],
                )

    return source.mapInArrow(run, "doc long, first long, w int, print long, grams array<long>")


def _block(column: str, b: str):
    return F.expr(f"cast(shiftright({column}, 8 * {b}) & 255 AS int)")


def candidates(found: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """Windows and items of the same size within RADIUS bits, each pair once."""
    index = items.select("item", "w", F.col("print").alias("item_print"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    index = index.withColumn("flip", F.explode(F.array(*map(F.lit, _FLIPS)))).withColumn("key", _block("item_print", "b").bitwiseXOR(F.col("flip"))).drop("flip")
    probes = found.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("key", _block("print", "b"))
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    # a pair that agrees in several blocks is taken at the first
    first = F.expr("b = array_position(transform(sequence(0, 7), i -> bit_count(shiftright(print ^ item_print, 8 * i) & 255) <= 2), true) - 1")
    return probes.join(F.broadcast(index) if n_items <= BROADCAST_ITEMS else index, ["w", "b", "key"]).where((F.bit_count(apart) <= RADIUS) & first).drop("b", "key", "print", "item_print")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, first_word, n_words, windows."""
    source = short_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    items = materialise(item_rows(benchmark, item_col, item_text), "benchmark-items")
    size = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("grams"), F.sort_array(F.collect_set("w")).alias("sizes")).first()
    bits = slot_bits(size["grams"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = (b.column(c) for c in ("grams", "item_grams"))
            found = [weighted_jaccard(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", "item", "first", "w")), pa.array(found, pa.float64())], names=["doc", "item", "first", "w", "similarity"])

    found = windows(source, slot_maps(items, bits), size["sizes"], bits)
    wanted = items.select("item", F.col("grams").alias("item_grams"))
    near = candidates(found, items, size["items"]).join(F.broadcast(wanted) if size["grams"] <= BROADCAST_GRAMS else wanted, "item")
    near = materialise(near.select("doc", "item", "first", "w", "grams", "item_grams"), "candidates")  # no task runs two Python workers
    out = near.mapInArrow(similar, "doc long, item long, first long, w int, similarity double").where(F.col("similarity") >= SIMILARITY)
    best = F.struct(-F.col("similarity"), F.col("first"))
    return out.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("similarity").alias("similarity"), F.min_by("first", best).alias("first_word"), F.first("w").cast("long").alias("n_words"), F.count(F.lit(1)).alias("windows")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns. Rows that share an id go together; rows without an id stay."""
    gone = benchmark_matches(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
