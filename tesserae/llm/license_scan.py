"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined to the positions of the templates' k-grams. A hit votes for
the diagonal (place in text - place in template); votes are added up per diagonal as bit masks of the template words
that they cover, one mask for each 63 words of the template; neighbouring diagonals are merged, and a span is verified
by the share of the template's words that it covers.

Defined cases: null text is empty; a text without words has n_words 0, no labels and score 0; every row gives one result
row, rows that repeat others or have a null id too. Templates have any length of k words and more; shorter ones and null
texts of templates are an error, since no gram can vote for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.storage import materialise, short_batches

K = 3
#: Diagonals at most this far apart are one match with words put in or left out.
NEIGHBOUR = 3
#: Share of a template's words that a span has to cover, for templates that allow changes.
COVER = 0.8
#: Words of a template in one mask.
MASK = 63
#: Up to so many grams of templates (about 100 bytes each) are sent to all executors; with more, grams are joined by shuffle.
BROADCAST_GRAMS = 100_000
#: Result rows of one repeated row that are written from one task's row.
REPEATS = 10_000

# Phrases that are matched whole, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of public licences that are matched with small changes, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you should have received a copy of the gnu lesser general public license along with this library", "lgpl"),
    ("you should have received a copy of the gnu affero general public license along with this program", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """text, label, exact: the lists above."""
    return spark.createDataFrame([(p, x, True) for p, x in PHRASES.items()] + [(t, x, False) for t, x in NOTICES], "text string, label string, exact boolean")


def template_grams(templates: DataFrame, k: int = K) -> DataFrame:
    """gram, template, place, size (words), label, exact: a row for each place of each template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            for i, text in enumerate(texts):
                hashes = words.word_hashes(text, words.ALNUM)[0]
                if len(hashes) < k:
                    raise ValueError(f"a template needs {k} words at least: {text[:80]!r}")
                own = words.signed(words.grams(hashes, k))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own),
                        pa.array(np.full(n, hash_text(text), np.int64)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(np.full(n, len(hashes), np.int32)),
                        pa.array(rows.column("label").slice(i, 1).to_pylist() * n, pa.string()),
                        pa.array(rows.column("exact").slice(i, 1).to_pylist() * n, pa.bool_()),
                    ],
                    names=["gram", "template", "place", "size", "label", "exact"],
                )

    # a text may stand for several labels; the template's number tells them apart
    found = templates.select("text", "label", "exact").distinct().mapInArrow(run, "gram long, template long, place int, size int, label string, exact boolean")
    return found.withColumn("template", F.xxhash64("template", "label", "exact"))


def document_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text_key, n_words and the array of all rolling k-gram hashes of the whole text, behind a null that stands for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            hashes, edges = words.batch_words(texts, words.ALNUM)
            own = [np.concatenate((np.zeros(1, np.uint64), words.grams(hashes[a:b], k))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            sizes = np.fromiter(map(len, own), np.int32, len(own))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            flat = words.signed(np.concatenate(own)) if own else np.empty(0, np.int64)
            none = np.zeros(len(flat), bool)
            none[ends[:-1]] = True
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([hash_text(t) for t in texts], pa.int64()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=none)),
                ],
                names=["doc_id", "text_key", "n_words", "grams"],
            )

    source = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, text_key long, n_words long, grams array<long>")


def hash_text(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def license_spans(grams: DataFrame, k: int = K, templates: DataFrame | None = None) -> DataFrame:
    """Per document and diagonal: template, label, exact, first word, covered share; for each text a row without template that
    counts the rows that hold it."""
    own = template_grams(default_templates(grams.sparkSession) if templates is None else templates, k)
    if templates is not None:
        own = materialise(own, "template-grams")
    few = templates is None or own.count() <= BROADCAST_GRAMS
    covered = F.explode_outer(F.expr(f"sequence(place, place + {k - 1})"))
    text = ["doc_id", "text_key", "n_words"]
    template = ["template", "size", "label", "exact"]
    hits = (
        grams.select(*text, F.posexplode("grams").alias("at", "gram"))
        .join(F.broadcast(own) if few else own, "gram", "left")
        .select(*text, *template, (F.col("at") - 1).alias("at"), "place", covered.alias("word"))
        .groupBy(*text, *template, (F.col("at") - F.col("place")).alias("diagonal"), F.expr(f"word div {MASK}").alias("part"))
        .agg(
            F.expr(f"bit_or(shiftleft(1L, word % {MASK}))").alias("mask"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.count_if(F.col("at") < 0).alias("rows"),
        )
    )
    # neighbouring diagonals of one template in one text become one match: they would have it begin within a few words, so
    # they belong to one place, in whatever order words were put in and left out. The parts of a diagonal come first.
    spans = hits.groupBy(*text, *template, "diagonal").agg(
        F.collect_list(F.struct("part", "mask")).alias("masks"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("rows").alias("rows")
    )  # a diagonal has a mask for each 63 words of its template
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= NEIGHBOUR) & ~F.col("exact")
    merged = (
        spans.withColumn("new", F.when(near, 0).otherwise(1))
        .withColumn("match", F.sum("new").over(order))
        .select(*text, *template, "match", "first_at", "last_at", "rows", F.inline("masks"))
        .groupBy(*text, *template, "match", "part")
        .agg(F.expr("bit_or(mask)").alias("mask"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("rows").alias("rows"))
        .groupBy(*text, *template, "match")
        .agg(F.sum(F.bit_count("mask")).alias("words"), F.min("first_at").alias("first"), (F.max("last_at") + F.lit(k)).alias("end"), F.sum("rows").alias("rows"))
    )
    return merged.withColumn("cover", F.col("words") / F.col("size"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, cover: float = COVER, templates: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: text, label and exact (matched whole, and counted as base places); the lists of this module if None."""
    spans = license_spans(document_grams(docs, id_col, text_col, k), k, templates)
    found = F.col("template").isNotNull() & F.when(F.col("exact"), F.col("cover") == 1).otherwise(F.col("cover") >= cover)
    base = F.coalesce(found & F.col("exact"), F.lit(False))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"),
        names(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sum("rows").alias("rows"),
    )
    # equal rows were counted on the way, and come back as many times
    each = out.withColumn("_from", F.explode(F.expr(f"sequence(0L, rows - 1, {REPEATS}L)"))).withColumn("_row", F.explode(F.expr(f"sequence(_from, least(_from + {REPEATS}, rows) - 1)")))
    return each.drop("text_key", "rows", "_from", "_row")
