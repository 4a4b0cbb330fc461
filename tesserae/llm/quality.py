"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled diagonal. The score is the logistic of
the difference of the classes' log densities (Mahalanobis distances through cached Cholesky factors) plus the
log odds of the labels. Means and covariances come from sums that Spark adds up over all labelled rows.

Defined cases: null text is empty, and empty texts are scored like any other; rows with a null id are scored and
have no label; labels with a null quality are left out and repeated labels count each time; when a class has
fewer than two labels, every score is (n1 + 1) / (n + 2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.storage import materialise, semi_by_key, short_batches

#: Weight of the pooled diagonal in a class covariance, and of the pooled variance added for stability.
SHRINK, RIDGE = 0.1, 0.02
CUT = 0.7

_KIND = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 white space, 5 sentence mark, 6 other ASCII, 7 beyond ASCII
_KIND[:128] = 6
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[32, *range(9, 14)]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_MARKS = [ord(c) for c in "!|"]


def statistics(text: bytes) -> np.ndarray:
    """Transformed statistics of one text; see FEATURES for their order."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    # counted in pieces: bincount widens its input to 64 bits
    kinds = sum((np.bincount(_KIND[raw[i : i + words.PIECE]], minlength=8) for i in range(0, len(raw), words.PIECE)), np.zeros(8, np.int64))
    letters = max(1, kinds[1] + kinds[2])
    own, first = words.word_hashes(text, words.SPACED)
    m = max(1, len(own))
    ordered = np.sort(own)
    runs = np.diff(np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(own)]))) if len(own) else np.zeros(1)
    again = np.count_nonzero(own[1:] == own[:-1])
    pairs = words.grams(own, 3)
    gaps = np.diff(first) if len(first) > 1 else np.array([n])
    share = lambda a, b, e=0.01: np.log(a / b + e)
    return np.array(
        [
            np.log1p(len(own)),
            share(kinds[1], letters),
            share(kinds[3], n),
            share(kinds[5], n),
            share(kinds[6], n),
            share(kinds[7], n, 0.05),
            share(np.count_nonzero(raw == _MARKS[0]), n),
            share(np.count_nonzero(raw == _MARKS[1]), n),
            share(again, m),
            share(runs.max(), m, 0.02),
            len(runs) / m,
            share(len(pairs) - len(np.unique(pairs)), max(1, len(pairs)), 0.02),
            np.log(gaps.mean()),
            np.log1p(gaps.std()),
        ]
    )


FEATURES = (
    "log words, upper case, digits, sentence marks, symbols, beyond ASCII, exclamation marks, bars, "
    "repeated neighbours, commonest word, distinct words, repeated triples, mean gap, gap deviation"
).split(", ")


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            x = np.stack([statistics(t) for t in texts])
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "x"])

    return short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Discriminant:
    """Means, inverses of the Cholesky factors and log determinants of class 0 and 1, and the log odds; or one constant score."""

    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    log_dets: np.ndarray | None = None
    odds: float = 0.0
    constant: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        part = [self.inverses[c] @ (x - self.means[c]).T for c in (0, 1)]
        density = [-0.5 * ((z * z).sum(axis=0) + self.log_dets[c]) for c, z in enumerate(part)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """The discriminant of the labelled rows that aren't held out; only sums of fixed size reach the driver."""
    d = len(FEATURES)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y")).where("y is not null")
    rows = features.join(marks, "doc_id").where(~held_out(F.col("doc_id"))).select("y", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, of = b.column("x").flatten().to_numpy().reshape(b.num_rows, d), b.column("y").to_numpy()
            for y in (0, 1):
                x = every[of == y]
                flat = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), y, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["y", "i", "v"])

    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        total[r["y"], r["i"]] = r["v"]
    n = total[:, 0]
    if min(n) < 2:
        return Discriminant(constant=float((n[1] + 1) / (n.sum() + 2)))
    means = total[:, 1 : 1 + d] / n[:, None]
    second = total[:, 1 + d :].reshape(2, d, d)
    own = [second[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag((n[0] * np.diag(own[0]) + n[1] * np.diag(own[1])) / n.sum()) + 1e-6 * np.eye(d)
    shrunk = [(1 - SHRINK) * s + (SHRINK + RIDGE) * pooled for s in own]
    factors = np.stack([np.linalg.cholesky(s) for s in shrunk])
    log_dets = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    inverses = np.stack([np.linalg.solve(f, np.eye(d)) for f in factors])
    return Discriminant(means, inverses, log_dets, float(np.log(n[1] / n[0])))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    features = materialise(feature_rows(docs, id_col, text_col), "quality-features")
    model = fit(features, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents that are accepted, with all their columns. Statistics of labelled documents are a table, so that no task
    runs two Python workers; texts are read once more to be scored."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    some = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    model = fit(materialise(feature_rows(semi_by_key(some, known, "_id", known.count()), "_id", "text"), "labelled-features"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches, text_col):
            yield rows.filter(pa.array(model.scores(np.stack([statistics(t) for t in texts])) >= cut))

    return docs.mapInArrow(run, docs.schema)
