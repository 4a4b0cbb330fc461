"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as parquet and read
again before the next one. All but the last return the columns of documents, further columns of theirs included.

Defined cases: a null text is empty, and scored, compared and encoded as such. Equal texts become one row, null ids last.
Documents without words link with none and hold no item, so they go only by quality or as copies. Rows that share an id
stand or go together, but for exact copies; rows without an id go only by quality or as exact copies. An empty
table gives an empty result with the same columns. Names of further columns are free but for _id and _gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.decontaminate import drop_contaminated
from tesserae.llm.exact_dedup import drop_exact_copies
from tesserae.llm.jaccard import drop_near_copies
from tesserae.llm.quality import keep_quality
from tesserae.llm.sentencepiece_codec import encode_documents
from tesserae.llm.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents in docs."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the document with the smallest id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document that is left."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL can't express the classifier; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
