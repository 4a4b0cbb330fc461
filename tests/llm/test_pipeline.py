"""The stages, each on its own input, and the whole against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.fixtures import edge_rows, table
from tests.llm.test_dedup import brute_components
from tests.llm.test_text import brute_matches

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    stages = dict(pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    left = sorted(r["doc_id"] for r in good.select("doc_id").collect())
    assert 0 < len(left) < len(text)
    seen: dict[str, int] = {}
    for i in left:
        seen.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text[i] or ""), i)
    left = sorted(seen.values())
    heads = brute_components([(i, text[i]) for i in left])
    left = [i for i in left if heads[i] == i]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    gone = {d for d, _ in brute_matches([(i, text[i]) for i in left], items)}
    left = [i for i in left if i not in gone]
    out = pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == left
    assert all(r["round_trip"] for r in out)
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]


def odd_documents(spark, extra):
    """Rows of every defined case, with further columns of clashing names and nulls in the others."""
    return table(spark, edge_rows() + extra).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))


def test_stages_define_odd_rows(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() if len(r["text"].split()) > 12)
    docs = odd_documents(spark, [(12, f"before {item} after"), (None, item)])
    stages = dict(pipeline.STAGES)
    ids = lambda out: Counter(r["doc_id"] for r in out.select("doc_id").collect())
    every = ids(docs)
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns and ids(good) <= every
    exact = stages["exact dedup"](spark, docs, SF)
    assert exact.columns == docs.columns and ids(exact) == Counter([1, 3, 4, 6, None, None, 8, 9, 10, 11, 12])
    near = stages["n-gram Jaccard join"](spark, docs, SF)
    assert near.columns == docs.columns and ids(near) == Counter([1, 2, 3, 4, 6, None, None, None, 8, 8, 9, 10, 12])
    clean = stages["benchmark decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and ids(clean) == every - Counter([12])  # rows without an id stay
    encoded = stages["SentencePiece encoding and decoding"](spark, docs, SF)
    assert ids(encoded) == every and all(r["round_trip"] for r in encoded.collect())


def test_stages_of_empty_tables(spark):
    docs = odd_documents(spark, []).limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == pipeline.STAGES[-1][0] or out.columns == docs.columns)


def test_batch_size_of_the_user_stays(spark):
    from tesserae.llm.storage import short_batches

    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    try:
        spark.conf.set(option, "10000")
        short_batches(spark.range(1))
        assert spark.conf.get(option) == "10000"
        spark.conf.unset(option)
        short_batches(spark.range(1))
        assert spark.conf.get(option) == "1000"
    finally:
        spark.conf.set(option, before)
