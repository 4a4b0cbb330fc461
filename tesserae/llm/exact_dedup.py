"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by content: by the first characters of the normalised text, then a hash of all
of it, so that splitters stay small whatever the length of texts and equal texts fall between the same two. Each partition is
sorted externally with the full text as a key, equal texts stand side by side, and neighbours are compared in full.

Texts whose hash has more than CROWD rows are sorted on their own, with a salt behind the hash, as many as their count asks
for; the first row of each of their runs takes part in a second content sort without salts, where runs of one text meet.
So every copy is found by a comparison of neighbouring texts, and no text brings more than CROWD rows together.

Defined cases: a null text counts as empty; rows with a null id stay only if no equal text has an id, and then
one of them; of rows that repeat id and text one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.storage import BROADCAST_KEYS, materialise

#: Rows of one hash that are sorted without a salt.
CROWD = 512
#: Characters of a text in a splitter.
LEAD = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _rows(docs: DataFrame, id_col: str, text_col: str, *payload: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), *payload)
    return rows.withColumns({"lead": F.substring("norm", 1, LEAD), "hash": F.xxhash64("norm")})


def _apart(docs: DataFrame, id_col: str, text_col: str, *payload: Column) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose hash isn't crowded, and the others with their salt; None where there are none."""
    counts = docs.select(F.xxhash64(normalised(F.col(text_col))).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("crowd"))
    crowded = materialise(counts.where(F.col("crowd") > CROWD), "crowded-hashes")
    n = crowded.count()
    rows = _rows(docs, id_col, text_col, *payload)
    if not n:
        return rows, None
    table = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded
    salt = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), F.ceil(F.col("crowd") / CROWD))
    return rows.join(table, "hash", "left_anti"), rows.join(table, "hash").withColumn("salt", salt).drop("crowd")


def content_runs(rows: DataFrame, *key: str) -> DataFrame:
    """rows in content order, with the first id, the size and the row's place in its run of equal texts. key: what the rows are
    range-partitioned by; the sort goes on with the full text and the id, and needs no other shuffle."""
    run = Window.partitionBy(*key, "norm")  # neighbours in the sort whose texts are the same in full
    place = run.orderBy(F.asc_nulls_last("id"))
    return rows.repartitionByRange(*key).withColumns(
        {"run_place": F.row_number().over(place).cast("long"), "run_keep": F.first("id").over(place), "run_size": F.count(F.lit(1)).over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    )


def _meeting(heads: DataFrame) -> DataFrame:
    """hash, salt, sha, keep_id, group_size, winner: the runs of crowded texts after they have met. heads: the first row of each run."""
    run = Window.partitionBy("lead", "hash", "norm")
    place = run.orderBy(F.asc_nulls_last("run_keep"), "salt")
    everyone = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = heads.repartitionByRange("lead", "hash")
    return rows.select(
        "hash", "salt", "sha", F.first("run_keep").over(place).alias("keep_id"), F.sum("run_size").over(everyone).alias("group_size"), (F.row_number().over(place) == 1).alias("winner")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    plain, crowd = _apart(docs, id_col, text_col)
    out = content_runs(plain, "lead", "hash").select(
        F.col("id").alias("doc_id"), F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), (F.col("run_place") == 1).alias("kept"), F.sha2("norm", 256).alias("text_sha256")
    )
    if crowd is None:
        return out
    runs = content_runs(crowd, "lead", "hash", "salt").withColumn("sha", F.sha2("norm", 256))
    first = F.col("run_place") == 1
    runs = materialise(runs.select("id", "hash", "salt", "sha", "run_keep", "run_size", "run_place", *(F.when(first, F.col(c)).alias(c) for c in ("lead", "norm"))), "crowded-runs")
    met = _meeting(runs.where("run_place = 1"))
    joined = runs.select("id", "hash", "salt", "sha", "run_place").join(met, ["hash", "salt", "sha"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("winner") & (F.col("run_place") == 1)).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return out.unionByName(joined)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, dealt out by hash: in content order, near copies and long texts of one make would
    stand in the same tasks of whatever comes next."""
    plain, crowd = _apart(docs, id_col, text_col, F.struct("*").alias("row"))
    out = content_runs(plain, "lead", "hash").where("run_place = 1").select("hash", "row")
    if crowd is not None:
        heads = content_runs(crowd, "lead", "hash", "salt").where("run_place = 1").drop("id")
        place = Window.partitionBy("lead", "hash", "norm").orderBy(F.asc_nulls_last("run_keep"), "salt")
        met = heads.repartitionByRange("lead", "hash").withColumn("place", F.row_number().over(place)).where("place = 1")
        out = out.unionByName(met.select("hash", "row"))
    return out.repartition("hash").select("row.*")
