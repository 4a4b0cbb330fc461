"""Sharding by extendible hashing.

A bucket is a prefix of the bits of a document's hash. The directory starts with one bucket, and only buckets over
the byte limit are split on their next bit until each fits. Byte sums are taken once per cell of LEVEL bits; the
sums of all shorter prefixes follow from the cells, and a bucket is a prefix that fits while its parent doesn't.
Cells that are still too large are looked at again with LEVEL more bits.

Defined cases: a null text has no bytes, a null id hashes like an empty one; a document larger than the limit has a
bucket of its own at the full depth, or shares it with rows of the same hash only, which are rows that repeat
id and text; those are dealt into numbered parts that fit (one row each at least); an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.storage import materialise

BITS, LEVEL = 60, 20
LIMIT = 1 << 20


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5 of id and text."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def _buckets(cells: DataFrame, low: int, limit: int) -> DataFrame:
    """depth, prefix, bytes, docs of the buckets among cells of low + LEVEL bits; `low` bits are known to be too few."""
    top = low + LEVEL
    nodes = (
        cells.select(F.explode(F.sequence(F.lit(low), F.lit(top))).alias("depth"), "cell", "bytes", "docs")
        .groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    )
    split = nodes.where((F.col("bytes") > limit) & (F.col("depth") < top)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    root = F.col("depth") == (0 if low == 0 else low)
    children = nodes.withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"], "left_semi").drop("parent")
    fits = (F.col("bytes") <= limit) | (F.col("depth") == top)
    return children.unionByName(nodes.where(root)).where(fits)


def shard_directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """depth, prefix, bytes, docs of every bucket of rows(hash, bytes). As many rows as shards; never on the driver."""
    done, low = None, 0
    while True:
        top = low + LEVEL
        cells = rows.groupBy(F.shiftright("hash", BITS - top).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        found = materialise(_buckets(cells, low, limit), "shard-directory")
        large = (F.col("depth") == top) & (F.col("bytes") > limit)
        if top == BITS or found.where(large).isEmpty():
            return found if done is None else done.unionByName(found)
        keep = found.where(~large)
        done = keep if done is None else done.unionByName(keep)
        # only the cells that are too large are read again, with more bits
        rows = rows.join(found.where(large).select(F.col("prefix").alias("_cell")), F.shiftright("hash", BITS - top) == F.col("_cell"), "left_semi")
        low = top


def _columns(id_col: str, text_col: str) -> list[Column]:
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    return [F.col(id_col).cast("long").alias("doc_id"), hash_bits(F.col(id_col), F.col(text_col)).alias("hash"), size.alias("bytes")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hash, bytes of every document."""
    return docs.select(*_columns(id_col, text_col))


def _placed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows with depth, shard and shard_bytes of the bucket that holds them."""
    depths = [r["depth"] for r in directory.select("depth").distinct().collect()]  # at most 61 numbers
    # a document looks itself up once per depth in use; exactly one bucket holds it
    keys = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.expr(f"shiftright(hash, {BITS - d})").alias("prefix")) for d in sorted(depths)))) if depths else F.explode(F.array().cast("array<struct<depth:int,prefix:bigint>>"))
    return (
        rows.select("*", keys.alias("key"))
        .select(*rows.columns, "key.*")
        .join(directory.select("depth", "prefix", F.col("bytes").alias("shard_bytes")), ["depth", "prefix"])
        .withColumn("shard", F.expr("right(lpad(bin(prefix), 60, '0'), depth)"))
        .drop("prefix")
    )


def _with_parts(placed: DataFrame, limit: int) -> DataFrame:
    """Numbered parts for rows of one hash that are too many for a bucket of the full depth, 0 for all others."""
    full = (F.col("shard_bytes") > limit) & (F.col("depth") == BITS)
    same = Window.partitionBy("hash").orderBy("doc_id")
    room = F.greatest(F.lit(1), F.expr(f"{int(limit)} div greatest(1, bytes)"))
    over = placed.where(full).withColumn("part", F.floor((F.row_number().over(same) - 1) / room).cast("long"))
    return placed.where(~full).withColumn("part", F.lit(0).cast("long")).unionByName(over)


def extendible_shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, shard (the bucket's bits), depth, part, bytes, shard_bytes (of the bucket)."""
    rows = materialise(_rows(docs, id_col, text_col), "shard-rows")
    placed = _placed(rows, shard_directory(rows.select("hash", "bytes"), limit))
    return _with_parts(placed, limit).select("doc_id", "shard", "depth", "part", "bytes", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row of docs, with one folder per shard and part.

    Rows find their bucket by hash, so null ids and repeated rows are written too. Columns of docs called shard or
    part get an underscore at the end.
    """
    rows = materialise(_rows(docs, id_col, text_col), "shard-rows")
    places = _placed(rows.select("hash").distinct(), shard_directory(rows.select("hash", "bytes"), limit))
    row = F.struct(*(F.col(f"`{c}`").alias(f"{c}_" if c in ("shard", "part") else c) for c in docs.columns)).alias("row")
    texts = docs.select(row, *_columns(id_col, text_col))
    dealt = _with_parts(texts.join(places, "hash"), limit)
    out = dealt.select("row.*", F.concat(F.lit("b"), "shard").alias("shard"), "part")
    out.repartition("shard", "part").write.partitionBy("shard", "part").parquet(path)
