"""N-gram Jaccard self-join by signature trees.

Two documents link when their sets of word 5-grams have a Jaccard similarity of at least 3/4. The steps:

1. Profiles. Equal sets are one class, and its smallest id stands for it. Each set has three keys: its smallest members in
   three orders.
2. First trees. Sets with a key in common are joined by signature trees (tesserae.llm.signature_trees). A bucket that holds
   many is cut into blocks, each with the bucket's smallest id; so groups of near copies of any size come together with a
   number of rows in line with their size. What this finds are links; what it misses is left to the next steps.
3. Prefixes. With overlap o >= 3/4 of either size, two linked sets share at least min(l_a, l_b) of their first
   n - ceil(3n/4) + l grams, l = ceil(n/10). Grams that only one component holds are dropped, then documents that keep
   fewer grams than any link needs. Grams with equal sets of documents become one with a weight, and each document
   leaves out its fullest buckets as long as what they weigh is less than any link needs. Grams whose first document is
   the same share a bucket.
4. Last trees. What is left in a bucket is joined by signature trees again, blocks of large buckets with each other. So
   every link between two components that step 2 left apart is found.

The traversal leaves out pairs of nodes with one component, as such pairs add nothing to it.

Defined cases: null texts and texts without words have n_shingles 0, are their own component and link with
nothing; fewer than five words make one shingle; rows with a null id get a null component and link with nothing;
rows that repeat an id are one document, with the links of all its rows, and give one result row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.components import components
from tesserae.llm.signature_trees import Forest
from tesserae.llm.storage import materialise, short_batches

K = 5
#: Documents of a block of a bucket (blocks that meet no other are smaller), its grams, and bytes of sets that a task joins at a time.
BLOCK, ALONE, BLOCK_GRAMS, FOREST_BYTES = 1024, 256, 1 << 20, 6 << 20
#: At most so many small rows (20 MB) are sent to every executor; beyond it a shuffle join is used.
BROADCAST_ROWS = 400_000
#: Salts of a gram that very many documents hold.
SALTS = 256


def shingles(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The set of k-word shingles as sorted hashes; shorter texts are one shingle, empty ones have none."""
    if not len(hashes):
        return hashes
    return np.unique(words.grams(hashes, k)) if len(hashes) >= k else words.whole(hashes)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    hashes, edges = words.batch_words(texts, words.SPACED)
    return [shingles(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def needed(n):
    """The least overlap with any linked set."""
    return -(-3 * n // 4)


def prefix_length(n):
    return n - needed(n) + -(-n // 10)


def least() -> Column:
    """How many prefix grams any link of a document of n grams shares."""
    return F.ceil(F.ceil(F.col("n") * 3 / 4) / 10)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return short_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def _joined(rows: DataFrame, table: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of n rows, one per key: broadcast up to BROADCAST_ROWS, else a shuffle join."""
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, key, how)


def profiles(source: DataFrame) -> DataFrame:
    """doc, n, two digests of the set, and its three keys; a set without members has nulls for keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            sets = _sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            out = np.zeros((5, len(n)), np.uint64)
            if len(some):
                flat = np.concatenate(sets)
                begin = (np.cumsum(n) - n)[some]
                for place, salt in enumerate((1, 2, 3)):
                    mixed = words.mix(flat ^ np.uint64(salt))
                    if place < 2:
                        out[place, some] = np.add.reduceat(mixed, begin)
                    if place:
                        out[place + 2, some] = np.minimum.reduceat(mixed, begin)
                out[2, some] = flat[begin]  # sets are sorted
            keys = [pa.array(words.signed(k), mask=n == 0) for k in out[2:]]
            yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(n), *(pa.array(words.signed(h)) for h in out[:2]), *keys], names=["doc", "n", "h1", "h2", "k0", "k1", "k2"])

    return source.mapInArrow(run, "doc long, n long, h1 long, h2 long, k0 long, k1 long, k2 long")


def prefix_rows(source: DataFrame) -> DataFrame:
    """token, doc, component (null: the document itself): the first grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            own = [s[: prefix_length(len(s))] for s in _sets(texts)]
            of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            flat = pa.array(words.signed(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([flat, rows.column("doc").take(of), rows.column("component").take(of)], names=["token", "doc", "component"])

    return source.mapInArrow(run, "token long, doc long, component long")


def with_sets(source: DataFrame) -> DataFrame:
    """doc, component, places, and the sorted set as packed 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            grams = pa.array([s.tobytes() for s in _sets(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("component"), rows.column("places"), grams], names=["doc", "component", "places", "grams"])

    return source.mapInArrow(run, "doc long, component long, places array<struct<key: long, i: int, j: int, block: int>>, grams binary")


def dealt(rows: DataFrame, every_pair: bool) -> DataFrame:
    """doc, component, places of rows (key, doc, n, component): the runs (key, i, j) in which a document is compared, and
    its block. Buckets of one component are left out; a bucket beyond one block is cut by size (powers of 4/3) and hash.
    every_pair: blocks of like sizes meet each other; else each is alone, but for the key's smallest document, which is in all."""
    most = BLOCK if every_pair else min(ALONE, BLOCK)
    kind = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")  # sizes of linked sets are one class apart at most
    rows = rows.withColumn("kind", kind if every_pair else F.lit(0))
    parts = rows.groupBy("key", "kind").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("doc", "component")).alias("pivot"),
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"),
        F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"),
    )
    buckets = parts.groupBy("key").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("pivot").alias("pivot"), F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"),
        ((F.sum("docs") > most) | (F.sum("grams") > BLOCK_GRAMS)).alias("large"),
    ).where("low <> high")
    buckets = materialise(buckets.drop("low", "high"), "buckets")
    size = buckets.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("large"), 1)).alias("large")).first()
    large = buckets.where("large").select("key", "blocks", "pivot")
    if size["all"] <= BROADCAST_ROWS:
        marked = _joined(rows, buckets.select("key", F.when(F.col("large"), F.col("blocks")).alias("blocks")), "key", size["all"])
        small, placed = marked.where("blocks is null").select("key", "doc", "component"), marked.where("blocks is not null")
    else:  # a key with very many rows isn't shuffled
        marked = _joined(rows, large.drop("pivot"), "key", size["large"], "left")
        small = marked.where("blocks is null").drop("blocks").join(buckets.where("not large").select("key"), "key", "left_semi").select("key", "doc", "component")
        placed = marked.where("blocks is not null")
    at = lambda kind, of: kind * (1 << 24) + of
    placed = placed.withColumn("block", at(F.col("kind"), F.pmod(F.xxhash64("doc"), F.col("blocks")[F.col("kind")]).cast("int")))
    all_of = lambda kind: F.coalesce(F.transform(F.sequence(F.lit(0), F.try_element_at("blocks", kind) - 1), lambda x: at(kind, x)), F.array().cast("array<int>"))
    if every_pair:
        mates = placed.withColumn("other", F.explode(F.flatten(F.array(*(all_of(F.col("kind") + d) for d in (-1, 0, 1))))))
        cut = mates.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "component")
    else:
        pivots = large.select("key", "pivot.doc", "pivot.component", F.explode(all_of(F.lit(0))).alias("block"))
        cut = placed.select("key", "doc", "component", "block").unionByName(pivots).withColumns({"i": F.col("block"), "j": F.col("block")})
    none = {c: F.lit(0) for c in ("i", "j", "block")}
    runs = small.withColumns(none).unionByName(cut)
    return runs.groupBy("doc").agg(F.first("component").alias("component"), F.collect_set(F.struct("key", "i", "j", "block")).alias("places"))


def tree_links(source: DataFrame, places: DataFrame) -> DataFrame:
    """Links (a, b) that the trees of all runs yield. places: doc, component, places."""

    def forest(part: pa.Table) -> pa.RecordBatch:
        grams = part.column("grams").combine_chunks()
        ends = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1] // 8
        flat = np.frombuffer(grams.buffers()[2], np.uint64)
        column = lambda c: part.column(c).to_numpy()
        run = np.unique(np.stack([column("key"), column("i"), column("j")]), axis=1, return_inverse=True)[1].ravel()
        found = Forest(run, column("block"), column("doc"), column("component"), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]).search()
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = pa.Table.from_batches([batch.slice(at, 256)])
                kept.append(part)
                held += part.nbytes
                if held < FOREST_BYTES:
                    continue
                whole = pa.concat_tables(kept).combine_chunks()
                last = np.ones(len(whole), bool)
                for c in ("key", "i", "j"):
                    values = whole.column(c).to_numpy()
                    last &= values == values[-1]
                begin = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0  # where the last run begins
                if begin:
                    yield forest(whole.slice(0, begin))
                kept = [pa.table({c: pa.chunked_array([pa.concat_arrays(whole.slice(begin).column(c).chunks)]) for c in whole.column_names})]
                held = 0 if begin else held // 2  # a long run is looked at again when it has grown by half
        if kept:
            yield forest(pa.concat_tables(kept).combine_chunks())

    size = places.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("rows")).first()
    sets = with_sets(_joined(source, places, "doc", max(size["docs"], size["rows"])))
    rows = sets.select("doc", "component", "grams", F.explode("places").alias("p")).select("p.key", "p.i", "p.j", "p.block", "doc", "component", "grams").where("length(grams) > 0")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def contested(rows: DataFrame, sizes: DataFrame, rounds: int = 2) -> DataFrame:
    """The rows (token, doc, component) that can still show a link between two components: of documents that keep as
    many grams as any link needs, grams that several components hold."""
    for _ in range(rounds):
        enough = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).join(sizes, "doc").where(F.col("c") >= least()).select("doc")
        rows = rows.join(enough, "doc", "left_semi")
        mixed = materialise(rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token"), "mixed")
        rows = materialise(_joined(rows, mixed, "token", mixed.count(), "left_semi"), "contested")
    return rows


def rarest(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, doc, n, component. Grams that the same documents hold are one, weighing as many; then each document's fullest
    buckets are left out as long as they weigh less together than what any link shares. In the order of buckets the first one that
    two linked documents share is kept by both, as it and what follows weighs that much. Grams with the same first
    document, in the order of hashes, share a bucket, so documents that share many grams meet in few."""
    rows = rows.dropDuplicates(["token", "doc"])
    same = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("docs"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"), F.min_by("doc", F.xxhash64("doc")).alias("key")
    )
    groups = materialise(same.groupBy("docs", "x", "y", "key").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).drop("x", "y"), "gram-groups")
    fullest = Window.partitionBy("doc").orderBy(F.desc("docs"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    weighed = _joined(rows, groups, "token", groups.count()).join(sizes, "doc").withColumn("so_far", F.sum("weight").over(fullest))
    return materialise(weighed.where(F.col("so_far") >= least()).select("key", "doc", "n", "component").dropDuplicates(["key", "doc"]), "rarest")


def links(source: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges (a, b) between the representatives heads (doc, n, k0, k1, k2) that give the components of all links."""
    heads = heads.withColumn("component", F.col("doc"))
    keyed = heads.select("doc", "n", "component", F.explode(F.array("k0", "k1", "k2")).alias("key"))
    first = materialise(tree_links(source, materialise(dealt(keyed, every_pair=False), "first-places")), "first-links")

    labels = components(first).toDF("doc", "label")
    # a gram that very many documents hold is the smallest of some; its rows are salted until few are left
    size = heads.count()
    very_common = materialise(heads.groupBy(F.col("k0").alias("token")).count().where(F.col("count") > max(128, size >> 19)).select("token", F.lit(True).alias("common")), "common-grams")
    placed = materialise(heads.groupBy("doc").agg(F.min("n").alias("n")).join(labels, "doc", "left").select("doc", "n", F.col("label").alias("component")), "representatives")
    grams = prefix_rows(_joined(source, placed.select("doc", "component"), "doc", placed.count()))
    grams = _joined(grams, very_common, "token", very_common.count(), "left").withColumns(
        {"component": F.coalesce("component", "doc"), "salt": F.when(F.col("common"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0)}
    )
    own = Window.partitionBy("token", "salt")
    grams = grams.withColumns({"low": F.min("component").over(own), "high": F.max("component").over(own)}).where("common or low <> high")
    rows = contested(materialise(grams.select("token", "doc", "component"), "shared-grams"), placed.select("doc", "n"))
    last = tree_links(source, materialise(dealt(rarest(rows, placed.select("doc", "n")), every_pair=True), "last-places"))
    return first.unionByName(last)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    source = _source(docs, id_col, text_col)
    rows = materialise(profiles(source), "profiles")
    some = rows.where("n > 0 and doc is not null")
    keys = [F.first(c).alias(c) for c in ("n", "k0", "k1", "k2")]
    classes = materialise(some.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), *keys), "classes")
    edges = links(source, classes.select(F.col("rep").alias("doc"), "n", "k0", "k1", "k2"))
    # an id whose rows differ belongs to several classes and joins them
    repeated = some.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc")
    joins = some.join(repeated, "doc", "left_semi").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    labels = components(edges.unionByName(joins))
    out = rows.join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left").withColumn("rep", F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc"))))
    return out.join(labels.toDF("rep", "component"), "rep", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of each component the smallest id. Rows with a null id stay."""
    gone = jaccard_components(docs, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
