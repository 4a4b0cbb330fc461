"""Near-duplicate documents by an LSH forest over min-hash signatures.

1. Signatures. Each distinct set of word 2-grams has HASHES min-hash values; equal sets are one class, and its smallest id
   stands for it.
2. Orders. The classes stand in ORDERS sorted orders, each by its own values of the signature. A region of an order is a run
   of classes with a common prefix of DEPTH values; two sets of similarity 0.8 miss each other's region in all 32 orders with a
   probability of (1 - 0.8^4)^32 < 1e-7. A region of more than REGION classes is cut by longer prefixes, as deep as each part needs.
3. Candidates. Neighbours in a region, the nearest first, that agree in so many values (one byte of each) that a link is
   possible: CUTOFF of 128, where a pair at the threshold has 102 with a deviation of 4.5. They make tentative groups.
4. Full sets. Each group, in blocks that share its smallest member where it is large, is searched breadth-first on whole sets.
5. The rest. Groups in several blocks, and those that meet in a region that longer prefixes cut, are looked at once more where
   they hold several components: a pair can only link if the rarest members of the two sets, counted within the group,
   meet; so of a group's documents those that aren't of its largest component are compared with few others, on whole sets. Neither
   depth nor blocks cost a link.

Defined cases: null texts and texts without words have n_shingles 0, are their own component and link with nothing; one
word is one shingle; rows with a null id get a null component, link with nothing and are kept; rows that repeat an id
are one document, with the links of all its rows, and give one result row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.components import components
from tesserae.llm.storage import materialise, short_batches

K, PER_CENT = 2, 80
HASHES, ORDERS, DEPTH, DEEPEST = 128, 32, 4, 12
#: Classes of a region whose pairs are all looked at, and of a block of a group; agreeing values that a candidate has.
REGION, BLOCK, CUTOFF = 256, 256, 78
#: Grams of a block, and rows that a task takes at a time.
BLOCK_GRAMS, ROWS = 1 << 20, 8192
#: At most so many small rows (20 MB) are sent to every executor; beyond it a shuffle join is used.
BROADCAST_ROWS = 400_000

_rng = np.random.Generator(np.random.PCG64(12))
_FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The values of each order, in their order; the first DEPTH of the orders don't overlap.
_VALUES = (np.arange(ORDERS)[:, None] * DEPTH + np.arange(DEEPEST)) % HASHES


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct 2-grams; a lone word is one."""
    hashes, edges = words.batch_words(texts, words.SPACED)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = hashes[a:b]
        out.append(np.unique(words.grams(own, K)) if len(own) >= K else words.whole(own) if len(own) else own)
    return out


def signatures(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HASHES 32-bit min-hash values of each of the sets that begin at these places of flat."""
    out = np.empty((len(begin), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(32), begin)
    return out


def profiles(source: DataFrame) -> DataFrame:
    """doc, n, two digests of the set, and its signature (null without members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            sets = _sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            digests, made = np.zeros((2, len(n)), np.uint64), [None] * len(n)
            if len(some):
                flat, begin = np.concatenate(sets), (np.cumsum(n) - n)[some]
                for place in range(2):
                    digests[place, some] = np.add.reduceat(words.mix(flat ^ np.uint64(place + 1)), begin)
                for i, s in zip(some.tolist(), signatures(flat, begin), strict=True):
                    made[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(n), *(pa.array(words.signed(d)) for d in digests), pa.array(made, pa.binary())], names=["doc", "n", "h1", "h2", "sig"])

    return source.mapInArrow(run, "doc long, n long, h1 long, h2 long, sig binary")


def _stacked(column: pa.Array, width: int, kind) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _prefix(sig: np.ndarray, order: int, depth: int) -> np.ndarray:
    """A 64-bit key of the first values of an order."""
    own = np.full(len(sig), (order + 1) * 64 + depth, np.uint64)
    for v in _VALUES[order, :depth]:
        own = words.mix(own + sig[:, v].astype(np.uint64))
    return own


def regions(heads: DataFrame) -> DataFrame:
    """doc, order_no, key, docs: the regions of DEPTH values that hold two classes at least, and how many they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                sig, docs = _stacked(part.column("sig"), HASHES, np.uint32), part.column("doc").to_numpy()
                for o in range(ORDERS):
                    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(np.full(len(docs), o, np.int8)), pa.array(words.signed(_prefix(sig, o, DEPTH)))], names=["doc", "order_no", "key"])

    rows = heads.select("doc", "sig").mapInArrow(run, "doc long, order_no byte, key long")
    shared = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1"), "shared-prefixes")
    size = shared.count()
    return materialise(rows.join(F.broadcast(shared) if size <= BROADCAST_ROWS else shared, "key").select("doc", "order_no", "key", "docs"), "regions")


def deepened(own: DataFrame, heads: DataFrame) -> DataFrame:
    """doc, order_no, key of the members of full regions: the shortest longer prefix that REGION classes have at most. What is full at
    DEEPEST values stays as it is there, and is cut into blocks by a hash."""
    full = own.where(F.col("docs") > REGION).groupBy("doc").agg(F.collect_list("order_no").alias("orders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _stacked(b.column("sig"), HASHES, np.uint32)
            docs, orders = b.column("doc").to_numpy(), b.column("orders").to_pylist()
            for o in range(ORDERS):
                at = np.array([i for i, x in enumerate(orders) if o in x], np.int64)
                for depth in range(DEPTH + 1, DEEPEST + 1) if len(at) else ():
                    key = words.signed(_prefix(sig[at], o, depth))
                    yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(np.full(len(at), o, np.int8)), pa.array(np.full(len(at), depth, np.int8)), pa.array(key)], names=["doc", "order_no", "depth", "key"])

    rows = heads.select("doc", "sig").join(full, "doc").mapInArrow(run, "doc long, order_no byte, depth byte, key long")
    rows = materialise(rows, "longer-prefixes")
    over = rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > REGION)
    fits = rows.join(over, "key", "left")
    best = F.min_by(F.struct("key", "docs"), F.when(F.col("docs").isNull(), F.col("depth")).otherwise(F.when(F.col("depth") == DEEPEST, 100)))
    deep = fits.groupBy("doc", "order_no").agg(best.alias("r"))
    cut = F.when(F.col("r.docs") > REGION, F.xxhash64("r.key", F.pmod(F.xxhash64("doc"), F.ceil(F.col("r.docs") / REGION)))).otherwise(F.col("r.key"))
    return deep.select("doc", "order_no", cut.alias("key"))


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ROWS rows that hold whole runs of equal keys."""
    kept: list[pa.Table] = []
    held, most = 0, ROWS
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            kept.append(pa.Table.from_batches([batch.slice(at, ROWS)]))
            held += kept[-1].num_rows
            if held < most:
                continue
            whole = pa.concat_tables(kept).combine_chunks()
            last = np.ones(len(whole), bool)
            for c in keys:
                values = whole.column(c).to_numpy()
                last &= values == values[-1]
            begin = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
            if begin:
                yield whole.slice(0, begin)
            kept = [whole.slice(begin)]
            held = len(whole) - begin
            most = ROWS + held  # a long run is looked at again when it has doubled
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def neighbours(rows: DataFrame) -> DataFrame:
    """a, b: candidates that join what all candidates of a region join; rows (key, place, doc, bytes), place in the region's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, ["key"]):
            key, doc = part.column("key").to_numpy(), part.column("doc").to_numpy()
            sig = _stacked(part.column("bytes"), HASHES, np.uint8)
            label = np.arange(len(key))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            region = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            ends = np.append(starts[1:], len(key))
            found = []
            for step in range(1, len(key)):
                at = np.flatnonzero(region[:-step] == region[step:])
                if not len(at):
                    break
                at = at[label[at] != label[at + step]]
                agree = np.concatenate([np.count_nonzero(sig[i] == sig[i + step], axis=1) for i in np.array_split(at, len(at) // ROWS + 1)])
                for i in at[agree >= CUTOFF].tolist():
                    a, b = label[i], label[i + step]
                    if a != b:
                        own = label[starts[region[i]] : ends[region[i]]]
                        own[own == max(a, b)] = min(a, b)
                        found.append((min(doc[i], doc[i + step]), max(doc[i], doc[i + step])))
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, "a long, b long")


def _with_bytes(places: DataFrame, heads: DataFrame) -> DataFrame:
    """places (doc, own: array of structs), one row for each struct, with one byte of each value and the next values of its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                sig = _stacked(part.column("sig"), HASHES, np.uint32)
                low = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("own"), pa.array([x.tobytes() for x in low], pa.binary())], names=["doc", "own", "bytes"])

    kind = dict(places.dtypes)["own"]
    return heads.select("doc", "sig").join(places, "doc").mapInArrow(run, f"doc long, own {kind}, bytes binary").select("doc", F.explode("own").alias("p"), "bytes").select("doc", "p.*", "bytes")


def group_links(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of sets whose links join, with the labels, what all links of the group join. Breadth-first: a set is compared
    with those that no component has reached yet, all at once by counting its hashes among theirs."""
    size = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    _, flat = np.unique(flat, return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    ids = [flat[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    open_, hit, found = np.ones(len(sets), bool), np.zeros(flat.max() + 1 if len(flat) else 1, bool), []
    while open_.any():
        todo = [int(np.argmax(open_))]
        same = np.flatnonzero(open_ & (label == label[todo[0]]))
        open_[same] = False
        todo = same.tolist()
        left = open_[owner]
        owner, flat = owner[left], flat[left]
        while todo and len(owner):
            i = todo.pop()
            hit[ids[i]] = True
            both = np.bincount(owner[hit[flat]], minlength=len(sets))
            hit[ids[i]] = False
            linked = np.flatnonzero(open_ & (100 * both >= PER_CENT * (size + size[i] - both)) & (both > 0))
            for j in linked.tolist():
                if not open_[j]:
                    continue
                found.append((i, j))
                same = np.flatnonzero(open_ & (label == label[j]))
                open_[same] = False
                todo += same.tolist()
            if len(linked):
                left = open_[owner]
                owner, flat = owner[left], flat[left]
    return found


def verified(source: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """a, b: links on whole sets within each (key, block). places: doc, key, block, label."""
    per = places.groupBy("doc").agg(F.collect_set(F.struct("key", "block", "label")).alias("own"))
    per = materialise(per, f"{name}-places")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("own"), pa.array([s.tobytes() for s in _sets(texts)], pa.binary())], names=["doc", "own", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks((s for b in batches for s in (b.slice(i, 64) for i in range(0, b.num_rows, 64))), ["key", "block"]):
            key, block, doc, label = (part.column(c).to_numpy() for c in ("key", "block", "doc", "label"))
            grams = part.column("grams")
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            found = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                sets = [np.frombuffer(g.as_py(), np.uint64) for g in grams.slice(a, b - a)]
                found += [(min(doc[a + i], doc[a + j]), max(doc[a + i], doc[a + j])) for i, j in group_links(sets, label[a:b])]
            x, y = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    size = per.count()
    kind = dict(per.dtypes)["own"]
    sets = source.join(F.broadcast(per) if size <= BROADCAST_ROWS // 4 else per, "doc").mapInArrow(with_sets, f"doc long, own {kind}, grams binary")
    rows = sets.where("length(grams) > 0").select("doc", "grams", F.explode("own").alias("p")).select("p.*", "doc", "grams")
    return materialise(rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a long, b long"), name)


def first_links(source: DataFrame, heads: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the tentative groups, and the groups (doc, grp, cut: whether in several blocks)."""
    shallow = own.where(F.col("docs") <= REGION).select("doc", "order_no", "key")
    rows = shallow.unionByName(deepened(own, heads)).groupBy("doc").agg(F.collect_list(F.struct("key", F.xxhash64("doc", "order_no").alias("place"))).alias("own"))
    pairs = materialise(neighbours(_with_bytes(rows, heads)).distinct(), "candidates")
    groups = materialise(components(pairs).toDF("doc", "grp").join(heads.select("doc", "n"), "doc"), "group-members")
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    groups = materialise(groups.join(size, "grp"), "groups")
    places = groups.select("doc", F.col("grp").alias("key"), F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"), F.col("doc").alias("label"))
    pivots = groups.where("doc = grp and blocks > 1").select("doc", F.col("grp").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("doc").alias("label"))
    return verified(source, places.unionByName(pivots), "first-links"), groups.select("doc", "grp", (F.col("blocks") > 1).alias("cut"))


def rest_members(heads: DataFrame, own: DataFrame, first: DataFrame, groups: DataFrame) -> DataFrame:
    """doc, grp, label, other, least: of groups in several blocks, and of all that meet in a full region, which are one group
    here, where they hold several components; other: not of the group's largest one; least: the group's smallest set."""
    labels = components(first).toDF("doc", "label")
    full = own.where(F.col("docs") > REGION).select("doc", "key").distinct()
    rows = heads.select("doc", "n").join(groups, "doc", "left").join(labels, "doc", "left").join(full.select("doc").distinct().withColumn("full", F.lit(True)), "doc", "left")
    rows = rows.where("cut or full").select("doc", "n", F.coalesce("grp", "doc").alias("grp"), F.coalesce("label", "doc").alias("label"))
    rows = materialise(rows, "rest-rows")
    meet = full.join(rows.select("doc", "grp"), "doc")
    glued = components(meet.join(meet.groupBy("key").agg(F.min("grp").alias("to")), "key").select(F.col("grp").alias("a"), F.col("to").alias("b")))
    rows = rows.join(glued.toDF("grp", "to"), "grp", "left").select("doc", "n", "label", F.coalesce("to", "grp").alias("grp"))
    per = rows.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"))
    mixed = per.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("least").alias("least")).where("low <> high")
    return materialise(rows.join(mixed, "grp").select("doc", "grp", "label", (F.col("label") != F.col("main")).alias("other"), "least"), "rest-members")


def rest_links(source: DataFrame, members: DataFrame) -> DataFrame:
    """Links between components of one group. In an order of a group's grams by how many of its sets hold them, two linked sets
    share one of the first n - o + 1, where o is the least overlap that a link of n members has with a set of the group, and at the
    first one that they share as many are left in both as a link of their sizes needs."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches):
            sets = _sets(texts)
            of = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            n = np.array([len(s) for s in sets], np.int64)
            mark = pa.array(np.array([int(s[0] ^ s[-1]) & (2**63 - 1) if len(s) else 0 for s in sets], np.int64))  # tells the texts of a repeated id apart
            cols = [rows.column(c).take(of) for c in ("doc", "grp", "label", "other", "least")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n).take(of), mark.take(of), pa.array(words.signed(np.concatenate(sets)))], names=["doc", "grp", "label", "other", "least", "n", "mark", "gram"])

    members = members.dropDuplicates(["doc"])
    size = members.count()
    rows = source.join(F.broadcast(members) if size <= BROADCAST_ROWS // 4 else members, "doc").mapInArrow(grams, "doc long, grp long, label long, other boolean, least long, n long, mark long, gram long")
    rows = materialise(rows, "rest-grams")
    held = rows.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("held"), F.count_if("other").alias("others")).where("held > 1 and others > 0")
    # grams that one set holds, or none of those to be compared, come first; nobody shares them, so they count by their number
    own = Window.partitionBy("doc", "n", "mark")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * PER_CENT / 100))
    overlap = F.ceil((F.col("n") + smallest) * PER_CENT / (100 + PER_CENT))
    place = F.row_number().over(own.orderBy("held", "gram"))
    shared = rows.join(held, ["grp", "gram"])
    first = materialise(shared.withColumns({"place": place + alone, "most": F.col("n") - overlap + 1}).where("place <= most").select("doc", "n", "grp", "label", "other", "gram", "place"), "rest-prefixes")
    mates = first.select(F.col("doc").alias("b"), F.col("n").alias("m"), "grp", F.col("label").alias("with"), "gram", F.col("place").alias("at"))
    # nothing is shared before the first gram that is, so what follows it has to be enough
    near = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= F.ceil((F.col("n") + F.col("m")) * PER_CENT / (100 + PER_CENT))
    pairs = first.where("other").join(mates, ["grp", "gram"]).where((F.col("label") != F.col("with")) & near).select(F.col("doc").alias("a"), "b").distinct()
    pairs = materialise(pairs, "rest-candidates")
    # each of them with its candidates, in blocks
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    stars = pairs.join(many, "a").select(F.col("b").alias("doc"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    selves = many.select(F.col("a").alias("doc"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return verified(source, stars.unionByName(selves).join(members.select("doc", "label"), "doc"), "rest-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    source = short_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = materialise(profiles(source), "profiles")
    some = rows.where("n > 0 and doc is not null")
    heads = materialise(some.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    own = regions(heads)
    first, groups = first_links(source, heads, own)
    rest = rest_links(source, rest_members(heads, own, first, groups))
    # an id whose rows differ belongs to several classes and joins them
    repeated = some.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc")
    reps = heads.select("h1", "h2", F.col("doc").alias("rep"))
    joins = some.join(repeated, "doc", "left_semi").join(reps, ["h1", "h2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    labels = components(first.unionByName(rest).unionByName(joins)).toDF("rep", "component")
    out = rows.select("doc", "n", "h1", "h2").join(reps, ["h1", "h2"], "left").withColumn("rep", F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc"))))
    out = out.join(labels, "rep", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
