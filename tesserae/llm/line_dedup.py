"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Two lines link when they are within k edits of each other, k = 2 where the shorter one has 20 characters and more, 1 from 10
characters on, and 0 below. Of its k + 1 segments at least one stands unchanged in the longer line, near its own place. Each line
puts its segments into an index keyed by (its length, segment number, content), and probes the index for its own and up to
k smaller lengths with the few substrings that a segment can have moved to. Keys with one line are dropped before any text is looked at again. Lines that share a key
are compared by their counts of common letters (k edits change them by 2k at most), which is a condition of the join,
so that hardly more than the true links come out of it, and then verified by a banded bit-parallel edit distance.

A line that repeats, or links through others to an earlier line, is dropped; the first occurrence (smallest id, then
place) stays. Blank lines stay.

Defined cases: a null text has no lines, an empty text has one blank line; rows that repeat an id are one document
with the lines of all its rows; rows with a null id count as one document, which comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.components import components
from tesserae.llm.storage import materialise, semi_by_key

K = 2
#: A pair may have one edit for each so many characters of its shorter line, K at most.
PER_EDIT = 10
#: Lines that stand in more places than this, or a 200,000th of all places, are broadcast with their first place (16 MB at most).
HEAVY, HEAVY_LINES = 1000, 200_000
#: Letters that are counted.
LETTERS = "etaoinshrdlucmfwypvbg"


def segment_start(n: str, i: int, k: int) -> str:
    """SQL: characters before segment i of a line of n characters; i = k + 1 gives its end."""
    return f"(({n}) * {i} div {k + 1})"


def edits(n: str, k: int) -> str:
    """SQL: edits allowed between a line of n characters and one that isn't shorter."""
    return f"least({k}, ({n}) div {PER_EDIT})"


def index_keys(k: int) -> list[str]:
    """SQL structs, or nulls, of the keys under which a line of `n` characters is found: own segments for each number of edits."""
    out = []
    for e in range(1, k + 1):
        for i in range(e + 1):
            start, end = segment_start("n", i, e), segment_start("n", i + 1, e)
            out.append(f"if({edits('n', k)} = {e}, struct(n, {i} AS i, xxhash64(substring(line, {start} + 1, {end} - {start})) AS h, true AS own), null)")
    return out


def probe_keys(k: int) -> list[str]:
    """SQL structs, or nulls, of the keys under which lines of n - d characters, 0 <= d <= e, may hold a segment of this one.

    With c edits before segment i and at most e in all, it has moved by `s` with |s| <= i and |s - d| <= e - i.
    """
    out = []
    for e in range(1, k + 1):
        for d in range(e + 1):
            for i in range(e + 1):
                m = f"(n - {d})"
                start, end = segment_start(m, i, e), segment_start(m, i + 1, e)
                for s in range(-i, i + 1):
                    if abs(s - d) <= e - i and (d or s):  # unmoved at the same length is the index key itself
                        out.append(f"if({edits(m, k)} = {e}, struct({m} AS n, {i} AS i, xxhash64(substring(line, {start} + {s} + 1, {end} - {start})) AS h, false AS own), null)")
    return out


def within_edits(a: Column, b: Column, k: int = K) -> Column:
    """Whether two arrays of characters, of k or more each, are within k edits.

    Bit t of a word stands for row j - k + t of column j. Vertical differences of the band fit one word of 2k + 1 bits
    whatever the length of the lines; the distance is followed down the band's lower diagonal to the last row and
    then along that row.
    """
    width = 2 * k + 1
    full = (1 << width) - 1
    m, n = F.size(a), F.size(b)

    def column(state: Column, j: Column) -> Column:
        match = F.lit(0)
        for t in range(width):
            row = j - k + t
            match = match.bitwiseOR(F.when((row >= 1) & (row <= m), F.when(F.get(a, row - 1) == F.get(b, j - 1), 1 << t).otherwise(0)).otherwise(0))
        vp, vn = state["vp"], state["vn"]
        bound = F.array(F.struct(match.alias("x"), vp.alias("vp"), vn.alias("vn"), state["dist"].alias("dist")))

        def diagonal(s: Column) -> Column:
            sum_ = (s["x"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(F.lit(full))
            d0 = sum_.bitwiseXOR(s["vp"]).bitwiseOR(s["x"]).bitwiseOR(s["vn"])
            return F.struct(d0.alias("d0"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"))

        def horizontal(s: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"])).bitwiseAND(F.lit(full)))
            return F.struct(s["d0"].alias("d0"), hp.alias("hp"), s["d0"].bitwiseAND(s["vp"]).alias("hn"), s["dist"].alias("dist"))

        def following(s: Column) -> Column:
            half = F.shiftright(s["d0"], 1)
            bit = F.expr("1")
            # columns up to m - k go down the diagonal; later ones go along row m, which is one bit higher in each
            along = j > m - k
            at = m - j + k
            delta = F.when(along, F.getbit(s["hp"], F.least(at, F.lit(30))).cast("int") - F.getbit(s["hn"], F.least(at, F.lit(30))).cast("int")).otherwise(
                bit - F.getbit(s["d0"], F.lit(width - 1)).cast("int")
            )
            return F.struct(
                s["hn"].bitwiseOR(F.bitwise_not(half.bitwiseOR(s["hp"])).bitwiseAND(F.lit(full))).alias("vp"),
                half.bitwiseAND(s["hp"]).alias("vn"),
                (s["dist"] + delta).alias("dist"),
            )

        return F.transform(F.transform(F.transform(bound, diagonal), horizontal), following)[0]

    start = F.struct(F.lit(full ^ ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("dist"))
    distance = F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["dist"])
    return F.when(F.abs(m - n) > k, False).otherwise(distance <= k)


def letter_counts(line: Column) -> dict[str, Column]:
    """How often each of LETTERS stands in a line. An edit changes two of the counts by one at most."""
    return {f"count_{i}": F.length(line) - F.length(F.replace(line, F.lit(x), F.lit(""))) for i, x in enumerate(LETTERS)}


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, place, line of every line that isn't blank."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line"))
    return lines.where(F.trim("line") != "")


def shared_segments(lines: DataFrame, k: int = K) -> DataFrame:
    """key, id (a line's 64-bit hash), doc (a document that holds it), own: distinct lines under keys with several of them."""
    distinct = lines.groupBy("line").agg(F.min("doc").alias("doc")).select("doc", "line", F.length("line").alias("n")).where(F.col("n") >= PER_EDIT)
    keys = F.array_compact(F.expr(f"array({', '.join(index_keys(k) + probe_keys(k))})"))
    keyed = distinct.select("doc", F.xxhash64("line").alias("id"), F.explode(keys).alias("key"))
    keyed = keyed.select(F.xxhash64("key.n", "key.i", "key.h").alias("key"), "id", "doc", "key.own")
    bucket = Window.partitionBy("key")
    counted = keyed.withColumns({"low": F.min("id").over(bucket), "high": F.max("id").over(bucket), "found": F.bool_or("own").over(bucket)})
    return counted.where("low <> high and found").drop("low", "high", "found")


def trimmed(a: Column, b: Column) -> tuple[Column, Column]:
    """Two arrays without what they have in common at their ends, but for one element that keeps them from being empty."""

    def common(x: Column, y: Column) -> Column:
        place = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(place == 0, F.least(F.size(x), F.size(y))).otherwise(place.cast("int") - 1)

    head = common(a, b)
    rest = F.least(F.size(a), F.size(b)) - head
    tail = F.least(rest, common(F.reverse(a), F.reverse(b)))
    return tuple(F.slice(x, head + 1, F.size(x) - head - tail) for x in (a, b))


def verified(a: Column, b: Column, k: int) -> Column:
    """Whether two arrays of characters are within k edits: bit-parallel on what is left between their common ends."""
    ends = F.array(F.struct(*(x.alias(n) for x, n in zip(trimmed(a, b), "ab", strict=True))))

    def decide(s: Column) -> Column:
        x, y = s["a"], s["b"]
        none = F.least(F.size(x), F.size(y)) <= k
        pad = F.array_repeat(F.lit(""), k + 1)  # equal ends change nothing and make both longer than k
        return within_edits(F.when(none, F.concat(pad, x)).otherwise(x), F.when(none, F.concat(pad, y)).otherwise(y), k)

    return F.transform(ends, decide)[0]


def linked(shared: DataFrame, texts: DataFrame, k: int = K) -> DataFrame:
    """Verified links (a, b), as md5s, among the lines that share a key; texts: id, line, n and letter counts of these."""
    side = shared.select("key", "id", "own").join(texts.drop("line"), "id")
    a, b = side.alias("a"), side.alias("b")
    some = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & F.col("a.own") & (~F.col("b.own") | (F.col("a.id") < F.col("b.id")))
    apart = sum((F.abs(F.col(f"a.count_{i}") - F.col(f"b.count_{i}")) for i in range(len(LETTERS))), F.lit(0))
    most = F.least(F.lit(k), F.floor(F.least("a.n", "b.n") / PER_EDIT))
    near = (F.abs(F.col("a.n") - F.col("b.n")) <= most) & (apart <= 2 * most)
    pairs = a.join(b, some & near).select(F.least("a.id", "b.id").alias("i"), F.greatest("a.id", "b.id").alias("j")).distinct()
    whole = lambda i, x: texts.select(F.col("id").alias(i), F.col("line").alias(x))
    allowed = F.floor(F.least(F.length("x"), F.length("y")) / PER_EDIT)
    close = F.lit(False)
    for e in range(1, k + 1):
        close = F.when(allowed >= e, verified(F.split("x", ""), F.split("y", ""), e)).otherwise(close)
    return pairs.join(whole("i", "x"), "i").join(whole("j", "y"), "j").where(close).select(F.md5("x").alias("a"), F.md5("y").alias("b"))


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc, place, kept of every line that isn't blank."""
    lines = line_rows(docs, id_col, text_col)
    shared = materialise(shared_segments(lines, k), "shared-segments")
    # owners by a hash of the id, which null has too; documents that share one by chance are read in vain only
    owners = materialise(shared.select(F.xxhash64("doc").alias("owner")).distinct(), "line-owners")
    some = line_rows(semi_by_key(docs.withColumn("owner", F.xxhash64(id_col)), owners, "owner", owners.count()), id_col, text_col)
    ids = materialise(shared.select("id").distinct(), "line-ids")
    texts = semi_by_key(some.select(F.xxhash64("line").alias("id"), "line"), ids, "id", ids.count()).distinct()
    texts = materialise(texts.select("id", "line", F.length("line").alias("n"), *(c.alias(x) for x, c in letter_counts(F.col("line")).items())), "line-texts")
    labels = components(materialise(linked(shared, texts, k), "line-links")).toDF("id", "component")

    labels = F.broadcast(labels) if labels.count() <= HEAVY_LINES else labels
    places = lines.select("doc", "place", F.md5("line").alias("id")).join(labels, "id", "left")
    places = materialise(places.select("doc", "place", F.coalesce("component", "id").alias("line")), "line-places")
    first = places.groupBy("line").agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first, "first-places")
    heavy = F.col("n") > max(HEAVY, places.count() // HEAVY_LINES)
    marked = places.join(F.broadcast(first.where(heavy).drop("n")), "line", "left")
    others = marked.where("first is null").drop("first").join(first.where(~heavy).drop("n"), "line", "left")
    kept = F.col("first").isNull() | F.struct("doc", "place").eqNullSafe(F.col("first"))
    return marked.where("first is not null").unionByName(others).select("doc", "place", kept.alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (places of dropped lines from 0, in order)."""
    gone = F.when(~F.col("kept"), F.col("place"))
    found = line_groups(docs, id_col, text_col, k).groupBy("doc").agg(F.array_sort(F.collect_list(gone)).alias("dropped"))
    sizes = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.coalesce(F.sum(F.size(F.split(F.col(text_col), "\n")).cast("long")), F.lit(0)).alias("n_lines"))
    found = found.withColumnRenamed("doc", "_doc")
    return sizes.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def without_dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """docs with the dropped lines taken out of their texts; ids identify documents here."""
    dropped = line_dedup(docs, id_col, text_col, k).select(F.col("doc_id").alias("_doc"), F.col("dropped").alias("_dropped"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("_dropped", i))
    return docs.join(dropped, F.col(id_col).eqNullSafe(F.col("_doc")), "left").withColumn(text_col, F.array_join(lines, "\n")).drop("_doc", "_dropped")
