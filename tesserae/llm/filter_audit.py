"""Interaction audit of five document filters over every order in which they can be applied.

Each document has a mask of the filters that it fails. An order removes it at the first of its filters, so for one mask
the orders that remove it at a step with a filter are those that begin with certain prefixes: filters outside of the mask, then
that filter. Orders with one prefix are neighbours in lexicographic order, an interval whose ends come from the prefix's
Lehmer rank. Counts per mask are added at the ends of its intervals, and a running sum over the ranks gives what each
order removes at each step. Texts aren't looked at again for any order.

Filters, on whole texts (null: empty; words are runs without white space): A under 200 words; B under half as many
distinct words as words; C over 2 per cent capitals A-Z; D any of #$%&*|; E an equal text under a smaller id.

Defined cases: rows with a null id never fail E and make no other fail it, and have no labels; rows that repeat an id count
one by one, and none of them fails E because of another; of labels that repeat an id, any that says 1 counts; a null part is the
empty string; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))


def rank_of(prefix: str, letters: str = FILTERS) -> int:
    """Lexicographic rank of the first order that begins with prefix: at each place, the letters left that are smaller
    times the orders of what then remains (the Lehmer code)."""
    left, rank = list(letters), 0
    for c in prefix:
        rank += left.index(c) * factorial(len(left) - 1)
        left.remove(c)
    return rank


def intervals(letters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """mask, step, begin, end (exclusive): the ranks of the orders that remove a document with that mask at that step;
    neighbouring intervals are one."""
    out = []
    masks = [set(m) for k in range(1, len(letters) + 1) for m in combinations(letters, k)]
    for mask in masks:
        bits = sum(1 << letters.index(c) for c in mask)
        rest = [c for c in letters if c not in mask]
        for before in range(len(rest) + 1):
            spans = sorted(rank_of("".join(p) + c) for p in permutations(rest, before) for c in mask)
            width, merged = factorial(len(letters) - before - 1), []
            for at in spans:
                if merged and merged[-1][1] == at:
                    merged[-1][1] = at + width
                else:
                    merged.append([at, at + width])
            out += [(bits, before + 1, a, b) for a, b in merged]
    return out


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails. The words are an array of their own column, see failed()."""
    count, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [count < 200, 100 * distinct < 50 * count, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def failed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, digest of the text, mask of A to D; one row per document, without its text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    return rows.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), text_mask(F.col("_text")).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of each part fail exactly the filters of each mask.

    Copies are never brought together: rows become counts per text and part, with the smallest id among them, before they
    meet by text; all rows of such a group but those with the text's smallest id fail E."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed(docs, id_col, text_col, part_col).join(marks, "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    key = ["digest", "part", "mask", "good", "toxic"]
    same_id = rows.select("digest", "part", "mask", flag("good"), flag("toxic"), "id").groupBy("id", *key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    groups = same_id.groupBy(*key).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"),
        F.min(F.when(known, F.struct("id", "n"))).alias("first"),
    )
    lowest = groups.groupBy("digest").agg(F.min("first.id").alias("lowest"))
    kept = F.when(F.col("first.id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = groups.join(lowest, "digest").select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("unknown") + kept).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("known") - kept).alias("n")))).alias("m")
    )
    n = F.col("m.n")
    counts = split.where(n > 0).groupBy("part", F.col("m.mask").alias("mask"))
    return counts.agg(F.sum(n).alias("docs"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def removals(counts: DataFrame) -> DataFrame:
    """part, rank, step, removed, good_lost, toxic_lost from counts per part and mask: differences at the ends of each
    mask's intervals, and their running sum over the ranks."""
    spark = counts.sparkSession
    spans = F.broadcast(spark.createDataFrame(intervals(), "mask int, step int, begin int, end int"))  # of fixed size
    names = ("docs", "good", "toxic")
    signed = lambda at, sign: F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in names))
    ends = counts.join(spans, "mask").select("part", "step", F.explode(F.array(signed("begin", 1), signed("end", -1))).alias("e")).select("part", "step", "e.*").where(F.col("rank") < ORDERS)
    grid = counts.select("part").distinct()
    for name, top in (("step", len(FILTERS)), ("rank", ORDERS)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0 if name == "rank" else 1), F.lit(top - 1 if name == "rank" else top))))
    zero = grid.select("part", "step", "rank", *(F.lit(0).cast("long").alias(c) for c in names))
    differences = ends.unionByName(zero).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in names))
    up_to = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # 120 rows
    return differences.select("part", "rank", "step", *(F.sum(c).over(up_to).alias(o) for c, o in zip(names, ("removed", "good_lost", "toxic_lost"), strict=True)))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (what the step's filter removes over all orders)."""
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    rows = removals(counts)
    orders = ["".join(p) for p in permutations(FILTERS)]
    letters = docs.sparkSession.createDataFrame([(r, o, s + 1, c) for r, o in enumerate(orders) for s, c in enumerate(o)], "rank int, filter_order string, step int, filter string")
    bit = lambda k: F.col("mask").bitwiseAND(1 << k) > 0
    per = counts.groupBy("part").agg(
        F.sum("docs").alias("all"), F.array(*(F.sum(F.when(bit(k), F.col("docs")).otherwise(0)) for k in range(len(FILTERS)))).alias("fails"),
        F.array(*(F.sum(F.when(F.col("mask") == 1 << k, F.col("docs")).otherwise(0)) for k in range(len(FILTERS)))).alias("alone"),
    )
    rows = rows.join(F.broadcast(letters), ["rank", "step"]).join(per, "part").withColumn("_k", F.ascii("filter") - ord("A"))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # five rows
    return rows.select(
        "part", "filter_order", "step", "filter", (F.col("all") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (F.get("fails", F.col("_k")) - F.col("removed")).alias("redundant"), F.get("alone", F.col("_k")).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),  # 600 rows a part in all
    )
