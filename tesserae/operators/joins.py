"""Joins (J1-J14). Nulls never match; sizes decide how Spark joins, so nothing is forced to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = str | list[str]


def with_lookup(df: DataFrame, lookup: DataFrame, on: Keys) -> DataFrame:
    """J1. Left join; rows multiply where the lookup has several rows for a key."""
    return df.join(lookup, on, "left")


def require_match(df: DataFrame, lookup: DataFrame, on: Keys) -> DataFrame:
    """J2. As J1, but an error when some row has no match."""
    missing = df.join(lookup, on, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"rows without a match on {on}")
    return df.join(lookup, on)


def join_inner(df: DataFrame, other: DataFrame, on: Keys) -> DataFrame:
    """J3."""
    return df.join(other, on)


def attach_counts(panel: DataFrame, counts: DataFrame, on: Keys = ["area", "month"], count: str = "n") -> DataFrame:  # noqa: B006
    """J4. Left join of counts; absent ones are 0."""
    return panel.join(counts, on, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def attach_attrs(panel: DataFrame, attrs: DataFrame, on: Keys = ["area", "month"]) -> DataFrame:  # noqa: B006
    """J5."""
    return panel.join(attrs, on, "left")


def keep_known(df: DataFrame, keys: DataFrame, on: Keys) -> DataFrame:
    """J6."""
    return df.join(keys, on, "left_semi")


def missing_keys(a: DataFrame, b: DataFrame, on: str, sample: int = 5) -> DataFrame:
    """J7. n_missing keys of a that b lacks, and the first few of them."""
    gone = a.select(on).distinct().where(F.col(on).isNotNull()).join(b, on, "left_anti")
    few = gone.orderBy(on).limit(sample).agg(F.sort_array(F.collect_list(on)).alias("sample"))
    return gone.agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(few)  # one row each


def keep_in(df: DataFrame, col: str, values: list) -> DataFrame:
    """J8."""
    return df.where(F.col(col).isin(values))


def lookup_code(df: DataFrame, key: str, dim: DataFrame, dim_key: str, code: str) -> DataFrame:
    """J9. Adds the first code for a key, null when there is none."""
    one = dim.where(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias(key)).agg(F.min(code).alias(code))
    return df.join(one, key, "left")


def map_index(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """J10. index: key and its dense number; keys without a number are left out."""
    return df.join(index, key)


def neighbour_join(panel: DataFrame, edges: DataFrame, value: str, month: str = "month") -> DataFrame:
    """J11. area, neighbour, month and the neighbour's value in that month."""
    other = panel.select(F.col("area").alias("neighbour"), month, F.col(value).alias(f"neighbour_{value}"))
    return edges.select("area", "neighbour").join(other, "neighbour").select("area", "neighbour", month, f"neighbour_{value}")


def month_range(spark, start: str, end: str) -> DataFrame:
    """One row per month, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))


def panel_grid(areas: DataFrame, start: str, end: str) -> DataFrame:
    """J12. Every area in every month; the months are an array on each row, so nothing is shuffled."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return areas.select("area").distinct().withColumn("month", F.explode(months))


def label_events(df: DataFrame, bands: DataFrame, month: str = "month") -> DataFrame:
    """J13. Rows with the labels of the bands (label, start, finish) that hold their month; null when none does.

    Bands are dealt to the months that they span, which makes the range join an equality join.
    """
    own = bands.select("label", F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("finish", "MM"), F.expr("interval 1 month"))).alias("_m"), "start", "finish")
    hit = (F.trunc(F.col(month), "MM") == F.col("_m")) & (F.col(month) >= F.col("start")) & (F.col(month) <= F.col("finish"))
    return df.join(own, hit, "left").drop("_m", "start", "finish")


def compare(pred: DataFrame, actual: DataFrame, on: Keys, a: str = "predicted", b: str = "actual") -> DataFrame:
    """J14. Both side by side, and predicted - actual; rows of either side stay."""
    return pred.join(actual, on, "full").withColumn("difference", F.col(a) - F.col(b))
