"""Windows and panel operators (W1-W8, N1-N9) over (area, month). Windows of one area share one partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.aggregate import first_valid
from tesserae.operators.joins import panel_grid
from tesserae.sources.shared import materialise


def _by_area(area: str = "area", month: str = "month"):
    return Window.partitionBy(area).orderBy(month)


def add_lags(df: DataFrame, lags: list[int], value: str = "n") -> DataFrame:
    """W1. lag_k: the value k rows (months) before."""
    w = _by_area()
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def add_rolling(df: DataFrame, sizes: list[int], value: str = "n") -> DataFrame:
    """W2. roll_k: mean of the k months before; null until there are k."""
    out = {}
    for k in sizes:
        w = _by_area().rowsBetween(-k, -1)
        out[f"roll_{k}"] = F.when(F.count(value).over(w) == k, F.avg(value).over(w))
    return df.withColumns(out)


def fill_both(df: DataFrame, cols: list[str], area: str = "area", month: str = "month") -> DataFrame:
    """W3. Forward, then backward fill within an area."""
    w = _by_area(area, month)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in cols})


def latest_per(df: DataFrame, key: str = "area", month: str = "month") -> DataFrame:
    """W4. The row with the greatest month; ties go to the least of the other columns. Pre-aggregated, no window."""
    rest = [c for c in df.columns if c not in (key, month)]
    best = F.max_by(F.struct(*df.columns), F.struct(month)) if not rest else F.min_by(F.struct(*df.columns), F.struct(-F.unix_date(month), *rest))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_row")).select("_row.*")


def earliest_per(df: DataFrame, key: str = "area", month: str = "month") -> DataFrame:
    """W5."""
    rest = [c for c in df.columns if c not in (key, month)]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(month, *rest)).alias("_row")).select("_row.*")


def group_mean(df: DataFrame, value: str, key: str = "month") -> DataFrame:
    """W6. The mean of a month on each of its rows: aggregated first and joined back, since months are few and large."""
    return df.join(df.groupBy(key).agg(F.avg(value).alias(f"mean_{value}")), key)


def index_keys(df: DataFrame, key: str, start: int = 0, order: Column | None = None) -> DataFrame:
    """W7. key, idx: dense numbers of the distinct keys, in the order in which they first appear by order, or in their own; ties go to
    the smaller key. The table serves both directions.

    There is no global window: keys are range-partitioned and written with their partition, whose sizes, one row each, give
    the offsets; so both uses of a partition's number see the same rows."""
    first = F.min(F.col(key) if order is None else order).alias("_first")
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(first).repartitionByRange("_first", key)
    part = materialise(keys.withColumn("_p", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_first", key)) - 1
    return part.join(before.select("_p", "_before"), "_p").select(key, (place + F.col("_before") + start).cast("long").alias("idx"))


def budget_pick(df: DataFrame, cap: int, group: str, guaranteed: str, score: str, tie: str) -> DataFrame:
    """W8. All guaranteed rows of a group, then the best others until there are cap rows."""
    w = Window.partitionBy(group).orderBy(F.desc(guaranteed), F.desc(score), tie)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col(guaranteed) | (F.col("_place") <= cap)).drop("_place")


def replicate(df: DataFrame, start: str, end: str) -> DataFrame:
    """N1. Every row in each month from start up to end, end excluded."""
    months = F.sequence(F.lit(start).cast("date"), F.add_months(F.lit(end).cast("date"), -1), F.expr("interval 1 month"))
    return df.withColumn("month", F.explode(months))


def extend_forward(df: DataFrame, to: str, key: str = "area") -> DataFrame:
    """N2. Copies of an area's latest row for the months after it, up to `to`."""
    last = latest_per(df, key).where(F.col("month") < F.lit(to).cast("date"))
    more = F.sequence(F.add_months("month", 1), F.lit(to).cast("date"), F.expr("interval 1 month"))
    return df.unionByName(last.withColumn("month", F.explode(more)))


def extend_backward(df: DataFrame, to: str, key: str = "area") -> DataFrame:
    """N3. Copies of an area's earliest row for the months before it, down to `to`."""
    first = earliest_per(df, key).where(F.col("month") > F.lit(to).cast("date"))
    more = F.sequence(F.lit(to).cast("date"), F.add_months("month", -1), F.expr("interval 1 month"))
    return df.unionByName(first.withColumn("month", F.explode(more)))


def year_to_months(df: DataFrame, last: int, month: str = "month") -> DataFrame:
    """N4. A row of a year up to `last` becomes twelve, one per month; later rows stay as they are."""
    year = F.trunc(month, "YEAR")
    months = F.when(F.year(month) <= last, F.sequence(year, F.add_months(year, 11), F.expr("interval 1 month"))).otherwise(F.array(month))
    return df.withColumn(month, F.explode(months))


def yearly_to_grid(df: DataFrame, start: str, end: str, cols: list[str]) -> DataFrame:
    """N5. Yearly attributes (area, year) on a monthly grid, filled both ways."""
    grid = panel_grid(df, start, end).withColumn("year", F.year("month"))
    return fill_both(grid.join(df, ["area", "year"], "left"), cols)


def populate_from(df: DataFrame, cols: list[str], base: int, target: int, month: str = "month") -> DataFrame:
    """N6. Columns that are empty in the target year take, per area, their first value of the base year there."""
    empty = df.where(F.year(month) == target).agg(*((F.count(c) == 0).alias(f"_empty_{c}") for c in cols))
    values = first_valid(df, "area", base, cols, month).select("area", *(F.col(c).alias(f"_base_{c}") for c in cols))
    joined = df.join(values, "area", "left").crossJoin(empty)  # one row
    use = lambda c: F.when((F.year(month) == target) & F.col(f"_empty_{c}"), F.coalesce(F.col(c), F.col(f"_base_{c}"))).otherwise(F.col(c))
    return joined.select(*((use(c).alias(c) if c in cols else F.col(c)) for c in df.columns))


def missing_months(df: DataFrame, start: str, end: str) -> DataFrame:
    """N7. area, n_missing and the missing months of each area that lacks some."""
    gone = panel_grid(df, start, end).join(df, ["area", "month"], "left_anti")
    return gone.groupBy("area").agg(F.count(F.lit(1)).alias("n_missing"), F.array_sort(F.collect_list("month")).alias("months"))


def complete_panel(df: DataFrame, start: str, end: str, cols: list[str], count: str | None = None) -> DataFrame:
    """N8. Every area in every month: attributes filled both ways, the count 0 where there was no row."""
    out = fill_both(panel_grid(df, start, end).join(df, ["area", "month"], "left"), cols)
    return out.withColumn(count, F.coalesce(count, F.lit(0))) if count else out


def stack(frames: list[DataFrame]) -> DataFrame:
    """N9. Union by name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
