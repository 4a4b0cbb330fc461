"""Aggregations (A1-A31). Null keys are left out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.shared import materialise


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.na.drop(subset=keys)


def count_sparse(df: DataFrame, keys: list[str]) -> DataFrame:
    """A1."""
    return _keyed(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_dense(df: DataFrame, area: str, month: str, id_col: str) -> DataFrame:
    """A2. Every seen area with every seen month; non-null ids; absent pairs are 0; sorted."""
    rows = _keyed(df, [area, month])
    grid = rows.select(area).distinct().crossJoin(rows.select(month).distinct())  # the dense panel is the result
    counts = rows.groupBy(area, month).agg(F.count(id_col).alias("n"))
    return grid.join(counts, [area, month], "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(area, month)


def count_pivot(df: DataFrame, key: str, group: str, groups: list | None = None) -> DataFrame:
    """A3. One column per group, zero where absent. Give the groups to save a job."""
    wide = _keyed(df, [key, group]).groupBy(key).pivot(group, groups).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4. Keys that occur more than once."""
    return count_sparse(df, keys).where("n > 1")


def merge_areas(df: DataFrame, keys: list[str], order: str, rules: list[tuple[str, str]] = [("Rank", "mean"), ("locations", "sum"), ("amount", "sum")]) -> DataFrame:  # noqa: B006
    """A5. By the first rule whose text a column's name holds: mean or sum; else the first non-null by `order`."""

    def one(c: str) -> Column:
        kind = next((k for part, k in rules if part.lower() in c.lower()), "first")
        value = F.col(f"`{c}`")
        agg = {"mean": F.avg, "sum": F.sum}.get(kind)
        return (agg(value) if agg else F.min_by(value, F.when(value.isNotNull(), F.col(order)))).alias(c)

    return _keyed(df, keys).groupBy(*keys).agg(*(one(c) for c in df.columns if c not in (*keys, order)))


def n_distinct(df: DataFrame, *cols: str) -> DataFrame:
    """A6."""
    return df.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in cols))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """A7. value, n, share in per cent of the non-null rows."""
    counts = count_sparse(df, [col]).withColumnRenamed(col, "value")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("value", "n", (F.col("n") * 100 / F.col("total")).alias("share")).orderBy(F.desc("n"), "value")


def missing_profile(df: DataFrame, cols: list[str], pair: tuple[str, str] | None = None) -> DataFrame:
    """A8. One row: for each column n_missing and pct_missing; for the pair both missing, one missing, consistent."""
    out = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        out += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}"), (F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"pct_{c}")]
    if pair:
        a, b = (F.col(c).isNull() for c in pair)
        out += [F.count_if(a & b).alias("both_missing"), F.count_if(a != b).alias("one_missing"), (F.count_if(a != b) == 0).alias("consistent")]
    return df.agg(*out)


def sentinel_audit(df: DataFrame, col: str, sentinel, others: list[str]) -> DataFrame:
    """A9. Rows with the sentinel, and how many of them still carry a value in each other column."""
    is_it = F.col(col) == F.lit(sentinel)
    return df.agg(F.count_if(is_it).alias("n_sentinel"), *(F.count_if(is_it & F.col(c).isNotNull()).alias(f"with_{c}") for c in others))


def mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10. The distinct pairs that differ, and how often."""
    return df.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def unmatched_share(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """A11. Share of rows without a match, in per cent."""
    hit = df.join(lookup.select(on, F.lit(1).alias("_hit")).distinct(), on, "left")
    return hit.agg((F.avg(F.col("_hit").isNull().cast("int")) * 100).alias("unmatched_pct"))


def by_year(df: DataFrame, month: str = "month") -> DataFrame:
    """A12."""
    return df.where(F.col(month).isNotNull()).groupBy(F.year(month).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def by_month(df: DataFrame, month: str = "month") -> DataFrame:
    """A12. Month of the year."""
    return df.where(F.col(month).isNotNull()).groupBy(F.month(month).alias("month_of_year")).agg(F.count(F.lit(1)).alias("n"))


def by_parent(df: DataFrame, lookup: DataFrame, on: str, parent: str) -> DataFrame:
    """A13. Counted before the join, so that only one row per key and task is shuffled."""
    counts = count_sparse(df, [on]).join(lookup.select(on, parent), on)
    out = counts.groupBy(parent).agg(F.sum("n").alias("n"))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(total).select(parent, "n", (F.col("n") * 100 / F.col("total")).alias("share"))


def top_areas(df: DataFrame, n: int, area: str = "area", value: str = "n") -> DataFrame:
    """A14. Ties go to the smaller area."""
    return _keyed(df, [area]).groupBy(area).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), area).limit(n)


def top_areas_in_year(df: DataFrame, n: int, year: int, area: str = "area", value: str = "n", month: str = "month") -> DataFrame:
    """A15. Totals in one year of the overall top n."""
    top = top_areas(df, n, area, value).select(area)
    return df.where(F.year(month) == year).join(top, area, "left_semi").groupBy(area).agg(F.sum(value).alias("total"))


def first_valid(df: DataFrame, key: str, year: int, cols: list[str], month: str = "month") -> DataFrame:
    """A16. Per key the first non-null of each column in the year."""
    rows = _keyed(df, [key]).where(F.year(month) == year)
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(month))).alias(c) for c in cols))


def empty_in_year(df: DataFrame, cols: list[str], year: int, month: str = "month") -> DataFrame:
    """A17. One row: whether each column is all null in the year."""
    return df.where(F.year(month) == year).agg(*((F.count(c) == 0).alias(c) for c in cols))


def split_static(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """A18. column, kind: static (one value per key), dynamic (more), or neither (all null)."""
    per = _keyed(df, [key]).groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in cols))
    most = per.agg(*(F.max(c).alias(c) for c in cols)).unpivot([], cols, "column", "most")
    return most.select("column", F.when(F.col("most") == 1, "static").when(F.col("most") > 1, "dynamic").otherwise("neither").alias("kind"))


def neighbour_stats(pairs: DataFrame, value: str, keys: tuple[str, str] = ("area", "month")) -> DataFrame:
    """A19. Sum, mean and median of the neighbours' values."""
    return pairs.groupBy(*keys).agg(F.sum(value).alias("neighbour_sum"), F.avg(value).alias("neighbour_mean"), F.percentile(value, F.lit(0.5)).alias("neighbour_median"))


def monthly_total(df: DataFrame, value: str = "n", month: str = "month") -> DataFrame:
    """A20."""
    return _keyed(df, [month]).groupBy(month).agg(F.sum(value).alias("total"))


def zero_share(df: DataFrame, value: str = "n", month: str = "month") -> DataFrame:
    """A21. Per cent of zero rows per month, rounded half to even."""
    return _keyed(df, [month]).groupBy(month).agg(F.bround(F.avg((F.col(value) == 0).cast("int")) * 100, 2).alias("zero_share"))


def rollup_parent(df: DataFrame, lookup: DataFrame, on: str, parent: str, value: str) -> DataFrame:
    """A22. Sums per parent; children without one are left out."""
    return df.join(lookup.select(on, parent), on).where(F.col(parent).isNotNull()).groupBy(parent).agg(F.sum(value).alias(value))


def rollup_weighted(df: DataFrame, overlay: DataFrame, on: str, target: str, value: str) -> DataFrame:
    """A23. overlay: (on, target, weight). Sums of value * weight, rounded half to even; what floating-point weights leave
    behind the sixth place doesn't decide a tie."""
    total = F.round(F.sum(F.col(value) * F.col("weight")), 6)
    return df.join(overlay, on).groupBy(target).agg(F.bround(total).cast("long").alias(value))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate; null where either is constant."""
    a, b = a.cast("double"), b.cast("double")
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def target_corr(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """A24. column, r; one job."""
    return df.agg(*(correlation(F.col(c), F.col(y)).alias(c) for c in cols)).unpivot([], cols, "column", "r")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """A25. i, j, a, b, r for all pairs of columns; absolute values; one job over the rows."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(correlation(F.col(cols[i]), F.col(cols[j])).alias(f"{i}_{j}") for i, j in pairs))
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.abs(f"{min(i, j)}_{max(i, j)}").alias("r")) for i in range(len(cols)) for j in range(len(cols))))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def high_corr_pairs(df: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """A26. Pairs above the threshold, each once, highest first."""
    return corr_matrix(df, cols).where((F.col("i") < F.col("j")) & (F.col("r") > threshold)).select("a", "b", "r").orderBy(F.desc("r"), "a", "b")


def exact_percentiles(df: DataFrame, cols: list[str], shares: list[float]) -> DataFrame:
    """column, q (array<double>, as long as shares): what percentile() gives, with no task that holds a column's values: these are counted,
    ranged, and written with their range, and only ranges that hold a wanted place are numbered. Columns without values have no row."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols)))
    counts = df.select(cells.alias("s")).select("s.*").where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    ranged = materialise(counts.repartitionByRange("column", "v").withColumn("_p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("column", "_p").agg(F.sum("c").alias("_c"))  # a row a range and column
    w = Window.partitionBy("column")
    before = sums.withColumns({"_before": F.sum("_c").over(w.orderBy("_p")) - F.col("_c"), "_n": F.sum("_c").over(w)})
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(shares))))
    ends = before.select("column", "_p", "_c", "_before", places.alias("p")).select("column", "_p", "_c", "_before", "p.*", F.explode(F.array(F.floor("p.at"), F.ceil("p.at"))).alias("place")).distinct()
    wanted = ends.where("place >= _before and place < _before + _c")
    held = ranged.join(F.broadcast(wanted.select("column", "_p", "_before").distinct()), ["column", "_p"])  # two rows a share and column at most
    last = F.sum("c").over(Window.partitionBy("column", "_p").orderBy("v")) + F.col("_before")
    numbered = held.withColumns({"_last": last}).withColumn("_first", F.col("_last") - F.col("c"))
    hits = numbered.join(F.broadcast(wanted.select("column", "_p", "i", "at", "place")), ["column", "_p"]).where("place >= _first and place < _last")
    low, high, at = F.min_by("v", "place"), F.max_by("v", "place"), F.first("at")
    one = hits.groupBy("column", "i").agg(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias("q"))
    return one.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A27. column, count, mean, std, min, q1, median, q3, max; exact quartiles."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    rest = df.agg(*(one(c).alias(c) for c in cols)).select(F.explode(F.array(*cols)).alias("s")).select("s.*")
    quartiles = [F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))]
    return rest.join(F.broadcast(exact_percentiles(df, cols, [0.25, 0.5, 0.75])), "column", "left").select("column", "count", "mean", "std", "min", *quartiles, "max")


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A28."""
    return df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def empty_share(df: DataFrame, point: str = "point") -> DataFrame:
    """A29. Per cent of rows without a point."""
    return df.agg((F.avg(F.col(point).isNull().cast("int")) * 100).alias("empty_pct"))


def scale_time(df: DataFrame, col: str) -> DataFrame:
    """A30. Adds col_s = (col - mean) / sample standard deviation over all rows; a constant column becomes 0."""
    stats = df.agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    scaled = F.when(F.col("_s") > 0, (F.col(col) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return df.crossJoin(stats).withColumn(f"{col}_s", scaled).drop("_m", "_s")  # one row


def dedup(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A31. Distinct rows, or per subset the first row by order."""
    if subset is None:
        return df.distinct()
    rest = [c for c in (order or df.columns) if c not in subset]
    row = F.struct(*df.columns)
    return df.groupBy(*subset).agg(F.min_by(row, F.struct(*rest)).alias("_row")).select("_row.*") if rest else df.select(*subset).distinct()
