"""Evaluation on predictive draws (E1-E11): a long table (area, month, draw, value) against (area, month, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.stats import normal_cdf, normal_pdf
from tesserae.operators.aggregate import value_shares

CELL = ["area", "month"]


def draws_wide(draws: DataFrame) -> DataFrame:
    """E1. The draws of a cell as an array in the order of draws; as long as there are draws."""
    return draws.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("draw", "value"))).alias("d")).select(*CELL, F.col("d.value").alias("draws"))


def post_mean(draws: DataFrame) -> DataFrame:
    """E2."""
    return draws.groupBy(*CELL).agg(F.avg("value").alias("mean"))


def post_median(draws: DataFrame) -> DataFrame:
    """E3. The lower middle value."""
    return draws.groupBy(*CELL).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"))


def post_interval(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """E4."""
    return draws.groupBy(*CELL).agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).select(*CELL, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _errors(draws: DataFrame, observed: DataFrame):
    return post_median(draws).join(observed, CELL)


def rmse(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """E5."""
    return _errors(draws, observed).agg(F.sqrt(F.avg(F.pow(F.col("median") - F.col("n"), 2))).alias("rmse"))


def mae(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """E6."""
    return _errors(draws, observed).agg(F.avg(F.abs(F.col("median") - F.col("n"))).alias("mae"))


def crps(draws: DataFrame, observed: DataFrame, against: str = "observed") -> DataFrame:
    """E7. Mean CRPS of a normal with the draws' mean and sample standard deviation (1e-6 at least), against the
    observed count or, for parity, against the draws' own median."""
    moments = draws.groupBy(*CELL).agg(
        F.avg("value").alias("m"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("s"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median")
    )
    y = F.col("n") if against == "observed" else F.col("median")
    z = (y - F.col("m")) / F.col("s")
    score = F.col("s") * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / F.sqrt(F.pi()))
    return moments.join(observed, CELL).agg(F.avg(score).alias("crps"))


def coverage_curve(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """E8. For alpha 0.05 to 0.95: per cent of cells within the interval, and its mean width; one pass over the draws."""
    alphas = [round(0.05 * i, 2) for i in range(1, 20)]
    points = F.array(*(F.lit(q) for a in alphas for q in (a / 2, 1 - a / 2)))
    cells = draws.groupBy(*CELL).agg(F.percentile("value", points).alias("q")).join(observed, CELL)
    pairs = F.array(*(F.struct(F.lit(a).alias("alpha"), F.col("q")[2 * i].alias("low"), F.col("q")[2 * i + 1].alias("high")) for i, a in enumerate(alphas)))
    rows = cells.select("n", F.explode(pairs).alias("p")).select("n", "p.*")
    return rows.groupBy("alpha").agg((F.avg(F.col("n").between(F.col("low"), F.col("high")).cast("int")) * 100).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"))


def worst(draws: DataFrame, observed: DataFrame, k: int) -> DataFrame:
    """E9. The k largest over-predictions."""
    rows = _errors(draws, observed).select(*CELL, "median", "n", (F.col("median") - F.col("n")).alias("difference"))
    return rows.orderBy(F.desc("difference"), *CELL).limit(k)


def interval_table(bounds: DataFrame, mean: str = "mean", low: str = "low", high: str = "high") -> DataFrame:
    """E10. Error sizes on both sides, and whether the interval holds zero."""
    return bounds.withColumns({"error_low": F.col(mean) - F.col(low), "error_high": F.col(high) - F.col(mean), "contains_zero": (F.col(low) <= 0) & (F.col(high) >= 0)})


def median_counts(draws: DataFrame) -> DataFrame:
    """E11. How often each median occurs."""
    return value_shares(post_median(draws), "median")
