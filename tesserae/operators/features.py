"""Model preparation (M1-M7). A feature build returns the frame and the names of its six groups of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.clean import in_period, month_index, seasonal
from tesserae.operators.aggregate import scale_time
from tesserae.operators.clean import complete_cases, interact
from tesserae.operators.panel import add_lags, add_rolling
from tesserae.operators.spatial import add_neighbour_lags, neighbour_count, with_area

GROUPS = ("static", "dynamic", "seasonal", "time_trend", "temporal", "spatial")
#: The periods that features are crossed with.
PERIODS = {"during": ("1998-03-01", "1999-07-01"), "after": ("1999-08-01", None)}


def build_features(panel: DataFrame, areas: DataFrame, edges: DataFrame, static: list[str], dynamic: list[str], periods=PERIODS) -> tuple[DataFrame, dict[str, list[str]]]:
    """M1. panel (area, month, n, ...): time, seasonal, temporal, static spatial, dynamic spatial, interactions, complete
    cases. Only columns named in static and dynamic are used, so a caller decides what a model may see."""
    origin = panel.agg(F.min("month").alias("_origin"))
    df = panel.crossJoin(origin).withColumn("t", month_index(F.col("month"), F.col("_origin")).cast("double")).drop("_origin")  # one row
    df = scale_time(df, "t").withColumns({"t_log": F.log1p("t"), "t_sq": F.pow("t_s", F.lit(2)), "season": seasonal(F.col("month"))})
    df = df.withColumns({k: in_period(F.col("month"), *p) for k, p in periods.items()})
    df = add_rolling(add_lags(df, [1, 2, 3, 12]), [3, 6, 12])
    sizes = with_area(areas).select("area", "size").join(neighbour_count(areas, edges), "area")
    df = add_neighbour_lags(df.join(sizes, "area"), edges)
    groups = {
        "static": [*static, "size", "neighbours"],
        "dynamic": list(dynamic),
        "seasonal": ["season"],
        "time_trend": ["t_s", "t_log", "t_sq"],
        "temporal": [f"lag_{k}" for k in (1, 2, 3, 12)] + [f"roll_{k}" for k in (3, 6, 12)],
        "spatial": ["neighbour_sum", "neighbour_median"],
    }
    crossed = [c for g in ("dynamic", "temporal", "spatial") for c in groups[g]]
    for flag in periods:
        df = interact(df, crossed, flag)
        for g in ("dynamic", "temporal", "spatial"):
            groups[g] = groups[g] + [f"{c}_x_{flag}" for c in groups[g] if c in crossed]
    keep = ["area", "month", "n", *(c for g in GROUPS for c in groups[g])]
    return complete_cases(df.select(*keep)), groups


def select_groups(df: DataFrame, groups: dict[str, list[str]], order: tuple[str, ...] = GROUPS) -> list[str]:
    """M2. The columns of the groups in their fixed order; an error when one is missing."""
    cols = [c for g in order for c in groups.get(g, [])]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns that the frame lacks: {missing}")
    return cols


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M3. Mean and population standard deviation of each column (0 becomes 1); one job."""
    row = df.agg(*(f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """M3. With the statistics of the training rows."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in stats.items()})


def ward_map(df: DataFrame, area: str = "area", ward: str = "ward") -> DataFrame:
    """M4. area, ward, one row per area; an error when an area lacks one."""
    rows = df.where(F.col(area).isNotNull()).groupBy(area).agg(F.min(ward).alias(ward))
    if not rows.where(F.col(ward).isNull()).isEmpty():
        raise ValueError("areas without a ward")
    return rows


def split_last(df: DataFrame, month: str = "month") -> tuple[DataFrame, DataFrame]:
    """M5."""
    return split_last_n(df, 1, month)


def split_last_n(df: DataFrame, n: int, month: str = "month") -> tuple[DataFrame, DataFrame]:
    """M6. Train and the last n months."""
    cut = df.agg(F.add_months(F.max(month), 1 - n).alias("cut")).first()["cut"]
    return df.where(F.col(month) < F.lit(cut)), df.where(F.col(month) >= F.lit(cut))


def rolling_splits(df: DataFrame, n: int, month: str = "month") -> list[tuple[DataFrame, DataFrame]]:
    """M7. For each of the last n months: all rows before it, and its rows."""
    last = df.agg(F.max(month).alias("m")).first()["m"]
    at = [F.add_months(F.lit(last), -i) for i in range(n - 1, -1, -1)]
    return [(df.where(F.col(month) < m), df.where(F.col(month) == m)) for m in at]


