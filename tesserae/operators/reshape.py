"""Reshape, sort and limit (R1-R7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.panel import latest_per


def melt(df: DataFrame, ids: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """R1."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], label, value)


def widen(df: DataFrame, ids: list[str], label: str, value: str, labels: list[str], order: str | None = None) -> DataFrame:
    """R2. The first non-null value per label; labels without rows are null columns."""
    own = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order or value)))
    return df.groupBy(*ids).pivot(label, labels).agg(own)


def composition(df: DataFrame, area, cols: list[str], key: str = "area", month: str = "month") -> DataFrame:
    """R3. (label, value) of one area's latest row."""
    return latest_per(df.where(F.col(key) == area), key, month).select(*(F.col(c).cast("double").alias(c) for c in cols)).unpivot([], cols, "label", "value")


def last_row_fields(df: DataFrame, key: str = "area", month: str = "month") -> DataFrame:
    """R4. key, field, value (text) of each key's latest row."""
    rest = [c for c in df.columns if c != key]
    return latest_per(df, key, month).select(key, *(F.col(c).cast("string").alias(c) for c in rest)).unpivot([key], rest, "field", "value")


def sort_by(df: DataFrame, *keys: str) -> DataFrame:
    """R5."""
    return df.orderBy(*keys)


def top_k(df: DataFrame, col: str, k: int, *ties: str) -> DataFrame:
    """R6."""
    return df.orderBy(F.desc(col), *ties).limit(k)


def month_labels(df: DataFrame, month: str = "month") -> DataFrame:
    """R7. The months that occur and their labels, newest first."""
    return df.where(F.col(month).isNotNull()).select(month).distinct().select(month, F.date_format(month, "yyyy-MMMM").alias("label")).orderBy(F.desc(month))
