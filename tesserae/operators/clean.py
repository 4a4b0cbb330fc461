"""Projections, predicates and cleaning of whole frames (P items)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.aggregate import exact_percentiles


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """P1. Null never matches."""
    return df.where(F.col(col) == F.lit(value))


def coerce_numeric(df: DataFrame, exclude: Iterable[str] = (".", "%", "Area", "mnemonic", "Sex")) -> DataFrame:
    """P5. Every column whose name holds none of exclude becomes a double; bad values become 0."""
    plain = [c for c in df.columns if not any(x in c for x in exclude)]
    return df.select(*(F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(c) if c in plain else F.col(f"`{c}`") for c in df.columns))


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """P7."""
    return df.na.drop(subset=cols)


def complete_cases(df: DataFrame) -> DataFrame:
    """P8."""
    return df.na.drop("any")


def fill_map(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """P9. Only the named columns."""
    return df.na.fill({k: v for k, v in values.items() if k in df.columns})


def fill_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P10. Only the named columns, not every null after a join."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def cast_cols(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """P11."""
    return df.select(*(F.col(c).cast(spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns))


def drop_if_exists(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P14."""
    return df.drop(*cols)


def drop_like(df: DataFrame, part: str) -> DataFrame:
    """P15."""
    return df.select(*(c for c in df.columns if part not in c))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """P16."""
    return df.withColumnsRenamed(dict(names))


def resolve_col(df: DataFrame, name: str, candidates: Iterable[str], otherwise: str | None = None) -> DataFrame:
    """P17. The first of candidates that is a column becomes `name`; else a copy of `otherwise`; else an error."""
    lower = {c.lower(): c for c in df.columns}
    found = next((lower[c.lower()] for c in candidates if c.lower() in lower), None)
    if found:
        return df.withColumnRenamed(found, name)
    if otherwise is None:
        raise ValueError(f"none of {list(candidates)} is a column")
    return df.withColumn(name, F.col(otherwise))


def tag(df: DataFrame, name: str, value) -> DataFrame:
    """P18."""
    return df.withColumn(name, F.lit(value))


def match_name(df: DataFrame, col: str, value: str) -> DataFrame:
    """P26. Whatever the case."""
    return df.where(F.lower(col) == value.lower())


def since(df: DataFrame, month: str, col: str = "month") -> DataFrame:
    """P27."""
    return df.where(F.col(col) >= F.lit(month).cast("date"))


def shrink_numeric(df: DataFrame) -> DataFrame:
    """P31. Integer columns become the smallest type that holds their range, doubles become floats; one job."""
    whole = [c for c, t in df.dtypes if t in ("smallint", "int", "bigint")]
    kinds = {c: "float" for c, t in df.dtypes if t == "double"}
    if whole:
        row = df.agg(*(f(c).alias(f"{n}_{c}") for c in whole for n, f in (("lo", F.min), ("hi", F.max)))).first()
        for c in whole:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            if lo is not None:
                kinds[c] = next(t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << b) <= lo and hi < 1 << b)
    return cast_cols(df, kinds)


def scale_bounds(df: DataFrame, col: str) -> DataFrame:
    """P32. low (the least value) and high (the 0.99 quantile); high is low + 1 when they are equal."""
    high = exact_percentiles(df, [col], [0.99]).select(F.col("q")[0].alias("high"))
    row = df.agg(F.min(col).cast("double").alias("low")).join(F.broadcast(high), F.lit(True), "left")  # one row each
    return row.withColumn("high", F.when(F.col("high") == F.col("low"), F.col("low") + 1).otherwise(F.col("high")))


def query(df: DataFrame, expr: str) -> DataFrame:
    """P33. A predicate as text."""
    return df.where(F.expr(expr))


def interact(df: DataFrame, cols: Iterable[str], flag: str) -> DataFrame:
    """P34. c_x_flag = c * flag for every column, in one projection."""
    return df.select("*", *((F.col(c) * F.col(flag)).alias(f"{c}_x_{flag}") for c in cols))


def pick_cols(df: DataFrame, suffix: str = "", any_of: Iterable[str] = ("",)) -> list[str]:
    """P35. Column names with the suffix that hold one of any_of."""
    return [c for c in df.columns if c.endswith(suffix) and any(x in c for x in any_of)]


def rep_point(ring: Column) -> Column:
    """P30. A point as it is, else the centroid."""
    from tesserae.functions.geometry import centroid

    return centroid(ring)
