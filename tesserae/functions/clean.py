"""Column expressions for messy text, dates and numbers (P and F items of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_month(col: Column, fmt: str = "yyyy-MM") -> Column:
    """P2. Text to the first day of its month; fmt is yyyy-MM, MM-yyyy or yyyy; bad text is null."""
    text = F.concat(col, F.lit("-01")) if fmt == "yyyy" else col
    return F.trunc(F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM" if fmt == "yyyy" else fmt))), "MM")


def to_ts_lenient(col: Column) -> Column:
    """P3."""
    return F.try_to_timestamp(col)


def to_num_lenient(col: Column, kind: str = "float") -> Column:
    """P4."""
    return col.try_cast(kind)


def make_point(x: Column, y: Column) -> Column:
    """P6. A struct of both, null when either is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def flag_contains(col: Column, part: str) -> Column:
    """P12. Case-sensitive; null is false."""
    return F.coalesce(col.contains(part), F.lit(False))


def to_flag(col: Column, null_as: bool = True) -> Column:
    """P13. Text to boolean; what isn't one, null included, is null_as."""
    return F.coalesce(col.try_cast("boolean"), F.lit(null_as))


def rank_to_int(col: Column, style: str = "comma") -> Column:
    """P19. "1234,00" (comma) or "1.234" (dot) to int."""
    return F.regexp_replace(col, r",00$" if style == "comma" else r"\.", "").try_cast("int")


def eu_number(col: Column, strict: bool = False) -> Column:
    """P20. "1.234,5 %" to 1234.5: per cent signs, spaces and dots go, the comma is the decimal mark, dashes and
    missing marks are blank. A dash anywhere goes, sign included; strict keeps a leading sign."""
    text = F.regexp_replace(F.regexp_replace(col, r"[%\s.]", ""), ",", ".")
    text = F.regexp_replace(text, r"N/A|nan", "")
    text = F.regexp_replace(text, r"(?<=.)-|^-$" if strict else "-", "")
    return F.nullif(text, F.lit("")).try_cast("double")


def simple_number(col: Column) -> Column:
    """P21. Comma to dot, dots kept; missing marks are case-sensitive."""
    text = F.regexp_replace(F.regexp_replace(col, r"[%\s]", ""), ",", ".")
    return F.nullif(F.regexp_replace(text, r"^(-|N/A|nan)$", ""), F.lit("")).try_cast("double")


def split_label(col: Column) -> tuple[Column, Column]:
    """P22. "name|YYYY" to (name, year)."""
    year = F.regexp_extract(col, r"\|\s*(\d{4})\s*$", 1)
    return F.regexp_extract(col, r"^(.*?)\s*\|\s*\d{4}\s*$", 1), F.nullif(year, F.lit("")).cast("int")


def split_label_any(col: Column) -> tuple[Column, Column]:
    """P23. As split_label, else "(YYYY)" anywhere in the text."""
    name, year = split_label(col)
    other = F.nullif(F.regexp_extract(col, r"\((\d{4})\)", 1), F.lit("")).cast("int")
    plain = F.trim(F.regexp_replace(col, r"\s*\(\d{4}\)", ""))
    return F.coalesce(F.nullif(name, F.lit("")), plain), F.coalesce(year, other)


#: Accented letters and what they become.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def norm_name(col: Column) -> Column:
    """P24. Lower case without accents; letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(col), ACCENTED, PLAIN), "[^a-z0-9 ]", " "), " +", " "))


def slug(col: Column) -> Column:
    """P25. A file-safe name."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_|_$", "")


def in_period(month: Column, start: str, end: str | None = None) -> Column:
    """P28. 1 from start to end (both included, end open when null), else 0."""
    inside = month >= F.lit(start).cast("date")
    return (inside & (month <= F.lit(end).cast("date")) if end else inside).cast("int")


#: Points of interest by tag; the first rule that fits wins.
POI_RULES = [
    ("shop", "shop", None),
    ("emergency", "amenity", ["police", "hospital", "fire_station"]),
    ("education", "amenity", ["school", "university", "library"]),
    ("transport", "public_transport", ["station"]),
    ("transport", "railway", ["station"]),
    ("entertainment", "amenity", ["theatre", "cinema", "museum"]),
    ("leisure", "leisure", ["park"]),
    ("food", "amenity", ["restaurant", "cafe", "bar", "pub", "nightclub", "fast_food"]),
    ("parking", "amenity", ["parking"]),
]


def poi_group(tags: Column, rules: list[tuple[str, str, list[str] | None]] = POI_RULES) -> Column:
    """P29. The group of a map of tags; null when no rule fits."""
    out = F.lit(None).cast("string")
    for group, tag, values in reversed(rules):
        own = F.try_element_at(tags, F.lit(tag))
        out = F.when(own.isin(values) if values else own.isNotNull(), group).otherwise(out)
    return out


def month_index(month: Column, origin: Column) -> Column:
    """F1. Months from origin to month."""
    return (F.year(month) - F.year(origin)) * 12 + F.month(month) - F.month(origin)


def seasonal(month: Column) -> Column:
    """F2. Sine of the month's place in the year."""
    return F.sin(2 * F.pi() * F.month(month) / 12)


def rate_of(log_rate: Column) -> Column:
    """F3. exp of a log rate that is clamped to [-4, 4]."""
    return F.exp(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), log_rate)))


def clamp(col: Column, low, high) -> Column:
    """F4."""
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def has_any(col: Column, values: list[str]) -> Column:
    """F11. Whether an array holds one of values; null is false."""
    return F.coalesce(F.arrays_overlap(col, F.array(*map(F.lit, values))), F.lit(False))
