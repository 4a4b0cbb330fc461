"""Sources and sinks (S1-S8): every scan has an explicit schema and every sink is a plain Spark writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.geometry import hilbert_key


def read_extracts(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """S1. All CSV files below root whose name contains pattern; columns by name; empty when there is none."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{pattern}*.csv").csv(root)


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: str, sep: str = ",", keep: tuple[str, list] | None = None) -> DataFrame:
    """S2. CSV with a chosen delimiter to parquet; keep = (column, values) filters on the way."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).csv(src)
    if keep:
        rows = rows.where(F.col(keep[0]).isin(list(keep[1])))
    rows.write.parquet(dst)
    return spark.read.schema(rows.schema).parquet(dst)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S3. Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """S4. Range-partitioned, sorted, compressed parquet."""
    df.orderBy(*keys).write.option("compression", "gzip").parquet(path)


def write_by_place(df: DataFrame, path: str, x: str = "x", y: str = "y", files: int | None = None) -> None:
    """S4, by geometry. Range-partitioned and sorted along a Hilbert curve over the points' square, so each file and row group
    covers a small box and the scan's own statistics on x and y leave out all others; rows without a point come first."""
    low = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    x0, y0, side = (0.0, 0.0, 1.0) if None in low else (low[0], low[1], max(low[2] - low[0], low[3] - low[1]) or 1.0)
    key = hilbert_key(F.col(x), F.col(y), F.lit(float(x0)), F.lit(float(y0)), F.lit(float(side)), 16)
    keyed = df.withColumn("_place", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), key))
    dealt = keyed.repartitionByRange(files, "_place") if files else keyed.repartitionByRange("_place")
    dealt.sortWithinPartitions("_place").drop("_place").write.option("compression", "gzip").parquet(path)


def read_box(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    """The rows of a table whose points lie within a box, borders included; both conditions reach the scan."""
    return spark.read.parquet(path).where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def write_csv(df: DataFrame, path: str) -> None:
    """S5. CSV with a header."""
    df.write.option("header", True).csv(path)


_FEATURE = {"type": "string", "properties": "map<string, string>", "geometry": "struct<type: string, coordinates: string>"}
#: A polygon's coordinates are rings of points; those of several polygons have one level more.
_POLYGON = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S6. One row per Polygon or MultiPolygon feature: its properties, its rings, array<struct<part, hole, ring>>, the first
    ring of each part the outer one, and as ring the outer one of the first part. Other geometries are left out; a polygon
    without rings has an empty array.

    A file holds one FeatureCollection; with lines, one feature in each line, so that large files are split."""
    if lines:
        feature = spark.read.schema(", ".join(map(" ".join, _FEATURE.items()))).json(path).select(F.struct("*").alias("f"))
    else:
        feature = spark.read.schema(f"features array<struct<{', '.join(map(': '.join, _FEATURE.items()))}>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, _POLYGON))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_POLYGON}>"))
    ring = lambda points: F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = F.flatten(F.transform(F.col("parts"), lambda part, i: F.transform(part, lambda points, k: F.struct(i.alias("part"), (k > 0).alias("hole"), ring(points).alias("ring")))))
    return feature.select(F.col("f.properties").alias("properties"), parts.alias("parts")).where("parts is not null").select("properties", rings.alias("rings")).withColumn("ring", F.get("rings", F.lit(0))["ring"])


def read_lookup(spark: SparkSession, path: str, schema: str, cols: list[str]) -> DataFrame:
    """S7. Code lookup, some columns of it, each row once."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*cols).distinct()


def write_predictions(df: DataFrame, path: str) -> None:
    """S8. area, median."""
    df.select("area", "median").write.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """S8. area, median."""
    return spark.read.parquet(path).select("area", "median")
