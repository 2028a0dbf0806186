"""Readers for event files, long weather tables, pixel tables and daily series."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_date, to_number
from ..operators.clean import canonical_columns
from ..operators.ordered import first_per_key
from ..session import cut_lineage

FILE_GLOB = "*_FPA_FOD_cons.csv"
#: The year of a file, or of a folder of part files, of that name.
YEAR_PATTERN = r"([0-9]{4})_[^/]*(/part-[^/]*)?$"


def _layout(spark: SparkSession, header: str) -> list[str]:
    """Canonical column names of a header line; a repeated name gets its position."""
    names = [n.strip() or f"_c{i}" for i, n in enumerate(next(csv.reader([header.lstrip("\ufeff")])))]
    empty = spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(names)))).toDF(*names)
    found = []
    for i, name in enumerate(canonical_columns(empty).columns if len(set(names)) == len(names) else names):
        found.append(f"{name}{i}" if name in found else name)
    return found


def read_events(spark: SparkSession, folder: str, glob: str = FILE_GLOB, years: list[int] | None = None, corrupt: str = "corrupt_line") -> tuple[DataFrame, list[int]]:
    """Union of yearly CSV files as text columns, and the expected years that are absent.

    All files are one scan of lines.  Each file's first line is its header; a line is read
    by its own file's header, whatever the columns and their order.  Lines with too many or
    too few fields are kept with the fields that fit, and whole in the ``corrupt`` column,
    which is null elsewhere.  Repeated headers and blank lines are dropped, files without a
    year in their name skipped, a missing FIRE_YEAR is filled in.  Quoted line breaks are not
    supported.  Only distinct headers and years reach the driver.
    """
    lines = spark.read.text(f"{folder.rstrip('/')}/{glob}").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    lines = lines.withColumn("_year", F.regexp_extract("_file", YEAR_PATTERN, 1)).where(F.col("_year") != "")
    first = lines.where(F.col("_block") == 0).withColumn("_line", F.monotonically_increasing_id())
    heads = cut_lineage(first.groupBy("_file", "_year").agg(F.min_by("value", "_line").alias("_header")), "headers")
    headers = sorted(r["_header"] for r in heads.select("_header").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"no file like {glob} with a year in {folder}")
    seen = {int(r["_year"]) for r in heads.select("_year").distinct().collect()}
    rows = lines.join(heads.drop("_year"), "_file").where((F.col("value") != F.col("_header")) & (F.trim("value") != ""))
    layouts = [_layout(spark, h) for h in headers]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    parsed = []
    for i, (header, names) in enumerate(zip(headers, layouts)):
        fields = ", ".join([*[f"c{j} string" for j in range(len(names))], "bad string"])
        parsed.append(F.when(F.col("_header") == header, F.from_csv("value", fields, options)).alias(f"_l{i}"))
    rows = rows.select("_year", *parsed)
    out = []
    for name in dict.fromkeys([*(n for names in layouts for n in names), "FIRE_YEAR"]):
        cells = [F.col(f"_l{i}.c{names.index(name)}") for i, names in enumerate(layouts) if name in names]
        if name == "FIRE_YEAR":
            cells += [F.when(F.col(f"_l{i}").isNotNull(), F.col("_year")) for i, names in enumerate(layouts) if name not in names]
        out.append(F.coalesce(*cells).alias(name))
    bad = F.coalesce(*[F.col(f"_l{i}.bad") for i in range(len(layouts))]).alias(corrupt)
    return rows.select(*out, F.col("_year").cast("int").alias("source_year"), bad), [y for y in (years or []) if y not in seen]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header where there is no readable parquet."""
    from pyspark.errors import AnalysisException

    if path.endswith(".csv"):
        return spark.read.csv(path, header=True)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        stem = path[: -len(".parquet")] if path.endswith(".parquet") else path
        return spark.read.csv(f"{stem}.csv", header=True)


def clean_points(raw: DataFrame, lat: str, lon: str, date: str, year: int | None = None) -> DataFrame:
    """Detections with usable coordinates and date, of one year when given, Fire = 1."""
    missing = [c for c in (lat, lon, date) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    df = raw.withColumn(lat, to_number(lat)).withColumn(lon, to_number(lon)).withColumn(date, to_date(date))
    df = df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & F.col(date).isNotNull())
    if year is not None:
        df = df.where(F.year(date) == year)
    return df.withColumn("Fire", F.lit(1))


def read_points(spark: SparkSession, path: str, year: int | None = None, lat="latitude", lon="longitude", date="acq_date") -> DataFrame:
    return clean_points(spark.read.csv(path, header=True), lat, lon, date, year)


def read_grid_long(spark: SparkSession, path: str, variables: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """(var, date, row, col, raw) rows; variable and date limits prune partitions."""
    df = spark.read.parquet(path)
    if variables:
        df = df.where(F.col("var").isin(*variables))
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
        if "year" in df.columns:
            df = df.where(F.col("year") >= int(first[:4]))
    if last:
        df = df.where(F.col("date") <= F.lit(last).cast("date"))
        if "year" in df.columns:
            df = df.where(F.col("year") <= int(last[:4]))
    return df


def mosaic_pixels(tiles: DataFrame) -> DataFrame:
    """Tiles of each layer on one global (row, col); at seams the first tile by name wins.

    ``tiles`` has layer, tile, row_off, col_off, row, col, value.
    """
    placed = tiles.select(
        "layer", (F.col("row") + F.col("row_off")).alias("row"), (F.col("col") + F.col("col_off")).alias("col"), "tile", "value"
    )
    return first_per_key(placed, ["layer", "row", "col"], ["tile"]).drop("tile")


def read_pixels(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if layer is None else df.where(F.col("layer") == layer)


def read_daily_scalar(spark: SparkSession, path: str, date: str = "date", value: str = "value") -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.select(to_date(date).alias(date), to_number(value).alias(value)).where(F.col(date).isNotNull())
