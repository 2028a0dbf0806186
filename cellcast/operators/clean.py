"""Schema alignment, filtering, validation and fill rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import in_bbox
from ..functions.scalars import nullify_nan, to_date, to_number
from .ordered import first_per_key, top_n

# Canonical upper-case column names; any other spelling of case maps here.
CANONICAL = (
    "FOD_ID", "FPA_ID", "FIRE_YEAR", "FIRE_NAME", "FIRE_SIZE", "FIRE_SIZE_CLASS", "STATE", "COUNTY",
    "LATITUDE", "LONGITUDE", "DISCOVERY_DATE", "DISCOVERY_DOY", "DISCOVERY_TIME", "CONT_DATE", "CONT_DOY",
    "CONT_TIME", "OWNER_DESCR", "NWCG_REPORTING_AGENCY", "NWCG_GENERAL_CAUSE", "SOURCE_SYSTEM", "FIRE_CODE",
)

# Redundant columns and columns that must not reach a model.
REDUNDANT = (
    "bi", "tmmn", "fm1000", "sph", "bi_5D_mean", "bi_5D_max", "ecoregion_l2", "ecoregion_l3",
    "Ecoregion_NA_L2CODE", "Ecoregion_NA_L3CODE", "GACCAbbrev", "NWCG_GACC_NAME", "h3_resolution",
    "state", "state_x", "state_y",
)
FORBIDDEN = (
    "FIRE_SIZE", "FIRE_SIZE_CLASS", "CONT_DATE", "CONT_DOY", "CONT_TIME", "NWCG_CAUSE_CLASSIFICATION",
    "NWCG_GENERAL_CAUSE", "MTBS_ID", "MTBS_FIRE_NAME", "ICS_209_PLUS_INCIDENT_JOIN_ID",
    "ICS_209_PLUS_COMPLEX_JOIN_ID", "FIRE_NAME", "FOD_ID", "NWCG_CAUSE_AGE_CATEGORY",
)
SAMPLE_IDS = 50


def canonical_columns(df: DataFrame, names=CANONICAL, extra: dict[str, str] | None = None) -> DataFrame:
    """Case-insensitive rename to canonical names; unknown columns stay."""
    target = {n.lower(): n for n in names}
    target.update({k.lower(): v for k, v in (extra or {}).items()})
    return df.select(*[F.col(f"`{c}`").alias(target.get(c.lower(), c)) for c in df.columns])


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    have = set(df.columns)
    return next((c for c in candidates if c in have), None)


def schema_report(spark, frames: dict[str, DataFrame]) -> DataFrame:
    """Per column: sources that have it and that miss it, dtypes, mismatch flags, the rows of
    the sources that have it and its values that aren't null. One aggregate per source.
    """
    long = None
    for source, df in frames.items():
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
        cells = [
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"c{i}").alias("present"))
            for i, f in enumerate(df.schema)
        ]
        part = counts.select(F.lit(str(source)).alias("source"), "rows", F.explode(F.array(*cells)).alias("m")).select("source", "rows", "m.*")
        long = part if long is None else long.unionAll(part)
    every = F.array_sort(F.array(*[F.lit(str(s)) for s in frames]))
    out = long.groupBy("column").agg(
        F.array_sort(F.collect_set("source")).alias("present_in"),
        F.array_sort(F.collect_set("dtype")).alias("dtypes"),
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
    )
    return out.select(
        "column",
        F.array_join("present_in", ",").alias("present_in"),
        F.array_join(F.array_except(every, F.col("present_in")), ",").alias("missing_in"),
        F.array_join("dtypes", ",").alias("dtypes"),
        (F.size("dtypes") > 1).alias("dtype_mismatch"),
        (F.size("present_in") == len(frames)).alias("in_all"),
        "rows",
        "present",
    )


def merge_sources(frames: dict[str, DataFrame], name: str = "source_year") -> DataFrame:
    """Union by name with a provenance column; missing columns become null."""
    tagged = [df.withColumn(name, F.lit(tag)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def filter_partition(df: DataFrame, key: str, value: str, known: set[str] | None = None) -> DataFrame:
    if key not in df.columns:
        raise ValueError(f"no column {key!r}")
    if known is not None and value not in known:
        raise ValueError(f"unknown code {value!r}")
    return df.where(F.trim(F.upper(F.col(key))) == value)


def filter_events(df: DataFrame, size: str, year: str, lat: str, lon: str, min_size: float = 1.0, years=(2014, 2020)) -> DataFrame:
    return df.where(
        (to_number(size) >= min_size)
        & to_number(year).between(*years)
        & F.col(lat).isNotNull()
        & F.col(lon).isNotNull()
    )


def number_rule(c: str, low: float, high: float, allow_null: bool = False) -> Column:
    """True where the value breaks the range."""
    v = to_number(c)
    bad = (v < low) | (v > high)
    return F.coalesce(bad, F.lit(not allow_null))


def date_rule(c: str, df: DataFrame) -> Column:
    if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(c).isNull()
    return to_date(c).isNull()


def equals_rule(c: str, value: str) -> Column:
    return ~F.coalesce(F.upper(F.trim(F.col(c).cast("string"))) == value, F.lit(False))


def null_rule(c: str) -> Column:
    return F.col(c).isNull()


def member_rule(c: str, values) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def violations(df: DataFrame, rules: dict[str, Column], row_id: str) -> DataFrame:
    """(rule, row_id) for every broken rule; rows are flagged, never dropped."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(F.col(row_id).alias("row_id"), F.explode(hits).alias("rule"))


def validation_summary(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Broken rows per rule and their share, in one pass."""
    flat = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(c, 1)).alias(f"r{i}") for i, c in enumerate(rules.values())])
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("invalid")) for i, n in enumerate(rules)]
    out = flat.select("_rows", F.explode(F.array(*rows)).alias("m")).select("_rows", "m.*")
    return out.select("rule", "invalid", F.round(F.try_divide(F.col("invalid") * 100.0, F.col("_rows")), 4).alias("pct"))


def violation_samples(df: DataFrame, rules: dict[str, Column], row_id: str, n: int = SAMPLE_IDS) -> DataFrame:
    """The first ``n`` ids of each rule, trimmed before the shuffle."""
    return top_n(violations(df, rules, row_id), "rule", [F.asc("row_id")], n)


def quality_filter(df: DataFrame, features: list[str], lat: str, lon: str, label: str, order: list[str], strict: bool = False, bbox=(25.0, 37.0, -107.5, -92.5)) -> DataFrame:
    """Drops featureless rows, off-box rows and repeated (lat, lon, label).

    ``strict`` also drops rows with more than half of the features missing.
    """
    gone = reduce(lambda a, b: a + b, [nullify_nan(F.col(c).cast("double")).isNull().cast("int") for c in features])
    limit = len(features) // 2 if strict else len(features) - 1
    kept = df.where((gone <= limit) & in_bbox(lat, lon, *bbox))
    return first_per_key(kept, [lat, lon, label], order)


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(df, keys, order)


def forbid_columns(df: DataFrame, names=FORBIDDEN) -> tuple[DataFrame, list[str]]:
    found = [c for c in names if c in df.columns]
    return df.drop(*found), found


def drop_redundant(df: DataFrame, names=REDUNDANT) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def select_features(df: DataFrame, names: list[str], keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    have = [c for c in names if c in df.columns]
    return df.select(*keep, *have), [c for c in names if c not in df.columns]


def enforce_schema(df: DataFrame, ordered: list[str]) -> DataFrame:
    first = [c for c in ordered if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def fill_policy(df: DataFrame, zeros: list[str] = (), codes: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """zeros: null to 0; codes: null to -1 as int; numbers: text that is no number to 0."""
    out = []
    for c in df.columns:
        v = F.col(c)
        if c in numbers:
            v = F.coalesce(to_number(v), F.lit(0.0))
        elif c in codes:
            v = F.coalesce(v.try_cast("int"), F.lit(-1))
        elif c in zeros:
            v = F.coalesce(v, F.lit(0))
        out.append(v.alias(c))
    return df.select(*out)


def availability_flag(df: DataFrame, probe: str, cols: list[str], name: str, training: bool = False) -> DataFrame:
    """Flag of a present source with zero fill, or only its rows in training mode."""
    if training:
        return df.where(F.col(probe).isNotNull())
    flagged = df.withColumn(name, F.col(probe).isNotNull().cast("int"))
    return flagged.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in flagged.columns])
