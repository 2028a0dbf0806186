"""Casting, string and numeric Column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk bands, highest first.
RISK_BANDS = (
    (0.80, "CRITICAL"),
    (0.65, "HIGH"),
    (0.50, "MEDIUM-HIGH"),
    (0.35, "MEDIUM"),
    (0.20, "LOW-MEDIUM"),
)
LOWEST_BAND = "LOW"

DATE_FORMATS = ("yyyy-MM-dd",)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullify_nan(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def to_number(c: Column | str) -> Column:
    """Double, or null where the text is no number or is NaN."""
    return nullify_nan(as_col(c).try_cast("double"))


def to_date(c: Column | str, formats=DATE_FORMATS, prefix: int | None = 10) -> Column:
    """First format that parses wins; anything else is null.

    ``prefix`` characters are enough for the ISO date, which a time may follow; all other
    formats must fit the whole text.
    """
    c = as_col(c).cast("string")
    head = F.substring(c, 1, prefix) if prefix else c
    texts = [head if f == "yyyy-MM-dd" else c for f in formats]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for t, f in zip(texts, formats)]).cast("date")


def contains_ci(c: Column | str, text: str) -> Column:
    return F.lower(as_col(c)).contains(text.lower())


def missing_flag(c: Column | str) -> Column:
    return as_col(c).isNull().cast("int")


def large_event_flag(size: Column | str, limit: float = 100.0) -> Column:
    return F.coalesce((as_col(size) >= limit).cast("int"), F.lit(0))


def log1p_clip(c: Column | str) -> Column:
    c = as_col(c)
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def clean_num(c: Column | str, digits: int = 3) -> Column:
    """Rounded for export; NaN and infinities become null."""
    c = as_col(c).cast("double")
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.round(c, digits))


def risk_band(score: Column | str) -> Column:
    score = as_col(score)
    cascade = reduce(
        lambda acc, band: acc.when(score >= band[0], band[1]),
        RISK_BANDS,
        F.when(score.isNull(), F.lit(None).cast("string")),
    )
    return cascade.otherwise(LOWEST_BAND)


def truncate_example(c: Column | str, width: int = 80) -> Column:
    c = as_col(c).cast("string")
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def one_hot(code: Column | str, classes: dict[str, int]) -> dict[str, Column]:
    code = as_col(code)
    return {name: F.coalesce((code == value).cast("int"), F.lit(0)) for name, value in classes.items()}


def parse_row(line: Column | str, schema: str) -> Column:
    """CSV line to a typed struct with bad or missing numbers set to 0."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1].lower() for part in schema.split(",")]
    raw = F.from_csv(as_col(line), ", ".join(f"{n} STRING" for n in names))
    fields = []
    for name, kind in zip(names, kinds):
        field = F.trim(raw[name])
        if kind != "string":
            field = F.coalesce(nullify_nan(field.try_cast("double")), F.lit(0.0)).try_cast(kind)
        fields.append(field.alias(name))
    return F.struct(*fields)
