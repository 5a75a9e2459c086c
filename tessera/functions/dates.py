"""Dates (T-a to T-h, F9-F11, J23, J24): lenient parsing with a precision, parts, lunar age, calendar windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind, clean_text

# Ages in days below which a phase holds, and yearly windows (month, day) to (month, day).
MOON_PHASES = (
    (1.84566, "New"),
    (5.53699, "Waxing crescent"),
    (9.22831, "First quarter"),
    (12.91963, "Waxing gibbous"),
    (16.61096, "Full"),
    (20.30228, "Waning gibbous"),
    (23.99361, "Last quarter"),
    (27.68493, "Waning crescent"),
    (29.53059, "New"),
)
SYNODIC_DAYS = 29.53058867
NEW_MOON = "2000-01-06 18:14:00"
WINDOWS = (("01-01", "01-18"), ("04-01", "04-25"), ("08-01", "08-25"), ("11-20", "12-15"))


def parse_date(c: Column) -> Column:
    """T-a: struct of date and precision (day, month, year, timestamp, missing, unparsed)."""
    return bind(clean_text(c), _parsed)


def _parsed(text: Column) -> Column:
    precision = (
        F.when(text == "", F.lit("missing"))
        .when(text.rlike(r"^\d{4}$"), F.lit("year"))
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.lit("month"))
        .when(text.rlike(r"^\d{4}-\d$|^\d{4}-\d{1,2}-\d{1,2}$|^\d{8}$"), F.lit("day"))
        .when(F.try_to_timestamp(text).isNotNull(), F.lit("timestamp"))
        .otherwise(F.lit("unparsed"))
    )
    day = F.coalesce(
        *(F.try_to_date(text, f) for f in ("yyyy-M-d", "yyyyMMdd", "yyyy-M", "yyyy")), F.to_date(F.try_to_timestamp(text))
    )
    return F.struct(
        F.when(precision.isin("missing", "unparsed"), F.lit(None).cast("date")).otherwise(day).alias("date"),
        F.when((precision != "missing") & day.isNull(), F.lit("unparsed")).otherwise(precision).alias("precision"),
    )


def epoch_date(seconds: Column) -> Column:
    """T-b: UTC date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def embedded_date(c: Column, pattern: str = r"^(\d{8})_") -> Column:
    """F10, T-f: date at the head of a name, or null."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), "yyyyMMdd")


def recent(c: Column, reference: str, days: int) -> Column:
    """at most so many days before the reference date."""
    return c >= F.date_sub(F.lit(reference).cast("date"), days)


def moon_age(ts: Column) -> Column:
    """T-g: days since the last new moon, on average."""
    days = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(NEW_MOON).cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.pmod(days, F.lit(SYNODIC_DAYS))


def moon_phase(ts: Column) -> Column:
    """Range lookup in ordered buckets."""
    case = None
    for top, label in MOON_PHASES:
        case = (F if case is None else case).when(moon_age(ts) < top, F.lit(label))
    return case.otherwise(F.lit("New"))


def in_yearly_windows(ts: Column, windows=WINDOWS) -> Column:
    """Inside any closed window of its year, ends at midnight."""
    year, out = F.date_format(ts.cast("timestamp"), "yyyy"), F.lit(False)
    for a, b in windows:
        low, high = (F.to_timestamp(F.concat_ws("-", year, F.lit(x)), "yyyy-MM-dd") for x in (a, b))
        out = out | ((ts >= low) & (ts <= high))
    return out
