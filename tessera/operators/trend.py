"""Quantile trends and capped scenario forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import capped_growth
from tessera.operators.quantile import exact_quantiles


def yearly_quantile(df: DataFrame, day: str, value: str, q: float) -> DataFrame:
    """Exact interpolated quantile per year of positive values."""
    return exact_quantiles(df.where(F.col(value) > 0).withColumn("year", F.year(day)), ["year"], value, **{"value": q})


def log_slope(yearly: DataFrame, least: int = 3) -> DataFrame:
    """One row: slope of log10(value) over years; 0 with fewer than ``least`` years."""
    return yearly.agg(
        F.when(F.count(F.lit(1)) >= least, F.regr_slope(F.log10("value"), F.col("year").cast("double"))).otherwise(F.lit(0.0)).alias("slope"),
        F.count(F.lit(1)).alias("years"),
        F.max_by("value", "year").alias("latest"),
        F.max("year").alias("last_year"),
    )


def forecast(slope: Column, latest: Column, horizon: Column, scale: Column, cap: Column) -> tuple[Column, Column]:
    """latest times the growth over the horizon, growth at most ``cap``; (value, whether capped). Not finite is capped."""
    growth, capped = capped_growth(F.pow(F.lit(10.0), slope * scale * horizon), cap)
    return latest * growth, capped
