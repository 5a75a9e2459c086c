"""Ranks, firsts and cadence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_min(value: Column, *partition: str) -> Column:
    """1 for the largest; equals share the smallest rank; missing last."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value.desc_nulls_last()))


def first_per_group(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order (give a unique one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cadence(df: DataFrame, keys: Sequence[str], day: Column, reference: str, recent_days: int = 365) -> DataFrame:
    """Events, recent events, median gap of distinct days, days since the latest, its date and a label.

    Undated and future events count in the total; gaps, the latest and recent events are those of dated ones.
    """
    now = F.lit(reference).cast("date")
    days = df.select(*keys, F.to_date(day).alias("d")).groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy(*keys, F.col("d").isNull()).orderBy("d")))
    recent, middle = F.col("recent"), F.col("median_gap_days")
    return (
        days.withColumn("gap", gap)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("d") >= F.date_sub(now, recent_days), F.col("n"))), F.lit(0)).alias("recent"),
            F.round(F.median("gap"), 1).alias("median_gap_days"),
            F.datediff(now, F.max("d")).alias("days_since_latest"),
            F.coalesce(F.max("d").cast("string"), F.lit("")).alias("latest_date"),
        )
        .withColumn("cadence_label", F.when((recent >= 5) | (middle <= 75), "fast").when(recent >= 2, "steady").otherwise("slow_or_sparse"))
    )


def in_order(c: Column, order: Sequence[str]) -> Column:
    """Place of a value in a list, the rest after it."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), c)
    return F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(order) + 1)).cast("int")


def stable_top(df: DataFrame, key: str, rank: str, top: int, scenarios: int) -> DataFrame:
    """Keys that rank in the top in at least so many scenarios."""
    return df.groupBy(key).agg((F.count_if(F.col(rank) <= top) >= scenarios).alias("stable"))
