"""Ranks and places over whole tables (W1, O1, O2, O6, O8) without one task that sorts them all.

Rows are dealt to ranges of the sort order, sorted within each, and numbered there; the sizes of the ranges, one row each,
say where a range begins. Equal keys are told apart by their row numbers in the input, so a value that a third of all
rows share is spread over many ranges. Ranks count distinct keys first (summed before the shuffle), so equal keys have
one rank however many they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import settled

#: Rows of a range, in the low bits of a number made by Spark.
_BITS = 33


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with its range and the row's number there, from 0."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = settled(dealt, "placed")
    return rows.withColumn("__range", F.shiftright("__at", _BITS)).withColumn("__at", F.col("__at").bitwiseAND((1 << _BITS) - 1))


def _starts(sizes: DataFrame) -> DataFrame:
    """__range, __start: how much lies before each range; one row per range."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))


def place(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in ``order``; rows that it leaves equal follow each other as in the input."""
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = _ranged(rows, [*order, F.asc("__tie")])
    starts = _starts(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")))
    return rows.join(starts, "__range").select(*df.columns, (F.col("__start") + F.col("__at") + 1).alias(name))


def rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", within: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """``df`` with the rank of ``order`` over the columns ``keys``: equals share the smallest place (``dense``: no gaps).

    ``within``: ranks start anew in each group of these columns, few or many, large or small.
    """
    all_keys = [*within, *keys]
    counts = df.groupBy(*all_keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = _ranged(counts, [*[F.col(c).asc_nulls_last() for c in within], *order])
    weight = F.lit(1) if dense else F.col("__n")
    rows = rows.withColumn("__before", F.sum(weight).over(Window.partitionBy("__range").orderBy("__at")) - weight)
    starts = _starts(rows.groupBy("__range").agg(F.sum(weight).alias("n")))
    placed = rows.join(starts, "__range").select(*all_keys, (F.col("__start") + F.col("__before") + 1).alias("__rank"))
    if within:
        first = _renamed(placed.groupBy(*within).agg(F.min("__rank").alias("__first")), within)
        placed = placed.join(first, _equal(within)).select(*all_keys, (F.col("__rank") - F.col("__first") + 1).alias("__rank"))
    ranks = _renamed(placed, all_keys)
    return df.join(ranks, _equal(all_keys)).select(*df.columns, F.col("__rank").cast("long").alias(name))


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}__" for k in keys})


def _equal(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return on


def sorted_counts(df: DataFrame, label: str) -> DataFrame:
    """How often each label occurs, with its place in the order of the labels; missing ones are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return place(counts, [F.asc(label)])
