"""Pareto frontier (J20): rows that no other row beats in both value and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def skyline(df: DataFrame, gain: str, cost: str, ranges: int = 128) -> DataFrame:
    """Rows with no other of at least their gain at most their cost, one of them strictly; ties stay, missing goes.

    One row per cost is kept (its best gain). Costs are cut into ranges at approximate quantiles (``ranges`` numbers on
    the driver); the best gain of all cheaper ranges is one row per range; within a range a running maximum decides.
    So nothing but one row per range is sorted in one place.
    """
    known = df.where(F.col(gain).isNotNull() & F.col(cost).isNotNull())
    best = known.groupBy(F.col(cost).alias("__c")).agg(F.max(gain).alias("__g"))
    cuts = known.agg(F.percentile_approx(F.col(cost).cast("double"), [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    place = F.size(F.filter(F.array(*(F.lit(float(x)) for x in sorted(set(cuts)))), lambda x: x < F.col("__c"))) if cuts else F.lit(0)
    placed = best.withColumn("__r", place)
    tops = placed.groupBy("__r").agg(F.max("__g").alias("__top"))
    cheaper = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__r", F.max("__top").over(cheaper).alias("__before"))  # one row per range
    within = Window.partitionBy("__r").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__m", F.max("__g").over(within)).join(F.broadcast(tops), "__r")
    beaten = F.greatest("__m", "__before")  # skips nulls
    winners = ranked.where(beaten.isNull() | (F.col("__g") > beaten)).select("__c", "__g")
    return known.join(winners, (known[cost] == winners["__c"]) & (known[gain] == winners["__g"])).drop("__c", "__g")
