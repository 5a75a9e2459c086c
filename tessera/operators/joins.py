"""Join shapes (J1-J25): fills, fallbacks, full merges, scenario products, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Left join, missing measures 0."""
    return left.join(right, list(on), "left").na.fill(0, subset=list(fill))


def left_with_fallback(left: DataFrame, first: DataFrame, key: str, second: DataFrame, fallback: str, value: str) -> DataFrame:
    """A value by key, else by fallback key; both sides unique by key, so rows never fan out."""
    a = first.select(key, F.col(value).alias("__a"))
    b = second.select(fallback, F.col(value).alias("__b"))
    out = left.join(a, key, "left").join(b, fallback, "left")
    return out.withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def full_merge(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Outer merge of grouped frames by key in one shuffle: union with missing columns, then the known value of each."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every.groupBy(key).agg(*(F.max(c).alias(c) for c in every.columns if c != key))


def scenarios(spark, table: dict[str, dict[str, float]]) -> DataFrame:
    """Weights as a literal table (scenario, one column per weight)."""
    names = list(next(iter(table.values())))
    rows = [F.struct(F.lit(s).alias("scenario"), *(F.lit(float(w[n])).alias(f"w_{n}") for n in names)) for s, w in table.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_lookup(df: DataFrame, key: str, table: dict, name: str, default) -> DataFrame:
    """Value of a literal map, with a default."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(key)), F.lit(default) if not isinstance(default, Column) else default))


def upsert(df: DataFrame, keys: Sequence[str], order: Sequence[Column], provenance: str, sep: str = "|") -> DataFrame:
    """The last row of each key, with all of its provenance values in order of first appearance; null is a key, too.

    One row per key and provenance value is kept before the values meet, so a key's list is as long as its values are many.
    """
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    each = df.groupBy(*keys, F.col(provenance).alias("__value")).agg(F.min(at).alias("__first"), F.max(at).alias("__at"), F.max_by(F.struct(*rest), at).alias("__last"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("__first", "__value"))), lambda x: x["__value"].cast("string"))
    out = each.groupBy(*keys).agg(F.max_by("__last", "__at").alias("__last"), F.array_join(seen, sep).alias("__trail"))
    return out.select(*keys, "__last.*", F.col("__trail").alias("provenance"))


def with_proxy(detail: DataFrame, groups: DataFrame, key: str, own: str, group_value: str, name: str) -> DataFrame:
    """A detail row's own value, else that of its group; and which of them it is."""
    proxy = groups.select(key, F.col(group_value).alias("__proxy"))
    kind = F.when(F.col(own).isNotNull(), "own").when(F.col("__proxy").isNotNull(), "group_proxy").otherwise("none")
    return detail.join(proxy, key, "left").withColumn(name, F.coalesce(own, "__proxy")).withColumn(f"{name}_source", kind).drop("__proxy")


def compared(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """Columns of another table beside one's own, under prefixed names."""
    return left.join(right.select(key, *(F.col(c).alias(prefix + c) for c in columns)), key, "left")


def rank_shift(left: DataFrame, right: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """How many places a key is lower in ``left`` than in ``right``; null where either lacks it."""
    other = right.select(key, F.col(rank).alias("__other"))
    return left.join(other, key, "left").withColumn("rank_shift", F.col(rank) - F.col("__other")).drop("__other")


def membership(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Whether a key occurs on the right, rows unchanged."""
    keys = right.select(*on).distinct().withColumn("__hit", F.lit(True))
    return left.join(keys, list(on), "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__hit")
