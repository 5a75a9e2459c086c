"""Grouped aggregates (G1-G41) beyond the built-ins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantile import exact_quantiles


def top_n(df: DataFrame, keys: Sequence[str], value: str, n: int, *ties: str) -> DataFrame:
    """Rows of the n largest non-null values of each group; the limit runs before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *ties)
    return df.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def first_n(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], value: str) -> DataFrame:
    """Each group's first n values in order, as an array; at most n rows of a group and task are shuffled."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("__n", F.col(value).alias("v"))))  # n values
    return ranked.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(value))


def top_n_then(df: DataFrame, keys: Sequence[str], value: str, n: int, **aggs: Column) -> DataFrame:
    """Aggregates over the n largest values of each group."""
    return top_n(df, keys, value, n).groupBy(*keys).agg(*(c.alias(k) for k, c in aggs.items()))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null values left out of both sums."""
    w = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * w), F.sum(w))


def positive_min(c: Column) -> Column:
    """M4."""
    return F.min(F.when(c > 0, c))


def share(condition: Column) -> Column:
    """Share of rows with a condition, null as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def sum0(c: Column) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def sorted_join(c: Column, limit: int | None = None, sep: str = ",") -> Column:
    """Distinct values in order, joined; the first ``limit`` of them."""
    found = F.array_sort(F.collect_set(c))
    return F.array_join(F.slice(found, 1, limit) if limit else found, sep)


def mode(c: Column) -> Column:
    """The most frequent value, the smallest among equals."""
    return F.mode(c, True)


def first_by(c: Column, order: Column) -> Column:
    """The first non-null value in an explicit order."""
    return F.min_by(c, F.when(c.isNotNull(), order))


def field_coverage(*fields: Column, positive: bool = False) -> Column:
    """Share of rows with any of the fields known (text: not blank; ``positive``: above 0)."""
    known = F.lit(False)
    for f in fields:
        known = known | F.coalesce(f > 0 if positive else F.trim(f.cast("string")) != "", F.lit(False))
    return F.avg(known.cast("double"))


def latest_date(df: DataFrame, *columns: str) -> DataFrame:
    """The latest of all dates in the columns, one row."""
    return df.agg(F.greatest(*(F.max(F.col(c).try_cast("date")) for c in columns), *([F.lit(None).cast("date")] if len(columns) < 2 else [])).alias("latest_date"))


def table_profile(df: DataFrame, name: str, fields: Mapping[str, tuple[Sequence[str], bool]], listed: int = 40) -> DataFrame:
    """One row about any table, from its schema and one scan.

    Rows, columns, the latest of all columns whose name holds "date" or ends in "_at" (empty text without), the share of
    rows where any of the aliases of a field is known (aliases in any case; the flag: above 0), and the first columns' names.
    """
    have = {c.lower(): c for c in df.columns}
    days = [c for k, c in have.items() if "date" in k or k.endswith("_at")]
    latest = [F.max(F.col(f"`{c}`").try_cast("date")) for c in days] + [F.lit(None).cast("date")] * 2
    covered = []
    for field, (aliases, positive) in fields.items():
        found = [F.col(f"`{have[a.lower()]}`") for a in aliases if a.lower() in have]
        share = field_coverage(*found, positive=positive) if found else F.lit(0.0)
        covered.append(F.round(F.coalesce(share, F.lit(0.0)), 4).alias(field))
    counts = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.greatest(*latest).cast("string"), F.lit("")).alias("latest_source_date"), *covered]
    return df.agg(*counts).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "latest_source_date", *fields, F.lit(",".join(df.columns[:listed])).alias("columns_present"))


def most_frequent(df: DataFrame, key: str) -> DataFrame:
    """Value, count and share of the most frequent value; the smallest among equals."""
    counts = df.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(1)
    return top.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def grouping_sets(df: DataFrame, columns: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One grouping per column, as rows (grouping, group, aggregates); null groups are 'unknown'."""
    known = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) if c in columns else F.col(c) for c in df.columns))
    flags = [F.grouping(c).alias(f"__g_{c}") for c in columns]
    grouped = known.groupingSets([[c] for c in columns], *columns).agg(*aggs, *flags)
    name = F.coalesce(*(F.when(F.col(f"__g_{c}") == 0, F.lit(c)) for c in columns))
    value = F.coalesce(*(F.when(F.col(f"__g_{c}") == 0, F.col(c)) for c in columns))
    return grouped.select(name.alias("grouping"), value.alias("group"), *(c for c in grouped.columns if c not in columns and not c.startswith("__g_")))


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts with a fixed list of columns, missing 0."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def reasons(**conditions: Column) -> Column:
    """Names of the conditions that hold, joined by ','; 'none' without."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())))
    return F.when(F.size(found) == 0, F.lit("none")).otherwise(F.array_join(found, ","))


def mean_and_size(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of a number and size of each group, by any list of keys; text that is no number is left out of the mean."""
    return df.groupBy(*keys).agg(F.avg(F.col(value).try_cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def class_medians(df: DataFrame, kind: str, value: str, top: str, bottom: str) -> DataFrame:
    """One row with the medians of two classes and their ratio."""
    medians = exact_quantiles(df.where(F.col(kind).isin(top, bottom)), [kind], value, median=0.5)
    of = lambda k: F.max(F.when(F.col(kind) == k, F.col("median")))
    return medians.agg(of(top).alias("top_median"), of(bottom).alias("bottom_median")).withColumn("ratio", F.try_divide("top_median", "bottom_median"))


def leaders(df: DataFrame, group: str, key: str, value: str, n: int = 10) -> DataFrame:
    """The n keys with the highest maximum, and in each group the leader among these."""
    best = df.groupBy(key).agg(F.max(value).alias("__best")).orderBy(F.desc("__best"), key).limit(n)
    kept = df.join(F.broadcast(best.select(key)), key, "left_semi")  # n rows
    return kept.groupBy(group).agg(F.max_by(key, F.struct(value, F.col(key))).alias("leader"), F.max(value).alias("best"))


def pick_rows(df: DataFrame, fixed: Sequence[str], key: str, metric: str, least: float, never: str) -> DataFrame:
    """rows whose key is in a fixed list or whose metric is large enough, but never one key."""
    return df.where((F.col(key).isin(*fixed) | (F.col(metric) >= least)) & (F.col(key) != never))
