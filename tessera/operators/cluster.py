"""k-means and profiles (Z4, Z5): Lloyd's algorithm as assignment joins, with fixed first centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import aggregate as agg
from tessera.operators.quantile import exact_quantiles
from tessera.sources.scratch import settled


def _nearest(features: Sequence[str], k: int, mark: str) -> str:
    """Index of the nearest of k centres in columns of ``mark``, the first among equals."""
    far = lambda c: " + ".join(f"(coalesce(`{f}`, 0D) - {mark}_{c}_{j}) * (coalesce(`{f}`, 0D) - {mark}_{c}_{j})" for j, f in enumerate(features))
    return f"array_min(array({', '.join(f'struct({far(c)} AS d, {c} AS k)' for c in range(k))})).k"


def _centres(df: DataFrame, **centres: list[tuple[float, ...]]) -> DataFrame:
    """One row with every coordinate of the centres, by mark: plans stay the same from one iteration to the next."""
    cells = {f"{m}_{c}_{j}": x for m, by in centres.items() for c, centre in enumerate(by) for j, x in enumerate(centre)}
    return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES ({', '.join(f'{x!r}D' for x in cells.values())}) AS t({', '.join(cells)})"))


def kmeans(df: DataFrame, key: str, features: Sequence[str], k: int = 7, iterations: int = 80) -> DataFrame:
    """``df`` with ``cluster``: first centres are the k rows with the smallest hashes of the key; an empty cluster keeps its centre.

    Rows are assigned ``iterations`` times, or until no assignment changes. Only k rows of sums come to the driver per
    iteration; the features are computed once, into the shared folder. Fewer than k rows are all in cluster 0.
    """
    rows = settled(df.select(key, *features), "kmeans-features")
    seeds = rows.orderBy(F.xxhash64(key), key).limit(k).select(*features).collect()
    if len(seeds) < k:
        return df.withColumn("cluster", F.lit(0))
    centres, before = [tuple(float(x or 0.0) for x in r) for r in seeds], None
    here, there = _nearest(features, k, "now"), _nearest(features, k, "was")
    sums = [F.expr(f"bool_or(near <> {there})").alias("changed"), *(F.expr(f"avg(coalesce(`{f}`, 0D))").alias(f) for f in features)]
    for _ in range(iterations - 1):
        both = rows.crossJoin(_centres(df, now=centres, was=before or centres)).withColumn("near", F.expr(here))
        means = both.groupBy("near").agg(*sums).collect()
        if before is not None and not any(r["changed"] for r in means):
            break
        before, centres = centres, list(centres)
        for r in means:
            centres[r["near"]] = tuple(float(r[f]) for f in features)
    return df.crossJoin(_centres(df, now=centres)).withColumn("cluster", F.expr(here)).select(*df.columns, "cluster")


def profile(clustered: DataFrame, features: Sequence[str], example: str | None = None, order: Sequence[Column] = (), median: str | None = None, total: str | None = None, examples: int = 5) -> DataFrame:
    """Size and means of each cluster in the features' own units (missing ones 0); on request its first examples in an
    order, the exact median of one column (``<median>_median``) and the sum of another (``<total>_sum``)."""
    sums = [F.sum(total).alias(f"{total}_sum")] if total else []
    out = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce(f, F.lit(0))).alias(f) for f in features), *sums)
    if example:
        first = agg.first_n(clustered, ["cluster"], examples, order, example).select("cluster", text.sentence_join(F.col(example).cast("array<string>"), examples).alias("examples"))
        out = out.join(first, "cluster")
    if median:
        out = out.join(exact_quantiles(clustered, ["cluster"], median, **{f"{median}_median": 0.5}), "cluster", "left")
    return out
