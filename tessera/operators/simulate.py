"""Random studies (Z1-Z3, Z6, Z7): every draw has its own seed, so results don't depend on partitions or retries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seed, noise of a component (least, and what evidence divides), concentration of weights, labels by spread.
SEED = 20260516
NOISE = (2.2, 36.0)
CONCENTRATION = 120
STABILITY = ((1.0, "stable"), (3.0, "moderate"), (None, "unstable"))
#: Entities that are ranked in every draw at most.
MOST = 20_000


def sensitivity(scores: DataFrame, weights: DataFrame, components: list[str]) -> DataFrame:
    """Weighted mean of components per scenario (weights: scenario, w_<component>); a literal table, broadcast."""
    total = sum((F.col(f"w_{c}") for c in components), F.lit(0.0))
    index = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col(f"w_{c}") for c in components), F.lit(0.0)) / total
    return scores.crossJoin(F.broadcast(weights)).withColumn("index", index)


def _packed(scores: DataFrame, *columns: str) -> DataFrame:
    """The rows of a small table as one sorted array; more than MOST entities are refused."""
    n = scores.count()
    if n > MOST:
        raise ValueError(f"{n} entities to rank in every draw; {MOST} are the most")
    return scores.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def component_draw(base: np.ndarray, evidence: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ranks of one draw: noise on every component, clipped, then weighted; 1 is best, equals share the smallest."""
    spread = NOISE[0] + NOISE[1] / np.sqrt(np.maximum(evidence, 1))
    noisy = np.clip(base + rng.normal(0, spread[:, None], base.shape), 0, 100)
    s = noisy @ rng.dirichlet(weights * CONCENTRATION)
    return s, 1 + len(s) - np.searchsorted(np.sort(s), s, "right")


def bootstrap_draws(scores: DataFrame, key: str, components: list[str], weights: list[float], evidence: str, draws: int = 700, seed: int = SEED) -> DataFrame:
    """(draw, key, score, rank) of draws with Dirichlet weights and component noise that shrinks with evidence.

    ``scores`` is the small table of ranked entities; its rows are packed once and sent with the draws.
    """
    drawn = scores.sparkSession.range(0, draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(_packed(scores, key, evidence, *components)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for draw, rows in zip(part["draw"], part["rows"]):
                base = np.array([[r[c] or 0.0 for c in components] for r in rows], float).reshape(len(rows), len(components))
                known = np.array([r[evidence] or 0 for r in rows], float)
                s, rank = component_draw(base, known, np.array(weights), np.random.default_rng([seed, int(draw)]))
                yield pd.DataFrame({"draw": draw, key: [r[key] for r in rows], "score": s.round(2), "rank": rank})

    kind = scores.schema[key].dataType.simpleString()
    return drawn.repartition(max(1, min(64, draws // 50)), "draw").mapInPandas(run, f"draw long, {key} {kind}, score double, rank long")


def rank_intervals(draws: DataFrame, key: str) -> DataFrame:
    """Quantiles of score and rank of each entity over its draws, and how stable its rank is."""
    p = F.percentile("score", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    iqr = F.round(F.percentile("rank", F.lit(0.75)) - F.percentile("rank", F.lit(0.25)), 2)
    out = draws.groupBy(key).agg(
        *(F.round(p[k], 2).alias(f"score_p{n}") for k, n in enumerate((10, 50, 90))), F.min("rank").alias("best_rank"),
        F.median("rank").alias("median_rank"), F.max("rank").alias("worst_rank"), iqr.alias("rank_iqr"),
    )
    label = F.lit(STABILITY[-1][1])
    for most, name in reversed(STABILITY[:-1]):
        label = F.when(F.col("rank_iqr") <= most, name).otherwise(label)
    return out.withColumn("rank_stability_label", label)


def bootstrap_ranks(scores: DataFrame, key: str, components: list[str], weights: list[float], evidence: str, draws: int = 700, seed: int = SEED) -> DataFrame:
    """Z2 and G24 together."""
    return rank_intervals(bootstrap_draws(scores, key, components, weights, evidence, draws, seed), key)


def leadership(scores: DataFrame, key: str, components: list[str], scenarios: list[tuple[str, int, list[float]]], draws: int = 6000, seed: int = SEED) -> DataFrame:
    """Z3: per scenario and horizon, each entity's share of wins and its simulated score's mean, p10 and p90."""
    packed = _packed(scores, key, *components)
    spark = scores.sparkSession
    plan = spark.createDataFrame([(s, h, list(map(float, w))) for s, h, w in scenarios], "scenario string, horizon int, weights array<double>")
    blocks = plan.crossJoin(spark.range(0, -(-draws // 500)).withColumnRenamed("id", "block")).crossJoin(F.broadcast(packed))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for scenario, horizon, weights, block, rows in part.itertuples(index=False):
                n = min(500, draws - 500 * int(block))
                rng = np.random.default_rng([seed, sum(map(ord, scenario)), int(horizon), int(block)])
                base = np.array([[r[c] or 0.0 for c in components] for r in rows], float)
                w = rng.dirichlet(np.maximum(np.array(weights) * 140, 2.0), n)
                s = w @ base.T + rng.normal(0, 2.5 + 0.18 * horizon, (n, len(rows)))
                wins = s.argmax(1)
                for k, r in enumerate(rows):
                    yield pd.DataFrame({"scenario": scenario, "horizon": horizon, key: r[key], "score": s[:, k], "won": wins == k})

    kind = scores.schema[key].dataType.simpleString()
    many = blocks.repartition(32, "scenario", "horizon", "block").mapInPandas(run, f"scenario string, horizon int, {key} {kind}, score double, won boolean")
    p = F.percentile("score", F.array(F.lit(0.1), F.lit(0.9)))
    return many.groupBy("scenario", "horizon", key).agg(
        F.avg(F.col("won").cast("double")).alias("win_share"), F.avg("score").alias("score_mean"),
        p[0].alias("score_p10"), p[1].alias("score_p90"), F.count(F.lit(1)).alias("draws"),
    )


def bucket_p_value(df: DataFrame, bucket: str, categories: int, sims: int = 10_000, seed: int = 42) -> DataFrame:
    """How often the fullest of ``categories`` equally likely buckets is at least as full as the observed one."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    blocks = df.sparkSession.range(0, -(-sims // 1000)).crossJoin(F.broadcast(seen))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block, top, total in part.itertuples(index=False):
                n = min(1000, sims - 1000 * int(block))
                drawn = np.random.default_rng([seed, int(block)]).multinomial(int(total), [1 / categories] * categories, n)
                yield pd.DataFrame({"top": [top], "total": [total], "hits": [int((drawn.max(1) >= top).sum())], "n": [n]})

    rows = blocks.mapInPandas(run, "top long, total long, hits long, n long")
    return rows.agg(F.max("top").alias("observed"), F.max("total").alias("total"), ((F.sum("hits") + 1) / (F.sum("n") + 1)).alias("p_value"))


BUCKETS = {"weekday": 7, "month": 12, "quarter": 4}


def _year_shares(year: int, feature: str) -> np.ndarray:
    """Share of a year's days in each bucket."""
    days = pd.date_range(f"{year}-01-01", f"{year}-12-31")
    at = {"weekday": days.dayofweek, "month": days.month - 1, "quarter": days.quarter - 1}[feature]
    return np.bincount(at, minlength=BUCKETS[feature]) / len(days)


def _bucket(day: Column, feature: str) -> Column:
    return {"weekday": F.dayofweek, "month": F.month, "quarter": F.quarter}[feature](day)


def date_p_value(events: DataFrame, day: str, feature: str = "weekday", sims: int = 5000, seed: int = 42) -> DataFrame:
    """How often dates drawn anew within each event's year fill a weekday, month or quarter as much as observed."""
    dated = events.where(F.col(day).isNotNull())
    years = dated.groupBy(F.year(day).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    seen = dated.groupBy(_bucket(F.col(day), feature).alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"))
    packed = years.agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("years")).crossJoin(F.broadcast(seen))
    blocks = events.sparkSession.range(0, -(-sims // 250)).crossJoin(F.broadcast(packed))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block, years, top in part.itertuples(index=False):
                n = min(250, sims - 250 * int(block))
                rng, total = np.random.default_rng([seed, BUCKETS[feature], int(block)]), np.zeros((n, BUCKETS[feature]), np.int64)
                for r in years:
                    total += rng.multinomial(int(r["n"]), _year_shares(int(r["y"]), feature), n)
                yield pd.DataFrame({"top": [top], "hits": [int((total.max(1) >= top).sum())], "n": [n]})

    rows = blocks.mapInPandas(run, "top long, hits long, n long")
    return rows.agg(F.max("top").alias("observed"), ((F.sum("hits") + 1) / (F.sum("n") + 1)).alias("p_value"))


def pattern_tests(events: DataFrame, day: str, other: dict[str, int]) -> DataFrame:
    """Per feature the fullest bucket, its count and share, a p-value, the null model and a verdict.

    Calendar features are tested against dates drawn within years; columns of ``other`` (name to number of buckets)
    against equal shares, and are marked as approximate.
    """
    named = {"weekday": F.date_format(day, "EEEE"), "month": F.date_format(day, "MMMM"), "quarter": F.concat(F.lit("Q"), F.quarter(day))}
    out = None
    for feature, n in {**BUCKETS, **other}.items():
        calendar = feature in BUCKETS
        rows = events.select(day, named[feature].alias("__b") if calendar else F.col(feature).cast("string").alias("__b")).where("__b IS NOT NULL")
        counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("top_count"))
        total = counts.agg(F.sum("top_count").alias("n"))
        top = counts.orderBy(F.desc("top_count"), "__b").limit(1).crossJoin(F.broadcast(total))
        p = date_p_value(events, day, feature) if calendar else bucket_p_value(rows, "__b", n)
        low = F.col("p_value") < 0.01
        verdicts = ("calendar_cluster_not_causal", "no_robust_calendar_cluster") if calendar else ("cluster_detected_not_causal", "no_robust_cluster")
        one = top.crossJoin(F.broadcast(p.select("p_value"))).select(
            F.lit(feature).alias("feature"), F.col("__b").alias("top_bucket"), "top_count", "n", (F.col("top_count") / F.col("n")).alias("share"),
            F.lit(n).alias("null_categories"), F.col("p_value").alias("permutation_p_value"),
            F.lit("year-preserving random dates" if calendar else "uniform bucket permutation").alias("null_model"),
            F.lit(not calendar).alias("approximate_feature"), F.when(low, verdicts[0]).otherwise(verdicts[1]).alias("verdict"),
        )
        out = one if out is None else out.unionByName(one)
    return out.orderBy("permutation_p_value", "feature")
