"""Composite indexes, portfolios, trends, forecasts, clusters and random studies, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import numeric, text
from tessera.operators import aggregate as agg
from tessera.operators import cluster, joins, ranking, simulate, trend
from tessera.operators.skyline import skyline
from tessera.plans.joins import FEATURES_SQL, nation_features
from tessera.sources.readers import table

# Component weights of the index, and the sets of the sensitivity study.
WEIGHTS = {"revenue_component": 0.4, "activity_component": 0.25, "supply_component": 0.2, "cost_component": 0.15}
SETS = {
    "baseline": WEIGHTS,
    "no_supply": {"revenue_component": 0.5, "activity_component": 0.3, "supply_component": 0.0, "cost_component": 0.2},
    "no_cost": {"revenue_component": 0.45, "activity_component": 0.3, "supply_component": 0.25, "cost_component": 0.0},
    "equal": dict.fromkeys(WEIGHTS, 0.25),
}


def composite(spark, d):
    """Per nation, scaled components, index and rank."""
    scaled = numeric.minmax(
        nation_features(spark, d),
        {"revenue_component": ("revenue", "log"), "activity_component": ("recent", ""), "supply_component": ("suppliers", ""), "cost_component": ("least_balance", "log invert")},
    )
    indexed = scaled.withColumn("index", F.round(numeric.weighted_index(WEIGHTS), 4))
    return indexed.withColumn("rank", ranking.rank_min(F.col("index")).cast("long"))


def _scaled(c: str, mode: str) -> str:
    v = f"CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END" if "log" in mode else c  # greatest() skips nulls
    s = f"({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) * 100"
    s = f"100 - {s}" if "invert" in mode else s
    return f"CASE WHEN max({v}) OVER () = min({v}) OVER () OR max({v}) OVER () IS NULL THEN 50.0 ELSE least(greatest(coalesce({s}, 0), 0), 100) END::DOUBLE"


INDEX_SQL = f"""{FEATURES_SQL},
s AS (SELECT *, {_scaled('revenue', 'log')} AS revenue_component, {_scaled('recent', '')} AS activity_component,
  {_scaled('suppliers', '')} AS supply_component, {_scaled('least_balance', 'log invert')} AS cost_component FROM f),
i AS (SELECT *, round({' + '.join(f'{k} * {w}::DOUBLE' for k, w in WEIGHTS.items())}, 4) AS "index" FROM s)
"""


def q_composite_index(spark, d):
    return composite(spark, d).select("nation", *(F.round(c, 4).alias(c) for c in WEIGHTS), "index", "rank")


register("q_composite_index", q_composite_index, f"WITH {INDEX_SQL} SELECT nation, {', '.join(f'round({k}, 4) AS {k}' for k in WEIGHTS)}, \"index\", rank() OVER (ORDER BY \"index\" DESC) AS rank FROM i")


def sensitivity(spark, d):
    each = simulate.sensitivity(composite(spark, d).drop("index", "rank"), joins.scenarios(spark, SETS), list(WEIGHTS))
    each = each.select("scenario", "nation", F.round("index", 4).alias("index"))
    return each.withColumn("rank", ranking.rank_min(F.col("index"), "scenario").cast("long"))


def _sets_sql() -> str:
    rows = ", ".join(f"('{s}', {', '.join(f'{w[k]}::DOUBLE' for k in WEIGHTS)})" for s, w in SETS.items())
    names = ", ".join(f"w_{k}" for k in WEIGHTS)
    top = " + ".join(f"{k} * w_{k}" for k in WEIGHTS)
    low = " + ".join(f"w_{k}" for k in WEIGHTS)
    return f"{INDEX_SQL}, w(scenario, {names}) AS (VALUES {rows}), z AS (SELECT scenario, nation, round(({top}) / ({low}), 4) AS x FROM s, w), r AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY x DESC) AS rank FROM z)"


register("q_weight_sensitivity", sensitivity, f"WITH {_sets_sql()} SELECT scenario, nation, x AS \"index\", rank FROM r")


def q_stable_top(spark, d):
    return ranking.stable_top(sensitivity(spark, d), "nation", "rank", 3, 3)


register("q_stable_top", q_stable_top, f"WITH {_sets_sql()} SELECT nation, count(*) FILTER (rank <= 3) >= 3 AS stable FROM r GROUP BY nation")


def q_vendor_portfolio(spark, d):
    """A region's flagship nation blended with the weighted mean of its nations."""
    rows = composite(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "nation")
    by = rows.groupBy("region").agg(
        F.max_by("nation", F.struct("index", -F.col("nation"))).cast("long").alias("flagship"),
        F.count(F.lit(1)).alias("nations"),
        (F.max("index") * 0.65 + agg.weighted_mean(F.col("index"), F.greatest("orders", F.lit(1))) * 0.35).alias("x"),
    )
    return by.select("region", "flagship", "nations", F.round("x", 3).alias("score"), F.rank().over(_desc("x")).cast("long").alias("rank"))


def _desc(c):
    from pyspark.sql import Window

    return Window.orderBy(F.desc(F.round(c, 3)))


register("q_vendor_portfolio", q_vendor_portfolio, f"WITH {INDEX_SQL}, v AS (SELECT n_regionkey AS region, first(nation ORDER BY \"index\" DESC, nation)::BIGINT AS flagship, count(*) AS nations, round(max(\"index\") * 0.65 + sum(\"index\" * greatest(orders, 1)) / sum(greatest(orders, 1)) * 0.35, 3) AS score FROM i JOIN nation ON n_nationkey = nation GROUP BY 1) SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM v")


def q_price_performance(spark, d):
    """Index of size against price, and the frontier."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    scaled = numeric.minmax(parts, {"perf": ("p_size", ""), "cheap": ("p_retailprice", "log invert")})
    front = skyline(parts, "p_size", "p_retailprice").select("p_partkey", F.lit(True).alias("front"))
    return scaled.join(F.broadcast(front), "p_partkey", "left").select("p_partkey", F.round(F.col("perf") * 0.7 + F.col("cheap") * 0.3, 4).alias("index"), F.coalesce("front", F.lit(False)).alias("on_frontier"))


register("q_price_performance", q_price_performance, f"SELECT p_partkey, round({_scaled('p_size', '')} * 0.7::DOUBLE + {_scaled('p_retailprice', 'log invert')} * 0.3::DOUBLE, 4) AS \"index\", NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice)) AS on_frontier FROM part a")


def q_gap_by_category(spark, d):
    by = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice"))
    gap = F.col("F") - F.col("O")
    return by.select("o_orderpriority", F.round(gap, 2).alias("gap"), F.round(F.try_divide(gap, F.col("F")), 6).alias("share"), F.when(gap > 0, "closed ahead").otherwise("open ahead").alias("note"))


register("q_gap_by_category", q_gap_by_category, "SELECT o_orderpriority, round(f - o, 2) AS gap, round((f - o) / f, 6) AS share, CASE WHEN f - o > 0 THEN 'closed ahead' ELSE 'open ahead' END AS note FROM (SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)")

TASKS = {"language": ["the", "and", "for", "with"], "analysis": ["tion", "ing", "able"]}
BRAKES = {"physical": ["hand", "when"], "trust": ["you", "that", "this"]}


def q_gated_scores(spark, d):
    """Keyword features, a gate of brakes, indexes and labels."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    f = rows.select("doc_id", F.coalesce("quality", F.lit(0)).cast("double").alias("e"), *(text.keyword_score(F.col("text"), w).alias(k) for k, w in {**TASKS, **BRAKES}.items()))
    gate = numeric.gate(F.col("e") * 0.5 + F.lit(0.5), (F.col("physical"), 0.8), (F.col("trust"), 0.7))
    scored = f.select("doc_id", F.round(gate * (F.col("language") * 60 + F.col("analysis") * 40), 4).alias("feasibility"), F.round((F.col("physical") * 0.45 + F.col("trust") * 0.35) * 100, 4).alias("bottleneck"))
    return scored.withColumn("label", F.when(F.col("feasibility") >= 35, "replace").when(F.col("bottleneck") >= 25, "blocked").otherwise("mixed"))


def _gated_sql() -> str:
    part = lambda w: f"least(1.0::DOUBLE, ({' + '.join(f'contains(lower(text), {chr(39)}{x}{chr(39)})::INT' for x in w)}) / {max(2.0, 0.35 * len(w))}::DOUBLE)"
    cols = ", ".join(f"{part(w)} AS {k}" for k, w in {**TASKS, **BRAKES}.items())
    return f"WITH f AS (SELECT doc_id, coalesce(quality, 0)::DOUBLE AS e, {cols} FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT doc_id, round((e * 0.5 + 0.5::DOUBLE) * (1 - 0.8::DOUBLE * physical) * (1 - 0.7::DOUBLE * trust) * (language * 60 + analysis * 40), 4) AS feasibility, round((physical * 0.45::DOUBLE + trust * 0.35::DOUBLE) * 100, 4) AS bottleneck FROM f) SELECT *, CASE WHEN feasibility >= 35 THEN 'replace' WHEN bottleneck >= 25 THEN 'blocked' ELSE 'mixed' END AS label FROM s"


register("q_gated_scores", q_gated_scores, _gated_sql())


def q_trend_slope(spark, d):
    return trend.log_slope(trend.yearly_quantile(table(spark, d, "orders"), "o_orderdate", "o_totalprice", 0.9)).select(F.round("slope", 8).alias("slope"), "years", F.round("latest", 4).alias("latest"))


YEARLY_SQL = "y AS (SELECT year(o_orderdate) AS y, quantile_cont(o_totalprice, 0.9) AS v FROM orders WHERE o_totalprice > 0 GROUP BY 1), t AS (SELECT CASE WHEN count(*) >= 3 THEN regr_slope(log10(v), y::DOUBLE) ELSE 0.0 END AS slope, count(*) AS years, max_by(v, y) AS latest FROM y)"
register("q_trend_slope", q_trend_slope, f"WITH {YEARLY_SQL} SELECT round(slope, 8) AS slope, years, round(latest, 4) AS latest FROM t")
FORECASTS = {"conservative": {"scale": 0.55, "cap": 1.001}, "base": {"scale": 1.0, "cap": 400.0}, "aggressive": {"scale": 1.45, "cap": 1200.0}}


def q_scenario_forecast(spark, d):
    fit = trend.log_slope(trend.yearly_quantile(table(spark, d, "orders"), "o_orderdate", "o_totalprice", 0.9))
    plan = joins.scenarios(spark, FORECASTS).crossJoin(spark.range(1).select(F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))).alias("horizon")))
    value, capped = trend.forecast(F.greatest("slope", F.lit(0.01)), F.col("latest"), F.col("horizon"), F.col("w_scale"), F.col("w_cap"))
    return plan.crossJoin(F.broadcast(fit)).select("scenario", F.col("horizon").cast("long").alias("horizon"), F.round(value, 2).alias("value"), capped.alias("capped"))


register("q_scenario_forecast", q_scenario_forecast, f"WITH {YEARLY_SQL}, p(scenario, scale, cap) AS (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {w['scale']}::DOUBLE, {w['cap']}::DOUBLE)' for s, w in FORECASTS.items())}), g AS (SELECT scenario, h::BIGINT AS horizon, latest, cap, pow(10.0, greatest(slope, 0.01) * scale * h) AS growth FROM t, p, (VALUES (2), (5), (10)) AS x(h)) SELECT scenario, horizon, round(latest * least(growth, cap), 2) AS value, growth > cap AS capped FROM g")


def q_cosine_similarity(spark, d):
    fixed = F.transform("embedding", lambda x, i: (i % 3 - 1).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(numeric.cosine(F.col("embedding"), fixed) * 100, 4).alias("similarity"))


register("q_cosine_similarity", q_cosine_similarity, "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: (i % 3 - 1)::DOUBLE)) * 100, 4) AS similarity FROM embeddings")


def q_cadence_by_entity(spark, d):
    return ranking.cadence(table(spark, d, "events"), ["event_type"], F.col("ts"), "2024-01-30", 7).select("event_type", F.col("total").cast("long").alias("total"), F.col("recent").cast("long").alias("recent"), "median_gap_days", "latest_date", "cadence_label")


register("q_cadence_by_entity", q_cadence_by_entity, "WITH e AS (SELECT event_type, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY event_type ORDER BY d), d) AS gap FROM e), a AS (SELECT event_type, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (d >= DATE '2024-01-23'), 0)::BIGINT AS recent, round(median(gap), 1) AS median_gap_days, max(d)::VARCHAR AS latest_date FROM g GROUP BY 1) SELECT *, CASE WHEN recent >= 5 OR median_gap_days <= 75 THEN 'fast' WHEN recent >= 2 THEN 'steady' ELSE 'slow_or_sparse' END AS cadence_label FROM a")

CUSTOMER_FEATURES = ["balance", "orders", "spent"]


def q_kmeans_profile(spark, d):
    rolled = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("spent"))
    rows = joins.left_fill(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")), rolled, ["c_custkey"], ["orders", "spent"])
    z = numeric.zscore(rows, CUSTOMER_FEATURES)
    clustered = cluster.kmeans(z, "c_custkey", [f"{c}_z" for c in CUSTOMER_FEATURES])
    return cluster.profile(clustered, CUSTOMER_FEATURES, "c_custkey", [F.asc("c_custkey")], "balance", "spent")


register("q_kmeans_profile", q_kmeans_profile)


def q_bootstrap_rank(spark, d):
    return simulate.bootstrap_ranks(composite(spark, d).select("nation", "orders", *WEIGHTS), "nation", list(WEIGHTS), list(WEIGHTS.values()), "orders")


register("q_bootstrap_rank", q_bootstrap_rank)
LEADERS = [(s, h, [max(0.01, w + h / 200 * k) for k, w in enumerate(SETS[s].values())]) for s in ("baseline", "no_cost", "equal") for h in (2, 5, 10)]


def q_monte_carlo(spark, d):
    return simulate.leadership(composite(spark, d).select("nation", *WEIGHTS), "nation", list(WEIGHTS), LEADERS)


register("q_monte_carlo", q_monte_carlo)
register("q_permutation_pvalue", lambda spark, d: simulate.bucket_p_value(table(spark, d, "events").withColumn("w", F.dayofweek("ts")), "w", 7))
register("q_date_null_test", lambda spark, d: simulate.date_p_value(table(spark, d, "orders"), "o_orderdate"))
