"""Queries over grouped aggregates, windows, sorts and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import numeric
from tessera.operators import aggregate as agg
from tessera.operators import placing, ranking
from tessera.operators.quantile import exact_quantiles
from tessera.sources.readers import table

REFERENCE = "2001-08-01"


def n(c="n"):
    return F.count(F.lit(1)).alias(c)


def q_conditional_counts(spark, d):
    c = F.col
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        n(), F.count_if(c("l_discount") > 0.05).alias("discounted"), F.round(agg.positive_min(c("l_tax")), 6).alias("least_tax"),
        F.round(agg.share(c("l_quantity") > 25), 6).alias("large_share"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.round(F.max(F.when(c("l_quantity") > 40, c("l_extendedprice"))), 2).alias("top_large"),
    )


register("q_conditional_counts", q_conditional_counts, "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, round(min(CASE WHEN l_tax > 0 THEN l_tax END), 6) AS least_tax, round(avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS large_share, count(DISTINCT l_suppkey) AS suppliers, round(max(CASE WHEN l_quantity > 40 THEN l_extendedprice END), 2) AS top_large FROM lineitem GROUP BY ALL")


def q_bool_any_sorted_join(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.bool_or(F.col("n_chars") > 10000).alias("any_long"), agg.sorted_join(F.col("source"), 4, "; ").alias("sources"), agg.sum0(F.when(F.col("n_chars") < 0, 1)).cast("long").alias("negative"))


register("q_bool_any_sorted_join", q_bool_any_sorted_join, "SELECT lang, bool_or(n_chars > 10000) AS any_long, array_to_string(list_slice(list_sort(list_distinct(list(source))), 1, 4), '; ') AS sources, 0::BIGINT AS negative FROM documents GROUP BY lang")


def q_topn_then_agg(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return agg.top_n_then(rows, ["c_nationkey"], "o_totalprice", 20, top20_median=F.round(F.median("o_totalprice"), 4), top20_mean=F.round(F.avg("o_totalprice"), 4))


register("q_topn_then_agg", q_topn_then_agg, "SELECT c_nationkey, round(median(o_totalprice), 4) AS top20_median, round(avg(o_totalprice), 4) AS top20_mean FROM (SELECT c_nationkey, o_totalprice, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC) AS k FROM orders JOIN customer ON c_custkey = o_custkey) WHERE k <= 20 GROUP BY c_nationkey")


def q_quantile_by_year(spark, d):
    rows = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return exact_quantiles(rows, ["y"], "o_totalprice", p92=0.92, p75=0.75, p25=0.25).select("y", F.round("p92", 4).alias("p92"), F.round(F.col("p75") - F.col("p25"), 4).alias("iqr"))


register("q_quantile_by_year", q_quantile_by_year, "SELECT year(o_orderdate)::BIGINT AS y, round(quantile_cont(o_totalprice, 0.92), 4) AS p92, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1")


def q_weighted_avg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(agg.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("discount"))


register("q_weighted_avg", q_weighted_avg, "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS discount FROM lineitem GROUP BY l_returnflag")


def q_mode(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(agg.mode(F.col("event_type")).alias("mode"))


register("q_mode", q_mode, "SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1")


def q_grouping_sets(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    c = F.col
    return agg.grouping_sets(rows, ["l_returnflag", "l_linestatus", "ship_year"], [n(), F.round(agg.weighted_mean(c("l_extendedprice"), c("l_quantity")), 4).alias("price")])


register("q_grouping_sets", q_grouping_sets, "SELECT CASE WHEN grouping(f) = 0 THEN 'l_returnflag' WHEN grouping(s) = 0 THEN 'l_linestatus' ELSE 'ship_year' END AS grouping, coalesce(f, s, y) AS \"group\", count(*) AS n, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM (SELECT *, l_returnflag AS f, l_linestatus AS s, year(l_shipdate)::VARCHAR AS y FROM lineitem) GROUP BY GROUPING SETS ((f), (s), (y))")


def q_pivot_count(spark, d):
    return agg.contingency(table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "event_type", ["click", "purchase", "view"])


register("q_pivot_count", q_pivot_count, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")


def q_pivot_max(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.max("o_totalprice"), 2))


register("q_pivot_max", q_pivot_max, "SELECT o_orderpriority, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(max(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")


def q_coverage_share(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    c = F.col
    return rows.groupBy("lang").agg(F.round(agg.field_coverage(c("quality"), c("toxic")), 4).alias("labelled"), F.round(agg.field_coverage(c("quality"), positive=True), 4).alias("good"), F.round(agg.field_coverage(c("source")), 4).alias("sourced")).withColumn("index", F.round((c("labelled") + c("good") + c("sourced")) / 3 * 100, 4))


register("q_coverage_share", q_coverage_share, "SELECT *, round((labelled + good + sourced) / 3 * 100, 4) AS \"index\" FROM (SELECT lang, round(avg((quality IS NOT NULL OR toxic IS NOT NULL)::INT::DOUBLE), 4) AS labelled, round(avg(coalesce(quality > 0, false)::INT::DOUBLE), 4) AS good, round(avg((trim(source) <> '')::INT::DOUBLE), 4) AS sourced FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)")


def q_latest_date(spark, d):
    a = agg.latest_date(table(spark, d, "orders"), "o_orderdate").withColumn("table", F.lit("orders"))
    b = agg.latest_date(table(spark, d, "lineitem"), "l_shipdate").withColumn("table", F.lit("lineitem"))
    return a.unionByName(b).select("table", F.date_format("latest_date", "yyyy-MM-dd").alias("latest"))


register("q_latest_date", q_latest_date, "SELECT 'orders' AS \"table\", strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders UNION ALL SELECT 'lineitem', strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem")


def q_argmax_row(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"), F.round(F.max("o_totalprice"), 2).alias("price"))


register("q_argmax_row", q_argmax_row, "SELECT o_orderpriority, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS o_orderkey, round(max(o_totalprice), 2) AS price FROM orders GROUP BY 1")


def q_top_bucket(spark, d):
    return agg.most_frequent(table(spark, d, "events"), "event_type").select("value", "n", F.round("share", 6).alias("share"))


register("q_top_bucket", q_top_bucket, "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 1")


def q_rowwise_stats(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    c = F.col
    return rows.select("doc_id", F.round(numeric.row_mean(c("quality"), c("toxic"), (c("n_chars") % 7)), 6).alias("mean"), F.greatest("quality", "toxic").cast("long").alias("most"))


register("q_rowwise_stats", q_rowwise_stats, "SELECT doc_id, round((coalesce(quality, 0) + coalesce(toxic, 0) + n_chars % 7) / (1 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT)::DOUBLE, 6) AS mean, greatest(quality, toxic)::BIGINT AS most FROM documents LEFT JOIN labels USING (doc_id)")


def q_zscore(spark, d):
    return numeric.zscore(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_z", 6).alias("z"))


register("q_zscore", q_zscore, "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS z FROM part")


def q_rank_min(spark, d):
    spent = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).cast("long").alias("k"))
    peers = spent.groupBy("c_nationkey").agg(n("peers"))
    return placing.rank(spent, ["k"], [F.desc_nulls_last("k")], "rank", ["c_nationkey"]).join(peers, "c_nationkey").select("c_custkey", "rank", "peers")


register("q_rank_min", q_rank_min, "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS peers FROM customer")


def q_top1_per_group(spark, d):
    return ranking.first_per_group(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


register("q_top1_per_group", q_top1_per_group, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")


def q_lag_cadence(spark, d):
    return ranking.cadence(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), REFERENCE).select("o_custkey", F.col("total").cast("long").alias("total"), F.col("recent").cast("long").alias("recent"), F.round("median_gap_days", 4).alias("gap"), F.col("days_since_latest").cast("long").alias("since"), "cadence_label")


register("q_lag_cadence", q_lag_cadence, f"WITH e AS (SELECT o_custkey, o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM e), a AS (SELECT o_custkey, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (d >= DATE '{REFERENCE}' - INTERVAL 365 DAY), 0)::BIGINT AS recent, round(median(gap), 1) AS m, date_diff('day', max(d), DATE '{REFERENCE}')::BIGINT AS since FROM g GROUP BY o_custkey) SELECT o_custkey, total, recent, round(m, 4) AS gap, since, CASE WHEN recent >= 5 OR m <= 75 THEN 'fast' WHEN recent >= 2 THEN 'steady' ELSE 'slow_or_sparse' END AS cadence_label FROM a")


def q_minmax(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(7.0).alias("same"))
    scaled = numeric.minmax(rows, {"plain": ("s_acctbal", ""), "logged": ("s_acctbal", "log"), "turned": ("s_acctbal", "log invert"), "flat": ("same", "")})
    return scaled.select("s_suppkey", *(F.round(c, 6).alias(c) for c in ("plain", "logged", "turned", "flat")))


register("q_minmax", q_minmax, "WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, min(ln(1 + greatest(s_acctbal, 0))) AS llo, max(ln(1 + greatest(s_acctbal, 0))) AS lhi FROM supplier) SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo) * 100, 6) AS plain, round((ln(1 + greatest(s_acctbal, 0)) - llo) / (lhi - llo) * 100, 6) AS logged, round(100 - (ln(1 + greatest(s_acctbal, 0)) - llo) / (lhi - llo) * 100, 6) AS turned, 50.0::DOUBLE AS flat FROM supplier, b")


def q_sort_mixed_nulls(spark, d):
    """O1, O2: all rows with their place in a sort of mixed directions, missing values last."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("long").alias("quality"), "toxic")
    return placing.place(rows, [F.desc_nulls_last("quality"), F.asc_nulls_last("toxic"), F.asc("doc_id")]).select("doc_id", "quality", "place")


register("q_sort_mixed_nulls", q_sort_mixed_nulls, "SELECT doc_id, quality::BIGINT AS quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, toxic ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")


def q_sort_by_label(spark, d):
    """Counts in the order of their labels."""
    return placing.sorted_counts(table(spark, d, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")), "day")


register("q_sort_by_label", q_sort_by_label, "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n, row_number() OVER (ORDER BY strftime(l_shipdate, '%Y-%m-%d')) AS place FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY day")


def q_topk(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    top = c.orderBy(F.desc("price"), "o_orderkey").limit(10).withColumn("end", F.lit("top"))
    return top.unionByName(c.orderBy("price", "o_orderkey").limit(10).withColumn("end", F.lit("bottom")))


register("q_topk", q_topk, "(SELECT o_orderkey, round(o_totalprice, 2) AS price, 'top' AS \"end\" FROM orders ORDER BY price DESC, o_orderkey LIMIT 10) UNION ALL (SELECT o_orderkey, round(o_totalprice, 2) AS price, 'bottom' FROM orders ORDER BY price, o_orderkey LIMIT 10)")


def q_union_schema_evolve(spark, d):
    a = table(spark, d, "customer").select(F.concat(F.lit("c::"), F.col("c_custkey")).alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("s::"), F.col("s_suppkey")).alias("entity_id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))
    c = table(spark, d, "nation").select(F.concat(F.lit("n::"), F.col("n_nationkey")).alias("entity_id"), F.col("n_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


register("q_union_schema_evolve", q_union_schema_evolve, "SELECT 'c::' || c_custkey AS entity_id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 's::' || s_suppkey, s_name, NULL, round(s_acctbal, 2) FROM supplier UNION ALL SELECT 'n::' || n_nationkey, n_name, NULL, NULL FROM nation")


def q_distinct_on(spark, d):
    return ranking.first_per_group(table(spark, d, "part"), ["p_brand", "p_type"], F.asc("p_retailprice"), F.asc("p_partkey")).select("p_brand", "p_type", "p_partkey")


register("q_distinct_on", q_distinct_on, "SELECT DISTINCT ON (p_brand, p_type) p_brand, p_type, p_partkey FROM part ORDER BY p_brand, p_type, p_retailprice, p_partkey")


def q_set_ops(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    first, other = F.array(F.lit("click"), F.lit("view")), F.col("s")
    return by.select("user_id", F.array_join(F.array_sort(F.array_intersect(other, first)), ",").alias("both"), F.array_join(F.array_sort(F.array_except(other, first)), ",").alias("rest"), F.size(F.array_union(other, first)).cast("long").alias("all"), (~F.arrays_overlap(other, F.array(F.lit("error"))) & ~F.array_contains(other, "signup")).alias("neither"))


register("q_set_ops", q_set_ops, "WITH b AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS s FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_filter(s, lambda x: x IN ('click', 'view')), ',') AS both, array_to_string(list_filter(s, lambda x: x NOT IN ('click', 'view')), ',') AS rest, len(list_distinct(list_concat(s, ['click', 'view'])))::BIGINT AS \"all\", NOT list_contains(s, 'error') AND NOT list_contains(s, 'signup') AS neither FROM b")
