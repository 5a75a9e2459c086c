"""Queries over join shapes, frontiers and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import numeric, text
from tessera.operators import aggregate as agg
from tessera.operators import joins, match
from tessera.operators.skyline import skyline
from tessera.sources.readers import table


def q_left_rollup_fill0(spark, d):
    rolled = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return joins.left_fill(table(spark, d, "customer").select("c_custkey"), rolled, ["c_custkey"], ["orders", "spent"])


register("q_left_rollup_fill0", q_left_rollup_fill0, "SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(spent, 0.0) AS spent FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (c_custkey)")


def q_left_text_key_fallback(spark, d):
    parts = table(spark, d, "part").select("p_partkey", text.title_key(F.col("p_name")).alias("k"), F.substring("p_brand", 1, 6).alias("g"))
    price = table(spark, d, "part").where("p_size > 45").groupBy(text.title_key(F.col("p_name")).alias("k")).agg(F.round(F.max("p_retailprice"), 2).alias("price"))
    group = table(spark, d, "part").groupBy(F.substring("p_brand", 1, 6).alias("g")).agg(F.round(F.avg("p_retailprice"), 2).alias("price"))
    return joins.left_with_fallback(parts, price, "k", group, "g", "price").select("p_partkey", "price")


register("q_left_text_key_fallback", q_left_text_key_fallback, "WITH p AS (SELECT p_partkey, lower(p_name) AS k, substr(p_brand, 1, 6) AS g, p_size, p_retailprice FROM part), a AS (SELECT k, round(max(p_retailprice), 2) AS x FROM p WHERE p_size > 45 GROUP BY k), b AS (SELECT g, round(avg(p_retailprice), 2) AS y FROM p GROUP BY g) SELECT p_partkey, coalesce(x, y) AS price FROM p LEFT JOIN a USING (k) LEFT JOIN b USING (g)")


def q_inner_left_chain(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey", F.col("s_name").alias("rich"))
    return table(spark, d, "part").join(lines, "p_partkey").join(rich, "s_suppkey", "left").groupBy("p_type").agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("rich").isNotNull(), F.col("n")).otherwise(0)).alias("rich_lines"))


register("q_inner_left_chain", q_inner_left_chain, "SELECT p_type, count(*) AS lines, count(s_suppkey) AS rich_lines FROM part JOIN lineitem ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_suppkey = l_suppkey GROUP BY p_type")


def nation_features(spark, d):
    """One row per nation: customers, suppliers, orders."""
    customers = table(spark, d, "customer")
    orders = table(spark, d, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    a = customers.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("best_balance"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"), agg.positive_min(F.col("s_acctbal")).alias("least_balance"))
    c = orders.groupBy("nation").agg(F.sum("o_totalprice").alias("revenue"), F.count_if(F.col("o_orderdate") >= "2001-01-01").alias("recent"), F.count(F.lit(1)).alias("orders"))
    return joins.full_merge([a, b, c], "nation")


FEATURES_SQL = """
a AS (SELECT c_nationkey AS nation, count(*) AS customers, max(c_acctbal) AS best_balance FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS nation, count(*) AS suppliers, min(s_acctbal) FILTER (s_acctbal > 0) AS least_balance FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey AS nation, sum(o_totalprice) AS revenue, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS recent, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
f AS (SELECT nation, customers, best_balance, suppliers, least_balance, revenue, recent, orders FROM a FULL JOIN b USING (nation) FULL JOIN c USING (nation))
"""


def q_full_outer_merge(spark, d):
    f = nation_features(spark, d)
    return f.select("nation", "customers", "suppliers", "orders", "recent", F.round("revenue", 2).alias("revenue"), F.round("least_balance", 2).alias("least_balance"))


register("q_full_outer_merge", q_full_outer_merge, f"WITH {FEATURES_SQL} SELECT nation, customers, suppliers, orders, recent, round(revenue, 2) AS revenue, round(least_balance, 2) AS least_balance FROM f")


def q_cross_scenarios(spark, d):
    table_of = {"low": {"a": 1.0, "b": 0.5}, "high": {"a": 2.0, "b": 0.25}}
    nations = table(spark, d, "nation").select("n_nationkey")
    return nations.crossJoin(F.broadcast(joins.scenarios(spark, table_of))).select("n_nationkey", "scenario", F.round(F.col("n_nationkey") * F.col("w_a") + F.col("w_b"), 4).alias("x"))


register("q_cross_scenarios", q_cross_scenarios, "SELECT n_nationkey, scenario, round(n_nationkey * a + b, 4) AS x FROM nation, (VALUES ('low', 1.0::DOUBLE, 0.5::DOUBLE), ('high', 2.0::DOUBLE, 0.25::DOUBLE)) AS s(scenario, a, b)")


def q_cross_membership_flags(spark, d):
    kinds = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("click", "purchase", "error")))).alias("event_type"))
    users = table(spark, d, "events").select("user_id").distinct()
    return joins.membership(users.crossJoin(F.broadcast(kinds)), table(spark, d, "events"), ["user_id", "event_type"], "seen")


register("q_cross_membership_flags", q_cross_membership_flags, "SELECT u.user_id, k.event_type, EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type) AS seen FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('purchase'), ('error')) k(event_type)")


def q_semi_flag(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    semi = table(spark, d, "customer").join(big, "c_custkey", "left_semi")
    return joins.with_lookup(semi.select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "b2b", "HOUSEHOLD": "b2c"}, "channel", "other")


register("q_semi_flag", q_semi_flag, "SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'b2b' WHEN 'HOUSEHOLD' THEN 'b2c' ELSE 'other' END AS channel FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")


def q_upsert_last_wins(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return joins.upsert(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "day").select("user_id", "event_type", "event_id", "provenance")


register("q_upsert_last_wins", q_upsert_last_wins, "WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), l AS (SELECT user_id, event_type, last(event_id ORDER BY ts, event_id) AS event_id FROM e GROUP BY ALL), p AS (SELECT user_id, event_type, string_agg(day, '|' ORDER BY day) AS provenance FROM (SELECT DISTINCT user_id, event_type, day FROM e) GROUP BY ALL) SELECT user_id, event_type, event_id, provenance FROM l JOIN p USING (user_id, event_type)")


def q_skyline(spark, d):
    return skyline(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


register("q_skyline", q_skyline, "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")


def q_tiered_match(spark, d):
    """Every part against all parts as candidates: by name, by an alias of name and price class, by type."""
    alias = F.array(F.concat_ws("-", F.replace("p_name", F.lit(" ")), F.floor(F.col("p_retailprice") * 10).cast("string")))
    parts = table(spark, d, "part")
    queries = parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("p"), F.col("p_partkey")).alias("model_id"), F.col("p_type").alias("family"), alias.alias("aliases"))
    candidates = parts.select((-F.col("p_partkey")).alias("ord"), F.concat(F.lit("P"), F.col("p_partkey") * 2).alias("name"), F.col("p_type").alias("family"), alias.alias("aliases"), F.col("p_retailprice").alias("sort_score"))
    return match.tiered_match(queries, candidates).select("id", "match_confidence", "match_key", "direct", F.col("record.name").alias("candidate_name"))


register(
    "q_tiered_match", q_tiered_match,
    "WITH p AS (SELECT *, replace(p_name, ' ', '') || '-' || floor(p_retailprice * 10)::BIGINT AS a FROM part), "
    "m AS (SELECT q.p_partkey AS id, 0 AS tier, c.p_partkey AS c, 'p' || q.p_partkey AS k FROM p q JOIN p c ON c.p_partkey * 2 = q.p_partkey UNION ALL "
    "SELECT q.p_partkey, 1, c.c, q.a FROM p q JOIN (SELECT a, max(p_partkey) AS c FROM p GROUP BY a) c USING (a) UNION ALL "
    "SELECT q.p_partkey, 3, c.c, q.p_type FROM p q JOIN (SELECT p_type, first(p_partkey ORDER BY p_retailprice DESC, p_partkey DESC) AS c FROM p GROUP BY 1) c USING (p_type)), "
    "b AS (SELECT id, first(tier ORDER BY tier) AS tier, first(c ORDER BY tier) AS c, first(k ORDER BY tier) AS k FROM m GROUP BY id) "
    "SELECT id, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized_exact' WHEN 3 THEN 'family_only' END AS match_confidence, k AS match_key, tier <= 2 AS direct, 'P' || (c * 2) AS candidate_name FROM b",
)


def q_price_blend(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("a"), F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))).alias("b"))
    return by.select("l_partkey", F.round(numeric.price_blend(F.col("a"), F.col("b")), 1).alias("blend"))


register("q_price_blend", q_price_blend, "SELECT l_partkey, round(a * 0.35 + coalesce(b, a) * 0.65, 1) AS blend FROM (SELECT l_partkey, avg(l_extendedprice) AS a, avg(CASE WHEN l_discount > 0.05 THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1)")


def q_reason_list(spark, d):
    f = nation_features(spark, d)
    middle = f.agg(F.median("revenue").alias("m"))
    return f.crossJoin(F.broadcast(middle)).select("nation", agg.reasons(few_suppliers=F.col("suppliers") < 4, low_recent=F.col("recent") < 50, below_median=F.col("revenue") < F.col("m")).alias("reasons"))


register("q_reason_list", q_reason_list, f"WITH {FEATURES_SQL} SELECT nation, coalesce(nullif(concat_ws(',', CASE WHEN suppliers < 4 THEN 'few_suppliers' END, CASE WHEN recent < 50 THEN 'low_recent' END, CASE WHEN revenue < (SELECT median(revenue) FROM f) THEN 'below_median' END), ''), 'none') AS reasons FROM f")
