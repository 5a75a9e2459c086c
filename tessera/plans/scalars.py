"""Queries over text, date and number functions, filters and projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import dates, nested, numeric, rules, text
from tessera.sources.readers import table

WORDS = ["widget", "gear", "cold", "small"]
DOMAINS = {"legal": ["the", "law"], "office": ["and", "office"], "analysis": ["of", "ing"]}
PART_RULES = (("metal", ("steel", "bolt", "gear")), ("cold", ("cold",)), ("widget", ("widget",)))
SLUG_SQL = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


def _contains_sql(column: str, rules) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules)


def q_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.clean_text(F.col("p_brand"), "n/a").alias("brand"))


register("q_slug", q_slug, f"SELECT p_partkey, {SLUG_SQL.format(c='p_name')} AS slug, CASE WHEN lower(trim(p_brand)) IN ('', 'nan', 'none', 'null') OR p_brand IS NULL THEN 'n/a' ELSE trim(p_brand) END AS brand FROM part")


def q_safe_float(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.safe_float(F.col("o_orderpriority")).alias("level"), text.price_per_million(F.col("o_totalprice").cast("string")).alias("per_million"))


register("q_safe_float", q_safe_float, "SELECT o_orderkey, try_cast(nullif(regexp_extract(o_orderpriority, '[-+]?\\d*\\.?\\d+', 0), '') AS DOUBLE) AS level, CASE WHEN o_totalprice >= 0 THEN o_totalprice * 1000000 END AS per_million FROM orders")


def q_code_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", text.code_prefix(F.col("p_brand"), r"\d{2}", 5).alias("code"), F.substring_index("p_name", " ", 1).alias("head"), F.substring("p_type", 1, 2).alias("kind"))


register("q_code_prefix", q_code_prefix, "SELECT p_partkey, coalesce(nullif(regexp_extract(p_brand, '\\d{2}', 0), ''), substr(p_brand, 1, 5)) AS code, split_part(p_name, ' ', 1) AS head, substr(p_type, 1, 2) AS kind FROM part")


def q_rule_classify(spark, d):
    low = F.lower("p_name")
    return table(spark, d, "part").select("p_partkey", rules.first_rule(low, PART_RULES, rules.any_substring, F.lit("other")).alias("class"), F.when(F.col("p_type").rlike("^(PROMO|ECONOMY)"), "cheap").otherwise("full").alias("tier"))


register("q_rule_classify", q_rule_classify, f"SELECT p_partkey, CASE {_contains_sql('lower(p_name)', PART_RULES)} ELSE 'other' END AS class, CASE WHEN regexp_matches(p_type, '^(PROMO|ECONOMY)') THEN 'cheap' ELSE 'full' END AS tier FROM part")


def q_keyword_score(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(text.keyword_score(c, WORDS), 6).alias("score"), text.best_by_keywords(c, DOMAINS, "none").alias("domain"))


def _score_sql() -> str:
    hits = " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS)
    each = {k: " + ".join(f"contains(lower(text), '{w}')::INT" for w in v) for k, v in DOMAINS.items()}
    top = "greatest(" + ", ".join(each.values()) + ")"
    case = " ".join(f"WHEN ({v}) = {top} THEN '{k}'" for k, v in each.items())
    return f"SELECT doc_id, round(least(1.0, ({hits}) / 2.0)::DOUBLE, 6) AS score, CASE WHEN {top} = 0 THEN 'none' {case} END AS domain FROM documents"


register("q_keyword_score", q_keyword_score, _score_sql())


def q_mentions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(text.mentions(F.col("text"), "the|tion")).alias("mention"))
    return rows.groupBy("mention").agg(F.count(F.lit(1)).alias("docs"))


register("q_mentions", q_mentions, "SELECT mention, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)(the|tion)', 1))) AS mention FROM documents) GROUP BY mention")


def q_param_infer(spark, d):
    name = F.concat(F.lit("m-"), F.col("p_size").cast("string"), F.lit("b-"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.inferred_parameters(name).alias("parameters"), text.active_parameters(F.concat(F.col("p_size").cast("string"), F.lit("B active"))).alias("active"))


register("q_param_infer", q_param_infer, "SELECT p_partkey, p_size * 1e9 AS parameters, p_size * 1e9 AS active FROM part")


def q_title_key(spark, d):
    return table(spark, d, "pages").select("page_id", text.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_key"))


register("q_title_key", q_title_key, "SELECT page_id, regexp_replace(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')), '\\s+occupations?$', '') AS title_key FROM pages")


def q_normalize_name(spark, d):
    name = F.concat(F.lit("Acme: openai/"), F.col("p_name"), F.lit(" (Fast) 2024-05-13 Preview 1.5"))
    return table(spark, d, "part").select("p_partkey", rules.normalized_model(name).alias("name"), F.size(rules.alias_set(name, F.col("p_name"), F.lit("GPT"), ("GPT",))).alias("aliases"))


register("q_normalize_name", q_normalize_name, "SELECT p_partkey, 'openai' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '15' AS name, 2 AS aliases FROM part")


def q_json_fields(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


register("q_json_fields", q_json_fields, "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")


def q_json_map_explode(spark, d):
    packed = table(spark, d, "part").select("p_partkey", F.to_json(F.create_map(F.lit("size"), F.create_map(F.lit("value"), F.col("p_size").cast("string"), F.lit("unit"), F.lit("cm")))).alias("m"))
    return nested.map_of_maps(packed, "m", "benchmark", "metric").select("p_partkey", "benchmark", "metric", "raw_value", "value")


register("q_json_map_explode", q_json_map_explode, "SELECT p_partkey, 'size' AS benchmark, 'value' AS metric, p_size::VARCHAR AS raw_value, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'size', 'unit', 'cm', NULL FROM part")


def q_inverted_text(spark, d):
    words = F.split("p_name", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w))))
    return table(spark, d, "part").select("p_partkey", nested.inverted_text(index).alias("text"))


register("q_inverted_text", q_inverted_text, "SELECT p_partkey, p_name AS text FROM part")


def q_date_parts(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(c).cast("long").alias("y"), F.concat(F.lit("Q"), F.quarter(c).cast("string")).alias("q"), F.date_format(c, "MMMM").alias("month_name"), F.date_format(c, "EEEE").alias("day_name"), F.date_format(c, "yyyy-MM-dd").alias("iso"))


register("q_date_parts", q_date_parts, "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, 'Q' || quarter(o_orderdate)::VARCHAR AS q, monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")


def q_parse_date(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.lit("garbage"))
    p = dates.parse_date(raw)
    return table(spark, d, "orders").select("o_orderkey", p["precision"].alias("precision"), F.date_format(p["date"], "yyyy-MM-dd").alias("iso"))


register("q_parse_date", q_parse_date, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' ELSE 'unparsed' END AS precision, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")


def q_recent_window(spark, d):
    return table(spark, d, "orders").where(dates.recent(F.col("o_orderdate"), "2001-08-01", 240)).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


register("q_recent_window", q_recent_window, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 240 DAY GROUP BY o_orderpriority")


def q_embedded_date(spark, d):
    name = F.concat(F.when(F.col("event_id") % 5 == 0, "undated").otherwise(F.date_format("ts", "yyyyMMdd")), F.lit("_run"))
    day = dates.embedded_date(name)
    return table(spark, d, "events").where(day.isNull() | (day <= F.lit("2024-01-15").cast("date"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


register("q_embedded_date", q_embedded_date, "SELECT event_type, count(*) AS n FROM events WHERE event_id % 5 = 0 OR ts::DATE <= DATE '2024-01-15' GROUP BY event_type")


def q_cut_bins(spark, d):
    c = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", numeric.cut(F.col("p_size").cast("double"), [0, 10, 20, 35], ["low", "mid", "high"]).alias("bin"), numeric.rounded(numeric.clip(c, 950, 1500), 2).alias("clipped"))


register("q_cut_bins", q_cut_bins, "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'low' WHEN p_size > 10 AND p_size <= 20 THEN 'mid' WHEN p_size > 20 AND p_size <= 35 THEN 'high' END AS bin, round(least(greatest(p_retailprice, 950), 1500), 2) AS clipped FROM part")


def q_case_divide(spark, d):
    c = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(numeric.safe_divide(F.sum("l_extendedprice"), F.sum(F.when(c > 5, 1)), -1.0), 4).alias("per_deep_discount"), F.round(F.avg(F.when(c >= 0.05, 1.0).otherwise(0.0)), 6).alias("discounted"))


register("q_case_divide", q_case_divide, "SELECT l_returnflag, round(coalesce(sum(l_extendedprice) / nullif(sum(CASE WHEN l_discount > 5 THEN 1 END), 0), -1.0), 4) AS per_deep_discount, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS discounted FROM lineitem GROUP BY l_returnflag")


def q_coalesce_chain(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).cast("long").alias("label"))


register("q_coalesce_chain", q_coalesce_chain, "SELECT doc_id, coalesce(quality, toxic, -1)::BIGINT AS label FROM documents LEFT JOIN labels USING (doc_id)")


def q_exclusion_filter(spark, d):
    return table(spark, d, "part").where(~rules.excluded([F.col("p_name"), F.col("p_type")], (r"\bcold\b", r"promo"))).select("p_partkey", "p_name")


register("q_exclusion_filter", q_exclusion_filter, r"SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(concat_ws(' ', p_name, p_type)), '\bcold\b|promo')")


def q_range_bucket(spark, d):
    return table(spark, d, "events").select("event_id", dates.moon_phase(F.col("ts")).alias("phase"), F.round(dates.moon_age(F.col("ts")), 4).alias("age"), dates.in_yearly_windows(F.col("ts")).alias("inside"))


def _moon_sql() -> str:
    cases = " ".join(f"WHEN age < {a} THEN '{label}'" for a, label in dates.MOON_PHASES)
    inside = " OR ".join(f"(ts >= (strftime(ts, '%Y') || '-{a}')::TIMESTAMP AND ts <= (strftime(ts, '%Y') || '-{b}')::TIMESTAMP)" for a, b in dates.WINDOWS)
    return f"SELECT event_id, CASE {cases} ELSE 'New' END AS phase, round(age, 4) AS age, {inside} AS inside FROM (SELECT *, ((epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-06 18:14:00')) / 86400000000.0::DOUBLE) % {dates.SYNODIC_DAYS}::DOUBLE AS age FROM events)"


register("q_range_bucket", q_range_bucket, _moon_sql())


def q_html_formats(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.escape_html(F.col("text")).alias("html"), text.format_share(F.length("text") / 1000).alias("share"), text.sentence_join(F.split("text", r"\.\s*"), 2).alias("lead"), F.sha2("text", 256).alias("sha"))


register("q_html_formats", q_html_formats, r"SELECT item_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS html, printf('%.1f%%', round(length(text) / 1000.0::DOUBLE * 100, 1)) AS share, array_to_string(list_slice(list_filter(string_split_regex(text, '\.\s*'), lambda x: trim(x) <> ''), 1, 2), '; ') AS lead, sha256(text) AS sha FROM benchmark")
