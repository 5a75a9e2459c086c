"""Composed pipelines on small literal tables: contracts of their outputs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric, text
from tessera.plans import exposure, families, labor

FAMILIES = ["GPT", "Claude", "Gemini", "Gemma", "Qwen"]


@pytest.fixture(scope="module")
def features(spark):
    names = "lmarena_best swebench_best openllm_top_mean recent_api_releases epoch_recent_releases hf_downloads github_model_mentions openalex_paper_mentions hf_likes context_window_max max_output_tokens multimodal_models training_compute_max output_price_min open_api_models hf_open_weight_share open_weight_epoch_share evidence_count".split()
    rows = [(f, *(float((k + 1) * (j + 2) % 11) if (k, j) != (2, 13) else 0.0 for j in range(len(names)))) for k, f in enumerate(FAMILIES)]
    return spark.createDataFrame(rows, "model_family string, " + ", ".join(n + " double" for n in names))


@pytest.fixture(scope="module")
def scores(features):
    return families.components(features).cache()


@pytest.fixture(scope="module")
def catalogue(spark):
    schema = "id string, name string, created long, context_length long, pricing struct<prompt:string,completion:string>, architecture struct<input_modalities:array<string>>"
    rows = [("openai/gpt-5.5", "OpenAI: GPT 5.5", 1_750_000_000, 1000, ("0.000002", "0.00001"), (["text", "image"],)), ("acme/odd", "Odd", None, None, ("-1", None), (None,)), ("anthropic/claude-sonnet-4.5", "Anthropic: Claude Sonnet 4.5", 1_740_000_000, 500, ("0", "0.000003"), (["text"],))]
    return families.api_catalogue(spark.createDataFrame(rows, schema)).cache()


def test_components(scores):
    rows = scores.collect()
    for r in rows:
        assert all(0 <= r[c] <= 100 for c in families.COMPONENTS)
        assert r["index"] == pytest.approx(sum(r[c] * w for c, w in families.COMPONENTS.items()), abs=0.006)
    assert sorted(r["rank"] for r in rows)[0] == 1
    free = next(r for r in rows if r.model_family == "Gemini")
    assert free.cost_efficiency_component == 0.0  # a zero price is missing, and missing is worst


def test_studies(scores):
    each = families.sensitivity(scores)
    assert each.count() == 4 * len(FAMILIES) and each.agg(F.max("rank")).first()[0] <= len(FAMILIES)
    vendors = {r.vendor: r for r in families.vendor_scores(scores).collect()}
    assert vendors["Google"].family_count == 2 and vendors["Google"].portfolio_families == "Gemini, Gemma"
    spans = families.rank_intervals(scores, draws=60).collect()
    assert all(r.best_rank <= r.worst_rank and r.score_p10 <= r.score_p90 for r in spans)
    shares = families.leadership(scores, draws=500).groupBy("scenario", "horizon").agg(F.sum("win_share").alias("s")).collect()
    assert len(shares) == 9 and all(r.s == pytest.approx(1.0) for r in shares)


def test_weights():
    assert sum(families.COMPONENTS.values()) == pytest.approx(1.0)
    assert all(sum(w) == pytest.approx(1.0) for w in families.SENSITIVITY.values())
    assert all(sum(w) == pytest.approx(1.0) for by in families.LEADERSHIP.values() for w in by.values())


def test_catalogue_audit_and_coverage(spark, catalogue):
    rows = {r.openrouter_id: r for r in catalogue.collect()}
    gpt = rows["openai/gpt-5.5"]
    assert (gpt.vendor, gpt.model_family, gpt.input_usd_per_1m, gpt.release_date) == ("OpenAI", "GPT", pytest.approx(2.0), datetime.date(2025, 6, 15))
    assert rows["acme/odd"].input_usd_per_1m is None and rows["acme/odd"].release_date is None
    board = spark.createDataFrame([("gpt-5.5", "OpenAI", "text", 9.0), ("gpt-5.5", "OpenAI", "code", 11.0), ("claude-opus", "Anthropic", "text", 1.0)], "model string, org string, category string, score double")
    family = families.rules.family_of_model(F.col("model"), F.lit(""), F.col("org"))
    a = families.best_rows(board, "a", "rating", "model", "model", "score", family, F.col("category"), F.lit("u"))
    b = families.mean_rows(board, "b", "mean", "model", "model", "score", family, "category", F.lit("v"))
    assert {(r.name, r.benchmark_score, r.benchmark_category) for r in a.collect()} == {("gpt-5.5", 11.0, "code"), ("claude-opus", 1.0, "text")}
    assert {(r.name, r.benchmark_score, r.benchmark_category, r.sort_score) for r in b.collect()} == {("gpt-5.5", 10.0, "code; text", 11.0), ("claude-opus", 1.0, "text", 1.0)}
    audit = families.match_audit(catalogue, a.unionByName(b)).cache()
    got = {(r.openrouter_id, r.benchmark_source): (r.match_confidence, r.benchmark_model_name, r.benchmark_score) for r in audit.collect()}
    assert len(got) == 6 and len(audit.columns) == 17
    assert got["openai/gpt-5.5", "a"] == ("normalized_exact", "gpt-5.5", 11.0) and got["openai/gpt-5.5", "b"] == ("normalized_exact", "gpt-5.5", 10.0)
    assert got["anthropic/claude-sonnet-4.5", "b"] == ("family_only", "claude-opus", 1.0) and got["acme/odd", "a"][0] == "unmatched"
    assert len(catalogue.columns) == 22 and len(families.pricing(catalogue).columns) == 13
    short = families.key_models(catalogue, {"gpt-5.5": "https://release"}).collect()
    assert [(r.openrouter_id, r.source_url, r.secondary_source_url) for r in short] == [("openai/gpt-5.5", "https://release", "https://openai/gpt-5.5")]
    scored = spark.createDataFrame([("GPT", 4, 2), ("Grok", 0, 0)], "model_family string, lmarena_models long, api_model_count long")
    covered = {r.model_family: r for r in families.family_coverage(scored, catalogue, audit).collect()}
    assert set(covered) == {"GPT", "Grok"} and covered["GPT"].price_coverage == 1.0 and covered["GPT"].vendor == "OpenAI"
    assert (covered["GPT"].direct_benchmark_match_count, covered["GPT"].family_proxy_benchmark_count, covered["GPT"].source_gap_count) == (2, 4, 0)
    assert covered["GPT"].coverage_score == pytest.approx((4 + 2 / 3 + 0.8) / 6 * 100, abs=0.006)
    assert (covered["Grok"].coverage_score, covered["Grok"].source_gap_count) == (0.0, 6)
    # the first name with a claim, not the best score; within a family the best score
    twins = spark.createDataFrame([("s", n, n, "GPT", x, x, "m", "c", "u") for n, x in (("GPT 5.5", 1.0), ("gpt-5.5", 9.0))] + [("s", "claude-x", "claude-x", "Claude", 3.0, 3.0, "m", "c", "u"), ("s", "claude-a", "claude-a", "Claude", 2.0, 2.0, "m", "c", "u")],
        "benchmark_source string, name string, model_id string, family string, sort_score double, benchmark_score double, benchmark_metric string, benchmark_category string, source_url string")
    took = {r.openrouter_id: (r.benchmark_model_name, r.match_confidence) for r in families.match_audit(catalogue, twins).collect()}
    assert took["openai/gpt-5.5"] == ("GPT 5.5", "normalized_exact") and took["anthropic/claude-sonnet-4.5"] == ("claude-x", "family_only")
    undated = catalogue.unionByName(catalogue.withColumn("release_date", F.lit(None).cast("date"))).unionByName(catalogue)
    research = catalogue.withColumn("access_class", F.lit("likely_open_weight"))
    cadence = {r.model_family: r for r in families.release_cadence(research, undated, "model_family", "2026-05-15").collect()}
    assert set(cadence) == {"GPT", "Claude"} and cadence["GPT"].total == 2 and cadence["GPT"].source_mix == "api_catalog:1,open_weight:1" and cadence["GPT"].vendor == "OpenAI"
    vendors = {r.vendor: r for r in families.release_cadence(research, undated, "vendor", "2026-05-15").collect()}
    assert vendors["Anthropic"].portfolio_families == "Claude"
    priced = families.price_performance(catalogue.withColumn("rating", F.col("context_window")), direct=True)
    assert priced.where("on_frontier").count() >= 1


def test_research_files_gaps_outcomes(spark, tmp_path):
    raw = spark.createDataFrame([("Llama 4", "Meta", "2025-04", "1e11", "17B active", "Open weights"), ("X", None, "oops", "n/a", None, None)], "model string, Organization string, `Publication date` string, Parameters string, `Parameters notes` string, `Model accessibility` string")
    rows = {r.canonical_model: r for r in families.research_models(raw).collect()}
    assert (rows["Llama 4"].parameters, rows["Llama 4"].active_parameters, rows["Llama 4"].release_precision, rows["Llama 4"].access_class) == (1e11, 1.7e10, "month", "open_weight")
    assert rows["X"].release_precision == "unparsed" and rows["X"].parameters is None
    assert len(families.research_models(raw).columns) == 25
    hub = families.hub_models(spark.createDataFrame([("a/m-7b", "a", ["license:mit", "arxiv:1"], 5, 1), ("b/n", "b", [], 0, 0)], "id string, author string, tags array<string>, downloads long, likes long"), "org")
    assert len(hub.columns) == 26
    files = spark.createDataFrame([("a/m-7b", "x.safetensors", 9), ("a/m-7b", "config.json", 1)], "id string, path string, size long")
    got = {r.id: (r.license, r.parameters, r.file_count, r.total_bytes, r.weight_files) for r in families.file_rollup(hub, files).collect()}
    assert got == {"a/m-7b": ("mit", 7e9, 2, 10, 1), "b/n": (None, None, 0, 0, 0)}
    board = spark.createDataFrame([("c", "open_weight", "m", 90.0), ("c", "unknown", "n", 100.0), ("d", "unknown", "n", 5.0)], "category string, access_class string, model_name string, rating double")
    gaps = {r.category: (r.gap, r.gap_share) for r in families.open_closed_gap(board).collect()}
    assert gaps == {"c": (10.0, pytest.approx(0.1)), "d": (None, 0.0)}
    assert families.category_leaders(board).count() == 3
    subs = spark.createDataFrame([("s", ["r-1"], ["r-2"], None)], "submission string, resolved array<string>, no_generation array<string>, no_logs array<string>")
    out = families.instance_outcomes(subs, spark.createDataFrame([("r-1",), ("r-2",), ("r-3",)], "instance_id string"))
    assert [tuple(r)[3:] for r in out.orderBy("instance_id").collect()] == [(True, False, False, False), (False, True, False, False), (False, False, False, True)]
    assert families.unified_index(("a", raw.select(F.col("model").alias("name"))), ("b", hub.select(F.col("id").alias("name"), "likes"))).count() == 4


def test_round_even_is_that_of_the_sql(spark):
    import duckdb

    values = [float(x) for k in range(0, 4000, 5) for x in (k / 1000, k / 1000 * (1 + 2**-52), -k / 1000)] + [1.015, 1.145, 8.345, 35.855, 0.0]
    want = duckdb.sql(f"SELECT round_even(x, 2), round_even(x, 3) FROM (SELECT unnest({values}::DOUBLE[]) AS x)").fetchall()
    got = spark.createDataFrame([(x,) for x in values], "x double").select(numeric.round_even(F.col("x"), 2), numeric.round_even(F.col("x"), 3)).collect()
    assert [tuple(r) for r in got] == want


def test_first_family_among_equal_codes(spark):
    rows = [("11-0001", "n", f, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for f in ("SMALL", "ECONOMY", "PROMO")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        found = labor.wage_rollup(spark.createDataFrame(order, exposure.JOBS["wages"].schema).coalesce(1)).collect()
        assert [r.job_family for r in found] == ["ECONOMY"]


def test_first_family_among_equal_codes_is_that_of_the_first_line(spark, tmp_path):
    import duckdb

    where = f"{tmp_path}/part.parquet"
    duckdb.sql("COPY (SELECT k AS p_partkey, 'n' || k AS p_name, ['SMALL', 'ECONOMY', 'PROMO'][1 + k // 7 % 3] AS p_type, 1::INT AS p_size, 9.5 AS p_retailprice FROM (SELECT unnest([3, 827762, 1655521, 4, 827763, 12]) AS k)) TO '" + where + "'")
    wages = exposure.INPUTS["wages"].format(part=f"'{where}'")
    con = duckdb.connect(config={"threads": 1})
    want = con.execute(f"SELECT SOCcode, first(JobFamily ORDER BY SOCcode) FROM ({wages}) GROUP BY 1 ORDER BY 1").fetchall()
    parts = spark.read.parquet(where)
    for df in (parts, parts.orderBy(F.desc("p_partkey"))):
        lines = spark.sql(exposure.wages_by_line(), part=df)
        assert [(r.soc_base, r.job_family) for r in labor.wage_rollup(lines).orderBy("soc_base").collect()] == want and len(want) == 3


def test_document_features_are_those_of_the_tasks(spark):
    """Parts meet the numbers of documents; the tasks, with their texts, give the same."""
    parts = spark.createDataFrame([(k, f"p{k}", "SMALL", k % 50, 900.0 + k) for k in [*range(40), 827_759, 827_760]] + [(None, "p", "SMALL", 1, 1.0)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")
    docs = spark.createDataFrame([(0, "Write code", 10), (1, " repair and plan ", 12), (2, "write code ", 11), (2, "Draft an email", 14), (4, None, 0), (None, "lost", 4)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    t = {k: spark.sql(sql, **{n: df for n, df in {"part": parts, "documents": docs, "labels": labels}.items() if "{" + n + "}" in sql}) for k, sql in exposure.INPUTS.items()}
    lookups = (t["penetration"], t["shares"], t["modes"])
    texts = labor.text_features(docs.select("doc_id", F.col("text").alias("task")), *lookups)
    assert texts.count() == 5  # one row per text, not per part
    got, want = (sorted(map(str, df.collect())) for df in (exposure.document_features(parts, docs, *lookups), labor.task_features(t["tasks"], *lookups)))
    assert got == want and len(got) > 20


def test_marks_of_tasks_stand_for_their_texts(spark):
    """Keywords over borders, blank, equal and nearly equal texts: the domains are those of texts carried to the occupations."""
    long = "x" * 60
    texts = ["  center for claims", "center", "   ", "", "nan", long + "b web", long + "a legal", long + "c tutor", "Desk; help", "entry", long, "budget " * 9, "Budget", None, "relations", long + "a legal"]
    rng, pairs = random.Random(5), [(f"11-{k // 6:04d}", k % len(texts)) for k in range(600)]
    pairs += [(f"12-{k:04d}", rng.randrange(len(texts))) for k in range(120) for _ in range(rng.randrange(6))] + [(None, 3), ("13-0001", None)]
    socs = spark.createDataFrame(pairs, "soc string, doc_id long")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "audit loan"), (None, "web")], "doc_id long, task string")
    own = F.slice(F.array_sort(F.collect_set("task")), 1, 3)
    carried = socs.where("soc IS NOT NULL").join(docs.where("task IS NOT NULL"), "doc_id").groupBy(text.code_prefix(F.col("soc")).alias("soc_base")).agg(text.sentence_join(own, 3).alias("example_tasks"))
    titles = spark.createDataFrame([("call", "Public"), ("a help", "data"), ("x", None), ("insurance", "call"), (None, "help")], "title string, job_family string")
    marks = labor.example_marks(socs, docs)
    found = []
    for features in (carried, marks):
        rows = features.crossJoin(titles)
        found.append(sorted(map(str, rows.select("soc_base", "title", "job_family", labor.business_domain(rows).alias("d")).collect())))
    assert found[0] == found[1] and len(found[0]) > 900
    assert len({r.split("d=")[1] for r in found[0]}) >= 6


def test_labor(spark):
    t = {k: v.frame(spark) for k, v in exposure.JOBS.items()}
    features = labor.task_features(t["tasks"], t["penetration"], t["shares"], t["modes"]).cache()
    code = features.where("soc_base = '15-1252'").first()
    assert code.task_count == 2 and code.mean_task_penetration == pytest.approx(0.9) and code.directive_share == pytest.approx(0.4)
    scored = exposure.scored_jobs(spark).cache()
    rows = {r.title: r for r in scored.collect()}
    assert len(rows) == len(exposure.JOBS["jobs"].rows)
    for r in rows.values():
        assert all(0 <= r[c] <= 100 for c in ("substitution_pressure_index", "augmentation_index", "human_bottleneck_index", "full_job_automation_feasibility_index", "near_term_disruption_index"))
        assert r.scenario_2y_task_share_base <= r.scenario_5y_task_share_base <= r.scenario_10y_task_share_base <= 0.92
    assert rows["Data Entry Keyers"].dominant_outcome == "replacement_candidate"
    assert len({r.dominant_outcome for r in rows.values()}) >= 2
    assert rows["Lawyers"].bls_employment == 731340.0 and rows["Data Entry Keyers"].bls_employment == 18500000.0  # by title, by family
    assert {r.risk_label for r in rows.values()} <= set(labor.RISKS[1])
    domains = {r.business_domain: r for r in labor.domain_pressure(scored).collect()}
    worst = max(rows.values(), key=lambda r: r.near_term_disruption_index)
    assert set(domains) == set(labor.DOMAIN_WORDS)
    empty = [d for d in domains.values() if d.example_occupations == worst.title and d.occupation_count == 1]
    assert empty and all(d.disruption_index == pytest.approx(worst.near_term_disruption_index) for d in empty)
    assert {r["grouping"] for r in labor.market_summary(scored).collect()} == {"job_family", "dominant_outcome", "risk_label"}
    groups = labor.cluster_profiles(scored, families.cluster_label, k=3).collect()
    assert sum(g.n for g in groups) == len(rows) and all(g.cluster_label for g in groups)
    members = sorted(t for g in groups for t in g.examples.split("; "))
    assert members == sorted(rows) and sum(g.job_forecast_sum or 0 for g in groups) == sum(r.job_forecast or 0 for r in rows.values())
    alone = [g for g in groups if g.n == 1]
    assert all(g.median_salary_median == rows[g.examples].median_salary for g in alone)
    assert scored.select(families.cluster_label(lambda k: F.col(k)).alias("l")).count() == len(rows)


def test_forecasts_audits_findings(spark, scores):
    facts = spark.createDataFrame([(0.4, 0.05, 0.3, 30.0, 80.0, 0.4, 0.5)], "compute_slope double, context_slope double, price_slope double, gap double, top_score double, exposure double, pressure double")
    rows = {(r.scenario, r.horizon_years, r.metric): r for r in families.capability_forecasts(facts).collect()}
    assert len(rows) == 54
    assert rows["base", 10, "frontier_training_compute_multiplier"].value == 400.0 and rows["base", 10, "frontier_training_compute_multiplier"].capped
    assert rows["base", 2, "frontier_context_window_multiplier"].value == pytest.approx(10**0.16, abs=0.01)
    assert rows["base", 5, "frontier_output_price_factor"].value == 1.0  # prices that rise are assumed flat
    shares = families.leadership(scores, draws=500).cache()
    audit = families.leadership_audit(scores, shares).collect()
    assert {r.model_family for r in audit} == {"GPT", "Claude", "Gemini", "Qwen"} and all(r.audit_note for r in audit)
    gaps = spark.createDataFrame([("c", 10.0), ("d", None)], "category string, gap double")
    front = spark.createDataFrame([("m", True, 5.0), ("n", False, 9.0)], "model_id string, on_frontier boolean, index double")
    scored = exposure.scored_jobs(spark)
    found = families.counterintuitive(shares, gaps, front, scored, labor.market_summary(scored)).orderBy("place").collect()
    assert len(found) == 5 and found[1].evidence == "c 10.0" and found[2].evidence == "m" and found[3].evidence.startswith("Data Entry Keyers")
    one = scores.withColumn("direct_matches", F.lit(1)).withColumn("coverage_score", F.lit(90.0)).select("model_family", "direct_matches", "coverage_score")
    assert "few_direct_model_matches" in families.underobserved(scores, one).first().reasons
