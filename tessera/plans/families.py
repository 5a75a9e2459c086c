"""Composed pipelines on model catalogues (Z10, Z13-Z17, G20-G45, P4-P6): tables in, ranked and audited tables out.

Inputs are DataFrames with the columns named in each docstring; a reference date is an argument, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates, numeric, rules, text
from tessera.operators import aggregate as agg
from tessera.operators import joins, match, ranking, simulate, trend
from tessera.operators.skyline import skyline
from tessera.sources.readers import resolve

# Weights of the index and of its sensitivity sets, and of the simulation's scenarios by horizon.
COMPONENTS = {
    "performance_component": 0.31,
    "release_velocity_component": 0.16,
    "ecosystem_component": 0.17,
    "capability_surface_component": 0.17,
    "cost_efficiency_component": 0.11,
    "openness_component": 0.08,
}
SENSITIVITY = {
    "baseline": (0.31, 0.16, 0.17, 0.17, 0.11, 0.08),
    "no_ecosystem": (0.38, 0.19, 0.0, 0.21, 0.13, 0.09),
    "no_price": (0.35, 0.18, 0.19, 0.19, 0.0, 0.09),
    "equal_weight": (1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6),
}
LEADERSHIP = {
    "frontier_quality": {2: (0.46, 0.22, 0.07, 0.20, 0.02, 0.03), 5: (0.42, 0.20, 0.09, 0.21, 0.03, 0.05), 10: (0.38, 0.18, 0.11, 0.22, 0.04, 0.07)},
    "balanced_lab_execution": {2: (0.38, 0.22, 0.13, 0.18, 0.04, 0.05), 5: (0.34, 0.20, 0.15, 0.18, 0.06, 0.07), 10: (0.30, 0.18, 0.17, 0.18, 0.07, 0.10)},
    "open_ecosystem_upside": {2: (0.32, 0.18, 0.18, 0.15, 0.08, 0.09), 5: (0.28, 0.16, 0.21, 0.15, 0.09, 0.11), 10: (0.25, 0.14, 0.23, 0.14, 0.10, 0.14)},
}
#: Forecast multipliers of compute, context, price, adoption, gap; caps of compute and context.
FORECAST = {
    "conservative": (0.55, 0.45, 0.55, 0.55, 0.45, 80.0, 16.0),
    "base": (1.0, 1.0, 1.0, 1.0, 1.0, 400.0, 64.0),
    "aggressive": (1.45, 1.50, 1.35, 1.55, 1.35, 1200.0, 128.0),
}
# Labels of clusters and their bounds, the first that holds.
CLUSTER_RULES = (
    ("replacement-prone clerical/transaction work", lambda c: c("full_job_automation_feasibility_index") >= 18),
    ("augmentation-heavy expert work", lambda c: c("augmentation_index") >= c("substitution_pressure_index") + 8),
    ("trust/physical bottleneck work", lambda c: c("human_bottleneck_index") >= 22),
    ("technical analysis work", lambda c: (c("code_task_share") >= 0.08) | (c("analysis_task_share") >= 0.12)),
    ("coordination and management work", lambda c: c("agentic_task_share") >= 0.10),
)


def research_models(raw: DataFrame) -> DataFrame:
    """25 fields per research model, from columns found by alias in any case."""
    r = lambda *names: resolve(raw, names)
    name, org = text.clean_text(r("Model", "name")), text.clean_text(r("Organization", "org"))
    day, entity = dates.parse_date(r("Publication date", "date")), rules.classify_entity(name, org)
    return raw.select(
        F.concat(F.lit("epoch::"), text.slug(name)).alias("model_id"), name.alias("canonical_model"), entity["vendor"].alias("vendor"),
        entity["model_family"].alias("model_family"), entity["product_line"].alias("product_line"), entity["model_family"].alias("family"), org.alias("source_vendor"),
        day["date"].alias("release_date"), day["precision"].alias("release_precision"), text.clean_text(r("Domain")).alias("domain"), text.clean_text(r("Task")).alias("task"),
        r("Country (of organization)").alias("country"), text.safe_float(r("Parameters")).alias("parameters"), text.active_parameters(r("Parameters notes")).alias("active_parameters"),
        text.safe_float(r("Training compute (FLOP)")).alias("training_compute_flop"), text.safe_float(r("Training dataset size (total)")).alias("training_tokens"),
        text.safe_float(r("Training compute cost (2023 USD)")).alias("training_compute_cost_2023_usd"), r("Model accessibility").alias("model_accessibility"), r("Open model weights?").alias("open_model_weights"),
        rules.classify_access(name, org, r("Model accessibility"), r("Open model weights?")).alias("access_class"), F.trim(F.coalesce(r("Frontier model"), F.lit(""))).alias("frontier_model"),
        r("Reference").alias("reference"), text.clean_text(r("Link", "Reference")).alias("source_url"), F.lit("research_models").alias("source_id"), r("Confidence").alias("confidence"),
    )


def _field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A nested field, or null where the schema hasn't got it."""
    node = df.schema
    for part in path.split("."):
        names = [f.name for f in getattr(node, "fields", [])]
        if part not in names:
            return F.lit(None).cast(kind)
        node = node[part].dataType
    return F.col(path)


def api_catalogue(items: DataFrame) -> DataFrame:
    """P5: 22 fields per catalogue item (id, name, created, context_length, top_provider, pricing, architecture)."""
    of = lambda path, kind="string": _field(items, path, kind)
    vendor = F.when(F.contains("id", F.lit("/")), F.substring_index("id", "/", 1)).otherwise(F.substring_index("name", ":", 1))
    name, day = F.coalesce("name", "id"), dates.epoch_date(F.col("created"))
    family = rules.family_of_model(name, F.col("id"), vendor)
    price = lambda c: text.price_per_million(of(f"pricing.{c}"))
    listed = lambda c: F.coalesce(F.array_join(of(f"architecture.{c}", "array<string>"), ","), F.lit(""))
    return items.select(
        F.concat(F.lit("openrouter::"), text.slug(F.col("id"))).alias("model_id"), F.col("id").alias("openrouter_id"), F.col("name").alias("canonical_model"),
        rules.canonical_vendor(vendor, name).alias("vendor"), vendor.alias("source_vendor"), family.alias("model_family"), family.alias("product_line"), family.alias("family"),
        day.alias("release_date"), F.when(F.col("created").isNotNull(), "timestamp").otherwise("missing").alias("release_precision"),
        F.col("context_length").cast("double").alias("context_window"), of("top_provider.max_completion_tokens", "long").cast("double").alias("max_output_tokens"),
        price("prompt").alias("input_usd_per_1m"), price("completion").alias("output_usd_per_1m"), price("input_cache_read").alias("cache_read_usd_per_1m"), price("input_cache_write").alias("cache_write_usd_per_1m"),
        of("architecture.modality").alias("modality"), listed("input_modalities").alias("input_modalities"), listed("output_modalities").alias("output_modalities"),
        rules.classify_access(name, vendor, F.lit("api"), F.lit("")).alias("access_class"), F.concat(F.lit("https://"), F.col("id")).alias("source_url"), F.lit("models_api").alias("source_id"),
    )


PRICING = ["model_id", "openrouter_id", "canonical_model", "vendor", "model_family", "product_line", "family", "context_window", "input_usd_per_1m", "output_usd_per_1m", "cache_read_usd_per_1m", "cache_write_usd_per_1m", "source_url"]


def pricing(catalogue: DataFrame) -> DataFrame:
    """P5: the 13 pricing fields of the catalogue."""
    return catalogue.select(*PRICING)


def hub_models(items: DataFrame, collection: str) -> DataFrame:
    """26 fields per hub model (id, author, tags, downloads, likes, cardData and more, where there)."""
    of = lambda path, kind="string": _field(items, path, kind)
    author = F.coalesce(F.nullif(text.clean_text(of("author")), F.lit("")), F.substring_index("id", "/", 1))
    tags, entity = F.coalesce("tags", F.array().cast("array<string>")), rules.classify_entity(F.col("id"), author)
    listed = lambda c: F.coalesce(F.array_join(of(f"cardData.{c}", "array<string>"), ","), F.lit(""))
    plain = lambda c: text.clean_text(of(c).cast("string"))
    license_ = text.hub_license(tags, of("cardData.license", "array<string>"))
    return items.select(
        "id", author.alias("author"), F.lit(collection).alias("collection"), entity["vendor"].alias("vendor"), entity["model_family"].alias("model_family"), entity["product_line"].alias("product_line"),
        entity["model_family"].alias("family"), rules.classify_access(F.col("id"), author, F.lit(""), license_).alias("access_class"), F.col("downloads").cast("double").alias("downloads"), F.col("likes").cast("double").alias("likes"),
        plain("pipeline_tag").alias("pipeline_tag"), plain("library_name").alias("library_name"), plain("createdAt").alias("created_at"), plain("lastModified").alias("last_modified"),
        of("private", "boolean").alias("private"), of("gated", "boolean").alias("gated"), of("disabled", "boolean").alias("disabled"), plain("sha").alias("sha"), license_.alias("license"),
        plain("cardData.base_model").alias("base_model"), listed("language").alias("language"), listed("datasets").alias("datasets"), F.size(tags).alias("tags_count"),
        text.inferred_parameters(F.col("id")).alias("parameters"), F.concat(F.lit("https://"), F.col("id")).alias("source_url"), F.lit("hub_models_api").alias("source_id"),
    )


def file_rollup(models: DataFrame, files: DataFrame) -> DataFrame:
    """Models with counts and bytes of their files, 0 without any."""
    weight = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1).isin("safetensors", "bin", "gguf", "pt")
    rolled = files.groupBy("id").agg(F.count(F.lit(1)).alias("file_count"), agg.sum0(F.col("size")).alias("total_bytes"), agg.sum0(weight.cast("long")).alias("weight_files"))
    return joins.left_fill(models, rolled, ["id"], ["file_count", "total_bytes", "weight_files"])


def components(features: DataFrame) -> DataFrame:
    """Six components, index, rank and evidence of families (features by family; missing ones may be null)."""
    zero_free = features.withColumn("output_price_min", F.nullif(F.col("output_price_min"), F.lit(0.0)))
    raw = {
        "_lm": ("lmarena_best", ""), "_swe": ("swebench_best", ""), "_llm": ("openllm_top_mean", ""), "_api": ("recent_api_releases", ""), "_ep": ("epoch_recent_releases", ""),
        "_dl": ("hf_downloads", "log"), "_gh": ("github_model_mentions", "log"), "_pa": ("openalex_paper_mentions", "log"), "_li": ("hf_likes", "log"),
        "_ctx": ("context_window_max", "log"), "_out": ("max_output_tokens", "log"), "_mm": ("multimodal_models", ""), "_cp": ("training_compute_max", "log"),
        "cost_efficiency_component": ("output_price_min", "log invert"), "_op": ("open_api_models", ""),
    }
    c = F.col
    scaled = numeric.minmax(zero_free, raw)
    share = F.coalesce(c("hf_open_weight_share"), F.lit(0.0)) * 55 + F.coalesce(c("open_weight_epoch_share"), F.lit(0.0)) * 35 + c("_op") * 0.10
    built = (
        scaled.withColumn("performance_component", c("_lm") * 0.45 + c("_swe") * 0.30 + c("_llm") * 0.25)
        .withColumn("release_velocity_component", c("_api") * 0.55 + c("_ep") * 0.45)
        .withColumn("ecosystem_component", c("_dl") * 0.40 + c("_gh") * 0.25 + c("_pa") * 0.25 + c("_li") * 0.10)
        .withColumn("capability_surface_component", c("_ctx") * 0.35 + c("_out") * 0.20 + c("_mm") * 0.20 + c("_cp") * 0.25)
        .withColumn("openness_component", numeric.clip(share, 0, 100))
        .withColumn("index", F.bround(numeric.weighted_index(COMPONENTS), 2))
    )
    return built.withColumn("rank", ranking.rank_min(c("index"))).drop(*(k for k in raw if k.startswith("_")))


def sensitivity(scores: DataFrame) -> DataFrame:
    """Index and rank per weight set."""
    sets = joins.scenarios(scores.sparkSession, {s: dict(zip(COMPONENTS, w)) for s, w in SENSITIVITY.items()})
    each = simulate.sensitivity(scores.drop("index", "rank"), sets, list(COMPONENTS)).withColumn("index", F.bround("index", 2))
    return each.withColumn("rank", ranking.rank_min(F.col("index"), "scenario"))


def vendor_scores(scores: DataFrame) -> DataFrame:
    """0.65 of the best family and 0.35 of the evidence-weighted mean, per vendor."""
    w = numeric.clip(F.coalesce(F.col("evidence_count"), F.lit(0)).cast("double"), 1)
    mix = F.max("index") * 0.65 + agg.weighted_mean(F.col("index"), w) * 0.35
    by = joins.with_lookup(scores, "model_family", rules.FAMILY_VENDOR, "vendor", F.col("model_family")).groupBy("vendor").agg(
        F.max_by("model_family", "index").alias("flagship_family"), agg.sorted_join(F.col("model_family"), sep=", ").alias("portfolio_families"),
        F.count(F.lit(1)).alias("family_count"), F.bround(mix, 2).alias("score"),
    )
    return by.withColumn("rank", ranking.rank_min(F.col("score")))


def open_closed_gap(board: DataFrame) -> DataFrame:
    """Best closed and open rating per category, gap and share (category, access_class, rating)."""
    bucket = F.when(F.col("access_class").isin("open_weight", "likely_open_weight"), "open_weight").otherwise("closed_or_api")
    by = board.withColumn("bucket", bucket).groupBy("category").pivot("bucket", ["closed_or_api", "open_weight"]).agg(F.max("rating"))
    gap = F.col("closed_or_api") - F.col("open_weight")
    return by.withColumn("gap", gap).withColumn("gap_share", F.coalesce(F.try_divide(gap, F.col("closed_or_api")), F.lit(0.0)))


def category_leaders(board: DataFrame, top: int = 1) -> DataFrame:
    """Leading model of each category and access class."""
    w = Window.partitionBy("category", "access_class").orderBy(F.desc_nulls_last("rating"), "model_name")
    return board.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def price_performance(models: DataFrame, direct: bool) -> DataFrame:
    """Blended price, index and frontier (model_id, rating, context_window, input/output prices)."""
    a, b, c = (0.76, 0.12, 0.12) if direct else (0.70, 0.15, 0.15)
    priced = models.withColumn("price", numeric.price_blend(F.col("input_usd_per_1m"), F.col("output_usd_per_1m")))
    scaled = numeric.minmax(priced, {"_r": ("rating", ""), "_p": ("price", "log invert"), "_c": ("context_window", "log")})
    front = skyline(priced.where("price > 0"), "rating", "price").select("model_id").withColumn("on_frontier", F.lit(True))
    out = scaled.withColumn("index", F.bround(F.col("_r") * a + F.col("_p") * b + F.col("_c") * c, 2)).drop("_r", "_p", "_c")
    return out.join(front, "model_id", "left").withColumn("on_frontier", F.coalesce("on_frontier", F.lit(False)))


def best_rows(board: DataFrame, source: str, metric: str, name: str, model_id: str, score: str, family: Column, category: Column, url: Column) -> DataFrame:
    """Candidates of a source that has one number per row: the best row of each model."""
    rows = board.where(F.col(name).isNotNull()).select(
        F.lit(source).alias("benchmark_source"), F.col(name).alias("name"), F.col(model_id).cast("string").alias("model_id"), family.alias("family"), numeric.to_number(F.col(score)).alias("benchmark_score"),
        F.lit(metric).alias("benchmark_metric"), category.alias("benchmark_category"), numeric.to_number(F.col(score)).alias("sort_score"), url.alias("source_url"),
    )
    return ranking.first_per_group(rows, ["name"], F.desc_nulls_last("sort_score"), "model_id")


def mean_rows(board: DataFrame, source: str, metric: str, name: str, model_id: str, score: str, family: Column, label: str, url: Column) -> DataFrame:
    """Candidates of a source with many numbers per model: their mean, ordered by the best; up to four labels."""
    rows = board.where(F.col(name).isNotNull()).withColumn("__family", family).withColumn("__url", url).withColumn("__score", numeric.to_number(F.col(score)))
    return rows.groupBy(F.col(name).alias("name"), F.col(model_id).cast("string").alias("model_id")).agg(
        F.lit(source).alias("benchmark_source"), F.min("__family").alias("family"), F.avg("__score").alias("benchmark_score"), F.lit(metric).alias("benchmark_metric"),
        text.sentence_join(F.array_sort(F.collect_set(text.clean_text(F.col(label)))), 4).alias("benchmark_category"), F.max("__score").alias("sort_score"), F.min("__url").alias("source_url"),
    )


def match_audit(catalogue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every catalogue model against every benchmark source: 17 columns with the tier of its best match.

    candidates: benchmark_source, name, model_id, family, sort_score, benchmark_score, benchmark_metric,
    benchmark_category, source_url. Candidates of a source are in the order of their names: the first one with the name
    or an alias is taken; the score decides among those of a family only. Sources are a few; models meet candidates by
    key only.
    """
    sources = candidates.select("benchmark_source").distinct()
    mark = lambda c: F.concat_ws("\x01", "benchmark_source", c)
    forms = lambda name, mid, family: F.transform(
        F.filter(rules.alias_set(name, mid, family), lambda a: a != rules.normalized_model(family)), lambda a: F.concat_ws("\x01", "benchmark_source", a)
    )
    asked = catalogue.crossJoin(F.broadcast(sources)).select(
        F.struct("openrouter_id", "benchmark_source").alias("id"), "canonical_model", "vendor", "model_family", mark("canonical_model").alias("name"), mark("openrouter_id").alias("model_id"), mark("model_family").alias("family"),
        forms(F.col("canonical_model"), F.col("openrouter_id"), F.col("model_family")).alias("aliases"),
    )
    known = candidates.withColumn("ord", F.struct("name", "model_id", "benchmark_source"))
    known = known.withColumns({"__name": F.col("name"), "__family": F.col("family"), "aliases": forms(F.col("name"), F.col("model_id"), F.col("family"))})
    known = known.withColumns({"name": mark("name"), "family": mark("family")})
    found = match.tiered_match(asked, known).join(asked.select("id", "canonical_model", "vendor", "model_family"), "id")
    bare = lambda c: F.substring_index(c, "\x01", -1)
    r = lambda c: F.coalesce(F.col(f"record.{c}"), F.lit(""))
    return found.select(
        F.col("id.openrouter_id").alias("openrouter_id"), "canonical_model", "vendor", "model_family", F.col("id.benchmark_source").alias("benchmark_source"), r("__name").alias("benchmark_model_name"),
        r("__family").alias("benchmark_family"), "match_confidence", "match_rank", F.coalesce(bare("match_key"), F.lit("")).alias("match_key"), F.col("direct").alias("direct_model_match"), F.col("record.benchmark_score").alias("benchmark_score"),
        r("benchmark_metric").alias("benchmark_metric"), r("benchmark_category").alias("benchmark_category"), r("source_url").alias("benchmark_source_url"),
        rules.normalized_model(F.col("canonical_model")).alias("normalized_openrouter_name"), rules.normalized_model(r("__name")).alias("normalized_benchmark_name"),
    )


def family_coverage(scores: DataFrame, catalogue: DataFrame, audit: DataFrame) -> DataFrame:
    """Per scored family, coverage of four fields of its catalogue models and of its matches, their mean and the gaps.

    scores: model_family, lmarena_models (models of the family on the leaderboard), api_model_count; absent ones are 0.
    A part that is 0 is a gap.
    """
    c, zero = F.col, F.lit(0.0)
    fields = {
        "price_coverage": agg.field_coverage(c("input_usd_per_1m"), c("output_usd_per_1m"), positive=True), "release_date_coverage": agg.field_coverage(c("release_date")),
        "access_class_coverage": agg.field_coverage(c("access_class")), "context_window_coverage": agg.field_coverage(c("context_window"), positive=True),
    }
    base = catalogue.groupBy("model_family").agg(*(F.bround(v, 4).alias(k) for k, v in fields.items()))
    direct = audit.where("direct_model_match").groupBy("model_family").agg(F.count(F.lit(1)).alias("direct_benchmark_match_count"))
    count = lambda name: F.coalesce(resolve(scores, [name], "double").cast("long"), F.lit(0))
    families = scores.select("model_family", count("api_model_count").alias("api_model_count"), count("lmarena_models").alias("family_proxy_benchmark_count"))
    out = joins.left_fill(joins.left_fill(families, base, ["model_family"], list(fields)), direct, ["model_family"], ["direct_benchmark_match_count"])
    parts = [c(k) for k in fields] + [F.least(F.lit(1.0), c("direct_benchmark_match_count") / 3), F.least(F.lit(1.0), c("family_proxy_benchmark_count") / 5)]
    gaps = sum(((p <= zero).cast("int") for p in parts), F.lit(0))
    out = joins.with_lookup(out, "model_family", rules.FAMILY_VENDOR, "vendor", F.col("model_family")).withColumn("labor_signal_coverage", F.lit(1.0))
    return out.withColumn("source_gap_count", gaps).withColumn("coverage_score", F.bround(sum(parts, zero) / len(parts) * 100, 2))


def releases(research: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct dated releases of known families in both sources: release_date, model_family, vendor, product_line, model_name, release_type.

    The type is open_weight by the access class, else api_catalog or research_metadata by the source.
    """
    c = F.col

    def of(df: DataFrame, opened: Column, other: str) -> DataFrame:
        kind = F.when(F.coalesce(opened, F.lit(False)), "open_weight").otherwise(F.lit(other))
        named = F.coalesce(F.nullif(text.clean_text(c("vendor")), F.lit("")), F.lit("Unknown"))
        rows = joins.with_lookup(df.withColumn("__vendor", named), "model_family", rules.FAMILY_VENDOR, "__mapped", c("__vendor"))
        line = F.coalesce(F.nullif(text.clean_text(c("product_line")), F.lit("")), c("model_family"))
        return rows.where(c("release_date").isNotNull() & c("model_family").isin(*rules.FAMILY_VENDOR)).select(
            c("release_date").cast("date").alias("release_date"), "model_family", c("__mapped").alias("vendor"), line.alias("product_line"), c("canonical_model").alias("model_name"), kind.alias("release_type")
        )

    access = F.lower(text.clean_text(c("access_class")))
    return of(catalogue, F.startswith(access, F.lit("open")), "api_catalog").unionByName(of(research, F.contains(access, F.lit("open")), "research_metadata")).distinct()


def release_cadence(research: DataFrame, catalogue: DataFrame, by: str, reference: str) -> DataFrame:
    """Cadence over distinct dated releases, with the mix of release types (most frequent first) and, by vendor, its families."""
    every = releases(research, catalogue)
    mix = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "release_type", "count"))), lambda x: F.concat_ws(":", x["release_type"], x["count"]))  # three types
    counts = every.groupBy(by, "release_type").count().groupBy(by).agg(F.array_join(mix, ",").alias("source_mix"))
    out = ranking.cadence(every, [by], F.col("release_date"), reference).join(counts, by)
    if by == "vendor":
        return out.join(every.groupBy("vendor").agg(agg.sorted_join(F.col("model_family")).alias("portfolio_families")), "vendor")
    return out.join(every.groupBy(by).agg(F.min("vendor").alias("vendor")), by)


def underobserved(scores: DataFrame, coverage: DataFrame) -> DataFrame:
    """Families with thin evidence and why."""
    middle = scores.agg(F.median("evidence_count").alias("middle"))
    direct = resolve(coverage, ["direct_benchmark_match_count", "direct_matches"], "long").alias("direct_matches")
    rows = scores.join(coverage.select("model_family", direct, "coverage_score"), "model_family", "left").crossJoin(F.broadcast(middle))
    why = agg.reasons(few_direct_model_matches=F.coalesce("direct_matches", F.lit(0)) < 2, low_source_coverage=F.coalesce("coverage_score", F.lit(0.0)) < 60, below_median_evidence_depth=F.col("evidence_count") < F.col("middle"))
    return rows.select("model_family", "evidence_count", "direct_matches", "coverage_score", why.alias("reasons"), (why != "none").alias("underobserved"))


def leadership(scores: DataFrame, draws: int = 6000) -> DataFrame:
    """Z3 with the fixed scenarios."""
    plan = [(s, h, list(w)) for s, by in LEADERSHIP.items() for h, w in by.items()]
    return simulate.leadership(scores.select("model_family", *COMPONENTS), "model_family", list(COMPONENTS), plan, draws)


def rank_intervals(scores: DataFrame, draws: int = 700) -> DataFrame:
    """Bootstrap intervals and a stability label beside the current rank."""
    drawn = simulate.bootstrap_ranks(scores.select("model_family", "evidence_count", *COMPONENTS), "model_family", list(COMPONENTS), list(COMPONENTS.values()), "evidence_count", draws)
    return drawn.join(scores.select("model_family", F.col("rank").alias("current_rank")), "model_family", "left")


# Families of the leadership audit and its notes; names that make a key model.
AUDITED = ["GPT", "Qwen", "Claude", "Gemini", "Mistral", "DeepSeek", "Llama", "Grok"]
AUDIT_NOTES = {
    "Mistral": "Strong openness/cost, but current performance and release-velocity signals are below GPT/Qwen/Claude/Gemini; should not be called raw frontier leader from this dataset.",
    "Qwen": "Strong open ecosystem and good performance; credible upside, especially under open-distribution scenarios.",
    "GPT": "Strongest current composite and release velocity; remains top frontier-quality prior in this dataset.",
    "Claude": "Strong benchmark/coding signal but lower release breadth and ecosystem pull in this snapshot.",
    "Gemini": "Strong benchmark breadth and ecosystem signal; weaker openness/cost signal.",
}
OTHER_NOTE = "Interpret with caution; public signals are incomplete and component-dependent."
KEY_MODELS = ["gpt-5.5", "gpt-5.5-pro", "claude-opus-4.7", "claude-opus-4.7-fast", "gpt-5", "claude-opus-4"]


def leadership_audit(scores: DataFrame, shares: DataFrame) -> DataFrame:
    """Components of the audited families beside their ten-year shares of wins, and a note."""
    ten = shares.where("horizon = 10").groupBy("model_family").pivot("scenario", ["frontier_quality", "open_ecosystem_upside"]).agg(F.max("win_share"))
    ten = ten.select("model_family", F.col("frontier_quality").alias("frontier_quality_10y_probability"), F.col("open_ecosystem_upside").alias("open_ecosystem_10y_probability"))
    rows = scores.where(F.col("model_family").isin(*AUDITED)).select("model_family", "index", F.col("rank").alias("current_rank"), *COMPONENTS).join(ten, "model_family", "left")
    return joins.with_lookup(rows, "model_family", AUDIT_NOTES, "audit_note", OTHER_NOTE).orderBy(F.desc_nulls_last("frontier_quality_10y_probability"), "model_family")


def key_models(catalogue: DataFrame, urls: dict[str, str]) -> DataFrame:
    """Catalogue models whose id holds a key name, with the release page of the first such name."""
    first = F.get(F.filter(F.array(*(F.lit(w) for w in KEY_MODELS)), lambda w: F.contains(F.col("openrouter_id"), w)), F.lit(0))
    rows = catalogue.withColumn("__key", first).where("__key IS NOT NULL")
    rows = joins.with_lookup(rows, "__key", urls, "release_url", F.col("source_url")) if urls else rows.withColumn("release_url", F.col("source_url"))
    columns = ["openrouter_id", "vendor", "model_family", "release_date", "context_window", "input_usd_per_1m", "output_usd_per_1m"]
    out = rows.select(F.col("canonical_model").alias("model"), *columns, F.col("release_url").alias("source_url"), F.col("source_url").alias("secondary_source_url"))
    return out.orderBy("vendor", "release_date", "model")


def counterintuitive(shares: DataFrame, gaps: DataFrame, frontier: DataFrame, jobs: DataFrame, labor_groups: DataFrame) -> DataFrame:
    """Five findings with formatted evidence, each from the leader of a table."""
    top = lambda df, *order: df.orderBy(*order).limit(1)
    lead = lambda s: top(shares.where((F.col("scenario") == s) & (F.col("horizon") == 10)), F.desc("win_share"), "model_family")
    named = F.concat(F.col("model_family"), F.lit(" "), text.format_share(F.col("win_share")))
    weight = lambda g: F.coalesce(F.sum(F.when((F.col("grouping") == "dominant_outcome") & (F.col("group") == g), F.col("labor_weight_sum"))), F.lit(0.0))
    two = lead("frontier_quality").select(named.alias("a")).crossJoin(lead("open_ecosystem_upside").select(named.alias("b")))
    cheap = frontier.where("on_frontier").orderBy(F.desc("index"), "model_id").limit(3).agg(F.array_join(F.array_sort(F.collect_list("model_id")), "; ").alias("e"))
    rows = [
        ("leadership and open distribution are different questions", two.select(F.concat_ws(" against ", "a", "b").alias("e"))),
        ("the gap of open and closed differs by category", top(gaps.where("gap IS NOT NULL"), F.desc("gap"), "category").select(F.format_string("%s %.1f", "category", "gap").alias("e"))),
        ("cheap models can be efficient without being best", cheap),
        ("whole jobs are narrower than touched tasks", top(jobs, F.desc("full_job_automation_feasibility_index"), "title").select(F.format_string("%s %.1f", "title", "full_job_automation_feasibility_index").alias("e"))),
        ("augmentation can weigh more than replacement", labor_groups.agg(F.format_string("%s against %s", text.format_number(weight("augmentation_first"), 0), text.format_number(weight("replacement_candidate"), 0)).alias("e"))),
    ]
    out = None
    for k, (finding, row) in enumerate(rows, 1):
        row = row.select(F.lit(k).alias("place"), F.lit(finding).alias("finding"), F.col("e").alias("evidence"))
        out = row if out is None else out.unionByName(row)
    return out


def capability_forecasts(facts: DataFrame) -> DataFrame:
    """Six metrics for each scenario and horizon, from one row of facts.

    facts: compute_slope, context_slope, price_slope (log10 a year), gap, top_score, exposure, pressure.
    """
    c = F.col
    names = ("compute", "context", "price", "adoption", "gap", "compute_cap", "context_cap")
    plan = joins.scenarios(facts.sparkSession, {s: dict(zip(names, m)) for s, m in FORECAST.items()})
    plan = plan.crossJoin(facts.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x).cast("long") for x in (2, 5, 10)))).alias("horizon_years")))
    rows, h = plan.crossJoin(F.broadcast(facts)), c("horizon_years")
    compute, compute_hit = numeric.capped_growth(F.pow(F.lit(10.0), F.greatest(c("compute_slope"), F.lit(0.12)) * h * c("w_compute")), c("w_compute_cap"))
    context, context_hit = numeric.capped_growth(F.pow(F.lit(10.0), F.greatest(c("context_slope"), F.lit(0.08)) * h * c("w_context")), c("w_context_cap"))
    price = F.greatest(F.lit(0.05), F.pow(F.lit(10.0), F.least(c("price_slope"), F.lit(0.0)) * h * c("w_price")))
    left = F.greatest(F.lit(0.0), c("gap") * (1 - F.least(F.lit(0.92), 0.12 * h * c("w_gap"))))
    touched = F.least(F.lit(0.88), (c("exposure") * 0.24 + c("pressure") * 0.18) * F.pow(h, F.lit(0.62)) * c("w_adoption"))
    first = F.least(F.lit(0.95), c("top_score") / 100 + 0.03 * h * (c("w_compute") - 0.7))
    none = F.lit(None).cast("boolean")
    metrics = (
        # Names and units of the published table.
        ("frontier_training_compute_multiplier", compute, 2, compute_hit, "x current frontier trend"), ("frontier_context_window_multiplier", context, 2, context_hit, "x current API catalog trend"),
        ("frontier_output_price_factor", price, 4, none, "fraction of current low-price frontier API output cost"), ("open_weight_lmarena_gap_remaining", left, 1, none, "arena rating points"),
        ("share_of_us_occupation_tasks_materially_touched", touched, 3, none, "share of task-weighted occupation activity"), ("leading_lab_concentration", first, 3, none, "index, 1 means winner-take-most frontier"),
    )
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.bround(v.cast("double"), d).alias("value"), F.lit(u).alias("unit"), hit.alias("capped")) for n, v, d, hit, u in metrics))
    return rows.select("scenario", "horizon_years", (h + 2026).alias("target_year"), F.inline(each))


def frontier_history(series: dict[str, tuple[DataFrame, str, str, float]]) -> DataFrame:
    """(series, year, value) of yearly quantiles; series by name: table, day, value, quantile."""
    out = None
    for name, (df, day, value, q) in series.items():
        one = trend.yearly_quantile(df, day, value, q).select(F.lit(name).alias("series"), "year", "value")
        out = one if out is None else out.unionByName(one)
    return out


def forecast_diagnostics(series: dict[str, tuple[DataFrame, str, str, float]]) -> DataFrame:
    """Years used, first and last year and slope of each series."""
    n = F.count(F.lit(1))
    slope = F.when(n >= 3, F.regr_slope(F.log10("value"), F.col("year").cast("double"))).otherwise(F.lit(0.0))
    years = {"years_used": n, "fit_start_year": F.min("year").cast("long"), "fit_end_year": F.max("year").cast("long"), "raw_log10_slope_per_year": slope}
    return frontier_history(series).groupBy("series").agg(*(v.alias(k) for k, v in years.items()))


def cluster_label(of=F.col) -> Column:
    """The first rule that holds for a cluster's means."""
    case = None
    for name, test in CLUSTER_RULES:
        case = (F if case is None else case).when(F.coalesce(test(of), F.lit(False)), F.lit(name))
    return case.otherwise(F.lit("mixed redesign work"))


def transparency(models: DataFrame, fields: list[str], key: str = "vendor", since: int = 2020) -> DataFrame:
    """Mean share of known fields per vendor with at least two models since a year."""
    recent = models.where(F.year("release_date") >= since)
    shares = {f: F.avg(F.col(f).isNotNull().cast("double")) for f in fields}
    by = recent.groupBy(key).agg(F.count(F.lit(1)).alias("models"), *(s.alias(f) for f, s in shares.items())).where("models >= 2")
    return by.withColumn("transparency_index", F.bround(numeric.row_mean(*(F.col(f) for f in fields)) * 100, 2))


def instance_outcomes(submissions: DataFrame, instances: DataFrame) -> DataFrame:
    """Every submission against every instance with exclusive flags (submission; resolved, no_generation, no_logs arrays)."""
    rows = submissions.crossJoin(F.broadcast(instances.select("instance_id").distinct()))
    flag = {c: F.coalesce(F.array_contains(c, F.col("instance_id")), F.lit(False)) for c in ("resolved", "no_generation", "no_logs")}
    none = ~flag["resolved"] & ~flag["no_generation"] & ~flag["no_logs"]
    return rows.select("submission", "instance_id", F.substring_index("instance_id", "-", 1).alias("repo"), *(c.alias(k) for k, c in flag.items()), none.alias("unresolved_or_not_listed"))


def unified_index(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Entities of sources with different columns, ids by namespace."""
    out = None
    for namespace, df in parts:
        one = df.withColumn("entity_id", F.concat(F.lit(namespace + "::"), text.slug(F.col("name")))).withColumn("source_namespace", F.lit(namespace))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
