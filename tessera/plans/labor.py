"""Job exposure scoring (Z12, G12-G14, G25, G28, J2-J6): occupations with wages, employment and tasks; indexes and labels.

Inputs, as the source files name their columns: jobs (occ_code, title, observed_exposure); wages (SOCcode, JobName,
JobFamily, MedianSalary, JobForecast, ChanceAuto, JobZone, isBright, isGreen); employment (title and number, by place);
tasks (soc, task); penetration (task, penetration); shares (task_name, pct); modes (task_name and six shares).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric, text
from tessera.operators import aggregate as agg
from tessera.operators import cluster, placing
from tessera.sources.scratch import settled

# Words whose substrings mark tasks, brakes and business domains.
TASK_WORDS = {
    "language": ["write", "draft", "document", "report", "summar", "translate", "edit", "email", "communicat"],
    "code": ["code", "software", "program", "debug", "database", "script", "algorithm", "application"],
    "analysis": ["analy", "forecast", "model", "statistic", "research", "evaluate", "calculate", "financial"],
    "visual": ["image", "video", "design", "graphic", "drawing", "visual", "photograph", "layout"],
    "agentic": ["plan", "schedule", "coordinate", "monitor", "prepare", "recommend", "decide", "organize"],
}
BRAKE_WORDS = {
    "physical": ["repair", "install", "operate", "drive", "lift", "clean", "cook", "weld", "inspect equipment", "manual"],
    "human_trust": ["teach", "counsel", "negotiate", "care", "nurse", "patient", "child", "therapy", "supervise"],
    "regulated": ["legal", "medical", "safety", "compliance", "license", "court", "diagnos", "prescribe"],
}
DOMAIN_WORDS = {
    "software_engineering": ["software", "developer", "program", "code", "web", "database", "systems", "qa", "computer"],
    "customer_support": ["customer", "support", "service", "call center", "reception", "client", "help desk"],
    "legal_compliance": ["legal", "law", "compliance", "paralegal", "contract", "claims", "insurance"],
    "marketing_content": ["marketing", "writer", "editor", "content", "public relations", "advertising", "media"],
    "finance_analysis": ["financial", "account", "analyst", "bookkeeping", "budget", "credit", "loan", "actuar"],
    "healthcare_administration": ["medical records", "health information", "billing", "healthcare", "clinic", "hospital", "insurance"],
    "education": ["teacher", "instruction", "tutor", "education", "training", "library"],
    "operations_back_office": ["office", "administrative", "clerical", "operations", "logistics", "coordinator", "data entry"],
}


MODES = ("directive", "feedback_loop", "task_iteration", "validation", "learning", "filtered")
# Weights of the indexes, bounds and names of outcomes and risks.
OUTCOMES = (("replacement_candidate", 35), ("augmentation_first", 1.15), ("bottleneck_protected", 25))
RISKS = ([-1, 20, 40, 60, 80, 101], ["low", "moderate", "high", "very_high", "extreme"])
PRESSURES = ([-1, 25, 45, 65, 101], ["low", "moderate", "high", "very_high"])
SHARES = {2: (0.16, 0.22), 5: (0.34, 0.39), 10: (0.56, 0.58)}


def wage_rollup(wages: DataFrame) -> DataFrame:
    """One row per base code: best measures, the first family, the first two names by code.

    Among equal codes the family of the smallest ``line`` is first, as a reader in order finds it; by name without that column.
    """
    first = F.struct("SOCcode", *(["line"] if "line" in wages.columns else []), "JobFamily")
    names = F.transform(F.array_sort(F.collect_list(F.struct("SOCcode", "JobName"))), lambda x: x["JobName"])
    return wages.groupBy(text.code_prefix(F.col("SOCcode")).alias("soc_base")).agg(
        F.max("MedianSalary").alias("median_salary"), F.max("JobForecast").alias("job_forecast"), F.max("ChanceAuto").alias("chance_auto"),
        F.max("JobZone").alias("job_zone"), text.sentence_join(names, 2).alias("wage_job_name"), agg.first_by(F.col("JobFamily"), first).alias("job_family"),
        F.max("isBright").alias("bright_outlook"), F.max("isGreen").alias("green_job"),
    )


def with_employment(jobs: DataFrame, employment: DataFrame) -> DataFrame:
    """Employment by title, else that of the job's family; titles that repeat are reduced to their largest number."""
    named = numeric.named_by_place(employment, "bls_title", "bls_employment")
    bare = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit("nan"))), "[^a-z0-9]+", " "))
    by = lambda key, name: named.groupBy(key.alias("__k")).agg(F.max("bls_employment").alias(name))
    out = jobs.withColumn("__k", bare(F.col("title"))).join(by(bare(F.col("bls_title")), "__own"), "__k", "left").drop("__k")
    group = by(text.title_key(F.col("bls_title")), "bls_major_group_employment")
    out = out.withColumn("__k", bare(F.col("job_family"))).join(group, "__k", "left").drop("__k")
    return out.withColumn("bls_employment", F.coalesce("__own", "bls_major_group_employment")).drop("__own")


def text_features(texts: DataFrame, penetration: DataFrame, shares: DataFrame, modes: DataFrame) -> DataFrame:
    """``texts`` with what is known of each ``task``: penetration, share, modes and keyword scores.

    The three lookups are by lower-case text of the task; each is reduced to one row per text before the join. Texts meet by
    their MD5 and are scored where they are read, so none is shuffled unless what follows reads ``task``.
    """
    key = lambda c: F.coalesce(F.md5(F.lower(F.trim(c)).cast("binary")), F.lit(""))  # noqa: E731, "": no text, met by no task
    one = lambda df, c, *values: df.groupBy(key(c).alias("__key")).agg(*(F.avg(v).alias(v) for v in values))
    score = {f"{k}_task_share": text.keyword_score(F.col("task"), w) for k, w in TASK_WORDS.items()}
    score |= {f"{k}_bottleneck": text.keyword_score(F.col("task"), w) for k, w in BRAKE_WORDS.items()}
    rows = texts.where("task IS NOT NULL").withColumn("__key", key("task")).withColumns(score)
    rows = rows.join(one(penetration, "task", "penetration"), "__key", "left").join(one(shares, "task_name", "pct"), "__key", "left").join(one(modes, "task_name", *MODES), "__key", "left")
    return rows.drop("__key")


def rolled_features(rows: DataFrame) -> DataFrame:
    """Per base code of ``soc``, means over its tasks of the columns of text_features(), and example tasks."""
    own = [f"{k}_task_share" for k in TASK_WORDS] + [f"{k}_bottleneck" for k in BRAKE_WORDS]
    return rows.where("soc IS NOT NULL").groupBy(text.code_prefix(F.col("soc")).alias("soc_base")).agg(
        F.count(F.lit(1)).alias("task_count"), F.avg("penetration").alias("mean_task_penetration"), F.avg("pct").alias("mean_aei_task_pct"),
        *(F.avg(m).alias(f"{m}_share") for m in MODES), *(F.avg(c).alias(c) for c in own),
        text.sentence_join(F.slice(F.array_sort(F.collect_set("task")), 1, 3), 3).alias("example_tasks"),
    )


#: Characters by which texts are ordered first; those that share them are placed by the whole text.
LEAD = 48
#: A keyword that begins before a text ends within so many of its characters.
REACH = max(len(w) for words in DOMAIN_WORDS.values() for w in words) - 1


def example_marks(socs: DataFrame, texts: DataFrame) -> DataFrame:
    """What domain_pressure() needs of rolled_features()'s ``example_tasks``, without carrying texts to codes.

    ``socs`` (soc, doc_id), ``texts`` (doc_id, task). Per base code, of its first three different tasks in text order:
    ``example_hits``, the keywords in any of them (none reaches over the ``; `` between two), and ``example_head``, how the
    first that is not blank begins, as a keyword may begin in what stands before.
    """
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    texts = texts.where("task IS NOT NULL").withColumn("lead", F.substring("task", 1, LEAD))
    known = texts.select("doc_id", "lead", digest("task").alias("digest"), text.keyword_bits(F.col("task"), DOMAIN_WORDS).alias("bits"), F.substring(F.ltrim("task"), 1, REACH).alias("head"), (F.trim("task") == "").alias("blank"))
    known = settled(known, "task-marks")
    shared = known.groupBy("lead").agg((F.min("digest") < F.max("digest")).alias("shared")).where("shared").select("lead")
    placed = placing.place(texts.join(shared, "lead", "left_semi").select("task").distinct(), [F.asc("task")])
    placed = placed.select(digest("task").alias("digest"), "place")
    known = known.join(placed, "digest", "left").withColumn("order", F.struct("lead", F.coalesce("place", F.lit(0).cast("long")).alias("place")))
    rows = socs.where("soc IS NOT NULL").join(known.drop("digest", "lead", "place"), "doc_id").withColumn("soc_base", text.code_prefix(F.col("soc")))
    rows = rows.withColumn("__n", F.dense_rank().over(Window.partitionBy("soc_base").orderBy("order"))).where("__n <= 3")
    return rows.groupBy("soc_base").agg(F.bit_or("bits").alias("example_hits"), F.min_by("head", F.when(~F.col("blank"), F.col("order"))).alias("example_head"))


def task_features(tasks: DataFrame, penetration: DataFrame, shares: DataFrame, modes: DataFrame) -> DataFrame:
    """The rolled features of tasks (soc, task)."""
    return rolled_features(text_features(tasks, penetration, shares, modes))


def job_scores(jobs: DataFrame, wages: DataFrame, employment: DataFrame, features: DataFrame) -> DataFrame:
    """Seven indexes, three scenario shares, outcome and risk of every job."""
    c, r2 = F.col, lambda x: numeric.round_even(x, 2)
    rows = jobs.withColumn("soc_base", text.code_prefix(c("occ_code"))).join(wage_rollup(wages), "soc_base", "left")
    rows = with_employment(rows, employment).join(features, "soc_base", "left")
    own = {f"{k}_task_share": w for k, w in TASK_WORDS.items()} | {f"{k}_bottleneck": w for k, w in BRAKE_WORDS.items()}
    rows = rows.withColumns({k: F.coalesce(c(k), text.keyword_score(c("title"), w)) for k, w in own.items()})
    rows = rows.withColumn("__chance", F.nullif(numeric.to_number(c("chance_auto")), F.lit(-1.0)) / 100)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.median("__chance").alias("__middle"))))  # one row
    zero = lambda k: F.coalesce(numeric.to_number(c(k)), F.lit(0.0))
    physical, trust, law = (c(f"{k}_bottleneck") for k in BRAKE_WORDS)
    rows = rows.withColumns({
        "__e": zero("observed_exposure"),
        "__together": numeric.clip(sum((zero(f"{m}_share") for m in ("task_iteration", "validation", "learning")), zero("feedback_loop_share")), 0, 1),
        "__digital": numeric.row_mean(*(c(f"{k}_task_share") for k in TASK_WORDS)),
        "__brake": numeric.clip(physical * 0.45 + trust * 0.35 + law * 0.20, 0, 1),
        "__signal": zero("mean_task_penetration") * 0.65 + zero("mean_aei_task_pct") * 0.35,
    })
    rows = rows.withColumns({
        "capability_exposure_index": r2(100 * (0.56 * c("__e") + 0.24 * c("__digital") + 0.20 * c("__signal"))),
        "substitution_pressure_index": r2(100 * (0.48 * c("__e") + 0.26 * zero("directive_share") + 0.26 * F.coalesce("__chance", "__middle")) * (1 - 0.62 * c("__brake"))),
        "augmentation_index": r2(100 * (0.50 * c("__e") + 0.32 * c("__together") + 0.18 * (1 - physical))),
        "human_bottleneck_index": r2(100 * c("__brake")),
    })
    rows = numeric.minmax(rows, {"__salary": ("median_salary", ""), "__growth": ("job_forecast", "invert")})
    gate = numeric.clip(numeric.gate(0.50 + 0.50 * numeric.clip(c("__signal"), 0, 1), (physical, 0.80), (trust, 0.70), (law, 0.75)), 0, 1)
    sub, more = c("substitution_pressure_index"), c("augmentation_index")
    rows = rows.withColumns({
        "near_term_disruption_index": r2(sub * 0.48 + more * 0.30 + c("__salary") * 0.12 + c("__growth") * 0.10),
        "full_job_automation_feasibility_index": F.bround(sub * gate, 2),
        "augmentation_dominance_ratio": numeric.round_even(numeric.safe_divide(more, sub, 0.0), 3),
        **{f"scenario_{h}y_task_share_base": F.bround(F.least(sub / 100 * a + more / 100 * b, F.lit(0.92 if h == 10 else 1e9)), 3) for h, (a, b) in SHARES.items()},
    })
    (first, full), (second, ratio), (third, brake) = OUTCOMES
    outcome = F.when(c("full_job_automation_feasibility_index") >= full, first).when(c("augmentation_dominance_ratio") >= ratio, second)
    out = rows.withColumn("dominant_outcome", outcome.when(c("human_bottleneck_index") >= brake, third).otherwise("mixed_redesign"))
    out = out.withColumn("risk_label", numeric.cut(c("near_term_disruption_index"), *RISKS, parity=True))
    return out.drop(*(x for x in out.columns if x.startswith("__")))


def domain_heatmap(scored: DataFrame) -> DataFrame:
    """Means of task shares and brakes by the first two characters of the code."""
    columns = [f"{k}_task_share" for k in TASK_WORDS] + [f"{k}_bottleneck" for k in BRAKE_WORDS]
    return scored.groupBy(F.substring("soc_base", 1, 2).alias("soc_major")).agg(*(F.avg(c).alias(c) for c in columns), F.count(F.lit(1)).alias("occupation_count"))


def _weighted(scored: DataFrame, allocated: bool = False) -> DataFrame:
    """``__w``: employment, else the forecast, else 1. ``allocated``: a family's employment is shared among its occupations."""
    employed = numeric.to_number(F.col("bls_employment"))
    if allocated:  # one row per family
        peers = scored.where(F.col("job_family").isNotNull()).groupBy("job_family").agg(F.count("title").alias("__peers"))
        scored, employed = scored.join(peers, "job_family", "left"), F.try_divide(employed, F.nullif(F.col("__peers"), F.lit(0)))
    weight = F.coalesce(employed, numeric.to_number(F.col("job_forecast")), F.lit(1.0))
    return scored.withColumn("__w", F.greatest(weight, F.lit(1.0))).drop("__peers")


def business_domain(scored: DataFrame) -> Column:
    """The domain with most keywords in title, family and example tasks, or their example_marks()."""
    marked = "example_hits" in scored.columns
    words = F.concat_ws(" ", *(text.clean_text(F.col(x)) for x in ("title", "job_family", "example_head" if marked else "example_tasks")))
    if marked:
        return text.best_by_keyword_bits(words, F.coalesce("example_hits", F.lit(0).cast("long")), DOMAIN_WORDS, "operations_back_office")
    return text.best_by_keywords(words, DOMAIN_WORDS, "operations_back_office")


PRESSURE_INPUTS = [
    "occ_code", "title", "job_family", "bls_employment", "job_forecast", "near_term_disruption_index", "augmentation_index", "full_job_automation_feasibility_index",
    "human_bottleneck_index", "dominant_outcome",
]


def domain_pressure(scored: DataFrame) -> DataFrame:
    """Weighted means per business domain; a domain without jobs takes the most disrupted job alone."""
    rows = _weighted(scored).withColumn("business_domain", business_domain(scored))
    top = rows.orderBy(F.desc("near_term_disruption_index"), "occ_code").limit(1)
    domains = scored.sparkSession.range(1).select(F.explode(F.array(*(F.lit(d) for d in DOMAIN_WORDS))).alias("business_domain"))
    empty = domains.join(rows.select("business_domain").distinct(), "business_domain", "left_anti")
    every = rows.unionByName(empty.crossJoin(F.broadcast(top.drop("business_domain"))))
    mean = lambda m: F.round(agg.weighted_mean(F.col(m), F.col("__w")), 2)
    out = every.groupBy("business_domain").agg(
        F.count(F.lit(1)).alias("occupation_count"), F.round(F.sum("__w"), 2).alias("labor_weight_sum"), mean("near_term_disruption_index").alias("disruption_index"),
        mean("augmentation_index").alias("augmentation_index"), mean("full_job_automation_feasibility_index").alias("replacement_feasibility_index"),
        mean("human_bottleneck_index").alias("human_bottleneck_index"), agg.mode(F.col("dominant_outcome")).alias("dominant_outcome"),
    )
    first = agg.first_n(every, ["business_domain"], 4, [F.desc("near_term_disruption_index"), F.asc("occ_code"), F.asc("title")], "title")
    named = first.select("business_domain", text.sentence_join(F.col("title"), 4).alias("example_occupations"))
    out = out.join(named, "business_domain", "left")
    return out.withColumn("pressure_label", numeric.cut(F.col("disruption_index"), *PRESSURES, parity=True))


CLUSTER_FEATURES = [
    "observed_exposure", "capability_exposure_index", "substitution_pressure_index", "augmentation_index", "human_bottleneck_index", "full_job_automation_feasibility_index",
    *(f"{k}_task_share" for k in TASK_WORDS), *(f"{k}_bottleneck" for k in BRAKE_WORDS),
]


def cluster_profiles(scored: DataFrame, label: Callable[[], Column], k: int = 7) -> DataFrame:
    """K-means over standardised indexes, shares and brakes; per cluster its means, label, first five occupations by
    code, median salary and sum of forecasts. ``label`` names a cluster by its means."""
    rows = scored.withColumns({f: F.coalesce(numeric.to_number(F.col(f)), F.lit(0.0)) for f in CLUSTER_FEATURES}).withColumn("__row", F.concat_ws(":", "occ_code", "title"))
    scaled = numeric.zscore(rows, CLUSTER_FEATURES)
    clustered = cluster.kmeans(scaled, "__row", [f"{f}_z" for f in CLUSTER_FEATURES], k)
    order = [F.asc("occ_code"), F.asc("title")]
    return cluster.profile(clustered, CLUSTER_FEATURES, "title", order, "median_salary", "job_forecast").withColumn("cluster_label", label())


def market_summary(scored: DataFrame) -> DataFrame:
    """Means over three groupings in one pass, weighted with employment allocated to the occupations of a family."""
    mean = lambda m: F.round(agg.weighted_mean(F.col(m), F.col("__w")), 2)
    measures = ("near_term_disruption_index", "augmentation_index", "full_job_automation_feasibility_index", "human_bottleneck_index")
    return agg.grouping_sets(_weighted(scored, allocated=True), ["job_family", "dominant_outcome", "risk_label"], [F.count(F.lit(1)).alias("occupation_count"), F.round(F.sum("__w"), 2).alias("labor_weight_sum"), *(mean(m).alias(m) for m in measures)])
