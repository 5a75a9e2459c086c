"""Operators against small expectations and definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import aggregate, cluster, joins, match, ranking, simulate
from tessera.operators.skyline import skyline
from tessera.sources import readers, sinks

MATCHES = [
    ("gpt-5.5", "openai/gpt-5.5", "GPT", "exact", True),
    ("OpenAI: GPT 5.5 Preview", "openai/gpt-5.5-preview", "GPT", "normalized_exact", True),
    ("Anthropic: Claude Sonnet 4.5 (Fast)", "anthropic/claude-sonnet-4.5-fast", "Claude", "normalized_exact", True),
    ("Qwen Experimental Model", "qwen/qwen-experimental", "Qwen", "family_only", False),
    ("Unknown Lab Model", "unknown/model", "Other", "unmatched", False),
]
CANDIDATES = [("gpt-5.5", "GPT", 99.0), ("claude-sonnet-4-5-20250929", "Claude", 80.0), ("qwen3-235b-a22b", "Qwen", 75.0), ("grok-4", "Grok", 75.0)]


def test_tiers(spark):
    q = spark.createDataFrame([(k, *m[:3]) for k, m in enumerate(MATCHES)], "id long, name string, model_id string, family string")
    c = spark.createDataFrame([(k, *x) for k, x in enumerate(CANDIDATES)], "ord long, name string, family string, sort_score double")
    own = lambda model_id: F.filter(rules.alias_set(F.col("name"), model_id, F.col("family")), lambda a: a != rules.normalized_model(F.col("family")))
    q, c = q.withColumn("aliases", own(F.col("model_id"))), c.withColumn("aliases", own(F.lit("")))
    got = {r.id: (r.match_confidence, r.direct) for r in match.tiered_match(q, c).collect()}
    assert got == {k: m[3:] for k, m in enumerate(MATCHES)}


def test_the_first_listed_candidate_wins(spark):
    q = spark.createDataFrame([(1, "q", "i", "F", ["a", "b"]), (2, "none", "none", "F", []), (3, "none", "none", None, [])], "id long, name string, model_id string, family string, aliases array<string>")
    c = spark.createDataFrame([(0, "zeta", "G", ["b", "a"], 1.0, "u"), (1, "alpha", "F", ["a"], None, "v"), (2, "beta", "F", [], 0.0, "w")], "ord long, name string, family string, aliases array<string>, sort_score double, extra string")
    got = {r.id: (r.match_confidence, r.record and r.record.name, r.match_key, r.record and r.record.extra) for r in match.tiered_match(q, c).collect()}
    assert got == {1: ("normalized_exact", "zeta", "a", "u"), 2: ("family_only", "alpha", "F", "v"), 3: ("unmatched", None, None, None)}


def skyline_by_definition(df, key, gain, cost):
    """By an anti-join, quadratic: the yardstick."""
    known = df.where(F.col(gain).isNotNull() & F.col(cost).isNotNull())
    a, b = known.alias("a"), known.alias("b")
    beaten = (F.col(f"b.{gain}") >= F.col(f"a.{gain}")) & (F.col(f"b.{cost}") <= F.col(f"a.{cost}"))
    strict = (F.col(f"b.{gain}") > F.col(f"a.{gain}")) | (F.col(f"b.{cost}") < F.col(f"a.{cost}"))
    return a.join(b, beaten & strict & (F.col(f"a.{key}") != F.col(f"b.{key}")), "left_anti")


def test_skyline_is_its_definition(spark):
    rows = [(k, float(k * 37 % 23), float(k * 53 % 19)) for k in range(120)] + [(900, None, 1.0), (901, 22.0, None)]
    df = spark.createDataFrame(rows, "k long, gain double, cost double")
    assert sorted(r.k for r in skyline(df, "gain", "cost").collect()) == sorted(r.k for r in skyline_by_definition(df, "k", "gain", "cost").collect())


def test_full_merge_keeps_every_key(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("y", 5.0), ("z", 6.0)], "k string, b double")
    assert sorted((r.k, r.a, r.b) for r in joins.full_merge([a, b], "k").collect()) == [("x", 1, None), ("y", 2, 5.0), ("z", None, 6.0)]


def test_upsert(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "c")], "k int, t int, p string")
    assert sorted((r.k, r.t, r.provenance) for r in joins.upsert(df, ["k"], [F.col("t")], "p").collect()) == [(1, 3, "a|b"), (2, 1, "c")]
    null = spark.createDataFrame([(None, 1, "a"), (None, 4, "b"), (7, 2, "c")], "k int, t int, p string")
    assert sorted(((r.k, r.t, r.provenance) for r in joins.upsert(null, ["k"], [F.col("t")], "p").collect()), key=str) == [(7, 2, "c"), (None, 4, "a|b")]


def test_component_noise():
    base = np.array([[50.0, 10.0], [40.0, 90.0]])
    s, rank = simulate.component_draw(base, np.array([100.0, 1.0]), np.array([0.6, 0.4]), np.random.default_rng(3))
    rng = np.random.default_rng(3)
    noisy = np.clip(base + rng.normal(0, np.array([[2.2 + 3.6], [2.2 + 36.0]]), (2, 2)), 0, 100)
    w = rng.dirichlet([72.0, 48.0])
    assert s == pytest.approx(noisy @ w) and sorted(rank) == [1, 2] and rank[np.argmax(s)] == 1
    tied = simulate.component_draw(np.zeros((3, 1)), np.full(3, 1e30), np.array([1.0]), np.random.default_rng(0))[1]
    assert tied.min() == 1


def test_shapes(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 4.0)], "g string, k string, v double")
    groups = spark.createDataFrame([("a", 9.0)], "g string, m double")
    assert sorted((r.g, r.k, r.value, r.value_source) for r in joins.with_proxy(df, groups, "g", "v", "m", "value").collect()) == [("a", "x", 1.0, "own"), ("a", "y", 9.0, "group_proxy"), ("b", "x", 4.0, "own")]
    assert joins.compared(df, groups, "g", ["m"], "proxy_").columns == ["g", "k", "v", "proxy_m"]
    ranks = spark.createDataFrame([("a", 1), ("b", 2)], "g string, rank int")
    assert sorted((r.g, r.rank_shift) for r in joins.rank_shift(ranks, ranks.where("g = 'a'"), "g").collect()) == [("a", 0), ("b", None)]
    assert sorted((r.g, r["mean"], r.n) for r in aggregate.mean_and_size(df.withColumn("v", F.coalesce(F.col("v").cast("string"), F.lit("no"))), ["g"], "v").collect()) == [("a", 1.0, 2), ("b", 4.0, 1)]
    assert aggregate.class_medians(df, "g", "v", "b", "a").first().ratio == 4.0
    assert sorted(r.k for r in aggregate.pick_rows(df, ["y"], "k", "v", 4.0, "z").collect()) == ["x", "y"]
    assert [r.k for r in df.select("k").distinct().orderBy(ranking.in_order(F.col("k"), ["y"])).collect()] == ["y", "x"]


def test_undated_and_future_releases_count(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2025-06-01"), ("a", None), ("b", None)], "k string, d string")
    got = {r.k: (r.total, r.recent, r.median_gap_days, r.days_since_latest, r.cadence_label) for r in ranking.cadence(df, ["k"], F.col("d"), "2024-12-31").collect()}
    assert got == {"a": (3, 2, 517.0, -152, "steady") if "2024-01-01" >= "2024-01-01" else None, "b": (1, 0, None, None, "slow_or_sparse")}


def test_groups_and_reasons(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    got = sorted((r["grouping"], r["group"], r["n"]) for r in aggregate.grouping_sets(df, ["g"], [F.count(F.lit(1)).alias("n")]).collect())
    assert got == [("g", "a", 2), ("g", "unknown", 1)]
    assert aggregate.top_n_then(df, ["g"], "v", 1, m=F.max("v")).where("g = 'a'").first().m == 3.0
    one = df.where("v = 1").select(aggregate.reasons(low=F.col("v") < 2, null=F.col("g").isNull()).alias("r"), aggregate.reasons(no=F.lit(False)).alias("s")).first()
    assert tuple(one) == ("low", "none")


def test_ranks_don_t_depend_on_partitions(spark):
    rows = [(k, float(k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, v double")
    ranked = [sorted(tuple(r) for r in d.select("k", ranking.rank_min(F.col("v"))).collect()) for d in (df.repartition(1), df.repartition(7))]
    assert ranked[0] == ranked[1]


def test_simulations(spark):
    s = spark.createDataFrame([(k, float(50 + 10 * k), 50.0, 100) for k in range(4)], "e long, a double, b double, n long")
    runs = [sorted(tuple(r) for r in simulate.bootstrap_ranks(d, "e", ["a", "b"], [0.5, 0.5], "n", draws=60).collect()) for d in (s, s.repartition(3))]
    assert runs[0] == runs[1]
    assert all(r[4] <= r[6] for r in runs[0])
    lead = simulate.leadership(s, "e", ["a", "b"], [("x", 2, [0.9, 0.1])], draws=600)
    assert lead.agg(F.sum("win_share")).first()[0] == pytest.approx(1.0)
    p = simulate.bucket_p_value(s, "e", 4, sims=500).first()
    assert 0 < p.p_value <= 1


def test_kmeans(spark):
    rows = [(k, float(k % 3) * 100 + k * 0.01) for k in range(30)]
    got = cluster.kmeans(spark.createDataFrame(rows, "k long, x double"), "k", ["x"], k=3)
    assert got.count() == 30 and {r.n for r in cluster.profile(got, ["x"]).collect()} <= {10, 20, 30} | set(range(31))
    assert {r.cluster for r in cluster.kmeans(spark.createDataFrame(rows[:2], "k long, x double"), "k", ["x"], k=3).collect()} == {0}


def test_kmeans_runs_until_stable(spark):
    rows = [(k, float((k * 7919) % 1500) ** 1.3) for k in range(1500)]
    df = spark.createDataFrame(rows, "k long, x double")
    points = np.array([x for _, x in rows])
    centres = np.array([r.x for r in df.orderBy(F.xxhash64("k"), "k").limit(7).collect()])
    labels = []
    while len(labels) < 80 and (len(labels) < 2 or (labels[-1] != labels[-2]).any()):
        labels.append(((points[:, None] - centres) ** 2).argmin(axis=1))
        centres = np.array([points[labels[-1] == c].mean() if (labels[-1] == c).any() else centres[c] for c in range(7)])
    assert len(labels) > 22 and (labels[20] != labels[-1]).any()
    got = {r.k: r.cluster for r in cluster.kmeans(df, "k", ["x"]).collect()}
    assert [got[k] for k, _ in rows] == labels[-1].tolist()


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,t\n1,nan,"x, ""y""\nz"\n2,1.5,\nbad,oops,q\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "k long, v double, t string").cache()
    rows = {r.k: r for r in got.collect()}
    assert rows[1].v is None and rows[1].t == 'x, "y"\nz' and rows[2].v == 1.5 and rows[None][readers.BAD]
    sink = sinks.Sink(spark, str(tmp_path / "out"), captured_at="2026-05-15")
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "k long, tags array<string>")
    back = sink.write(df, "t")
    sink.write(df.where("k = 1"), "u")
    assert sorted((r.k, r.tags) for r in back.collect()) == [(1, '["a"]'), (2, None)]
    listed = {r.table: r for r in sink.manifest().collect()}
    assert listed["t"].rows == 2 and listed["u"].rows == 1 and listed["t"].bytes > 0 and len(listed["t"].sha256) == 64
    assert sink.repair("u", "k long, tags string, captured_at string").count() == 1
    with pytest.raises(AssertionError, match="positive"):
        sinks.validate(df, positive=F.col("k") > 1)
    with pytest.raises(RuntimeError):
        readers.require(df, 5, "sample")
    assert sinks.markdown(df.select("k"), 1) == "| k |\n| --- |\n| 1 |"
