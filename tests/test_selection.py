"""Exact quantiles and global places against the built-ins over one group."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import aggregate, placing, quantile


def values(seed, n):
    rng = random.Random(seed)
    pick = [
        lambda: rng.uniform(-1e3, 1e3), lambda: rng.choice([0.0, -0.0, 1.0, 5.5, -7.25]), lambda: rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300),
        lambda: 1.0 + rng.randrange(5) * 2**-52, lambda: rng.choice([5e-324, 1e-310, -1e-310, math.inf, -math.inf]), lambda: rng.choice([None, math.nan]), lambda: 2.0 + rng.random() * 1e-9,
    ]
    return [(rng.choice(["a", "b", None]), pick[rng.randrange(len(pick))]()) for _ in range(n)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)]


@pytest.mark.parametrize("few", [2, 4096])
def test_quantiles_are_percentiles(spark, few):
    rows = [(k, v) for k, v in values(3, 3000) if v is None or not math.isinf(v) or k == "a"]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    qs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p92": 0.92, "p100": 1.0}
    got = {r.k: tuple(r)[1:] for r in quantile.exact_quantiles(df, ["k"], "v", few=few, **qs).collect()}
    clean = df.where(F.col("v").isNotNull() & ~F.isnan("v"))
    want = {r.k: tuple(r)[1:] for r in clean.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in qs.items()]).collect()}
    assert got == want and "none" not in got and got["two"][2] == 1.5
    alone = quantile.exact_quantiles(clean, [], "v", few=few, m=0.5).collect()
    assert [r.m for r in alone] == [clean.agg(F.median("v")).first()[0]]
    assert quantile.exact_quantiles(clean.limit(0), [], "v", m=0.5).collect() == []


def test_close_values_take_more_passes(spark):
    df = spark.range(20000).select((F.lit(1.0) + F.col("id") * 2.0**-52).alias("v"), F.lit(1).alias("k"))
    got = quantile.exact_quantiles(df, ["k"], "v", few=3, a=0.25, b=0.5, c=0.999).first()
    assert tuple(got)[1:] == tuple(df.agg(*[F.percentile("v", F.lit(q)) for q in (0.25, 0.5, 0.999)]).first())


def test_places_and_ranks(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, 1.5, 2.5, *range(50)]) if rng.random() > 0.4 else 7.0) for k in range(3000)]
    df = spark.createDataFrame([(k, g, None if v is None else float(v)) for k, g, v in rows], "id long, g string, v double").repartition(5)
    order = [F.desc_nulls_last("v"), F.asc_nulls_first("g")]
    got = {r.id: r.place for r in placing.place(df, [*order, F.asc("id")]).collect()}
    assert got == {r.id: r.p for r in df.withColumn("p", F.row_number().over(Window.orderBy(*order, "id"))).collect()}
    assert sorted(r.place for r in placing.place(df, order).collect()) == list(range(1, 3001))
    for within in ([], ["g"]):
        for dense, f in ((False, F.rank), (True, F.dense_rank)):
            got = {r.id: r.r for r in placing.rank(df, ["v"], [F.desc_nulls_last("v")], "r", within, dense).collect()}
            assert got == {r.id: r.p for r in df.withColumn("p", f().over(Window.partitionBy(*within).orderBy(F.desc_nulls_last("v")))).collect()}
    assert placing.place(df.limit(0), order).collect() == [] and placing.rank(df.limit(0), ["v"], [F.asc("v")]).collect() == []


def test_no_window_over_the_table(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = placing.place(df, [F.asc("k")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the starts of the ranges


def test_sorted_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("",)], "label string")
    assert sorted(tuple(r) for r in placing.sorted_counts(df, "label").collect()) == [("", 1, 1), ("a", 1, 2), ("b", 2, 3)]


def test_profiles_of_odd_tables(spark):
    fields = {"price": (["price", "cost"], True), "name": (["NAME"], False), "none": (["absent"], False)}
    df = spark.createDataFrame([("a", None, 0.0, "2020-01-05", None), (" ", 2.0, None, "no date", "2021-03-01"), (None, None, None, None, None)], "name string, price double, cost double, some_date string, made_at string")
    r = aggregate.table_profile(df, "t", fields).first()
    assert (r["table"], r.rows, r.columns, r.latest_source_date, r.price, r.name, r.none) == ("t", 3, 5, "2021-03-01", 0.3333, 0.3333, 0.0)
    e = aggregate.table_profile(df.limit(0).select("name"), "e", fields).first()
    assert (e.rows, e.latest_source_date, e.price, e.columns_present) == (0, "", 0.0, "name")


def test_first_n(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 1, None), (None, 5, "n")], "g string, k int, v string")
    got = {r.g: r.v for r in aggregate.first_n(df, ["g"], 2, [F.desc("k")], "v").collect()}
    assert got == {"a": ["x", "z"], "b": [None], None: ["n"]}
