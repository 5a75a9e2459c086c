"""Readers and sinks on files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import nested, numeric, text
from tessera.sources import readers, sinks


def test_keyed_json_and_dead_letters(spark, tmp_path):
    for name, body in (("m1", '{"score": 1.5}'), ("m2", "no json")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "results.json").write_text(body)
    rows = readers.read_keyed_json(spark, str(tmp_path / "in"), "score double", "model")
    assert {(r.model, r.score, r[readers.BAD]) for r in rows.collect()} == {("m1", 1.5, None), ("m2", None, "no json")}
    good = readers.dead_letters(rows, str(tmp_path / "bad"))
    assert [(r.model, r.score) for r in good.collect()] == [("m1", 1.5)]
    assert spark.read.json(str(tmp_path / "bad")).first().error == "no json"


def test_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# note\ninfo:\n  name: \"A system\"\ntags:\n  model:\n    - m1\n    - m2\n  org: [x, y]\n  open: true\n")
    (tmp_path / "b.yaml").write_text("info\n")
    got = {r.path[-6:]: r for r in readers.read_yaml(spark, f"{tmp_path}/*.yaml", "info struct<name:string>, tags struct<model:array<string>,org:array<string>,open:boolean>").collect()}
    assert got["a.yaml"].info.name == "A system" and got["a.yaml"].tags.model == ["m1", "m2"] and got["a.yaml"].tags.org == ["x", "y"] and got["a.yaml"].tags.open
    assert got["b.yaml"].info is None and got["b.yaml"].error
    with pytest.raises(ValueError):
        readers.parse_yaml("a: 1\n- b")


def test_registry_and_reference_list(spark, tmp_path):
    (tmp_path / "task_penetration.csv").write_text("task,penetration\nx,0.5\n\"y, z\",nan\n")
    found = readers.read_sources(spark, {"task_penetration": readers.LABOR_SOURCES["task_penetration"]}, str(tmp_path))
    assert sorted((r.task, r.penetration) for r in found["task_penetration"].collect()) == [("x", 0.5), ("y, z", None)]
    assert len(readers.LABOR_SOURCES) == 8
    ids = spark.createDataFrame([("b",), ("a",), ("b",), (" ",), (None,)], "id string")
    assert [r.id for r in readers.reference_list(ids, "id").collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    sink = sinks.Sink(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, 'b "c"')], "k long, v string")
    sink.write(df.repartition(2), "t")
    first = sink.manifest().first()
    assert (first.rows, first.files) == (2, 2) and first.bytes > 0
    sink.write(df.orderBy(F.desc("k")).coalesce(1), "t")
    again = sink.manifest().first()
    assert again.sha256 == first.sha256 and again.files == 1
    sink.write(df.withColumn("v", F.lit("other")), "t")
    assert sink.manifest().first().sha256 != first.sha256
    path = sink.write_csv_file(df.orderBy("k"), "one")
    assert open(path).read().splitlines() == ["k,v", "1,a", '2,"b ""c"""']
    assert sink.try_write(df.select(F.raise_error(F.lit("no")).alias("x")), "bad") is not None
    assert sink.run_facts()["tables"] == ["t", "t", "t"]
    rows = json.loads(sinks.to_json_text([{"a": float("inf"), "b": np.float64(1.5), "c": [float("nan")]}]))
    assert rows == [{"a": None, "b": 1.5, "c": [None]}]


def test_text_and_nested(spark):
    one = spark.range(1)
    got = one.select(
        text.format_number(F.lit(1234567.891), 2).alias("a"), text.format_number(F.lit(1.5e15)).alias("b"), text.format_number(F.lit(float("nan"))).alias("c"),
        text.url_quoted(F.lit("a b/c+~*é")).alias("d"), text.inline_markdown(F.lit("**x** <y> [l](u) `k`")).alias("e"), text.wrapped(F.lit("aa bb cccccc d"), 5).alias("f"),
        text.title_case(F.lit("near_term index")).alias("g"), text.composite_key(F.lit(None).cast("string"), F.lit("A B"), F.lit("x")).alias("h"), text.file_timestamp(F.lit("d/results_2024-01.json")).alias("i"),
    ).first()
    assert tuple(got) == ("1,234,567.89", "1.50e+15", "n/a", "a%20b/c%2B~%2A%C3%A9", '<strong>x</strong> &lt;y&gt; <a href="u">l</a> <code>k</code>', "aa bb\ncccccc\nd", "Near Term Index", "::a-b::x", "2024-01")
    ids = text.unique_ids(spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "k int, t string"), "t", "k")
    assert {r.k: r.html_id for r in ids.collect()} == {1: "a", 2: "a-2", 3: "b"}
    cells = spark.createDataFrame([("[\"x\", \"y\"]",), ("\"z\"",), ("w",), (None,), (" ",)], "c string")
    assert [r.v for r in cells.select(nested.scalar_or_list(F.col("c")).alias("v")).collect()] == [["x", "y"], ["z"], ["w"], [], []]
    tags = spark.createDataFrame([(["license:mit"], ["a"]), (["x"], ["a", "b"]), (None, None)], "t array<string>, c array<string>")
    assert [r.l for r in tags.select(text.hub_license(F.col("t"), F.col("c")).alias("l")).collect()] == ["mit", "a,b", None]
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert numeric.named_by_place(df, "x").columns == ["x", "b"] and numeric.column_list(df) == "a,b" and numeric.ensured(df, ["b", "c"]).columns == ["a", "b", "c"]
    assert df.select(numeric.within(F.col("a"), 1, 2).alias("w"), numeric.within(F.lit(None).cast("double"), 0, 1).alias("n")).first() == (True, False)
