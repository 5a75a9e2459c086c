"""Rule tables, text, number and date functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, nested, numeric, rules, text

FAMILIES = [
    ("Google: Gemini 3 Pro", "google", "Gemini"),
    ("Google: Gemma 3 27B", "google", "Gemma"),
    ("BERT-Large", "Google", "Other"),
    ("AmoebaNet-A", "Google Brain", "Other"),
    ("OpenAI: GPT-5.5", "openai", "GPT"),
    ("Sora 2.0", "OpenAI", "Other"),
    ("Anthropic: Claude Opus 4.7", "anthropic", "Claude"),
    ("meta-llama/Llama-4", "meta", "Llama"),
    ("Qwen3 Max", "alibaba", "Qwen"),
    ("DeepSeek V4", "deepseek", "DeepSeek"),
    ("Microsoft: Phi 4", "microsoft", "Phi"),
    ("Command R", "independent", "Command"),
    ("xAI: Grok 4", "x-ai", "Grok"),
]


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema)
    return [r[0] for r in df.orderBy("k").select(column.alias("x")).collect()]


def test_families(spark):
    got = values(spark, [r[:2] for r in FAMILIES], "n string, o string", rules.classify_family(F.col("n"), F.col("o")))
    assert got == [r[2] for r in FAMILIES]


def test_entity_and_access(spark):
    got = values(spark, [("Google: Gemma 3 27B", "google")], "n string, o string", rules.classify_entity(F.col("n"), F.col("o")))
    assert tuple(got[0]) == ("Google", "Gemma", "Gemma")
    rows = [("OpenAI: gpt-oss-120b", "openai", "", ""), ("X", "acme", "not released", ""), ("X", "acme", "", "Yes"), ("Llama 4", "meta", "", ""), ("X", "acme", "API access", ""), ("X", "acme", None, None)]
    got = values(spark, rows, "n string, o string, a string, w string", rules.classify_access(F.col("n"), F.col("o"), F.col("a"), F.col("w")))
    assert got == ["open_weight", "not_released", "open_weight", "likely_open_weight", "closed_or_api", "unknown"]


def test_vendor_fallbacks(spark):
    rows = [("Mistral AI", ""), ("acme", "x"), ("a,b", "Acme: Model"), ("", "model"), (None, None)]
    got = values(spark, rows, "o string, n string", rules.canonical_vendor(F.col("o"), F.col("n")))
    assert got == ["Mistral", "acme", "Acme", "Unknown", "Unknown"]


def test_text(spark):
    one = lambda v, c: values(spark, [(v,)], "c string", c)[0]
    c = F.col("c")
    assert [one(v, text.slug(c)) for v in ("Hello, World!", "--", None)] == ["hello-world", "unknown", "unknown"]
    assert [one(v, text.clean_text(c, "x")) for v in ("NaN", " a ", "", None, "None")] == ["x", "a", "x", "x", "x"]
    assert [one(v, text.safe_float(c)) for v in ("1,234", "$5.50/M", "nan", "", "1e3", "garbage", "-2")] == [1234.0, 5.5, None, None, 1000.0, None, -2.0]
    assert [one(v, text.price_per_million(c)) for v in ("0.000002", "-1", "0")] == [pytest.approx(2.0), None, 0.0]
    assert [one(v, text.code_prefix(c)) for v in ("15-1252.00", "abcdefghij")] == ["15-1252", "abcdefg"]
    assert [one(v, text.inferred_parameters(c)) for v in ("llama-7b-x", "a-1.5T", "mix-8b-70b", "none", "x350M")] == [7e9, 1.5e12, 70e9, None, None]
    assert one("Software  Developers, Occupations", text.title_key(c)) == "software developers"
    assert one("a<b>&", text.escape_html(c)) == "a&lt;b&gt;&amp;"


def test_normalized_names(spark):
    names = ["Anthropic: Claude Sonnet 4.5 (Fast)", "openai/gpt-5.5-preview", "vendor/model:free", "gpt 4 20240513", "meta-llama/Llama-4 2025"]
    assert values(spark, [(n,) for n in names], "c string", rules.normalized_model(F.col("c"))) == ["claudesonnet45", "gpt55", "", "gpt4", "llama4"]


def test_numbers(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (2.0,)]
    assert values(spark, rows, "c double", numeric.finite(F.col("c"))) == [None, None, None, 2.0]
    assert values(spark, [(0.0,), (4.0,)], "c double", numeric.safe_divide(F.lit(8.0), F.col("c"), -1.0)) == [-1.0, 2.0]
    edges = [(0.0,), (20.0,), (20.1,), (101.0,), (102.0,), (None,)]
    assert values(spark, edges, "c double", numeric.cut(F.col("c"), [-1, 20, 60, 101], ["a", "b", "c"])) == ["a", "a", "b", "c", None, None]
    assert values(spark, [(2.675,), (0.125,)], "c double", numeric.rounded(F.col("c"), 2, parity=True))[1] == 0.12
    assert values(spark, [(1.0, None), (None, None), (1.0, 3.0)], "a double, b double", numeric.row_mean(F.col("a"), F.col("b"))) == [1.0, None, 2.0]
    assert values(spark, [(0.0, 2.0), (1.0, 3.0)], "a double, b double", numeric.price_blend(F.col("a"), F.col("b"))) == [2.0, pytest.approx(2.3)]


def test_minmax_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, None), (2, 10.0, 5.0, None), (3, None, 5.0, None)], "k int, a double, b double, c double")
    got = {r.k: r for r in numeric.minmax(df, {"x": ("a", ""), "y": ("a", "invert"), "flat": ("b", ""), "void": ("c", "")}).collect()}
    assert [(got[k].x, got[k].y, got[k].flat, got[k].void) for k in (1, 2, 3)] == [(0.0, 100.0, 50.0, 50.0), (100.0, 0.0, 50.0, 50.0), (0.0, 0.0, 50.0, 50.0)]


def test_dates(spark):
    rows = [("2025",), ("2025-05",), ("2025-05-13",), ("2025-05-13T10:00:00Z",), ("garbage",), ("",), (None,)]
    got = values(spark, rows, "c string", dates.parse_date(F.col("c")))
    assert [x["precision"] for x in got] == ["year", "month", "day", "timestamp", "unparsed", "missing", "missing"]
    assert [str(x["date"]) for x in got] == ["2025-01-01", "2025-05-01", "2025-05-13", "2025-05-13", "None", "None", "None"]
    assert [str(x) for x in values(spark, [("20250513_name",), ("name",)], "c string", dates.embedded_date(F.col("c")))] == ["2025-05-13", "None"]


def test_nested(spark):
    df = spark.createDataFrame([(1, '{"b": {"m": "1.5", "s": "x"}}'), (2, None)], "k int, j string")
    got = sorted(tuple(r) for r in nested.map_of_maps(df, "j", "bench", "metric").select("k", "bench", "metric", "value", "raw_value").collect())
    assert got == [(1, "b", "m", 1.5, "1.5"), (1, "b", "s", None, "x")]
    index = spark.createDataFrame([({"a": [0, 2], "b": [1]},)], "m map<string,array<int>>")
    assert index.select(nested.inverted_text(F.col("m"))).first()[0] == "a b a"
