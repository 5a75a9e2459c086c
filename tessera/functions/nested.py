"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listify(c: Column) -> Column:
    """Null to an empty array."""
    return F.coalesce(c, F.array().cast("array<string>"))


def scalar_or_list(c: Column) -> Column:
    """JSON text of a list, or of one value, as an array of text; null and blank give an empty one."""
    bare = F.trim(c)
    many = F.from_json(bare, "array<string>")
    one = F.array(F.regexp_replace(bare, '^"(.*)"$', "$1"))
    none = F.array().cast("array<string>")
    return F.when(bare.isNull() | bare.isin("", "null"), none).when(F.startswith(bare, F.lit("[")), F.coalesce(many, none)).otherwise(one)


def child_table(df: DataFrame, key: str, items: str, joined: str, fields: list[str]) -> DataFrame:
    """One row per element of an array of structs, with its place, fields and an inner array joined by commas."""
    each = df.select(key, F.posexplode(items).alias("place", "item"))
    return each.select(key, "place", *(F.col(f"item.{f}").alias(f) for f in fields), F.array_join(f"item.{joined}", ",").alias(joined))


def map_of_maps(df: DataFrame, column: str, outer: str, inner: str) -> DataFrame:
    """JSON map of maps to long rows with number and raw text of each value."""
    parsed = df.withColumn("__m", F.from_json(column, "map<string,map<string,string>>"))
    first = parsed.select("*", F.explode("__m").alias(outer, "__v")).drop("__m")
    return first.select("*", F.explode("__v").alias(inner, "raw_value")).drop("__v").withColumn(
        "value", F.col("raw_value").try_cast("double")
    )


def inverted_text(c: Column) -> Column:
    """Text of an inverted index map<word, array<position>>; the later word wins a position."""
    placed = F.flatten(
        F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    ordered = F.array_sort(placed)
    return F.array_join(F.transform(ordered, lambda x: x["w"]), " ")


def canonical_json(c: Column) -> Column:
    """JSON of a map with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def stored(df: DataFrame) -> DataFrame:
    """K2: nested columns as JSON text, for sinks without nesting."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
