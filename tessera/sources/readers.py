"""Typed, tolerant readers (S7-S20): NaN becomes NULL at the door, schemas drift by alias, bad rows stay visible."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tessera.sources.scratch import settled

BAD = "_corrupt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN cells of float columns become NULL."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, tolerant: bool = True, multi_line: bool = True) -> DataFrame:
    """Headed CSV with quotes and line breaks in cells; ``tolerant`` keeps bad rows in ``_corrupt``.

    Files without line breaks in cells may be split among tasks: say ``multi_line=False``.
    """
    declared = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("nanValue", "nan").option("nullValue", "")
    if tolerant:
        declared = StructType([*declared.fields]).add(BAD, "string")
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return without_nan(reader.schema(declared).csv(path))


def read_json_items(spark: SparkSession, path: str | list[str], schema: StructType | str, items: str) -> DataFrame:
    """Documents with an array of records under ``items``, one row per record, with the file's path."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.explode(items).alias("item"), F.col("_metadata.file_path").alias("source_path")).select("item.*", "source_path")


def read_listing(spark: SparkSession, path: str, schema: StructType | str, suffix: str) -> DataFrame:
    """A listing as a top-level JSON array; files with the suffix."""
    return spark.read.schema(schema).option("multiLine", True).json(path).where((F.col("type") == "file") & F.endswith("path", F.lit(suffix)))


def read_glob(spark: SparkSession, path: str, pattern: str, name: str) -> DataFrame:
    """Many Parquet files, with a column taken from their paths."""
    return spark.read.parquet(path).withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_keyed_json(spark: SparkSession, path: str, schema: StructType | str, key: str, file_name: str = "results.json") -> DataFrame:
    """JSON documents of a tree of folders, with the name of each one's folder as the key.

    A file that is no JSON of the schema gives a row with its text in ``_corrupt``; files that vanish meanwhile are left out.
    """
    declared = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", file_name).option("ignoreMissingFiles", True)
    docs = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).schema(StructType([*declared.fields]).add(BAD, "string")).json(path)
    return docs.withColumn(key, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def parse_yaml(text: str) -> dict:
    """Nested maps, lists and plain or quoted scalars of simple YAML, by indentation; everything else raises ValueError."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]

    def scalar(x: str) -> object:
        if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
            return x[1:-1]
        if x.startswith("[") and x.endswith("]"):
            return [scalar(part.strip()) for part in x[1:-1].split(",") if part.strip()]
        return {"": None, "null": None, "~": None, "true": True, "false": False}.get(x, x)

    def block(at: int, depth: int) -> tuple[object, int]:
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] >= depth:
            indent, line = lines[at]
            if indent > depth:
                raise ValueError(f"unexpected indentation: {line}")
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                if not isinstance(out, list):
                    raise ValueError(f"list item in a map: {line}")
                out.append(scalar(line[2:].strip()))
                at += 1
                continue
            name, mark, value = line.partition(":")
            out = {} if out is None else out
            if not mark or not isinstance(out, dict):
                raise ValueError(f"no map entry: {line}")
            at += 1
            if value.strip():
                out[scalar(name.strip())] = scalar(value.strip())
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
                out[scalar(name.strip())], at = block(at, lines[at][0])
            else:
                out[scalar(name.strip())] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def read_yaml(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Simple YAML files as rows of the schema, with ``path`` and ``error`` (null where the file was read).

    Each file is parsed by itself in Arrow batches; its JSON is then read with the schema.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for text, where in zip(part["value"], part["path"]):
                try:
                    found.append((json.dumps(parse_yaml(text)), None, where))
                except (ValueError, IndexError) as bad:
                    found.append((None, str(bad), where))
            yield pd.DataFrame(found, columns=["body", "error", "path"])

    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = texts.mapInPandas(run, "body string, error string, path string")
    return rows.withColumn("r", F.from_json("body", schema if isinstance(schema, str) else schema.json())).select("r.*", "path", "error")


def dead_letters(df: DataFrame, path: str, bad: str = BAD) -> DataFrame:
    """Good rows without the mark; bad ones are appended as JSON under ``path``, with the time. ``df`` is read once."""
    kept = settled(df, "dead-letters")
    kept.where(F.col(bad).isNotNull()).select(F.col(bad).alias("error"), F.current_timestamp().alias("failed_at")).write.mode("append").json(path)
    return kept.where(F.col(bad).isNull()).drop(bad)


def reference_list(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, blanks left out."""
    value = F.trim(F.col(column).cast("string"))
    return df.select(value.alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def read_sources(spark: SparkSession, registry: dict[str, tuple], root: str) -> dict[str, DataFrame]:
    """Every source of a registry, name to (reader, path under ``root``, schema, further arguments)."""
    return {name: reader(spark, f"{root}/{path}", schema, *more) for name, (reader, path, schema, *more) in registry.items()}


#: The eight files of the labour sources (S6), by the schema of the columns that are read.
LABOR_SOURCES = {
    "job_exposure": (read_csv, "job_exposure.csv", "occ_code string, title string, observed_exposure double"),
    "wage_data": (read_csv, "wage_data.csv", "SOCcode string, JobName string, JobFamily string, MedianSalary double, JobForecast double, ChanceAuto double, JobZone double, isBright double, isGreen double"),
    "bls_employment_may_2023": (read_csv, "bls_employment_may_2023.csv", "title string, employment double"),
    "task_penetration": (read_csv, "task_penetration.csv", "task string, penetration double"),
    "automation_by_task": (read_csv, "automation_by_task.csv", "task_name string, directive double, feedback_loop double, task_iteration double, validation double, learning double, filtered double"),
    "onet_task_statements": (read_csv, "onet_task_statements.csv", "soc string, title string, task_id string, task string"),
    "onet_task_mappings": (read_csv, "onet_task_mappings.csv", "task_name string, pct double"),
    "automation_vs_augmentation": (read_csv, "automation_vs_augmentation.csv", "interaction_type string, pct double"),
}


def resolve(df: DataFrame, names: Sequence[str], kind: str | DataType = "string") -> Column:
    """The first of the names that is a column in any case, else a null column."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return F.col(f"`{have[n.lower()]}`")
    return F.lit(None).cast(kind)


def conform(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Columns of a schema in its order, missing ones null, wrong types tried."""
    declared = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return df.select(*(resolve(df, [f.name]).try_cast(f.dataType).alias(f.name) for f in declared))


def latest_per_key(files: DataFrame, key: str, path: str) -> DataFrame:
    """The last path of each key."""
    return files.groupBy(key).agg(F.max(path).alias(path))


def listed_first(df: DataFrame, column: str, first: Sequence[str], order: str, limit: int) -> DataFrame:
    """Rows of the listed values first, then the rest in order; the first ``limit``."""
    return df.orderBy(F.when(F.col(column).isin(*first), 0).otherwise(1), order).limit(limit)


def require(df: DataFrame, least: int, forbidden_prefix: str, *columns: str) -> DataFrame:
    """``df``, or an error if it has too few rows or a forbidden value."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.startswith(F.coalesce(c, F.lit("")), F.lit(forbidden_prefix))
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.bool_or(bad), F.lit(False))).first()
    if found[0] < least or found[1]:
        raise RuntimeError(f"input has {found[0]} rows (needs {least}); forbidden values: {found[1]}")
    return df
