"""Sinks (K1-K9, K16, K17): tables as Parquet and CSV with a manifest of rows, bytes and SHA-256."""

from __future__ import annotations

import json
import logging
import math
import subprocess
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.nested import stored
from tessera.operators.ranking import first_per_group


@dataclass
class Sink:
    """Writes tables under ``out_dir``; keeps what it wrote for the manifest."""

    spark: SparkSession
    out_dir: str
    captured_at: str | None = None
    written: list[tuple[int, str, str]] = field(default_factory=list)

    def write(self, df: DataFrame, name: str, source_ids: str = "", csv: bool = True) -> DataFrame:
        """K1-K4: the table, as stored (nested cells as JSON text), read back from Parquet."""
        out = stored(df)
        if self.captured_at:
            out = out.withColumn("captured_at", F.lit(self.captured_at))
        out.write.mode("overwrite").parquet(f"{self.out_dir}/{name}.parquet")
        back = self.spark.read.parquet(f"{self.out_dir}/{name}.parquet")
        if csv:
            back.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{self.out_dir}/{name}.csv")
        self.written.append((len(self.written), name, source_ids))
        return back.drop("captured_at") if self.captured_at else back

    def try_write(self, df: DataFrame, name: str, source_ids: str = "") -> str | None:
        """K2: like write(), but an error is logged and returned, so that the other tables are still written."""
        try:
            self.write(df, name, source_ids)
        except PySparkException as bad:
            logging.getLogger(__name__).warning("%s wasn't written: %s", name, bad)
            return str(bad)
        return None

    def write_csv_file(self, df: DataFrame, name: str) -> str:
        """K1: one headed CSV file ``name.csv``, for small tables that people open; its rows are in one task."""
        folder, jvm = f"{self.out_dir}/.{name}.csv", self.spark.sparkContext._jvm
        stored(df).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
        path = jvm.org.apache.hadoop.fs.Path
        store = path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in store.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
        target = path(f"{self.out_dir}/{name}.csv")
        store.delete(target, True)
        store.rename(part, target)
        store.delete(path(folder), True)
        return f"{self.out_dir}/{name}.csv"

    def run_facts(self) -> dict[str, object]:
        """K6: what was run: arguments and the commit of the working folder, if it has one."""
        try:
            commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            commit = None
        return {"argv": list(sys.argv), "git_sha": commit, "tables": [name for _, name, _ in self.written]}

    def manifest(self) -> DataFrame:
        """K6, K8, K9: (table, source_ids, rows, files, bytes, sha256) of the last write of each table.

        The hash is that of the sorted hashes of rows, so no file is held whole and the order of rows doesn't matter.
        """
        every = self.spark.createDataFrame(self.written, "seq int, table string, source_ids string")
        last = first_per_group(every, ["table"], F.desc("seq"))
        parts = None
        for name in sorted({w[1] for w in self.written}):
            rows = self.spark.read.parquet(f"{self.out_dir}/{name}.parquet")
            digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
            by_head = rows.select(digest.alias("d"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy(F.substring("d", 1, 4).alias("head"), "f", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("d", 5, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
            files = by_head.groupBy("f", "b").agg(F.sum("n").alias("n"))
            sums = by_head.groupBy("head").agg(F.sum("s").alias("s")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "head", F.col("s").cast("string")))), ","), 256).alias("sha256"))
            one = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).crossJoin(sums).withColumn("table", F.lit(name))
            parts = one if parts is None else parts.unionByName(one)
        return last.drop("seq").join(parts, "table") if parts is not None else last.drop("seq")

    def repair(self, name: str, schema: str) -> DataFrame:
        """K5: Parquet of a table written anew from its CSV."""
        back = self.spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{self.out_dir}/{name}.csv")
        back.write.mode("overwrite").parquet(f"{self.out_dir}/{name}.parquet")
        return self.spark.read.parquet(f"{self.out_dir}/{name}.parquet")


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """K1: headed CSV whose cells may hold quotes and line breaks; null cells are bare, empty ones quoted."""
    kept = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**kept).csv(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """K7: a JSON array in each file, one element on a line; null fields are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = "[", None
        for batch in batches:
            for element in batch.column(0).to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{before}{held},"])], ["value"])
                    before = ""
                held = element
        yield pa.RecordBatch.from_arrays([pa.array([f"{before}{held or ''}]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns))).mapInArrow(run, "value string").write.text(path)


def to_json_text(rows: list[dict]) -> str:
    """K7: JSON of small driver-side rows; NaN and infinities become null, dates ISO text, numbers of arrays plain."""

    def clean(v):
        v = v.item() if hasattr(v, "item") and not isinstance(v, (dict, list)) else v
        if isinstance(v, float) and not math.isfinite(v):
            return None
        return {k: clean(x) for k, x in v.items()} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list) else v

    return json.dumps(clean(rows), default=str, sort_keys=True)


def markdown(df: DataFrame, limit: int = 20) -> str:
    """The first rows as a Markdown table; missing cells are n/a."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines)


def validate(df: DataFrame, **checks) -> None:
    """Raise unless every named condition holds on every row."""
    found = df.agg(*(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(k) for k, c in checks.items())).first()
    bad = [k for k in checks if not found[k]]
    if bad:
        raise AssertionError(f"output fails: {', '.join(bad)}")
