"""Quoted CSV and JSON arrays of any size, read by many tasks.

Spark's text source splits a file into blocks at line ends (CSV) or closing braces (JSON), which may lie inside quotes: no
block knows by itself whether it begins within them. So each block is read under both assumptions; how the quotes (and
the depth) of one block change what the next begins with is a row per block, summed along each file; then the
assumption that holds is picked, and what belongs to one record or element is put together. Only records of several lines
and elements of several braces are shuffled for that (JSON: pieces are numbered by block first).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.scratch import settled

BAD = "_corrupt"


def _pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """file, block (where it begins), at (rises along a block), value: the text up to each ``end``."""
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", end).text(path)
    return read.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _blocks_before() -> WindowSpec:
    """The blocks of a file before one: a row each."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's place in its block under both assumptions: parity of quotes before and after it, records begun up to it."""
    last, odd, begun = None, 0, [0, 0]
    for batch in batches:
        file, block, _, value = (batch.column(k) for k in range(4))
        quotes = pc.count_substring(pc.fill_null(value, ""), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        names, starts = file.to_pylist(), block.to_numpy()
        borders = [0, *(k for k in range(1, len(names)) if starts[k] != starts[k - 1] or names[k] != names[k - 1]), len(names)]
        for lo, hi in zip(borders, borders[1:]):
            if lo == hi:
                continue
            if (names[lo], starts[lo]) != last:
                last, odd, begun = (names[lo], starts[lo]), 0, [0, 0]
            after = (odd + np.cumsum(quotes[lo:hi])) & 1
            before = np.append(odd, after[:-1])
            record = [begun[h] + np.cumsum(before == h) for h in (0, 1)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x.astype(np.int64)) for x in (before, after, *record))], [*part.schema.names, "before", "after", "record0", "record1"])
            odd, begun = int(after[-1]), [int(r[-1]) for r in record]


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, first (whether the file begins with it), record: records of quoted CSV, with the line breaks in their cells.

    As in any reader, a quote that is never closed takes what follows, up to the next one, into its record. Lines are read
    once: where Spark cuts blocks hangs on settings and on the executors of the moment, so a second scan may have others.
    """
    scanned = _pieces(spark, path, "\n").mapInArrow(_quoted, "file string, block long, at long, value string, before long, after long, record0 long, record1 long")
    scanned = settled(scanned, "csv-lines")
    blocks = scanned.groupBy("file", "block").agg(F.max_by("after", "at").alias("odd"), F.max("record0").alias("begun0"), F.max("record1").alias("begun1"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(_blocks_before()), F.lit(0)) % 2).withColumn("begun", F.when(F.col("inside") == 1, F.col("begun1")).otherwise(F.col("begun0")))
    opener = F.when(F.col("begun") > 0, F.struct(F.col("block").alias("home"), F.col("begun").alias("number")))
    blocks = blocks.withColumn("open", F.last(opener, True).over(_blocks_before())).select(F.col("file").alias("f"), F.col("block").alias("b"), "inside", "open")
    known = scanned.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    number = F.when(F.col("inside") == 1, F.col("record1")).otherwise(F.col("record0"))
    own = number > 0
    known = known.select(
        "file", "block", "at", "value", F.when(own, F.col("block")).otherwise(F.col("open.home")).alias("home"), F.when(own, number).otherwise(F.col("open.number")).alias("number"),
        ((F.col("before") == F.col("inside")) & (F.col("after") == F.col("inside"))).alias("alone"),
    )
    first = ((F.col("home") == 0) & (F.col("number") == 1)).alias("first")
    lines_of = F.array_sort(F.collect_list(F.struct("block", "at", "value")))  # the lines of one record
    several = known.where(~F.col("alone")).groupBy("file", "home", "number").agg(F.array_join(F.transform(lines_of, lambda s: s["value"]), "\n").alias("record"))
    return known.where("alone").select("file", first, F.col("value").alias("record")).unionByName(several.select("file", first, "record"))


def read_quoted_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> DataFrame:
    """Rows of the schema from quoted CSV; what doesn't fit it is kept in ``_corrupt``, with the cells that do.

    Blank records are left out, ``nan`` is null in numbers. Unquoted empty cells are null, quoted ones are empty texts (no number).
    """
    null = f"null-{uuid.uuid4().hex}"  # what no cell holds; "" would make quoted empty cells null, too
    declared = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    kind = StructType([*declared.fields]).add(BAD, "string")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "nanValue": "nan", "nullValue": null, "maxCharsPerColumn": "-1", "charToEscapeQuoteEscaping": '"'}
    record = F.regexp_replace("record", "\r$", "")
    records = csv_records(spark, path).where(~F.col("first") if header else F.lit(True)).select(record.alias("record")).where(F.trim("record") != "")
    rows = records.select(F.from_csv("record", _ddl(kind), options).alias("r")).select("r.*")
    floats = {f.name for f in declared if f.dataType.typeName() in ("float", "double")}
    return rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns))


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def json_elements(spark: SparkSession, path: str | list[str], depth: int = 1) -> DataFrame:
    """file, element: the objects of a JSON array as text; ``depth`` 1 for an array at the top, 2 for one in an object.

    The array of objects must be the only one at its depth in a file.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2
    change = {}
    for inside, text in enumerate((bare, F.concat(F.lit('"'), bare))):
        open_text = F.regexp_replace(text, r'"[^"]*("|$)', "")
        closes = F.when((odd + inside) % 2 == 0, 1).otherwise(0)  # the brace that ends the piece
        change[inside] = F.length(F.regexp_replace(open_text, r"[^\[{]", "")) - F.length(F.regexp_replace(open_text, r"[^\]]", "")) - closes
    pieces = _pieces(spark, path, "}").withColumns({"odd": odd, "change0": change[0], "change1": change[1]})
    along = Window.partitionBy("file", "block").orderBy("at")
    state = F.coalesce(F.sum("odd").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    pieces = pieces.withColumn("state", state)
    for h in (0, 1):  # whether the block begins inside a string
        mine = F.when((F.col("state") + h) % 2 == 1, F.col("change1")).otherwise(F.col("change0"))
        pieces = pieces.withColumn(f"depth{h}", F.sum(mine).over(along))
    pieces = settled(pieces.select("file", "block", "at", "value", "odd", "state", "depth0", "depth1"), "json-pieces")
    blocks = pieces.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.max_by("depth0", "at").alias("depth0"), F.max_by("depth1", "at").alias("depth1"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(_blocks_before()), F.lit(0)) % 2)
    blocks = blocks.withColumn("depth", F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0")))
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), "inside", F.coalesce(F.sum("depth").over(_blocks_before()), F.lit(0)).alias("level"))
    known = pieces.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    depth_after = F.col("level") + F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    ends = (depth_after == depth) & ((F.col("state") + F.col("inside") + F.col("odd")) % 2 == 0)
    known = known.select("file", "block", "at", "value", ends.alias("ends"), (depth_after >= depth).alias("within"))
    number = F.coalesce(F.sum(F.col("ends").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = settled(known.withColumn("number", number), "json-numbered")
    last = known.groupBy("file", "block").agg(F.sum(F.col("ends").cast("long")).alias("ended"))
    opener = F.last(F.when(F.col("ended") > 0, F.struct(F.col("block").alias("home"), F.col("ended").alias("number"))), True).over(_blocks_before())
    last = last.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(opener, F.struct(F.lit(0).cast("long").alias("home"), F.lit(0).cast("long").alias("number"))).alias("open"))
    # pieces before a block's first end go on with what the last block left open
    placed = known.join(last, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("home", F.when(F.col("number") > 0, F.col("block")).otherwise(F.col("open.home"))).withColumn("element", F.when(F.col("number") > 0, F.col("number")).otherwise(F.col("open.number")))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))  # the pieces of one element
    whole = placed.groupBy("file", "home", "element").agg(F.array_join(F.transform(parts, lambda s: s["value"]), "}").alias("text"), F.bool_or("ends").alias("ended")).where("ended")
    # before the element: a comma, or what opens the array
    opened = r"(?s)^[^{]*\{" if depth == 1 else r"(?s)^[^{]*\{[^\[]*\[[^{]*\{"
    text = F.when((F.col("home") == 0) & (F.col("element") == 0), F.regexp_replace("text", opened, "{")).otherwise(F.regexp_replace("text", r"(?s)^[^{]*\{", "{"))
    return whole.select("file", F.concat(text, F.lit("}")).alias("element"))


def read_json_array(spark: SparkSession, path: str | list[str], schema: StructType | str, depth: int = 1) -> DataFrame:
    """Rows of the schema from the objects of JSON arrays, with ``source_path``; bad ones in ``_corrupt``."""
    declared = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    kind = StructType([*declared.fields]).add(BAD, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return json_elements(spark, path, depth).select(F.from_json("element", kind, options).alias("r"), F.col("file").alias("source_path")).select("r.*", "source_path")
