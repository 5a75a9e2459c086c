"""Queries over tables that were written as text and read back, with the SQL of the tables themselves."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import placing
from tessera.sources import chunked, paged, sinks
from tessera.sources.readers import table
from tessera.sources.scratch import new_path, settled

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
_SQL = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars, {} AS bad FROM documents"


def _digest(rows):
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars", F.col(chunked.BAD).isNotNull().cast("long").alias("bad"))


def q_csv_chunks(spark, d):
    """All documents as quoted CSV, line breaks and quotes in their texts, read back by as many tasks as the files have blocks."""
    path = new_path(spark, "documents-csv")
    sinks.write_quoted_csv(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return _digest(chunked.read_quoted_csv(spark, path, DOCUMENT))


register("q_csv_chunks", q_csv_chunks, _SQL.format("0::BIGINT"))


def q_json_array(spark, d):
    """All documents as JSON arrays, the elements cut out and parsed in parallel."""
    path = new_path(spark, "documents-json")
    sinks.write_json_array(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return _digest(chunked.read_json_array(spark, path, DOCUMENT))


register("q_json_array", q_json_array, _SQL.format("0::BIGINT"))

#: Documents on a page of the service that `q_paged_source` asks.
PAGE = 500


def q_paged_source(spark, d):
    """All documents, cut into numbered pages by language and asked for again, a partition for each page."""
    root = new_path(spark, "pages")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, page, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paged.write_atomically(f"{root}/{quote(lang, safe='')}/{page}.json", body.encode())
            yield batch.select(["lang", "page"])

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    placed = placing.rank(docs, ["doc_id"], [F.asc("doc_id")], "place", ["lang"]).withColumn("page", F.ceil(F.col("place") / PAGE))
    items = F.collect_list(F.struct("doc_id", "text"))  # PAGE documents
    pages = placed.groupBy("lang", "page").agg(F.to_json(F.struct(items.alias("items"))).alias("body"))
    stored = settled(pages.mapInArrow(store, "lang string, page long"), "pages-stored")
    last = {r[0]: r[1] for r in stored.groupBy("lang").agg(F.max("page")).collect()}  # the service's queries
    found = paged.read_paged(spark, sorted(last), url=root + "/{query}/{page}.json", paging="page", pages=max(last.values(), default=1), transport="tessera.sources.paged:file_get")
    item = F.from_json("item", "doc_id long, text string")
    return found.select(item.alias("r"), F.col("query").alias("lang")).select("r.doc_id", "lang", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))


register("q_paged_source", q_paged_source, "SELECT doc_id, coalesce(lang, 'und') AS lang, md5(text) AS text_md5 FROM documents")
