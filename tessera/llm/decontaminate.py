"""Benchmark decontamination (4), native: size-partitioned MinHash containment search, verified by exact containment.

Texts are lower-cased and cut into words [^\\x20\\x09-\\x0D]+; shingles are WORDS words (all words of a shorter item).
An item is found in a document when at least PERCENT of its distinct shingles occur in it, however long the document.

Containment of a short item in a long document is a tiny Jaccard similarity, for which banded signatures of whole
documents would need thousands of values. So the search is asymmetric: items are partitioned by size (powers of two of
their number of shingles), and the partition sets how deep an item's MinHash sketch is: the k smallest shingle hashes,
where k - 1 is the most shingles that an item of the partition may miss. A document that contains the item must hold at
least one of these, so no containing document is lost, whatever its size. Document shingles meet the sketches in a
hash join; the resulting pairs are verified by the words of their shingles.

Sketches are sent to all executors while there are at most SENT_ROWS of them (counted), else the join is shuffled;
likewise the candidate pairs. Null or blank texts and items hold nothing and are in nothing. Repeated rows of documents
or items give one row per pair of ids. A null id is an id like others. Other columns aren't read. Python isn't used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, let, save, table, words_of

WORDS, PERCENT = 5, 80
#: Rows of sketches or pairs that are sent to all executors at most (16 bytes each).
SENT_ROWS = 500_000


def _grams(words: Column, width: int, make) -> Column:
    """One value per run of ``width`` words."""
    runs = F.transform(words, lambda x, i: make([x, *(F.get(words, i + k) for k in range(1, width))]))
    return F.slice(runs, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def shingle_hashes(text: Column, widths: list[int]) -> Column:
    """Distinct hashes of the runs of each of the widths."""
    of = lambda w: F.concat(*(_grams(w, k, lambda x: F.xxhash64(*x)) for k in widths))
    return F.array_distinct(let(words_of(F.lower(text)), of))


def shingle_texts(text: Column, width: int) -> Column:
    """Distinct runs of ``width`` words, joined by spaces."""
    return F.array_distinct(let(words_of(F.lower(text)), lambda w: _grams(w, width, lambda x: F.concat_ws(" ", *x))))


def _by_width(size: Column, make, words: int) -> Column:
    """``make(width)`` for the width of an item of ``size`` words."""
    out = make(words)
    for k in range(words - 1, 0, -1):
        out = F.when(size == k, make(k)).otherwise(out)
    return out


def item_sketches(items: DataFrame, item: str, text: str, words: int, percent: int) -> DataFrame:
    """(item_id, width, shingles, m, size_class, sketch) of items with words: sketch has the smallest hashes."""
    body = F.col(text)
    size = F.size(words_of(F.lower(body)))
    sized = items.select(F.col(item).alias("item_id"), body.alias("body"), size.alias("size")).where("size > 0")
    hashed = sized.select(
        "item_id",
        F.least("size", F.lit(words)).alias("width"),
        _by_width(F.col("size"), lambda k: shingle_texts(F.col("body"), k), words).alias("shingles"),
        _by_width(F.col("size"), lambda k: shingle_hashes(F.col("body"), [k]), words).alias("hashes"),
    ).dropDuplicates(["item_id", "hashes"])
    m = F.size("shingles")
    size_class = F.floor(F.log2(m)).cast("int")
    largest = F.pow(F.lit(2.0), size_class + 1) - 1
    depth = F.floor(F.lit(100 - percent) * largest / 100).cast("int") + 1
    return hashed.select(
        "item_id", "width", "shingles", m.alias("m"), size_class.alias("size_class"),
        F.slice(F.array_sort("hashes"), F.lit(1), depth).alias("sketch"),
    )


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(key, item_id, n_shingles, n_shared): every item with its share of shingles in a document at ``percent`` or more."""
    sketches, _ = save(item_sketches(items, item, item_text, words, percent), "decontaminate-items")
    widths = sorted(r[0] for r in sketches.select("width").distinct().collect()) or [words]  # at most WORDS rows
    keys = sketches.select("item_id", "width", F.explode("sketch").alias("h"))
    keys = F.broadcast(keys) if keys.count() <= SENT_ROWS else keys
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    held = rows.select("key", F.explode(shingle_hashes(F.col("body"), widths)).alias("h"))
    pairs, _ = save(held.join(keys, "h").select("key", "item_id").distinct(), "decontaminate-pairs")
    pairs = pairs.select(F.col("key").alias("pair_key"), F.col("item_id").alias("pair_item"))
    by_doc = pairs.groupBy("pair_key").agg(F.collect_set("pair_item").alias("pair_items"), F.max(F.col("pair_item").isNull()).alias("pair_null"))
    by_doc = F.broadcast(by_doc) if pairs.count() <= SENT_ROWS else by_doc
    found = rows.join(by_doc, rows["key"].eqNullSafe(by_doc["pair_key"]))
    whole = found.select("key", "pair_items", "pair_null", *(shingle_texts(F.col("body"), k).alias(f"w{k}") for k in widths))
    wanted = F.when(F.col("pair_null"), F.concat("pair_items", F.array(F.lit(None)))).otherwise(F.col("pair_items"))
    each = whole.withColumn("pair_item", F.explode(wanted))
    facts = F.broadcast(sketches.drop("sketch")) if sketches.count() <= SENT_ROWS // 50 else sketches.drop("sketch")
    joined = each.join(facts, F.col("pair_item").eqNullSafe(F.col("item_id")))
    shared = F.lit(0)
    for k in widths:
        shared = F.when(F.col("width") == k, F.size(F.array_intersect(f"w{k}", "shingles"))).otherwise(shared)
    return (
        joined.select("key", "item_id", F.col("m").alias("n_shingles"), shared.alias("n_shared"))
        .where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
        .groupBy("key", "item_id")
        .agg(F.max(F.struct("n_shared", "n_shingles")).alias("best"))
        .select(
            F.col("key").alias(key),
            "item_id",
            F.col("best.n_shingles").cast("long").alias("n_shingles"),
            F.col("best.n_shared").cast("long").alias("n_shared"),
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item, whatever their key, which may repeat or be null.

    Texts are told apart by two 64-bit hashes.
    """
    body = F.col(text)
    mark = F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit("text"), body).alias("b"))
    leak = fresh(docs, "leak")
    rows = docs.where(body.isNotNull()).select(mark.alias("mark"), body.alias("text"))
    found, _ = save(contained_items(rows, items, "mark", "text").select(F.col("mark").alias(leak)).distinct(), "decontaminate-found")
    few = found.count() <= SENT_ROWS
    return docs.join(F.broadcast(found) if few else found, mark == F.col(leak), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(5, len(w))::BIGINT AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(list_slice(w, p, p + k - 1), ' '))) AS g FROM k),
m AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(list_slice(w, p, p + k - 1), ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN s USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, n_shared::BIGINT AS n_shared
FROM c JOIN m USING (item_id) WHERE 100 * n_shared >= 80 * n_shingles
"""
