"""Sharding (2), native: fixed virtual slots with a versioned slot-to-shard map.

Records hash into SLOTS virtual slots by their key, once and for all. Bytes are summed per slot (at most SLOTS
rows, whatever the corpus), and the map from slot to shard is a small stored table with a version: version 1 deals
slots round robin, and each rebalancing reads the sums, moves slots from the heaviest to the lightest shard, and
stores the edited map as the next version. No record is hashed anew, and only records of moved slots move.

The law is ``bytes``: shards hold nearly equal bytes, to within the smallest slot of the heaviest shard. A record's
size is its text's UTF-8 bytes (null: none) plus 1. A null key has a slot like any other. Rows with the same key
share a slot; repeated rows are dealt like others and get positions of their own in arbitrary order among equals.
A text counts whole, however long (its length is read, never its characters). An empty table gives an empty result. Columns other than key and text aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_path, table

SLOTS = 8192
SHARDS = 8


def virtual_slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot; ``version`` counts its edits."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def initial(shards: int = SHARDS) -> SlotMap:
        return SlotMap(1, shards, tuple(k % shards for k in range(SLOTS)))

    def rebalanced(self, bytes_of: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard while that narrows their gap.

        ``shards`` above the present number adds empty shards; that edit moves slots into these alone.
        """
        n = shards or self.shards
        if n < self.shards:
            raise ValueError(f"the map has {self.shards} shards, which can't become {n}")
        takers = range(self.shards, n) if n > self.shards else range(n)
        shard_of, held, load = list(self.shard_of), [[] for _ in range(n)], [0] * n
        for slot, shard in enumerate(shard_of):
            if size := bytes_of.get(slot, 0):
                insort(held[shard], (size, slot))
                load[shard] += size
        while True:
            top, low = max(range(n), key=load.__getitem__), min(takers, key=load.__getitem__)
            gap = load[top] - load[low]
            at = bisect_left(held[top], (gap / 2, -1))
            near = [held[top][k] for k in (at - 1, at) if 0 <= k < len(held[top]) and held[top][k][0] < gap]
            if not near:
                return SlotMap(self.version + 1, n, tuple(shard_of))
            size, slot = min(near, key=lambda x: abs(x[0] - gap / 2))
            held[top].remove((size, slot))
            insort(held[low], (size, slot))
            load[top], load[low], shard_of[slot] = load[top] - size, load[low] + size, low

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table of SLOTS rows."""
        shards = F.split(F.lit(",".join(map(str, self.shard_of))), ",")
        return spark.range(0, SLOTS, 1, 1).select(
            F.col("id").cast("int").alias("virtual_slot"),
            F.get(shards, F.col("id").cast("int")).cast("int").alias("shard"),
            F.lit(self.shards).alias("shards"),
        )

    def store(self, spark: SparkSession, path: str) -> None:
        """Write as ``path/version=N``; a version that exists is never overwritten."""
        self.frame(spark).write.parquet(f"{path}/version={self.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored map, the latest by default."""
    rows = spark.read.parquet(path)
    version = version or rows.agg(F.max("version")).first()[0]
    found = rows.where(F.col("version") == version).select("virtual_slot", "shard", "shards").collect()  # SLOTS rows
    shard_of = {slot: shard for slot, shard, _ in found}
    return SlotMap(version, found[0][2], tuple(shard_of[k] for k in range(SLOTS)))


def slot_loads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Bytes and rows of each slot in use: at most SLOTS rows."""
    return docs.groupBy(virtual_slot(docs[key]).alias("virtual_slot")).agg(
        F.sum(record_size(docs[text])).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = None, path: str | None = None, former: SlotMap | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot (its position in the shard), grown_shard, virtual_slot.

    A ``former`` map (as load_map() gives) is edited; without one the first version is made and stored, too. The edited
    version is stored under ``path``. ``shards`` is the map's own number by default (SHARDS without a map); a larger one
    adds shards, which take records from the others while nothing moves between those.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-map")
    loads = {r[0]: (r[1], r[2]) for r in slot_loads(docs, key, text).collect()}  # at most SLOTS rows
    first = former or SlotMap.initial(shards or SHARDS)
    if former is None:
        first.store(spark, path)
    edited = first.rebalanced({slot: x[0] for slot, x in loads.items()}, shards)
    edited.store(spark, path)
    before, placed = [0] * edited.shards, [0] * SLOTS
    for slot, shard in enumerate(edited.shard_of):
        placed[slot] = before[shard]
        before[shard] += loads.get(slot, (0, 0))[1]
    starts = F.split(F.lit(",".join(map(str, placed))), ",")
    mapped = edited.frame(spark).withColumn("start", F.get(starts, F.col("virtual_slot")).cast("long")).drop("shards")
    records = docs.select(
        docs[key].alias("key"),
        record_size(docs[text]).alias("size"),
        F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(docs[key]).alias("virtual_slot"),
    )
    order = Window.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size")
    return (
        records.withColumn("rank", F.row_number().over(order) - 1)
        .join(F.broadcast(mapped), "virtual_slot")  # SLOTS rows
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


#: The query in SQL but for the shard of each slot, which the map decides: what the laws leave open isn't in it.
RECORDS = """
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) * (text IS NOT NULL)::INT + 1)::BIGINT AS size, 'bytes' AS law FROM documents
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return assign(table(spark, sf_dir, "documents"))
