"""Context restaurants of the language model (9), built in parts by the word before; scores flow back per document.

Every task cuts its texts into chunks of about CHUNK_TOKENS tokens and writes each to a file of the shared folder: for
each part the tokens (u1, u2, w, document) whose word before, u1, belongs to it. Words are coded by rank, rare ones by
hash. A part reads its piece of each chunk, so all restaurants of u1 and of (u2, u1) are whole in one task; it seats and
sweeps them, and hands back the sums of log probabilities per document of a chunk. The long contexts of a u1 of more than
ROOM tokens go to several parts, by a hash of u2, so a frequent word fills no task; they seat its one restaurant together
(module `frequent`), with the result one task would have. Files of failed attempts are read by nobody. The shared folder holds the corpus once, in coded form.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import frequent
from tessera.llm.common import drop, frugal, new_path, open_store, pack_piece, packed, save, table, unpack_piece, unpacked
from tessera.llm.frequent import BLOCK, BURN_IN, SAMPLES, SHARED, TAIL, Share, distinct, grouped
from tessera.llm.pitman_yor import FOLDS, HELD_OUT, STRENGTH, Head, count_words, discount, head_of, is_held_out, mix, pair, sample_tables, slices, tokens, train, word_hash

CHUNK_TOKENS = 1 << 20
#: Tokens of a part, about, and of one word before in a part.
PART_TOKENS, ROOM = 1 << 20, 1 << 19
#: Parts of small corpora: this many tokens, up to SMALL_PARTS of them.
SMALL_TOKENS, SMALL_PARTS = 1 << 17, 32


class Rooms:
    """Restaurants of one part: distinct (room of u1, u2, w) with training counts ``c`` and the probability ``p1`` of w.

    Dishes without customers are there to be predicted.
    """

    def __init__(self, room: np.ndarray, u2: np.ndarray, w: np.ndarray, c: np.ndarray, p1: np.ndarray):
        long = pair(room, u2)
        self.c, self.dish3 = c.astype(np.int64), pair(long, w)
        rooms3, self.room3 = distinct(long)
        short = pair(room, w)
        first, self.up = distinct(short)
        rooms2, self.room2 = distinct(room[first])
        self.dish2, self.p1, self.n3, self.n2 = short[first], p1[first], len(rooms3), len(rooms2)
        self.inverse3 = (1 / (STRENGTH + np.bincount(self.room3, self.c, self.n3)))[self.room3]
        self.t3, self.again = np.minimum(self.c, 1), np.flatnonzero(self.c > 1)
        self.again_c, self.again_room, self.again_up, self.again_dish = (x[self.again] for x in (self.c, self.room3, self.up, self.dish3))
        self._send()
        self.t2 = np.minimum(self.c2, 1)

    def _send(self) -> None:
        """Tables of long contexts become customers of their parents."""
        self.c2 = np.bincount(self.up, self.t3, len(self.dish2)).astype(np.int64)

    def _look(self, d2: float) -> None:
        """Tables of the rooms, and the probability of w after u1, as they are now."""
        self.tables2 = np.bincount(self.room2, self.t2, self.n2)
        self.tables3 = np.bincount(self.room3, self.t3, self.n3)
        inverse = 1 / (STRENGTH + np.bincount(self.room2, self.c2, self.n2))
        self.p2 = (self.c2 - d2 * self.t2) * inverse[self.room2] + ((STRENGTH + d2 * self.tables2) * inverse)[self.room2] * self.p1

    def predict(self, d2: float, d3: float) -> np.ndarray:
        """Predictive probability of w after (u2, u1)."""
        self._look(d2)
        return self._predicted(d3)

    def _predicted(self, d3: float) -> np.ndarray:
        return (self.c - d3 * self.t3 + (STRENGTH + d3 * self.tables3)[self.room3] * self.p2[self.up]) * self.inverse3

    def sweep(self, d2: float, d3: float, number: int) -> None:
        """Reseat all dishes, given the tables that _look() has seen; look again."""
        at = self.again
        others = self.tables3[self.again_room].astype(np.int64) - self.t3[at]
        self.t3[at] = sample_tables(self.again_c, others, self.p2[self.again_up], d3, self.again_dish, 2 * number)
        self._send()
        at = np.flatnonzero(self.c2 > 1)
        others = self.tables2[self.room2[at]].astype(np.int64) - self.t2[at]
        self.t2 = np.minimum(self.c2, 1)
        self.t2[at] = sample_tables(self.c2[at], others, self.p1[at], d2, self.dish2[at], 2 * number + 1)
        self._look(d2)

    def averaged(self, d2: float, d3: float) -> np.ndarray:
        """Predictive probabilities, averaged over SAMPLES sweeps after BURN_IN."""
        total = np.zeros(len(self.c))
        self._look(d2)
        for number in range(BURN_IN + SAMPLES):
            self.sweep(d2, d3, number)
            if number >= BURN_IN:
                total += self._predicted(d3)
        return total / SAMPLES


def place_of(u1: np.ndarray, u2: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Where tokens after (u2, u1) go, all of a u1 to one place; a u1 of more than ROOM tokens (the first ranks) has several."""
    place = mix(u1)
    hot = np.flatnonzero(u1 < np.uint64(len(splits)))
    if len(hot):
        place[hot] = pair(place[hot], mix(u2[hot]) % splits[u1[hot].astype(np.int64)])
    return place


def splits_of(head: Head) -> np.ndarray:
    """Places of the words with more than ROOM tokens, by rank: at most one word for each ROOM tokens."""
    return -(-head.n[head.n > ROOM] // ROOM).astype(np.uint64)


class Chunk:
    """Tokens of some documents, written by part."""

    def __init__(self, root: str, parts: int, splits: np.ndarray):
        self.root, self.parts, self.splits = root, parts, splits
        self.codes: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.trains: list[bool] = []
        self.tokens = 0

    def write(self) -> tuple[str, list[int]]:
        """The file's name and the offsets of its parts."""
        w = np.concatenate(self.codes)
        sizes = np.array(self.sizes)
        starts = np.cumsum(sizes) - sizes
        end = w[sizes[0] - 1]
        u1 = np.concatenate([[end], w[:-1]])
        u2 = np.concatenate([[end], u1[:-1]])
        u1[starts] = u2[starts] = end
        u2[(starts + 1)[sizes > 1]] = end
        doc = np.repeat(np.arange(len(sizes)), sizes)
        trains = np.array(self.trains)[doc]
        part = (mix(place_of(u1, u2, self.splits)) % np.uint64(self.parts)).astype(np.uint32)
        order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        store, root = open_store(self.root)
        name, at = f"chunk-{uuid.uuid4().hex}", [0]
        with store.open_output_stream(f"{root}/{name}") as f:
            for lo, hi in zip(bounds, bounds[1:]):
                if hi > lo:
                    k = order[lo:hi]
                    data = pack_piece([u1[k], u2[k], w[k], np.diff(doc[k], prepend=0) << 1 | trains[k]])
                    f.write(data)
                    at.append(at[-1] + len(data))
                else:
                    at.append(at[-1])
        self.codes, self.sizes, self.trains, self.tokens = [], [], [], 0
        return name, at


def write_chunks(rows: DataFrame, root: str, head: object, floor: float, parts: int, splits: np.ndarray) -> DataFrame:
    """Rows of three kinds, after writing the chunks of (key, text).

    Documents: (row, key, n_tokens, n_known and base of head words). Words outside the head: (row, hash, tf).
    Chunks: (file, row of the first document, offsets).
    """
    kind = rows.schema["key"].dataType.simpleString()
    fields = {"row": pa.int64(), "key": None, "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "hash": pa.int64(), "tf": pa.int64(), "file": pa.string(), "offsets": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = head.value
        task, seq = TaskContext.get().partitionId() << 40, 0
        chunk, first = Chunk(root, parts, splits), 0
        known_head, base_head = np.append(most.c > 0, False), np.append(np.log10(most.c + 1.0) - floor, 0.0)  # rank -1 is outside

        def out(key_type: pa.DataType, **given: pa.Array) -> pa.RecordBatch:
            n = len(given["row"])
            return pa.RecordBatch.from_arrays([given.get(f, pa.nulls(n, t or key_type)) for f, t in fields.items()], list(fields))

        def close(key_type: pa.DataType) -> pa.RecordBatch:
            name, offsets = chunk.write()
            return out(key_type, row=pa.array([task + first]), file=pa.array([name]), offsets=pa.array([offsets], pa.list_(pa.int64())))

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in slices(batch):
                ids, words, size = tokens(part.column(1))
                h = word_hash(words.to_pylist())
                rank = most.find(h)
                common = rank >= 0
                codes, starts = np.where(common, rank.astype(np.uint64), h)[ids], np.cumsum(size) - size
                known = np.add.reduceat(known_head[rank][ids], starts, dtype=np.int64)
                base = np.add.reduceat(base_head[rank][ids], starts)
                tail = np.flatnonzero(~common[ids])
                uid = task + seq + np.arange(len(size))
                yield out(key_type, row=pa.array(uid), key=part.column(0), n_tokens=pa.array(size, pa.int64()), n_known=pa.array(known), base=pa.array(base))
                both, tf = np.unique((np.searchsorted(starts, tail, "right") - 1) * len(words) + ids[tail], return_counts=True)
                if len(both):
                    yield out(key_type, row=pa.array(uid[both // len(words)]), hash=pa.array(h[both % len(words)].view(np.int64)), tf=pa.array(tf))
                held = [is_held_out(k) for k in part.column(0).to_pylist()]
                for k in range(len(size)):
                    if not chunk.sizes:
                        first = seq + k
                    chunk.codes.append(codes[starts[k] : starts[k] + size[k]])
                    chunk.sizes.append(int(size[k]))
                    chunk.trains.append(not held[k])
                    chunk.tokens += int(size[k])
                    if chunk.tokens >= CHUNK_TOKENS:
                        yield close(key_type)
                seq += len(size)
        if chunk.sizes:
            yield close(key_type)

    return rows.mapInArrow(frugal(run), f"row long, key {kind}, n_tokens long, n_known long, base double, hash long, tf long, file string, offsets array<long>")


class Part:
    """The tokens of one part: distinct (u1, u2, w) with training counts, and where each token is."""

    def __init__(self, root: str, pieces: list[tuple[str, int, int, int]]):
        store, folder = open_store(root)
        found = []
        for name, _, lo, hi in pieces:
            with store.open_input_file(f"{folder}/{name}") as f:
                found.append(unpack_piece(f.read_at(hi - lo, lo), 4))
        self.sizes = [len(x[0]) for x in found]
        self.docs = [np.cumsum((x[3] >> np.uint64(1)).astype(np.int64)) for x in found]
        trains = np.concatenate([x[3] for x in found]) & np.uint64(1)
        u1, u2, w = (np.concatenate([x[k] for x in found]) for k in range(3))
        del found
        first, self.at = distinct(pair(pair(mix(u1), u2), w))
        self.u1, self.u2, self.w = u1[first], u2[first], w[first]
        self.c = np.bincount(self.at, trains, len(first)).astype(np.int64)

    def share(self, shared: np.ndarray, blocks: np.ndarray) -> Share:
        """The dishes of words before that other parts seat as well."""
        return Share(self.u1[shared], self.u2[shared], self.w[shared], self.c[shared], blocks)


def part_rows(chunks: DataFrame, parts: int, more: DataFrame | None = None) -> DataFrame:
    """(part, hash, p, file, row, low, high): pieces of chunks and, by part, rows of ``more`` (part and others), part after part."""
    pieces = chunks.select("file", "row", "offsets", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select(
        "part", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("double").alias("p"), "file", "row",
        F.get("offsets", F.col("part")).alias("low"), F.get("offsets", F.col("part") + 1).alias("high"),
    ).where("high > low")
    if more is not None:
        pieces = pieces.unionByName(more, allowMissingColumns=True)
    return pieces.repartitionByRange(parts, "part").sortWithinPartitions("part", "row")


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[tuple[str, int, int, int]]]]:
    """(part, its rows, pieces) of rows in the order of parts."""
    for number, rows in grouped(batches):
        files = rows.filter(rows["file"].is_valid())
        yield number, rows, list(zip(*(files[k].to_pylist() for k in ("file", "row", "low", "high"))))


def followers(chunks: DataFrame, root: str, share_root: str, parts: int, blocks: np.ndarray) -> DataFrame:
    """(part, hash, k, block, counts) and rows of ``frequent``: in how many restaurants of one word before (u1) words have a
    table at first.

    Words outside the head have a row (part, hash, k) for each part they occur in; of the head, each part gives counts by
    blocks of ranks. Counts of dishes with one and with two customers come as parts -1, -2 (two words before) and -3, -4.
    Restaurants that several parts seat are left to their blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, pieces in by_part(batches):
            part = Part(root, pieces)
            shared = part.u1 < np.uint64(len(blocks))
            there = np.flatnonzero((part.c > 0) & ~shared)
            first, dish = distinct(pair(mix(part.u1[there]), part.w[there]))
            c2 = np.bincount(dish, minlength=len(first))
            stats = [int((x == n).sum()) for x in (part.c, c2) for n in (1, 2)]
            words, at = distinct(part.w)
            k = np.bincount(at[there[first]], minlength=len(words)).astype(np.int64)
            follows = np.bincount(at[shared], minlength=len(words)) > 0
            for batch in frequent.counted(number, part.w[words], k, follows, stats):
                yield frequent.wide(batch)
            if shared.any():
                del first, dish, words, at
                yield frequent.wide(part.share(shared, blocks).rows(share_root, number))

    return part_rows(chunks, parts).mapInArrow(frugal(run), frequent.FOUND_DDL)


def head_customers(found: DataFrame, head: object) -> DataFrame:
    """(hash, k) of the head's words: the sums of what followers() counted."""

    def add(group: pa.Table) -> pa.Table:
        most, block = head.value, group["block"][0].as_py()
        total = sum(unpacked(x, BLOCK) for x in group["counts"].to_pylist()).astype(np.int64)
        hashes = np.empty(len(most.hashes), np.uint64)
        hashes[most.rank] = most.hashes
        mine = hashes[block * BLOCK : (block + 1) * BLOCK]
        return pa.table({"hash": pa.array(mine.view(np.int64)), "k": pa.array(total[: len(mine)])})

    return found.where(F.col("block").isNotNull()).groupBy("block").applyInArrow(add, "hash long, k long")


def document_sums(chunks: DataFrame, root: str, p_head: object, more: DataFrame, discounts: tuple[float, float], parts: int, blocks: np.ndarray, known: object) -> DataFrame:
    """(row, docs, sums) by chunk and part: places of documents after ``row`` and their sums of log10 probabilities.

    ``more``: probabilities of words outside the head, and the sweeps of frequent words before with the sums ``known``.
    """
    d2, d3 = discounts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, pieces in by_part(batches):
            if not pieces:
                continue
            part = Part(root, pieces)
            words = rows.filter(rows["hash"].is_valid())
            p1 = frequent.p_of_words(part.w, p_head.value, words["hash"].to_numpy().view(np.uint64), words["p"].to_numpy())
            shared = part.u1 < np.uint64(len(blocks))
            p, own = np.empty(len(p1)), ~shared
            if own.any():
                p[own] = Rooms(mix(part.u1[own]), part.u2[own], part.w[own], part.c[own], p1[own]).averaged(d2, d3)
            if shared.any():
                p[shared] = part.share(shared, blocks).averaged(rows.filter(rows["sweep"].is_valid()), p1[shared], discounts, known.value)
            del part.u1, part.u2, part.w, part.c, p1
            logs = np.log10(np.maximum(p, 1e-300))
            at, docs, sums = 0, [], []
            for size, doc in zip(part.sizes, part.docs):
                total = np.bincount(doc, logs[part.at[at : at + size]])
                at += size
                here = np.flatnonzero(total)
                docs.append(packed(np.diff(here, prepend=0).astype(np.uint64)))
                sums.append(total[here].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in pieces], pa.int64()), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], ["row", "docs", "sums"])

    return part_rows(chunks, parts, more).mapInArrow(frugal(run), "row long, docs binary, sums binary")


def _summed(group: pa.Table) -> pa.Table:
    """(row, score) of the documents of a chunk."""
    first, total = group["row"][0].as_py(), np.zeros(0)
    for docs, sums in zip(group["docs"].to_pylist(), group["sums"].to_pylist()):
        sums = np.frombuffer(sums, "<f4").astype(float)
        at = np.cumsum(unpacked(docs, len(sums)).astype(np.int64))
        if len(at) and at[-1] >= len(total):
            total = np.append(total, np.zeros(at[-1] + 1 - len(total)))
        total[at] += sums
    return pa.table({"row": pa.array(first + np.arange(len(total)), pa.int64()), "score": pa.array(total)})


def _held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % FOLDS == HELD_OUT


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    words, words_path = save(count_words(rows), "lm-words")
    n_train, types, n_all = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = math.log10(n_train + types + 1)  # of the base's denominator
    parts = max(1, -(-n_all // PART_TOKENS), min(SMALL_PARTS, n_all // SMALL_TOKENS))
    most, cut = head_of(words)
    head = spark.sparkContext.broadcast(most)
    root, share_root = new_path(spark, "lm-chunks"), new_path(spark, "lm-shares-of-parts")
    for path in (root, share_root):
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
    splits = splits_of(most)
    blocks = frequent.blocks_of(splits)
    written, written_path = save(write_chunks(rows, root, head, floor, parts, splits), "lm-documents")
    chunks = written.where(F.col("file").isNotNull()).select("file", "row", "offsets")

    found, found_path = save(followers(chunks, root, share_root, parts, blocks), "lm-followers", tidy=True)
    old, tasks = [found_path], min(parts, int(splits.sum()))
    counts = found.select(*frequent.COUNTED)
    if len(splits):
        first, first_path = save(frequent.opened(found, share_root, tasks), "lm-blocks", tidy=True)
        old.append(first_path)
        counts = counts.unionByName(first.select(*frequent.COUNTED))
    stats = dict(counts.where("part between -4 and -1").groupBy("part").agg(F.sum("k")).collect())  # 4 rows
    one_two = lambda a: discount(np.array([1, 2]), np.array([stats.get(a, 0), stats.get(a - 1, 0)]))
    d3, d2 = one_two(-1), one_two(-3)
    customers = counts.where(f"part >= 0 or part = {SHARED}").groupBy("hash").agg(F.sum("k").alias("k")).unionByName(head_customers(counts, head))
    seats, seats_path = save(words.join(customers, "hash", "left").select("word", "hash", F.coalesce("k", F.lit(0)).alias("k"), "c", "n"), "lm-seats")
    drop(spark, words_path)
    shares, shares_path = save(train(spark, seats), "lm-shares")
    old.append(shares_path)
    in_head = seats.where(F.col("n") >= cut).select("hash").join(shares, "hash").toArrow()  # at most HEAD_WORDS rows
    p_head = np.zeros(len(most.hashes))
    p_head[most.find(in_head["hash"].to_numpy().view(np.uint64))] = in_head["p"].to_numpy()
    tails, tails_path = save(found.where("part >= 0").join(shares, "hash").select("part", "hash", "p", "shared"), "lm-tails", tidy=True)
    p_head, known, more = spark.sparkContext.broadcast(p_head), {}, tails.select("part", "hash", "p")
    if len(splits):
        sweeps, known, swept = frequent.swept(found, first, tails, share_root, p_head, (d2, d3), blocks, tasks, old)
        more = more.unionByName(sweeps, allowMissingColumns=True)
    else:
        swept = old
    drop(spark, share_root)
    sums, sums_path = save(document_sums(chunks, root, p_head, more, (d2, d3), parts, blocks, spark.sparkContext.broadcast(known)), "lm-sums", tidy=True)
    drop(spark, root, tails_path, *swept)
    scores = sums.groupBy("row").applyInArrow(_summed, "row long, score double")
    c = F.col("c")
    rare = (
        written.where(F.col("hash").isNotNull())
        .select("row", "hash", "tf")
        .join(seats.where(F.col("n") < cut).select("hash", "c"), "hash")
        .groupBy("row")
        .agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * (F.log10(c + 1.0) - floor)).alias("more_base"))
    )
    return (
        written.where(F.col("n_tokens").isNotNull())
        .select("row", "key", "n_tokens", "n_known", "base")
        .join(rare, "row", "left")
        .join(scores, "row", "left")
        .select(
            F.col("key").alias(key),
            _held_out(F.col("key")).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(n_train).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; six sevenths of them train."""
    return score(table(spark, sf_dir, "documents"))
