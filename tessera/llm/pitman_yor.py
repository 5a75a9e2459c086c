"""LM scoring (9): a hierarchical Pitman-Yor model with Chinese-restaurant seating sampled by Gibbs.

Restaurants, from the longest context: the two words before (u2, u1); the word before (u1), parent of all (u2, u1); the
word restaurant without context, parent of all u1; and the spelling model, parent of that: byte restaurants for every
context of two bytes, one byte and none, over 256 uniform bytes. A word is spelled as its bytes and a space; the end of a
text is the word 0xFF, which no UTF-8 text holds, and texts begin as if after two ends. So the model is a distribution
over all byte strings: a word that no training text holds has the probability of its own spelling, backed off to.

Tables of a restaurant are the customers of its parent. Seating begins with one table per dish; the word restaurant
takes its customers from that (one for each word and word before it), and is swept together with the spelling model.
Then the context restaurants are swept given the words' probabilities (module `contexts`). A sweep reseats all dishes of
a level at once, given the tables of the sweep before: the number of tables of a dish of c customers is drawn exactly (by
generalized Stirling numbers) up to EXACT customers; beyond, customers are seated in blocks of at most a twentieth of
those seated, by the expected number of tables rounded at random. Predictive probabilities of words are averaged over the
sweeps after burn-in. Discounts are estimated from singletons and doubletons, strengths are STRENGTH. Draws are hashes of
dish and sweep, so that scores depend neither on partitions nor on batches, and a lost task gives the same again.

What grows with the corpus stays distributed: word counts are a table; context restaurants are built in parts, by the
word before. The spelling model has at most 2**24 entries. The HEAD_WORDS most frequent words (a fixed bound) go to the
executors for short codes and quick look-up; all other words meet the word table in a join, so counts are exact.

A null, empty or blank text is the end token alone. Rows with a null key are scored and train as the key 'null'.
Repeated rows are scored (and counted) one by one. Very long texts are whole. With no training rows every token is
unknown. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import frugal, save

FOLDS, HELD_OUT = 7, 2
END = b"\xff"
STRENGTH = 1.0
#: Sweeps of the word restaurant; in each the spelling restaurants are swept SPELL_SWEEPS times.
BURN_IN, SAMPLES, SPELL_SWEEPS = 1, 2, 3
EXACT, PRODUCTS = 64, 16
SEED = 20240101
#: Words that are looked up where the texts are (32 bytes each).
HEAD_WORDS = 1 << 19
#: Rows and bytes of texts that are split at a time; a longer text is split alone.
SLICE_ROWS, SLICE_BYTES = 8192, 8 << 20
#: Words a task counts before it hands its counts on.
TASK_WORDS = 500_000
CONTEXTS = 1 << 16


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of SLICE_ROWS rows and SLICE_BYTES of texts (its second column) at most."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Tokens of texts, one after the other: number of each one's word, the words by number, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = lists.flatten().dictionary_encode()
    words, sizes = coded.dictionary.cast(pa.binary()), pc.list_value_length(lists).to_numpy()
    ids = coded.indices.to_numpy().astype(np.int64)
    blank = pc.index(words, pa.scalar(b"", pa.binary())).as_py()  # the one piece of a text without words
    if blank >= 0:
        texts_of = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(texts_of[ids != blank], minlength=len(sizes))
        ids = ids[ids != blank]
    sizes = sizes.astype(np.int64) + 1
    with_ends = np.full(len(ids) + len(sizes), len(words))
    words_at = np.ones(len(with_ends), bool)
    words_at[np.cumsum(sizes) - 1] = False
    with_ends[words_at] = ids
    return with_ends, pa.concat_arrays([words, pa.array([END], pa.binary())]), sizes


def is_held_out(key: object) -> bool:
    return zlib.crc32(("null" if key is None else str(key)).encode()) % FOLDS == HELD_OUT


@lru_cache(maxsize=64)
def log_stirling(d: float, top: int = EXACT) -> np.ndarray:
    """log S_d(c, t): weights of seatings of c customers at t tables; row c, column t."""
    s = np.zeros((top + 1, top + 1))
    s[0, 0] = 1.0
    for c in range(1, top + 1):
        for t in range(1, c + 1):
            s[c, t] = s[c - 1, t - 1] + (c - 1 - d * t) * s[c - 1, t]
    with np.errstate(divide="ignore"):
        return np.log(s)


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired(mixed: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of pairs, in this order, whose first numbers are mixed."""
    return mix(mixed ^ (np.atleast_1d(np.asarray(b, np.uint64)) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs, in this order."""
    return paired(mix(a), b)


def fraction(hashed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((hashed >> np.uint64(11)) + 0.5) * 2.0**-53


def uniform(dish: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1), fixed by dish and draw."""
    return fraction(pair(dish, draw))


def sample_tables(c: np.ndarray, others: np.ndarray, p0: np.ndarray, d: float, dish: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes (by hash) with ``c`` customers, given ``others`` tables in their rooms and parent probability ``p0``."""
    t = np.minimum(c, 1).astype(np.int64)
    low = 1
    while low < EXACT:
        high = 2 * low
        members = np.flatnonzero((c > low) & (c <= high))
        for lo in range(0, len(members), 1 << 16):
            few = members[lo : lo + (1 << 16)]
            if high <= PRODUCTS:  # products of at most so many factors stay within floats
                weight = np.exp(log_stirling(d))[c[few], 1 : high + 1]
                weight[:, 1:] *= np.cumprod((STRENGTH + d * (others[few, None] + np.arange(1, high))) * p0[few, None], axis=1)
            else:
                tables = np.arange(1, high + 1)
                rising = np.cumsum(np.log(STRENGTH + d * (others[few, None] + tables - 1)), axis=1)
                weight = log_stirling(d)[c[few], 1 : high + 1] + rising + tables * np.log(p0[few, None])
                weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            ends = np.cumsum(weight, axis=1)
            t[few] = 1 + (ends < (uniform(dish[few], sweep << 8) * ends[:, -1])[:, None]).sum(axis=1)
        low = high
    many = np.flatnonzero(c > EXACT)
    many = many[np.argsort(-c[many], kind="stable")]  # so those with customers left come first
    most, other, p, own = c[many].astype(np.int64), others[many], p0[many], mix(dish[many])
    tables, seated, step = np.ones(len(many), np.int64), 1, 0
    while n := int(np.searchsorted(-most, -seated)):
        block, step = np.minimum(most[:n] - seated, max(1, seated // 20)), step + 1
        new = (STRENGTH + d * (other[:n] + tables[:n])) * p[:n]
        expected = block * new / (new + np.maximum(seated - d * tables[:n], 1e-12))
        u = fraction(paired(own[:n], (sweep << 8 | 255) + (step << 20)))
        tables[:n] += np.minimum(block, np.floor(expected + u).astype(np.int64))
        seated += max(1, seated // 20)
    t[many] = tables
    return t


def discount(c: np.ndarray, n: np.ndarray | None = None) -> float:
    n1, n2 = (int((c == k).sum()) if n is None else int(n[c == k].sum()) for k in (1, 2))
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Spelling:
    """Byte restaurants of contexts of 2, 1 and 0 bytes; ``customers`` by byte triples, bounded by 2**24."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.c = [keys[order]], [customers[order]]
        self.parent_of = []
        for size in (1 << 16, 1 << 8):
            up, at = np.unique(self.keys[-1] % size, return_inverse=True)
            self.keys.append(up)
            self.parent_of.append(at)
        self.t = [np.minimum(self.c[0], 1)]
        for at, up in zip(self.parent_of, self.keys[1:]):
            self.c.append(np.bincount(at, self.t[-1], len(up)).astype(np.int64))
            self.t.append(np.minimum(self.c[-1], 1))

    def sweep(self, number: int) -> None:
        """Reseat all customers, longest contexts first; tables send customers to the parent."""
        predictive = self.entries()
        for level in range(3):
            c, t = self.c[level], self.t[level]
            room = self.keys[level] >> 8
            rooms, at = np.unique(room, return_inverse=True)
            total = np.bincount(at, t, len(rooms)).astype(np.int64)
            p0 = predictive[level + 1][self.parent_of[level]] if level < 2 else np.full(len(c), 1 / 256)
            dish = self.keys[level].astype(np.uint64) + np.uint64(level << 32)
            self.t[level] = sample_tables(c, total[at] - t, p0, discount(c), dish, number)
            if level < 2:
                self.c[level + 1] = np.bincount(self.parent_of[level], self.t[level], len(self.c[level + 1])).astype(np.int64)

    def _rooms(self, level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Share of each dish's own seats, and of the parent, by restaurant; arrays over all n restaurants."""
        room = (self.keys[level] >> 8).astype(np.int64)
        c, t, d = self.c[level], self.t[level], discount(self.c[level])
        customers, tables = np.bincount(room, c, n), np.bincount(room, t, n)
        return (c - d * t) / (STRENGTH + customers[room]), (STRENGTH + d * tables) / (STRENGTH + customers)

    def entries(self) -> list[np.ndarray]:
        """Predictive probability of each dish in each level, on the entries in use."""
        out: list[np.ndarray] = [np.array([])] * 3
        for level, n in ((2, 1), (1, 256), (0, CONTEXTS)):
            own, back = self._rooms(level, n)
            up = out[level + 1][self.parent_of[level]] if level < 2 else 1 / 256
            out[level] = own + back[(self.keys[level] >> 8).astype(np.int64)] * up
        return out

    def table(self) -> SpellTable:
        """What predicts every byte in every context of two bytes."""
        p = np.full(256, 1 / 256)
        for level, n in ((2, 1), (1, 256)):
            own, back = self._rooms(level, n)
            p = np.repeat(back, 256) * np.tile(p, n)
            p[self.keys[level].astype(np.int64)] += own
        own, back = self._rooms(0, CONTEXTS)
        return SpellTable(self.keys[0].astype(np.int64), own.astype(np.float32), back.astype(np.float32), p.astype(np.float32))


@dataclass(frozen=True)
class SpellTable:
    """Own share of the byte triples in use (sorted, at most 2**24), back-off of each context, and its parent's table."""

    keys: np.ndarray
    own: np.ndarray
    back: np.ndarray
    parent: np.ndarray

    def p(self, triples: np.ndarray) -> np.ndarray:
        out = self.back[triples >> 8] * self.parent[triples & 0xFFFF].astype(np.float64)
        at = np.minimum(np.searchsorted(self.keys, triples), len(self.keys) - 1)
        return out + np.where(self.keys[at] == triples, self.own[at], 0)


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte triples of the spellings of words, and where each word's begin."""
    flat = np.frombuffer(b"  " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    triples = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(size + 1) - (size + 1)
    keep = np.ones(len(triples), bool)
    keep[starts[1:] - 1] = False
    return triples[keep], np.cumsum(size) - size


def spelled(tables: list[SpellTable], words: list[bytes]) -> np.ndarray:
    """Probability of each word's spelling: the mean over the tables."""
    if not words:
        return np.array([])
    triples, starts = spell(words)
    distinct, at = np.unique(triples, return_inverse=True)
    return sum(10.0 ** np.add.reduceat(np.log10(t.p(distinct))[at], starts) for t in tables) / len(tables)


def word_hash(words: list[bytes]) -> np.ndarray:
    """What F.xxhash64 gives for the words, with the highest bit set: no rank of a word is as large."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in words), np.uint64, len(words)) | np.uint64(1 << 63)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, hash, c, n): training tokens and all tokens of each word of (key, text); tasks hand on summed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []

        def add() -> pa.Table:
            total = pa.concat_tables(found).group_by("word").aggregate([("c", "sum"), ("n", "sum")])
            return total.select(["word", "c_sum", "n_sum"]).rename_columns(["word", "c", "n"])

        for batch in batches:
            for part in slices(batch):
                ids, words, sizes = tokens(part.column(1))
                trains = np.array([not is_held_out(k) for k in part.column(0).to_pylist()])
                c, n = (np.bincount(x, minlength=len(words)) for x in (ids[np.repeat(trains, sizes)], ids))
                found.append(pa.table({"word": words, "c": c, "n": n}).filter(n > 0))
                if sum(x.num_rows for x in found) > 2 * TASK_WORDS:
                    found = [add()]
                    if found[0].num_rows > TASK_WORDS:
                        yield from found.pop().to_batches()
        if found:
            yield from add().to_batches()

    counted = rows.mapInArrow(frugal(run), "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    return counted.select("word", F.xxhash64("word").bitwiseOR(F.lit(-(1 << 63))).alias("hash"), "c", "n")


def word_tables(names: list[bytes], hashes: np.ndarray, c: np.ndarray, spelling: list[SpellTable], d: float, tables: int, sweep: int) -> np.ndarray:
    """Tables of words in a sweep, given the spelling model and the number of tables of the sweep before."""
    t, again = np.minimum(c, 1), np.flatnonzero(c > 1)
    if len(again):
        p0 = np.maximum(spelled(spelling, [names[k] for k in again]), 1e-300)
        t[again] = sample_tables(c[again], np.full(len(again), tables - 1), p0, d, hashes[again], sweep)
    return t


def _seated(words: DataFrame, d: float, sweep: int, spelling: object | None, tables: int) -> DataFrame:
    """(word, t): tables of each word with customers in a sweep; one each in sweep 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, k = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            hashes = batch.column(1).to_numpy().view(np.uint64)
            t = np.minimum(k, 1) if spelling is None else word_tables(names, hashes, k, spelling.value, d, tables, sweep)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.int64())], ["word", "t"])

    return words.where("k > 0").select("word", "hash", "k").mapInArrow(frugal(run), "word binary, t long")


def _spelling_counts(seated: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Customers of the spelling model by byte triple (at most 2**24), and the number of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tables = {}, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            if not names:
                continue
            t = batch.column(1).to_numpy()
            tables += int(t.sum())
            triples, starts = spell(names)
            weight = np.repeat(t, np.diff(np.append(starts, len(triples))))
            keys, at = np.unique(triples, return_inverse=True)
            for k, n in zip(keys.tolist(), np.bincount(at, weight).astype(np.int64).tolist()):
                total[k] = total.get(k, 0) + n
        keys = [*total, -1]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*total.values(), tables], pa.int64())], ["key", "n"])

    rows = seated.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most 2**24 + 1 rows
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    real = keys >= 0
    return keys[real], n[real], int(n[~real].sum())


def train(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(hash, p) of each of the words (word, hash, k customers): its probability without context, averaged over sweeps."""
    n, types, n1, n2 = words.agg(
        F.coalesce(F.sum("k"), F.lit(0)), F.count_if(F.col("k") > 0), F.count_if(F.col("k") == 1), F.count_if(F.col("k") == 2)
    ).first()
    d = discount(np.array([1, 2]), np.array([n1, n2]))
    given, tables, kept, drawn, back = None, types, [], [], []
    for sweep in range(BURN_IN + SAMPLES if types else 0):
        before = tables
        keys, customers, tables = _spelling_counts(_seated(words, d, sweep, given, before))
        spelling = Spelling(keys, customers)
        for k in range(SPELL_SWEEPS):
            spelling.sweep(sweep * SPELL_SWEEPS + k)
        if sweep >= BURN_IN:
            drawn.append(spelling.table())
            back.append((STRENGTH + d * tables) / (n + STRENGTH))
            kept.append((sweep, given, before))
        given = spark.sparkContext.broadcast([spelling.table()])
    share = sum(back) / len(back) if back else 1.0
    drawn = drawn or [SpellTable(np.array([-1]), np.zeros(1, np.float32), np.ones(CONTEXTS, np.float32), np.full(CONTEXTS, 1 / 256, np.float32))]
    final = spark.sparkContext.broadcast(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, k = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            hashes, own = batch.column(1).to_numpy().view(np.uint64), np.zeros(len(names))
            for sweep, before, tables in kept:
                own += (k - d * word_tables(names, hashes, k, before.value, d, tables, sweep)) / (n + STRENGTH) / len(kept)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own + share * spelled(final.value, names))], ["hash", "p"])

    return words.select("word", "hash", "k").mapInArrow(frugal(run), "hash long, p double")


@dataclass(frozen=True)
class Head:
    """The most frequent words: ``hashes`` sorted, with ``rank`` of each; ``c`` and ``n`` by rank."""

    hashes: np.ndarray
    rank: np.ndarray
    c: np.ndarray
    n: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1)


def head_of(words: DataFrame, size: int | None = None) -> tuple[Head, int]:
    """The words with at least ``cut`` tokens, at most ``size`` of them, and the cut."""
    by_count = words.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().collect()  # at most 2**20 rows
    left, cut = HEAD_WORDS if size is None else size, 1 << 62
    for n, rows in sorted(map(tuple, by_count), reverse=True):
        left -= rows
        if left < 0:
            break
        cut = n
    found = words.where(F.col("n") >= cut).select("hash", "c", "n").toArrow()  # at most ``size`` rows
    hashes, c, n = found["hash"].to_numpy().view(np.uint64), found["c"].to_numpy(), found["n"].to_numpy()
    order = np.lexsort((hashes, -n))  # by rank
    hashes, c, n = hashes[order], c[order], n[order]
    by_hash = np.argsort(hashes)
    return Head(hashes[by_hash], by_hash, c, n), cut


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of training and held-out rows, of the model and of the base."""
    per = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("model"), per("base_score").alias("base"), F.count(F.lit(1)).alias("rows"))
