"""Restaurants of frequent words before, seated by several parts together.

The long contexts (u2, u1) of a frequent u1 lie in several parts, but u1 has one restaurant, like every other word before.
Its dishes (u1, w) lie in blocks, by a hash of w. In each sweep parts reseat their long contexts and send the blocks how
many tables each dish has; blocks add them up as customers, reseat the dishes and send customers and tables back. The sums of
a whole restaurant (two numbers for each frequent word) go through the driver. Draws and formulas are those of
``contexts.Rooms``, so scores don't depend on which words are frequent.

What stays the same in all sweeps is written to files of the shared folder once; rows name them and carry the tables.
Homes of rows are parts (0 and more) or blocks (-1 - block); ``source`` is where a message comes from, -1 in a home's own row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, frugal, open_store, pack_piece, packed, save, unpack_piece
from tessera.llm.pitman_yor import STRENGTH, mix, pair, sample_tables

BURN_IN, SAMPLES = 2, 3
#: Ranks whose customers are counted in one row.
BLOCK = 1 << 14
#: Codes from here on are hashes of words outside the head.
TAIL = np.uint64(1 << 63)
#: The part of customers that blocks count.
SHARED = -5
COUNTED = {"part": pa.int32(), "hash": pa.int64(), "k": pa.int64(), "shared": pa.bool_(), "block": pa.int32(), "counts": pa.binary()}
STATE = {"home": pa.int64(), "source": pa.int64(), "file": pa.string(), "prices": pa.string(), "data": pa.binary(), "price": pa.binary(), "customers": pa.int64(), "tables": pa.int64()}
STATE_DDL = "home long, source long, file string, prices string, data binary, price binary, customers long, tables long"
FOUND_DDL = "part int, hash long, k long, shared boolean, block int, counts binary, " + STATE_DDL


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is found, in their order, and the number of each key's."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows by their first column, in whose order they come."""
    now, found = None, []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if key[lo] != now:
                if found:
                    yield now, pa.Table.from_batches(found)
                now, found = int(key[lo]), []
            found.append(batch.slice(lo, hi - lo))
    if found:
        yield now, pa.Table.from_batches(found)


def state(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(STATE))


def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with all columns of COUNTED and STATE."""
    fields = COUNTED | STATE
    return pa.RecordBatch.from_arrays([batch.column(f) if f in batch.schema.names else pa.nulls(batch.num_rows, t) for f, t in fields.items()], list(fields))


def counted(part: int, codes: np.ndarray, k: np.ndarray, shared: np.ndarray, stats: list[int]) -> Iterator[pa.RecordBatch]:
    """Customers ``k`` of words: a row for each outside the head, those of the head by blocks of ranks; stats as parts -1 to -4.

    ``shared``: whether the word follows a frequent one.
    """
    rare = codes >= TAIL
    n = int(rare.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(np.full(n, part), [-1, -2, -3, -4]), pa.int32()), pa.array(np.append(codes[rare].view(np.int64), [0] * 4)), pa.array(np.append(k[rare], stats)), pa.array(np.append(shared[rare], [False] * 4))],
        ["part", "hash", "k", "shared"],
    )
    ranks, k = codes[~rare].astype(np.int64), k[~rare]
    blocks = [(b, np.bincount(ranks[x] % BLOCK, k[x], BLOCK)) for b in np.unique(ranks // BLOCK).tolist() if (x := ranks // BLOCK == b).any()]
    counts = pa.array([packed(x.astype(np.uint64)) for _, x in blocks], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), counts], ["block", "counts"])


def put(root: str, name: str, *pieces: bytes) -> str:
    """Write pieces to a new file of the shared folder; its name."""
    store, folder = open_store(root)
    file = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{folder}/{file}") as f:
        f.write(struct.pack(f"<{len(pieces)}Q", *map(len, pieces)) + b"".join(pieces))
    return file


def take(root: str, file: str, columns: list[int]) -> list[list[np.ndarray]]:
    """Pieces of a file, each of so many columns."""
    store, folder = open_store(root)
    with store.open_input_file(f"{folder}/{file}") as f:
        data = f.read()
    ends = np.cumsum([8 * len(columns), *struct.unpack_from(f"<{len(columns)}Q", data)]).tolist()
    return [unpack_piece(data[a:b], n) for a, b, n in zip(ends, ends[1:], columns)]


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of numbers mostly in order, which pack tighter; sums of them give the numbers again."""
    return np.diff(ordered.astype(np.uint64), prepend=np.uint64(0))


def received(rows: pa.Table, column: str, columns: int) -> list[np.ndarray]:
    """Columns of the messages of a home, one after the other by source."""
    rows = rows.filter(pc.greater_equal(rows["source"], 0)).sort_by("source")
    found = [unpack_piece(x, columns) for x in rows[column].to_pylist()]
    return [np.concatenate([x[k] for x in found]) for k in range(columns)]


def own_row(rows: pa.Table) -> dict:
    return rows.filter(pc.equal(rows["source"], -1)).to_pylist()[0]


def blocks_of(splits: np.ndarray) -> np.ndarray:
    """Blocks of the dishes of frequent words: each has the dishes of four parts, if all are different."""
    return -(-splits.astype(np.int64) // 4).astype(np.uint64)


def p_of_words(w: np.ndarray, p_head: np.ndarray, hashes: np.ndarray, ps: np.ndarray) -> np.ndarray:
    """The probability without context of coded words: of ranks, or looked up by hash."""
    order = np.argsort(hashes)
    hashes, ps = hashes[order], ps[order]
    p1, rare = np.zeros(len(w)), w >= TAIL
    p1[~rare] = p_head[w[~rare].astype(np.int64)]
    p1[rare] = ps[np.searchsorted(hashes, w[rare])]
    return np.maximum(p1, 1e-300)


def p_short(u1: np.ndarray, c2: np.ndarray, t2: np.ndarray, p1: np.ndarray, d2: float, sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Predictive probability of w after u1, given customers and tables of whole restaurants by rank."""
    customers, tables = sums
    inverse = 1 / (STRENGTH + customers)
    return (c2.astype(np.int64) - d2 * t2) * inverse[u1] + ((STRENGTH + d2 * tables) * inverse)[u1] * p1


class Share:
    """A part's dishes of frequent words before: long ones (u1, u2, w) and, in the order of blocks, short ones (u1, w)."""

    def __init__(self, u1: np.ndarray, u2: np.ndarray, w: np.ndarray, c: np.ndarray, blocks: np.ndarray):
        self.c, room = c, mix(u1)
        long = pair(room, u2)
        self.dish3 = pair(long, w)
        rooms3, self.room3 = distinct(long)
        self.n3, self.again = len(rooms3), np.flatnonzero(c > 1)
        first, up = distinct(pair(room, w))
        block = u1[first] << np.uint64(32) | mix(w[first]) % blocks[u1[first].astype(np.int64)]
        order = np.lexsort((w[first], block))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.up, self.block, self.w = place[up], block[order], w[first[order]]
        self.t3 = np.minimum(c, 1)

    def rows(self, root: str, part: int) -> pa.RecordBatch:
        """Own row of the part, and messages where the blocks' words and first customers are (pieces of a file, which the own row
        names in place of prices)."""
        at = self.again
        fixed = np.bincount(self.room3, self.t3, self.n3) - np.bincount(self.room3[at], minlength=self.n3)
        again = pack_piece([x.astype(np.uint64) for x in (self.c[at], self.up[at], self.room3[at], self.dish3[at])])
        file = put(root, "share", again, pack_piece([steps(self.block)]), pack_piece([fixed.astype(np.uint64)]))
        c2, found = np.bincount(self.up, self.t3, len(self.w)).astype(np.uint64), runs(self.block)
        pieces = [pack_piece([steps(self.w[lo:hi]), c2[lo:hi]]) for _, lo, hi in found]
        words, ends = put(root, "words", *pieces), np.cumsum([8 * len(pieces), *map(len, pieces)]).tolist()
        out = [{"home": part, "source": -1, "file": file, "prices": words, "data": pack_piece([np.ones(len(at), np.uint64)])}]
        return state(out + [{"home": -1 - b, "source": part, "file": words, "data": struct.pack("<2Q", lo, hi)} for (b, _, _), lo, hi in zip(found, ends, ends[1:])])

    def averaged(self, rows: pa.Table, p1: np.ndarray, discounts: tuple[float, float], sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Predictive probabilities of the long dishes, averaged over the rows of the sweeps kept; ``p1`` of the long dishes."""
        d2, d3 = discounts
        short = np.empty(len(self.w))
        short[self.up] = p1
        u1, total = (self.block >> np.uint64(32)).astype(np.int64), np.zeros(len(self.c))
        inverse3 = (1 / (STRENGTH + np.bincount(self.room3, self.c, self.n3)))[self.room3]
        for sweep, known in sums.items():
            mine = rows.filter(pc.equal(rows["sweep"], sweep))
            self.t3[self.again] = unpack_piece(own_row(mine)["data"], 1)[0]
            p2 = p_short(u1, *received(mine, "data", 2), short, d2, known)
            tables = np.bincount(self.room3, self.t3, self.n3)
            total += (self.c - d3 * self.t3 + (STRENGTH + d3 * tables)[self.room3] * p2[self.up]) * inverse3
        return total / len(sums)


def runs(block: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, from, to) of ordered blocks."""
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return [(int(block[lo]), lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def by_home(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "home").sortWithinPartitions("home", "source")


def words_at(root: str, file: str, bounds: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words and first customers, of a piece of a file."""
    store, folder = open_store(root)
    lo, hi = struct.unpack("<2Q", bounds)
    with store.open_input_file(f"{folder}/{file}") as f:
        w, c2 = unpack_piece(f.read_at(hi - lo, lo), 2)
    return np.cumsum(w), c2


def opened(found: DataFrame, root: str, tasks: int) -> DataFrame:
    """Blocks from the first messages of parts: their own rows, messages back, and the customers their first tables send on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in grouped(batches):
            rows = rows.sort_by("source")
            parts, found = rows["source"].to_pylist(), [words_at(root, *x) for x in zip(rows["file"].to_pylist(), rows["data"].to_pylist())]
            first, at = distinct(words := np.concatenate([x[0] for x in found]))
            w, c2 = words[first], np.bincount(at, np.concatenate([x[1] for x in found]), len(first)).astype(np.uint64)
            of = np.repeat(np.array(parts, np.uint64), [len(x[0]) for x in found])
            file = put(root, "block", pack_piece([steps(w), c2]), pack_piece([of, steps(at)]))
            yield wide(state(list(served(home, of, at, c2, np.minimum(c2, 1), file, None))))
            for batch in counted(SHARED, w, np.minimum(c2, 1).astype(np.int64), np.ones(len(w), bool), [0, 0, *(int((c2 == n).sum()) for n in (1, 2))]):
                yield wide(batch)

    return by_home(found.where("home < 0").select(*STATE), tasks).mapInArrow(frugal(run), FOUND_DDL)


def served(home: int, of: np.ndarray, at: np.ndarray, c2: np.ndarray, t2: np.ndarray, file: str, prices: str | None) -> Iterator[dict]:
    """A block's own row, and messages with customers and tables to the parts."""
    c2, t2 = c2.astype(np.uint64), t2.astype(np.uint64)
    yield {"home": home, "source": -1, "file": file, "prices": prices, "data": pack_piece([t2]), "customers": int(c2.sum()), "tables": int(t2.sum())}
    for part, lo, hi in runs(of):
        yield {"home": part, "source": -1 - home, "data": pack_piece([c2[at[lo:hi]], t2[at[lo:hi]]])}


def reseated_parts(rows: DataFrame, root: str, p_head: object, discounts: tuple[float, float], number: int, sums: object) -> DataFrame:
    """Parts sweep their long contexts: their own rows, and messages with tables to the blocks (with prices in the first sweep)."""
    d2, d3 = discounts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in grouped(batches):
            own = rows.filter(rows["file"].is_valid())
            if not own.num_rows:
                continue  # words outside the head of a part without frequent words before
            own = own.to_pylist()[0]
            (c, up, room3, dish3), (block,), (fixed,) = take(root, own["file"], [4, 1, 1])
            c, up, room3, block = (x.astype(np.int64) for x in (c, up, room3, np.cumsum(block)))
            u1, blocks = block >> 32, runs(block)
            t3, prices = unpack_piece(own["data"], 1)[0].astype(np.int64), own["prices"]
            c2, t2 = received(rows, "data", 2)
            if number:
                p1 = take(root, prices, [1])[0][0].view(float)
            else:
                words, again = rows.filter(rows["hash"].is_valid()), np.bincount(up, minlength=len(block)) > 0
                w = np.concatenate([np.cumsum(x) for x, _ in take(root, prices, [2] * len(blocks))])
                p1 = p_of_words(w, p_head.value, words["hash"].to_numpy().view(np.uint64), words["p"].to_numpy())
                price = np.where(again | (c2 > 1), p1, 0)  # others are never reseated
                p1[~again] = 0
                prices = put(root, "prices", pack_piece([p1.view(np.uint64)]))
            p2 = p_short(u1, c2, t2, p1, d2, sums.value)
            tables = (fixed + np.bincount(room3, t3, len(fixed))).astype(np.int64)
            t3 = sample_tables(c, tables[room3] - t3, p2[up], d3, dish3, 2 * number)
            more = np.bincount(up, t3 - 1, len(block)).astype(np.uint64)
            out = [{"home": part, "source": -1, "file": own["file"], "prices": prices, "data": pack_piece([t3.astype(np.uint64)])}]
            for b, lo, hi in blocks:
                out.append({"home": -1 - b, "source": part, "data": pack_piece([more[lo:hi]]), "price": None if number else pack_piece([price[lo:hi].view(np.uint64)])})
            yield state(out)

    return rows.mapInArrow(frugal(run), STATE_DDL)


def reseated_blocks(rows: DataFrame, root: str, d2: float, number: int, sums: object) -> DataFrame:
    """Blocks add up their customers and sweep their dishes; parts' own rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in grouped(batches):
            if home >= 0:
                yield from rows.to_batches()
                continue
            own, u1 = own_row(rows), -1 - home >> 32
            (w, c2), (of, at) = take(root, own["file"], [2, 2])
            w, at, t2, prices = np.cumsum(w), np.cumsum(at).astype(np.int64), unpack_piece(own["data"], 1)[0].astype(np.int64), own["prices"]
            if number:
                p1 = take(root, prices, [1])[0][0].view(float)
            else:
                p1 = np.zeros(len(w))
                np.maximum.at(p1, at, received(rows, "price", 1)[0].view(float))
                prices = put(root, "prices", pack_piece([p1.view(np.uint64)]))
            c2 = c2.astype(np.int64) + np.bincount(at, received(rows, "data", 1)[0], len(w)).astype(np.int64)
            many = np.flatnonzero(c2 > 1)
            others, dish2 = int(sums.value[1][u1]) - t2[many], pair(mix(np.array([u1], np.uint64)), w[many])
            t2 = np.minimum(c2, 1)
            t2[many] = sample_tables(c2[many], others, p1[many], d2, dish2, 2 * number + 1)
            yield state(list(served(home, of, at, c2, t2, own["file"], prices)))

    return rows.mapInArrow(frugal(run), STATE_DDL)


def sums_of(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the restaurants of frequent words, by rank (two numbers a word)."""
    u1 = F.shiftright(-1 - F.col("home"), 32).alias("u1")
    found = rows.where("home < 0").groupBy(u1).agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).toArrow()
    out = np.zeros((2, words))
    for k, name in enumerate(("customers", "tables")):
        out[k, found["u1"].to_numpy()] = found[name].to_numpy()
    return out[0], out[1]


def swept(found: DataFrame, first: DataFrame, tails: DataFrame, root: str, p_head: object, discounts: tuple[float, float], blocks: np.ndarray, tasks: int, old: list[str]) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]], list[str]]:
    """Rows (part, source, data, sweep) of the sweeps kept, the sums of each, and the paths of their tables; ``old`` tables go after the first sweep."""
    spark = found.sparkSession
    now, homes = found.where("home >= 0").select(*STATE).unionByName(first.where("home is not null").select(*STATE)), int(blocks.sum())
    rows = now.where("home >= 0").unionByName(tails.where("shared").select(F.col("part").cast("long").alias("home"), "hash", "p"), allowMissingColumns=True)
    sums, kept, known, paths = sums_of(now, len(blocks)), [], {}, []
    for number in range(BURN_IN + SAMPLES):
        given = spark.sparkContext.broadcast(sums)
        sent = reseated_parts(by_home(rows, tasks), root, p_head, discounts, number, given).unionByName(now.where("home < 0"))
        now, path = save(reseated_blocks(by_home(sent, min(tasks, homes)), root, discounts[0], number, given), "lm-sweep", tidy=True)
        rows, sums = now.where("home >= 0"), sums_of(now, len(blocks))
        if old:
            drop(spark, *old)
        old = [path] if number < BURN_IN else []
        if number >= BURN_IN:
            known[number] = sums
            paths.append(path)
            kept.append(rows.select(F.col("home").cast("int").alias("part"), "source", "data", F.lit(number).alias("sweep")))
    both = kept[0]
    for more in kept[1:]:
        both = both.unionByName(more)
    return both, known, paths
