r"""Phrase collocation mining (12): hierarchical naming of pairs, from words up to phrases of LONGEST words.

Texts are lower-cased (A-Z), split at `[.,;:!?\x0A-\x0D]` into pieces and those into words `[^\x20\x09]+`. Everything is
per lang (null: ``und``). A task packs its pieces into blocks of about BLOCK words: an array of the block's own numbers
of words, -1 between pieces, beside the block's distinct words with their counts.

Each level sums the distinct entries of the blocks over all blocks, puts those that are frequent (at least MIN_COUNT
times in the lang) under one id, the place of the first, and sends the ids home to the blocks. There the numbers of frequent
(k-1)-grams replace the former array, and two adjacent numbers make a k-gram: it is named by its pair of ids and counted
within the block. As no part of a frequent phrase is rarer than the phrase, nothing frequent is lost. What travels is one
row per block and distinct pair, once, and then the frequent ones; a pair that stands in every block is one row of each,
so no key is hot and no text is shuffled.

The pair is also a pair of pointers to the parents, the phrase without its last and without its first word. Following
them gives the words, the counts of all first and last parts for the cuts, and, as a longer phrase is never more
frequent than what it contains, the most frequent parent-child relation decides whether a phrase lies inside a longer one
with SUBSUMED % of its count.

A null text is the empty one. Repeated rows count each. A very long text is cut into blocks between pieces; a single
piece stays in one block. Ties in score and count are ordered by phrase (UTF-8 bytes); equal cuts by the smaller first
part. An empty table, or one without frequent phrases, gives an empty result. Columns other than lang and text aren't
read, whatever their names. Products are decimals of 38 digits, so no count passes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ROWS_PER_SLICE, drop, frugal, save, table

MIN_COUNT, LONGEST, SUBSUMED, SCALE, TOP = 30, 4, 80, 2_000_000, 2000
#: Words of a block: a block's arrays are all that a task holds.
BLOCK = 1 << 21
#: Parts in which a lang's best are found before they meet.
PARTS = 64
#: Letters become lower case, the marks between pieces a comma, tabs a space; every other byte stays.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz,,,,,,,,, ")

#: An entry's place: its block, and in the low bits its number there. A task numbers its blocks in 12 bits.
LOW, SEQUENCE = 31, 12

WORDS = "at long, lang string, word string, n long, block long, state binary"
PAIRS = "at long, left long, right long, n long"
BLOCKS = "block long, state binary, ids binary"


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the place of each in an array with one gap between pieces."""
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))
    _, offsets, data = texts.buffers()
    plain = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(bytes(data or b"").translate(_BYTES))])
    words = pc.split_pattern(pc.split_pattern(plain, ",").flatten(), " ")
    piece = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    flat, piece = flat.filter(real), piece[real.to_numpy(zero_copy_only=False)]
    gaps = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0) if len(piece) else piece
    return flat, np.arange(len(flat)) + gaps


class Block:
    """Words of the langs that a task has met since the last block."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[pa.DictionaryArray, np.ndarray]]] = {}
        self.words = 0

    def add(self, lang: str, texts: pa.Array) -> None:
        words, places = pieces_of(texts)
        if len(words):
            self.parts.setdefault(lang, []).append((words.dictionary_encode(), places))
            self.words += len(words)

    def rows(self, number: int) -> pa.RecordBatch:
        """A row for each distinct word, and one with the array of numbers."""
        langs, words, counts, states, base = [], [], [], [], 0
        for lang, parts in sorted(self.parts.items()):
            whole = pa.chunked_array([p for p, _ in parts]).unify_dictionaries()
            known = whole.chunk(0).dictionary
            count = np.zeros(len(known), np.int64)
            for chunk, (_, places) in zip(whole.chunks, parts, strict=True):
                local = chunk.indices.to_numpy()
                count += np.bincount(local, minlength=len(known))
                state = np.full(places[-1] + 2, -1, np.int32)
                state[places] = local + base
                states.append(state)
            langs += [lang] * len(known)
            words.append(known)
            counts.append(count)
            base += len(known)
        self.parts, self.words = {}, 0
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array((number << LOW) + np.arange(base)), pa.nulls(1, pa.int64())]),
                pa.array([*langs, None], pa.string()),
                pa.concat_arrays([*words, pa.nulls(1, words[0].type)]),
                pa.concat_arrays([pa.array(np.concatenate(counts)), pa.nulls(1, pa.int64())]),
                pa.concat_arrays([pa.nulls(base, pa.int64()), pa.array([number])]),
                pa.concat_arrays([pa.nulls(base, pa.binary()), pa.array([np.concatenate(states).tobytes()], pa.binary())]),
            ],
            ["at", "lang", "word", "n", "block", "state"],
        )


def word_blocks(docs: DataFrame, lang: str, text: str, size: int = BLOCK) -> DataFrame:
    """WORDS: blocks of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << SEQUENCE
        number = first
        block = Block()
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part = batch.slice(lo, MAX_ROWS_PER_SLICE)
                codes = part.column(0).dictionary_encode()
                for code, name in enumerate(codes.dictionary.to_pylist()):
                    block.add(name, part.column(1).filter(pc.equal(codes.indices, code)))
                if block.words >= size and number - first < (1 << SEQUENCE) - 1:
                    yield block.rows(number)
                    number += 1
        if block.words:
            yield block.rows(number)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(frugal(run), WORDS)


def adjacent(state: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left * known + right) of adjacent numbers, their counts, and the pair's number at each place or -1."""
    first, second = state[:-1].astype(np.int64), state[1:]
    both = (first >= 0) & (second >= 0)
    pairs, number, counts = np.unique(first[both] * known + second[both], return_inverse=True, return_counts=True)
    places = np.full(len(both), -1, np.int64)
    places[both] = number
    return pairs, counts, places


def pairs_of(blocks: DataFrame) -> DataFrame:
    """PAIRS: the distinct pairs of adjacent numbers of BLOCKS, by the ids that the numbers stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, state, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                pairs, counts, _ = adjacent(np.frombuffer(state, np.int32), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((block << LOW) + np.arange(len(pairs))), pa.array(ids[pairs // len(ids)]), pa.array(ids[pairs % len(ids)]), pa.array(counts.astype(np.int64))],
                    ["at", "left", "right", "n"],
                )

    return blocks.mapInArrow(frugal(run), PAIRS)


def renamed(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """BLOCKS with the numbers of frequent entries only; ``named`` has at and id of these.

    Entries are the numbers in ``blocks`` themselves where they have no ids yet (words), else pairs of adjacent ones.
    """

    def run(key: tuple, states: pa.Table, names: pa.Table) -> pa.Table:
        if not states.num_rows or not names.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "state": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
        state, ids = np.frombuffer(states.column("state")[0].as_py(), np.int32), states.column("ids")[0].as_py()
        if ids is not None:
            state = adjacent(state, len(ids) // 8)[2]
        local, name = names.column("local").to_numpy(), names.column("id").to_numpy()
        order = np.argsort(name)
        local, name = local[order], name[order]
        rank = np.full(max(state.max(), local.max()) + 2, -1, np.int32)  # the last entry stands for -1
        rank[local] = np.arange(len(local), dtype=np.int32)
        new = rank[state]
        new = new[(new >= 0) | (np.append(np.int32(-1), new[:-1]) >= 0)]  # one -1 of each run
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([new.tobytes()], pa.binary()), "ids": pa.array([name.tobytes()], pa.binary())})

    homes = named.select(F.shiftright("at", LOW).alias("home"), F.col("at").bitwiseAND((1 << LOW) - 1).alias("local"), "id")
    return blocks.groupBy("block").cogroup(homes.groupBy("home")).applyInArrow(run, BLOCKS)


def frequent(entries: DataFrame, key: list[str], least: int) -> DataFrame:
    """key, at, id, a: entries that occur ``least`` times or more in all blocks, that count, and where the first stands.

    A window's rows of a key are at most one of each block, and are spilled if many.
    """
    whole = Window.partitionBy(*key)
    return entries.withColumns({"a": F.sum("n").over(whole), "id": F.min("at").over(whole)}).where(F.col("a") >= least).drop("n")


def described(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of one more word: id, lang, phrase, last, a, first parts' and last parts' counts by length, parents."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("lead"), F.array_append("firsts", F.col("a")).alias("firsts"))
    right = shorter.select(F.col("id").alias("right"), "last", F.array_append("lasts", F.col("a")).alias("lasts"))
    return pairs.join(left, "left").join(right, "right").select(
        "id", "lang", F.concat_ws(" ", "lead", "last").alias("phrase"), "last", "a", "firsts", "lasts", "left", "right"
    )


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(phrases: DataFrame, words: int, scale: int = SCALE) -> DataFrame:
    """``phrases`` of ``words`` words with l, r and score of the lowest-scoring cut."""
    cuts = []
    for k in range(1, words):
        l, r = F.get("firsts", F.lit(k - 1)), F.get("lasts", F.lit(words - k - 1))
        score = F.call_function("div", F.lit(scale).cast("decimal(18,0)") * _wide(F.col("a")), _wide(l) + _wide(r))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return phrases.withColumn("cut", F.array_min(F.array(*cuts))).select("*", "cut.score", "cut.l", "cut.r").drop("cut")


def uncovered(phrases: DataFrame, longer: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """``phrases`` that no phrase of one more word holds with ``share`` % of their count."""
    inside = longer.select(F.col("left").alias("id"), F.col("a").alias("held")).unionByName(longer.select(F.col("right").alias("id"), F.col("a").alias("held")))
    most = inside.groupBy("id").agg(F.max("held").alias("held"))
    return phrases.join(most, "id", "left").where(F.col("held").isNull() | (_wide(F.col("held")) * 100 < _wide(F.col("a")) * share)).drop("held")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, share: int = SUBSUMED, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """The best ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    blocks, words_path = save(word_blocks(docs, lang, text, size), "phrase-words", tidy=True)
    entries = blocks.where("at IS NOT NULL").select("at", "lang", "word", "n")
    totals, _ = save(entries.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals", tidy=True)
    blocks = blocks.where("state IS NOT NULL").select("block", "state", F.lit(None).cast("binary").alias("ids"))
    nothing, key, old = F.array().cast("array<bigint>"), ["lang", "word"], [words_path]
    levels: list[DataFrame] = []
    for words in range(1, longest + 1):
        if words == longest:
            names = entries.groupBy(*key).agg(F.sum("n").alias("a"), F.min("at").alias("id")).where(F.col("a") >= least)
        else:
            found, rows_path = save(frequent(entries, key, least), f"phrase-entries-{words}", tidy=True)
            names = found.where("at = id").select(*key, "a", "id")
        if words == 1:
            levels.append(save(names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", nothing.alias("firsts"), nothing.alias("lasts")), "phrase-level-1", tidy=True)[0])
        else:
            levels.append(save(described(names, levels[-1]), f"phrase-level-{words}", tidy=True)[0])
        if words < longest:
            blocks, path = save(renamed(blocks, found.select("at", "id")), f"phrase-blocks-{words}", tidy=True)
            drop(spark, rows_path, *old)
            entries, key, old = pairs_of(blocks), ["left", "right"], [path]
    drop(spark, *old)
    kept = [scored(uncovered(level, longer, share), n, scale) for n, (level, longer) in enumerate(zip(levels[1:], levels[2:]), 2)]
    kept.append(scored(levels[-1], longest, scale))
    every = reduce(DataFrame.unionByName, [k.select("lang", "phrase", "a", "l", "r", "score") for k in kept])
    return best(every, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang: first of PARTS parts by hash, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    some = found.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each lang of all documents."""
    return mine(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
u AS MATERIALIZED (SELECT id, lang, unnest(range(len(ws))) AS i, unnest(ws) AS w1 FROM w),
v AS MATERIALIZED (SELECT lang, w1, w1 || ' ' || lead(w1) OVER o AS w2, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o AS w3, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o AS w4
  FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, 1 AS m, w1 AS phrase FROM v UNION ALL SELECT lang, 2, w2 FROM v UNION ALL SELECT lang, 3, w3 FROM v UNION ALL SELECT lang, 4, w4 FROM v) WHERE phrase IS NOT NULL GROUP BY ALL HAVING m = 1 OR count(*) >= {MIN_COUNT}),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
y AS MATERIALIZED (SELECT *, array_to_string(ws[:k], ' ') AS lead, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
x AS (SELECT y.lang, y.m, y.phrase, y.a, min({{'score': ({SCALE}::HUGEINT * y.a) // (l.a + r.a), 'k': k, 'l': l.a, 'r': r.a}}) AS cut
  FROM y JOIN f l ON l.lang = y.lang AND l.phrase = y.lead JOIN f r ON r.lang = y.lang AND r.phrase = y.rest GROUP BY ALL),
h AS (SELECT lang, phrase, max(a) AS held FROM (SELECT lang, a, array_to_string(ws[i:i + b - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - b + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS b FROM c))) GROUP BY ALL),
k AS (SELECT x.lang, x.phrase, a, cut.l AS l, cut.r AS r, cut.score::BIGINT AS score FROM x LEFT JOIN h ON h.lang = x.lang AND h.phrase = x.phrase WHERE held IS NULL OR 100 * held < {SUBSUMED} * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN t USING (lang)) WHERE rank <= {TOP}
"""
