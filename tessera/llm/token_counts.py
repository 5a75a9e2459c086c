"""Token counts (8): edit-aware counting with a segment tree over each document's pre-tokens.

A document's pre-tokens lie in blocks; a segment tree over the blocks keeps sums of characters and tokens. An edit
(start, end, replacement) finds its place in the tree, takes back as many pre-tokens before it as its first characters
could be a lookahead of, and re-encodes from there until a pre-token ends where an old one ended beyond the edit: since
the pattern reads from left to right and remembers nothing, all later pre-tokens are the old ones. Only the changed
blocks and the sums on their way to the root are updated.

Trees are stored with their texts, a few bytes for each pre-token; a later run loads them and encodes only what its
edits touch. A very long text has a deeper tree; each is held whole by one task. An empty table gives an empty result.

A null text is the empty one. Edits outside a text are clipped to it. Special tokens' strings are cut and counted as in
the encoder. Repeated rows are counted one by one; other columns aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import MEMO_BYTES, PATTERN_LOOKAHEAD, TOKENIZER, Merges, pattern_for
from tessera.llm.common import MAX_ROWS_PER_SLICE, Memo, frugal, save, table

#: Pre-tokens of a block at most; a block of more is cut in two.
BLOCK = 64
#: Characters that are re-encoded at a time while looking for an old boundary.
REACH = 256
#: Edits (start, end, replacement) of a text by its key.
Edits = Callable[[str, int], list[tuple[int, int, str]]]


class Known(Memo):
    """Tokens of pre-tokens: looked up, or encoded and remembered."""

    def __init__(self, merges: Merges):
        super().__init__(MEMO_BYTES)
        self.merges = merges

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.merges.special else len(self.merges.merge(word.encode()))
        if len(word) <= 40:
            self.put(word, n, 32)
        return n


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, Known(merges)

    def __call__(self, word: str) -> int:
        return self.known[word]


@lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """One for each Python worker and all its tasks."""
    return Counter(Merges(path))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("u1") if not len(x) or x.max() < 256 else x.astype("<u4")


class CountTree:
    """Token counts of one text under edits.

    A block is an array of (characters, tokens) rows until an edit touches it, then a list of pairs.
    """

    def __init__(self, text: str, count: Counter):
        self.text, self.count, self.encoded = text, count, 0
        self.special = tuple(count.merges.special)
        whole = self._rows(text)
        self.encoded = 0
        self._plant([whole[k : k + BLOCK] for k in range(0, len(whole), BLOCK)] or [whole])

    def _rows(self, text: str) -> np.ndarray:
        """All pre-tokens of a text as rows."""
        if any(s in text for s in self.special):
            return np.array(self._cut(text, 0, True), np.int64).reshape(-1, 2)
        words = pattern_for(text).findall(text)
        out = np.empty((len(words), 2), np.int64)
        out[:, 0] = np.fromiter(map(len, words), np.int64, len(words))
        out[:, 1] = np.fromiter(map(self.count.known.__getitem__, words), np.int64, len(words))
        return out

    # pre-tokens are (characters, tokens)
    def _cut(self, text: str, start: int, whole: bool) -> list[tuple[int, int]]:
        """Pre-tokens of text[start:]; without ``whole`` only those that more text wouldn't change."""
        out, count = [], self.count
        while True:
            at, name = min(((p, s) for s in self.special if (p := text.find(s, start)) >= 0), default=(-1, ""))
            part = text[start : at if at >= 0 else len(text)]
            words = pattern_for(part).findall(part)
            settled = len(part) if whole or at >= 0 else len(part) - max(PATTERN_LOOKAHEAD, max(map(len, self.special), default=0))
            size = 0
            for w in words:
                size += len(w)
                if size > settled:
                    break
                out.append((len(w), count(w)))
            self.encoded += len(words)
            if at < 0:
                return out
            out.append((len(name), 1))
            start = at + len(name)

    def _plant(self, blocks: list) -> None:
        self.blocks = blocks
        self.width = 1 << max(0, (len(blocks) - 1).bit_length())
        sums = np.zeros((2 * self.width, 2), np.int64)
        if all(isinstance(b, np.ndarray) for b in blocks):
            ends = np.cumsum([0, *map(len, blocks)])
            upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.concatenate(blocks), axis=0)])
            sums[self.width : self.width + len(blocks)] = upto[ends[1:]] - upto[ends[:-1]]
        else:
            for k, b in enumerate(blocks):
                sums[self.width + k] = np.array(b, np.int64).reshape(-1, 2).sum(0)
        level = self.width
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2
        self.chars, self.tokens = sums[:, 0].tolist(), sums[:, 1].tolist()

    def _block(self, k: int) -> list[tuple[int, int]]:
        """A block as a list of pairs, from now on."""
        if isinstance(self.blocks[k], np.ndarray):
            self.blocks[k] = list(map(tuple, self.blocks[k].tolist()))
        return self.blocks[k]

    def _update(self, k: int) -> None:
        b, at = self._block(k), self.width + k
        self.chars[at], self.tokens[at] = sum(x[0] for x in b), sum(x[1] for x in b)
        while at > 1:
            at //= 2
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pretokens(self) -> int:
        return sum(map(len, self.blocks))

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, place in it, characters before) of the pre-token that holds character ``at``, or the end."""
        if at >= self.chars[1]:
            return len(self.blocks) - 1, len(self.blocks[-1]), self.chars[1]
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if at - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        block = k - self.width
        for place, (size, _) in enumerate(self._block(block)):
            if at - before < size:
                return block, place, before
            before += size
        raise AssertionError("sums and blocks disagree")

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by ``new``."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        reach = max(PATTERN_LOOKAHEAD, max(map(len, self.special), default=0))
        first, place, at = self._find(max(0, start - reach))
        while place == 0 and first > 0:  # one more, in case it ends just before
            first -= 1
            place = len(self.blocks[first])
        if place:
            place -= 1
            at -= self._block(first)[place][0]
        text = self.text[:start] + new + self.text[end:]
        shift, goal = len(new) - (end - start), start + len(new)
        size = goal - at + REACH
        while True:
            whole = at + size >= len(text)
            found = self._cut(text[at : at + size], 0, whole)
            stop, taken = at, 0
            match = None
            for k, (chars, _) in enumerate(found):
                stop += chars
                taken = k + 1
                if stop >= goal:
                    match = self._old_boundary(stop - shift)
                    if match:
                        break
            if match or whole:
                break
            size *= 2
        last, until = match if match else (len(self.blocks) - 1, len(self.blocks[-1]))
        merged = self._block(first)[:place] + found[:taken] + self._block(last)[until:]
        self.text = text
        if first == last and len(merged) <= 2 * BLOCK:
            self.blocks[first] = merged
            self._update(first)
        else:
            pieces = [merged[k : k + BLOCK] for k in range(0, len(merged), BLOCK)] or [[]]
            if len(pieces) <= last - first + 1:
                pieces += [[]] * (last - first + 1 - len(pieces))
                self.blocks[first : last + 1] = pieces
                for k in range(first, last + 1):
                    self._update(k)
            else:
                self._plant(self.blocks[:first] + pieces + self.blocks[last + 1 :])

    def _old_boundary(self, at: int) -> tuple[int, int] | None:
        """(block, place) of the old pre-token that begins at ``at``; None if none does."""
        block, place, before = self._find(at)
        return (block, place) if before == at else None


    def stored(self) -> bytes:
        """Characters and tokens of the pre-tokens, block by block: what load() makes the tree of without encoding."""
        sizes = np.fromiter(map(len, self.blocks), np.int64, len(self.blocks))
        rows = np.concatenate([np.asarray(b, np.int64).reshape(-1, 2) for b in self.blocks])
        parts = [_narrow(x) for x in (sizes, rows[:, 0], rows[:, 1])]
        head = struct.pack("<3I3B", *map(len, parts), *(x.itemsize for x in parts))
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.tobytes() for x in parts))

    @classmethod
    def load(cls, text: str, data: bytes, count: Counter) -> CountTree:
        """The tree of ``text`` as stored(); only sums are computed."""
        tree = cls.__new__(cls)
        tree.text, tree.count, tree.encoded, tree.special = text, count, 0, tuple(count.merges.special)
        raw = zstandard.ZstdDecompressor().decompress(data)
        *ns, a, b, c = struct.unpack_from("<3I3B", raw)
        at, found = struct.calcsize("<3I3B"), []
        for n, width in zip(ns, (a, b, c)):
            found.append(np.frombuffer(raw, "u1" if width == 1 else "<u4", n, at).astype(np.int64))
            at += n * width
        rows, ends = np.stack(found[1:], axis=1), np.cumsum(found[0]).tolist()
        if int(found[1].sum()) != len(text):
            raise ValueError("a stored tree doesn't belong to its text")
        tree._plant([rows[x:y] for x, y in zip([0, *ends], ends)])
        return tree


def sample_edits(text: str, key: int) -> list[tuple[int, int, str]]:
    """Three edits fixed by key and length: a deletion, an insertion and a replacement."""
    n = len(text)
    a, b, c = (key * 7919 + 1) % (n + 1), (key * 104729 + 7) % (n + 1), (key * 1299709 + 3) % (n + 1)
    return [(a, a + 5, ""), (b, b, " inserted words, it's 42"), (c, c + 9, "X" if key % 2 else "\n\n")]


def plant(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row: key, text, n_tokens, n_pretokens and the stored tree: save it, edit it later."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(public_tokenizers.path(tokenizer))
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part, rows = batch.slice(lo, MAX_ROWS_PER_SLICE), []
                for t in part.column(1).to_pylist():
                    tree = CountTree(t or "", count)
                    rows.append((tree.total, tree.pretokens, tree.stored()))
                n, words, trees = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(trees, pa.binary())], ["key", "text", "n_tokens", "n_pretokens", "tree"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(frugal(run), f"key {kind}, text string, n_tokens long, n_pretokens long, tree binary")


def edited(trees: DataFrame, edits: Edits = sample_edits, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows of plant(), or of this, after ``edits(text, key)``: texts, counts and trees, and the pre-tokens that were encoded anew."""
    kind = trees.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(public_tokenizers.path(tokenizer))
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part, rows = batch.slice(lo, MAX_ROWS_PER_SLICE), []
                for k, t, data in zip(*(part.column(c).to_pylist() for c in (0, 1, 2))):
                    tree = CountTree.load(t or "", data, count)
                    for edit in edits(t or "", k or 0):
                        tree.edit(*edit)
                    rows.append((tree.text, tree.total, tree.pretokens, tree.stored(), tree.encoded))
                columns = zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in columns)], ["key", "text", "n_tokens", "n_pretokens", "tree", "n_reencoded"])

    schema = f"key {kind}, text string, n_tokens long, n_pretokens long, tree binary, n_reencoded long"
    return trees.select("key", "text", "tree", F.col("n_tokens").alias("before"), F.col("n_pretokens").alias("words")).mapInArrow(frugal(_with(run)), schema + ", n_tokens_before long, n_pretokens_before long")


def _with(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with the counts before the edits beside its rows."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in run(iter([batch])):
                old = batch.slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, old.column(3), old.column(4)], [*out.schema.names, "n_tokens_before", "n_pretokens_before"])

    return both


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, edits: Edits = sample_edits) -> DataFrame:
    """One row per row: key, n_tokens, n_tokens_edited after ``edits(text, key)``, n_pretokens, n_reencoded.

    Trees are stored first; the edits are made on loaded trees, which encode only what they touch.
    """
    trees, _ = save(plant(docs, key, text, tokenizer), "count-trees")
    return edited(trees, edits, tokenizer).select(
        F.col("key").alias(key), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
        F.col("n_pretokens_before").alias("n_pretokens"), "n_reencoded",
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after three edits each."""
    return counted(table(spark, sf_dir, "documents"))
