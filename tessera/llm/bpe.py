"""BPE encoding and decoding (5): a bounded-lookahead streaming transducer over byte-level merges.

A merge list has a *sufficient lookahead*: a number of bytes such that, once so many bytes beyond a token are
known, nothing that follows can change the token. `sufficient_lookahead` computes a bound from the list: text to
the right can undo the merge (u, v) only through an earlier merge (x, y) whose left part ends where v ends, and
that one only through a still earlier merge, so the bound is the heaviest chain of such merges by bytes of y.
`WordStream` holds at most a few lookaheads of bytes of a pre-token and emits tokens as soon as they are stable; it
remembers what it emitted for short pre-tokens, in a memo of bounded bytes. `TextEncoder` cuts a text, fed in pieces,
into pre-tokens in the same way; `TextDecoder` is the inverse: a state machine from ids to text that keeps at most an
unfinished UTF-8 sequence. Every text takes this way, in pieces of PIECE characters; a pre-token that outgrows half a
piece is fed to its stream as it arrives. Memory doesn't grow with the text, however long.

A null text is the empty one: no ids. Strings of special tokens in a text become their ids, as the tokenizer
file's flags say. Repeated rows, ties and other columns don't matter: each text is encoded by itself. An empty table
gives an empty result. The table of newer characters is for the Unicode version in NEW_UNICODE: with another version of
`regex`, `check_unicode` refuses to run rather than cut such characters differently.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ROWS_PER_SLICE, Generations, Memo, frugal, table

TOKENIZER = "byte_bpe_50k.json"
#: Characters fed at once; any other number gives the same ids.
PIECE = 1 << 13
#: Bytes that a worker's memo of pre-tokens takes.
MEMO_BYTES = 48 << 20
#: Ids are below 2**BITS; NEVER is beyond every rule.
BITS = 20
MASK, NEVER = (1 << BITS) - 1, 1 << 62
#: White space as the tokenizer's pattern understands it.
WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers of Unicode 17, which the tokenizer's pattern (Unicode 16) doesn't know as such.
TOO_NEW = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1"
    "\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee"
    "\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f"
    "\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff"
    "\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2"
    "\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed"
    "\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479"
)
#: Characters that a match may look at beyond its end: a quote, up to two letters.
PATTERN_LOOKAHEAD = 3


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pretoken_pattern(letter: str, number: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{WS}\p{{L}}\p{{N}}]+"
        rf"|[{WS}]+(?![^{WS}])|[{WS}]+"
    )


_PLAIN = regex.compile(pretoken_pattern(r"\p{L}", r"\p{N}"))
_EXACT = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{TOO_NEW}]]+| ?[\p{{N}}--[{TOO_NEW}]]+"
    rf"| ?(?:[^{WS}\p{{L}}\p{{N}}]|[{TOO_NEW}])+|[{WS}]+(?![^{WS}])|[{WS}]+"
)
_NEW = regex.compile(f"[{TOO_NEW}]")
#: A letter that Unicode 17 has and Unicode 16 hasn't: what TOO_NEW was taken from.
NEW_UNICODE = "\u088f"
_KINDS = tuple(
    regex.compile(x)
    for x in (
        rf"(?V1)[\p{{L}}--[{TOO_NEW}]]*",
        rf"(?V1)[\p{{N}}--[{TOO_NEW}]]*",
        rf"(?V1)(?:[^{WS}\p{{L}}\p{{N}}]|[{TOO_NEW}])*",
        rf"[{WS}]*",
    )
)


#: Texts with none of these have Latin letters up to U+017E and plain white space alone; `re` cuts those faster.
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\u012f\u0131-\u017e]")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017e"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(
    f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{DIGITS}]+| ?[^\\t\\n\\r {LETTERS}{DIGITS}]+"
    "|[\\t\\n\\r ]+(?![^\\t\\n\\r ])|[\\t\\n\\r ]+"
)


def pattern_for(text: str) -> re.Pattern | regex.Pattern:
    """The fastest pattern that cuts this text as the tokenizer does."""
    if not OTHER.search(text):
        return _LATIN
    return _EXACT if _NEW.search(text) else _PLAIN


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token that settle it: the heaviest chain of ever earlier merges, each able to undo the one before.

    The merge (x, y) can undo a later (u, v) if x and v end at the same byte and one is a suffix of the other.
    """
    ends: dict[bytes, int] = {}  # suffix of some left part x -> heaviest chain that begins with a merge of x
    whole: dict[bytes, int] = {}  # left part x -> the same
    best = 0
    for u, v in merges:
        chain = ends.get(v, 0)
        for k in range(len(v)):
            chain = max(chain, whole.get(v[k:], 0))
        best = max(best, chain)
        mine = chain + len(v)
        if mine > whole.get(u, 0):
            whole[u] = mine
        for k in range(len(u)):
            if mine > ends.get(u[k:], 0):
                ends[u[k:]] = mine
    return best + max(len(u) + len(v) for u, v in merges) if merges else 0


def check_unicode() -> None:
    """Raise if `regex` knows another version of Unicode than TOO_NEW was made for."""
    if not regex.fullmatch(r"\p{L}", NEW_UNICODE):
        raise RuntimeError("TOO_NEW must be made anew: this version of regex knows other letters")


class Merges:
    """Vocabulary and merge list of a byte-level tokenizer file."""

    def __init__(self, path: str):
        check_unicode()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, k in vocab.items():
            self.token_bytes[k] = as_bytes(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.token_bytes[k] = content.encode()
        self.byte_ids = [vocab[c] for c in sorted(alphabet, key=alphabet.get)]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        #: left id and right id in one number -> rank and merged id in one number, which orders by rank
        self.rules = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.lookahead = sufficient_lookahead([(as_bytes(a), as_bytes(b)) for a, b in pairs])
        ids = [self.byte_ids[b] for b in range(256)]
        self.byte_rules = [self.rules.get(a << BITS | b, NEVER) for a in ids for b in ids]
        self.numbers = list(range(len(self.token_bytes)))  # so that memos share them
        self.id_text = [str(k) for k in range(len(self.token_bytes))]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a whole word: the earliest merge first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) < 2:
            return ids
        if len(ids) > 48:
            return self._merge_long(ids)
        first = self.byte_rules
        return self._merge_short(ids, [first[a << 8 | b] for a, b in zip(word, word[1:])])

    def _merge_short(self, ids: list[int], found: list[int]) -> list[int]:
        """``found`` are the rules of neighbours."""
        get = self.rules.get
        while found:
            first = min(found)
            if first == NEVER:
                break
            at = found.index(first)
            merged = ids[at] = first & MASK
            del found[at], ids[at + 1]
            if at < len(found):
                found[at] = get(merged << BITS | ids[at + 1], NEVER)
            if at:
                found[at - 1] = get(ids[at - 1] << BITS | merged, NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.rules.get, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rule, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rule := get(ids[k] << BITS | ids[k + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rule, k, a, b = heapq.heappop(heap)
            r = right[k]
            if gone[k] or r >= n or ids[k] != a or ids[r] != b:
                continue
            merged = ids[k] = rule & MASK
            gone[r], right[k] = True, right[r]
            if right[k] < n:
                left[right[k]] = k
                if (rule := get(merged << BITS | ids[right[k]])) is not None:
                    heapq.heappush(heap, (rule, k, merged, ids[right[k]]))
            if left[k] >= 0 and (rule := get(ids[left[k]] << BITS | merged)) is not None:
                heapq.heappush(heap, (rule, left[k], ids[left[k]], merged))
        return [ids[k] for k in range(n) if not gone[k]]


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    """Merges of a file, once for each Python worker and all its tasks."""
    return Merges(path)


@lru_cache(maxsize=1)
def memo_of(path: str) -> Generations:
    """Ids of short pre-tokens of a file's merges, for a worker's tasks one after the other; of bounded bytes."""
    return Generations(MEMO_BYTES)


class WordStream:
    """Ids of pre-tokens, one after the other, whose bytes arrive in pieces."""

    def __init__(self, merges: Merges, memo: Memo | None = None):
        self.merges, self.held = merges, b""
        self.memo = Generations(MEMO_BYTES) if memo is None else memo
        self.window = 4 * max(merges.lookahead, 64)
        self.fed = 0  # pre-tokens that went through feed and finish, not through the memo

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a whole pre-token."""
        ids = self.memo.old.get(text)
        if ids is None:
            ids = tuple(map(self.merges.numbers.__getitem__, self.feed(text.encode()) + self.finish()))
            self.fed += 1
        if len(text) <= 40:
            self.memo.put(text, ids, 60 + 8 * len(ids))
        return ids

    def words(self, texts: list[str], out: list[int]) -> None:
        """Append the ids of whole pre-tokens; what the stream has emitted for the same bytes is emitted again."""
        get, word = self.memo.get, self.word
        for t in texts:
            out += get(t) or word(t)

    def feed(self, piece: bytes) -> list[int]:
        self.held += piece
        out: list[int] = []
        while len(self.held) >= self.window:
            ids, at, size = self.merges.merge(self.held[: self.window]), 0, 0
            stable = self.window - self.merges.lookahead
            for k in ids:
                size += len(self.merges.token_bytes[k])
                if size > stable:
                    break
                at += 1
                done = size
            if not at:
                self.window *= 2
                continue
            out += ids[:at]
            self.held = self.held[done:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class TextEncoder:
    """Ids of a text whose characters arrive in pieces: ``feed`` them, then ``finish``. Then the next text may follow."""

    def __init__(self, merges: Merges, memo: Memo | None = None):
        self.merges, self.stream = merges, WordStream(merges, memo)
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.starts = {s[0] for s in merges.special}
        self.longest = max(map(len, merges.special), default=1) - 1
        self.buffer, self.open, self.kind = "", False, None

    def _cut(self, text: str, last: bool, out: list[int]) -> str:
        """Emit the pre-tokens of ``text`` that are settled; return the rest. With ``last`` all are."""
        if self.open:  # a pre-token longer than half a piece is under way
            end = self.kind.match(text).end()
            if end == len(text) and not last:
                hold = 1 if self.kind is _KINDS[3] else 0
                out += self.stream.feed(text[: end - hold].encode())
                return text[end - hold :]
            if self.kind is _KINDS[3] and end < len(text):
                end = max(0, end - 1)
            out += self.stream.feed(text[:end].encode())
            out += self.stream.finish()
            self.open, text = False, text[end:]
        words = pattern_for(text).findall(text)  # these tile the text
        if last:
            self.stream.words(words, out)
            return ""
        stop, settled = len(text), len(text) - PATTERN_LOOKAHEAD
        while words and stop > settled:
            stop -= len(words.pop())
        self.stream.words(words, out)
        rest = text[stop:]
        if len(rest) > PIECE // 2:  # one long run of letters, digits, signs or spaces
            self.open = True
            lead = 1 if rest[0] == " " and _KINDS[3].match(rest).end() == 1 else 0
            self.kind = next(k for k in _KINDS if k.match(rest, lead).end() > lead)
            out += self.stream.feed(rest[:lead].encode())
            return self._cut(rest[lead:], last, out)
        return rest

    def feed(self, piece: str) -> list[int]:
        out: list[int] = []
        self.buffer += piece
        while self.special and (m := self.special.search(self.buffer)):
            self._cut(self.buffer[: m.start()], True, out)
            out.append(self.merges.special[m.group()])
            self.buffer = self.buffer[m.end() :]
        ready = len(self.buffer)
        if self.special and self.longest:  # a special token may begin in the last characters
            low = max(0, ready - self.longest)
            ready = min((at for s in self.starts if (at := self.buffer.find(s, low)) >= 0), default=ready)
        self.buffer = self._cut(self.buffer[:ready], False, out) + self.buffer[ready:]
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        self._cut(self.buffer, True, out)
        self.buffer = ""
        return out


class TextDecoder:
    """Text of ids that arrive in pieces; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, merges: Merges):
        self.token = merges.token_bytes.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.token, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode_pieces(encoder: TextEncoder, text: str, piece: int | None = None) -> Iterator[list[int]]:
    """Ids of a text, fed to the transducer piece after piece."""
    piece = piece or PIECE
    for at in range(0, len(text), piece):
        yield encoder.feed(text[at : at + piece])
    yield encoder.finish()


def digest(encoder: TextEncoder, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text; in constant memory."""
    ids_hash, text_hash, decoder, n = hashlib.sha256(), hashlib.sha256(), TextDecoder(encoder.merges), 0
    name = encoder.merges.id_text.__getitem__
    for ids in encode_pieces(encoder, text):
        if ids:
            ids_hash.update((("," if n else "") + ",".join(map(name, ids))).encode())
            n += len(ids)
            text_hash.update(decoder.feed(ids).encode())
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """For each row its key, ``ids`` (array of int) and the text decoded from them."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(public_tokenizers.path(tokenizer))
        encoder = TextEncoder(merges, memo_of(public_tokenizers.path(tokenizer)))
        for batch in batches:
            for at in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part = batch.slice(at, MAX_ROWS_PER_SLICE)
                ids, decoded = [], []
                for t in part.column(1).to_pylist():
                    mine = [k for piece in encode_pieces(encoder, t or "") for k in piece]
                    decoder = TextDecoder(merges)
                    ids.append(mine)
                    decoded.append(decoder.feed(mine) + decoder.finish())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    ["key", "ids", "decoded"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(frugal(run), f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """For each row its key, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(tokenizer)
        encoder = TextEncoder(merges_of(path), memo_of(path))
        for batch in batches:
            found = [digest(encoder, t.as_py() or "") for t in batch.column(1)]
            n, ids, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(frugal(run), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded from their ids."""
    return digests(table(spark, sf_dir, "documents"))
