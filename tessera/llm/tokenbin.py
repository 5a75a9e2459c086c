"""Token-ID / binary output (7): token files with a shared zstandard dictionary and one frame per document.

Documents are encoded with a tokenizers-library file, an end id is appended, and the ids become little-endian unsigned
integers (two bytes where the vocabulary fits, else four). A zstandard dictionary is trained on the serialized arrays of
a documented sample (SAMPLE_ROWS rows, at most SAMPLE_BYTES of whole texts, long ones in pieces), and every document is compressed separately with it, so a
short document is read without its neighbours. A file holds a header (magic, version, id width, SHA-256 of the
dictionary), the frames, an index (key, id count, frame offset and length per document) and a footer with the index's
place; the dictionary is stored once beside the files, and a reader refuses a file whose hash differs.

Files and documents are in ascending key order. Only compressed frames are shuffled: they are range-partitioned and
sorted by key, text length and checksum, so rows that repeat one key, or have none, spread over several tasks, too, and
every task writes files of about FILE_ROWS documents or FILE_BYTES. A null key comes first; a null text is the empty one
and has the end id alone; a very long text is encoded whole and is one frame. An empty table gives no files. Columns
other than key and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import DIGITS, LETTERS, MEMO_BYTES, OTHER, byte_alphabet
from tessera.llm.common import Memo, drop, frugal, new_path, open_store, save, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Rows and bytes of texts that the dictionary is trained on at most, and bytes of ids in one training sample.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
PIECE_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Documents and bytes of a file, about.
FILE_ROWS = 8192
FILE_BYTES = 64 << 20
MAGIC = b"TOKB"
#: struct formats.
HEADER, ENTRY, FOOTER = "<4sHH32s", "<?qIQI", "<QQ4s"

#: A text without OTHER characters is lower-cased, in NFC, and cut by _WORDS just as the library does it.
_WORDS = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^\\t\\n\\r {LETTERS}{DIGITS}]+")


class WordEncoder:
    """Serialized ids as the library gives them: common texts word by word, words looked up or encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = id_type(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Memo(MEMO_BYTES)
        self.byte_char = {v: k for k, v in byte_alphabet().items()}

    def encode(self, text: str) -> bytes:
        if OTHER.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        get, new = self.words.get, self._new
        return b"".join([get(w) or new(w) for w in _WORDS.findall(text.lower())])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _new(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.byte_char.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], self.kind).tobytes()
        if len(word) <= 40:
            self.words.put(word, ids, 40 + len(ids))
        return ids


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One for each Python worker and all its tasks."""
    return WordEncoder(path)


def id_type(path: str) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, key: str, text: str, path: str) -> bytes:
    """Dictionary for the arrays of a sample spread over the corpus by a hash of the key; empty for tiny corpora.

    Sampled texts are taken in the order of another hash, whole, until their bytes reach SAMPLE_BYTES.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()
    share = min(1.0, 2 * SAMPLE_ROWS / max(n, 1), 2 * SAMPLE_BYTES / max(size, 1))
    spread = docs.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30)))
    picked = spread.select(body.alias("body"), F.octet_length(body).cast("long").alias("size"), F.xxhash64(key, F.lit("order")).alias("o")).orderBy("o", "size").limit(SAMPLE_ROWS)
    before = Window.orderBy("o", "size").rowsBetween(Window.unboundedPreceding, -1)  # over SAMPLE_ROWS rows at most
    rows = picked.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") + F.col("size") <= SAMPLE_BYTES).select("body").collect()
    encoder, samples = encoder_of(path), []
    end = np.array([END_ID], encoder.kind).tobytes()
    for (t,) in rows:
        ids = encoder.encode(t) + end
        samples += [ids[at : at + PIECE_BYTES] for at in range(0, len(ids), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> list[tuple[str, int, int]]:
    """Write the token files of ``docs`` under ``path``: (name, documents, ids) of each file, in key order."""
    where = public_tokenizers.path(tokenizer)
    tasks = max(1, -(-docs.count() // FILE_ROWS))
    dictionary = train_dictionary(docs, key, text, where)
    store, root = open_store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    kind = id_type(where)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(where)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True).compress
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            counts, frames = [], []
            for t in batch.column(1):
                ids = encoder.encode(t.as_py() or "") + end
                counts.append(len(ids) // len(end))
                frames.append(pack(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["key", "n", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        task = TaskContext.get()
        attempt, place = task.taskAttemptId(), task.partitionId()
        done: list[tuple[str, int, int]] = []
        out, index, at, total = None, [], 0, 0

        def close() -> None:
            for row in index:
                out.write(struct.pack(ENTRY, *row))
            out.write(struct.pack(FOOTER, at, len(index), MAGIC))
            out.close()
            store.move(f"{name}.attempt-{attempt}", name)
            done.append((name.rpartition("/")[2], len(index), total))

        for batch in batches:
            for k, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or len(index) >= 2 * FILE_ROWS or at >= FILE_BYTES:
                    if out is not None:
                        close()
                    name, index, total = f"{root}/part-{place:06d}-{len(done):04d}.tokens", [], 0
                    out = store.open_output_stream(f"{name}.attempt-{attempt}")
                    out.write(struct.pack(HEADER, MAGIC, 1, int(kind[2]), hashlib.sha256(dictionary).digest()))
                    at = struct.calcsize(HEADER)
                out.write(frame)
                index.append((k is not None, k or 0, n, at, len(frame)))
                at += len(frame)
                total += n
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["name", "documents", "ids"],
        )

    packed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(frugal(compress), "key long, n long, frame binary")
    packed, packed_path = save(packed, "token-frames")  # ranges are sampled from it, so texts are encoded once
    order = ["key", "n", F.crc32("frame")]
    ordered = packed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    files = ordered.mapInArrow(write, "name string, documents long, ids long").collect()  # one row per file
    drop(docs.sparkSession, packed_path)
    return sorted(tuple(r) for r in files)


class TokenFile:
    """Random and sequential access to one file."""

    def __init__(self, path: str, dictionary: bytes):
        store, name = open_store(path)
        self.source = store.open_input_file(name)
        magic, version, width, digest = struct.unpack(HEADER, self.source.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{path} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} needs another dictionary")
        size = self.source.size()
        at, n, magic = struct.unpack(FOOTER, self.source.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't whole")
        self.index = list(struct.iter_unpack(ENTRY, self.source.read_at(n * struct.calcsize(ENTRY), at)))
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress
        self.kind = f"<u{width}"

    def __len__(self) -> int:
        return len(self.index)

    def key(self, k: int) -> int | None:
        return self.index[k][1] if self.index[k][0] else None

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frame is read."""
        _, _, n, at, size = self.index[k]
        ids = np.frombuffer(self.unpack(self.source.read_at(size, at)), self.kind)
        if len(ids) != n:
            raise ValueError("a frame holds another number of ids than the index says")
        return ids


def read_dictionary(path: str) -> bytes:
    store, root = open_store(path)
    with store.open_input_stream(f"{root}/dictionary") as f:
        return f.read()


def read_tokens(spark: SparkSession, path: str, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """One row per document: key, start (ids of all documents before it), n_tokens, ids_crc32, ids (on request)."""
    schema = "key long, start long, n_tokens long, ids_crc32 long, ids array<int>"
    starts, total = [], 0
    for name, _, n in files:
        starts.append((name, total))
        total += n
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_dictionary(path)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                f = TokenFile(f"{path}/{name}", dictionary)
                for first in range(0, len(f), 512):
                    rows = []
                    for k in range(first, min(first + 512, len(f))):
                        ids = f.ids(k)
                        rows.append((f.key(k), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                        ["key", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    table_of = spark.createDataFrame(starts, "name string, start long").repartition(len(starts))
    return table_of.mapInArrow(run, schema)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files, and what the files hold."""
    path = new_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, files).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
