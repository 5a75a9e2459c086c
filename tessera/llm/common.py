"""Shared pieces: the shared folder, tables that cut lineage, and Column helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D], which part words.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows that Python code takes from a batch at a time.
MAX_ROWS_PER_SLICE = 512


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir as a full URI; in local mode (tests) a folder of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _own_dir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full.rstrip("/"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the execution that made them ends, instead of with the driver's garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, tidy: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends at files all executors see.

    ``tidy``: what was shuffled for it is deleted at once, and the files are packed tighter.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_TIDY, "false") if tidy else None
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path, compression="zstd" if tidy else None)
    finally:
        if tidy:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of save() that nothing reads any more; shuffle files of finished steps go with them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    gc.collect()
    jvm.System.gc()  # Spark cleans up after plans that are no longer referred to


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for Python code on executors."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row: rows that agree in both are equal in every column."""
    return [F.xxhash64(*df.columns), F.xxhash64(F.lit("row"), *df.columns)]


class Memo(dict):
    """Results by string key, of at most about ``limit`` bytes: emptied when full. Holding less only costs time."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.used = limit, 0
        self.old: dict = {}  # what Generations keep longer

    def put(self, key: str | bytes, value: object, size: int) -> None:
        """Remember ``value`` of about ``size`` bytes; keys are charged with 160 bytes of overhead."""
        size += 160 + len(key)
        if self.used + size > self.limit:
            self.clear()
        self.used += size
        self[key] = value

    def clear(self) -> None:
        super().clear()
        self.used = 0


class Generations(Memo):
    """A Memo that keeps its older half when the newer one is full: what is found there may be put again."""

    def __init__(self, limit: int):
        super().__init__(limit // 2)

    def clear(self) -> None:
        self.old = dict(self)
        super().clear()


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back when the task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, 8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_piece(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, of one length."""
    parts = [packed(x) for x in columns]
    return struct.pack(f"<I{len(parts)}I", len(columns[0]), *map(len, parts)) + b"".join(parts)


def unpack_piece(data: bytes, columns: int) -> list[np.ndarray]:
    n, *sizes = struct.unpack_from(f"<I{columns}I", data)
    ends = np.cumsum([4 + 4 * columns, *sizes]).tolist()
    return [unpacked(data[a:b], n) for a, b in zip(ends, ends[1:])]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also where a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; none for null or blank."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).when(
        bare.isNotNull(), F.split(bare, SPACE_CLASS + "+", -1)
    ).otherwise(F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
