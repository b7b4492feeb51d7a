"""What several operators of this subpackage share: the shared scratch folder, Arrow batches as byte
arrays, hashing of bytes and words, and word splitting.

A text's words are its maximal runs of characters other than space and the control characters 9 to 13.
Those are single bytes in UTF-8, so all splitting and hashing here is done on the UTF-8 bytes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step handles at a time; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies in the same place for them (else install it there)."""
    home = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, environment.get("PYTHONPATH", "")]))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. In local mode, as in tests, one is made where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        attach(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write df once and return it read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of docs; null texts are empty ones. Other columns are left out unless asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def small_batches(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts hold at most limit bytes together, or a single longer text."""
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def few_rows(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """All batches in slices as small_batches makes them, so that what a slice unpacks to stays bounded."""
    for batch in batches:
        yield from small_batches(batch, column, limit)


#: Compressed bytes that are unpacked at a time.
PACKED_BYTES = 400_000


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text starts in it, with the end."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def rolling(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all k consecutive values (bytes, or 64-bit hashes), by doubling; position i covers i to i+k-1."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    power = _table(seed)[values] if values.dtype == np.uint8 else mixed(values + np.uint64(seed + 1))
    have, width, length, done = None, 0, 1, False
    factor = np.uint64(0x9E3779B97F4A7C15 | 1)
    while not done:
        if k & length:
            if have is None:
                have, width = power, length
            else:
                n = len(values) - width - length + 1
                have = mixed(have[:n] * factor + power[width : width + n])
                width += length
        length *= 2
        done = length > k
        if not done:
            half = length // 2
            n = len(values) - length + 1
            power = power[:n] * factor + power[half : half + n]
            power ^= power >> np.uint64(29)
    return have if k & (k - 1) else mixed(have)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    have, length = values, 1
    while length * 2 <= w:
        have = np.minimum(have[:-length], have[length:])
        length *= 2
    if length < w:
        have = np.minimum(have[: len(have) - (w - length)], have[w - length :])
    return have


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, starts: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in the bytes of several texts, and the words before each text.

    starts is what text_bytes returns: words never cross from one text to the next.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = ~separator[raw]
    first = np.zeros(n + 1, bool)
    first[starts[starts <= n]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, starts)


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, from differences of prefix sums."""
    n = len(raw)
    if not len(begins):
        return np.zeros(0, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    step = np.full(n + 1, base, np.uint64)
    step[0] = 1
    powers = np.cumprod(step, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table(seed + 77)[raw] * powers[:n], out=sums[1:])
    span = int(begins.max())
    step = np.full(span + 1, inverse, np.uint64)
    step[0] = 1
    back = np.cumprod(step, dtype=np.uint64)
    return mixed((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
