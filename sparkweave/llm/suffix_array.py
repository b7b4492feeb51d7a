"""Suffix-array deduplication (operator 8): bytes covered by a 200-byte string that starts in two places.

A suffix counts by its leading 200 bytes, so only suffixes that can repeat are sorted: those whose minimiser
(64 bytes inside the leading 200) occurs twice in the corpus. They are held as chains (see windows.py), in
which consecutive suffixes share their bytes. Chains with equal content answer for all their suffixes at once.
Where contents differ, the chains are range-partitioned by leading token with sampled splitters, each bucket
sorts its suffixes by multikey quicksort, and groups that lie on a bucket's boundary are compared across it.
The leading token of a suffix is its minimiser; runs of TOKEN bytes from its start follow, in order. Any such
order puts equal suffixes side by side.

The bytes to remove are joined to the texts, which yields per text the kept bytes.

Edge cases: a null text is empty; texts shorter than the length have no suffix that counts and keep all. Equal
texts in two rows repeat each other, also under one doc_id. Matches never cross texts, overlaps count, and all
is judged on the input. An empty table gives an empty result. Only doc_id and text are read. Tokens and
contents are told apart by 64-bit hashes, used together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.common import PACKED_BYTES, Scratch, few_rows, rolling
from sparkweave.llm.windows import KEY, NO_ID, group_parts, original_id, packed_texts, resolve, text_chains, unpack

LENGTH, SEED_BYTES, TOKEN = 200, 64, 40


def multikey_sort(group: np.ndarray, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members and class numbers of classes of two or more equal keys; a key is a group and a sequence of tokens.

    Sort by one token, part into classes of equal ones, drop classes of one, go on with the next token inside
    the classes that are left.
    """
    order = np.argsort(group, kind="stable")
    same = group[order]
    for token in [None, *tokens]:
        if token is not None:
            key = token[order]
            by = np.lexsort((key, same))
            order, same, key = order[by], same[by], key[by]
            new = (same[1:] != same[:-1]) | (key[1:] != key[:-1])
        else:
            new = same[1:] != same[:-1]
        starts = np.concatenate([[True], new]) if len(order) else np.zeros(0, bool)
        alone = starts & np.append(starts[1:], True) if len(order) else starts
        same = np.cumsum(starts)[~alone]
        order = order[~alone]
    return order, same


def _suffixes(rows: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in its chain, and start in raw of every suffix of the rows."""
    n = rows["n"].astype(np.int64)
    i = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i, at, rows["starts"][i] + at


def bucket_sorter(length: int, width: int):
    """What sorts the suffixes of whole groups, and what names them where a group goes on in another bucket."""

    def sort(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        i, at, start = _suffixes(rows, length)
        named = rolling(rows["raw"], width, seed=3)
        group = np.unique(rows["token"], return_inverse=True)[1][i]
        order, _ = multikey_sort(group, [named[start + offset] for offset in range(0, length - width + 1, width)])
        return i[order], at[order]

    def digest(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, at, start = _suffixes(rows, length)
        return i, at, rolling(rows["raw"], length, seed=3)[start].view(np.int64)

    return sort, digest


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, seed: int = SEED_BYTES, token: int = TOKEN) -> DataFrame:
    """doc_id, version, spans: array of (begin, end) that repeated strings cover; they may overlap. length is a multiple of token."""
    every = scratch.table(text_chains(docs, length, seed, words=False))
    twice = every.groupBy("token").agg(F.count(F.lit(1)).alias("chains")).filter("chains > 1")
    candidates = scratch.table(every.join(scratch.table(twice.select("token")), "token", "left_semi"))  # a written side lets Spark split a hot token
    scratch.drop(every)
    contents = scratch.table(candidates.groupBy("token", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "first", "n")).alias("at")))
    mixed_tokens = contents.groupBy("token").agg(F.count(F.lit(1)).alias("contents"), F.min("copies").alias("fewest")).filter("contents > 1 and fewest = 1")
    needed = contents.join(mixed_tokens.select("token", group_parts().alias("parts")), "token").select("at.doc_id", "at.version", F.struct("token", "content", "at.first", "at.n", "parts").alias("chain"))

    wanted = needed.groupBy(*KEY).agg(F.collect_list("chain").alias("chains"))  # no more than a text's own chains

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "packed", PACKED_BYTES):
            out: list[tuple] = []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("chains").to_pylist(), strict=True):
                raw = unpack(packed)
                out += [(x["token"], x["content"], x["n"], raw[x["first"] : x["first"] + x["n"] + length - 1], x["parts"]) for x in found]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array([0] * len(out), pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.int64())], names=["token", "content", "n", "rank", "body", "parts"])

    texts = packed_texts(docs).join(wanted, KEY)  # a text in two rows comes twice, but then all its chains are repeated anyway
    bodies = scratch.table(texts.select("packed", "chains").mapInArrow(extract, "token long, content long, n int, rank long, body binary, parts long"))
    found = resolve(bodies, *bucket_sorter(length, token), F.col("members") > 1, scratch)
    decided = (
        contents.join(found, ["token", "content"], "left")
        .filter("copies > 1 or begin is not null")
        .select("token", "content", F.when(F.col("copies") > 1, F.lit(0)).otherwise(F.col("begin")).alias("begin"), F.when(F.col("copies") > 1, F.col("at.n") - 1).otherwise(F.col("end")).alias("end"))
    )
    covered = candidates.join(decided, ["token", "content"]).select(*KEY, (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end") + length).alias("end"))
    return covered.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of covered bytes."""
    runs: list[list[int]] = []
    for begin, end in sorted(spans):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    return runs


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): every row of docs without its repeated bytes."""
    scratch = Scratch(docs.sparkSession, "suffix-array")
    spans = scratch.table(repeated_spans(docs, scratch, length))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "packed", PACKED_BYTES):
            n, removed, counts, kept = [], [], [], []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = unpack(packed)
                runs = merged([(x["begin"], x["end"]) for x in found or []])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                rest = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(raw)), removed.append(len(raw) - len(rest)), counts.append(len(runs)), kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, counts)), pa.array(kept, pa.binary()), batch.column("version")],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "version"],
            )

    joined = packed_texts(docs).join(spans, KEY, "left")
    return joined.select(*KEY, "packed", "spans").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, version long")


def digests(stripped: DataFrame) -> DataFrame:
    return stripped.select(original_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def strip_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with all its columns; text without its repeated bytes, n_chars (if there) its new length.

    Where a cut leaves part of a character, the part goes too. A null text stays null.
    """
    scratch = Scratch(docs.sparkSession, "suffix-array")
    spans = scratch.table(repeated_spans(docs, scratch, length)).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("spans").alias("__spans"))
    names, schema = docs.columns, docs.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in few_rows(batches, "text"):
            packed = [None if t is None else press.compress(t.encode()) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "text", PACKED_BYTES):
            texts = []
            for packed, found in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                raw = unpack(packed)
                if found:
                    edges = [0, *(x for run in merged([(x["begin"], x["end"]) for x in found]) for x in run), len(raw)]
                    raw = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                texts.append(None if packed is None else raw.decode(errors="ignore"))
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__version", F.xxhash64(F.coalesce("text", F.lit(""))))
    moved = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in keyed.schema])
    joined = keyed.mapInArrow(pack, moved).join(spans, ["__id", "__version"], "left")
    return joined.select(*names, "__spans").mapInArrow(strip, schema)
