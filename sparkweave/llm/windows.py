"""Windows of texts grouped by their minimiser: what finding long repeated passages has in common.

A window is `length` consecutive units (bytes, or words) of one text. Its minimiser is the place, leftmost
among equals, of the least hash of `k` units inside it. That place depends on the window's content only, so
equal windows have equal minimisers at equal distances. Consecutive windows with one minimiser form a chain;
chains, not windows, are what is counted and joined, about one for every (length - k) / 2 units.

A chain's token is the hash of its minimiser's k units, its content the hash of all its units. A window can
only be repeated if its token is. Chains with a token of their own are dropped first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import Scratch, documents_rows, mixed, rolling, small_batches, text_bytes, window_min, word_hashes, word_spans

#: Units that one numpy step handles; the low bits of a minimiser's key hold its place in the step.
STEP, PLACE_BITS = 1 << 18, 20
KEY = ["doc_id", "version"]
NO_ID = -(2**63)
#: Chains of one token that a bucket sorts by itself. Larger groups are split, and compared across their parts.
GROUP_ROWS = 20_000


def chains(values: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, token and content of every chain of several texts (units end to end)."""
    place = np.uint64((1 << PLACE_BITS) - 1)
    found: list[list[np.ndarray]] = [[], [], [], []]
    ends = starts[1:]
    for begin in range(0, max(0, len(values) - length + 1), STEP):
        part = values[begin : begin + STEP + length - 1]
        hashes = rolling(part, k)
        key = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        least = (window_min(key, length - k + 1) & place).astype(np.int64)
        valid = np.ones(len(least), bool)
        for end in ends[(ends > begin) & (ends - length < begin + len(least))]:
            valid[max(0, end - length + 1 - begin) : max(0, end - begin)] = False
        window = np.flatnonzero(valid)
        if not len(window):
            continue
        at = least[window]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
        first = window[new]
        n = np.diff(np.append(np.flatnonzero(new), len(window)))
        whole = rolling(part, length, seed=5)
        content = mixed(whole[first] * np.uint64(0x9E3779B97F4A7C15) + whole[first + n - 1] + n.astype(np.uint64))
        for x, y in zip(found, (first + begin, n, hashes[at[new]], content), strict=True):
            x.append(y)
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, kinds, strict=True))


def units(texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The units of several texts end to end, and where each text starts in them."""
    raw, starts = text_bytes(texts)
    if not words:
        return raw, starts
    begins, ends, at = word_spans(raw, starts)
    return word_hashes(raw, begins, ends), at


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows apart that share a doc_id. A null doc_id becomes the least long."""
    return documents_rows(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("version"))


def original_id() -> F.Column:
    return F.nullif("doc_id", F.lit(NO_ID))


def text_chains(docs: DataFrame, length: int, k: int, words: bool) -> DataFrame:
    """doc_id, version, token, content, first (window), n (windows): every chain of every text, in one scan."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                values, starts = units(part.column("text"), words)
                first, n, token, content = chains(values, starts, length, k)
                of = np.searchsorted(starts, first, "right") - 1
                of_row = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of_row), part.column("version").take(of_row), pa.array(token.view(np.int64)), pa.array(content.view(np.int64)), pa.array((first - starts[of]).astype(np.int64)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "version", "token", "content", "first", "n"],
                )

    return versioned(docs).mapInArrow(cut, "doc_id long, version long, token long, content long, first long, n int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, version and the compressed bytes of every text: what joins move instead of the text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in small_batches(batch):
                raw, starts = text_bytes(part.column("text"))
                raw = raw.tobytes()
                packed = [press.compress(raw[s:e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(packed, pa.binary())], names=["doc_id", "version", "packed"])

    return versioned(docs).mapInArrow(pack, "doc_id long, version long, packed binary")


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def group_parts() -> F.Column:
    """How many parts a token's group (of contents chains) is dealt to."""
    return F.ceil(F.col("contents") / GROUP_ROWS)


#: What sorts the windows of whole groups: it gets columns as arrays and returns, for each window that counts as
#: repeated, its row and its place in the row's chain.
Sorter = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def resolve(needed: DataFrame, sort: Sorter, digest: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], repeated: F.Column, scratch: Scratch, rows_at_once: int = 2000) -> DataFrame:
    """First and last repeated window of chains: token, content, begin, end.

    needed: token, content, n, rank (long), body (binary) and parts (as group_parts gives). The chains are
    range-partitioned by token, with sampled splitters, and sorted; each bucket sorts the windows of its groups.
    A group of more than GROUP_ROWS chains lies in several parts, which may be in several buckets: its windows
    leave as digests, and are compared across the boundaries by one aggregation. repeated is a condition on
    members (windows of the class), rank and least (the class's least rank).
    """
    parts = int(needed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.col("content"), F.col("parts"))
    ranged = needed.select("token", "content", "n", "rank", "body", "parts", part.alias("part")).repartitionByRange(parts, "token", "part").sortWithinPartitions("token", "part", "content")

    def rows_of(table: pa.Table) -> dict:
        table = table.combine_chunks()
        body = table.column("body")
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        raw, starts = text_bytes(body)
        return {c: table.column(c).to_numpy() for c in ("token", "content", "n", "rank")} | {"raw": raw, "starts": starts}

    def out(rows: dict, i: np.ndarray, at: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        empty = pa.array(np.zeros(len(i), np.int64)) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["token"][i]), pa.array(rows["content"][i]), pa.array(at.astype(np.int64)), pa.array(rows["rank"][i]), empty, pa.array(np.full(len(i), other is not None))],
            names=["token", "content", "at", "rank", "window", "open"],
        )

    def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows_of(table)
        i, at = sort(rows)
        if len(i):
            order = np.lexsort((at, i))
            i, at = i[order], at[order]
            first = np.concatenate([[True], i[1:] != i[:-1]])
            last = np.append(first[1:], True)
            ends = first | last
            yield out(rows, i[ends], at[ends])

    def opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for start in range(0, table.num_rows, rows_at_once):
            rows = rows_of(table.slice(start, rows_at_once))
            i, at, window = digest(rows)
            yield out(rows, i, at, window)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            new = [] if batch is None else [pa.Table.from_batches([batch])]
            split = [x.filter(pa.compute.greater(x.column("parts"), 1)) for x in new]
            for table in split:
                yield from opened(table)
            whole = [x.filter(pa.compute.equal(x.column("parts"), 1)) for x in new]
            tables = [x for x in ([held] if held is not None else []) + whole if x.num_rows]
            if not tables:
                continue
            held = pa.concat_tables(tables)
            tokens = held.column("token").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]])
            last, done = len(starts) - (1 if batch is None else 2), 0  # the last group may go on in the next batch
            while done < starts[last]:
                j = min(last, int(np.searchsorted(starts, done + rows_at_once, "left")))
                yield from closed(held.slice(done, int(starts[j]) - done))
                done = int(starts[j])
            held = held.slice(done)

    found = scratch.table(ranged.mapInArrow(bucket, "token long, content long, at long, rank long, window long, open boolean"))
    across = found.filter("open")
    classes = across.groupBy("token", "window").agg(F.count(F.lit(1)).alias("members"), F.min("rank").alias("least"))
    met = across.join(classes, ["token", "window"]).filter(repeated).select("token", "content", "at")
    both = found.filter("not open").select("token", "content", "at").union(met)
    return both.groupBy("token", "content").agg(F.min("at").alias("begin"), F.max("at").alias("end"))
