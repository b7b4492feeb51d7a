"""Substring deduplication by De Bruijn compaction (operator 2): words in 50-word windows that start in an
earlier document.

The graph's edges are the 50-word windows (token k-mers). As in published compaction of sequencing graphs,
they are dealt by minimiser: consecutive windows with one minimiser are a chain, a path that is compact from
the start (see windows.py). Chains whose minimiser stands in one document only are dropped. Repeated chains,
those with equal content in several documents, are then glued through joins: where a chain is always followed
by the same chain and that one always comes after it, both belong to one nonbranching path. The end of a
repeated stretch counts as a branch, so every document that enters a path runs through it whole; pointer
jumping finds each chain's path head and its distance. A path's earliest document decides for all others.

Source coordinates verify the spans: an occurrence's place less its distance in the path is the same along
one run, and only runs without gaps become spans. Windows at branches, where contents differ though the
minimiser is the same, are compared one by one in sorted buckets.

Edge cases: a null text has no words. Repeats inside one document, and in rows with the same doc_id, remove
nothing; a null doc_id counts as the smallest. Texts under 50 words are kept whole. Windows are judged on the
input. An empty table gives an empty result. Only doc_id and text are read. Words, minimisers and windows are
told apart by 64-bit hashes, windows by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import PACKED_BYTES, Scratch, few_rows, rolling, word_hashes, word_spans
from sparkweave.llm.suffix_array import merged
from sparkweave.llm.windows import KEY, group_parts, original_id, packed_texts, resolve, text_chains, unpack

LENGTH, SEED_WORDS = 50, 10


def compact(links: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes: content, n. links: u, v, nonbranching edges (each u and each v once). Returns content, head, distance.

    Pointers to the node before are doubled until all point at a head. A cycle has no head; after as many
    rounds as the longest path could need, its nodes are left as paths of their own.
    """
    back = links.select(F.col("v").alias("content"), F.col("u").alias("head")).join(nodes.select(F.col("content").alias("head"), F.col("n").alias("step")), "head")
    state = scratch.table(nodes.join(back, "content", "left").select("content", F.coalesce("head", "content").alias("head"), F.coalesce("step", F.lit(0)).cast("long").alias("distance"), F.col("head").isNull().alias("done")))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if state.filter("not done").isEmpty():
            break
        ahead = state.select(F.col("content").alias("head"), F.col("head").alias("next"), F.col("distance").alias("more"), F.col("done").alias("there"))
        moving = state.filter("not done").join(ahead, "head").select("content", F.col("next").alias("head"), (F.col("distance") + F.col("more")).alias("distance"), F.col("there").alias("done"))
        following = scratch.table(state.filter("done").union(moving))
        scratch.drop(state)
        state = following
    return state.select("content", F.when(F.col("done"), F.col("head")).otherwise(F.col("content")).alias("head"), F.when(F.col("done"), F.col("distance")).otherwise(F.lit(0)).alias("distance"))


def path_spans(occurrences: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """occurrences: doc_id, version, first, n, content, first_doc. Returns spans that start in an earlier document: doc_id, version, begin, end, path, first_doc."""
    along = Window.partitionBy(*KEY).orderBy("first")
    once = occurrences.repartition(*KEY).dropDuplicates([*KEY, "first"])  # a row of docs may be there twice
    placed = once.select(
        "*",
        F.when(F.lead("first").over(along) == F.col("first") + F.col("n"), F.lead("content").over(along)).alias("after"),
        F.when(F.lag(F.col("first") + F.col("n")).over(along) == F.col("first"), F.lag("content").over(along)).alias("ahead"),
    )
    placed = scratch.table(placed)
    stats = placed.groupBy("content").agg(
        F.first("n").alias("n"),
        F.min("first_doc").alias("first_doc"),
        F.min("after").alias("after"),
        ((F.min("after") == F.max("after")) & (F.count("after") == F.count(F.lit(1)))).alias("one_after"),
        F.min("ahead").alias("ahead"),
        ((F.min("ahead") == F.max("ahead")) & (F.count("ahead") == F.count(F.lit(1)))).alias("one_ahead"),
    )
    stats = scratch.table(stats)
    leaving = stats.filter("one_after").select(F.col("content").alias("u"), F.col("after").alias("v"))
    entering = stats.filter("one_ahead").select(F.col("content").alias("v"), F.col("ahead").alias("u"))
    paths = compact(leaving.join(entering, ["u", "v"]).filter("u <> v"), stats.select("content", "n"), scratch)
    heads = stats.join(paths, "content").groupBy("head").agg(F.min("first_doc").alias("path_doc"))
    runs = (
        placed.join(paths, "content")
        .groupBy(*KEY, F.col("head").alias("path"), (F.col("first") - F.col("distance")).alias("origin"))
        .agg(F.min("first").alias("begin"), F.max(F.col("first") + F.col("n")).alias("last"), F.sum("n").alias("windows"))
        .filter(F.col("last") - F.col("begin") == F.col("windows"))
    )
    return runs.join(heads.withColumnRenamed("head", "path"), "path").filter("path_doc < doc_id").select(*KEY, "begin", (F.col("last") + length - 1).alias("end"), "path", F.col("path_doc").alias("first_doc"))


def window_sorter():
    """Sorts window hashes of whole groups; a window is repeated if its class holds a smaller document."""

    def windows(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = rows["n"].astype(np.int64)
        i = np.repeat(np.arange(len(n)), n)
        return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), np.frombuffer(rows["raw"].tobytes(), np.int64)

    def sort(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        i, at, window = windows(rows)
        rank = rows["rank"][i]
        order = np.lexsort((rank, window, rows["token"][i]))
        token, sorted_window = rows["token"][i][order], window[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sorted_window[1:] != sorted_window[:-1])]) if len(order) else np.zeros(0, bool)
        least = rank[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else rank
        later = order[rank[order] > least] if len(order) else order
        return i[later], at[later]

    return sort, windows


def earlier_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, version, begin, end (words) of what windows cover that start in a document with a smaller doc_id."""
    every = scratch.table(text_chains(docs, length, seed, words=True))
    shared = every.groupBy("token").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    candidates = scratch.table(every.join(scratch.table(shared.select("token")), "token", "left_semi"))  # a written side lets Spark split a hot token
    scratch.drop(every)
    contents = scratch.table(candidates.groupBy("token", "content").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min(F.struct(*KEY, "first", "n")).alias("at")))

    repeated = contents.filter("last_doc > first_doc").select("token", "content", "first_doc")
    paths = path_spans(candidates.join(repeated, ["token", "content"]).select(*KEY, "first", "n", "content", "first_doc"), scratch, length)

    branching = contents.groupBy("token").agg(F.min("first_doc").alias("a"), F.max("first_doc").alias("b"), F.count(F.lit(1)).alias("contents")).filter("a < b")
    needed = contents.join(branching.select("token", group_parts().alias("parts")), "token").select("at.doc_id", "at.version", F.struct("token", "content", "at.first", "at.n", "parts").alias("chain"))
    wanted = needed.groupBy(*KEY).agg(F.collect_list("chain").alias("chains"))  # no more than a text's own chains

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "packed", PACKED_BYTES):
            out: list[tuple] = []
            for doc, packed, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "chains")), strict=True):
                raw = np.frombuffer(unpack(packed), np.uint8)
                begins, ends, _ = word_spans(raw, np.array([0, len(raw)]))
                hashes = rolling(word_hashes(raw, begins, ends), length, seed=5)
                out += [(x["token"], x["content"], x["n"], doc, hashes[x["first"] : x["first"] + x["n"]].tobytes(), x["parts"]) for x in found]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["token", "content", "n", "rank", "body", "parts"])

    texts = packed_texts(docs).join(wanted, KEY)
    bodies = scratch.table(texts.select("doc_id", "packed", "chains").mapInArrow(extract, "token long, content long, n int, rank long, body binary, parts long"))
    found = resolve(bodies, *window_sorter(), F.col("least") < F.col("rank"), scratch)
    firsts = candidates.join(contents.join(found, ["token", "content"]).select("token", "content", "first_doc", "begin", "end"), ["token", "content"]).filter("doc_id = first_doc")
    branches = firsts.select(*KEY, (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end") + length).alias("end"))
    return paths.select(*KEY, "begin", "end").union(branches)


def without_earlier(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): every row of docs."""
    scratch = Scratch(docs.sparkSession, "debruijn")
    spans = scratch.table(earlier_spans(docs, scratch, length).groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "packed", PACKED_BYTES):
            n, removed, kept = [], [], []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = unpack(packed).split()
                edges = [0, *(x for run in merged([(x["begin"], x["end"]) for x in found or []]) for x in run), len(words)]
                rest = [w for s, e in zip(edges[::2], edges[1::2], strict=True) for w in words[s:e]]
                n.append(len(words)), removed.append(len(words) - len(rest)), kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = packed_texts(docs).join(spans, KEY, "left")
    stripped = joined.select("doc_id", "packed", "spans").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")
    return stripped.select(original_id().alias("doc_id"), "n_words", "n_removed", "kept")


def digests(stripped: DataFrame) -> DataFrame:
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
