"""Toxicity by FTRL-proximal logistic regression (operator 9).

Features of a text are the hashed words, pairs of neighbouring words and pairs with one word between
(after lower-casing A-Z, words being runs of ASCII letters and digits and of all other characters that are
not ASCII), each counted once for a text. Hashes have 64 bits, so long texts do not meet strangers' features.
Only features in at least MIN_DOCS documents of the sample whose association with the label reaches LEAST_G2
are included; both are the same at every size, and L1 does the rest.

Training uses a bounded sample of labelled rows: all rows whose hash of doc_id is under a threshold that
makes about SAMPLE_ROWS of them (all, if there are fewer). The sample is spread over shards of about SHARD_ROWS rows. In each
round every shard runs FTRL-proximal over its rows from the common state (z, n for each feature), and the
states are averaged. The L1 term leaves few weights that are not zero; they are what is broadcast for
scoring, and their number is bounded by that of the sample's included features.

Edge cases: an empty, null or wordless text gets the score of the intercept. Labels that are null are left
out; a document with several labels is toxic if one of them says so. Labels without a document do nothing.
Without any training label nothing speaks for toxicity: every score is 0 (to double precision). Repeated rows are scored each. An empty
table gives an empty result. Only doc_id and text of docs, and doc_id and toxic of labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import LOWER, Scratch, documents_rows, few_rows, mixed, small_batches, text_bytes, word_hashes, word_spans

#: The bound on labelled rows in training.
SAMPLE_ROWS = 20_000
SHARD_ROWS, ROUNDS = 5_000, 8
#: Documents of the sample that must hold a feature, whatever the sample's size.
MIN_DOCS = 3
#: Likelihood ratio of a feature and the label that is included: chi-squared's 0.999 at one degree of freedom.
LEAST_G2 = 10.83
#: Bytes of text whose features are counted together, features sent at a time, and tasks that count a shard.
COUNT_BYTES, COUNT_ROWS, COUNT_TASKS = 500_000, 32_768, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: The intercept where there is no label to learn from.
NO_LABELS = -700.0

_BREAK = np.ones(256, bool)
_BREAK[128:] = _BREAK[48:58] = _BREAK[97:123] = _BREAK[65:91] = False


def features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, pair and skip pair of several texts."""
    raw = LOWER[raw]
    begins, ends, at = word_spans(raw, starts, _BREAK)
    words = word_hashes(raw, begins, ends, seed=9)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(at))
    found, of = [words], [text]
    for gap in (1, 2):
        if len(words) > gap:
            same = text[:-gap] == text[gap:]
            found.append(mixed(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(gap))[same])
            of.append(text[gap:][same])
    return np.concatenate(found), np.concatenate(of)


def distinct_features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[0])


class Ftrl:
    """FTRL-proximal with a learning rate for each coordinate; the last coordinate is the intercept."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z.copy(), n.copy()

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, i: np.ndarray, label: float) -> None:
        i = np.append(i, len(self.z) - 1)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _likelihood_ratio(n: Column, t: Column, n_rows: int, n_toxic: int) -> Column:
    """Twice the log likelihood ratio of n documents with a feature, t of them toxic, among n_rows with n_toxic."""
    term = lambda seen, row, column: F.when((seen > 0) & (row > 0) & (column > 0), seen * F.log(seen * float(n_rows) / (row * column))).otherwise(0.0)
    clean = F.lit(n_rows - n_toxic)
    return 2 * (term(t, n, F.lit(n_toxic)) + term(n - t, n, clean) + term(n_toxic - t, n_rows - n, F.lit(n_toxic)) + term(clean - n + t, n_rows - n, clean))


def _sample(labels: DataFrame, learn: Column) -> DataFrame:
    """About SAMPLE_ROWS of the labelled rows that may be learnt from: doc_id, toxic."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, SAMPLE_ROWS / max(1, usable.count()))
    return usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes in order, their weights, and the intercept. learn: which doc_id may be learnt from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    chosen = scratch.table(_sample(labels, F.lit(True) if learn is None else learn))
    shards = -(-max(1, chosen.count()) // SHARD_ROWS)
    rows = documents_rows(docs).join(F.broadcast(chosen), "doc_id")  # bounded by SAMPLE_ROWS
    order = F.xxhash64("doc_id", F.lit("order"))
    rows = scratch.table(rows.withColumn("shard", F.pmod(order, F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", order, "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "text", COUNT_BYTES):
            found = [distinct_features(t) for t in batch.column("text").to_pylist()]
            labels_of = np.repeat(batch.column("toxic").to_numpy(), [len(f) for f in found])
            known, place, sums = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            toxic_sums = np.bincount(place, labels_of, len(known)).astype(np.int64)
            for start in range(0, len(known), COUNT_ROWS):
                part = slice(start, start + COUNT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(known[part].view(np.int64)), pa.array(sums[part]), pa.array(toxic_sums[part])], names=["feature", "n", "t"])

    n_rows, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    # More tasks than shards, and counts of a slice at a time: neither a task nor a batch holds all features of a shard.
    spread = rows.repartition(shards * COUNT_TASKS)
    sums = spread.select(F.col("text"), (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(count, "feature long, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counted = sums.filter((F.col("n") >= min_docs) & (_likelihood_ratio(F.col("n"), F.col("t"), n_rows, n_toxic) >= LEAST_G2))
    included = np.sort(counted.select("feature").toArrow().column("feature").to_numpy().view(np.uint64))  # bounded by the sample

    vocabulary = spark.sparkContext.broadcast(included)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in few_rows(batches, "text"):
            places = []
            for text in batch.column("text").to_pylist():
                found = distinct_features(text)
                place = np.searchsorted(known, found)
                place[place == len(known)] = 0
                places.append(place[known[place] == found] if len(known) else place[:0])
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("toxic"), pa.array(places, pa.list_(pa.int64()))], names=["shard", "toxic", "places"])

    encoded = scratch.table(rows.select("shard", "toxic", "text").mapInArrow(encode, "shard long, toxic int, places array<long>"))

    state = Ftrl(np.zeros(len(included) + 1), np.zeros(len(included) + 1))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((state.z, state.n))

        def learn_shard(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            models: dict[int, Ftrl] = {}
            for batch in batches:
                for shard, toxic, places in zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist(), batch.column("places"), strict=True):
                    if shard not in models:
                        models[shard] = Ftrl(*shared.value)
                    models[shard].learn(places.values.to_numpy(zero_copy_only=False).astype(np.int64), float(toxic))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.z.tobytes() for m in models.values()], pa.binary()), pa.array([m.n.tobytes() for m in models.values()], pa.binary())],
                names=["z", "n"],
            )

        states = encoded.mapInArrow(learn_shard, "z binary, n binary").collect()  # a row for each shard, of bounded size
        if states:
            order_free = sorted((bytes(s.z), bytes(s.n)) for s in states)
            state = Ftrl(np.mean([np.frombuffer(z) for z, _ in order_free], axis=0), np.mean([np.frombuffer(n) for _, n in order_free], axis=0))
        shared.unpersist()
    if not n_rows:
        return included, np.zeros(0), NO_LABELS
    weights = state.weights()
    kept = np.flatnonzero(weights[:-1])
    return included[kept], weights[kept], float(weights[-1])


def _scores(texts: pa.Array, known: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    raw, starts = text_bytes(texts)
    found, of = features(raw, starts)
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    near = maybe[(found & np.uint64(0xFFFF)).astype(np.int64)]
    found, of = found[near], of[near]
    total = np.full(len(texts), intercept)
    if len(known) and len(found):
        place = np.searchsorted(known, found)
        place[place == len(known)] = 0
        hit = known[place] == found
        pairs = np.unique(of[hit] * len(known) + place[hit])
        total += np.bincount(pairs // len(known), weights[pairs % len(known)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every text: a map over the scan, with the weights broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(part.column("text"), *shared.value))], names=["doc_id", "score"])

    return documents_rows(docs).mapInArrow(apply, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                yield part.filter(pa.array(_scores(part.column("text").fill_null(""), *shared.value) < threshold))

    return docs.mapInArrow(apply, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows outside the held-out fold."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    scored = score(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
