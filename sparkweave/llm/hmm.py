"""Language-model scoring with a hidden Markov model (operator 5).

Tokens are words of the text with A-Z lower-cased, then one end. A token belongs to a class: the end, each of
the OWN most frequent training words, and for all other words one of ENDINGS classes by a hash of their last
bytes. A hidden state emits a class, a class emits a word by its smoothed share of the class's training tokens
(a class of several words keeps a share for unseen ones). So the states' tables are bounded whatever the
vocabulary, while every word's count in the whole training corpus enters its probability.

Counts: texts are packed into blocks of about BLOCK_BYTES. A block lists its distinct words once; these lists,
not the tokens, are aggregated to corpus counts and joined back to their blocks. After that a block is a row
of class numbers. Baum-Welch runs on those: every partition computes expected counts of starts, transitions
and emissions over whole texts (a text of more than SEGMENT moves in segments, whose forward and backward rows are
handed on as products of their matrices), the counts are summed, and the driver only normalises bounded tables. Each of the ROUNDS rounds uses all training texts. Scoring is the scaled forward
recursion over each whole text, so the likelihood is exact: all texts of a block advance together.

score = log10 P(text) = log10 P(classes) + sum of log10 P(word | class).

Edge cases: null, empty and wordless texts are one end. With no training text every count is 0, base scores
use N = V = 0 and the classes are equally likely. Repeated rows are learnt and scored as rows. An empty table
gives an empty result. Only doc_id and text are read. A null doc_id is not held out. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import LOWER, Scratch, documents_rows, mixed, small_batches, text_bytes, word_hashes, word_spans

BLOCK_BYTES = 8_000_000
STATES, OWN, ENDINGS, SEGMENT = 8, 1500, 1024, 1024
#: Tokens whose forward and backward rows are held at a time.
CHUNK_TOKENS = 250_000
ROUNDS = 8
#: Sums over states are products with this: much faster than sums along a short axis.
ONES = np.ones(STATES)
#: Class numbers: the end, then endings, then words of their own.
END, CLASSES = 0, 1 + ENDINGS + OWN


def ending_classes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word by its last three bytes."""
    code = np.zeros(len(ends), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        code = code * np.uint64(257) + np.where(at >= begins, raw[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (1 + mixed(code) % np.uint64(ENDINGS)).astype(np.int16)


def _blob(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _values(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def word_blocks(docs: DataFrame, folds: int) -> DataFrame:
    """One row for a block: its texts with their lengths and word numbers, its distinct words with class and training count."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base = 0, TaskContext.get().partitionId() << 24
        ids, flags, counts, hashes, classes, size = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            h = np.concatenate(hashes)
            words, first, place = np.unique(h, return_index=True, return_inverse=True)
            n = np.concatenate(counts)
            held_out = np.concatenate(flags)
            train = np.bincount(place, np.repeat(~held_out, n).astype(np.float64), len(words)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + number], pa.int64()),
                    pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
                    pa.array([held_out.tolist()], pa.list_(pa.bool_())),
                    pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([_blob(place.astype(np.int32))], pa.binary()),
                    pa.array([words.view(np.int64)], pa.list_(pa.int64())),
                    pa.array([np.concatenate(classes)[first]], pa.list_(pa.int16())),
                    pa.array([train], pa.list_(pa.int64())),
                ],
                names=["block", "doc_ids", "held", "lengths", "tokens", "words", "classes", "train"],
            )

        for batch in batches:
            for part in small_batches(batch):
                raw, starts = text_bytes(part.column("text"))
                raw = LOWER[raw]
                begins, ends, at = word_spans(raw, starts)
                ids.append(part.column("doc_id"))
                flags.append(part.column("held").to_numpy(zero_copy_only=False))
                counts.append(np.diff(at))
                hashes.append(word_hashes(raw, begins, ends))
                classes.append(ending_classes(raw, begins, ends))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield block()
                    number += 1
                    ids, flags, counts, hashes, classes, size = [], [], [], [], [], 0
        if ids:
            yield block()

    rows = documents_rows(docs).withColumn("held", held)
    return rows.mapInArrow(pack, "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words array<long>, classes array<short>, train array<long>")


def corpus_counts(listed: DataFrame, scratch: Scratch) -> DataFrame:
    """word, c, class (by its ending) and own (a class of its own, or null) of all training words."""
    counts = scratch.table(listed.groupBy("word").agg(F.sum("train").alias("c"), F.min("class").alias("class")).filter("c > 0"))
    top = counts.orderBy(F.col("c").desc(), "word").limit(OWN)  # bounded by OWN
    top = top.select("word", (F.row_number().over(Window.orderBy(F.col("c").desc(), "word")) + ENDINGS).alias("own"))
    return counts.join(F.broadcast(top), "word", "left")


def classed_blocks(docs: DataFrame, folds: int, scratch: Scratch) -> tuple[DataFrame, dict]:
    """Blocks as class numbers with what does not depend on the states; and the corpus's totals."""
    blocks = scratch.table(word_blocks(docs, folds))
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "train", "classes")).alias("place", "x")).select("block", "place", F.col("x.words").alias("word"), F.col("x.train").alias("train"), F.col("x.classes").alias("class"))
    counts = scratch.table(corpus_counts(listed, scratch))
    texts = blocks.select(F.size(F.filter("held", lambda x: ~x)).alias("n")).agg(F.sum("n")).first()[0] or 0
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    types_of = {row["class"]: row.n for row in counts.filter("own is null").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # ENDINGS rows at most
    totals = {"N": tokens + texts, "V": types + (texts > 0), "texts": texts, "types": types_of}

    found = listed.select("block", "place", "word").join(counts.select("word", "c", "own"), "word").groupBy("block").agg(F.collect_list(F.struct("place", "c", "own")).alias("known"))
    known = found.select("block", F.col("known.place").alias("place"), F.col("known.c").alias("c"), F.col("known.own").alias("own"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.log10(totals["N"] + 0.1 * (totals["V"] + 1))
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: E731, B023
                lengths = get("lengths").values.to_numpy().astype(np.int64)
                token = _values(get("tokens").as_py(), np.int32)
                classes = get("classes").values.to_numpy().copy()
                c = np.zeros(len(classes), np.int64)
                if get("place").is_valid:
                    place = get("place").values.to_numpy()
                    c[place] = get("c").values.to_numpy()
                    own = get("own").values.to_numpy(zero_copy_only=False).astype(np.float64)
                    classes[place] = np.where(np.isnan(own), classes[place], np.nan_to_num(own)).astype(np.int16)
                text = np.repeat(np.arange(len(lengths)), lengths)
                size = len(lengths)
                base = np.bincount(text, np.log10(c + 0.1)[token] - low, size) + np.log10(totals["texts"] + 0.1) - low
                seen = np.bincount(text, (c > 0)[token], size).astype(np.int64) + int(totals["texts"] > 0)
                inside = np.bincount(text, np.log10(c + 0.1)[token] * (classes <= ENDINGS)[token], size)
                sequence = np.insert(classes[token], np.cumsum(lengths), END)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], kind) for x, kind in ((get("block").as_py(), pa.int64()), (get("doc_ids").as_py(), pa.list_(pa.int64())), (get("held").as_py(), pa.list_(pa.bool_())), ((lengths + 1).astype(np.int32), pa.list_(pa.int32())), (_blob(sequence.astype(np.int16)), pa.binary()), (base, pa.list_(pa.float64())), (seen, pa.list_(pa.int64())), (inside, pa.list_(pa.float64())))],
                    names=["block", "doc_ids", "held", "lengths", "classes", "base", "seen", "inside"],
                )

    joined = blocks.select("block", "doc_ids", "held", "lengths", "tokens", "classes").join(known, "block", "left")
    schema = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, classes binary, base array<double>, seen array<long>, inside array<double>"
    classed = scratch.table(joined.mapInArrow(number, schema))
    scratch.drop(blocks)
    return classed, totals


class Model:
    """start (S), move (S x S) and emit (C x S, the emission probabilities of each class in each state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray) -> Model:
        noise = np.random.default_rng(5).gamma(1.0, size=(len(shares), STATES))
        emit = shares[:, None] * noise
        move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        """From expected counts, with a little of the corpus's own class shares in every state."""
        emit = emit + 50.0 * shares[:, None]
        move, start = move + 1.0, start + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def forward(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence, by the scaled forward recursion over its whole length."""
    order = np.argsort(-lengths, kind="stable")
    at = (np.cumsum(lengths) - lengths)[order]
    longest = lengths[order]
    total = np.zeros(len(lengths))
    alpha = np.broadcast_to(model.start, (len(lengths), STATES))
    active = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(longest) else 0) + 1), "right")
    for t, n in enumerate(active.tolist()):
        alpha = alpha[:n] if t == 0 else alpha[:n] @ model.move
        alpha = alpha * model.emit[classes[at[:n] + t]]
        scale = alpha @ ONES
        alpha = alpha / scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def transfers(model: Model, classes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a segment makes of the forward row at its first token: a matrix each, up to a factor. Longest segments first."""
    out = np.broadcast_to(np.eye(STATES), (len(at), STATES, STATES)).copy()
    for t in range(1, size[0] if len(size) else 0):
        n = np.searchsorted(-size, -t, "left")
        out[:n] = (out[:n].reshape(-1, STATES) @ model.move).reshape(n, STATES, STATES) * model.emit[classes[at[:n] + t]][:, None, :]
        if t % 16 == 0:
            out[:n] /= out[:n].max((1, 2), keepdims=True)
    return out / out.max((1, 2), keepdims=True)


def boundaries(model: Model, classes: np.ndarray, piece: np.ndarray, last: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward row at the first token and backward row at the last one of every segment, up to factors.

    Segments of a text lie in order. Only texts of several segments need their matrices.
    """
    enter = model.start * model.emit[classes[at]]
    leave = np.ones((len(at), STATES))
    several = np.flatnonzero((piece > 0) | ~last)
    order = several[np.argsort(-size[several], kind="stable")]
    for low in range(0, len(order), 4096):
        some = order[low : low + 4096]
        if low == 0:
            through = np.zeros((len(at), STATES, STATES)) if len(several) else None
        through[some] = transfers(model, classes, at[some], size[some])
    most = int(piece.max(initial=0))
    for p in range(most):
        i = np.flatnonzero((piece == p) & ~last)
        row = (enter[i][:, None, :] @ through[i])[:, 0]
        enter[i + 1] = row / row.sum(1, keepdims=True)
    for p in range(most, 0, -1):
        i = np.flatnonzero(piece == p)
        column = (through[i] @ leave[i][:, :, None])[:, :, 0]
        leave[i - 1] = column / column.max(1, keepdims=True)
    return enter, leave


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions of the chosen sequences, end to end in one array.

    Long sequences are dealt with in segments that hand the forward and backward rows on, so the counts are those
    of whole sequences. A segment's first token is the last of the segment before, where its emission is counted.
    """
    begin = (np.cumsum(lengths) - lengths)[chosen]
    pieces = np.maximum(1, -(-(lengths[chosen] - 1) // SEGMENT))
    text = np.repeat(np.arange(len(begin)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = begin[text] + piece * SEGMENT
    size = np.minimum(SEGMENT + 1, lengths[chosen][text] - piece * SEGMENT)
    enter, leave = boundaries(model, classes, piece, piece == pieces[text] - 1, at, size)
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    order = np.argsort(-size, kind="stable")
    chunk = np.cumsum(size[order]) // CHUNK_TOKENS
    for some in np.split(order, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1):
        if not len(some):
            continue
        place, long, opens = at[some], size[some], piece[some] == 0
        active = np.searchsorted(-long, -np.arange(1, long[0] + 1), "right").tolist()
        alphas, scales, emits, symbols = [], [], [], []
        alpha = enter[some] / model.emit[classes[place]]
        for t, n in enumerate(active):
            symbols.append(classes[place[:n] + t])
            emits.append(model.emit[symbols[-1]])
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ model.move) * emits[-1]
            scales.append((alpha @ ONES)[:, None])
            alpha = alpha / scales[-1]
            alphas.append(alpha)
        beta, weights, m = np.zeros((0, STATES)), [], 0
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if t + 1 < len(active):
                right = emits[t + 1] * beta / scales[t + 1]
                move += alphas[t][:m].T @ right
                beta = right @ model.move.T
            ending = leave[some[m:n]]
            beta = np.concatenate([beta, ending / ((alphas[t][m:] * ending) @ ONES)[:, None]])
            weights.append(alphas[t] * beta)
            m = n
        start += weights[-1][opens].sum(0)
        weights[-1] = weights[-1] * opens[:, None]
        symbol, weight = np.concatenate(symbols[::-1]), np.concatenate(weights)
        for s in range(STATES):
            emit[:, s] += np.bincount(symbol, weight[:, s], CLASSES)
    return np.concatenate([start, (move * model.move).ravel(), emit.ravel()])


def baum_welch(classed: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One round over all training texts: expected counts of all partitions, summed, then normalised."""
    spark = classed.sparkSession
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        total = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.column("held")[row].values.to_numpy(zero_copy_only=False)
                chosen = np.flatnonzero(~held)
                if len(chosen):
                    lengths = batch.column("lengths")[row].values.to_numpy().astype(np.int64)
                    total += expected_counts(own, _values(batch.column("classes")[row].as_py(), np.int16), lengths, chosen)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "value"])

    counted = classed.select("held", "lengths", "classes").mapInArrow(count, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
    for row in counted.collect():  # bounded by the model's tables
        total[row.place] = row.value
    shared.unpersist()
    return Model.of(total[:STATES], total[STATES : STATES + STATES * STATES].reshape(STATES, STATES), total[STATES + STATES * STATES :].reshape(CLASSES, STATES), shares)


def class_totals(classed: DataFrame) -> np.ndarray:
    """Training tokens of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.column("held")[row].values.to_numpy(zero_copy_only=False)
                lengths = batch.column("lengths")[row].values.to_numpy()
                classes = _values(batch.column("classes")[row].as_py(), np.int16)
                total += np.bincount(classes[~np.repeat(held, lengths)], minlength=CLASSES)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "value"])

    out = np.zeros(CLASSES)
    for row in classed.select("held", "lengths", "classes").mapInArrow(count, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[row.place] = row.value
    return out


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    classed, totals = classed_blocks(docs, folds, scratch)
    tokens = class_totals(classed)
    shares = (tokens + 0.1) / (tokens + 0.1).sum()
    model = Model.first(shares)
    for _ in range(ROUNDS):
        model = baum_welch(classed, model, shares)

    # A class of several words shares out its tokens and a tenth for each word it knows and for one it doesn't.
    inside = np.zeros(CLASSES)
    types = np.array([totals["types"].get(k, 0) for k in range(1, ENDINGS + 1)])
    inside[1 : ENDINGS + 1] = np.log10(tokens[1 : ENDINGS + 1] + 0.1 * (types + 1))
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit, inside))
    n_train = int(totals["N"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, low = shared.value
        own = Model(start, move, emit)
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = batch.column("lengths")[row].values.to_numpy().astype(np.int64)
                classes = _values(batch.column("classes")[row].as_py(), np.int16)
                text = np.repeat(np.arange(len(lengths)), lengths)
                log10 = forward(own, classes, lengths) / np.log(10)
                log10 += batch.column("inside")[row].values.to_numpy() - np.bincount(text, low[classes], len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, batch.column("held")[row].values, pa.array(lengths), batch.column("seen")[row].values, pa.array(np.full(len(lengths), n_train)), batch.column("base")[row].values, pa.array(log10)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return classed.select("doc_ids", "held", "lengths", "classes", "base", "seen", "inside").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
