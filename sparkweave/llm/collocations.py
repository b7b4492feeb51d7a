"""Phrase collocation mining (operator 13): frequent phrases of two to five words in each language, by how much
more often their parts stand together than chance would have it.

Texts are lower-cased (A-Z only) and cut into pieces at . , ; : ! ? and line ends; a phrase is a run of words
inside a piece. Prefix sums of a polynomial over the words' hashes give the Rabin-Karp fingerprint of any run
of words by one subtraction. A phrase is frequent only if its parts are, so fingerprints are counted by length:
words first, then pairs of frequent words, then runs of frequent pairs; each task combines its counts before
the shuffle. What one level found reaches the next as a table of bits of bounded size (FILTER_BITS): a
fingerprint whose bit is not set can't be frequent. A bit set by chance costs a row, never a result.

Fingerprints only choose. A last pass over the texts takes the occurrences that all levels let through, compares
each with the occurrence that its fingerprint points to, word by word in the bytes, and spells the phrase out
there; counts are then summed by the phrase itself. So only phrases that may be frequent are ever written out,
and neither a collision nor a crowded table of bits can change a count.

Parts of a frequent phrase are frequent, so the table of frequent phrases holds all that scores need.

Edge cases: null and empty texts have no words; a null lang is `und` and meets documents that say so. Repeated
rows count as often as they stand. Other columns than lang and text are not read. Texts above STEP bytes are
cut between words, and the words after a cut are read as context, so no phrase is lost or counted twice. Words
are bytes: invalid or rare characters are kept as they are. An empty table gives an empty result. Ties in score
go to the higher count, then to the phrase in byte order, so the order is total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import LOWER, Scratch, mixed, word_hashes, word_spans

#: Bytes of text that a numpy step handles.
STEP = 500_000

#: The longest phrase, and the largest table of bits that is broadcast for one level (32 MB).
LONGEST, FILTER_BITS = 5, 1 << 28

#: Fingerprints, or phrases, that a task combines before it passes them on, and rows that it passes on at a time.
COMBINED, SPELT, PASSED = 1_000_000, 300_000, 20_000

#: Languages up to which their totals are broadcast.
FEW_LANGS = 10_000

PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
SEPARATOR = PIECE_END.copy()
SEPARATOR[[9, 32]] = True

_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


class Fingerprints:
    """Fingerprints of the runs of words of one slice; lang is part of them. A token 0 stands between pieces."""

    def __init__(self, tokens: np.ndarray, lang: str):
        powers, self.back = _powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mixed(tokens) * powers[:-1], out=self.sums[1:])
        self.salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        own = (self.sums[places + n] - self.sums[places]) * self.back[places]
        return mixed((own ^ self.salt) + np.uint64(n))


def has_bit(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slots = prints & np.uint64(len(bits) * 8 - 1)
    return (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def runs(tokens: np.ndarray, prints: Fingerprints, filters: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1 to longest: n, the places of runs of n words that may be frequent, and their fingerprints.

    A run may be frequent if both runs one word shorter may be, and its own bit is set where filters has its length.
    """
    open_places = tokens != 0
    for n in range(1, longest + 1):
        if n > 1:
            open_places = open_places[:-1] & open_places[1:]
        places = np.flatnonzero(open_places)
        found = prints.at(places, n)
        if n in filters:
            keep = has_bit(filters[n], found)
            open_places[places[~keep]] = False
            places, found = places[keep], found[keep]
        yield n, places, found


def slices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, int]]:
    """lang, lower-cased bytes, and how many of these are the slice's own; the rest is context of a long text.

    Texts of one language are joined by line ends, up to STEP bytes.
    """
    langs = batch.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    texts = batch.column("text").cast(pa.binary())
    held: list[bytes] = []
    size = 0
    for k, i in enumerate(order):
        text = texts[i].as_py()
        if len(text) > STEP:
            yield from ((langs[i], part, own) for part, own in _parts(LOWER[np.frombuffer(text, np.uint8)]))
        elif text:
            held.append(text)
            size += len(text) + 1
        if held and (size > STEP or k + 1 == len(order) or langs[order[k + 1]] != langs[i]):
            raw = LOWER[np.frombuffer(b"\n".join(held), np.uint8)]
            yield langs[i], raw, len(raw)
            held, size = [], 0


def _parts(raw: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in parts that end between words, each with the words after it that its last phrases need."""
    begin = 0
    while begin < len(raw):
        end = begin + STEP
        while end < len(raw) and not SEPARATOR[raw[end]]:
            gap = np.flatnonzero(SEPARATOR[raw[end : end + STEP]])
            end += int(gap[0]) if len(gap) else STEP
        end, look = min(end, len(raw)), 4096
        while end + look < len(raw) and len(word_spans(raw[end : end + look], np.array([0, look]), SEPARATOR)[0]) < LONGEST + 1:
            look *= 2
        yield raw[begin : end + look], end - begin
        begin = end


def tokenised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word, with a row of zeros between pieces."""
    begins, ends, _ = word_spans(raw, np.array([0, len(raw)]), SEPARATOR)
    hashes = np.maximum(word_hashes(raw, begins, ends), np.uint64(1))
    pieces = np.cumsum(PIECE_END[raw], dtype=np.int32)[begins]
    cuts = np.flatnonzero(pieces[1:] != pieces[:-1]) + 1
    return tuple(np.insert(x, cuts, 0) for x in (hashes, begins, ends))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def word_totals(docs: DataFrame) -> DataFrame:
    """lang, total: the words of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, int] = {}
            for lang, raw, own in slices(batch):
                begins, _, _ = word_spans(raw, np.array([0, len(raw)]), SEPARATOR)
                totals[lang] = totals.get(lang, 0) + int(np.searchsorted(begins, own))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "n_words"])

    return _texts(docs).mapInArrow(count, "lang string, n_words long").filter("n_words > 0").groupBy("lang").agg(F.sum("n_words").alias("total"))


def counted(docs: DataFrame, first: int, last: int, filters: dict, least: int) -> DataFrame:
    """n, print: the fingerprints of runs of first to last words that occur at least so often in their language.

    Each level hashes the words anew: as a table, the hashes of many texts are wide rows, of which a reader holds
    thousands at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: x.value for n, x in filters.items()}
        held: dict[int, list[np.ndarray]] = {n: [] for n in range(first, last + 1)}
        sizes = dict.fromkeys(held, 0)

        def emptied(n: int) -> Iterator[pa.RecordBatch]:
            prints = np.concatenate(held[n])
            held[n], sizes[n] = [], 0
            prints.sort()
            begins = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])).astype(np.int32)
            counts = np.diff(np.append(begins, len(prints)))
            for start in range(0, len(begins), PASSED):
                own = slice(start, start + PASSED)
                some = begins[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(prints[some].view(np.int64)), pa.array(counts[own], pa.int64())], names=["n", "print", "c"])

        for batch in batches:
            for lang, raw, own in slices(batch):
                words, begins, _ = tokenised(raw)
                for n, places, prints in runs(words, Fingerprints(words, lang), bits, last):
                    if n >= first and len(places):
                        held[n].append(prints[: np.searchsorted(begins[places], own)])
                        sizes[n] += len(held[n][-1])
                        if sizes[n] > COMBINED:
                            yield from emptied(n)
        for n, size in sizes.items():
            if size:
                yield from emptied(n)

    return _texts(docs).mapInArrow(count, "n int, print long, c long").groupBy("n", "print").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("n", "print")


def bit_tables(prints: DataFrame, lengths: range) -> dict:
    """Broadcasts a table of bits for each length: bit print mod size is set. About 16 bits a fingerprint, FILTER_BITS at most."""
    spark, out = prints.sparkSession, {}
    sizes = dict(prints.groupBy("n").count().collect())
    for n in lengths:
        size = 1 << 15
        while size < min(16 * sizes.get(n, 0), FILTER_BITS):
            size *= 2
        slot = F.col("print").bitwiseAND(F.lit(size - 1))
        packed = prints.filter(F.col("n") == n).select(F.shiftright(slot, 15).alias("block"), slot.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
        table = np.zeros((size >> 15, 1 << 12), np.uint8)
        for block, bits in packed.groupBy("block").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
            table[block] = np.frombuffer(bits, np.uint8)
        out[n] = spark.sparkContext.broadcast(table.reshape(-1))
    return out


def _word_ids(raw: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal only for equal bytes: every word is compared with the first of its hash."""
    _, firsts, ids = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - begins
    same = bool(np.all(sizes == sizes[firsts][ids]))
    if same:
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        same = bool(np.array_equal(raw[np.repeat(begins, sizes) + at], raw[np.repeat(begins[firsts][ids], sizes) + at]))
    if same:
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(raw[b:e].tobytes(), len(known)) for b, e in zip(begins, ends, strict=True)])


def _groups(ids: np.ndarray, places: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every different run of n words, and how often it occurs; runs of one fingerprint are compared."""
    _, firsts, which, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    pointed = places[firsts][which]
    if all(np.array_equal(ids[places + j], ids[pointed + j]) for j in range(n)):
        return places[firsts], counts
    _, firsts, counts = np.unique(np.stack([ids[places + j] for j in range(n)]), axis=1, return_index=True, return_counts=True)
    return places[firsts], counts


def _spelt(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between begins and ends, with one space between words."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
    texts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return pc.replace_substring_regex(texts, "[ \t]+", " ")


def spelt_phrases(docs: DataFrame, filters: dict, least: int) -> DataFrame:
    """lang, n, phrase, f: all runs of one to five words that occur at least so often in a language, exactly counted."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: x.value for n, x in filters.items()}
        held: list[pa.Table] = []

        def combined() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "n", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "n", "phrase", "f"])

        def emptied() -> Iterator[pa.RecordBatch]:
            table = held.pop()
            pa.default_memory_pool().release_unused()
            yield from table.set_column(2, "phrase", table["phrase"].cast(pa.binary()).cast(pa.string())).to_batches(max_chunksize=10_000)

        for batch in batches:
            for lang, raw, own in slices(batch):
                hashes, begins, ends = tokenised(raw)
                ids = _word_ids(raw, hashes, begins, ends)
                for n, places, prints in runs(hashes, Fingerprints(hashes, lang), bits, LONGEST):
                    mine = np.searchsorted(begins[places], own)
                    if mine:
                        firsts, counts = _groups(ids, places[:mine], prints[:mine], n)
                        held.append(pa.table({"lang": pa.repeat(lang, len(firsts)), "n": pa.array(np.full(len(firsts), n, np.int32)), "phrase": _spelt(raw, begins[firsts], ends[firsts + n - 1]), "f": counts}))
                if sum(map(len, held[1:])) > SPELT:
                    held = [combined()]
                    if len(held[0]) > 2 * SPELT:
                        yield from emptied()
        if held:
            held = [combined()]
            yield from emptied()

    return _texts(docs).mapInArrow(spell, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """lang, n, phrase, f of the frequent runs of one to five words; and lang, total: the words of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    filters: dict = {}
    for first, last in ((1, 1), (2, 2), (3, 3), (4, LONGEST)):
        prints = scratch.table(counted(docs, first, last, filters, least))
        filters |= bit_tables(prints, range(first, last + 1))
    return scratch.table(spelt_phrases(docs, filters, least)), scratch.table(word_totals(docs))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two or more words, by its lowest-scoring cut (ties: the first)."""
    words = F.split("phrase", " ")
    cuts = phrases.filter("n > 1").select("lang", "phrase", F.col("f").alias("a"), "n", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    joined = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(18,0)").cast("decimal(38,0)")
    if totals.count() <= FEW_LANGS:
        totals = F.broadcast(totals)
    cuts = cuts.join(totals, "lang").withColumn("top", wide("a") * F.lit(1000) * wide("total")).withColumn("bottom", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.total").alias("n"), "b.score")


def unabsorbed(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """candidates without those that occur inside a longer one each time.

    A longer phrase can't occur more often than its part, and the phrases between them lie between in count, so
    it is enough to look at phrases longer by one word: those that equal the first or the last words of one.
    """
    longer = phrases.filter("n > 2").select("lang", F.split("phrase", " ").alias("w"), F.col("n").alias("size"), F.col("f").alias("a"))
    inside = longer.select("lang", "a", F.explode(F.array(F.slice("w", F.lit(1), F.col("size") - 1), F.slice("w", F.lit(2), F.col("size") - 1))).alias("w"))
    return candidates.join(inside.select("lang", "a", F.array_join("w", " ").alias("phrase")), ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, least: int = 100, limit: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Ranks are taken in 64 parts of a language first, so that no task sorts more than its part and 64 * limit rows.
    """
    phrases, totals = frequent_phrases(docs, least)
    found = unabsorbed(scored(phrases, totals), phrases)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= limit)
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
