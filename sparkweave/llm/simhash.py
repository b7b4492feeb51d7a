"""SimHash near-deduplication with a Gray-order hierarchical index (operator 4).

A text's fingerprint has 64 bits; a bit is set if it is set in more than half the XXH64 hashes of the text's
word shingles (A-Z lower-cased, repeats included). Equal fingerprints are one class.

The index: classes are range-partitioned and sorted by Gray rank, so neighbours differ in few bits, and cut
into leaves of LEAF fingerprints. A node keeps the bits that all its members share, as a mask with a pattern
(from AND and OR of the members); FANOUT nodes in a row make a node of the level above, up to one root. The
search goes down from the root paired with itself: the shared bits in which two nodes differ are differences
of every pair below them, so a pair of nodes with more of them than the radius is dropped with all below it.
Pairs that are left at the leaves are compared fingerprint by fingerprint. A leaf pair returns for each
member the least class it is connected to, so what is written is linear in the members, not in the links.
Components come from these edges.

Fingerprints are distinct in the index, so no group of copies reaches one task, and the number of node pairs
grows with the number of leaves times the square of its logarithm for mixed fingerprints.

Edge cases: null, empty and wordless texts have fingerprint 0 and are linked like any other; texts with fewer
words than a shingle have one shingle of all their words. Ties at half the hashes give 0. Repeated rows and
ids give a row each. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import LOWER, PACKED_BYTES, Scratch, documents_rows, few_rows, mixed, rolling, small_batches, text_bytes, word_hashes, word_spans
from sparkweave.llm.components import connected_components, least_reached, spanning_forest
from sparkweave.llm.windows import packed_texts, unpack

LEAF, FANOUT = 256, 16
#: Classes that share a pattern, about; classes of one that are compared in one piece; share of links that may meet in no table.
BUCKET, BLOCK, MISS = 64, 1024, 0.01
#: Members of a group above which only a forest of its links is kept.
DENSE = 96
#: Sets, and bytes of their hashes, that a tile of the exact comparison should hold.
TILE, TILE_BYTES = 128, 1_000_000


def shingles(text: str, words: int) -> list[bytes]:
    """Shingles of the lower-cased text, repeats included. bytes.split() and lower() know the same separators and A-Z."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found])
    starts = [0, *ends[: len(found) - words].tolist()]
    return [joined[s:e] for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles(text, words)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and more (empty) of every text: a map over the scan."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                fp = [fingerprint(text, words) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array([b""] * len(fp), pa.binary())], names=["doc_id", "fp", "more"])

    return documents_rows(docs).mapInArrow(hash_texts, "doc_id long, fp long, more binary")


def set_key(hashes: np.ndarray) -> bytes:
    """A digest of a set of distinct shingles, given as sorted hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def shingle_set_hashes(raw: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text (texts end to end): of all its words, if it has fewer than a shingle."""
    raw = LOWER[raw]
    begins, ends, at = word_spans(raw, starts)
    hashes = word_hashes(raw, begins, ends, seed=4)
    rolled = rolling(hashes, words, seed=6)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(rolled[s : e - words + 1]) if e - s >= words else rolling(hashes[s:e], e - s, seed=6) if e > s else hashes[:0])
    return out


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The majority of each set; sets lie end to end. Four 16-bit counters are summed at a time; larger sets go one by one."""
    out, starts = np.zeros(len(sizes), np.uint64), np.cumsum(sizes) - sizes
    large = sizes > 0xFFFF
    for i in np.flatnonzero(large):
        out[i] = majority(hashes[starts[i] : starts[i] + sizes[i]])
    some = np.flatnonzero(sizes > 0)
    half = sizes[some].astype(np.uint64)
    for k in range(16 if len(some) else 0):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0001000100010001), starts[some])
        for j in range(4):
            ones = (sums >> np.uint64(16 * j)) & np.uint64(0xFFFF)
            out[some] |= np.where(large[some], np.uint64(0), (2 * ones > half).astype(np.uint64) << np.uint64(16 * j + k))
    return out


def lane_bits(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """The fingerprints of sets in several lanes (sets x lanes): majorities of the hashes, mixed anew in each lane."""
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.stack([majorities(mixed(hashes + np.uint64(lane)) if lane else hashes, sizes) for lane in range(lanes)], axis=1)


def set_fingerprints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """doc_id, version (a hash of the text), key (of the set of distinct shingles), and bits (the set's fingerprint in all lanes)."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches, "text"):
            sets = shingle_set_hashes(*text_bytes(part.column("text")), words)
            bits = [x.tobytes() for x in lane_bits(sets, lanes)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array([set_key(x) for x in sets], pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "version", "key", "bits"])

    rows = documents_rows(docs).withColumn("version", F.xxhash64("text"))
    return rows.mapInArrow(hash_texts, "doc_id long, version long, key binary, bits binary")


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit pattern in Gray order, as a long that sorts in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def leaves(classes: DataFrame, scratch: Scratch, leaf: int = LEAF) -> DataFrame:
    """node, all_and, all_or, fps, more, reps: runs of leaf classes in Gray order, numbered through all partitions.

    Places in the order come from a range partitioning and the counts of its parts, so leaves are full wherever
    the partitions end.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = classes.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(parts, "rank")
    ranged = scratch.table(ranged.select(F.spark_partition_id().alias("part"), "rank", "fp", "more", "rep"))
    counts = ranged.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a partition
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("rank", "rep")) - 1
    placed = ranged.join(before, "part").select(F.floor(place / leaf).alias("node"), "fp", "more", "rep")
    gathered = placed.groupBy("node").agg(F.bit_and("fp").alias("all_and"), F.bit_or("fp").alias("all_or"), F.collect_list(F.struct("fp", "more", "rep")).alias("rows"))  # leaf rows at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = batch.column("rows")[row].values
                blobs = rows.field("fp").to_numpy().tobytes(), b"".join(rows.field("more").to_pylist()), rows.field("rep").to_numpy().tobytes()
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("node", "all_and", "all_or")), *(pa.array([x], pa.binary()) for x in blobs)], names=["node", "all_and", "all_or", "fps", "more", "reps"])

    return scratch.table(gathered.mapInArrow(pack, "node long, all_and long, all_or long, fps binary, more binary, reps binary"))


def _differences(u: str, v: str) -> Column:
    """Shared bits in which two nodes differ: set in all of one and in none of the other."""
    one = F.col(f"{u}.all_and").bitwiseAND(F.bitwise_not(F.col(f"{v}.all_or")))
    two = F.col(f"{v}.all_and").bitwiseAND(F.bitwise_not(F.col(f"{u}.all_or")))
    return F.bit_count(one.bitwiseOR(two))


def node_pairs(bottom: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """u, v: pairs of leaves (and each leaf with itself) that the index can't tell apart by more than radius bits."""
    levels = [bottom.select("node", "all_and", "all_or")]
    n = bottom.count()
    while n > 1:
        above = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.bit_and("all_and").alias("all_and"), F.bit_or("all_or").alias("all_or"))
        levels.append(scratch.table(above))
        n = -(-n // FANOUT)
    pairs = levels[-1].select(F.col("node").alias("u"), F.col("node").alias("v"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("parent", F.floor(F.col("node") / FANOUT))
        pairs = (
            pairs.join(below.alias("a"), F.col("a.parent") == F.col("u"))
            .join(below.alias("b"), F.col("b.parent") == F.col("v"))
            .filter((F.col("a.node") <= F.col("b.node")) & (_differences("a", "b") <= radius))
            .select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        )
        pairs = scratch.table(pairs)
    return pairs


def _met(bottom: DataFrame, pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs of leaves with what both hold. Only one side moves once for each pair: the other is met where it lies."""
    side = lambda x: bottom.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
    return pairs.join(side("v"), "v").join(side("u"), "u")


def _values(batch: pa.RecordBatch, row: int, column: str, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_py(), kind)


def linked_edges(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """classes: fp, more, rep, one row for each fp. Returns u, v: pairs of fp that connect what links of at most radius bits connect."""
    bottom = leaves(classes, scratch)
    met = _met(bottom, node_pairs(bottom, radius, scratch), ("fps",))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = _values(batch, row, "u_fps"), _values(batch, row, "v_fps")
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                if batch.column("u")[row] == batch.column("v")[row]:
                    i, j = i[i < j], j[i < j]
                    ids = a.view(np.int64)
                else:
                    j = j + len(a)
                    ids = np.concatenate([a, b]).view(np.int64)
                if len(i):
                    least = least_reached(ids, i, j)
                    far = least != ids
                    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(least[far])], names=["u", "v"])

    return met.mapInArrow(compare, "u long, v long")


def plan_patterns(classes: int, p: float, lanes: int) -> np.ndarray:
    """Which bits each table takes as its pattern: tables x bits.

    Bits grow with the logarithm of the classes, so that a pattern has about BUCKET of them. The number of tables
    follows from the share of links that may have no pattern in common, MISS: over all counts of differing bits,
    p being the probability that a bit differs at the similarity asked for.
    """
    n = 64 * lanes
    bits = max(8, round(math.log2(max(1, classes) / BUCKET)) if classes > BUCKET else 8)
    share = [math.comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(n + 1)]
    agree = [math.comb(n - d, bits) / math.comb(n, bits) for d in range(n + 1)]
    tables = 1
    while sum(x * (1 - y) ** tables for x, y in zip(share, agree, strict=True)) > MISS:
        tables += 1
    rng = np.random.default_rng(bits)
    return np.array([rng.choice(n, bits, replace=False) for _ in range(tables)])


def bucket_links(group: np.ndarray, side: np.ndarray, lanes: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v (places) and differing bits of the pairs in a group that differ in at most total bits. group is sorted.

    side is 0 for a group that is met with itself; of two blocks that meet, one has 1 and one 2. Groups of more
    than DENSE members give a minimum spanning forest of their pairs only.
    """
    found: list[list[np.ndarray]] = [[], [], []]
    starts = np.concatenate([np.flatnonzero(np.append(True, group[1:] != group[:-1])), [len(group)]])
    sizes = np.diff(starts)
    live, k = np.flatnonzero(np.repeat(sizes <= DENSE, sizes)), 1
    while True:
        live = live[: np.searchsorted(live, len(group) - k)]
        live = live[group[live] == group[live + k]]
        if not len(live):
            break
        i = live[(side[live] == 0) | (side[live] != side[live + k])]
        differ = np.bitwise_count(lanes[i] ^ lanes[i + k]).sum(1, dtype=np.int64)
        near = differ <= total
        for x, y in zip(found, (i[near], i[near] + k, differ[near]), strict=True):
            x.append(y)
        k += 1
    for n in np.flatnonzero(sizes > DENSE):
        s, e = starts[n], starts[n + 1]
        a, b = (s + np.flatnonzero(side[s:e] != x) for x in (2, 1))
        for x, y in zip(found, dense_forest(a, b, lanes, total), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def dense_forest(a: np.ndarray, b: np.ndarray, lanes: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links between the places a and b (the same, or apart): each round every
    place takes its nearest one outside its tree."""
    nodes = np.unique(np.concatenate([a, b]))
    at, bt = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    differ = np.zeros((len(a), len(b)), np.uint16)
    for k in range(lanes.shape[1]):
        differ += np.bitwise_count(lanes[a, k][:, None] ^ lanes[b, k][None, :])
    far = np.uint16(0xFFFF)
    differ[differ > total] = far
    label = np.arange(len(nodes))
    found: list[list[np.ndarray]] = [[], [], []]
    while True:
        differ[label[at][:, None] == label[bt][None, :]] = far
        ends = differ.argmin(1), differ.argmin(0)
        u, v = np.concatenate([np.arange(len(a)), ends[1]]), np.concatenate([ends[0], np.arange(len(b))])
        bits = differ[u, v]
        u, v, bits = (x[bits < far] for x in (u, v, bits))
        if not len(u):
            return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        trees = label[at[u]], label[bt[v]]
        kept = spanning_forest(len(nodes), *trees, bits)
        for x, y in zip(found, (a[u[kept]], b[v[kept]], bits[kept].astype(np.int64)), strict=True):
            x.append(y)
        label = least_reached(np.arange(len(nodes)), trees[0][kept], trees[1][kept])[label]


def proposed_edges(classes: DataFrame, patterns: np.ndarray, total: int, lanes: int, scratch: Scratch) -> DataFrame:
    """u, v, differ: edges that connect all classes (rep, bits) with a pattern in common and at most total differing bits.

    Every class goes to one bucket a table. A bucket of more than BLOCK classes is split, and its blocks are met
    pair by pair. A task leaves a minimum spanning forest (by bits) of what it found, so its output is linear in
    its classes; links left out lie inside what the forest connects, where unsettled_links compares exactly.
    """
    spark = classes.sparkSession
    names = [f"lane{k}" for k in range(lanes)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column("bits").to_pylist())
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(batch), -1), axis=1, bitorder="little")
            columns = [pa.array(x) for x in np.frombuffer(raw, np.int64).reshape(len(batch), -1).T]
            for table, chosen in enumerate(patterns):
                pattern = bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), table, np.int32)), pa.array(pattern), batch.column("rep"), *columns], names=["table", "pattern", "rep", *names])

    placed = classes.select("rep", "bits").mapInArrow(place, "table int, pattern long, rep long, " + ", ".join(f"{x} long" for x in names))
    key = ["table", "pattern"]
    large = scratch.table(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("long")
    met = (
        placed.join(large, key, "left")  # a written side: Spark can split a hot pattern
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*key, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.when(F.col("blocks") == 1, 0).when(F.col("block") < F.col("other"), 1).when(F.col("block") > F.col("other"), 2).otherwise(0).alias("side"), "rep", *names)
    )
    group = [*key, "first", "second"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = met.repartition(parts, *group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            table = pa.concat_tables([x for x in (held, None if batch is None else pa.Table.from_batches([batch])) if x is not None]) if batch is not None or held is not None else None
            if table is None or not table.num_rows:
                continue
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in group])
            new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
            whole = table.num_rows if batch is None else int(np.flatnonzero(new)[-1])  # the last group may go on
            held = table.slice(whole)
            if whole < 2:
                continue
            table = table.slice(0, whole)
            bits = np.stack([table.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
            u, v, differ = bucket_links(np.cumsum(new[:whole]), table.column("side").to_numpy(), bits, total)
            if len(u):
                ids, place = np.unique(table.column("rep").to_numpy(), return_inverse=True)
                u, v = place[u], place[v]
                kept = spanning_forest(len(ids), u, v, differ)
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.minimum(u, v)[kept]]), pa.array(ids[np.maximum(u, v)[kept]]), pa.array(differ[kept])], names=["u", "v", "differ"])

    return ordered.mapInArrow(compare, "u long, v long, differ long").distinct()


def index_edges(classes: DataFrame, lanes: int, radius: int, scratch: Scratch) -> DataFrame:
    """u, v, differ: what connects the classes (rep, bits) whose fingerprints the Gray-order index links at most radius bits apart.

    The fingerprint is the first lane. Classes that share one hang on its least; differ is counted over all lanes.
    """
    digits = F.hex("bits")  # bytes of a lane stand least first
    lane = lambda k: F.concat(*(F.substring(digits, 16 * k + 2 * x + 1, 2) for x in reversed(range(8))))
    words = F.array(*(F.conv(lane(k), 16, -10).cast("long") for k in range(lanes)))
    keyed = scratch.table(classes.select("rep", words.alias("lanes")).withColumn("fp", F.col("lanes")[0]))
    first = scratch.table(keyed.groupBy("fp").agg(F.min("rep").alias("rep")).withColumn("more", F.lit(b"")))
    near = linked_edges(first, radius, scratch)
    of = lambda name: first.select(F.col("fp").alias(name), F.col("rep").alias(f"{name}_rep"))
    across = near.join(of("u"), "u").join(of("v"), "v").select(F.least("u_rep", "v_rep").alias("u"), F.greatest("u_rep", "v_rep").alias("v"))
    inside = keyed.join(first.select("fp", F.col("rep").alias("first")), "fp").filter("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v"))
    side = lambda name: keyed.select(F.col("rep").alias(name), F.col("lanes").alias(f"{name}_lanes"))
    both = across.union(inside).distinct().join(side("u"), "u").join(side("v"), "v")
    differ = F.aggregate(F.zip_with("u_lanes", "v_lanes", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    return both.select("u", "v", differ.cast("long").alias("differ"))


def nearest_edges(edges: DataFrame, few: int = 4) -> DataFrame:
    """u, v: for each node the edges with the fewest differing bits, few of them."""
    both = edges.union(edges.select("v", "u", "differ"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("differ", "v"))
    near = both.withColumn("rank", rank).filter(F.col("rank") <= few)
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def groups(hashed: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """hashed: doc_id, fp, more. Adds component_id, the least doc_id that links of at most radius bits reach."""
    classes = scratch.table(hashed.groupBy("fp").agg(F.first("more").alias("more"), F.min("doc_id").alias("rep")))
    reached = connected_components(linked_edges(classes, radius, scratch), scratch)
    labelled = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    return hashed.join(labelled.join(least, "component").select("fp", "component_id"), "fp")


def shingle_sets(docs: DataFrame, ends: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """rep, shingles (sorted hashes of the distinct shingles) of the classes in ends (rep, doc_id, key)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "packed", PACKED_BYTES):
            out = shingle_set_hashes(*text_bytes(pa.array([unpack(x) for x in batch.column("packed").to_pylist()], pa.binary())), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_key(x) for x in out], pa.binary()), pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "key", "shingles"])

    texts = packed_texts(docs).join(ends.select("doc_id").distinct(), "doc_id").groupBy("doc_id", "version").agg(F.min("packed").alias("packed"))
    found = texts.mapInArrow(sets, "doc_id long, key binary, shingles binary").join(ends, ["doc_id", "key"])  # rows of one id may differ
    return scratch.table(found.groupBy("rep").agg(F.min("shingles").alias("shingles")))


def confirmed(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v) whose sets of shingles have at least the Jaccard similarity."""
    both = edges.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("u_set")), "u").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("v_set")), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, "u_set"):
            keep = []
            for a, b in zip(batch.column("u_set").to_pylist(), batch.column("v_set").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "u long, v long")


def shared_counts(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """How many values each set of a shares with each of b; sets lie end to end."""
    common = np.intersect1d(a, b)
    out = np.zeros((len(a_sizes), len(b_sizes)), np.float32)  # whole numbers below 2**24
    found = []
    for values, sizes in ((a, a_sizes), (b, b_sizes)):
        of, place = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(common, values)
        inside = np.flatnonzero(place < len(common))
        inside = inside[common[place[inside]] == values[inside]]
        inside = inside[np.argsort(place[inside], kind="stable")]
        found.append((of[inside], place[inside], len(sizes)))
    for start in range(0, len(common), 4096):
        sides = []
        for of, place, n in found:
            low, high = np.searchsorted(place, [start, start + 4096])
            side = np.zeros((n, 4096), np.float32)
            side[of[low:high], place[low:high] - start] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def unsettled_links(edges: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """u, v: what connects the links that edges leave out, as edges is thinned to forests before the exact check.

    A cluster is what edges connect, a part what links (the confirmed edges) connect. Where a cluster has more
    than one part, each of its sets is compared exactly with all sets of other parts: in tiles of about TILE sets
    or TILE_BYTES, a large part in tiles of its own, which are never met with each other. A pair of tiles returns
    a spanning forest of its links.
    """
    parts = connected_components(links, scratch).withColumnRenamed("component", "part")
    state = connected_components(edges, scratch).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    state = scratch.table(state.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("part", "rep")))
    several = state.groupBy("cluster").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("cluster")
    opened = scratch.table(state.join(several, "cluster").join(sets, "rep"))
    tiles = F.ceil(F.greatest(F.sum("n") / TILE, F.sum("bytes") / TILE_BYTES)).cast("long")
    sized = scratch.table(opened.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")))
    owner = F.when((F.col("n") >= TILE) | (F.col("bytes") >= TILE_BYTES), F.col("part"))
    owned = sized.select("cluster", "part", owner.alias("owner"), "n", "bytes")
    dealt = owned.groupBy("cluster", "owner").agg(F.greatest(tiles, F.lit(1)).alias("tiles")).withColumnRenamed("cluster", "c").withColumnRenamed("owner", "o")
    owned = owned.join(dealt, (F.col("cluster") == F.col("c")) & F.col("owner").eqNullSafe(F.col("o"))).select("cluster", "part", "owner", "tiles")
    deal = F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("part")).otherwise(F.col("rep"))), F.col("tiles"))
    gathered = opened.join(owned, ["cluster", "part"]).groupBy("cluster", "owner", deal.alias("deal")).agg(F.collect_list(F.struct("rep", "part", "shingles")).alias("rows"))  # a tile

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows, one = batch.column("rows")[row].values, batch.slice(row, 1)
                shingles = rows.field("shingles").to_pylist()
                sizes = np.array([len(x) // 8 for x in shingles], np.int64)
                blobs = rows.field("rep").to_numpy().tobytes(), rows.field("part").to_numpy().tobytes(), sizes.tobytes(), b"".join(shingles)
                yield pa.RecordBatch.from_arrays([one.column("cluster"), one.column("owner"), *(pa.array([x], pa.binary()) for x in blobs)], names=["cluster", "owner", "reps", "parts", "sizes", "shingles"])

    packed = gathered.mapInArrow(pack, "cluster long, owner long, reps binary, parts binary, sizes binary, shingles binary")
    packed = scratch.table(packed.withColumn("node", F.monotonically_increasing_id()))
    side = lambda x: packed.select("cluster", F.col("node").alias(x), F.col("owner").alias(f"{x}_owner"))
    apart = F.col("u_owner").isNull() | F.col("v_owner").isNull() | (F.col("u_owner") != F.col("v_owner"))
    pairs = scratch.table(side("u").join(side("v"), "cluster").filter((F.col("u") <= F.col("v")) & apart).select("u", "v"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("u")[row] == batch.column("v")[row]
                (a_reps, a_parts, a_sizes), (b_reps, b_parts, b_sizes) = ([_values(batch, row, f"{x}_{c}", np.int64) for c in ("reps", "parts", "sizes")] for x in "uv")
                shared = shared_counts(_values(batch, row, "u_shingles"), a_sizes, _values(batch, row, "v_shingles"), b_sizes)
                linked = (shared >= similarity * (a_sizes[:, None] + b_sizes[None, :] - shared)) & (a_parts[:, None] != b_parts[None, :])
                i, j = np.nonzero(np.triu(linked, 1) if own else linked)
                if len(i):
                    ids = a_reps if own else np.concatenate([a_reps, b_reps])
                    j = j + (0 if own else len(a_reps))
                    kept = spanning_forest(len(ids), i, j, np.zeros(len(i), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[kept]]), pa.array(ids[j[kept]])], names=["u", "v"])

    return _met(packed, pairs, ("reps", "parts", "sizes", "shingles")).mapInArrow(compare, "u long, v long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, radius: int = 2) -> DataFrame:
    """doc_id, version (xxhash64 of the text), component, component_id (the component's least doc_id): groups of
    texts linked by a Jaccard similarity of word shingles, one row for each row of docs.

    Texts with the same set of shingles are one class. Operator 4's Gray-order index links the fingerprints of the
    sets at radius bits. It is complete at that radius, but texts at this similarity differ in more bits: each with
    a probability p that follows from the angle between two sets, so that a radius of 3.2 standard deviations above
    the mean is too wide for the index to prune. For these links fingerprints in four lanes (256 bits) are met by
    patterns of some of the bits, in several tables, besides the index's links. All links are then checked
    exactly: the nearest proposals first, then, inside what proposals connect, all pairs that the confirmed
    links don't connect.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = math.ceil(64 * lanes * p + 3.2 * math.sqrt(64 * lanes * p * (1 - p)))
    hashed = scratch.table(set_fingerprints(docs, words, lanes))
    classes = hashed.groupBy("key").agg(F.min("bits").alias("bits"), F.min("doc_id").alias("doc_id"))
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()))
    known = classes.filter("doc_id is not null")
    near = index_edges(known, lanes, radius, scratch)
    wide = proposed_edges(known, plan_patterns(known.count(), p, lanes), total, lanes, scratch)
    edges = scratch.table(near.union(wide).distinct())
    ends = edges.select(F.col("u").alias("rep")).union(edges.select(F.col("v").alias("rep"))).distinct()
    sets = shingle_sets(docs, classes.select("rep", "doc_id", "key").join(ends, "rep"), words, scratch)
    links = scratch.table(confirmed(nearest_edges(edges), sets, similarity))
    links = scratch.table(links.union(unsettled_links(edges.select("u", "v"), links, sets, similarity, scratch)))
    components = connected_components(links, scratch).withColumnRenamed("node", "rep")
    labelled = scratch.table(classes.join(components, "rep", "left").select("key", "doc_id", F.coalesce("component", "rep").alias("component")))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labelled.join(least, "component").select("key", "component", "component_id")
    return hashed.select("doc_id", "version", "key").join(labels, "key").select("doc_id", "version", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    hashed = scratch.table(fingerprints(docs, words))
    return groups(hashed, radius, scratch).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
