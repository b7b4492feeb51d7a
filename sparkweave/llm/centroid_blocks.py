"""Exact centroid clustering over Hilbert-ordered blocks (operator 11).

Vectors become whole numbers, floor(1024 * x). They are sorted once along a Hilbert curve through all components
(GRID bits each) and cut into blocks of BLOCK vectors, stored with the least and greatest value of each component:
a zone map. In each round the box of a block bounds the distance of its vectors to every centroid from below and
from above; centroids whose lower bound exceeds another's upper bound can't be nearest in that block. The others
are compared exactly, whole numbers throughout. What leaves a task is a count, a sum of distances and a sum of
vectors for each centroid, so a round moves a few rows a task, and the driver holds nothing but centroids.

Sorting is spread by a number drawn from the row's place, so that equal vectors, however many, fill many blocks
and many tasks. How blocks are cut changes no result.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part. A null
vec_id is kept; it comes last among the starting centroids. Repeated rows count as often as they stand. Ties of the
starting order go to the lesser vector, ties of distance to the smaller centroid number. With fewer vectors than
centroids, each is a centroid. An empty table gives an empty result. Only vec_id and embedding are read. A component
of 131,072 or more in size is an error, since squared distances must fit 64 bits; sums of distances are decimals, and
null where they do not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import Scratch, mixed

#: Vectors of a block, bits of a component in the curve, blocks that one numpy step handles.
BLOCK, GRID, BLOCKS = 64, 4, 128

#: Whole numbers below this in size have exact products and sums in doubles (64 components), and in longs.
IN_DOUBLES, IN_LONGS = 1 << 22, 1 << 27


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = lambda x: x.cast("double") * scale
    fits = lambda x: F.when(F.abs(scaled(x)) < IN_LONGS - 1, F.floor(scaled(x)).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    kept = vectors.filter((F.size("embedding") == dims) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", fits).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes that sort like the places of the cells (one row each, values below 2**bits) on a Hilbert curve.

    By Skilling's method: undo the turns of all subcubes from the greatest down, then Gray-code and interleave.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in x:
            turned = (axis & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(turned, below, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flips
    return np.packbits(np.concatenate([(x >> level & 1).astype(np.uint8) for level in range(bits - 1, -1, -1)]).T, axis=1)


def build(vectors: DataFrame, dims: int) -> DataFrame:
    """The blocks in curve order: ids, values (whole vectors end to end), low and high (the box)."""
    low, high = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    width = (high - low) // (1 << GRID) + 1 if low is not None else 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            keys = hilbert_keys((x.astype(np.int64) - low) // width, GRID)
            spread = mixed(np.arange(done, done + len(x), dtype=np.uint64)).view(np.int64)
            done += len(x)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(x), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(x), [None, pa.py_buffer(x.astype(np.int32).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, pa.array(spread), batch.column("vec_id"), values], names=["key", "spread", "vec_id", "values"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = b"".join(part.column("values").to_pylist())
                x = np.frombuffer(values, np.int32).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in (values, x.min(0).tobytes(), x.max(0).tobytes()))],
                    names=["ids", "values", "low", "high"],
                )

    dealt = vectors.mapInArrow(keyed, "key binary, spread long, vec_id long, values binary").repartitionByRange("key", "spread")
    return dealt.sortWithinPartitions("key", "spread").mapInArrow(blocks, "ids array<long>, values binary, low binary, high binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box (rows of low and high) and centroid, whether it may be nearest to a vector in the box."""
    lows, highs = low[:, None].astype(np.int64), high[:, None].astype(np.int64)
    least = (np.maximum(0, np.maximum(lows - centroids, centroids - highs)) ** 2).sum(2)
    most = (np.maximum(np.abs(centroids - lows), np.abs(centroids - highs)) ** 2).sum(2)
    return least <= most.min(1)[:, None]


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance, for the vectors x of blocks of these sizes and boxes."""
    open_pairs = candidates(low, high, centroids)
    small = max(np.abs(low).max(), np.abs(high).max(), np.abs(centroids).max()) < IN_DOUBLES
    values = x.astype(np.float64 if small else np.int64)
    best, distance = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    squares = np.einsum("ij,ij->i", values, values) if small else None
    for k, centroid in enumerate(centroids.astype(values.dtype)):
        rows = slice(None) if open_pairs[:, k].all() else np.flatnonzero(np.repeat(open_pairs[:, k], sizes))
        if small:
            found = (squares[rows] - 2 * (values[rows] @ centroid) + centroid @ centroid).astype(np.int64)
        else:
            found = ((values[rows] - centroid) ** 2).sum(1)
        closer = found < distance[rows]
        distance[rows] = np.where(closer, found, distance[rows])
        best[rows] = np.where(closer, k, best[rows])
    return best, distance


def _steps(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors, boxes' low and high, and block sizes of up to BLOCKS blocks at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCKS):
            part = batch.slice(start, BLOCKS)
            x, low, high = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int32).reshape(-1, dims) for c in ("values", "low", "high"))
            ids = part.column("ids")
            yield ids.flatten(), x, low, high, ids.value_lengths().to_numpy()


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, Decimal, list[int]]]:
    """For each centroid with vectors: their count, sum of distances and sum."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals, added = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, x, low, high, sizes in _steps(batches, dims):
            best, distance = nearest(x, low, high, sizes, centroids)
            counts += np.bincount(best, minlength=k)
            for c in range(k):
                mine = best == c
                added[c] += x[mine].sum(0, dtype=np.int64)
                totals[c] += int(distance[mine].sum()) if distance.max(initial=0) < 1 << 40 else sum(distance[mine].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0)), pa.array(added.tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total", "added"],
        )

    parts = blocks.mapInArrow(partial, "cluster int, n long, total decimal(38,0), added array<long>").filter("n > 0")
    each = parts.select("cluster", "n", "total", F.posexplode("added").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, Decimal, list[int]]] = {}
    for row in each.collect():
        out.setdefault(row["cluster"], (row["n"], row["total"], [0] * dims))[2][row["i"]] = row["s"]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([row["v"] for row in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(rows, k, seed)
    schema = "vec_id long, cluster int, distance long"
    more = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, {more.split(', ', 1)[1]}")
    blocks = Scratch(spark, "centroids").table(build(rows, dims))
    for _ in range(rounds):
        for number, (n, _total, added) in sums(blocks, centroids).items():
            centroids[number] = [s // n for s in added]
    found = sums(blocks, centroids)
    fits = lambda total: int(total) if total < 1 << 63 else None
    inertia = fits(sum(total for _, total, _ in found.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = spark.createDataFrame([(number, fits(total), inertia, digest(centroids[number].tolist())) for number, (_, total, _) in sorted(found.items())], more)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, low, high, sizes in _steps(batches, dims):
            best, distance = nearest(x, low, high, sizes, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(assigned, schema).join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
