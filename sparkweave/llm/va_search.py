"""Exact top-k search with a vector-approximation file (operator 7).

Vectors become whole numbers, floor(256 * x). They are packed into blocks; for each block the file holds,
beside the exact vectors, one byte for each component: its cell in a grid over the block's range. A scan of
the cells bounds every score from above. Exact vectors are read in the order of these bounds until the kth
best exact score is above all bounds that are left (equal bounds are still read, so ties are exact).

Queries are packed into blocks too, and each meets each block of the file once; what leaves a task is k rows
for a query. The best k of these are the result. Blocks are dealt by row, so neither a hot id nor a hot
vector makes a large block.

Edge cases: vectors that are null, or hold null or non-finite components, take no part. Only vectors of equal
length meet; with fewer than k others, all are returned. Rows with the query's own id are never candidates.
Repeated rows are candidates each, and queries each. An empty table gives an empty result. Only vec_id and
embedding are read. Scores are whole numbers; sums beyond 2^53 are computed in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import Scratch

BLOCK, QUERIES, CELLS = 8192, 1024, 64


def whole_vectors(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("embedding").isNotNull() & finite, whole).alias("v")).filter("v is not null and vec_id is not null").withColumn("dim", F.size("v"))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """dim, block number, ids and vectors (end to end) of about size rows."""
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    packed = dealt.groupBy("dim", name).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    return packed.select("dim", name, F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("values"))


def build(vectors: DataFrame) -> DataFrame:
    """The file: for each block its ids, exact vectors, cells (a byte each), and the grid's start and step."""

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = one.column("ids").flatten().to_numpy()
                dim = one.column("dim")[0].as_py()
                x = one.column("values").flatten().to_numpy().reshape(len(ids), dim)
                low = x.min(0) if x.size else np.zeros(dim, np.int64)
                step = ((x.max(0) if x.size else low) - low) // CELLS + 1
                cells = ((x - low) // step).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), one.column("block"), *(pa.array([v.tobytes()], pa.binary()) for v in (ids.astype(np.int64), x.astype(np.int64), cells, low.astype(np.int64), step.astype(np.int64)))],
                    names=["dim", "block", "ids", "vectors", "cells", "low", "step"],
                )

    return _packed(vectors, BLOCK, "block").mapInArrow(approximate, "dim int, block long, ids binary, vectors binary, cells binary, low binary, step binary")


def best_in_block(q_ids, q, ids, x, cells, low, step, k: int):
    """(query row, candidate row, exact score) of the k best of one block for each query; and how many vectors were read."""
    dim = q.shape[1]
    small = dim * float(np.abs(q).max(initial=0)) * float(max(np.abs(x).max(initial=0), np.abs(low).max(initial=0) + CELLS * np.abs(step).max(initial=0))) < 2**52
    kind = np.float64 if small else np.longdouble
    bottom = low + cells.astype(np.int64) * step
    top = bottom + step - 1
    bound = np.maximum(q, 0).astype(kind) @ top.T.astype(kind) + np.minimum(q, 0).astype(kind) @ bottom.T.astype(kind)
    if not small:
        bound = bound * (1 + 1e-15 * np.sign(bound)) + 1
    own = q_ids[:, None] == ids[None, :]
    bound[own] = -np.inf
    exact = (lambda i, j: (q[i].astype(np.float64) * x[j].astype(np.float64)).sum(-1).astype(np.int64)) if small else (lambda i, j: (q[i] * x[j]).sum(-1))
    out_q, out_c, out_s, read = [], [], [], 0
    for i in range(len(q)):
        left = bound[i]
        n = min(len(ids), 4 * k)
        order = np.argpartition(-left, n - 1)[:n] if n < len(ids) else np.arange(len(ids))
        order = order[np.isfinite(left[order])]
        seen, scores = order, exact(i, order)
        read += len(order)
        if len(scores) >= k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rest = np.flatnonzero(left >= least)
            rest = rest[~np.isin(rest, order)]
            rest = rest[np.argsort(-left[rest], kind="stable")]
            at = 0
            while at < len(rest) and left[rest[at]] >= least:
                some = rest[at : at + 64]
                seen, scores = np.append(seen, some), np.append(scores, exact(i, some))
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                at += 64
            read += min(at, len(rest))
        best = np.lexsort((ids[seen], -scores))[:k]
        out_q.append(np.full(len(best), i)), out_c.append(seen[best]), out_s.append(scores[best])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s), read


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query."""
    scratch = Scratch(vectors.sparkSession, "va-search")
    rows = scratch.table(whole_vectors(vectors))
    index = scratch.table(build(rows))
    blocks = index.select("dim", "block")
    asked = scratch.table(_packed(rows.filter(is_query), QUERIES, "query_block"))
    meet = asked.withColumnRenamed("ids", "q_ids").withColumnRenamed("values", "q_values").join(blocks, "dim")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = meet.repartition(parts, "block", "query_block").join(index, ["dim", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                dim = one.column("dim")[0].as_py()
                q_ids = one.column("q_ids").flatten().to_numpy()
                q = one.column("q_values").flatten().to_numpy().reshape(len(q_ids), dim)
                ids, x, low, step = (np.frombuffer(one.column(c)[0].as_py(), np.int64) for c in ("ids", "vectors", "low", "step"))
                cells = np.frombuffer(one.column("cells")[0].as_py(), np.uint8).reshape(len(ids), dim)
                i, j, score, _ = best_in_block(q_ids, q, ids, x.reshape(len(ids), dim), cells, low, step, k)
                number = one.column("query_block")[0].as_py() * (1 << 20)
                yield pa.RecordBatch.from_arrays([pa.array(number + i), pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    found = meet.mapInArrow(scan, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
