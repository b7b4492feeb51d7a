"""Near-duplicate vectors (operator 1): random-hyperplane sign hashing in several tables, exact cosine
verification, connected components.

Vectors of one label with the same components are one class with a count; the classes are hashed. In each
table the signs of a vector's products with random hyperplanes make its bucket. The number of hyperplanes
grows with the logarithm of the number of classes, so that buckets stay small, and the number of tables
follows from it and from the wanted recall at the threshold: two vectors at cosine 0.93 share no bucket with
a probability of MISS at most, and closer ones more rarely still.

Members of a bucket are compared in blocks of BLOCK vectors, block against block, in double precision. What
leaves a task is linear in its members: for each vector the number of links (a pair counts in the first
table whose bucket it shares) and the least vector it is connected to inside the block, for the components.
No pairs are written, however large a group of near copies is.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label, link with nothing and are components of their own. Vectors of different lengths never link. Repeated
rows link with each other. Repeated ids are rows of their own: each has its vector's links, and all have a
common component. A row without an id counts as a link; it has its component's least id, null if there is none,
and is never kept. An empty table gives an empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import Scratch
from sparkweave.llm.components import connected_components, least_reached

BLOCK = 1024
MISS = 5e-4


def usable(embedding: str = "embedding") -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def plan_tables(classes: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes of a table and number of tables."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(8, math.ceil(math.log2(max(1, classes) / 16))) if classes > 16 else 8)
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


@functools.lru_cache(maxsize=4)
def hyperplanes(bits: int, tables: int, dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    signs = (x @ planes > 0).reshape(len(x), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _compare(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, side: np.ndarray, two: bool, table: int, bits: int, tables: int, threshold: float):
    """Links of each vector of a bucket (or of two of its blocks), and the least id that each is connected to here."""
    norm = np.sqrt((x * x).sum(1))
    if two:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    else:
        a = b = np.arange(len(ids))
    u, v = np.nonzero((x[a] @ x[b].T) / np.outer(norm[a], norm[b]) >= threshold)
    u, v = a[u], b[v]
    if not two:
        u, v = u[u < v], v[u < v]
    links = np.zeros(len(ids), np.int64)
    parent = ids
    if len(u):
        used, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        s = signatures(x[used], hyperplanes(bits, tables, x.shape[1])[:, : table * bits], bits)
        for start in range(0, len(u), 100_000):
            p, q = place[: len(u)][start : start + 100_000], place[len(u) :][start : start + 100_000]
            new = ~(s[p] == s[q]).any(1)
            i, j = u[start : start + 100_000][new], v[start : start + 100_000][new]
            links += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
        parent = least_reached(ids, u, v)
    return links, parent


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    rows = scratch.table(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label"),
            F.when(F.col("label").isNotNull() & usable(), F.col("embedding")).alias("vector"),
        )
    )
    good = rows.filter("vector is not null")
    classes = scratch.table(good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    bits, tables = plan_tables(classes.count(), threshold)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                s = signatures(_matrix(part.column("vector")), hyperplanes(bits, tables, int(dim)), bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), part.column("label"), part.column("dim"), pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * tables, pa.array(s.ravel()))],
                    names=["class", "label", "dim", "buckets"],
                )

    label_type = dict(classes.dtypes)["label"]
    hashed = classes.select("class", "label", "dim", "vector").mapInArrow(hash_rows, f"class long, label {label_type}, dim int, buckets array<long>")
    key = ["label", "dim", "table", "bucket"]
    members = scratch.table(hashed.select("class", "label", "dim", F.posexplode("buckets").alias("table", "bucket")))
    counts = scratch.table(members.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))  # a written side lets Spark split a hot bucket
    blocks = F.ceil(F.col("members") / BLOCK)
    placed = (
        members.join(counts, key)
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("class", "table", "bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = ["label", "dim", "table", "bucket", "first", "second"]
    together = placed.join(classes.select("class", "n", "label", "dim", "vector"), "class").repartition(parts, *group).sortWithinPartitions(*group, "class")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            """Bucket blocks that are complete in the table; the rest is held back."""
            nonlocal held
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("code", "dim", "table", "bucket", "first", "second")])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [table.num_rows]])
            whole = len(starts) - 1 if last else len(starts) - 2
            held = None if last else table.slice(starts[-2])
            if whole <= 0:
                return
            table = table.slice(0, starts[whole]).combine_chunks()
            ids, weight, block = (table.column(c).to_numpy() for c in ("class", "n", "block"))
            dims = keys[1]
            values = table.column("vector").combine_chunks()
            values = (values.flatten() if not isinstance(values, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in values.chunks])).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(dims[: starts[whole]])])
            out_ids, out_links, out_parents = [], [], []
            for s, e in zip(starts[:whole], starts[1 : whole + 1], strict=True):
                two = keys[4, s] != keys[5, s]
                if e - s < 2:
                    continue
                x = values[at[s] : at[e]].astype(np.float64).reshape(e - s, dims[s])
                side = (block[s:e] != keys[4, s]).astype(np.int8)
                links, parent = _compare(x, ids[s:e], weight[s:e], side, bool(two), int(keys[2, s]), bits, tables, threshold)
                changed = (links > 0) | (parent != ids[s:e])
                out_ids.append(ids[s:e][changed]), out_links.append(links[changed]), out_parents.append(parent[changed])
            if out_ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_ids, out_links, out_parents)], names=["class", "links", "parent"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            yield from groups(table, False)
        if held is not None:
            yield from groups(held, True)

    columns = ["class", "n", F.xxhash64("label").alias("code"), "dim", "table", "bucket", "first", "second", "block", "vector"]
    found = scratch.table(together.select(*columns).mapInArrow(verify, "class long, links long, parent long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    of_row = scratch.table(good.join(classes.select("label", "vector", "class"), ["label", "vector"]).select("vec_id", "class"))
    # Vectors that share an id have a common component, though no link.
    shared = scratch.table(of_row.filter("vec_id is not null").groupBy("vec_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high"))
    same_id = of_row.join(shared, "vec_id").select(F.col("class").alias("u"), F.col("low").alias("v"))
    components = connected_components(found.select(F.col("class").alias("u"), F.col("parent").alias("v")).union(same_id), scratch)
    per_class = classes.select("class", "rep", "n").join(links, "class", "left").join(components.withColumnRenamed("node", "class"), "class", "left")
    per_class = scratch.table(per_class.select("class", "rep", F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = of_row.join(per_class.join(least, "component").select("class", "n_links", "component_id"), "class").select("vec_id", "n_links", "component_id")
    bare = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    by_id = of_row.join(per_class.join(least, "component").select("class", "component_id"), "class").groupBy(F.col("vec_id").alias("id")).agg(F.min("component_id").alias("component_id"))
    alone = bare.join(by_id, F.col("vec_id") == F.col("id"), "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
