"""Connected components by alternating large and small stars, on Spark joins only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


#: Edges up to which a round is dealt by node to few partitions; above it Spark chooses, and may split a hub's edges.
FEW_EDGES, EDGES_A_PART = 2_000_000, 100_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: u, v (long). Returns node, component for each node that has an edge to another: the least node it reaches.

    A large star links all larger neighbours of a node to its least neighbour, a small star the node and its
    smaller neighbours to the least of them. Both only lower the ends of edges, and their number never grows.
    The table is cut off by a write in each round; a hub's edges are only ever aggregated (with partial sums)
    and joined (where Spark can split a hot key). Loops and repeated edges are allowed; no edges, no rows.
    """
    edges = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(-(-before[0] // EDGES_A_PART), "u") if before[0] <= FEW_EDGES else df

    while before[0]:
        both = dealt(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(dealt(large).distinct())
        again = dealt(large)
        least = again.groupBy("u").agg(F.min("v").alias("m"))
        small = again.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following = scratch.table(dealt(small).distinct())
        scratch.drop(edges)
        scratch.drop(large)
        edges, now = following, _state(following)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def least_reached(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of a task's ids, the least id it reaches over the links (u[k], v[k]), which are places in ids."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[order[label]]
        if (label == before).all():
            return ids[order[label]]


def spanning_forest(size: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges make a minimum spanning forest: each tree takes its lightest edge out, until none is left."""
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(u))
    edge_of = np.argsort(rank)
    label, live, chosen = np.arange(size), np.arange(len(u)), []
    while True:
        live = live[label[u[live]] != label[v[live]]]
        if not len(live):
            return np.concatenate(chosen) if chosen else live
        best = np.full(size, len(u))
        np.minimum.at(best, label[u[live]], rank[live])
        np.minimum.at(best, label[v[live]], rank[live])
        taken = edge_of[np.unique(best[best < len(u)])]
        chosen.append(taken)
        label = least_reached(np.arange(size), label[u[taken]], label[v[taken]])[label]
