"""Running sums, ranks, quantiles and pair counts within groups of any size, by ranges of values.

Rows are dealt by ranges of (group, value), so a large group fills many tasks; each range is summed, and the sums
of the ranges before it are joined back. No window spans a group: windows span one range of one group, or the
list of a group's ranges, which has at most as many rows as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.sources.sequences import once


def running(rows: DataFrame, by: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Adds before_<s> and all_<s> for each of sums: its sum over the group's rows before this one in order, and over all.

    rows have one row for each by and order (aggregate first: equal values then need no range of their own). Null groups
    are groups. The dealt rows are written once, since ranges must not change between the sums and their use.
    """
    keys = [*by, "__part"]
    dealt = once(rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = parts.select(*(F.col(k).alias(f"{k}__o") for k in keys), *(x for s in sums for x in (F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}__o"), F.sum(s).over(whole).alias(f"all_{s}"))))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in keys))
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", *(F.coalesce(F.sum(s).over(local), F.lit(0)).alias(f"{s}__l") for s in sums))
    return inside.join(offsets, same).select(*rows.columns, *(x for s in sums for x in ((F.col(f"{s}__l") + F.col(f"{s}__o")).alias(f"before_{s}"), F.col(f"all_{s}"))))


def ranked(counts: DataFrame, by: Sequence[str], value: str, count: str = "c") -> DataFrame:
    """counts: one row for each by and value. Adds rank, the average rank of the value's copies, and the group's n."""
    out = running(counts, by, value, [count])
    return out.select(*counts.columns, (F.col(f"before_{count}") + (F.col(count) + 1) / 2).alias("rank"), F.col(f"all_{count}").alias("n"))


def value_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, c: how often each finite value occurs."""
    x = F.col(value).cast("double")
    return rows.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by, n and, for each name, the value at this place (from 0) in the group's order; a place may use n."""
    placed = running(value_counts(rows, by, value), by, value, ["c"]).withColumnRenamed("all_c", "n")
    at = lambda place: F.max(F.when((F.col("before_c") <= place) & (place < F.col("before_c") + F.col("c")), F.col(value)))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(at(place).alias(name) for name, place in places.items()))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by, n and the named quantiles, with linear interpolation between neighbours; non-finite values are left out."""
    top = F.col("n") - 1
    spot = {name: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(q)))) * top for name, q in wanted.items()}
    places = {f"{name}__{end}": F.least(F.floor(h) + end, top) for name, h in spot.items() for end in (0, 1)}
    found = order_statistics(rows, by, value, places)
    low, high = (lambda name: F.col(f"{name}__0")), (lambda name: F.col(f"{name}__1"))
    return found.select(*by, "n", *((low(name) + (high(name) - low(name)) * (h - F.floor(h))).alias(name) for name, h in spot.items()))


def pair_orders(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, same and opposite: pairs of rows with different x and different y, ordered alike or the other way round.

    Counted by merging instead of pairing. Distinct x of a group are numbered; two numbers differ first at one bit, and
    there one has 0 and the other 1 below the same leading bits. So each row stands once for every bit, and within a
    block (bit, leading bits) the zeros with a lower y than a one are counted by a running sum in the order of y. That is
    rows times bits of the largest number in all.
    """
    counts = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))
    numbers = running(counts.select(*by, x).distinct().withColumn("one", F.lit(1)), by, x, ["one"]).select(*(F.col(k).alias(f"{k}__n") for k in (*by, x)), F.col("before_one").alias("number"))
    numbers = once(numbers, "numbers")
    bits = max(1, (numbers.agg(F.max("number")).first()[0] or 0).bit_length())
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}__n")) for k in (*by, x)))
    at = counts.join(numbers, same).select(*by, y, "c", "number", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("__bit"))
    shifted = F.call_function("shiftright", F.col("number"), F.col("__bit"))
    one = shifted.bitwiseAND(F.lit(1)) == 1
    at = at.select(*by, "__bit", F.call_function("shiftright", shifted, F.lit(1)).alias("__lead"), y, F.when(one, 0).otherwise(F.col("c")).alias("zeros"), F.when(one, F.col("c")).otherwise(0).alias("ones"))
    block = [*by, "__bit", "__lead"]
    merged = running(at.groupBy(*block, y).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")), block, y, ["zeros"])
    above = F.col("all_zeros") - F.col("before_zeros") - F.col("zeros")
    return merged.groupBy(*by).agg(F.sum(F.col("ones") * F.col("before_zeros")).alias("same"), F.sum(F.col("ones") * above).alias("opposite"))
