"""Aggregations over samples and arms: strata, gaps, taxonomies, histograms and cross-run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.stats import finite
from sparkweave.operators.metrics import BINS
from sparkweave.operators.ranges import quantiles, running


def nanmean(x: Column) -> Column:
    """Mean without nulls and NaN; infinities count."""
    return F.avg(F.when(~F.isnan(x), x))


def distribution_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population sd, min, quartiles and max of finite values."""
    x = finite(F.col(value))
    out = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    return _beside(out, quantiles(rows, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}), by).select(*by, "n", "mean", "sd", "min", "p25", "median", "p75", "max")


def _beside(out: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """out with the other columns of found, joined by the groups; a null group is a group."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out.join(found.drop("n").withColumnsRenamed({c: f"__{c}" for c in by}), same, "left")


def describe_group(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median (of the middle two), sample sd, min and max."""
    x = F.col(value)
    out = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    return _beside(out, quantiles(rows, by, value, {"median": 0.5}), by).select(*by, "n", "mean", "median", "sd", "min", "max")


def bins_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, label) for i, (label, _, _) in enumerate(BINS)], "bin_no int, bin string")


def stratify_by_bin(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with bin. n and usable values of every bin, empty ones too."""
    spark = rows.sparkSession
    keys = rows.select(*by).distinct()
    grid = keys.join(F.broadcast(bins_table(spark)))
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.count(finite(F.col(value))).alias("usable"), F.avg(finite(F.col(value))).alias("mean"))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("usable", F.lit(0)).alias("usable"), "mean")


def lift_over_baseline(rows: DataFrame, by: list[str], arm: str, baseline: str) -> DataFrame:
    """Per bin, empty ones too: n, pairs where both are usable, their means and the mean paired difference."""
    a, b = finite(F.col(arm)), finite(F.col(baseline))
    both = a.isNotNull() & b.isNotNull()
    found = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(both, 1)).alias("n_usable"), F.avg(F.when(both, a)).alias("arm_mean"), F.avg(F.when(both, b)).alias("baseline_mean"), F.avg(F.when(both, a - b)).alias("lift"))
    grid = rows.select(*by).distinct().join(F.broadcast(bins_table(rows.sparkSession)))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(found, [*by, "bin"], "full").select(*by, "bin", none("n"), none("n_usable"), "arm_mean", "baseline_mean", "lift")


def counts_with_zeros(rows: DataFrame, by: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """count and share of each kind in a fixed list, zeros kept."""
    spark = rows.sparkSession
    grid = rows.select(*by).distinct().join(F.broadcast(spark.createDataFrame([(k,) for k in kinds], f"{kind} string")))
    counts = rows.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("count"))
    out = grid.join(counts, [*by, kind], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def display_samples(rows: DataFrame, by: list[str], order: str, limit: int = 30, head: int = 15, tail: int = 5) -> DataFrame:
    """All rows of groups up to limit, else the first head and the last tail; hidden is how many are left out."""
    placed = running(rows.withColumn("__one", F.lit(1)), by, order, ["__one"])
    k, n = F.col("before___one"), F.col("all___one")
    shown = placed.filter((n <= limit) | (k < head) | (k >= n - tail))
    return shown.withColumn("hidden", F.when(n > limit, n - head - tail).otherwise(0)).drop("__one", "before___one", "all___one")


def ceiling_gap(rows: DataFrame, by: list[str], ceiling: str, chosen: str) -> DataFrame:
    gap = F.col(ceiling) - F.col(chosen)
    return rows.groupBy(*by).agg(F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.count(F.when(gap > 1e-12, 1)).alias("n_gap"))


def median_split(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mean of y up to the median of x, less that above; null under four rows or with an empty side."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    middle = _beside(sizes, quantiles(rows, by, x, {"__m": 0.5}), by).select(*by, "__m", "n")
    low, high = F.when(F.col(x) <= F.col("__m"), F.col(y)), F.when(F.col(x) > F.col("__m"), F.col(y))
    out = rows.join(middle, by).groupBy(*by).agg(F.max("n").alias("n"), F.avg(low).alias("low_mean"), F.avg(high).alias("high_mean"))
    return out.withColumn("difference", F.when(F.col("n") >= 4, F.col("low_mean") - F.col("high_mean")))


def stratified_delta(rows: DataFrame, by: list[str], group: str, a: str, b: str, value: str, least: int = 3) -> DataFrame:
    """Difference of means of groups a and b within bins, weighted by the bins' sizes; bins need least rows of each."""
    x = F.col(value)
    of = lambda g: F.when(F.col(group) == g, x)
    bins = rows.filter(F.col(group).isin(a, b)).groupBy(*by, "bin").agg(F.count(of(a)).alias("na"), F.count(of(b)).alias("nb"), F.avg(of(a)).alias("ma"), F.avg(of(b)).alias("mb"))
    used = bins.filter((F.col("na") >= least) & (F.col("nb") >= least)).withColumn("w", F.col("na") + F.col("nb"))
    agg = used.agg if not by else used.groupBy(*by).agg
    return agg((F.sum((F.col("ma") - F.col("mb")) * F.col("w")) / F.sum("w")).alias("delta"), (F.sum(F.col("mb") * F.col("w")) / F.sum("w")).alias("base"), F.count(F.lit(1)).alias("bins"))


def common_language_effect(rows: DataFrame, group: str, a: str, b: str, value: str, least: int = 3) -> DataFrame:
    """P(a > b) + P(a = b) / 2 within bins that have least rows of each, from rank sums of distinct values, without pairs."""
    of = lambda g: F.count(F.when(F.col(group) == g, 1))
    values = rows.filter(F.col(group).isin(a, b)).groupBy("bin", value).agg(of(a).alias("ca"), of(b).alias("cb"))
    wins = running(values, ["bin"], value, ["cb"]).withColumn("wins", F.col("ca") * (F.col("before_cb") + F.col("cb") / 2))
    bins = wins.groupBy("bin").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.sum("wins").alias("wins")).filter((F.col("na") >= least) & (F.col("nb") >= least))
    return bins.agg((F.sum("wins") / F.sum(F.col("na") * F.col("nb"))).alias("effect"), F.count(F.lit(1)).alias("bins"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, the last closed, empty ones kept; width 1e-6 if all are equal."""
    x = finite(F.col(value))
    ends = rows.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1e-6))
    placed = rows.join(ends, by).filter(x.isNotNull()).withColumn("bin", F.least(F.floor((x - F.col("lo")) / F.col("width")), F.lit(bins - 1)))
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select(*by, "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("count", F.lit(0)).alias("count"))


def binned_means(rows: DataFrame, by: list[str], x: str, y: str, width: int, last: int) -> DataFrame:
    """Mean of y in bins (low, low + width] of x up to last, empty ones too; what lies beyond is counted as bin null."""
    bin_ = F.when(F.col(x) <= last, (F.ceil(F.col(x) / width) - 1) * width)
    found = rows.groupBy(*by, bin_.alias("low")).agg(F.count(F.lit(1)).alias("n"), nanmean(F.col(y)).alias("mean"))
    lows = F.array(*(F.lit(x).cast("long") for x in [*range(0, last, width), None]))
    grid = rows.select(*by).distinct().select(*by, F.explode(lows).alias("low"))
    same = F.col("low").eqNullSafe(F.col("__low"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = grid.join(found.withColumnsRenamed({c: f"__{c}" for c in [*by, "low"]}), same, "left")
    return met.select(*by, "low", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def gain_histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """As histogram, in min(20, max(6, n // 5)) bins for the n values of a group."""
    x = finite(F.col(value))
    ends = rows.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.least(F.lit(20), F.greatest(F.lit(6), F.floor(F.count(x) / 5))).cast("long").alias("bins"))
    ends = ends.withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1e-6))
    placed = rows.join(ends, by).filter(x.isNotNull()).withColumn("bin", F.least(F.floor((x - F.col("lo")) / F.col("width")), F.col("bins") - 1))
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select(*by, "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("count", F.lit(0)).alias("count"))
