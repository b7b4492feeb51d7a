"""Intervals and tests as column expressions and aggregations.

Heavy work (ranks, counts, sums) is done by Spark; the closed formulas then run on a handful of result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.rounding import settle

from sparkweave.operators.ranges import ranked, running, value_counts
from sparkweave.operators.resampling import MEAN, Statistic, beside, replicates
from sparkweave.operators.segment import draw
from sparkweave.sources.sequences import once


#: Degrees of freedom up to which Student's series is summed.
MANY_DEGREES = 100_000


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), x.cast("double"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by its series; 0 and 1 beyond 8."""
    first = F.struct(z.alias("term"), z.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), first, lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum")))["sum"]
    density = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(0.5 + density * series)


def normal_quantile(p: Column) -> Column:
    """The inverse by bisection on the series: 60 halvings of [-8, 8]."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(-8.0).alias("low"), F.lit(8.0).alias("high")),
        lambda s, _: F.when(normal_cdf((s["low"] + s["high"]) / 2) < p, F.struct(((s["low"] + s["high"]) / 2).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), ((s["low"] + s["high"]) / 2).alias("high"))),
    )
    return (pair["low"] + pair["high"]) / 2


#: Fixed value: the normal quantile of 0.975.
Z95 = 1.959963984540054


def wilson_interval(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of k successes in n; pinned to 0 and 1 at k = 0 and k = n; NaN for n <= 0."""
    m = F.when(n > 0, n)
    p = k / m
    centre, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    bound = lambda x: x / (1 + z * z / m)
    nan = F.lit(float("nan"))
    low = F.when(n <= 0, nan).when(k == 0, 0.0).otherwise(bound(centre - half))
    high = F.when(n <= 0, nan).when(k == n, 1.0).otherwise(bound(centre + half))
    return low, high


def mcnemar_exact(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Paired binary columns: n10, n01, n11, n00 and the exact two-sided p at one half."""
    counts = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count(F.when((F.col(a) == 1) & (F.col(b) == 0), 1)).alias("n10"),
        F.count(F.when((F.col(a) == 0) & (F.col(b) == 1), 1)).alias("n01"),
        F.count(F.when((F.col(a) == 1) & (F.col(b) == 1), 1)).alias("n11"),
        F.count(F.when((F.col(a) == 0) & (F.col(b) == 0), 1)).alias("n00"),
    )
    n, m = F.col("n10") + F.col("n01"), F.least("n10", "n01")
    # log2 of each binomial term, by ratios of neighbours
    tail = F.aggregate(
        F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum")),
        lambda s, k: F.struct((s["log"] + F.log((n - k + 1) / k)).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - k + 1) / k) - n * F.log(F.lit(2.0)))).alias("sum")),
    )["sum"]
    return counts.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def wilcoxon_exact_p(w: Column, n: Column) -> Column:
    """Two-sided p of the smaller rank sum w of n untied differences, by counting subsets of ranks with each sum."""
    total = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), total), lambda i: F.when(i == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda c, r: F.transform(c, lambda x, i: x + F.when(i >= r, F.get(c, i - r)).otherwise(F.lit(0).cast("long"))))
    at_or_below = F.aggregate(F.slice(counts, 1, F.floor(w).cast("int") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2.0 * at_or_below / F.pow(F.lit(2.0), n))


def wilcoxon_signed_rank(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """n_pairs, n_nonzero, n_positive, n_negative, w_plus, w_minus, ties, median_delta and p of paired columns.

    Zero differences are dropped; exact p without ties up to 50 differences, else the normal approximation with
    tie and continuity corrections. Differences are rounded to nine digits, so that equal ones tie. A group
    is aggregated to its distinct differences first; ranks then come from ranges of them.
    """
    d = F.round(F.col(a) - F.col(b), 9)
    pairs = rows.filter(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull()).select(*by, d.alias("d"))
    # Three branches read the distinct differences; the pairs are read once.
    values = once(pairs.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("c")), "differences")
    placed = running(values, by, "d", ["c"])
    middle = F.floor(F.col("all_c") / 2)
    medians = placed.filter((F.col("before_c") <= middle) & (middle < F.col("before_c") + F.col("c"))).select(*by, F.col("d").alias("median_delta"))
    sizes = values.filter("d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.sum("c").alias("tie"), F.sum(F.when(F.col("d") > 0, F.col("c")).otherwise(0)).alias("plus"))
    sums = ranked(sizes, by, "size", "tie").groupBy(*by).agg(
        F.sum("tie").alias("n_nonzero"),
        F.sum("plus").alias("n_positive"),
        F.sum(F.col("rank") * F.col("plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("tie") - F.col("plus"))).alias("w_minus"),
        F.sum((F.pow("tie", F.lit(3)) - F.col("tie"))).alias("ties"),
    )
    out = values.groupBy(*by).agg(F.sum("c").alias("n_pairs")).join(medians, by, "left").join(sums, by, "left").fillna(0, ["n_nonzero", "n_positive", "w_plus", "w_minus", "ties"])
    # In doubles: the cube of two million differences is beyond a long.
    n, w = F.col("n_nonzero").cast("double"), F.least("w_plus", "w_minus")
    var = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24
    z = F.greatest((F.abs(w - n * (n + 1) / 4) - 0.5) / F.sqrt(var), F.lit(0.0))
    normal = F.when(var <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))))
    exact = (F.col("ties") == 0) & (n <= 50)
    p = F.when(n == 0, 1.0).when(exact, wilcoxon_exact_p(w, n)).otherwise(normal)
    return out.select(*by, "n_pairs", "n_nonzero", "n_positive", (F.col("n_nonzero") - F.col("n_positive")).alias("n_negative"), "w_plus", "w_minus", "ties", "median_delta", p.alias("p"))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p for whole degrees of freedom, by the finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    count = F.when(df <= MANY_DEGREES, F.floor((df - F.when(odd, 3).otherwise(2)) / 2)).otherwise(0).cast("int")
    step = lambda s, k: F.struct((s["term"] * c2 * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("term"), (s["sum"] + s["term"] * c2 * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("sum"))
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    series = F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("term"), first.alias("sum")), step)["sum"]
    inside = F.when(df == 1, 2 * theta / 3.141592653589793).when(odd, 2 / F.lit(3.141592653589793) * (theta + F.sin(theta) * series)).otherwise(F.sin(theta) * series)
    exact = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - inside))
    # With very many degrees the series is long; the corrected normal approximation is then within 1e-10.
    z = F.abs(t) * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > MANY_DEGREES, 2 * (1 - normal_cdf(z))).otherwise(exact)


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n, rho and p of rank correlation; null rho under four pairs or where one side is constant, p 0 at |rho| = 1.

    Groups are aggregated to distinct pairs of values first; ranks come from running counts.
    """
    pairs = rows.filter(finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))

    def ranks(name: str) -> DataFrame:
        counts = pairs.groupBy(*by, name).agg(F.sum("c").alias("t"))
        return ranked(counts, by, name, "t").select(*by, name, F.col("rank").alias(f"r{name}"))

    both = pairs.join(ranks("x"), [*by, "x"]).join(ranks("y"), [*by, "y"])
    s = lambda e: F.sum(F.col("c") * e)
    rx, ry = F.col("rx"), F.col("ry")
    sums = both.groupBy(*by).agg(F.sum("c").alias("n"), s(rx).alias("sx"), s(ry).alias("sy"), s(rx * rx).alias("sxx"), s(ry * ry).alias("syy"), s(rx * ry).alias("sxy"))
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    rho = F.when((n >= 4) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    out = sums.select(*by, "n", rho.alias("rho"))
    r = F.col("rho")
    return out.select(*by, "n", "rho", F.when(F.abs(r) >= 1, 0.0).otherwise(student_t_two_sided(r * F.sqrt((n - 2) / (1 - r * r)), (n - 2).cast("int"))).alias("p"))


def holm(rows: DataFrame, p: str, family: list[str]) -> DataFrame:
    """Adds p_holm: step-down, monotone, at most 1; null p's stay out of the family's size. Families are bounded."""
    order = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*family))
    stepped = rows.withColumn("__step", F.when(F.col(p).isNotNull(), (m - F.row_number().over(order) + 1) * F.col(p)))
    running = F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("__step")


def bootstrap_means(rows: DataFrame, by: list[str], idx: str, value: str, resamples: int, seed: int) -> DataFrame:
    """by, replicate, mean: means of seeded resamples. idx numbers a group's values from 0.

    Every value draws, for each replicate, places in its group; the draws meet the values in one join and are
    averaged with partial sums. So rows, not resamples, are what is joined.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    draws = rows.join(sizes, by).select(*by, F.col(idx).alias("__slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"))
    chosen = F.floor(draw(seed, *[F.col(c) for c in by], F.col("replicate"), F.col("__slot")) * F.col("n")).cast("long")
    picked = draws.select(*by, "replicate", chosen.alias(idx)).join(rows.select(*by, F.col(idx).cast("long").alias(idx), value), [*by, idx])
    return picked.groupBy(*by, "replicate").agg(F.avg(value).alias("mean"))


def bca_bootstrap(rows: DataFrame, by: list[str], idx: str, value: str, resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """by, n, point, low, high, method: a bias-corrected and accelerated interval of the mean.

    Under two values there is no interval; a constant sample is its own; where the correction is undefined the
    plain quantiles of the replicates are used. method says which.
    """
    x = F.col(value)
    means = bootstrap_means(rows, by, idx, value, resamples, seed)
    point = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("point"), F.sum(x).alias("s"), F.min(x).alias("least"), F.max(x).alias("most"))
    left = F.try_divide(F.col("s") - x, F.col("n") - 1)
    # For the mean, leave-one-out means differ from their own mean by (x - mean) / (1 - n).
    dev = F.col("s") / F.col("n") - left
    skew = rows.join(point, by).groupBy(*by).agg(F.sum(F.pow(dev, F.lit(3))).alias("d3"), F.sum(dev * dev).alias("d2"))
    acceleration = F.when(F.col("d2") > 0, F.col("d3") / (6 * F.pow("d2", F.lit(1.5)))).otherwise(0.0)
    sorted_means = means.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("m"))
    return corrected_interval(share_below(point.join(skew, by).join(sorted_means, by).withColumn("a", acceleration), resamples), by, resamples, confidence)


def share_below(out: DataFrame, resamples: int) -> DataFrame:
    """Adds share, the part of the resamples m whose statistic is below the point; both are settled first."""
    return out.withColumn("share", F.size(F.filter("m", lambda v: settle(v, 9) < settle(F.col("point"), 9))) / resamples)


def corrected_interval(out: DataFrame, by: list[str], resamples: int, confidence: float) -> DataFrame:
    """The interval from out: by, n, point, least, most, the acceleration a, share, and m, the sorted statistics of the resamples."""
    alpha = 1 - confidence
    out = out.withColumn("z0", normal_quantile(F.col("share")))

    def adjusted(z: float) -> Column:
        num = F.col("z0") + z
        return F.when(1 - F.col("a") * num > 0, normal_cdf(F.col("z0") + num / (1 - F.col("a") * num)))

    def quantile(q: Column) -> Column:
        place = q * (resamples - 1)
        low = F.floor(place).cast("int")
        a, b = F.get("m", low), F.get("m", F.least(low + 1, F.lit(resamples - 1)))
        return a + (b - a) * (place - low)

    ok = (F.col("share") > 0) & (F.col("share") < 1)
    lo, hi = adjusted(-Z95), adjusted(Z95)
    method = F.when(F.col("n") < 2, "bca (insufficient n)").when(F.col("least") == F.col("most"), "bca (degenerate: constant sample)").when(~ok, "percentile (BCa z0 undefined)").when(lo.isNull() | hi.isNull(), "percentile (BCa acceleration unstable)").otherwise("bca")
    end = lambda q, p: F.when(F.col("n") < 2, float("nan")).when(F.col("least") == F.col("most"), F.col("point")).when(ok & lo.isNotNull() & hi.isNotNull(), quantile(q)).otherwise(quantile(F.lit(p)))
    return out.select(*by, "n", "point", end(lo, alpha / 2).alias("low"), end(hi, 1 - alpha / 2).alias("high"), method.alias("method"))


def bca_interval(rows: DataFrame, by: list[str], value: str, statistic: Statistic = MEAN, resamples: int = 10_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """by, n, point, low, high, method for any statistic of weighted values; resamples are drawn as counts of distinct values.

    Non-finite values are left out; a group without values gives no row. A statistic without an acceleration gets a
    bias-corrected interval, with the same method labels.
    """
    counts = once(value_counts(rows, by, value), "counts")
    sizes = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    point = statistic.of(counts, by, value, "c").withColumnRenamed("theta", "point")
    found = replicates(counts, by, value, statistic, resamples, seed).groupBy(*by).agg(F.sort_array(F.collect_list("theta")).alias("m"))  # resamples numbers
    out = beside(beside(sizes, point, by), found, by)
    out = beside(out, statistic.acceleration(counts, by, value), by) if statistic.acceleration else out.withColumn("a", F.lit(0.0))
    # Written before the folds of the normal distribution, which would count the resamples again in every step.
    return corrected_interval(once(share_below(out.fillna(0.0, ["a"]), resamples), "shares"), by, resamples, confidence)


def metric_interval(rows: DataFrame, by: list[str], idx: str, value: str, binary: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """rows: by, metric, idx, value. by, metric, n, point, low, high, method: the score interval for binary metrics
    (values 0 and 1), the bootstrap's for the others. idx numbers a group's values of a metric from 0."""
    key = [*by, "metric"]
    of = F.col("metric").isin(*binary)
    counts = rows.filter(of).groupBy(*key).agg(F.count(value).alias("n"), F.sum(value).alias("k"), F.avg(value).alias("point"))
    low, high = wilson_interval(F.col("k"), F.col("n"))
    shares = counts.select(*key, "n", "point", low.alias("low"), high.alias("high"), F.lit("wilson").alias("method"))
    return shares.unionByName(bca_bootstrap(rows.filter(~of), key, idx, value, resamples, seed))


def compare_arms(pairs: DataFrame, family: list[str], binary: list[str], alpha: float = 0.05) -> DataFrame:
    """pairs: family, comparison, metric, a, b. A test for each comparison and metric: McNemar for binary metrics,
    Wilcoxon for the others; p, p_holm over the family, and reject."""
    key = [*family, "comparison", "metric"]
    of = F.col("metric").isin(*binary)
    exact = mcnemar_exact(pairs.filter(of), "a", "b", key).select(*key, F.lit("mcnemar").alias("test"), (F.col("n10") + F.col("n01")).alias("n"), "p")
    ranked = wilcoxon_signed_rank(pairs.filter(~of), "a", "b", key).select(*key, F.lit("wilcoxon").alias("test"), F.col("n_nonzero").alias("n"), "p")
    return holm(exact.unionByName(ranked).withColumn("p", settle("p")), "p", family).withColumn("reject", F.col("p_holm") <= alpha)
