"""Mixing sources to target weights by entropy balancing (operator 6), in DataFrame functions only.

A document's size is the number of its words. Sources in code point order (null last) weigh 5, 2, 1,
repeating, and share all words; a source's target stops at 3 times its size and what is over is shared
again by weight. Rates w(d) between 0 and 3 are then sought for the documents of each source that meet
sum(w * size) = target and stay closest to 1 in relative entropy. The dual of that convex problem has one
multiplier for each source, w = min(3, exp(lambda * size / mean size)), an exponential tilt cut at the bound, and
Newton steps, kept inside a bracket, solve it for all sources at once. A step is one aggregation of the histogram
of sizes by source, so its cost follows the number of distinct sizes, not the number of documents.

Rates become whole copies: running sums of the rates, taken through the sizes of a source from large to
small, are rounded, and their differences are the copies of each size. Inside a size, copies differ by one
at most and the documents that come first by a hash of their id get the larger number. What this leaves of a
source's target in words, such as half a very long text, is spread over the sizes that fit into it, again and
again until none does; two corrections of one copy then bring the words closer still.

Sizes that many documents share are split into cells of about 4096 documents by a hash of the id, so no
window holds a hot source or a hot size.

Edge cases: a null text has size 0 and takes 0 words; a null source is a source of its own, the last. A
source without words has target 0. Repeated rows are mixed as rows of their own. An empty table gives an
empty result. Only doc_id, source and text are read. Reruns agree: sums of words are whole numbers, and
multipliers are rounded before use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import WORD, Scratch

KEY = ["src", "src_null"]
#: Documents of one size that a cell should hold.
CELL = 4096


def _rate(lam: Column, x: Column) -> Column:
    return F.least(F.lit(3.0), F.exp(lam * x))


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """sizes: src, src_null, source_size, n_docs. Adds weight and target.

    Places in the order come from a range partitioning and the counts of its parts, not from one sorted task.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.table(sizes.repartitionByRange(parts, "src_null", "src").withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("src_null", "src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = scratch.table(placed.join(before, "part").withColumn("weight", weight).drop("part", "before"))

    most = F.col("source_size") * F.lit(cap)
    total, weight_sum = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    share, capped = (total or 0) / (weight_sum or 1.0), -1
    while True:
        held = most <= F.col("weight") * F.lit(share)
        n, used, free = weighed.agg(F.count(F.when(held, 1)), F.sum(F.when(held, most)), F.sum(F.when(~held, F.col("weight")))).first()
        if n == capped or not free:
            break
        share, capped = ((total or 0) - (used or 0.0)) / free, n
    return weighed.withColumn("target", F.least(most, F.col("weight") * F.lit(share)))


def solve_rates(histogram: DataFrame, sources: DataFrame, scratch: Scratch, steps: int = 60) -> DataFrame:
    """The multiplier lam of each source: safeguarded Newton steps on the dual, all sources in each step."""
    full, none = F.col("target") >= F.col("source_size") * 3.0, F.col("target") <= 0
    state = scratch.table(
        sources.select(*KEY, "target", "source_size", (F.col("source_size") / F.greatest("n_docs", F.lit(1))).alias("mean_size"), F.lit(0.0).alias("lam"))
        .withColumn("low", F.lit(None).cast("double"))
        .withColumn("high", F.lit(None).cast("double"))
        .withColumn("fixed", F.when(none, F.lit(0.0)).when(full, F.lit(3.0)))
        .withColumn("done", full | none)
    )
    for _ in range(steps):
        if state.filter(~F.col("done")).isEmpty():
            break
        x = F.col("size") / F.col("mean_size")
        rate = _rate(F.col("lam"), x)
        words = F.col("n") * F.col("size")
        sums = (
            histogram.join(state.filter(~F.col("done")).select(*KEY, "lam", "mean_size"), KEY)
            .groupBy(*KEY)
            .agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < 3.0, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        miss = F.col("got") - F.col("target")
        low, high = F.when(miss < 0, F.col("lam")).otherwise(F.col("low")), F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        inside = step.isNotNull() & (F.col("new_low").isNull() | (step > F.col("new_low"))) & (F.col("new_high").isNull() | (step < F.col("new_high")))
        wide = F.greatest(F.lit(1.0), F.abs("lam"))
        other = F.when(F.col("new_low").isNull(), F.col("lam") - wide).when(F.col("new_high").isNull(), F.col("lam") + wide).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        near = F.abs(miss) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        following = (
            state.join(sums, KEY, "left")
            .withColumn("new_low", low)
            .withColumn("new_high", high)
            .withColumn("now_done", F.col("done") | near)
            .withColumn("lam", F.when(F.col("now_done"), F.col("lam")).otherwise(F.when(inside, step).otherwise(other)))
            .select(*KEY, "target", "source_size", "mean_size", "lam", F.col("new_low").alias("low"), F.col("new_high").alias("high"), "fixed", F.col("now_done").alias("done"))
        )
        following = scratch.table(following)
        scratch.drop(state)
        state = following
    return state.select(*KEY, "target", "source_size", "mean_size", F.round("lam", 7).alias("lam"), "fixed")


def _spread(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """What rounding left of each source's target in words, taken up by the sizes that fit into it.

    Each such cell gives the same share of its room: of the copies it may still get, or of those it has. The
    copies are running sums from large to small again, so what is left at least halves, until no size fits.
    """
    through = Window.partitionBy(*KEY).orderBy(F.col("size").desc(), "cell")
    while True:
        lefts = cells.groupBy(*KEY).agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("left"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left"))
        room = F.when(fits, F.when(F.col("left") > 0, 3 * F.col("n") - F.col("k")).otherwise(F.col("k"))).otherwise(F.lit(0))
        roomy = cells.join(lefts, KEY).withColumn("room", room)
        shares = roomy.groupBy(*KEY).agg(F.first("left").alias("left"), F.sum(F.col("room") * F.col("size")).alias("words")).filter("words > 0")
        shares = scratch.table(shares.select(*KEY, "left", F.least(F.lit(1.0), F.abs("left") / F.col("words")).alias("share")))
        if shares.isEmpty():
            return cells
        spread = cells.join(shares, KEY, "left").withColumn("room", F.coalesce(room, F.lit(0)))
        run = F.floor(F.round(F.sum(F.col("room") * F.coalesce("share", F.lit(0.0))).over(through.rowsBetween(Window.unboundedPreceding, 0)), 6) + 0.5)
        moved = spread.withColumn("run", run).withColumn("step", F.col("run") - F.coalesce(F.lag("run").over(through), F.lit(0)))
        cells = scratch.table(moved.withColumn("k", F.col("k") + F.when(F.col("left") < 0, -F.col("step")).otherwise(F.col("step"))).select(*KEY, "size", "cell", "n", "target", "k"))


def _corrected(cells: DataFrame) -> DataFrame:
    """One copy more or less of one document in each source, where that brings its words closer to the target."""
    left = F.col("target") - F.col("words")
    totals = cells.groupBy(*KEY).agg(F.sum(F.col("k") * F.col("size")).alias("words"))
    with_left = cells.join(totals, KEY).withColumn("left", left)
    able = (F.col("size") > 0) & F.when(F.col("left") > 0, F.col("k") < 3 * F.col("n")).otherwise(F.col("k") > 0)
    after = F.abs(F.abs("left") - F.col("size"))
    best = with_left.filter(able & (after < F.abs("left"))).groupBy(*KEY).agg(F.min(F.struct(after.alias("after"), "size", "cell", F.signum("left").cast("long").alias("sign"))).alias("best"))
    chosen = (F.col("size") == F.col("best.size")) & (F.col("cell") == F.col("best.cell"))
    return cells.join(best, KEY, "left").withColumn("k", F.col("k") + F.when(chosen, F.col("best.sign")).otherwise(F.lit(0))).drop("best")


def words_of(text: str) -> Column:
    """A document's size: the number of its words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), named: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate: one row for each row of docs. named: with its source (src, and src_null)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
            F.col("source").isNull().alias("src_null"),
            words_of("text").alias("size"),
        )
    )
    histogram = scratch.table(sized.groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = histogram.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = scratch.table(source_targets(sizes, scratch, weights))
    solved = solve_rates(histogram, sources, scratch)

    rates = histogram.join(solved, KEY).select(
        *KEY,
        "size",
        "target",
        "source_size",
        F.coalesce("fixed", _rate(F.col("lam"), F.col("size") / F.when(F.col("mean_size") > 0, F.col("mean_size")).otherwise(1.0))).alias("rate"),
        F.ceil(F.col("n") / F.lit(CELL)).alias("cells"),
    )
    celled = scratch.table(sized.join(rates, [*KEY, "size"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit("cell")), F.col("cells"))).drop("cells"))

    through = Window.partitionBy(*KEY).orderBy(F.col("size").desc(), "cell")
    counted = celled.groupBy(*KEY, "size", "cell").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"), F.first("target").alias("target"))
    run = F.round(F.sum(F.col("n") * F.col("rate")).over(through.rowsBetween(Window.unboundedPreceding, 0)), 6)
    rounded = counted.withColumn("run", F.floor(run + 0.5))
    copies = scratch.table(rounded.withColumn("k", F.col("run") - F.coalesce(F.lag("run").over(through), F.lit(0))).select(*KEY, "size", "cell", "n", "target", "k"))
    copies = scratch.table(_corrected(_corrected(_spread(copies, scratch))).select(*KEY, "size", "cell", "n", "k"))

    rank = F.row_number().over(Window.partitionBy(*KEY, "size", "cell").orderBy(F.xxhash64("doc_id", F.lit("copy")), "doc_id"))
    return (
        celled.withColumn("rank", rank)
        .join(copies, [*KEY, "size", "cell"])
        .withColumn("copies", F.floor(F.col("k") / F.col("n")) + F.when(F.col("rank") <= F.col("k") % F.col("n"), 1).otherwise(0))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *(KEY if named else []))
    )
