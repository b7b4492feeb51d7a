"""Scores of junctions from a residue model computed from the corpus by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.rounding import settle
from sparkweave.operators.batches import gram_counts

#: Letters a residue can be.
ALPHABET = 26


def residue_model(seqs: DataFrame, k: int = 2, alpha: float = 1.0) -> DataFrame:
    """context, residue, logp: the smoothed log probability of a residue after k others, over all sequences."""
    if k == 2:
        grams = gram_counts(seqs)
    else:
        places = F.when(F.length("seq") > k, F.sequence(F.lit(1), F.length("seq") - k)).otherwise(F.array().cast("array<int>"))
        grams = seqs.select("seq", F.explode(places).alias("p")).select(F.substr("seq", F.col("p"), F.lit(k + 1)).alias("gram"), F.lit(1).cast("long").alias("n"))
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n")).select(F.left("gram", F.lit(k)).alias("context"), F.right("gram", F.lit(1)).alias("residue"), "n")
    # A window over the counts, at most ALPHABET ** (k + 1) rows: a join would count the corpus twice.
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy("context")))
    return totals.select("context", "residue", F.round(F.log((F.col("n") + alpha) / (F.col("total") + alpha * ALPHABET)), 9).alias("logp"))


def backoff() -> Column:
    return F.round(F.log(F.lit(1.0 / ALPHABET)), 9)


def junction_targets(pairs: DataFrame, window: int = 3) -> DataFrame:
    """pairs: seq_id, i, j, a, b. A row for each of b's first window residues, with what stands left and right of it."""
    at = pairs.withColumn("p", F.explode(F.sequence(F.lit(0), F.least(F.lit(window), F.length("b")) - 1)))
    return at.select("seq_id", "i", "j", "p", F.concat("a", F.substr("b", F.lit(1), F.col("p"))).alias("left"), F.substr("b", F.col("p") + 2, F.length("b")).alias("right"), F.substr("b", F.col("p") + 1, F.lit(1)).alias("target"))


def with_logp(targets: DataFrame, model: DataFrame, k: int = 2) -> DataFrame:
    """targets: left, target. Adds logp of the target after the last k residues on its left; the back-off where unseen."""
    known = targets.withColumn("context", F.right("left", F.lit(k)))
    return known.join(model.withColumnRenamed("residue", "target"), ["context", "target"], "left").withColumn("logp", F.coalesce("logp", backoff())).drop("context")


def score_pairs(targets: DataFrame, model: DataFrame, k: int = 2) -> DataFrame:
    """seq_id, i, j, score: the mean log probability over a pair's targets."""
    return with_logp(targets, model, k).groupBy("seq_id", "i", "j").agg(settle(F.avg("logp")).alias("score"))


def with_mean(rows: DataFrame, model: DataFrame, grams: list[Column], name: str = "score", windows: tuple[int, ...] = ()) -> DataFrame:
    """Adds the mean log probability of some residues, each given as its context and itself in one string (null: left out).

    The model has at most ALPHABET**(k + 1) rows and is broadcast, so no row moves. With windows, the means over the first
    residues of each window, as an array.
    """
    columns = rows.columns
    for p, gram in enumerate(grams):
        known = model.select(F.concat("context", "residue").alias(f"__gram{p}"), F.col("logp").alias(f"__logp{p}"))
        rows = rows.withColumn(f"__gram{p}", gram).join(F.broadcast(known), f"__gram{p}", "left")

    def mean(n: int) -> Column:
        used = range(n)
        logp = lambda p: F.when(F.col(f"__gram{p}").isNull(), 0.0).otherwise(F.coalesce(f"__logp{p}", backoff()))
        count = sum((F.col(f"__gram{p}").isNotNull().cast("int") for p in used), F.lit(0))
        return settle(F.when(count > 0, sum((logp(p) for p in used), F.lit(0.0)) / count))

    value = F.array(*(mean(w) for w in windows)) if windows else mean(len(grams))
    return rows.select(*columns, value.alias(name))


def junction_grams(window: int = 3, k: int = 2) -> list[Column]:
    """Contexts and residues of what junction_targets returns, for the columns a and b of a pair."""
    gram = lambda p: F.concat(F.right(F.concat("a", F.substr("b", F.lit(1), F.lit(p))), F.lit(k)), F.substr("b", F.lit(p + 1), F.lit(1)))
    return [F.when(F.length("b") > p, gram(p)) for p in range(window)]


def two_sided_grams(k: int = 2) -> list[Column]:
    """The same of two_sided_targets."""
    last = F.concat(F.right(F.expr("left(a, length(a) - 1)"), F.lit(k)), F.right("a", F.lit(1)))
    first = F.concat(F.right("a", F.lit(k)), F.left("b", F.lit(1)))
    return [F.when(F.length("a") > 1, last), F.when((F.length("b") > 1) | (F.length("a") <= 1), first)]


def junction_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("seq_id").agg(F.count("score").alias("n"), settle(F.avg("score")).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


def junction_local_logprob(open_scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """open_scores: scores of unconfirmed neighbours; sizes: seq_id, n. Their mean; 0 if none is left, null under two fragments."""
    means = open_scores.groupBy("seq_id").agg(F.avg("score").alias("mean"))
    return sizes.join(means, "seq_id", "left").select("seq_id", F.when(F.col("n") >= 2, settle(F.coalesce("mean", F.lit(0.0)))).alias("mean_lp"))


def blended_validity(mean_lp: Column, agreement: Column, penalty_weight: float = 0.75) -> list[Column]:
    """validity_score (infinite when undefined), junction_local_ppl, confirmed_adjacency_agreement, confirmed_penalty_applied."""
    penalty = F.when(agreement.isNull(), 0.0).otherwise(penalty_weight * (1 - agreement))
    ppl = F.exp(-mean_lp)
    score = ppl * (1 + penalty)
    return [
        F.when(mean_lp.isNull() | F.isnan(score), F.lit(float("inf"))).otherwise(score).alias("validity_score"),
        ppl.alias("junction_local_ppl"),
        agreement.alias("confirmed_adjacency_agreement"),
        penalty.alias("confirmed_penalty_applied"),
    ]


def pseudo_perplexity(seqs: DataFrame, model: DataFrame, k: int = 2) -> DataFrame:
    """seq_id, ppl: exp of the mean negative log probability of all residues that have k before them; infinite without any."""
    places = F.when(F.length("seq") > k, F.sequence(F.lit(k), F.length("seq") - 1)).otherwise(F.array().cast("array<int>"))
    # Only a window of each place moves on, and the model (bounded by the alphabet) is broadcast.
    grams = seqs.select("seq_id", "seq", F.explode_outer(places).alias("p")).select("seq_id", F.substr("seq", F.col("p") - k + 1, F.lit(k + 1)).alias("gram"))
    known = F.broadcast(model.select(F.concat("context", "residue").alias("gram"), "logp"))
    logp = F.when(F.col("gram").isNotNull(), F.coalesce("logp", backoff()))
    means = grams.join(known, "gram", "left").groupBy("seq_id").agg(F.avg(logp).alias("mean"))
    return means.select("seq_id", F.coalesce(F.exp(-F.col("mean")), F.lit(float("inf"))).alias("ppl"))


def two_sided_targets(pairs: DataFrame) -> DataFrame:
    """The last residue of a and the first of b as targets; a side of one residue has nothing on its own side and is left out."""
    last = pairs.filter(F.length("a") > 1).select("seq_id", "i", "j", F.expr("left(a, length(a) - 1)").alias("left"), F.right("a", F.lit(1)).alias("target"))
    first = pairs.filter((F.length("b") > 1) | (F.length("a") <= 1)).select("seq_id", "i", "j", F.col("a").alias("left"), F.left("b", F.lit(1)).alias("target"))
    return last.unionByName(first)


def length_weighted_mean(rows: DataFrame, key: str, score: str, length: str) -> DataFrame:
    return rows.groupBy(key).agg((F.sum(F.col(score) * F.col(length)) / F.sum(length)).alias("weighted_mean"))
