"""Run folders: nested sample records and settings of each run, written and scanned as JSON lines, plain or gzipped.

A root holds samples/run=<name>/, config/run=<name>/ and summary/. A run is a folder with samples; its settings
may be absent, and then the defaults hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import metrics as M

ITERATION = "struct<iteration: int, lever: double, validity: double>"
SAMPLE_RECORD = f"sample long, grp string, target string, fragments array<string>, `order` array<int>, control struct<reconstruction: string, edit_similarity: double>, iterations array<{ITERATION}>"


def run_sink(samples: DataFrame, root: str, compression: str | None = None) -> None:
    """samples: run and the columns of SAMPLE_RECORD. A folder for each run, and one row a run for the summary."""
    samples.write.mode("append").option("compression", compression or "none").partitionBy("run").json(f"{root}/samples")
    exact = F.col("control.reconstruction") == F.col("target")
    summary = samples.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(exact, 1)).alias("exact"), F.sum(F.size("fragments")).alias("fragments"))
    summary.write.mode("append").json(f"{root}/summary")


def config_sink(configs: DataFrame, root: str) -> None:
    """configs: run and any settings."""
    configs.write.partitionBy("run").json(f"{root}/config")


def samples_scan(spark: SparkSession, root: str) -> DataFrame:
    """The sample records of every run, with the run's name."""
    return spark.read.schema(f"{SAMPLE_RECORD}, run string").json(f"{root}/samples")


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """run: the folders that hold a samples file, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/samples").select("path")
    return files.select(F.url_decode(F.regexp_extract("path", r"/run=([^/]+)/", 1)).alias("run")).distinct()


def run_config_scan(spark: SparkSession, root: str, schema: str, defaults: dict) -> DataFrame:
    """run and its settings; a run without a snapshot, or a setting it lacks, has the default."""
    found = spark.read.schema(f"{schema}, run string").json(f"{root}/config")
    joined = discover_runs(spark, root).join(found, "run", "left")
    return joined.select("run", *(F.coalesce(name, F.lit(value)).alias(name) for name, value in defaults.items()))


def load_run_samples(records: DataFrame, order: str = "order") -> DataFrame:
    """run, sample, target, order and n_fragments; the order may be a list in a string, with either kind of quotes."""
    parsed = F.from_json(F.regexp_replace(F.col(order), "['\"]", ""), "array<int>") if dict(records.dtypes)[order] == "string" else F.col(order)
    return records.select("run", "sample", "target", parsed.alias("order"), F.size("fragments").alias("n_fragments"))


def normalize_fragment_samples(fragments: Column, fragment_samples: Column) -> Column:
    """Replicas as a list of lists: what is stored, else the flat list as one replica, else none."""
    flat = F.when(fragments.isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(fragments))
    return F.coalesce(fragment_samples, flat)


def clean_permutation(order: Column, fragments: Column) -> Column:
    """Is order each place of fragments once?"""
    return F.coalesce((F.size(fragments) > 0) & (F.array_sort(order) == F.sequence(F.lit(0), F.size(fragments) - 1)), F.lit(False))


def assembled(order: Column, fragments: Column) -> Column:
    """The text that fragments make in this order; null where the order is no clean permutation."""
    return F.when(clean_permutation(order, fragments), F.array_join(F.transform(order, lambda i: F.get(fragments, i)), ""))


def backfill_edit_similarity(samples: DataFrame) -> DataFrame:
    """Adds control_similarity (stored, else from the stored text), random_similarity (where fragments and a clean
    permutation are stored) and ceiling_similarity (the best of the candidates: the order and its reverse)."""
    fragments, order, target = F.col("fragments"), F.col("order"), F.col("target")
    forward, backward = (M.edit_similarity(assembled(x, fragments), target) for x in (order, F.reverse(order)))
    control = F.coalesce("control.edit_similarity", M.edit_similarity(F.col("control.reconstruction"), target))
    return samples.withColumn("control_similarity", control).withColumn("random_similarity", forward).withColumn("ceiling_similarity", F.greatest(forward, backward))


def sample_rows(samples: DataFrame) -> DataFrame:
    """One flat row a sample: run, sample, grp, n, bin, exact, adjacent, iterations, best_iteration, best_validity, gain."""
    n = F.size("fragments")
    steps = F.zip_with(F.slice("order", 1, F.greatest(n - 1, F.lit(0))), F.slice("order", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (b - a == 1).cast("int"))
    adjacent = F.when(n > 1, F.aggregate(steps, F.lit(0), lambda total, x: total + x) / (n - 1))
    # The most valid iteration, the earliest of equal ones.
    best = F.array_min(F.transform("iterations", lambda x: F.struct((-x["validity"]).alias("loss"), x["iteration"].alias("iteration"))))
    first = F.get(F.col("iterations"), F.lit(0))["validity"]
    return samples.select(
        "run",
        "sample",
        "grp",
        n.alias("n"),
        M.fragment_bin(n).alias("bin"),
        M.exact_match(assembled(F.col("order"), F.col("fragments")), F.col("target")).alias("exact"),
        adjacent.alias("adjacent"),
        F.size("iterations").alias("iterations"),
        best["iteration"].alias("best_iteration"),
        (-best["loss"]).alias("best_validity"),
        (-best["loss"] - first).alias("gain"),
    )


def iteration_behaviour(samples: DataFrame) -> DataFrame:
    """For each run: samples, mean_iterations, levers (distinct values), changes (share of later iterations with another
    lever value than the one before), mean_best (iteration), improved (samples whose best beats their first)."""
    its = F.col("iterations")
    levers = F.transform(its, lambda x: x["lever"])
    changed = F.zip_with(F.slice(levers, 1, F.greatest(F.size(its) - 1, F.lit(0))), F.slice(levers, 2, F.greatest(F.size(its) - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    rows = sample_rows(samples).groupBy("run").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("iterations").alias("mean_iterations"), F.avg("best_iteration").alias("mean_best"), F.count(F.when(F.col("gain") > 0, 1)).alias("improved")
    )
    moves = samples.groupBy("run").agg((F.sum(F.aggregate(changed, F.lit(0), lambda total, x: total + x)) / F.nullif(F.sum(F.size(its) - 1), F.lit(0))).alias("changes"))
    used = samples.select("run", F.explode(levers).alias("lever")).distinct().groupBy("run").agg(F.count("lever").alias("levers"))
    return rows.join(moves, "run").join(used, "run")
