"""Exact token counts (operator 3): one histogram of encoded lengths answers every question about lengths.

Documents are aggregated by their encoded length. Sums over the lengths above and below each one then
give, for any context limit, how many documents fit, how many tokens there are, how many are left after
cutting every document at the limit, and every quantile. The histogram has at most as many rows as there
are distinct lengths, so it stays small however many documents there are.

Edge cases: null and empty texts have length 0 and are counted. Repeated rows count each time. An empty
table gives an empty histogram. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.bpe import token_lengths
from sparkweave.llm.common import Scratch


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and the number of documents of that length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L: documents and tokens up to L and above it, tokens left when cut at L, the share of documents up to L.

    Sums over bands of 256 lengths come first, so that no task holds more than the bands or one band.
    """
    banded = histogram.withColumn("band", F.floor(F.col("n_tokens") / 256)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    bands = banded.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum("tokens").alias("band_tokens"))
    over = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bands = bands.select(
        "band",
        F.coalesce(F.sum("band_docs").over(over), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("band_tokens").over(over), F.lit(0)).alias("tokens_before"),
        F.sum("band_docs").over(everything).alias("all_docs"),
        F.sum("band_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("band").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = banded.join(bands, "band").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_up_to"),
        (F.col("tokens_before") + F.sum("tokens").over(inside)).alias("tokens_up_to"),
        "all_docs",
        "all_tokens",
    )
    above = F.col("all_docs") - F.col("docs_up_to")
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        above.alias("docs_above"),
        "tokens_up_to",
        (F.col("all_tokens") - F.col("tokens_up_to")).alias("tokens_above"),
        (F.col("tokens_up_to") + F.col("n_tokens") * above).alias("truncated_tokens"),
        (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The histogram with its sums, for every document's whole text. Encoding is done once: the histogram is written, then summed."""
    scratch = Scratch(docs.sparkSession, "token-counts")
    return with_suffix_sums(scratch.table(length_histogram(token_lengths(docs, vocabulary, pattern))))


def at_limits(summed: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, also those that no document has exactly: limit, docs_fit, truncated_tokens."""
    spark = summed.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    best = F.broadcast(asked).join(summed, F.col("n_tokens") <= F.col("limit"), "left").groupBy("limit").agg(F.max_by(F.struct("docs_up_to", "docs_above", "tokens_up_to"), "n_tokens").alias("x"))
    totals = summed.agg(F.sum("n_docs").alias("all_docs"))
    return best.join(F.broadcast(totals)).select(
        "limit",
        F.coalesce("x.docs_up_to", F.lit(0)).alias("docs_fit"),
        F.coalesce(F.col("x.tokens_up_to") + F.col("limit") * F.col("x.docs_above"), F.col("limit") * F.col("all_docs")).alias("truncated_tokens"),
    )


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least the given share of documents doesn't exceed."""
    spark = summed.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return F.broadcast(asked).join(summed, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
