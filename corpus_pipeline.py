"""A corpus pipeline of five of the training-data operators, each stage working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm import bpe, mixing, simhash, suffix_array, toxicity
from sparkweave.llm.common import Scratch, attach, read
from sparkweave.llm.registry import _vocabulary
from sparkweave.llm.windows import NO_ID


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents among docs; documents scored 0.5 or more go.

    With no label for any of them, all stay. Null and empty texts stay unless the labels make the intercept
    toxic. Repeated rows fare alike. An empty table stays empty.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of five-word shingles, the document with the least id stays.

    Rows that share a doc_id are told apart by their texts, and of equal ones the first by their other columns
    stays. Rows without a doc_id stay. Null, empty and wordless texts are copies of each other. An empty table
    stays empty.
    """
    scratch = Scratch(spark, "near-copies")
    found = scratch.table(simhash.similar_groups(docs, words=5, similarity=0.8).filter("doc_id is not null"))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    gone = found.join(first, "component").filter(F.struct("doc_id", "version") != F.col("first"))
    gone = scratch.table(gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct())
    again = found.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).count().filter("count > 1").select("__id", "__version")
    again = scratch.table(again)

    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__version", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(gone, ["__id", "__version"], "left_anti")
    others = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    rank = F.row_number().over(Window.partitionBy("__id", "__version").orderBy(F.xxhash64(*others)))
    one = kept.join(again, ["__id", "__version"], "left_semi").withColumn("__rank", rank).filter("__rank = 1")
    return kept.join(again, ["__id", "__version"], "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a repeated 200-byte string covers; n_chars follows.

    Every row stays, with an empty text where all of it repeats. A null text stays null. Rows that share a
    doc_id are rows of their own. An empty table stays empty.
    """
    return suffix_array.strip_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Rows that share doc_id, source and size are dealt the copies of these rows in the order of their texts; a
    null doc_id or source is a value like any other. Texts without words are taken or not as they are worth
    nothing to a target. An empty table stays empty.
    """
    dealt = mixing.mix(docs, named=True)
    key = ["__id", "__src", "__null", "__size"]
    copies = dealt.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("src").alias("__src"), F.col("src_null").alias("__null"), F.col("size").alias("__size")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    keyed = docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__src"),
        F.col("source").isNull().alias("__null"),
        mixing.words_of("text").alias("__size"),
    )
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))
    own = F.floor(F.col("__copies") / F.col("__rows")) + F.when(rank <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    mixed = keyed.join(copies, key).withColumn("__own", own.cast("int"))
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("__own"))).alias("__copy")).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of every document, one row for each row; null texts are empty ones."""
    return bpe.round_trip(docs, *_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Training and the mix's Newton steps can't be put in SQL. Tests hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again."""
    attach(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = scratch.table(docs) if number < len(STAGES) else docs
    return docs
