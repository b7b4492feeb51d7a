"""Sequence tables: from documents, and from and to FASTA, JSON lines and CSV."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a document that make one sequence.
WORDS = 20

FRAGMENT_RECORD = "seq_id long, target string, fragments array<string>, fragment_samples array<array<string>>, num_fragments int, replica_count int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. In local mode one is made where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkweave-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what several branches of a plan use is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, list[DataFrame]] = {}


def _status(spark: SparkSession, path: str):
    """The file system's entry of a path; None where there is nothing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(at) if system.exists(at) else None


def once_a_session(spark: SparkSession, source: str, make: Callable[[], list[DataFrame]]) -> list[DataFrame]:
    """Tables that make() writes with once(), kept for later queries of the session while source and they are unchanged."""
    entry = _status(spark, source)
    key = (spark.sparkContext.applicationId, make.__qualname__, source, entry.getModificationTime(), entry.getLen())
    found = _KEPT.get(key)
    if found is None or not all(_status(spark, f) for df in found for f in df.inputFiles()[:1]):
        found = _KEPT[key] = make()
    return found


def letters_of_runs(words: int) -> Callable[[Column | str], Column]:
    """A function of a text: the letters A-Z and a-z, upper-cased, of each run of words. Words stand between ASCII spaces."""
    upper = bytes(x - 32 if 97 <= x <= 122 else x for x in range(256))
    others = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122))

    def runs(texts: pa.Array) -> pa.Array:
        found, counts = [], [0]
        for text in texts.cast(pa.large_binary()).to_pylist():
            parts = text.split() if text else []
            found += [b"".join(parts[k : k + words]).translate(upper, others) for k in range(0, len(parts), words)]
            counts.append(len(found))
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(found, pa.binary()).cast(pa.string()))

    return F.arrow_udf(runs, "array<string>")


def sequences(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """seq_id, doc_id, grp, seq: the letters, upper-cased, of each run of words of a text. A map over the scan.

    Texts without letters give no sequence; seq_id is doc_id * 1,000,000 plus the run's number.
    """
    split = docs.select("doc_id", F.col("lang").alias("grp"), letters_of_runs(words)("text").alias("runs")).select("doc_id", "grp", F.posexplode("runs").alias("run", "seq"))
    letters = split.filter("seq <> ''")
    return letters.select((F.col("doc_id") * 1_000_000 + F.col("run")).alias("seq_id"), "doc_id", "grp", "seq")


def fasta_sink(records: DataFrame, path: str, width: int = 60) -> None:
    """id, description, sequence: '>' and the description, then the sequence in lines of width."""
    wrapped = F.rtrim(F.regexp_replace("sequence", f"(.{{1,{width}}})", "$1\n"))
    records.select(F.concat(F.lit(">"), F.col("description"), F.lit("\n"), F.regexp_replace(wrapped, "\n$", "")).alias("value")).write.text(path)


def fasta_scan(spark: SparkSession, path: str) -> DataFrame:
    """id, description, organism, gene, sequence of every record; lines of a sequence are joined."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).filter("trim(value) <> ''")
    description = F.regexp_extract("value", r"^([^\n]*)", 1)
    return records.select(
        F.regexp_extract("value", r"^(\S+)", 1).alias("id"),
        description.alias("description"),
        F.nullif(F.regexp_extract(description, r"OS=(.+?)(?= [A-Z]{2}=|$)", 1), F.lit("")).alias("organism"),
        F.nullif(F.regexp_extract(description, r"GN=(\S+)", 1), F.lit("")).alias("gene"),
        F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "").alias("sequence"),
    )


def fragment_jsonl_sink(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as lines of JSON; a record holds its sequence several times over, so the files are compressed by default."""
    records.write.json(path, compression=compression)


def fragment_jsonl_scan(spark: SparkSession, path: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Fragment records; with a limit, that many in a seeded order (the limit is the sampling operator's own)."""
    records = spark.read.schema(FRAGMENT_RECORD).json(path)
    if limit is None:
        return records
    return records.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("seq_id").cast("string"))), "seq_id").limit(limit)


def plain(value: Column, kind: T.DataType) -> Column:
    """A value for CSV: booleans as 1 and 0, NaN and infinities empty."""
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return value


def rows_csv_sink(frames: list[DataFrame], path: str) -> DataFrame:
    """Write the union of the frames, missing columns empty, and return it."""
    together = frames[0]
    for frame in frames[1:]:
        together = together.unionByName(frame, allowMissingColumns=True)
    cleaned = together.select(*(plain(F.col(f.name), f.dataType).alias(f.name) for f in together.schema))
    cleaned.write.option("header", True).option("nullValue", "").csv(path)
    return cleaned


def latest_record(lines: DataFrame) -> DataFrame:
    """lines: target, line, fragments. One record for each target, the last line wins; its length, count and fragment lengths."""
    last = lines.groupBy("target").agg(F.max_by("fragments", "line").alias("fragments"), F.max("line").alias("line"))
    return last.select("target", "line", F.length("target").alias("length"), F.size("fragments").alias("num_fragments"), F.transform("fragments", F.length).alias("fragment_lengths"))


def train_test_split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Marks the first floor(n * (1 - ratio)) rows of a seeded order as train, the others as test: exact sizes.

    Ranks come from counts of 4096 hash ranges and a rank inside each, so no task sorts all rows.
    """
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    ranged = rows.withColumn("__draw", draw).withColumn("__range", F.substring("__draw", 1, 3))
    from pyspark.sql import Window

    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__draw", key)) + F.col("__before")
    return ranged.join(F.broadcast(before), "__range").withColumn("split", F.when(rank <= F.floor(F.col("__all") * (1 - ratio)), "train").otherwise("test")).drop("__draw", "__range", "__n", "__before", "__all")
