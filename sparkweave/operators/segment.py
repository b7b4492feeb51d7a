"""Cutting sequences into fragments by cleavage rules, several times over, with seeded draws.

Everything happens inside a row: sites, draws and pieces are array expressions, so cutting is a map over the
scan and makes no shuffle. A draw depends on seed, sequence, replica and position only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = ("trypsin", "lys_c", "asp_n", "glu_c")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside a lambda Spark computes an expression again each time it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def draw(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the parts."""
    named = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


#: Where each rule cuts, as an empty match between residues.
PATTERNS = {"trypsin": "(?<=[KR])(?!P)", "lys_c": "(?<=K)", "asp_n": "(?=D)", "glu_c": "(?<=[DE])"}


def cleavage_sites(seq: Column, rule: str = "trypsin") -> Column:
    """Positions 0..length where the rule cuts: before the residue at that place, counting from 0.

    One split finds the pieces; the sites are the running sums of their lengths, the last left out.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("ends"))
    longer = lambda s, x: let(s["at"] + F.length(x), lambda at: F.struct(at.alias("at"), F.concat(s["ends"], F.array(at)).alias("ends")))
    ends = let(F.split(seq, PATTERNS[rule]), lambda pieces: F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, longer)["ends"])
    # A cut before the first residue gives no piece.
    return F.when(seq.startswith("D"), F.concat(F.array(F.lit(0)), ends)).otherwise(ends) if rule == "asp_n" else ends


def missed_cleavage_prob(seq: Column, pos: Column, ratio: float) -> Column:
    """The base ratio; half as much again, at most 1, when a K stands before the cut."""
    return F.when((pos > 0) & (F.substr(seq, pos, F.lit(1)) == "K"), F.least(F.lit(ratio * 1.5), F.lit(1.0))).otherwise(F.lit(float(ratio)))


def _kept(seq: Column, sites: Column, prefix: Column, ratio: float) -> Column:
    """The sites whose draw is above their probability of being missed; prefix holds the draw's other parts.

    A draw is the first 32 bits of a digest, so it is above a probability exactly if the digest's text is above that
    probability's digits: no number is made of it.
    """
    above = lambda p: F.lit(f"{int(min(p, 1.0) * 2**32):08x}" + "f" * 24 if p < 1 else "g")
    high, low = above(ratio * 1.5), above(float(ratio))
    return F.filter(sites, lambda p: F.md5(F.concat(prefix, p.cast("string"))) > F.when((p > 0) & (F.substr(seq, p, F.lit(1)) == "K"), high).otherwise(low))


def segment(seqs: DataFrame, rule: str = "trypsin", ratio: float = 0.3, replicas: int = 3, seed: int = 42) -> DataFrame:
    """seq_id, grp, replica, pos, start, fragment: the non-empty pieces between the cuts that were not missed."""
    rows = seqs.select("seq_id", "grp", "seq", cleavage_sites(F.col("seq"), rule).alias("sites"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    rows = rows.withColumn("prefix", F.concat(F.lit(f"{seed}|"), F.col("seq_id").cast("string"), F.lit("|"), F.col("replica").cast("string"), F.lit("|")))
    cut = rows.select("seq_id", "grp", "seq", "replica", F.explode(F.array(_kept(F.col("seq"), F.col("sites"), F.col("prefix"), ratio))).alias("cuts"))
    begins, ends = F.concat(F.array(F.lit(0)), "cuts"), F.concat("cuts", F.array(F.length("seq")))
    pieces = F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("start"), (e - b).alias("size"))), lambda x: x["size"] > 0)
    out = cut.select("seq_id", "grp", "seq", "replica", F.posexplode(pieces).alias("pos", "piece"))
    return out.select("seq_id", "grp", "replica", "pos", F.col("piece.start").alias("start"), F.substr("seq", F.col("piece.start") + 1, F.col("piece.size")).alias("fragment"))


def cut_rows(seqs: DataFrame, rule: str = "trypsin", ratio: float = 0.3, replicas: int = 3, seed: int = 42) -> DataFrame:
    """seq_id, grp, pieces: the fragments of every replica as an array of arrays, in the row of the sequence. A map."""
    sited = seqs.select("seq_id", "grp", "seq", F.explode(F.array(cleavage_sites(F.col("seq"), rule))).alias("sites"))

    def replica(r: Column) -> Column:
        kept = F.get("kept", r)
        parts = F.zip_with(F.concat(F.array(F.lit(0)), kept), F.concat(kept, F.array(F.length("seq"))), lambda b, e: F.substr(F.col("seq"), b + 1, e - b))
        return F.filter(parts, lambda x: x != "")

    # Exploding an array of one keeps Spark from repeating the cutting in each expression that reads the pieces.
    sited = sited.withColumn("prefix", F.concat(F.lit(f"{seed}|"), F.col("seq_id").cast("string"), F.lit("|")))
    kept = [_kept(F.col("seq"), F.col("sites"), F.concat("prefix", F.lit(f"{r}|")), ratio) for r in range(replicas)]
    sited = sited.select("seq_id", "grp", "seq", F.explode(F.array(F.array(*kept))).alias("kept"))
    return sited.select("seq_id", "grp", F.explode(F.array(F.array(*(replica(F.lit(r)) for r in range(replicas))))).alias("pieces"))


def primary(fragments: DataFrame) -> DataFrame:
    """Fragments of replica 0; idx is their place."""
    return fragments.filter("replica = 0").select("seq_id", "grp", F.col("pos").alias("idx"), "fragment")


def unique_fragments(fragments: DataFrame) -> DataFrame:
    """Distinct fragments over all replicas, numbered by first appearance."""
    first = fragments.groupBy("seq_id", "fragment").agg(F.min(F.struct("replica", "pos")).alias("first"))
    return first.select("seq_id", "fragment", (F.row_number().over(Window.partitionBy("seq_id").orderBy("first")) - 1).alias("idx"))


def shuffle_fragments(fragments: DataFrame, seed: int = 42) -> DataFrame:
    """Adds place: a seeded random order of the fragments of each sequence."""
    order = Window.partitionBy("seq_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seq_id").cast("string"), F.col("idx").cast("string"))), "idx")
    return fragments.withColumn("place", F.row_number().over(order) - 1)


def shuffled(fragments: Column, *parts: Column | int | str) -> Column:
    """The same inside a row: an array of (draw, idx, fragment) in the seeded order; parts are what the draw begins with."""
    named = [x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]
    return F.sort_array(F.transform(fragments, lambda x, i: F.struct(F.md5(F.concat_ws("|", *named, i.cast("string"))).alias("draw"), i.alias("idx"), x.alias("fragment"))))


def unique_in_row() -> Column:
    """Distinct fragments over all replicas of a row of cut_rows, by first appearance."""
    return F.array_distinct(F.flatten("pieces"))


def spread(cut: DataFrame) -> DataFrame:
    """Rows dealt by sequence: what is exploded from them is then grouped by sequence without moving again."""
    return cut.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id")


def multi_rule_rows(seqs: DataFrame, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """seq_id, rule, idx, fragment, place: one segmentation by each rule, fragments in a seeded order. A map over the scan."""
    rows = [cut_rows(seqs, rule, ratio, 1, seed).select("seq_id", F.lit(rule).alias("rule"), F.col("pieces")[0].alias("fragments")) for rule in RULES]
    together = rows[0]
    for row in rows[1:]:
        together = together.unionByName(row)
    placed = together.select("seq_id", "rule", F.posexplode(shuffled(F.col("fragments"), seed, F.col("rule"), F.col("seq_id"))).alias("place", "x"))
    return placed.select("seq_id", "rule", F.col("x.idx").alias("idx"), F.col("x.fragment").alias("fragment"), "place")


def records_in_rows(cut: DataFrame, seed: int = 42) -> DataFrame:
    """What assemble_records returns, from whole sequences (cut_rows) and without a shuffle."""
    rows = cut.filter("seq_id is not null").select("seq_id", F.array_join(F.col("pieces")[0], "").alias("target"), F.transform(shuffled(unique_in_row(), seed, F.col("seq_id")), lambda x: x["fragment"]).alias("fragments"), F.col("pieces").alias("fragment_samples"))
    return rows.select("*", F.size("fragments").alias("num_fragments"), F.size("fragment_samples").alias("replica_count"))


def multi_rule_segment(seqs: DataFrame, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """One segmentation by each rule, fragments in a seeded order."""
    parts = [segment(seqs, rule, ratio, 1, seed).select("seq_id", F.lit(rule).alias("rule"), F.col("pos").alias("idx"), "fragment") for rule in RULES]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    order = Window.partitionBy("seq_id", "rule").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "rule", F.col("seq_id").cast("string"), F.col("idx").cast("string"))), "idx")
    return together.withColumn("place", F.row_number().over(order) - 1)


def assemble_records(fragments: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """One nested record for each sequence: its distinct fragments in a seeded order, and each replica's in order."""
    replicas = fragments.groupBy("seq_id", "replica").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fragment"))), lambda x: x["fragment"]).alias("pieces"))
    samples = replicas.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("replica", "pieces"))), lambda x: x["pieces"]).alias("fragment_samples"), F.count(F.lit(1)).cast("int").alias("replica_count"))
    mixed = shuffle_fragments(unique_fragments(fragments), seed).groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "fragment"))), lambda x: x["fragment"]).alias("fragments"))
    return targets.select("seq_id", F.col("seq").alias("target")).join(mixed, "seq_id").join(samples, "seq_id").select("seq_id", "target", "fragments", "fragment_samples", F.size("fragments").alias("num_fragments"), "replica_count")


def mixture(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs the kth sequence of a with the kth of b, in order of doc_id and seq_id inside 64 hash lanes; targets are joined.

    a, b: seq_id, seq. Numbering inside lanes keeps any one task small; sequences without a partner are left out.
    """
    lane = lambda df, name: df.select(F.pmod(F.col("seq_id"), F.lit(64)).alias("lane"), F.col("seq_id").alias(f"{name}_id"), F.col("seq").alias(f"{name}_seq")).withColumn("k", F.row_number().over(Window.partitionBy("lane").orderBy(f"{name}_id")))
    both = lane(a, "a").join(lane(b, "b"), ["lane", "k"])
    return both.select("a_id", "b_id", F.concat("a_seq", "b_seq").alias("target"))
