"""Queries on sequences, fragments and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import batches as B
from sparkweave.operators import edges as E
from sparkweave.operators import segment as S
from sparkweave.queries.base import DRAW, EDGES, FRAGS, IMPOSSIBLE, SEQS, query
from sparkweave.sources import sequences as Q


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return Q.sequences(Q.table(spark, d, "documents"))


def frags(spark: SparkSession, d: str) -> DataFrame:
    """Three replicas of all sequences, cut once."""
    return Q.once(S.segment(seqs(spark, d), "trypsin", 0.3, 3, 42), "fragments")


def primaries(spark: SparkSession, d: str) -> DataFrame:
    """The primary fragments alone: one replica, cut where it is used."""
    return S.primary(S.segment(seqs(spark, d), "trypsin", 0.3, 1, 42))


def cut(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with the fragments of three replicas in their rows, dealt once: a file may be one task's, and pairs are many more."""
    return S.cut_rows(S.spread(seqs(spark, d)), "trypsin", 0.3, 3, 42)


def primary_rows(spark, d):
    """seq_id and primary: the fragments of one replica, in the rows of the sequences, dealt by sequence."""
    rows = S.cut_rows(S.spread(seqs(spark, d).filter("seq_id is not null")), "trypsin", 0.3, 1, 42)
    return rows.select("seq_id", F.col("pieces")[0].alias("primary"))


def cut_sequences(spark, d):
    """seq_id, grp, seq, primary, edges: sequences with their fragments and the edges that three replicas prove, dealt by sequence."""
    rows = S.spread(seqs(spark, d).filter("seq_id is not null")).select("seq_id", "grp", "seq")
    return rows.withColumn("cut", B.cut_and_proved(0.3, 3, 42)("seq_id", "seq")).select("seq_id", "grp", "seq", "cut.primary", "cut.edges")


def proved(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, grp, i, j of the edges that three replicas prove, without a shuffle."""
    return E.edges_in_rows(S.cut_rows(seqs(spark, d), "trypsin", 0.3, 3, 42))


@query(
    f"WITH {EDGES} SELECT grp, count(*) AS n_edges, count(DISTINCT seq_id) AS n_seqs, sum(i * 31 + j)::BIGINT AS checksum FROM edges JOIN (SELECT DISTINCT seq_id, grp FROM seqs) USING (seq_id) GROUP BY grp"
)
def entry_confirmed_edges(spark, d):
    return proved(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("seq_id").alias("n_seqs"), F.sum(F.col("i") * 31 + F.col("j")).alias("checksum"))


def _rule_sql(condition: str, last: str = "length(seq) + 1") -> str:
    return f"WITH {SEQS}, s AS (SELECT seq_id, list_filter(range(1, {last}), lambda p: {condition}) AS sites FROM seqs) SELECT seq_id, len(sites)::BIGINT AS n_sites, coalesce(list_sum(sites), 0)::BIGINT AS sum_sites FROM s"


def _sites(spark, d, rule):
    s = seqs(spark, d).select("seq_id", S.cleavage_sites(F.col("seq"), rule).alias("sites"))
    return s.select("seq_id", F.size("sites").cast("long").alias("n_sites"), F.aggregate("sites", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_sites"))


@query(_rule_sql("substr(seq, p, 1) IN ('K', 'R') AND substr(seq, p + 1, 1) <> 'P'"))
def sg1_sites_trypsin(spark, d):
    return _sites(spark, d, "trypsin")


@query(_rule_sql("substr(seq, p, 1) = 'K'"))
def sg2_sites_lys_c(spark, d):
    return _sites(spark, d, "lys_c")


@query(f"WITH {SEQS}, s AS (SELECT seq_id, list_filter(range(0, length(seq)), lambda p: substr(seq, p + 1, 1) = 'D') AS sites FROM seqs) SELECT seq_id, len(sites)::BIGINT AS n_sites, coalesce(list_sum(sites), 0)::BIGINT AS sum_sites FROM s")
def sg3_sites_asp_n(spark, d):
    return _sites(spark, d, "asp_n")


@query(_rule_sql("substr(seq, p, 1) IN ('D', 'E')"))
def sg4_sites_glu_c(spark, d):
    return _sites(spark, d, "glu_c")


@query(f"WITH {SEQS}, s AS (SELECT seq_id, seq, unnest(list_filter(range(1, length(seq) + 1), lambda p: substr(seq, p, 1) IN ('K', 'R') AND substr(seq, p + 1, 1) <> 'P')) AS pos FROM seqs) SELECT seq_id, pos::INTEGER AS pos, CASE WHEN substr(seq, pos, 1) = 'K' THEN least(0.3::DOUBLE * 1.5::DOUBLE, 1) ELSE 0.3::DOUBLE END AS prob FROM s")
def sg5_missed_cleavage_prob(spark, d):
    rows = seqs(spark, d).select("seq_id", "seq", F.explode(S.cleavage_sites(F.col("seq"))).alias("pos"))
    return rows.select("seq_id", "pos", S.missed_cleavage_prob(F.col("seq"), F.col("pos"), 0.3).alias("prob"))


@query(f"WITH {FRAGS} SELECT seq_id, replica, pos, start, fragment FROM frag WHERE replica = 0")
def sg6_segment(spark, d):
    return S.segment(seqs(spark, d), "trypsin", 0.3, 1, 42).select("seq_id", "replica", "pos", "start", "fragment")


@query(f"WITH {FRAGS} SELECT seq_id, replica, count(*) AS n_fragments, md5(string_agg(fragment, '|' ORDER BY pos)) AS digest FROM frag GROUP BY ALL")
def sg7_replicate(spark, d):
    parts = frags(spark, d).groupBy("seq_id", "replica").agg(F.count(F.lit(1)).alias("n_fragments"), F.array_sort(F.collect_list(F.struct("pos", "fragment"))).alias("p"))
    return parts.select("seq_id", "replica", "n_fragments", F.md5(F.array_join(F.transform("p", lambda x: x["fragment"]), "|")).alias("digest"))


UNIQUE = FRAGS + ", firsts AS (SELECT seq_id, fragment, min(replica * 1000000 + pos) AS f FROM frag GROUP BY ALL), uniq AS (SELECT seq_id, fragment, row_number() OVER (PARTITION BY seq_id ORDER BY f) - 1 AS idx FROM firsts)"
MIXED = UNIQUE + ", placed AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY md5(concat_ws('|', 42, seq_id, idx)), idx) - 1 AS place FROM uniq)"


@query(f"WITH {UNIQUE} SELECT seq_id, fragment, idx::INTEGER AS idx FROM uniq")
def sg8_unique_fragments(spark, d):
    return cut(spark, d).select("seq_id", F.posexplode(S.unique_in_row()).alias("idx", "fragment")).select("seq_id", "fragment", "idx")


@query(f"WITH {MIXED} SELECT seq_id, fragment, idx::INTEGER AS idx, place::INTEGER AS place FROM placed")
def sg9_shuffle_fragments(spark, d):
    placed = cut(spark, d).select("seq_id", F.posexplode(S.shuffled(S.unique_in_row(), 42, F.col("seq_id"))).alias("place", "x"))
    return placed.select("seq_id", F.col("x.fragment").alias("fragment"), F.col("x.idx").alias("idx"), "place")


@query(f"""WITH {SEQS}, a AS (SELECT seq_id % 64 AS lane, seq_id, seq, row_number() OVER (PARTITION BY seq_id % 64 ORDER BY seq_id) AS k FROM seqs WHERE grp = 'en'),
b AS (SELECT seq_id % 64 AS lane, seq_id, seq, row_number() OVER (PARTITION BY seq_id % 64 ORDER BY seq_id) AS k FROM seqs WHERE grp = 'fr')
SELECT a.seq_id AS a_id, b.seq_id AS b_id, a.seq || b.seq AS target FROM a JOIN b USING (lane, k)""")
def sg10_mixture(spark, d):
    s = seqs(spark, d)
    return S.mixture(s.filter("grp = 'en'"), s.filter("grp = 'fr'"))


_RULE_SITES = {
    "trypsin": "list_filter(range(1, length(seq) + 1), lambda p: substr(seq, p, 1) IN ('K', 'R') AND substr(seq, p + 1, 1) <> 'P')",
    "lys_c": "list_filter(range(1, length(seq) + 1), lambda p: substr(seq, p, 1) = 'K')",
    "asp_n": "list_filter(range(0, length(seq)), lambda p: substr(seq, p + 1, 1) = 'D')",
    "glu_c": "list_filter(range(1, length(seq) + 1), lambda p: substr(seq, p, 1) IN ('D', 'E'))",
}
_ANY = " UNION ALL ".join(f"SELECT seq_id, seq, '{rule}' AS rule, {sites} AS sites FROM seqs" for rule, sites in _RULE_SITES.items())


@query(f"""WITH {SEQS}, sited AS ({_ANY}),
cut AS (SELECT *, list_filter(sites, lambda p: {DRAW.format("42, seq_id, 0, p")} > CASE WHEN p > 0 AND substr(seq, p, 1) = 'K' THEN 0.3::DOUBLE * 1.5::DOUBLE ELSE 0.3::DOUBLE END) AS cuts FROM sited),
pieces AS (SELECT seq_id, seq, rule, unnest(list_concat([0], cuts)) AS b, unnest(list_concat(cuts, [length(seq)])) AS e FROM cut),
f AS (SELECT seq_id, rule, row_number() OVER (PARTITION BY seq_id, rule ORDER BY b) - 1 AS idx, substr(seq, b + 1, e - b) AS fragment FROM pieces WHERE e > b)
SELECT seq_id, rule, idx::INTEGER AS idx, fragment, (row_number() OVER (PARTITION BY seq_id, rule ORDER BY md5(concat_ws('|', 42, rule, seq_id, idx)), idx) - 1)::INTEGER AS place FROM f""")
def sg11_multi_rule(spark, d):
    return S.multi_rule_rows(S.spread(seqs(spark, d)), 0.3, 42)


@query(f"""WITH {MIXED}, reps AS (SELECT seq_id, replica, string_agg(fragment, ',' ORDER BY pos) AS pieces FROM frag GROUP BY ALL),
samples AS (SELECT seq_id, string_agg(pieces, ';' ORDER BY replica) AS samples, count(*)::INTEGER AS replica_count FROM reps GROUP BY seq_id),
u AS (SELECT seq_id, string_agg(fragment, ',' ORDER BY place) AS fragments, count(*)::INTEGER AS num_fragments FROM placed GROUP BY seq_id)
SELECT seq_id, seq AS target, md5(fragments) AS fragments_md5, md5(samples) AS samples_md5, num_fragments, replica_count FROM seqs JOIN u USING (seq_id) JOIN samples USING (seq_id)""")
def sg12_assemble_records(spark, d):
    r = S.records_in_rows(cut(spark, d), 42)
    return r.select("seq_id", "target", F.md5(F.array_join("fragments", ",")).alias("fragments_md5"), F.md5(F.array_join(F.transform("fragment_samples", lambda x: F.array_join(x, ",")), ";")).alias("samples_md5"), "num_fragments", "replica_count")


# Edges

_PAIRS = ", pairs AS (SELECT a.seq_id, a.idx AS i, b.idx AS j, a.fragment AS a, b.fragment AS b FROM prim a JOIN prim b ON a.seq_id = b.seq_id AND a.idx <> b.idx)"
PAIRS, UNPROVED_PAIRS = EDGES + _PAIRS, FRAGS + _PAIRS


@query(f"WITH {EDGES} SELECT seq_id, i, j FROM edges")
def j1_confirmed_edges(spark, d):
    return proved(spark, d).select("seq_id", "i", "j")


@query(f"WITH {EDGES} SELECT seq_id, i, j FROM edges")
def j1_confirmed_edges_of_a_table(spark, d):
    """The same from a table of fragments, where sequences are not at hand."""
    # Dealt by sequence before it is cut: sequences move once, their fragments don't.
    return E.confirmed_edges(S.segment(S.spread(seqs(spark, d)), "trypsin", 0.3, 3, 42))


@query(f"WITH {PAIRS} SELECT seq_id, count(*) AS n_pairs, sum(i * 7 + j * 13)::BIGINT AS checksum FROM pairs GROUP BY seq_id")
def j2_ordered_pairs(spark, d):
    pairs = E.ordered_pairs(primaries(spark, d))
    return pairs.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("i") * 7 + F.col("j") * 13).alias("checksum"))


@query(f"WITH {PAIRS} SELECT seq_id, count(*) AS n_unscored, sum(i * 7 + j * 13)::BIGINT AS checksum FROM (SELECT seq_id, i, j FROM pairs EXCEPT SELECT * FROM edges) GROUP BY seq_id")
def j3_unscored_pairs(spark, d):
    left = E.pairs_in_rows(cut(spark, d)).filter(~F.col("confirmed"))
    return left.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_unscored"), F.sum(F.col("i") * 7 + F.col("j") * 13).alias("checksum"))


@query(f"WITH {EDGES} SELECT seq_id, i, count(*)::INTEGER AS n_successors, string_agg(j, ',' ORDER BY j) AS successors FROM edges GROUP BY ALL")
def j4_confirmed_successors(spark, d):
    s = E.confirmed_successors(proved(spark, d))
    return s.select("seq_id", "i", F.size("successors").alias("n_successors"), F.array_join(F.transform("successors", lambda x: x.cast("string")), ",").alias("successors"))


#: A plain score for pairs, where a query needs one: shared letters at the seam.
def seam_score(pairs: DataFrame) -> DataFrame:
    return pairs.select("seq_id", "i", "j", (F.length("a") * 3 + F.length("b") * 2 - F.abs(F.ascii("a") - F.ascii("b"))).cast("double").alias("score"))


SEAM = PAIRS + ", scores AS (SELECT seq_id, i, j, (length(a) * 3 + length(b) * 2 - abs(ascii(a) - ascii(b)))::DOUBLE AS score FROM pairs)"


@query(f"WITH {SEAM}, s AS (SELECT seq_id, i, j, CASE WHEN (i + j) % 3 = 0 THEN -score ELSE score END AS score FROM scores) SELECT seq_id, count(*) AS n, sum(score) AS total FROM s GROUP BY seq_id")
def j5_merge_scores(spark, d):
    old = seam_score(E.ordered_pairs(primaries(spark, d)))
    new = old.filter((F.col("i") + F.col("j")) % 3 == 0).select("seq_id", "i", "j", (-F.col("score")).alias("score"))
    return E.merge_scores(old, new).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query(f"WITH {SEAM}, s AS (SELECT s.seq_id, s.i, s.j, e.i IS NOT NULL AS confirmed, CASE WHEN e.i IS NOT NULL THEN 1000.0::DOUBLE ELSE score END AS score FROM scores s LEFT JOIN edges e ON e.seq_id = s.seq_id AND e.i = s.i AND e.j = s.j) SELECT seq_id, sum(score) AS total, count(*) FILTER (confirmed) AS n_confirmed FROM s GROUP BY seq_id")
def j6_apply_confirmed(spark, d):
    s = E.apply_confirmed(seam_score(E.ordered_pairs(primaries(spark, d))), proved(spark, d).select("seq_id", "i", "j"))
    return s.groupBy("seq_id").agg(F.sum("score").alias("total"), F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"))


def shuffled_order(prim: DataFrame) -> DataFrame:
    """A seeded order of the primary fragments: seq_id, place, idx."""
    return S.shuffle_fragments(prim, 7).select("seq_id", "place", "idx")


ORDERED = EDGES + """, ord AS MATERIALIZED (SELECT seq_id, idx, row_number() OVER (PARTITION BY seq_id ORDER BY md5(concat_ws('|', 7, seq_id, idx)), idx) - 1 AS place FROM prim),
consec AS MATERIALIZED (SELECT * FROM (SELECT seq_id, place, idx AS i, lead(idx) OVER (PARTITION BY seq_id ORDER BY place) AS j FROM ord) WHERE j IS NOT NULL)"""


@query(f"""WITH {ORDERED}, n AS (SELECT seq_id, count(*) AS n FROM prim GROUP BY seq_id), t AS (SELECT seq_id, count(*) AS total FROM edges GROUP BY seq_id),
r AS (SELECT seq_id, count(*) AS realised FROM (SELECT DISTINCT seq_id, i, j FROM consec) JOIN edges USING (seq_id, i, j) GROUP BY seq_id)
SELECT seq_id, coalesce(realised, 0) AS realised, coalesce(total, 0) AS total, CASE WHEN total > 0 AND n >= 2 THEN coalesce(realised, 0) / total::DOUBLE END AS agreement FROM n LEFT JOIN t USING (seq_id) LEFT JOIN r USING (seq_id)""")
def j7_confirmed_agreement(spark, d):
    return E.order_in_row(cut(spark, d)).select("seq_id", *E.agreement_in_row())


@query(f"WITH {ORDERED} SELECT seq_id, place::INTEGER AS place, i, j FROM consec c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.seq_id = c.seq_id AND e.i = c.i AND e.j = c.j)")
def j8_unconfirmed_junctions(spark, d):
    steps = E.order_in_row(cut(spark, d)).select("seq_id", F.explode("steps").alias("x"))
    return steps.filter(~F.col("x.confirmed")).select("seq_id", "x.place", "x.i", "x.j")


PRUNED = f""", tj AS (SELECT seq_id, idx, fragment, lead(fragment) OVER (PARTITION BY seq_id ORDER BY idx) AS nxt FROM prim),
t AS (SELECT seq_id, count(*) AS n, count(nxt) AS true_junctions, count(*) FILTER (nxt IS NOT NULL AND {IMPOSSIBLE.format("fragment", "nxt")}) AS pruned_true FROM tj GROUP BY seq_id),
p AS (SELECT seq_id, count(*) AS pruned_total FROM pairs WHERE {IMPOSSIBLE.format("a", "b")} GROUP BY seq_id),
recall AS (SELECT seq_id, n, true_junctions, pruned_true, CASE WHEN true_junctions > 0 THEN 1 - pruned_true / true_junctions::DOUBLE END AS recall, coalesce(pruned_total, 0) AS pruned_total FROM t LEFT JOIN p USING (seq_id))"""
RECALL = PAIRS + PRUNED


@query(f"WITH {RECALL} SELECT * FROM recall")
def j9_filter_recall(spark, d):
    return E.filter_recall(primaries(spark, d))


@query(f"WITH {UNPROVED_PAIRS} SELECT seq_id, count(*) AS n_impossible, sum(i * 7 + j * 13)::BIGINT AS checksum FROM pairs WHERE {IMPOSSIBLE.format('a', 'b')} GROUP BY seq_id")
def pf5_impossible_pairs(spark, d):
    ruled_out = E.ordered_pairs(primaries(spark, d)).filter(E.impossible(F.col("a"), F.col("b")))
    return ruled_out.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_impossible"), F.sum(F.col("i") * 7 + F.col("j") * 13).alias("checksum"))


@query(f"WITH {FRAGS} SELECT seq_id, idx, regexp_matches(fragment, '[KR][^P]') AS missed FROM prim")
def pf6_missed_cleavage(spark, d):
    return primaries(spark, d).select("seq_id", "idx", E.missed_cleavage_flag(F.col("fragment")).alias("missed"))


@query(f"WITH {FRAGS} SELECT seq_id, idx, fragment FROM prim WHERE fragment LIKE 'M%'")
def pf7_start_candidates(spark, d):
    return primaries(spark, d).filter(F.col("fragment").startswith("M")).select("seq_id", "idx", "fragment")


@query(f"WITH {RECALL} SELECT seq_id, CASE WHEN n > 1 THEN pruned_total / (n * (n - 1))::DOUBLE * 100 ELSE 0 END AS pruned_pct FROM recall")
def m17_pruned_pct(spark, d):
    return E.pruned_pct(E.filter_recall(primaries(spark, d)))
