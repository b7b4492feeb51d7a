"""Worked cases and invariants of the operators outside the llm subpackage."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import stats as T
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import reports as A
from sparkweave.operators import search as O
from sparkweave.operators import segment as S
from sparkweave.sources import runs as R
from sparkweave.sources import sequences as Q


def prim(spark, pieces):
    return spark.createDataFrame([(1, "x", i, p) for i, p in enumerate(pieces)], "seq_id long, grp string, idx int, fragment string")


def test_true_order_is_the_order_of_cutting(spark):
    """Fragments of a text, given in any numbering, are found in the order in which they were cut."""
    rng = random.Random(17)
    for _ in range(5):
        pieces = ["".join(rng.choice("ABCDEFGH") for _ in range(3 + k)) for k in range(5)]
        numbered = pieces[:]
        rng.shuffle(numbered)
        found = M.recover_true_order(spark.createDataFrame([(1, "".join(pieces))], "seq_id long, seq string"), prim(spark, numbered)).first().path
        assert [numbered[i] for i in found] == pieces
    longer = spark.createDataFrame([(1, "".join(pieces) + "Z")], "seq_id long, seq string")
    assert M.recover_true_order(longer, prim(spark, numbered)).first().path is None


def test_junction_ranks_against_brute_force(spark):
    rng = random.Random(18)
    n = 6
    scores = {(i, j): rng.random() for i in range(n) for j in range(n) if i != j}
    true = [(i, i + 1) for i in range(n - 1)]
    ranks = [1 + sum(scores[i, k] > scores[i, j] for k in range(n) if k not in (i, j)) for i, j in true]
    rows = spark.createDataFrame([(1, i, j, s) for (i, j), s in scores.items()], "seq_id long, i int, j int, score double")
    edges = spark.createDataFrame([(1, i, j) for i, j in true], "seq_id long, i int, j int")
    r = M.junction_ranking(rows, edges).first()
    assert (r.junctions, r.top1) == (n - 1, sum(k == 1 for k in ranks) / (n - 1))
    assert r.mrr == pytest.approx(sum(1 / k for k in ranks) / (n - 1))
    assert M.junction_ranking(rows, edges, edges.filter("i < 2")).first().junctions == n - 3


def test_diagnostics_keep_every_sample(spark):
    """A sample that its fragments do not tile, and one without fragments, keep their rows; confirmed neighbours are counted apart."""
    targets = spark.createDataFrame([(1, "AKBRC"), (2, "AKX"), (3, "")], "seq_id long, seq string")
    pieces = [(1, "x", 0, "BR"), (1, "x", 1, "AK"), (1, "x", 2, "C"), (2, "x", 0, "AK"), (2, "x", 1, "Y")]
    p = spark.createDataFrame(pieces, "seq_id long, grp string, idx int, fragment string")
    scores = spark.createDataFrame([(1, i, j, float(10 * i + j)) for i in range(3) for j in range(3) if i != j], "seq_id long, i int, j int, score double")
    edges = spark.createDataFrame([(1, 1, 0)], "seq_id long, i int, j int")
    found = {r.seq_id: r for r in M.sample_diagnostics(targets, p, scores, edges).collect()}
    assert [(k, r.fragments, r.recovered, r.junctions, r.excluded) for k, r in sorted(found.items())] == [(1, 3, True, 1, 1), (2, 2, False, 0, 0), (3, 0, False, 0, 0)]
    assert found[1].top1 == 1.0 and found[2].mrr is None and found[3].recall is None


def test_metric_intervals_by_kind(spark):
    """Binary metrics have the score interval, the others the bootstrap's; constants and single values say so."""
    rng = random.Random(19)
    values = [rng.gauss(5, 1) for _ in range(60)]
    rows = [("a", "exact", i, float(i < 15)) for i in range(60)] + [("a", "value", i, v) for i, v in enumerate(values)]
    rows += [("b", "value", i, 2.0) for i in range(4)] + [("c", "value", 0, 7.0)]
    df = spark.createDataFrame(rows, "g string, metric string, idx int, x double")
    found = {(r.g, r.metric): r for r in T.metric_interval(df, ["g"], "idx", "x", ["exact"], 300).collect()}
    exact, value = found["a", "exact"], found["a", "value"]
    p, n, z = 0.25, 60, T.Z95
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert exact.high - exact.low == pytest.approx(2 * half) and exact.method == "wilson"
    mean = sum(values) / n
    error = math.sqrt(sum((v - mean) ** 2 for v in values)) / n
    assert value.method == "bca" and value.low == pytest.approx(mean - z * error, abs=error) and value.high == pytest.approx(mean + z * error, abs=error)
    assert (found["b", "value"].low, found["b", "value"].high) == (2.0, 2.0) and math.isnan(found["c", "value"].low)


def test_filter_recall_counts_match_pairs(spark):
    p = prim(spark, ["MAK", "PVR", "LLG", "PR"])
    r = E.filter_recall(p).first()
    pairs = E.ordered_pairs(p).filter(E.impossible(F.col("a"), F.col("b")))
    assert r.pruned_total == pairs.count() and r.true_junctions == 3


def test_segments_join_back_to_the_sequence(spark):
    docs = spark.createDataFrame([(1, "mark the parker and krill prk " * 30, "en"), (2, None, "fr"), (3, "", None), (4, "1 2 3", "en")], "doc_id long, text string, lang string")
    seqs = Q.sequences(docs)
    assert {r.doc_id for r in seqs.collect()} == {1}
    for rule in S.RULES:
        parts = S.segment(seqs, rule, 0.3, 2, 1)
        joined = parts.groupBy("seq_id", "replica").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fragment"))), lambda x: x["fragment"]), "").alias("s"))
        assert joined.join(seqs, "seq_id").filter("s <> seq").isEmpty()


def test_confirmed_edges_against_brute_force(spark):
    rows = [(1, "x", 0, i, 0, f) for i, f in enumerate(["AB", "C", "DE", "C"])] + [(1, "x", 1, 0, 0, "ABC"), (1, "x", 1, 1, 0, "DEC"), (1, "x", 2, 0, 0, "CC")]
    frags = spark.createDataFrame(rows, "seq_id long, grp string, replica int, pos int, start int, fragment string")
    assert {(r.i, r.j) for r in E.confirmed_edges(frags).collect()} == {(0, 3), (2, 3), (3, 3)}


def test_greedy_and_beam_cover_every_fragment(spark):
    p = prim(spark, ["MAK", "LVR", "PPK", "GG", "AAR"])
    pairs = E.ordered_pairs(p)
    scores = pairs.select("seq_id", "i", "j", (F.col("i") * 7 % 5 - F.col("j") * 3 % 4).cast("double").alias("score"), F.lit(False).alias("confirmed"), E.impossible(F.col("a"), F.col("b")).alias("impossible"))
    for found in (O.greedy_order(scores, p), O.beam_order(scores, p, 2)):
        path = found.first().path
        assert sorted(path) == [0, 1, 2, 3, 4] and path[0] == 0
    one = prim(spark, ["K"])
    assert O.greedy_order(scores.filter("false"), one).first().path == [0]


def test_select_best_keeps_the_earliest(spark):
    c = spark.createDataFrame([(1, i, s) for i, s in enumerate([3.0, 2.0, 2.0, 1.95, 1.0], 1)], "sample int, iteration int, score double")
    assert O.select_best(c).first().best_iteration == 5
    assert O.select_best(c, 0.1, 2).first().best_iteration == 2


def test_wilcoxon_worked_case(spark):
    d = spark.createDataFrame([(0, x, 0.0) for x in (1.0, -2.0, 3.0, 4.0, -5.0, 6.0)], "g int, a double, b double")
    r = T.wilcoxon_signed_rank(d, "a", "b", ["g"]).first()
    signs = [sum(k for k in range(1, 7) if m >> (k - 1) & 1) for m in range(64)]
    w = min(r.w_plus, r.w_minus)
    assert r.p == pytest.approx(min(1, 2 * sum(s <= w for s in signs) / 64))


def test_wilcoxon_of_millions_of_pairs(spark):
    """The variance of three million differences does not fit a long."""
    n = 3_000_000
    d = spark.range(n).select(F.lit(0).alias("g"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.when(F.col("id") % 4 == 1, -1.0).otherwise(2.0)).alias("a"), F.lit(0.0).alias("b"))
    r = T.wilcoxon_signed_rank(d, "a", "b", ["g"]).first()
    assert (r.n_pairs, r.n_nonzero, r.n_positive, r.n_negative) == (n, n, n * 3 // 4, n // 4)
    ones, twos = n * 3 // 4, n // 4
    assert r.w_plus == n // 2 * (ones + 1) / 2 + twos * (ones + (twos + 1) / 2) and r.w_minus == n // 4 * (ones + 1) / 2
    assert r.p == 0.0


def test_normal_and_t(spark):
    z = spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 1.0, 2.5)], "z double").select("z", T.normal_cdf(F.col("z")).alias("p"))
    for r in z.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-12)
    q = spark.createDataFrame([(0.025,), (0.5,), (0.975,)], "p double").select(T.normal_quantile(F.col("p")).alias("z"))
    assert [r.z for r in q.collect()] == pytest.approx([-T.Z95, 0, T.Z95], abs=1e-9)
    t = spark.createDataFrame([(2.0, 1), (2.0, 2), (2.0, 10)], "t double, df int").select(T.student_t_two_sided(F.col("t"), F.col("df")).alias("p"))
    assert [r.p for r in t.collect()] == pytest.approx([0.295167, 0.183503, 0.073388], abs=1e-6)


def test_wilson_ends_and_empty(spark):
    rows = spark.createDataFrame([(0, 5), (5, 5), (0, 0)], "k int, n int")
    low, high = T.wilson_interval(F.col("k"), F.col("n"))
    r = rows.select(low.alias("low"), high.alias("high")).collect()
    assert r[0].low == 0 and r[1].high == 1 and math.isnan(r[2].low)


def test_bootstrap_fallbacks(spark):
    rows = spark.createDataFrame([("one", 0, 1.0)] + [("same", i, 2.0) for i in range(4)] + [("var", i, float(i)) for i in range(12)], "g string, idx int, x double")
    r = {x.g: x for x in T.bca_bootstrap(rows, ["g"], "idx", "x", 200, 1).collect()}
    assert r["one"].method == "bca (insufficient n)" and r["same"].low == r["same"].high == 2.0
    assert r["var"].low < r["var"].point < r["var"].high


def test_bins_and_error_classes(spark):
    n = spark.createDataFrame([(x,) for x in (1, 2, 4, 5, 9, 10, 19, 20, 49, 50, 5000)], "n int").select(M.fragment_bin(F.col("n")).alias("b"))
    assert [r.b for r in n.collect()] == ["<2", "2-4", "2-4", "5-9", "5-9", "10-19", "10-19", "20-49", "20-49", "50+", "50+"]
    one = spark.createDataFrame([("g", "5-9", 1.0)], "g string, bin string, x double")
    assert sorted((r.bin, r.n) for r in A.stratify_by_bin(one, ["g"], "x").collect()) == [("10-19", 0), ("2-4", 0), ("20-49", 0), ("5-9", 1), ("50+", 0)]


def test_grid_needs_values(spark):
    assert O.lever_grid(spark, {"a": [1, 2], "b": [3]}).count() == 2
    with pytest.raises(ValueError):
        O.lever_grid(spark, {"a": []})


def test_sample_records_with_gaps(spark):
    """Records without fragments, order, iterations or control give a row with nulls, never an error."""
    rows = [(1, "g", "ABC", ["A", "BC"], [0, 1], ("ABD", None), [(1, 0.1, 0.2), (2, 0.3, 0.2)]), (2, None, "AB", None, None, None, None), (3, "g", "AB", ["A", "B"], [0, 0], (None, 0.25), [])]
    samples = spark.createDataFrame(rows, R.SAMPLE_RECORD).withColumn("run", F.lit("r"))
    flat = {r["sample"]: r for r in R.sample_rows(samples).collect()}
    assert (flat[1].exact, flat[1].best_iteration, flat[1].gain) == (1.0, 1, 0.0) and flat[2].best_validity is None and len(flat) == 3
    filled = {r["sample"]: (r.control_similarity, r.random_similarity) for r in R.backfill_edit_similarity(samples).collect()}
    assert filled[1] == (pytest.approx(2 / 3), 1.0) and filled[2] == (None, None) and filled[3] == (0.25, None)
