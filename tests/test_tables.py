"""Tables over wide rows: tests, families, overviews, intervals, text."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import display as D
from sparkweave.operators import tables as B
from sparkweave.operators.candidates import ARMS, METRICS

COMPARISONS = [("vs_control", "selected", "control"), ("vs_first", "selected", "first")]
EXTRA = ["nterm_correct boolean", "breakpoints double", "breakpoints_normalized double", "concordance double", "comparable_pairs int", "n_edges long", "pruned_pct double",
         "num_iterations int", "best_iteration int", "true_junctions long", "cleavage_recall double", "best_validity double", "n int"]
SCHEMA = ", ".join(["run string", "sample long", *(f"{a}_{m} double" for a, m in product(ARMS, METRICS)), *EXTRA])


def wide_rows(spark):
    """Run a has all arms; run b has no control, and its first pass equals what was selected."""
    rng, rows = random.Random(3), []
    for run, i in product("ab", range(40)):
        cells = {f"{a}_{m}": float(rng.random() < 0.4) if m == "exact_match" else round(rng.random(), 2) for a, m in product(ARMS, METRICS)}
        if run == "b":
            cells |= {f"control_{m}": None for m in METRICS} | {f"first_{m}": cells[f"selected_{m}"] for m in METRICS}
        if i == 7:
            cells["selected_tau"] = float("nan")
        rows.append((run, i, *cells.values(), i % 2 == 0, float(i % 3), 0.5, None if i % 4 else 0.75, i % 5, i, 12.5, 3, 1 + i % 3, i % 2, 1.0 - i % 2, float("inf") if i == 0 else 2.5, 5))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def wide(spark):
    return wide_rows(spark).cache()


@pytest.fixture(scope="module")
def tests(wide):
    return B.paired_tests(B.paired(wide, ["run"], COMPARISONS), ["run"], ["exact_match"]).cache()


def normal(z):
    return (1 + math.erf(z / math.sqrt(2))) / 2


def wilcoxon(d):
    d = [round(x, 9) for x in d if round(x, 9)]
    sizes = sorted(abs(x) for x in d)
    rank = {s: sizes.index(s) + (sizes.count(s) + 1) / 2 for s in sizes}
    n, ties = len(d), sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
    w = min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    z = max((abs(w - n * (n + 1) / 4) - 0.5) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 0)
    return w, n, sum(x > 0 for x in d), ties, min(1, 2 * (1 - normal(z)))


def test_paired_tests_against_brute_force(wide, tests):
    rows = [r for r in wide.collect() if r.run == "a"]
    found = {(r.run, r.comparison, r.metric): r for r in tests.collect()}
    for name, a, b in COMPARISONS:
        x, y = [r[f"{a}_exact_match"] for r in rows], [r[f"{b}_exact_match"] for r in rows]
        n10, n01 = sum(p > q for p, q in zip(x, y)), sum(p < q for p, q in zip(x, y))
        got = found["a", name, "exact_match"]
        p = min(1, 2 * sum(math.comb(n10 + n01, i) for i in range(min(n10, n01) + 1)) / 2 ** (n10 + n01))
        assert (got.n10, got.n01, got.statistic, got.n_used, got.test) == (n10, n01, n10, 40, "mcnemar_exact")
        assert got.p == pytest.approx(p, abs=1e-6) and got.n_nonzero is None
        for m in METRICS[1:]:
            d = [r[f"{a}_{m}"] - r[f"{b}_{m}"] for r in rows if not math.isnan(r[f"{a}_{m}"])]
            w, n, plus, ties, p = wilcoxon(d)
            got = found["a", name, m]
            assert (got.statistic, got.n_used, got.n_positive, got.n_negative, got.n_pairs) == (w, n, plus, n - plus, len(d))
            assert got.mean_delta == pytest.approx(sum(d) / len(d), abs=1e-6)
            assert got.method == (B.NORMAL if ties else B.ENUMERATED)
            if ties:
                assert got.p == pytest.approx(p, abs=1e-6)


def test_absent_arm_and_equal_arms(tests):
    rows = [r for r in tests.collect() if r.run == "b"]
    assert {r.comparison for r in rows} == {"vs_first"} and len(rows) == 6
    for r in rows:
        assert r.p == 1.0 and r.mean_delta == 0
        if r.metric != "exact_match":
            assert (r.method, r.statistic, r.n_used) == (B.NO_DIFFERENCE, None, 0)


def test_family_is_a_parameter(spark):
    rows = [("r", "c", m, p) for m, p in zip(METRICS, (0.014, 0.5, 0.2, 0.9, 0.001, 0.7))]
    raw = spark.createDataFrame(rows, "run string, comparison string, metric string, p double")
    six = {r.metric: r for r in B.with_family(raw, ["run"]).collect()}
    four = {r.metric: r for r in B.with_family(raw, ["run"], ["exact_match", "edit_similarity", "apa", "lcr"]).collect()}
    assert six["exact_match"].p_holm == pytest.approx(0.07) and not six["exact_match"].reject and six["lcr"].reject
    assert four["exact_match"].p_holm == pytest.approx(0.042) and four["exact_match"].reject
    assert {r.family_size for r in four.values()} == {4} and len(four) == 4


def test_run_overview(wide, tests):
    found = {r.run: r for r in B.run_overview(wide, B.with_family(tests, ["run"]), ["run"], COMPARISONS).collect()}
    rows = [r for r in wide.collect() if r.run == "a"]
    a, b = found["a"], found["b"]
    mean = lambda xs: sum(xs) / len(xs)
    assert a.n_samples == a.exact_match_n == 40 and len(a) == 79
    assert a.selected_tau == pytest.approx(mean([r.selected_tau for r in rows if not math.isnan(r.selected_tau)]), abs=1e-6)
    assert a.ceiling_gap_apa == pytest.approx(mean([r.ceiling_apa - r.selected_apa for r in rows]), abs=1e-6)
    assert a.em_given_correct_nterm == pytest.approx(mean([r.selected_exact_match for r in rows if r.nterm_correct]), abs=1e-6)
    assert (a.zero_breakpoint_samples, a.mean_validity_concordance, a.cleavage_recall) == (14, 0.75, 0.0)
    assert a.delta_vs_control_apa == pytest.approx(mean([r.selected_apa - r.control_apa for r in rows]), abs=1e-6)
    assert (b.control_apa, b.delta_vs_control_apa, b.n_significant_vs_control) == (None, None, None)
    assert (b.delta_vs_first_apa, b.p_holm_vs_first_apa, b.n_significant_vs_first) == (0, 1, 0)


def test_intervals(spark, wide):
    pairs = B.paired(wide, ["run"], COMPARISONS[:1], ["exact_match", "apa"])
    found = {r.metric: r for r in B.delta_intervals(pairs, ["run"], 2000).collect()}
    d = [r.selected_apa - r.control_apa for r in wide.collect() if r.run == "a"]
    rng = random.Random(1)
    means = sorted(sum(rng.choices(d, k=40)) / 40 for _ in range(4000))
    assert found["apa"].point == pytest.approx(sum(d) / 40) and found["apa"].n == 40
    assert found["apa"].low == pytest.approx(means[100], abs=0.03) and found["apa"].high == pytest.approx(means[3900], abs=0.03)
    values = pairs.select("run", "metric", F.col("a").alias("value")).union(spark.createDataFrame([("a", "apa", None), ("a", "exact_match", float("nan"))], "run string, metric string, value double"))
    both = {r.metric: r for r in B.metric_intervals(values, ["run"], ["exact_match"], 500).collect()}
    assert both["exact_match"].method == "wilson" and both["exact_match"].n == both["apa"].n == 40
    assert both["apa"].low < both["apa"].point < both["apa"].high


def test_empty_tables(wide):
    none = wide.filter("run = 'z'")
    pairs = B.paired(none, ["run"], COMPARISONS)
    tests = B.with_family(B.paired_tests(pairs, ["run"], ["exact_match"]), ["run"])
    assert tests.count() == 0 and B.run_overview(none, tests, ["run"], COMPARISONS).count() == 0
    assert B.delta_intervals(pairs, ["run"], 100).count() == 0 and B.sample_lines(none, ["run"]).count() == 0


def test_text(spark, wide):
    lines = {(r.run, r.sample): r for r in B.sample_lines(wide, ["run"]).collect()}
    assert lines["a", 0].score == "n/a" and lines["a", 1].score == "2.5000"
    assert (lines["a", 1].pruned, lines["a", 1].fragments, lines["a", 1].confirmed, lines["a", 1].best_iteration) == ("12.50%", "5", "1", "2")
    numbers = spark.createDataFrame([(0, None), (1, float("nan")), (2, float("-inf")), (3, -0.00001), (4, 0.12345), (5, -2.0), (6, 0.0009), (7, 0.0426)], "i int, x double")
    rows = numbers.orderBy("i").select(D.shown(F.col("x")).alias("x"), D.shown(F.col("x"), 2, True).alias("s"), D.shown_p(F.col("x")).alias("p"), D.shown_count(F.col("i") - 4, True).alias("c")).collect()
    assert [r.x for r in rows] == ["n/a", "n/a", "n/a", "0.0000", "0.1235", "-2.0000", "0.0009", "0.0426"]
    assert [r.s for r in rows[3:]] == ["+0.00", "+0.12", "-2.00", "+0.00", "+0.04"]
    assert [r.p for r in rows[:2]] == ["n/a", "n/a"] and [r.p for r in rows[6:]] == ["<0.001", "0.043"]
    assert [r.c for r in rows[:5]] == ["-4", "-3", "-2", "-1", "+0"]
    ends = spark.createDataFrame([(0.5, 0.25, 0.75), (0.5, None, 0.75), (None, 0.1, 0.2), (0.5, float("nan"), 0.7)], "p double, l double, h double")
    assert [r[0] for r in ends.select(D.shown_interval(F.col("p"), F.col("l"), F.col("h"), 2)).collect()] == ["0.50 [0.25, 0.75]", "0.50", "n/a", "0.50"]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in flags.select(D.shown_flag(F.col("b"))).collect()] == ["yes", "no", "n/a"]
