"""Queries on run folders. A run is an order priority, a sample an order; its lines are fragments and iterations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweave.functions import stats as T
from sparkweave.functions.rounding import settle
from sparkweave.operators import reports as A
from sparkweave.operators.search import combo_overrides
from sparkweave.queries.base import query
from sparkweave.queries.report_queries import ARMS, BIN_GRID, LONG, R6, arms, long
from sparkweave.queries.stat_queries import HOLM, RAW_W, phi
from sparkweave.sources import runs as R
from sparkweave.sources.sequences import once, shared_folder, table

#: One row a sample with its lists: fragments in their own order, ord as the prices order them.
RECORDS = """line AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS pos,
  l_returnflag || l_linestatus || l_partkey AS fragment, l_extendedprice AS price, l_discount AS lever, l_tax AS validity FROM lineitem),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY price, pos) - 1 AS place FROM line),
rec AS MATERIALIZED (SELECT o_orderpriority AS run, sample, o_orderstatus AS grp, count(*) AS n, string_agg(fragment, '' ORDER BY pos) AS target, list(pos ORDER BY place) AS ord,
  string_agg(fragment, '' ORDER BY place) AS made, string_agg(fragment, '' ORDER BY place DESC) AS reversed FROM placed JOIN orders ON o_orderkey = sample GROUP BY ALL)"""


def records(spark, d):
    lines = table(spark, d, "lineitem").filter("l_orderkey is not null")
    of = Window.partitionBy("l_orderkey")
    pos = F.row_number().over(of.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")) - 1
    fragment = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    gathered = lines.select(F.col("l_orderkey").alias("sample"), F.struct(pos.alias("pos"), fragment.alias("fragment"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("lever"), F.col("l_tax").alias("validity")).alias("line"))
    grouped = gathered.groupBy("sample").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # an order's own lines
    by_price = F.array_sort(F.transform("lines", lambda x: F.struct(x["price"].alias("price"), x["pos"].alias("pos"))))
    fragments = F.transform("lines", lambda x: x["fragment"])
    ordered = F.transform(by_price, lambda x: x["pos"])
    stored = F.when(F.col("o_orderstatus") == "F", F.array_join(F.transform(ordered, lambda i: F.get(fragments, i)), ""))
    control = F.struct(stored.alias("reconstruction"), F.when(F.col("o_orderstatus") == "P", F.lit(0.5)).alias("edit_similarity"))
    iterations = F.transform("lines", lambda x: F.struct((x["pos"] + 1).alias("iteration"), x["lever"].alias("lever"), x["validity"].alias("validity")))
    rows = grouped.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("sample"))
    return rows.select(F.col("o_orderpriority").alias("run"), "sample", F.col("o_orderstatus").alias("grp"), F.array_join(fragments, "").alias("target"), fragments.alias("fragments"), ordered.alias("order"), control.alias("control"), iterations.alias("iterations"))


def written(spark, d):
    """The root of run folders with all records: one run gzipped, the others plain."""
    root = shared_folder(spark, "runs")
    rows = records(spark, d)
    R.run_sink(rows.filter("run <> '2-HIGH'"), root)
    R.run_sink(rows.filter("run = '2-HIGH'"), root, "gzip")
    return root


@query(f"WITH {RECORDS} SELECT run, sample, grp, n::INTEGER AS n, md5(target) AS target_md5, array_to_string(ord, ',') AS ord FROM rec")
def io5_samples_scan(spark, d):
    """Write run folders and scan them again, gzipped ones too."""
    rows = R.samples_scan(spark, written(spark, d))
    return rows.select("run", "sample", "grp", F.size("fragments").alias("n"), F.md5("target").alias("target_md5"), F.concat_ws(",", F.col("order").cast("array<string>")).alias("ord"))


@query(f"WITH {RECORDS} SELECT DISTINCT run FROM rec")
def io6_discover_runs(spark, d):
    return R.discover_runs(spark, written(spark, d))


@query(f"WITH {RECORDS} SELECT run, CASE WHEN run IN ('4-NOT SPECIFIED', '5-LOW') THEN 5 ELSE length(run) END AS beam_width, CASE WHEN run = '1-URGENT' THEN 7 ELSE 3 END AS patience FROM rec GROUP BY run")
def io7_run_config_scan(spark, d):
    """Settings of each run: two runs have no snapshot, and only one sets the patience."""
    root = written(spark, d)
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run")).distinct().filter("run not in ('4-NOT SPECIFIED', '5-LOW')")
    R.config_sink(names.select("run", F.length("run").alias("beam_width"), F.when(F.col("run") == "1-URGENT", 7).alias("patience")), root)
    return R.run_config_scan(spark, root, "beam_width int, patience int", {"beam_width": 5, "patience": 3})


@query(f"WITH {RECORDS} SELECT run, count(*) AS n, count(*) FILTER (grp = 'F' AND made = target) AS exact, sum(n)::BIGINT AS fragments FROM rec GROUP BY run")
def io8_run_sink(spark, d):
    """The summary that the sink writes beside the records."""
    return spark.read.schema("run string, n long, exact long, fragments long").json(f"{written(spark, d)}/summary")


@query(f"WITH {RECORDS} SELECT run, sample, ord[1]::INTEGER AS first, len(ord)::INTEGER AS places, n::INTEGER AS n_fragments FROM rec")
def io11_load_run_samples(spark, d):
    """Orders that were stored as a list in a string with quotes."""
    text = F.concat(F.lit("['"), F.array_join(F.col("order").cast("array<string>"), "', '"), F.lit("']"))
    rows = R.load_run_samples(R.samples_scan(spark, written(spark, d)).withColumn("order", text))
    return rows.select("run", "sample", F.get("order", F.lit(0)).alias("first"), F.size("order").alias("places"), "n_fragments")


@query(f"WITH {RECORDS} SELECT sample, CASE grp WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS replicas, CASE WHEN grp IN ('O', 'F') THEN n ELSE 0 END AS fragments FROM rec")
def pf10_normalize_fragment_samples(spark, d):
    """Stored replicas for one status, a flat list for another, neither for the third."""
    flat = F.when(F.col("grp") != "P", F.col("fragments"))
    replicas = R.normalize_fragment_samples(flat, F.when(F.col("grp") == "F", F.array("fragments", F.reverse("fragments"))))
    rows = records(spark, d).select("sample", replicas.alias("r"))
    return rows.select("sample", F.size("r").alias("replicas"), F.coalesce(F.size(F.get("r", F.lit(0))), F.lit(0)).cast("long").alias("fragments"))


BIN = "CASE WHEN n < 2 THEN '<2' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' ELSE '50+' END"
ROWS = f"""{RECORDS}, adj AS (SELECT sample, avg((b = a + 1)::INTEGER) AS adjacent FROM (SELECT sample, pos AS a, lead(pos) OVER (PARTITION BY sample ORDER BY place) AS b FROM placed) WHERE b IS NOT NULL GROUP BY sample),
it AS (SELECT sample, count(*) AS iterations, max(validity) AS best_validity, arg_min(pos, (-validity, pos)) + 1 AS best_iteration, arg_min(validity, pos) AS first FROM placed GROUP BY sample),
flat AS MATERIALIZED (SELECT run, sample, grp, n, {BIN} AS bin, (made = target)::INTEGER::DOUBLE AS exact, adjacent, iterations, best_iteration, best_validity, best_validity - first AS gain FROM rec JOIN it USING (sample) LEFT JOIN adj USING (sample))"""


@query(f"WITH {ROWS} SELECT run, sample, grp, n::INTEGER AS n, bin, exact, {R6.format('adjacent')} AS adjacent, iterations::INTEGER AS iterations, best_iteration::INTEGER AS best_iteration, best_validity, {R6.format('gain')} AS gain FROM flat")
def pf14_sample_rows(spark, d):
    rows = R.sample_rows(R.samples_scan(spark, written(spark, d)))
    return rows.withColumn("adjacent", settle("adjacent")).withColumn("gain", settle("gain"))


def _similar(made: str) -> str:
    return f"1 - levenshtein({made}, target) / greatest(length({made}), length(target))::DOUBLE"


@query(f"WITH {RECORDS} SELECT run, sample, {R6.format('CASE grp WHEN ' + chr(39) + 'P' + chr(39) + ' THEN 0.5::DOUBLE WHEN ' + chr(39) + 'F' + chr(39) + ' THEN ' + _similar('made') + ' END')} AS control, {R6.format(_similar('made'))} AS random, {R6.format('greatest(' + _similar('made') + ', ' + _similar('reversed') + ')')} AS ceiling FROM rec")
def pf15_backfill_edit_similarity(spark, d):
    rows = R.backfill_edit_similarity(R.samples_scan(spark, written(spark, d)))
    return rows.select("run", "sample", settle("control_similarity").alias("control"), settle("random_similarity").alias("random"), settle("ceiling_similarity").alias("ceiling"))


@query(f"""WITH {ROWS}, c AS (SELECT sample, lever, lag(lever) OVER (PARTITION BY sample ORDER BY pos) AS before, pos FROM placed),
m AS (SELECT run, sum((lever <> before)::INTEGER) / count(before)::DOUBLE AS changes, count(DISTINCT lever) AS levers FROM c JOIN rec USING (sample) GROUP BY run)
SELECT run, count(*) AS samples, {R6.format('avg(iterations)')} AS mean_iterations, {R6.format('avg(best_iteration)')} AS mean_best, count(*) FILTER (gain > 0) AS improved, {R6.format('any_value(changes)')} AS changes, any_value(levers) AS levers FROM flat JOIN m USING (run) GROUP BY run""")
def a15_iteration_behaviour(spark, d):
    rows = R.iteration_behaviour(R.samples_scan(spark, written(spark, d)))
    return rows.select("run", "samples", settle("mean_iterations").alias("mean_iterations"), settle("mean_best").alias("mean_best"), "improved", settle("changes").alias("changes"), "levers")


@query("WITH c AS (SELECT l_linenumber AS combo, CASE WHEN l_linenumber > 2 THEN l_linenumber * 2 END AS beam_width, CASE WHEN l_linenumber < 5 THEN l_linenumber + 10 END AS max_iterations FROM (SELECT DISTINCT l_linenumber FROM lineitem)) SELECT combo, coalesce(beam_width, 5) AS beam_width, coalesce(max_iterations, 20) AS max_iterations, coalesce(max_iterations, 20) AS early_stop_patience FROM c")
def j14_combo_overrides(spark, d):
    n = F.col("l_linenumber")
    combos = table(spark, d, "lineitem").select("l_linenumber").distinct().select(n.alias("combo"), F.when(n > 2, n * 2).alias("beam_width"), F.when(n < 5, n + 10).alias("max_iterations"))
    return combo_overrides(combos, {"beam_width": 5, "max_iterations": 20})


@query(f"""WITH {LONG}, {BIN_GRID}, g AS (SELECT * FROM (SELECT DISTINCT run FROM arms) CROSS JOIN bins CROSS JOIN (SELECT unnest(['baseline', 'control', 'selected', 'ceiling']) AS arm)),
v AS (SELECT l.run, l.bin, l.arm, count(l.value) AS n, avg(l.value) AS mean, avg(l.value - a.baseline) AS lift FROM long l JOIN arms a ON a.run = l.run AND a.sample = l.sample GROUP BY ALL)
SELECT run, bin, arm, coalesce(n, 0) AS n, {R6.format('mean')} AS mean, CASE WHEN arm <> 'baseline' THEN {R6.format('lift')} END AS lift FROM g LEFT JOIN v USING (run, bin, arm)""")
def a21_stratified_rows(spark, d):
    """Every run, bin and arm, empty ones too; the lift over the baseline of the same samples, none for the baseline itself."""
    rows = arms(spark, d)
    stacked = rows.select("run", "bin", "baseline", F.expr("stack(4, 'baseline', baseline, 'control', control, 'selected', selected, 'ceiling', ceiling) as (arm, value)"))
    found = stacked.groupBy("run", "bin", "arm").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value") - F.col("baseline")).alias("lift"))
    bins, names = (F.explode(F.array(*map(F.lit, x))) for x in (["2-4", "5-9", "10-19", "20-49", "50+"], ["baseline", "control", "selected", "ceiling"]))
    grid = rows.select("run").distinct().select("run", bins.alias("bin")).select("run", "bin", names.alias("arm"))
    lift = F.when(F.col("arm") != "baseline", settle("lift"))
    return grid.join(found, ["run", "bin", "arm"], "left").select("run", "bin", "arm", F.coalesce("n", F.lit(0)).alias("n"), settle("mean").alias("mean"), lift.alias("lift"))


@query(f"WITH {ARMS} SELECT run, count(*) AS n, {', '.join(f'{R6.format(f"avg({c})")} AS {c}' for c in ('baseline', 'control', 'selected', 'ceiling'))}, {R6.format('avg(ceiling - selected)')} AS gap FROM arms GROUP BY run")
def a22_cross_run_matrix(spark, d):
    """The headline means, a row a run."""
    means = long(spark, d).groupBy("run").pivot("arm", ["baseline", "control", "selected", "ceiling"]).agg(settle(A.nanmean(F.col("value"))))
    return means.join(arms(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), settle(F.avg(F.col("ceiling") - F.col("selected"))).alias("gap")), "run")


@query(f"""WITH {ARMS}, g AS (SELECT run, {R6.format('selected - baseline')} AS gain FROM arms WHERE baseline IS NOT NULL), e AS (SELECT run, min(gain) AS lo, max(gain) AS hi, least(20, greatest(6, count(*) // 5)) AS bins FROM g GROUP BY run),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1e-6 END AS width FROM e), p AS (SELECT run, least(floor((gain - lo) / width), bins - 1)::BIGINT AS bin, count(*) AS c FROM g JOIN w USING (run) GROUP BY ALL),
b AS (SELECT run, lo, width, unnest(range(0, bins)) AS bin FROM w) SELECT run, bin, {R6.format('lo + bin * width')} AS low, coalesce(c, 0) AS count FROM b LEFT JOIN p USING (run, bin)""")
def a32_gain_histogram(spark, d):
    """Gains over the baseline in min(20, max(6, n // 5)) bins of each run."""
    gains = arms(spark, d).filter("baseline is not null").select("run", settle(F.col("selected") - F.col("baseline")).alias("gain"))
    return A.gain_histogram(gains, ["run"], "gain").select("run", "bin", settle("low").alias("low"), "count")


@query(f"WITH {ARMS} SELECT grp, count(*) AS n, {R6.format('avg(control)')} AS control, {R6.format('avg(selected)')} AS selected, {R6.format('avg(selected) - avg(control)')} AS difference FROM arms GROUP BY grp")
def a38_arm_pair_means(spark, d):
    """The control arm's and the selected arm's mean for each group."""
    means = arms(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), A.nanmean(F.col("control")).alias("c"), A.nanmean(F.col("selected")).alias("s"))
    return means.select("grp", "n", settle("c").alias("control"), settle("s").alias("selected"), settle(F.col("s") - F.col("c")).alias("difference"))


COMPARISONS = [("selected_vs_control", "selected", "control"), ("selected_vs_baseline", "selected", "baseline"), ("ceiling_vs_selected", "ceiling", "selected")]
TESTS = f"""{ARMS}, pairs AS MATERIALIZED ({' UNION ALL '.join(f"SELECT run, '{name}' AS comparison, {a} AS a, {b} AS b FROM arms WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for name, a, b in COMPARISONS)}),
keyed AS (SELECT run || '/' || comparison AS k, a, b FROM pairs), {RAW_W.format(by='k', a='a', b='b', source='keyed')},
mc AS (SELECT run || '/' || comparison AS k, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS n, least(count(*) FILTER (a >= 0.5 AND b < 0.5), count(*) FILTER (a < 0.5 AND b >= 0.5)) AS m FROM pairs GROUP BY ALL),
tests AS (SELECT k, 'exact' AS metric, 'mcnemar' AS test, n, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE {R6.format('least(1, 2 * list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))))')} END AS p FROM mc
UNION ALL SELECT k, 'value', 'wilcoxon', n_nonzero, {R6.format('least(1, 2 * (1 - (' + phi('z') + ')))')} FROM z),
q AS (SELECT split_part(k, '/', 1) AS run, split_part(k, '/', 2) AS comparison, metric, test, n, p FROM tests), {HOLM.format(f='run', src='q')}"""


def compared(spark, d):
    # Both tests read all comparisons: the orders are grouped once, and a comparison is a projection of them.
    rows = once(arms(spark, d), "arms")
    sides = F.array(*(F.struct(F.lit(name).alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for name, a, b in COMPARISONS))
    every = rows.select("run", F.explode(sides).alias("x")).select("run", "x.*").filter("a is not null and b is not null")
    met = lambda c: (F.col(c) >= 0.5).cast("double").alias(c)
    metrics = every.select("run", "comparison", F.lit("value").alias("metric"), "a", "b").union(every.select("run", "comparison", F.lit("exact").alias("metric"), met("a"), met("b")))
    return T.compare_arms(metrics, ["run"], ["exact"])


@query(f"WITH {TESTS} SELECT run, comparison, metric, test, n, p, {R6.format('p_holm')} AS p_holm, p_holm <= 0.05 AS reject FROM h")
def a20_tests_rows(spark, d):
    """Every run, comparison and metric with its test, Holm over a run."""
    return compared(spark, d).select("run", "comparison", "metric", "test", "n", "p", settle("p_holm").alias("p_holm"), "reject")


@query(f"WITH {TESTS} SELECT comparison, metric, count(*) AS runs, count(*) FILTER (p_holm <= 0.05) AS rejected, {R6.format('min(p_holm)')} AS least_p FROM h GROUP BY ALL")
def t17_significance_records(spark, d):
    """How many runs each comparison and metric is significant in."""
    found = compared(spark, d).groupBy("comparison", "metric")
    return found.agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("reject"), 1)).alias("rejected"), settle(F.min("p_holm")).alias("least_p"))
