"""Queries on aggregations over samples and arms. A sample is an order; its lines give the arms' values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweave.functions import stats as T
from sparkweave.functions.rounding import settle
from sparkweave.operators import metrics as M
from sparkweave.operators import reports as A
from sparkweave.operators.ranges import order_statistics
from sparkweave.queries.base import query
from sparkweave.queries.metric_queries import KIND, SAMPLE, samples
from sparkweave.sources.sequences import table

R6 = "round({} + 1e-10::DOUBLE, 6)"

#: One row a sample: its run, fragments, bin, and the values of the arms; a sample of one line has no baseline.
ARMS = f"""o AS (SELECT l_orderkey AS sample, count(*) AS n, avg(l_discount) AS d, avg(l_tax) AS t, max(l_quantity) AS q, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1),
arms AS MATERIALIZED (SELECT o_orderpriority AS run, sample, n, CASE WHEN n < 2 THEN '<2' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' ELSE '50+' END AS bin,
CASE WHEN n > 1 THEN {R6.format('d * 10')} END AS baseline, {R6.format('t * 12.5')} AS control, {R6.format('(d * 10 + t * 12.5 + q / 50) / 3')} AS selected, {R6.format('greatest(d * 10, t * 12.5, q / 50)')} AS ceiling, cost, o_orderstatus AS grp FROM o JOIN orders ON o_orderkey = sample)"""


def arms(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.max("l_quantity").alias("q"), F.sum("l_extendedprice").alias("cost"))
    rows = o.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("sample"))
    base, control, q = F.col("d") * 10, F.col("t") * 12.5, F.col("q") / 50
    return rows.select(
        F.col("o_orderpriority").alias("run"), "sample", "n", M.fragment_bin(F.col("n")).alias("bin"), F.when(F.col("n") > 1, settle(base)).alias("baseline"), settle(control).alias("control"),
        settle((base + control + q) / 3).alias("selected"), settle(F.greatest(base, control, q)).alias("ceiling"), "cost", F.col("o_orderstatus").alias("grp"),
    )


ARM_NAMES = ["baseline", "control", "selected", "ceiling"]
LONG = ARMS + ", long AS MATERIALIZED (SELECT run, sample, n, bin, grp, unnest(['baseline', 'control', 'selected', 'ceiling']) AS arm, unnest([baseline, control, selected, ceiling]) AS value FROM arms)"


def long(spark, d):
    return arms(spark, d).select("run", "sample", "n", "bin", "grp", F.expr("stack(4, 'baseline', baseline, 'control', control, 'selected', selected, 'ceiling', ceiling) as (arm, value)"))


@query(f"WITH {LONG} SELECT run, arm, {R6.format('avg(value)')} AS mean FROM long GROUP BY ALL")
def a1_nanmean(spark, d):
    return long(spark, d).groupBy("run", "arm").agg(settle(A.nanmean(F.col("value"))).alias("mean"))


@query(f"SELECT lang, count(n_chars) AS n, {R6.format('avg(n_chars)')} AS mean, {R6.format('median(n_chars)')} AS median, {R6.format('stddev_samp(n_chars)')} AS sd, min(n_chars) AS min, max(n_chars) AS max FROM documents GROUP BY lang")
def a2_describe_group(spark, d):
    g = A.describe_group(table(spark, d, "documents"), ["lang"], "n_chars")
    return g.select("lang", "n", settle("mean").alias("mean"), settle("median").alias("median"), settle("sd").alias("sd"), "min", "max")


def _stats(rows, by):
    s = A.distribution_stats(rows, by, "value")
    return s.select(*by, "n", *(settle(c).alias(c) for c in ("mean", "sd", "min", "p25", "median", "p75", "max")))


STATS = f"count(value) AS n, {R6.format('avg(value)')} AS mean, {R6.format('stddev_pop(value)')} AS sd, {R6.format('min(value)')} AS min, {R6.format('quantile_cont(value, 0.25)')} AS p25, {R6.format('quantile_cont(value, 0.5)')} AS median, {R6.format('quantile_cont(value, 0.75)')} AS p75, {R6.format('max(value)')} AS max"


@query(f"WITH {LONG} SELECT run, arm, {STATS} FROM long GROUP BY ALL")
def a3_distribution_stats(spark, d):
    return _stats(long(spark, d), ["run", "arm"])


@query(f"WITH {LONG} SELECT run, arm, count(*) FILTER (value >= 1) AS successes, count(value) AS n FROM long GROUP BY ALL")
def a4_exact_match_count(spark, d):
    return long(spark, d).groupBy("run", "arm").agg(F.count(F.when(F.col("value") >= 1, 1)).alias("successes"), F.count("value").alias("n"))


BIN_GRID = "bins AS (SELECT unnest(['2-4', '5-9', '10-19', '20-49', '50+']) AS bin)"


@query(f"WITH {LONG}, {BIN_GRID}, c AS (SELECT run, bin, count(*) AS n, count(baseline) AS usable, avg(baseline) AS mean FROM arms GROUP BY ALL) SELECT run, bin, coalesce(n, 0) AS n, coalesce(usable, 0) AS usable, {R6.format('mean')} AS mean FROM (SELECT DISTINCT run FROM arms) CROSS JOIN bins LEFT JOIN c USING (run, bin)")
def a5_stratify_by_bin(spark, d):
    return A.stratify_by_bin(arms(spark, d), ["run"], "baseline").select("run", "bin", "n", "usable", settle("mean").alias("mean"))


LIFT = "SELECT run, bin, count(*) AS n, count(baseline) AS n_usable, {am} AS arm_mean, {bm} AS baseline_mean, {l} AS lift FROM arms GROUP BY ALL".format(am=R6.format("avg(selected) FILTER (baseline IS NOT NULL)"), bm=R6.format("avg(baseline)"), l=R6.format("avg(selected - baseline)"))


@query(f"WITH {ARMS}, {BIN_GRID}, l AS ({LIFT}), g AS (SELECT DISTINCT run, b.bin FROM arms CROSS JOIN bins b) SELECT run, bin, coalesce(n, 0) AS n, coalesce(n_usable, 0) AS n_usable, arm_mean, baseline_mean, lift FROM g FULL JOIN l USING (run, bin)")
def a6_lift_over_baseline(spark, d):
    x = A.lift_over_baseline(arms(spark, d), ["run"], "selected", "baseline")
    return x.select("run", "bin", "n", "n_usable", settle("arm_mean").alias("arm_mean"), settle("baseline_mean").alias("baseline_mean"), settle("lift").alias("lift"))


KINDS = ["exact", "unknown", "block_reversal", "full_scramble", "local_transposition", "wrong_start", "partial_assembly"]


@query(f"WITH {SAMPLE}, k AS (SELECT grp, {KIND} AS kind, count(*) AS c FROM sample GROUP BY ALL), g AS (SELECT DISTINCT grp FROM sample), ks AS (SELECT unnest({KINDS}) AS kind), j AS (SELECT g.grp, ks.kind, coalesce(c, 0) AS count FROM g CROSS JOIN ks LEFT JOIN k ON k.grp = g.grp AND k.kind = ks.kind) SELECT grp, kind, count, {R6.format('count / sum(count) OVER (PARTITION BY grp)')} AS share FROM j")
def a7_taxonomy_counts(spark, d):
    s = samples(spark, d).withColumn("kind", M.classify_error(*(F.col(c) for c in ("em", "apa", "lcr", "tau", "n", "start_ok"))))
    return A.counts_with_zeros(s, ["grp"], "kind", KINDS).select("grp", "kind", "count", settle("share").alias("share"))


@query(f"WITH {SAMPLE} SELECT grp, count(*) AS n, {R6.format('avg(start_ok::INTEGER)')} AS p_start, {R6.format('avg(em) FILTER (start_ok)')} AS exact_if_right, {R6.format('avg(em) FILTER (NOT start_ok)')} AS exact_if_wrong, {R6.format('avg(1.0::DOUBLE / n)')} AS p_shuffled, count(*) FILTER (start_ok) AS n_right, count(*) FILTER (NOT start_ok) AS n_wrong, count(*) FILTER (em = 1) AS hits FROM sample GROUP BY grp")
def a8_nterm_analysis(spark, d):
    ok = F.col("start_ok")
    return samples(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), settle(F.avg(ok.cast("double"))).alias("p_start"), settle(F.avg(F.when(ok, F.col("em")))).alias("exact_if_right"), settle(F.avg(F.when(~ok, F.col("em")))).alias("exact_if_wrong"), settle(F.avg(1 / F.col("n"))).alias("p_shuffled"), F.count(F.when(ok, 1)).alias("n_right"), F.count(F.when(~ok, 1)).alias("n_wrong"), F.count(F.when(F.col("em") == 1, 1)).alias("hits"))


@query(f"WITH {SAMPLE}, b AS (SELECT grp, {R6.format('(n - 1) * (1 - apa)')} AS b, 1 - apa AS x FROM sample WHERE n >= 2) SELECT grp, count(*) AS n, {R6.format('avg(b)')} AS mean, list_sort(list(b))[count(*) // 2 + 1] AS median, min(b) AS min, max(b) AS max, {R6.format('avg(x)')} AS normalised, count(*) FILTER (b < 0.5) AS zeros FROM b GROUP BY grp")
def a9_breakpoint_stats(spark, d):
    s = samples(spark, d).filter("n >= 2").withColumn("b", settle(M.breakpoints(F.col("n"), F.col("apa"))))
    # The upper of the middle two.
    middle = order_statistics(s, ["grp"], "b", {"median": F.floor(F.col("n") / 2)}).drop("n")
    out = s.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), settle(F.avg("b")).alias("mean"), F.min("b").alias("min"), F.max("b").alias("max"), settle(F.avg(1 - F.col("apa"))).alias("normalised"), F.count(F.when(F.col("b") < 0.5, 1)).alias("zeros"))
    return out.join(middle, "grp")


@query(f"""WITH c AS (SELECT user_id AS sample, value AS validity, extract(hour FROM ts) AS quality FROM events), p AS (SELECT a.sample, a.quality > b.quality AS good FROM c a JOIN c b ON a.sample = b.sample AND a.validity < b.validity AND a.quality <> b.quality),
s AS (SELECT sample, count(*) AS pairs, avg(good::INTEGER) AS x FROM p GROUP BY sample) SELECT count(*) AS n, {R6.format('avg(x)')} AS mean, sum(pairs)::BIGINT AS pairs, count(*) FILTER (x > 0.5) AS above FROM s""")
def a10_concordance_summary(spark, d):
    c = M.rank_concordance(table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("value").alias("validity"), F.hour("ts").alias("quality")))
    return c.agg(F.count(F.lit(1)).alias("n"), settle(F.avg("concordance")).alias("mean"), F.sum("pairs").alias("pairs"), F.count(F.when(F.col("concordance") > 0.5, 1)).alias("above"))


@query(f"WITH {ARMS} SELECT run, count(*) AS n, {R6.format('avg(ceiling - selected)')} AS mean_gap, count(*) FILTER (ceiling - selected > 1e-12) AS n_gap FROM arms GROUP BY run")
def a11_ceiling_gap(spark, d):
    return A.ceiling_gap(arms(spark, d), ["run"], "ceiling", "selected").select("run", "n", settle("mean_gap").alias("mean_gap"), "n_gap")


@query(f"""WITH {ARMS} SELECT run, count(*) AS n, round(sum(coalesce(cost, 0)) + 1e-6::DOUBLE, 2) AS total, round(sum(coalesce(cost, 0)) / count(*) + 1e-6::DOUBLE, 2) AS mean_cost, {R6.format('sum(coalesce(baseline, 0)) / count(*)')} AS mean_baseline,
count(*) FILTER (baseline IS NULL) AS failures, count(baseline) AS completed, count(*) FILTER (baseline IS NULL AND selected IS NOT NULL) AS recovered FROM arms GROUP BY run""")
def a12_cost_summary(spark, d):
    """Totals and means over all samples (null is 0); a sample without a baseline failed, and recovered if another arm has a value."""
    missing, n = F.col("baseline").isNull(), F.count(F.lit(1))
    cost = F.sum(F.coalesce("cost", F.lit(0.0)))
    return arms(spark, d).groupBy("run").agg(
        n.alias("n"), settle(cost, 2).alias("total"), settle(cost / n, 2).alias("mean_cost"), settle(F.sum(F.coalesce("baseline", F.lit(0.0))) / n).alias("mean_baseline"),
        F.count(F.when(missing, 1)).alias("failures"), F.count("baseline").alias("completed"), F.count(F.when(missing & F.col("selected").isNotNull(), 1)).alias("recovered"),
    )


@query(f"WITH {LONG} SELECT arm, {R6.format('avg(value)')} AS mean, {R6.format('avg(value) - (SELECT avg(baseline) FROM arms)')} AS delta FROM long GROUP BY arm")
def a17_run_averages(spark, d):
    means = long(spark, d).groupBy("arm").agg(F.avg("value").alias("m"))
    base = means.filter("arm = 'baseline'").select(F.col("m").alias("b"))
    return means.join(F.broadcast(base)).select("arm", settle("m").alias("mean"), settle(F.col("m") - F.col("b")).alias("delta"))


Z = "1.959963984540054::DOUBLE"
BOUND = "(k / n + {z} * {z} / (2 * n) {s} {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"


@query(f"""WITH {LONG}, c AS (SELECT run, arm, count(*) FILTER (value >= 0.5)::DOUBLE AS k, count(value)::DOUBLE AS n, avg(value) AS point FROM long GROUP BY ALL)
SELECT run, arm, n::BIGINT AS n, {R6.format('point')} AS point, {R6.format('k / n')} AS share, {R6.format('CASE WHEN k = 0 THEN 0 ELSE ' + BOUND.format(z=Z, s='-') + ' END')} AS ci_low, {R6.format('CASE WHEN k = n THEN 1 ELSE ' + BOUND.format(z=Z, s='+') + ' END')} AS ci_high, 'wilson' AS method FROM c""")
def a18_arm_summary(spark, d):
    """Mean of each arm, and the share of values of one half or more with its interval."""
    c = long(spark, d).groupBy("run", "arm").agg(F.count(F.when(F.col("value") >= 0.5, 1)).alias("k"), F.count("value").alias("n"), F.avg("value").alias("point"))
    low, high = T.wilson_interval(F.col("k"), F.col("n"))
    return c.select("run", "arm", "n", settle("point").alias("point"), settle(F.col("k") / F.col("n")).alias("share"), settle(low).alias("ci_low"), settle(high).alias("ci_high"), F.lit("wilson").alias("method"))


@query(f"WITH {ARMS} SELECT run, count(*) AS n, " + ", ".join(f"{R6.format(f'avg({a})')} AS {a}" for a in ("baseline", "control", "selected", "ceiling")) + " FROM arms GROUP BY run")
def a19_overview_row(spark, d):
    wide = long(spark, d).groupBy("run").pivot("arm", ARM_NAMES).agg(F.avg("value"))
    sizes = arms(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return wide.join(sizes, "run").select("run", "n", *(settle(a).alias(a) for a in ARM_NAMES))


@query(f"WITH {LONG} SELECT bin, " + ", ".join(f"{R6.format(f'''avg(value) FILTER (grp = '{g}')''')} AS {g.lower()}" for g in "FOP") + " FROM long WHERE arm = 'selected' GROUP BY bin")
def a23_group_by_bin(spark, d):
    p = long(spark, d).filter("arm = 'selected'").groupBy("bin").pivot("grp", ["F", "O", "P"]).agg(F.avg("value"))
    return p.select("bin", *(settle(g).alias(g.lower()) for g in "FOP"))


@query(f"WITH {ARMS}, m AS (SELECT run, quantile_cont(cost, 0.5) AS m, count(*) AS n FROM arms GROUP BY run) SELECT run, any_value(m.n) AS n, {R6.format('avg(selected) FILTER (cost <= m)')} AS low_mean, {R6.format('avg(selected) FILTER (cost > m)')} AS high_mean, {R6.format('avg(selected) FILTER (cost <= m) - avg(selected) FILTER (cost > m)')} AS difference FROM arms JOIN m USING (run) GROUP BY run")
def a25_median_split(spark, d):
    m = A.median_split(arms(spark, d).select("run", "cost", "selected"), ["run"], "cost", "selected")
    return m.select("run", "n", *(settle(c).alias(c) for c in ("low_mean", "high_mean", "difference")))


@query(f"WITH {ARMS} SELECT {R6.format('''avg(selected) FILTER (grp = 'F') - avg(selected) FILTER (grp = 'O')''')} AS gap, {R6.format('''100 * (avg(selected) FILTER (grp = 'F') - avg(selected) FILTER (grp = 'O')) / avg(selected) FILTER (grp = 'O')''')} AS relative FROM arms")
def a27_raw_and_relative_gap(spark, d):
    of = lambda g: F.avg(F.when(F.col("grp") == g, F.col("selected")))
    return arms(spark, d).agg(of("F").alias("f"), of("O").alias("o")).select(settle(F.col("f") - F.col("o")).alias("gap"), settle(100 * (F.col("f") - F.col("o")) / F.col("o")).alias("relative"))


@query(f"SELECT lang, {R6.format('count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id)::DOUBLE')} AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def a28_pool_coverage(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select(F.col("doc_id").alias("labelled")), F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("lang").agg(settle(F.countDistinct("labelled") / F.countDistinct("doc_id")).alias("coverage"))


@query(f"""WITH {ARMS}, c AS (SELECT run, CASE WHEN n <= 12 THEN ((ceil(n / 2.0::DOUBLE) - 1) * 2)::BIGINT END AS low, count(*) AS n, {R6.format('avg(baseline)')} AS mean FROM arms GROUP BY ALL),
g AS (SELECT run, unnest([0, 2, 4, 6, 8, 10, NULL]::BIGINT[]) AS low FROM (SELECT DISTINCT run FROM arms)) SELECT g.run, g.low, coalesce(n, 0) AS n, mean FROM g LEFT JOIN c ON c.run = g.run AND c.low IS NOT DISTINCT FROM g.low""")
def a29_binned_metric_means(spark, d):
    return A.binned_means(arms(spark, d).withColumnRenamed("n", "frags"), ["run"], "frags", "baseline", 2, 12).select("run", "low", "n", settle("mean").alias("mean"))


HIST = "e AS (SELECT run, min(value) AS lo, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / {n} ELSE 1e-6 END AS width FROM {src} WHERE value IS NOT NULL GROUP BY run), c AS (SELECT run, least(floor((value - lo) / width), {n} - 1)::BIGINT AS bin, count(*) AS c FROM {src} JOIN e USING (run) WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"WITH {ARMS}, v AS (SELECT run, selected AS value FROM arms), {HIST.format(n=15, src='v')} SELECT run, b.range AS bin, {R6.format('lo + b.range * width')} AS low, coalesce(c, 0) AS count FROM e CROSS JOIN range(15) b LEFT JOIN c ON c.run = e.run AND c.bin = b.range".replace("SELECT run, b.range", "SELECT e.run, b.range"))
def a30_histogram(spark, d):
    h = A.histogram(arms(spark, d), ["run"], "selected", 15)
    return h.select("run", "bin", settle("low").alias("low"), "count")


@query(f"WITH {ARMS}, g AS (SELECT run, {R6.format('selected - control')} AS value FROM arms) SELECT run, {STATS} FROM g GROUP BY run")
def a34_gain_distribution(spark, d):
    return _stats(arms(spark, d).select("run", settle(F.col("selected") - F.col("control")).alias("value")), ["run"])


@query(f"WITH {ARMS} SELECT run, {R6.format('avg(control)')} AS control_mean, {R6.format('avg(selected)')} AS selected_mean, count(*) FILTER (selected > control) AS better, count(*) FILTER (selected < control) AS worse, count(*) FILTER (selected = control) AS same FROM arms GROUP BY run")
def a35_benchmark_rows(spark, d):
    s, c = F.col("selected"), F.col("control")
    return arms(spark, d).groupBy("run").agg(settle(F.avg(c)).alias("control_mean"), settle(F.avg(s)).alias("selected_mean"), F.count(F.when(s > c, 1)).alias("better"), F.count(F.when(s < c, 1)).alias("worse"), F.count(F.when(s == c, 1)).alias("same"))


@query("SELECT l_returnflag AS run, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS line_numbers FROM lineitem GROUP BY 1")
def a37_distinct_config(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("line_numbers"))


@query("WITH c AS (SELECT l_orderkey AS sample, l_linenumber AS iteration, min(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS best FROM lineitem) SELECT iteration, round(avg(best) + 1e-6::DOUBLE, 2) AS mean, min(best) AS min, max(best) AS max FROM c GROUP BY iteration")
def a33_iteration_band(spark, d):
    best = F.min("l_extendedprice").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("iteration"), best.alias("best"))
    return rows.groupBy("iteration").agg(settle(F.avg("best"), 2).alias("mean"), F.min("best").alias("min"), F.max("best").alias("max"))


@query(f"WITH {LONG}, s AS (SELECT *, CASE arm WHEN 'baseline' THEN 0 WHEN 'control' THEN 1 WHEN 'selected' THEN 2 ELSE 3 END AS k FROM (SELECT run, arm, avg(value) AS m FROM long GROUP BY ALL)) SELECT run, arm, {R6.format('m - lag(m) OVER (PARTITION BY run ORDER BY k)')} AS step FROM s")
def w3_ladder_step(spark, d):
    means = long(spark, d).groupBy("run", "arm").agg(F.avg("value").alias("m"))
    place = F.array_position(F.array(*map(F.lit, ARM_NAMES)), F.col("arm"))
    return means.select("run", "arm", settle(F.col("m") - F.lag("m").over(Window.partitionBy("run").orderBy(place))).alias("step"))


@query(f"WITH {SAMPLE}, k AS (SELECT grp, {KIND} AS kind, count(*) AS c FROM sample GROUP BY ALL) SELECT grp, kind, {R6.format('sum(c) OVER (PARTITION BY grp ORDER BY kind ROWS UNBOUNDED PRECEDING) / sum(c) OVER (PARTITION BY grp)::DOUBLE')} AS cumulative FROM k")
def w8_cumulative_share(spark, d):
    s = samples(spark, d).withColumn("kind", M.classify_error(*(F.col(c) for c in ("em", "apa", "lcr", "tau", "n", "start_ok"))))
    c = s.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(Window.partitionBy("grp").orderBy("kind").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("grp", "kind", settle(run / F.sum("c").over(Window.partitionBy("grp"))).alias("cumulative"))


@query(f"WITH {ARMS} SELECT a.run, a.sample, {R6.format('selected - control')} AS vs_control, {R6.format('selected - baseline')} AS vs_baseline FROM arms a")
def m18_gains(spark, d):
    return arms(spark, d).select("run", "sample", settle(F.col("selected") - F.col("control")).alias("vs_control"), settle(F.col("selected") - F.col("baseline")).alias("vs_baseline"))


@query(f"WITH {LONG} SELECT a.run, a.sample, a.value AS a, b.value AS b FROM long a JOIN long b USING (run, sample) WHERE a.arm = 'selected' AND b.arm = 'baseline' AND b.value IS NOT NULL")
def j10_pair_runs(spark, d):
    rows = long(spark, d)
    a, b = rows.filter("arm = 'selected'").select("run", "sample", F.col("value").alias("a")), rows.filter("arm = 'baseline' and value is not null").select("run", "sample", F.col("value").alias("b"))
    return a.join(b, ["run", "sample"])
