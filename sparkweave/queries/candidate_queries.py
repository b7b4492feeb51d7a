"""Queries on candidates, arms and their reports. A run is a language, a sample a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.functions.rounding import settle
from sparkweave.operators import candidates as K
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import scoring as C
from sparkweave.operators import search as O
from sparkweave.operators import segment as S
from sparkweave.queries.base import DRAW, IMPOSSIBLE, query
from sparkweave.queries.fragments import PAIRS, cut_sequences, seqs
from sparkweave.queries.searches import BACKOFF, MODEL
from sparkweave.sources import records as R
from sparkweave.sources import sequences as Q

R6 = "round({} + 1e-10::DOUBLE, 6)"

WINDOWS, VALIDITY_WINDOW = (1, 3, 5), 5
SETTINGS = [
    {"combo": "a", "window": 1, "mode": "greedy", "width": 25, "edges": "hard", "bonus": 0.0},
    {"combo": "b", "window": 3, "mode": "greedy", "width": 25, "edges": "soft", "bonus": 0.5},
    {"combo": "c", "window": 3, "mode": "beam", "width": 3, "edges": "hard", "bonus": 0.0},
    {"combo": "d", "window": 1, "mode": "beam", "width": 3, "edges": "soft", "bonus": 0.5},
]
#: The guided arm tries these in this order; the control arm starts with the first and draws the others.
GUIDED, DRAWN = ("a", "b", "c"), 3

_LEVERS = ", ".join(f"('{s['combo']}', {s['window']}, {s['mode'] == 'beam'}, {s['width']}, {s['edges'] == 'soft'}, {s['bonus']}::DOUBLE)" for s in SETTINGS)

#: cand: every setting's path for each sequence; searched by recursion over all settings at once.
CAND = f"""{PAIRS}{MODEL},
combos(combo, win, beam, width, soft, bonus) AS (VALUES {_LEVERS}),
spots AS (SELECT seq_id, i, j, p, right(a || substr(b, 1, p), 2) AS context, substr(b, p + 1, 1) AS residue FROM (SELECT *, unnest(range(0, least(5, length(b)))) AS p FROM pairs)),
ms AS (SELECT t.seq_id, t.i, t.j, {R6.format(f"avg(coalesce(logp, {BACKOFF})) FILTER (p < 1)")} AS s1, {R6.format(f"avg(coalesce(logp, {BACKOFF})) FILTER (p < 3)")} AS s3, {R6.format(f"avg(coalesce(logp, {BACKOFF}))")} AS s5
  FROM spots t LEFT JOIN model m ON m.context = t.context AND m.residue = t.residue GROUP BY ALL),
mf AS MATERIALIZED (SELECT ms.*, e.i IS NOT NULL AS confirmed, {IMPOSSIBLE.format("p.a", "p.b")} AS impossible
  FROM ms JOIN pairs p USING (seq_id, i, j) LEFT JOIN edges e ON e.seq_id = ms.seq_id AND e.i = ms.i AND e.j = ms.j),
worth AS MATERIALIZED (SELECT combo, beam, width, soft, bonus, seq_id, i, j, confirmed, impossible,
  CASE WHEN confirmed THEN 1000.0::DOUBLE WHEN win = 1 THEN s1 ELSE s3 END AS score, bool_or(confirmed) OVER (PARTITION BY combo, seq_id, i) AS has FROM mf, combos),
gains AS MATERIALIZED (SELECT *, round(score + CASE WHEN confirmed AND (beam OR NOT impossible) THEN bonus ELSE 0 END, 6) AS gain FROM worth),
incoming AS (SELECT combo, seq_id, j, round(sum(score), 6) AS s FROM worth WHERE NOT beam GROUP BY ALL),
starts AS (SELECT combo, seq_id, idx FROM (SELECT c.combo, p.seq_id, p.idx, row_number() OVER (PARTITION BY c.combo, p.seq_id ORDER BY NOT starts_with(fragment, 'M'), coalesce(s, 0), p.idx) AS r
  FROM prim p CROSS JOIN combos c LEFT JOIN incoming n ON n.combo = c.combo AND n.seq_id = p.seq_id AND n.j = p.idx WHERE NOT c.beam) WHERE r = 1),
greedy(combo, seq_id, path, forced) AS (SELECT combo, seq_id, [idx], 0 FROM starts UNION ALL
  SELECT combo, seq_id, list_append(path, j), forced + impossible::INTEGER FROM (
    SELECT g.combo, g.seq_id, g.path, g.forced, f.j, f.impossible, row_number() OVER (PARTITION BY g.combo, g.seq_id ORDER BY f.impossible, -f.gain, f.j) AS r
    FROM greedy g JOIN gains f ON f.combo = g.combo AND f.seq_id = g.seq_id AND f.i = g.path[-1] AND NOT list_contains(g.path, f.j)) WHERE r = 1),
allowed AS MATERIALIZED (SELECT * FROM gains WHERE beam AND NOT impossible AND (soft OR NOT has OR confirmed)),
anym AS (SELECT seq_id, bool_or(starts_with(fragment, 'M')) AS m, count(*) AS n FROM prim GROUP BY seq_id),
beams(combo, seq_id, cost, path, r) AS (
  SELECT c.combo, p.seq_id, 0.0::DOUBLE, [idx], row_number() OVER (PARTITION BY c.combo, p.seq_id ORDER BY idx) FROM prim p JOIN anym USING (seq_id) CROSS JOIN combos c WHERE c.beam AND (starts_with(fragment, 'M') OR NOT m) UNION ALL
  SELECT combo, seq_id, cost, path, r2 FROM (SELECT b.combo, b.seq_id, f.width, round(b.cost - f.gain, 6) AS cost, list_append(b.path, f.j) AS path,
      row_number() OVER (PARTITION BY b.combo, b.seq_id ORDER BY round(b.cost - f.gain, 6), b.r, f.j) AS r2
    FROM beams b JOIN allowed f ON f.combo = b.combo AND f.seq_id = b.seq_id AND f.i = b.path[-1] AND NOT list_contains(b.path, f.j)) WHERE r2 <= width),
partial AS MATERIALIZED (SELECT combo, seq_id, arg_max(path, len(path)) AS path FROM beams WHERE r = 1 GROUP BY ALL),
finished(combo, seq_id, path) AS (SELECT * FROM partial UNION ALL SELECT combo, seq_id, list_append(path, j) FROM (
    SELECT g.combo, g.seq_id, g.path, f.j, row_number() OVER (PARTITION BY g.combo, g.seq_id ORDER BY -f.gain, f.j) AS r
    FROM finished g JOIN gains f ON f.combo = g.combo AND f.seq_id = g.seq_id AND f.i = g.path[-1] AND NOT list_contains(g.path, f.j)) WHERE r = 1),
found AS MATERIALIZED (
  SELECT combo, seq_id, arg_max(path, len(path)) AS path, arg_max(forced, len(path)) AS forced, FALSE AS fell_back, max(len(path)) AS placed FROM greedy GROUP BY ALL
  UNION ALL SELECT f.combo, f.seq_id, f.path, 0, len(p.path) < n, len(p.path) FROM (SELECT combo, seq_id, arg_max(path, len(path)) AS path FROM finished GROUP BY ALL) f JOIN partial p USING (combo, seq_id) JOIN anym USING (seq_id)),
stops AS MATERIALIZED (SELECT combo, seq_id, unnest(path) AS idx, generate_subscripts(path, 1) AS k FROM found),
links AS (SELECT combo, seq_id, idx AS i, lead(idx) OVER (PARTITION BY combo, seq_id ORDER BY k) AS j FROM stops),
judged AS (SELECT l.combo, l.seq_id, count(*) FILTER (confirmed) AS realised, avg(s5) FILTER (NOT confirmed) AS lp FROM links l JOIN mf USING (seq_id, i, j) GROUP BY ALL),
made AS (SELECT combo, s.seq_id, string_agg(fragment, '' ORDER BY k) AS reconstruction FROM stops s JOIN prim p ON p.seq_id = s.seq_id AND p.idx = s.idx GROUP BY ALL),
total AS (SELECT seq_id, count(*) AS n_edges FROM edges GROUP BY seq_id),
parts AS (SELECT combo, seq_id, path, forced, fell_back, placed, reconstruction, CASE WHEN n >= 2 THEN {R6.format("coalesce(lp, 0)")} END AS mean_lp, CASE WHEN n >= 2 AND n_edges > 0 THEN coalesce(realised, 0) / n_edges::DOUBLE END AS agreement
  FROM found JOIN made USING (combo, seq_id) JOIN anym USING (seq_id) LEFT JOIN judged USING (combo, seq_id) LEFT JOIN total USING (seq_id)),
cand AS MATERIALIZED (SELECT *, CASE WHEN mean_lp IS NULL THEN 'inf'::DOUBLE ELSE round(exp(-mean_lp) * (1 + CASE WHEN agreement IS NULL THEN 0 ELSE 0.75::DOUBLE * (1 - agreement) END), 6) END AS validity FROM parts)"""


def sequence_table(spark, d):
    """Sequences with their fragments and edges (cut_sequences); computed once in a session for the queries of this module."""

    def sequence_rows():
        return [Q.once(cut_sequences(spark, d), "sequences")]

    return Q.once_a_session(spark, f"{d}/documents.parquet", sequence_rows)[0]


def found_candidates(spark, d):
    """All candidates of all sequences; computed once in a session."""

    def candidate_tables():
        rows = sequence_table(spark, d)
        found = K.search_rows(rows, C.residue_model(rows), SETTINGS, WINDOWS, VALIDITY_WINDOW)
        return [Q.once(found.withColumn("validity_score", F.round("validity_score", 6)), "candidates")]

    return Q.once_a_session(spark, f"{d}/documents.parquet", candidate_tables)[0]


@query(f"WITH RECURSIVE {CAND} SELECT seq_id, combo, array_to_string(path, ',') AS path, forced, fell_back, placed::INTEGER AS placed, CASE WHEN isinf(validity) THEN -1 ELSE validity END AS validity, md5(reconstruction) AS reconstruction_md5 FROM cand")
def d8_candidates(spark, d):
    """Every sequence under every setting, over one table of scores."""
    c = found_candidates(spark, d)
    return c.select(
        "seq_id", "combo", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"), "forced", "fell_back", "placed",
        F.when(F.col("validity_score") == float("inf"), -1.0).otherwise(F.col("validity_score")).alias("validity"), F.md5("reconstruction").alias("reconstruction_md5"),
    )


#: armv: the metrics of every arm. Metrics are of every candidate and of the seeded order (combo random).
ARMV = f"""{CAND},
seeded AS (SELECT seq_id, idx, row_number() OVER (PARTITION BY seq_id ORDER BY md5(concat_ws('|', 7, seq_id, idx)), idx) AS k FROM prim),
orders AS MATERIALIZED (SELECT combo, seq_id, idx, k FROM stops UNION ALL SELECT 'random', seq_id, idx, k FROM seeded),
pred AS MATERIALIZED (SELECT combo, o.seq_id, k, fragment FROM orders o JOIN prim p ON p.seq_id = o.seq_id AND p.idx = o.idx),
texts AS MATERIALIZED (SELECT combo, seq_id, string_agg(fragment, '' ORDER BY k) AS reconstruction FROM pred GROUP BY ALL),
grams3 AS (
  SELECT combo, seq_id, substr(reconstruction, p, 3) AS g, 1 AS x, 0 AS y FROM (SELECT *, unnest(range(1, length(reconstruction) - 1)) AS p FROM texts)
  UNION ALL SELECT combo, seq_id, substr(seq, p, 3), 0, 1 FROM (SELECT combo, seq_id, seq, unnest(range(1, length(seq) - 1)) AS p FROM texts JOIN seqs USING (seq_id))),
gramc AS (SELECT combo, seq_id, g, sum(x) AS x, sum(y) AS y FROM grams3 GROUP BY ALL),
simv AS (SELECT combo, seq_id, 2 * sum(least(x, y)) / sum(x + y)::DOUBLE AS similarity FROM gramc GROUP BY ALL),
predp AS (SELECT combo, seq_id, fragment AS a, lead(fragment) OVER (PARTITION BY combo, seq_id ORDER BY k) AS b FROM pred),
predc AS (SELECT combo, seq_id, a, b, count(*) AS x FROM predp WHERE b IS NOT NULL GROUP BY ALL),
truep AS (SELECT seq_id, fragment AS a, lead(fragment) OVER (PARTITION BY seq_id ORDER BY idx) AS b FROM prim),
truec AS (SELECT seq_id, a, b, count(*) AS y FROM truep WHERE b IS NOT NULL GROUP BY ALL),
apav AS (SELECT combo, t.seq_id, sum(least(coalesce(x, 0), y)) / sum(y)::DOUBLE AS apa FROM (SELECT combo, c.* FROM truec c JOIN texts USING (seq_id)) t LEFT JOIN predc USING (combo, seq_id, a, b) GROUP BY ALL),
met AS (SELECT combo, q.seq_id, q.k - 1 AS p, q.k - 1 - t.idx AS d FROM pred q JOIN prim t ON t.seq_id = q.seq_id AND t.fragment = q.fragment),
islands AS (SELECT combo, seq_id, d, p - row_number() OVER (PARTITION BY combo, seq_id, d ORDER BY p) AS g FROM met),
lcrv AS (SELECT combo, seq_id, max(run) AS run FROM (SELECT combo, seq_id, count(*) AS run FROM islands GROUP BY combo, seq_id, d, g) GROUP BY ALL),
kp AS (SELECT *, row_number() OVER (PARTITION BY combo, seq_id, fragment ORDER BY k) AS c FROM pred), kt AS (SELECT *, row_number() OVER (PARTITION BY seq_id, fragment ORDER BY idx) AS c FROM prim),
mo AS MATERIALIZED (SELECT combo, kp.seq_id, kp.k AS p, kt.idx AS t FROM kp JOIN kt ON kt.seq_id = kp.seq_id AND kt.fragment = kp.fragment AND kt.c = kp.c),
tauv AS (SELECT a.combo, a.seq_id, sum(sign(b.t - a.t)) / count(*)::DOUBLE AS tau FROM mo a JOIN mo b ON a.combo = b.combo AND a.seq_id = b.seq_id AND a.p < b.p GROUP BY ALL),
measured AS MATERIALIZED (SELECT combo, seq_id, (reconstruction = seq)::INTEGER::DOUBLE AS exact_match, {R6.format("coalesce(similarity, 1)")} AS similarity,
  {R6.format("1 - levenshtein(reconstruction, seq) / greatest(length(reconstruction), length(seq))::DOUBLE")} AS edit_similarity, {R6.format("coalesce(apa, 0)")} AS apa, {R6.format("run / n::DOUBLE")} AS lcr, {R6.format("coalesce(tau, 0)")} AS tau
  FROM texts JOIN seqs USING (seq_id) JOIN anym USING (seq_id) LEFT JOIN simv USING (combo, seq_id) LEFT JOIN apav USING (combo, seq_id) LEFT JOIN lcrv USING (combo, seq_id) LEFT JOIN tauv USING (combo, seq_id)),
plan AS MATERIALIZED (
  SELECT seq_id, 'selected' AS arm, iteration, combo FROM seqs, (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(GUIDED, 1))}) g(iteration, combo)
  UNION ALL SELECT seq_id, 'control', 1, '{GUIDED[0]}' FROM seqs
  UNION ALL SELECT seq_id, 'control', r, combo FROM (SELECT seq_id, combo, row_number() OVER (PARTITION BY seq_id ORDER BY {DRAW.format("42, seq_id, combo")}, combo) + 1 AS r FROM seqs, combos WHERE combo <> '{GUIDED[0]}') WHERE r <= {DRAWN}),
tried AS MATERIALIZED (SELECT p.*, validity, row_number() OVER (PARTITION BY p.seq_id, arm ORDER BY validity, iteration) AS place FROM plan p JOIN cand c ON c.seq_id = p.seq_id AND c.combo = p.combo),
named AS (SELECT seq_id, 'baseline' AS arm, 'random' AS combo FROM seqs UNION ALL SELECT seq_id, 'first', combo FROM tried WHERE arm = 'selected' AND iteration = 1 UNION ALL SELECT seq_id, arm, combo FROM tried WHERE place = 1),
armv AS MATERIALIZED (
  SELECT n.seq_id, arm, {", ".join(K.METRICS)} FROM named n JOIN measured m ON m.seq_id = n.seq_id AND m.combo = n.combo
  UNION ALL SELECT t.seq_id, 'ceiling', {", ".join(f"max({m})" for m in K.METRICS)} FROM tried t JOIN measured m ON m.seq_id = t.seq_id AND m.combo = t.combo WHERE arm = 'selected' GROUP BY t.seq_id)"""

#: vals: armv in long form with the run, the fragments and their bin.
VALS = f"""{ARMV}, about AS MATERIALIZED (SELECT seq_id, grp AS run, n, CASE WHEN n < 2 THEN '<2' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' ELSE '50+' END AS bin FROM seqs JOIN anym USING (seq_id)),
vals AS MATERIALIZED ({" UNION ALL ".join(f"SELECT seq_id, run, n, bin, arm, '{m}' AS metric, {m} AS value FROM armv JOIN about USING (seq_id)" for m in K.METRICS)})"""


def arm_rows(spark, d):
    """Sequences with their candidates, histories and arms in the row (candidates.with_arms); the candidates are computed once
    in a session."""

    def measured():
        rows = sequence_table(spark, d)
        return [Q.once(K.measured_rows(rows, C.residue_model(rows), SETTINGS, WINDOWS, VALIDITY_WINDOW, 7), "measured")]

    combos = [s["combo"] for s in SETTINGS]
    plans = {"selected": F.array(*map(F.lit, GUIDED)), "control": K.control_plan(combos, GUIDED[0], DRAWN, 42)}
    return K.with_arms(Q.once_a_session(spark, f"{d}/documents.parquet", measured)[0], combos, plans)


def plan_table(spark, d):
    """seq_id, arm, iteration, combo: what the guided and the control arm try. It needs the sequences alone, no search."""

    def plan():
        return _plan(spark, d)

    return Q.once_a_session(spark, f"{d}/documents.parquet", plan)[0]


def _plan(spark, d):
    s = S.spread(seqs(spark, d).select("seq_id"))
    guided = s.select("seq_id", F.lit("selected").alias("arm"), F.posexplode(F.array(*map(F.lit, GUIDED))).alias("iteration", "combo")).withColumn("iteration", F.col("iteration") + 1)
    grid = spark.createDataFrame([(x["combo"],) for x in SETTINGS], "combo string")
    control = O.random_lever_plan(s.select(F.col("seq_id").alias("sample")), grid, F.col("combo"), DRAWN, 42, F.lit(GUIDED[0]))
    return [Q.once(guided.unionByName(control.select(F.col("sample").alias("seq_id"), F.lit("control").alias("arm"), "iteration", "combo")), "plan")]


def values(spark, d):
    """run, seq_id, n, bin, arm and all metrics, and base, the baseline's."""
    rows = arm_rows(spark, d).select(F.col("grp").alias("run"), "seq_id", F.col("n").cast("long").alias("n"), F.col("arms")[0].alias("base"), F.explode("arms").alias("x"))
    return rows.select("run", "seq_id", "n", M.fragment_bin(F.col("n")).alias("bin"), "x.*", "base")


@query(f"WITH RECURSIVE {ARMV} SELECT * FROM armv")
def d9_arm_values(spark, d):
    """Six metrics of five arms for each sequence."""
    return values(spark, d).select("seq_id", "arm", *K.METRICS)


@query(f"WITH RECURSIVE {ARMV} SELECT seq_id, arm, iteration::INTEGER AS iteration, combo FROM tried WHERE place = 1")
def o9_kept_candidates(spark, d):
    """The candidate that the guided and the control arm keep, by validity."""
    kept = F.array(*(F.struct(F.lit(arm).alias("arm"), F.col("kept")[arm]["iteration"].alias("iteration"), F.col("kept")[arm]["combo"].alias("combo")) for arm in ("selected", "control")))
    return arm_rows(spark, d).select("seq_id", F.explode(kept).alias("x")).select("seq_id", "x.*")


@query(f"WITH RECURSIVE {VALS} SELECT run, array_to_string(list_filter(['baseline', 'first', 'control', 'selected', 'ceiling'], lambda a: list_contains(list(DISTINCT arm), a)), ',') AS arms FROM vals WHERE value IS NOT NULL AND NOT (run = 'es' AND arm = 'control') GROUP BY run")
def pf13_arms_in_ladder_order(spark, d):
    """The arms of each run; the Spanish run is taken without its control."""
    rows = values(spark, d).filter("not (run = 'es' and arm = 'control')")
    return K.arms_present(rows, ["run"]).select("run", F.array_join("arms", ",").alias("arms"))


BINS = ["2-4", "5-9", "10-19", "20-49", "50+"]


@query(f"""WITH RECURSIVE {VALS}, base AS (SELECT seq_id, metric, value AS b FROM vals WHERE arm = 'baseline'),
grid AS (SELECT * FROM (SELECT DISTINCT run FROM about), (SELECT unnest({BINS}) AS bin), (SELECT unnest({K.ARMS}) AS arm), (SELECT unnest({K.METRICS}) AS metric)),
v AS (SELECT run, bin, arm, metric, count(value) AS n, avg(value) AS mean, avg(value - b) AS lift FROM vals JOIN base USING (seq_id, metric) GROUP BY ALL)
SELECT run, bin, arm, metric, coalesce(n, 0) AS n, {R6.format("mean")} AS mean, CASE WHEN arm <> 'baseline' THEN {R6.format("lift")} END AS lift FROM grid LEFT JOIN v USING (run, bin, arm, metric)""")
def a21_stratified_metrics(spark, d):
    """Run, bin, arm and metric, empty ones too, with the lift over the baseline of the same samples."""
    rows = values(spark, d)
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col("base")[m].alias("b")) for m in K.METRICS))
    long = rows.select("run", "bin", "arm", F.explode(each).alias("x")).select("run", "bin", "arm", "x.*")
    found = long.groupBy("run", "bin", "arm", "metric").agg(F.count("value").alias("n"), settle(F.avg("value")).alias("mean"), settle(F.avg(F.col("value") - F.col("b"))).alias("lift"))
    grid = rows.select("run").distinct()
    for name, listed in (("bin", BINS), ("arm", K.ARMS), ("metric", K.METRICS)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, listed))))
    return grid.join(found, ["run", "bin", "arm", "metric"], "left").select("run", "bin", "arm", "metric", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.when(F.col("arm") != "baseline", F.col("lift")).alias("lift"))


_MEANS = ", ".join(R6.format(f"avg(value) FILTER (arm = '{a}' AND metric = '{m}')") + f" AS {a}_{m}" for a in K.ARMS for m in K.METRICS)


@query(f"WITH RECURSIVE {VALS} SELECT run, count(DISTINCT seq_id) AS n, {_MEANS} FROM vals GROUP BY run")
def a22_cross_run_means(spark, d):
    """The mean of every metric of every arm, a row a run."""
    cells = [settle(F.avg(F.when(F.col("arm") == a, F.col(m)))).alias(f"{a}_{m}") for a in K.ARMS for m in K.METRICS]
    return values(spark, d).groupBy("run").agg(F.count(F.when(F.col("arm") == "baseline", 1)).alias("n"), *cells)


@query(f"""WITH RECURSIVE {VALS} SELECT run, metric, count(*) FILTER (arm = 'control') AS n, {R6.format("avg(value) FILTER (arm = 'control')")} AS control, {R6.format("avg(value) FILTER (arm = 'selected')")} AS selected,
{R6.format("avg(value) FILTER (arm = 'selected') - avg(value) FILTER (arm = 'control')")} AS difference FROM vals GROUP BY run, metric""")
def a38_arm_pair_metrics(spark, d):
    """The control's and the guided arm's mean of every metric for each run."""
    long = K.long_values(values(spark, d).select("run", "arm", *K.METRICS))
    of = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("value")))
    return long.groupBy("run", "metric").agg(F.count(F.when(F.col("arm") == "control", 1)).alias("n"), settle(of("control")).alias("control"), settle(of("selected")).alias("selected"), settle(of("selected") - of("control")).alias("difference"))


LEVERS = ("window", "mode", "width", "edges", "bonus")


def _levers(combo):
    """The levers of a setting as a map; the width is a lever of beam search only."""
    maps = [F.when(combo == s["combo"], F.create_map(*(F.lit(x) for name in LEVERS if name != "width" or s["mode"] == "beam" for x in (name, str(s[name]))))) for s in SETTINGS]
    return F.coalesce(*maps)


_LEVER_ROWS = ", ".join(f"('{s['combo']}', '{name}', '{s[name]}')" for s in SETTINGS for name in LEVERS if name != "width" or s["mode"] == "beam")


@query(f"""WITH RECURSIVE {VALS}, lv(combo, lever, value) AS (VALUES {_LEVER_ROWS}),
used AS (SELECT a.run, t.seq_id, t.iteration, lever, v.value FROM tried t JOIN about a USING (seq_id) CROSS JOIN (SELECT unnest({list(LEVERS)}) AS lever) LEFT JOIN lv v USING (combo, lever) WHERE arm = 'control'),
stepped AS (SELECT *, lag(value) OVER w AS before, lag(iteration) OVER w AS earlier, max(value) OVER (PARTITION BY seq_id, lever) AS ever FROM used WINDOW w AS (PARTITION BY seq_id, lever ORDER BY iteration)),
shares AS (SELECT run, lever, sum((value IS DISTINCT FROM before)::INTEGER)::BIGINT AS changes, count(*) AS steps FROM stepped WHERE earlier IS NOT NULL AND ever IS NOT NULL GROUP BY ALL),
counted AS (SELECT run, lever, value, count(*) AS n FROM used WHERE value IS NOT NULL GROUP BY ALL),
listed AS (SELECT run, lever, count(*) AS n_values, string_agg(value || ':' || n, ',' ORDER BY value) AS counts FROM counted GROUP BY ALL)
SELECT run, lever, changes, steps, {R6.format("changes / steps::DOUBLE")} AS change_share, n_values, counts FROM shares JOIN listed USING (run, lever)""")
def a15_lever_behaviour(spark, d):
    """How often the control arm moves each lever, and how often it uses each value."""
    plan = plan_table(spark, d)
    runs = seqs(spark, d).select("seq_id", F.col("grp").alias("run"))
    tried = plan.filter("arm = 'control'").join(runs, "seq_id").select("run", "seq_id", "iteration", _levers(F.col("combo")).alias("levers"))
    found = K.lever_behaviour(tried, ["run"])
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return found.select("run", "lever", "changes", "steps", settle("change_share").alias("change_share"), "n_values", text.alias("counts"))


@query(f"""WITH RECURSIVE {ARMV}, lv(combo, lever, value) AS (VALUES {_LEVER_ROWS}), v AS (SELECT DISTINCT lever, value FROM tried JOIN lv USING (combo)) SELECT lever, string_agg(value, ',' ORDER BY value) AS vals FROM v GROUP BY lever""")
def a37_distinct_settings(spark, d):
    """The sorted distinct values of every setting over all candidates tried."""
    plan = plan_table(spark, d)
    used = plan.select(F.explode(_levers(F.col("combo"))).alias("lever", "value")).distinct()
    return used.groupBy("lever").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals"))


def stored(spark, d):
    """The records of run folders that were written before, one run without a control arm."""

    def records():
        return _records(spark, d)

    return Q.once_a_session(spark, f"{d}/documents.parquet", records)[0]


def _records(spark, d):
    root = Q.shared_folder(spark, "records")
    R.record_sink(R.without_control(R.records_of_rows(arm_rows(spark, d), _levers), F.col("run") == "es"), root)
    return [R.record_scan(spark, root)]


KIND = """CASE WHEN selected_exact_match >= 1 THEN 'exact' WHEN selected_tau <= -0.5 THEN 'block_reversal' WHEN abs(selected_tau) < 0.15 AND selected_apa <= 0.05 THEN 'full_scramble'
WHEN n >= 2 AND (n - 1) * (1 - selected_apa) <= 2 AND selected_lcr >= 0.5 THEN 'local_transposition' WHEN NOT nterm_correct THEN 'wrong_start' ELSE 'partial_assembly' END"""
_CELLS = ", ".join(f"any_value({m}) FILTER (arm = '{a}'{' AND run <> ' + chr(39) + 'es' + chr(39) if a == 'control' else ''}) AS {a}_{m}" for a in K.ARMS for m in K.METRICS)

#: One row a sample with the arms side by side; the Spanish run has no control.
WIDE = f"""{VALS},
cells AS (SELECT seq_id, run, any_value(n) AS n, any_value(bin) AS bin, {_CELLS} FROM armv JOIN about USING (seq_id) GROUP BY seq_id, run),
hist AS MATERIALIZED (SELECT t.seq_id, t.arm, t.iteration, t.place, t.validity, m.apa, m.edit_similarity FROM tried t JOIN measured m ON m.seq_id = t.seq_id AND m.combo = t.combo),
conc AS (SELECT a.seq_id, count(*) AS pairs, avg((a.apa > b.apa)::INTEGER) AS concordance FROM hist a JOIN hist b ON a.seq_id = b.seq_id AND a.validity < b.validity AND a.apa <> b.apa
  WHERE a.arm = 'selected' AND b.arm = 'selected' AND isfinite(a.validity) AND isfinite(b.validity) GROUP BY a.seq_id),
heads AS (SELECT seq_id, arg_min(idx, k) FILTER (combo = 'random') = 0 AS shuffled FROM orders GROUP BY seq_id),
sel AS (SELECT t.seq_id, o.idx = 0 AS right_start FROM tried t JOIN orders o ON o.seq_id = t.seq_id AND o.combo = t.combo AND o.k = 1 WHERE t.arm = 'selected' AND t.place = 1),
trues AS (SELECT seq_id, count(b) AS true_junctions, count(*) FILTER (b IS NOT NULL AND {IMPOSSIBLE.format("a", "b")}) AS pruned_true FROM truep GROUP BY seq_id),
pruned AS (SELECT seq_id, count(*) FILTER (impossible) AS pruned_total FROM mf GROUP BY seq_id),
wide AS MATERIALIZED (SELECT c.*, length(seq) AS length, right_start AS nterm_correct, shuffled AS nterm_correct_shuffled, concordance, coalesce(pairs, 0) AS comparable_pairs,
  (SELECT any_value(iteration) FROM hist h WHERE h.seq_id = c.seq_id AND arm = 'selected' AND place = 1) AS best_iteration,
  (SELECT any_value(validity) FROM hist h WHERE h.seq_id = c.seq_id AND arm = 'selected' AND place = 1) AS best_validity,
  (SELECT any_value(validity) FROM hist h WHERE h.seq_id = c.seq_id AND arm = 'selected' AND iteration = 1) AS first_validity,
  CASE WHEN run <> 'es' THEN (SELECT any_value(validity) FROM hist h WHERE h.seq_id = c.seq_id AND arm = 'control' AND place = 1) END AS control_validity,
  CASE WHEN run <> 'es' THEN (SELECT any_value(iteration) FROM hist h WHERE h.seq_id = c.seq_id AND arm = 'control' AND place = 1) END AS control_best_iteration,
  coalesce(n_edges, 0) AS n_edges, true_junctions, pruned_true, coalesce(pruned_total, 0) AS num_pruned
  FROM cells c JOIN seqs USING (seq_id) JOIN heads USING (seq_id) JOIN sel USING (seq_id) JOIN trues USING (seq_id) LEFT JOIN conc USING (seq_id) LEFT JOIN total USING (seq_id) LEFT JOIN pruned USING (seq_id))"""


def _finite_or(c: str) -> str:
    return f"CASE WHEN isinf({c}) THEN -1 ELSE {c} END AS {c}"


@query(f"""WITH RECURSIVE {WIDE} SELECT run, seq_id AS sample, length, n::INTEGER AS n, bin, TRUE AS true_order_recovered, TRUE AS completed, {", ".join(f"{a}_{m}" for a in K.ARMS for m in K.METRICS)}, nterm_correct, nterm_correct_shuffled,
{R6.format("CASE WHEN n >= 2 THEN (n - 1) * (1 - selected_apa) END")} AS breakpoints, {R6.format("CASE WHEN n >= 2 THEN 1 - selected_apa END")} AS breakpoints_normalized, {KIND} AS error_class,
{R6.format("concordance")} AS concordance, comparable_pairs::INTEGER AS comparable_pairs, best_iteration::INTEGER AS best_iteration, {len(GUIDED)} AS num_iterations, {_finite_or("best_validity")}, {_finite_or("first_validity")}, {_finite_or("control_validity")},
control_best_iteration::INTEGER AS control_best_iteration, n_edges, n * (n - 1) AS total_junctions, num_pruned, {R6.format("CASE WHEN n > 1 THEN num_pruned / (n * (n - 1))::DOUBLE * 100 ELSE 0 END")} AS pruned_pct,
true_junctions, pruned_true, {R6.format("CASE WHEN true_junctions > 0 THEN 1 - pruned_true / true_junctions::DOUBLE END")} AS cleavage_recall FROM wide""")
def pf14_wide_rows(spark, d):
    """All columns of a sample, from the stored records of all runs in one scan."""
    rows = R.wide_rows(stored(spark, d))
    for c in ("breakpoints", "breakpoints_normalized", "concordance", "pruned_pct", "cleavage_recall"):
        rows = rows.withColumn(c, settle(c))
    for c in ("best_validity", "first_validity", "control_validity"):
        rows = rows.withColumn(c, F.when(F.col(c) == float("inf"), -1.0).otherwise(F.col(c)))
    return rows


@query(f"""WITH RECURSIVE {WIDE}, best AS (SELECT seq_id, max(edit_similarity) AS top FROM hist WHERE arm = 'selected' GROUP BY seq_id)
SELECT run, seq_id AS sample, baseline_edit_similarity AS baseline, first_edit_similarity AS first, control_edit_similarity AS control, selected_edit_similarity AS selected, top AS ceiling FROM wide JOIN best USING (seq_id)""")
def pf15_backfill_from_candidates(spark, d):
    """The arms' edit similarity when no record stores it: from texts, orders and the candidates of the history."""
    rows = stored(spark, d)
    for arm in K.ARMS:
        c = f"{arm}_metrics"
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c).withField("edit_similarity", F.lit(None).cast("double"))))
    found = R.backfill_similarity(rows)
    return found.select("run", "sample", *(settle(a).alias(a) for a in K.ARMS))
