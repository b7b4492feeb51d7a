"""Queries on summaries of edges, rankings and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweave.functions.rounding import settle
from sparkweave.operators import batches as B
from sparkweave.operators import candidates as K
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import scoring as C
from sparkweave.operators import search as O
from sparkweave.operators import segment as S
from sparkweave.operators.ranges import order_statistics
from sparkweave.queries.base import DRAW, EDGES, FRAGS, query
from sparkweave.queries.fragments import PRUNED, RECALL, cut, primaries, seqs
from sparkweave.queries.report_queries import ARMS, arms
from sparkweave.queries.searches import GRID, SCORED, SPACE, combo_grid, combo_name, true_ranks
from sparkweave.sources.sequences import table

R6 = "round({} + 1e-10::DOUBLE, 6)"


@query(f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY seq_id, i ORDER BY score DESC) AS rank FROM scores),
r AS (SELECT seq_id, avg((rank <= 1)::INTEGER) AS top1, avg((rank <= 3)::INTEGER) AS top3, avg(1.0::DOUBLE / rank) AS mrr, count(*) AS junctions FROM k WHERE j = i + 1 GROUP BY seq_id)
SELECT count(*) AS n, {R6.format('avg(top1)')} AS top1, {R6.format('avg(top3)')} AS top3, {R6.format('avg(mrr)')} AS mrr, sum(junctions)::BIGINT AS junctions FROM r""")
def a13_junction_ranking_summary(spark, d):
    r = true_ranks(spark, d).filter(F.size("ranks") > 0).select(*K.rank_means(F.col("ranks")))
    return r.agg(F.count(F.lit(1)).alias("n"), settle(F.avg("top1")).alias("top1"), settle(F.avg("top3")).alias("top3"), settle(F.avg("mrr")).alias("mrr"), F.sum("junctions").alias("junctions"))


@query(f"WITH {RECALL} SELECT {R6.format('1 - sum(pruned_true) / sum(true_junctions)::DOUBLE')} AS recall, count(*) FILTER (pruned_true > 0) AS with_loss, sum(pruned_total)::BIGINT AS pruned_total FROM recall")
def a14_filter_recall_summary(spark, d):
    r = E.filter_recall(primaries(spark, d))
    return r.agg(settle(1 - F.sum("pruned_true") / F.sum("true_junctions")).alias("recall"), F.count(F.when(F.col("pruned_true") > 0, 1)).alias("with_loss"), F.sum("pruned_total").alias("pruned_total"))


STRENGTH = RECALL + ", n AS (SELECT seq_id, any_value(grp) AS grp, count(*) AS n FROM prim GROUP BY seq_id), c AS (SELECT seq_id, count(*) AS c FROM edges GROUP BY seq_id), x AS (SELECT grp, coalesce(c, 0) AS c, CASE WHEN n > 1 THEN coalesce(c, 0) / (n - 1)::DOUBLE END AS share, CASE WHEN n > 1 THEN pruned_total / (n * (n - 1))::DOUBLE * 100 ELSE 0 END AS pruned FROM n LEFT JOIN c USING (seq_id) JOIN (SELECT seq_id, pruned_total FROM recall) USING (seq_id))"


@query(f"WITH {STRENGTH} SELECT grp, {R6.format('avg(c)')} AS mean_edges, {R6.format('avg(share)')} AS mean_share, {R6.format('avg(pruned)')} AS mean_pruned_pct FROM x GROUP BY grp")
def a16_overlap_strength(spark, d):
    primary, whole = F.col("pieces")[0], F.array_distinct(F.flatten("pieces"))
    x = cut(spark, d).filter("seq_id is not null").select("seq_id", "grp", F.size(primary).alias("n"), F.size(E.edges_of(primary, whole)).alias("c"), E.pruned_in_row(primary).alias("pruned_total"))
    pairs = F.col("n").cast("long") * (F.col("n") - 1)
    x = x.withColumn("pruned_pct", F.when(pairs > 0, F.col("pruned_total") / pairs * 100).otherwise(0.0))
    share = F.when(F.col("n") > 1, F.col("c") / (F.col("n") - 1))
    return x.groupBy("grp").agg(settle(F.avg("c")).alias("mean_edges"), settle(F.avg(share)).alias("mean_share"), settle(F.avg("pruned_pct")).alias("mean_pruned_pct"))


#: Edges that the first r replicas prove, r being the least replicas that do: that of the fragment which is split.
SCALED = FRAGS + """,
whole AS (SELECT seq_id, fragment, min(replica) + 1 AS needs FROM frag WHERE length(fragment) > 1 GROUP BY ALL),
halves AS (SELECT seq_id, fragment, needs, unnest(range(1, length(fragment))) AS n FROM whole),
proved AS (SELECT h.seq_id, a.idx AS i, b.idx AS j, min(needs) AS needs FROM halves h
  JOIN known a ON a.seq_id = h.seq_id AND a.fragment = substr(h.fragment, 1, n)
  JOIN known b ON b.seq_id = h.seq_id AND b.fragment = substr(h.fragment, n + 1) GROUP BY ALL),
n AS (SELECT seq_id, any_value(grp) AS grp, count(*) AS n FROM prim GROUP BY seq_id),
c AS (SELECT seq_id, r.range AS replicas, count(*) AS c FROM proved JOIN range(2, 4) r ON needs <= r.range GROUP BY ALL)"""


@query(f"WITH {SCALED} SELECT grp, r.range::INTEGER AS replicas, count(*) AS sequences, coalesce(sum(c), 0)::BIGINT AS edges, {R6.format('avg(coalesce(c, 0))')} AS mean_edges, {R6.format('avg(CASE WHEN n > 1 THEN coalesce(c, 0) / (n - 1)::DOUBLE END)')} AS mean_share FROM n CROSS JOIN range(2, 4) r LEFT JOIN c ON c.seq_id = n.seq_id AND c.replicas = r.range GROUP BY ALL")
def a24_replica_scaling(spark, d):
    """What two and three replicas confirm in each group."""
    primary = F.col("pieces")[0]
    of = lambda r: F.struct(F.lit(r).alias("replicas"), F.size(E.edges_of(primary, F.array_distinct(F.flatten(F.slice("pieces", F.lit(1), F.lit(r)))))).alias("c"))
    x = cut(spark, d).select("grp", F.size(primary).alias("n"), F.explode(F.array(of(2), of(3))).alias("x")).select("grp", "n", "x.*")
    share = F.when(F.col("n") > 1, F.col("c") / (F.col("n") - 1))
    return x.groupBy("grp", "replicas").agg(F.count(F.lit(1)).alias("sequences"), F.sum("c").alias("edges"), settle(F.avg("c")).alias("mean_edges"), settle(F.avg(share)).alias("mean_share"))


DIAGNOSED = SCORED + PRUNED + """, tile(seq_id, cur, path) AS (SELECT seq_id, 0::BIGINT, []::INTEGER[] FROM seqs UNION ALL
SELECT seq_id, cur + len, list_append(path, idx) FROM (SELECT t.seq_id, t.cur, t.path, p.idx, length(p.fragment) AS len, row_number() OVER (PARTITION BY t.seq_id ORDER BY -length(p.fragment), p.idx) AS r
  FROM tile t JOIN seqs s ON s.seq_id = t.seq_id JOIN prim p ON p.seq_id = t.seq_id AND NOT list_contains(t.path, p.idx) AND substr(s.seq, t.cur + 1, length(p.fragment)) = p.fragment) WHERE r = 1),
best AS (SELECT seq_id, max(cur) AS cur, arg_max(path, len(path)) AS path FROM tile GROUP BY seq_id),
ok AS (SELECT b.seq_id, path FROM best b JOIN seqs s ON s.seq_id = b.seq_id JOIN t ON t.seq_id = b.seq_id WHERE cur = length(seq) AND len(path) = n),
pathed AS (SELECT seq_id, path, unnest(range(1, len(path))) AS k FROM ok), tp AS (SELECT seq_id, path[k] AS i, path[k + 1] AS j FROM pathed),
ranked AS (SELECT *, rank() OVER (PARTITION BY seq_id, i ORDER BY score DESC) AS rank FROM scores),
marked AS (SELECT tp.seq_id, rank, e.i IS NOT NULL AS confirmed FROM tp LEFT JOIN ranked k ON k.seq_id = tp.seq_id AND k.i = tp.i AND k.j = tp.j LEFT JOIN edges e ON e.seq_id = tp.seq_id AND e.i = tp.i AND e.j = tp.j),
m AS (SELECT seq_id, avg((rank <= 1)::INTEGER) FILTER (NOT confirmed) AS top1, avg((rank <= 3)::INTEGER) FILTER (NOT confirmed) AS top3, avg(1.0::DOUBLE / rank) FILTER (NOT confirmed) AS mrr, count(rank) FILTER (NOT confirmed) AS junctions, count(*) FILTER (confirmed) AS excluded FROM marked GROUP BY seq_id)"""


@query(f"WITH RECURSIVE {DIAGNOSED} SELECT seq_id, coalesce(n, 0) AS fragments, ok.path IS NOT NULL AS recovered, {R6.format('top1')} AS top1, {R6.format('top3')} AS top3, {R6.format('mrr')} AS mrr, coalesce(junctions, 0) AS junctions, coalesce(excluded, 0) AS excluded, {R6.format('recall')} AS recall, pruned_total FROM seqs LEFT JOIN recall USING (seq_id) LEFT JOIN ok USING (seq_id) LEFT JOIN m USING (seq_id)")
def m16_sample_diagnostics(spark, d):
    """Everything in the row of a sequence, so that neither its pairs nor its fragments move."""
    # A sequence without a number is cut as number 0; none of its fragments counts.
    pieces = B.cut_and_proved(0.3, 3, 42)(F.coalesce("seq_id", F.lit(0)), "seq")
    rows = M.true_order_in_row(S.spread(seqs(spark, d)).select("seq_id", pieces.alias("cut")).select("seq_id", "cut.primary", "cut.edges"))
    rows = K.ranked_path(rows.withColumn("recovered", F.col("path").isNotNull()), C.residue_model(seqs(spark, d)), 3, F.col("path"), "seq_id", "primary", "recovered")
    means = K.rank_means(F.filter("ranks", lambda x: ~x["confirmed"]))
    # A sequence of a document without a number has no fragments in the tables, whose keys are not null.
    known = F.col("seq_id").isNotNull()
    count = lambda c: F.when(known, c).otherwise(0).cast("long")
    rows = rows.select("seq_id", count(F.size("primary")).alias("fragments"), (known & F.col("recovered")).alias("recovered"), *means, count(F.size(F.filter("ranks", lambda x: x["confirmed"]))).alias("excluded"), "primary")
    shares = [F.when(known, settle(c)).alias(c) for c in ("top1", "top3", "mrr")]
    return rows.select("seq_id", "fragments", "recovered", *shares, count(F.col("junctions")).alias("junctions"), "excluded", F.when(known, settle(E.recall_in_row(F.col("primary")))).alias("recall"), F.when(known, E.pruned_in_row(F.col("primary"))).alias("pruned_total"))


@query("""WITH v AS (SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL), c AS (SELECT x AS cap, n FROM v WHERE k = floor(0.99::DOUBLE * (n - 1))),
w AS (SELECT least(x, cap) AS x, cap, v.n FROM v, c), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 15 AS width, any_value(n) AS n FROM w), b AS (SELECT least(floor((x - lo) / width), 14)::BIGINT AS bin, count(*) AS c FROM w, e GROUP BY 1)
SELECT bin, c AS count, round(c / (n * width) + 1e-13::DOUBLE, 9) AS density FROM b, e""")
def a31_clipped_density(spark, d):
    """Lengths capped at the 99th percentile (a listed value), as a density in 15 bins; empty bins left out."""
    x = table(spark, d, "documents").filter("n_chars is not null").select(F.col("n_chars").cast("double").alias("x"))
    values = x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    cap = order_statistics(x, [], "x", {"cap": F.floor(0.99 * (F.col("n") - 1))})
    clipped = values.join(F.broadcast(cap)).select(F.least("x", "cap").alias("x"), "c", "n")
    ends = clipped.agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / 15).alias("width"))
    bins = clipped.join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(14)).alias("bin"), "n", "width").agg(F.sum("c").alias("count"))
    return bins.select("bin", "count", settle(F.col("count") / (F.col("n") * F.col("width")), 9).alias("density"))


@query(f"WITH {GRID}, o AS (SELECT '3/' || CASE WHEN o_orderstatus = 'F' THEN 'beam' ELSE 'greedy' END || '/' || CASE WHEN o_custkey % 2 = 0 THEN 5 ELSE 25 END AS combo, o_totalprice AS value FROM orders), s AS (SELECT combo, count(*) AS n, round(avg(value) + 1e-6::DOUBLE, 2) AS mean FROM o GROUP BY combo) SELECT grid.combo, coalesce(n, 0) AS n, mean, CASE WHEN n IS NULL THEN 'failed' ELSE 'ok' END AS status FROM grid LEFT JOIN s USING (combo)")
def a36_sweep_table(spark, d):
    grid, name = combo_grid(spark)
    mode, width = F.when(F.col("o_orderstatus") == "F", "beam").otherwise("greedy"), F.when(F.col("o_custkey") % 2 == 0, "5").otherwise("25")
    done = table(spark, d, "orders").groupBy(F.concat_ws("/", F.lit("3"), mode, width).alias("combo")).agg(F.count(F.lit(1)).alias("n"), settle(F.avg("o_totalprice"), 2).alias("mean"))
    return grid.select(name.alias("combo")).join(done, "combo", "left").select("combo", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.when(F.col("n").isNull(), "failed").otherwise("ok").alias("status"))


@query(f"WITH {ARMS} SELECT sample, (selected >= 1)::INTEGER::DOUBLE AS exact, selected, n AS fragments, baseline FROM arms")
def a39_per_sample_summary(spark, d):
    return arms(spark, d).select("sample", (F.col("selected") >= 1).cast("double").alias("exact"), "selected", F.col("n").alias("fragments"), "baseline")


@query(f"WITH {GRID}, o AS (SELECT DISTINCT l_linenumber AS extra FROM lineitem) SELECT combo, extra FROM grid, o")
def j13_lever_grid(spark, d):
    """The grid of levers, crossed with a further axis of few values that the data give."""
    extra = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("extra")).distinct()
    return O.crossed(extra, SPACE).select(combo_name().alias("combo"), "extra")


@query(f"WITH s AS (SELECT DISTINCT o_orderpriority AS combo FROM orders) SELECT (row_number() OVER (ORDER BY {DRAW.format('42, combo')}, combo))::INTEGER AS iteration, combo FROM s")
def o12_grid_lever_plan(spark, d):
    grid = table(spark, d, "orders").select("o_orderpriority").distinct()
    return O.grid_lever_plan(grid, F.col("o_orderpriority"), 42)
