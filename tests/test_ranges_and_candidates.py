"""Ranges against brute force, with ties, nulls and one large group; candidates and arms on a small table."""

import random
from statistics import quantiles as exact_quantiles

from pyspark.sql import functions as F

from sparkweave.operators import candidates as K
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import ranges as R
from sparkweave.operators import scoring as C
from sparkweave.operators import segment as S
from sparkweave.sources import records
from sparkweave.sources.sequences import once


def rows_of(spark):
    draw = random.Random(4)
    rows = [("big", float(draw.randrange(40)), float(draw.randrange(9))) for _ in range(900)]
    rows += [("big", 7.0, 7.0)] * 400 + [(None, float(draw.randrange(5)), 1.0) for _ in range(30)] + [("one", 3.0, 2.0), ("gone", None, 1.0), ("odd", float("nan"), 1.0), ("odd", float("inf"), 2.0), ("odd", 5.0, 3.0)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, x double, y double").repartition(7)


def finite(rows, g):
    return sorted(x for h, x, _ in rows if h == g and x is not None and abs(x) < float("inf"))


def test_quantiles_and_places(spark):
    rows, table = rows_of(spark)
    got = {r.g: r for r in R.quantiles(table, ["g"], "x", {"q25": 0.25, "q50": 0.5, "top": 7.0, "low": -1.0}).collect()}
    assert set(got) == {"big", None, "one", "odd"}
    for g, r in got.items():
        values = finite(rows, g)
        assert r.n == len(values) and r.low == values[0] and r.top == values[-1]
        if len(values) > 1:
            q1, q2, _ = exact_quantiles(values, n=4, method="inclusive")
            assert abs(r.q25 - q1) < 1e-9 and abs(r.q50 - q2) < 1e-9
    upper = {r.g: r.m for r in R.order_statistics(table, ["g"], "x", {"m": F.floor(F.col("n") / 2)}).collect()}
    assert upper == {g: finite(rows, g)[len(finite(rows, g)) // 2] for g in got}
    assert R.quantiles(table.limit(0), ["g"], "x", {"q": 0.5}).collect() == []
    assert R.quantiles(table.filter("g = 'big'"), [], "x", {"q": 0.5}).first().n == 1300


def test_average_ranks(spark):
    rows, table = rows_of(spark)
    got = {(r.g, r.x): (r.rank, r.n) for r in R.ranked(R.value_counts(table, ["g"], "x"), ["g"], "x").collect()}
    for (g, x), (rank, n) in got.items():
        values = finite(rows, g)
        places = [i for i, v in enumerate(values, 1) if v == x]
        assert rank == sum(places) / len(places) and n == len(values)


def test_pairs_are_counted_by_merging(spark):
    rows, table = rows_of(spark)
    table = table.filter("x is not null and not isnan(x)")
    got = {r.g: (r.same, r.opposite) for r in R.pair_orders(table, ["g"], "x", "y").collect()}
    for g in ("big", None, "one", "odd"):
        mine = [(x, y) for h, x, y in rows if h == g and x is not None and x == x]
        same = sum(a < c and b < d for a, b in mine for c, d in mine)
        opposite = sum(a < c and b > d for a, b in mine for c, d in mine)
        assert got[g] == (same, opposite)
    assert R.pair_orders(table.limit(0), ["g"], "x", "y").collect() == []


def assembled(spark):
    draw = random.Random(11)
    letters = "ADEGKRPMLNK"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(5, 60))) for _ in range(40)] + ["M", "KKKKKKK", "AKAKAKAK", "MAK" * 8]
    seqs = spark.createDataFrame([(i, "xy"[i % 2], t) for i, t in enumerate(texts)], "seq_id long, grp string, seq string")
    frags = S.segment(seqs, "trypsin", 0.3, 3, 42)
    return texts, seqs, frags, S.primary(frags)


def test_edges_in_rows_equal_those_by_joins(spark):
    _, seqs, frags, _ = assembled(spark)
    rows = sorted(tuple(r) for r in E.edges_in_rows(S.cut_rows(seqs)).select("seq_id", "i", "j").collect())
    assert rows == sorted(tuple(r) for r in E.confirmed_edges(frags).collect()) and len(rows) == len(set(rows)) > 30


def test_matrices_in_rows_equal_those_by_joins_and_nothing_moves(spark):
    _, seqs, frags, prim = assembled(spark)
    windows, model = (1, 3, 5), once(C.residue_model(seqs), "model")
    edges = once(E.confirmed_edges(frags), "edges")
    cut = S.cut_rows(seqs).select("seq_id", F.col("pieces")[0].alias("primary"), E.edges_of(F.col("pieces")[0], F.array_distinct(F.flatten("pieces"))).alias("edges"))
    rows = K.matrix_rows(cut, model, windows)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    joined = {r.seq_id: r for r in K.gathered(K.score_table(prim, edges, model, windows), prim, edges, windows).collect()}
    for r in rows.collect():
        want = joined.pop(r.seq_id)
        assert (r.n, r.pieces, r.starts, r.n_edges) == (want.n, want.pieces, want.starts, want.n_edges)
        if r.n > 1:
            assert r.matrix == want.matrix and r.incoming == want.incoming
    assert not joined


def test_measures_in_rows_equal_those_by_joins(spark):
    _, seqs, _, prim = assembled(spark)
    rows = once(S.cut_rows(seqs).select("seq_id", F.array_join(F.col("pieces")[0], "").alias("seq"), F.col("pieces")[0].alias("primary")), "rows")
    combos = {"a": F.sequence(F.size("primary") - 1, F.lit(0)), "b": F.sequence(F.lit(0), F.size("primary") - 1), "c": F.sequence(F.size("primary") - 1, F.lit(0))}
    each = rows.select("seq_id", "primary", F.explode(F.array(*(F.struct(F.lit(k).alias("combo"), path.alias("path"), F.lit(1).alias("placed")) for k, path in combos.items()))).alias("x")).select("seq_id", "primary", "x.*")
    found = once(each.select("seq_id", "combo", "path", F.array_join(F.transform("path", lambda i: F.get("primary", i)), "").alias("reconstruction"), "placed"), "found")
    got = K.measured_in_rows(found, rows)
    columns = ["seq_id", "combo", "path", "reconstruction", "placed", *K.METRICS]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(got.select(columns).collect()) == sorted(K.path_metrics(found, seqs, prim).select(columns).collect())


def test_arms_and_records(spark):
    texts, seqs, frags, prim = assembled(spark)
    seqs = once(seqs, "seqs")
    prim, edges = once(prim, "prim"), once(E.confirmed_edges(frags), "edges")
    windows = (1, 3)
    scores = once(K.score_table(prim, edges, C.residue_model(seqs), windows), "scores")
    settings = [{"combo": c, "window": w, "mode": m, "width": 2, "edges": e, "bonus": 0.5} for c, w, m, e in (("a", 1, "greedy", "hard"), ("b", 3, "beam", "hard"), ("c", 3, "beam", "soft"))]
    found = once(K.search_all(K.gathered(scores, prim, edges, windows), settings, windows, 3), "found")
    pieces = {r.seq_id: r.pieces for r in K.gathered(scores, prim, edges, windows).collect()}
    for r in found.collect():
        assert sorted(r.path) == list(range(len(pieces[r.seq_id]))) and r.reconstruction == "".join(pieces[r.seq_id][i] for i in r.path)
        assert (r.validity_score == float("inf")) == (len(pieces[r.seq_id]) < 2) and r.placed <= len(r.path) and (r.fell_back or r.placed == len(r.path))
    order = S.shuffle_fragments(prim, 7).groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "idx"))), lambda x: x["idx"]).alias("path"))
    random_ones = order.join(spark.createDataFrame([(i, p) for i, p in pieces.items()], "seq_id long, pieces array<string>"), "seq_id")
    random_ones = random_ones.select("seq_id", F.lit("random").alias("combo"), "path", F.array_join(F.transform("path", lambda i: F.get("pieces", i)), "").alias("reconstruction"))
    measured = once(K.path_metrics(found.unionByName(random_ones, allowMissingColumns=True), seqs, prim), "measured")
    assert measured.count() == 4 * len(texts)
    plan = seqs.select("seq_id", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(i).alias("iteration"), F.lit(c).alias("combo")) for a, i, c in (("selected", 1, "a"), ("selected", 2, "b"), ("control", 1, "a"), ("control", 2, "c"))))).alias("p")).select("seq_id", "p.*")
    plan = once(plan, "plan")
    kept = once(K.chosen(plan, measured), "kept")
    by = {(r.seq_id, r.combo): r for r in measured.collect()}
    for r in kept.collect():
        tried = [(by[r.seq_id, c].validity_score, i, c) for i, c in ((1, "a"), (2, "b" if r.arm == "selected" else "c"))]
        assert (r.iteration, r.combo) == min(tried)[1:]
    values = once(K.arm_values(plan, measured, kept), "values")
    got = {(r.seq_id, r.arm): r for r in values.collect()}
    assert len(got) == 5 * len(texts)
    for (i, arm), r in got.items():
        for m in K.METRICS:
            if arm == "ceiling":
                assert r[m] == max(by[i, "a"][m], by[i, "b"][m])
            if arm == "baseline":
                assert r[m] == by[i, "random"][m]
    levers = F.when(F.col("combo") == "a", F.create_map(F.lit("mode"), F.lit("greedy"))).otherwise(F.create_map(F.lit("mode"), F.lit("beam"), F.lit("width"), F.lit("2")))
    stored = records.without_control(records.records(seqs, prim, plan, measured, kept, values, edges, E.filter_recall(prim).drop("n"), levers), F.col("run") == "y")
    root = spark.conf.get("spark.checkpoint.dir") + "/records-test"
    records.record_sink(stored, root)
    records.record_sink(stored, root)  # again: nothing is doubled
    back = records.record_scan(spark, root)
    rows = {r["sample"]: r for r in records.wide_rows(back).collect()}
    assert len(rows) == len(texts) and back.count() == len(texts)
    for i, r in rows.items():
        assert r.run == "xy"[i % 2] and r.length == len(texts[i]) and r.n == len(pieces[i]) and r.selected_apa == got[i, "selected"].apa
        assert (r.control_apa is None) == (r.run == "y") and (r.control_validity is None) == (r.run == "y")
        assert r.num_iterations == 2 and r.best_validity == min(by[i, "a"].validity_score, by[i, "b"].validity_score)
    assert {r.run: r.arms for r in K.arms_present(values.join(seqs, "seq_id").filter("not (grp = 'y' and arm = 'control')").withColumnRenamed("grp", "run"), ["run"]).collect()} == {"x": K.ARMS, "y": [a for a in K.ARMS if a != "control"]}
    bare = back
    for arm in K.ARMS:
        bare = bare.withColumn(f"{arm}_metrics", F.lit(None).cast(records.METRIC_STRUCT))
    for r in records.backfill_similarity(bare).collect():
        assert abs(r.ceiling - got[r["sample"], "ceiling"].edit_similarity) < 1e-6 and abs(r.baseline - got[r["sample"], "baseline"].edit_similarity) < 1e-6
    tried = plan.filter("arm = 'control'").join(seqs, "seq_id").select(F.lit("all").alias("run"), "seq_id", "iteration", levers.alias("levers"))
    moves = {r.lever: r for r in K.lever_behaviour(tried, ["run"]).collect()}
    n = len(texts)
    assert (moves["mode"].changes, moves["mode"].steps, moves["mode"].counts) == (n, n, {"greedy": n, "beam": n}) and moves["width"].change_share == 1.0 and moves["width"].counts == {"2": n}


def test_pooled_concordance_counts_all_pairs(spark):
    draw = random.Random(2)
    rows = [("g", float(draw.randrange(30)), float(draw.randrange(6))) for _ in range(300)] + [("g", float("inf"), 1.0), ("g", float("nan"), 1.0), ("h", 1.0, 1.0)]
    got = M.pooled_concordance(spark.createDataFrame(rows, "k string, validity double, quality double"), "k").collect()
    usable = [(v, q) for k, v, q in rows if k == "g" and abs(v) < float("inf")]
    pairs = [q > s for v, q in usable for w, s in usable if v < w and q != s]
    assert [(r.k, r.pairs) for r in got] == [("g", len(pairs))] and abs(got[0].concordance - sum(pairs) / len(pairs)) < 1e-12
