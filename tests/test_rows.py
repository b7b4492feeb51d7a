"""What is computed in the rows of sequences, against the tables of fragments, and queries that return all of their rows."""

import re

import pytest
from pyspark.sql import functions as F

from sparkweave import registry
from sparkweave.operators import candidates as K
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import scoring as C
from sparkweave.operators import segment as S
from sparkweave.queries import candidate_queries, metric_queries
from sparkweave.sources import sequences as Q

TEXTS = ["Make kernels KRILL Moku RAKP " * 12, "krab keep kale rust mork risk " * 9, "Plain text without much", "", None, "K", "MK MK R"]


def documents(spark, folder):
    rows = [(i, text, "en" if i % 2 else None) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def fragments(spark, d):
    s = Q.sequences(Q.table(spark, d, "documents"))
    return s, S.segment(s, "trypsin", 0.3, 3, 42), S.cut_rows(s, "trypsin", 0.3, 3, 42)


def test_targets_are_returned_row_by_row(spark, tmp_path):
    d = documents(spark, tmp_path)
    _, f, _ = fragments(spark, d)
    wanted = C.junction_targets(E.ordered_pairs(S.primary(f)), 3)
    found = registry.queries()["sc1_junction_targets"](spark, d)
    assert found.columns == ["seq_id", "i", "j", "p", "left", "right", "target"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_pairs_in_rows_are_those_of_the_tables(spark, tmp_path):
    _, f, cut = fragments(spark, documents(spark, tmp_path))
    pairs = E.pairs_in_rows(cut)
    assert sorted(map(tuple, pairs.select("seq_id", "i", "j", "a", "b").collect())) == sorted(map(tuple, E.ordered_pairs(S.primary(f)).select("seq_id", "i", "j", "a", "b").collect()))
    edges = E.confirmed_edges(f).filter("i <> j")
    assert sorted(map(tuple, pairs.filter("confirmed").select("seq_id", "i", "j").collect())) == sorted(map(tuple, edges.collect()))
    assert edges.count() > 0


def moves(spark, df):
    """What is dealt by more than a sequence's number, or in how many steps: the exchanges of the plan that carry rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_pairs_are_scored_and_grouped_without_moving(spark, tmp_path):
    """No query deals pairs: scores need no exchange, and what groups them deals sequences once."""
    d = documents(spark, tmp_path)
    q = registry.queries()
    for name in ("sc3_score_pairs", "sc8_two_sided", "sc9_first_residue_probability", "j7_confirmed_agreement", "j8_unconfirmed_junctions", "m2_qgram_similarity", "m8_compute_all", "sg9_shuffle_fragments", "sg11_multi_rule", "sg12_assemble_records"):
        assert not [x for x in moves(spark, q[name](spark, d)) if "hashpartitioning(seq_id#" not in x or ", j#" in x], name
    for name in ("o1_start_fragment", "o2_greedy_order", "o3_beam_order_soft", "m9_junction_ranking"):
        assert not [x for x in moves(spark, q[name](spark, d)) if "j#" in x and "seq_id" in x and "idx" not in x], name


def test_scores_in_rows_are_those_of_the_tables(spark, tmp_path):
    d = documents(spark, tmp_path)
    s, f, cut = fragments(spark, d)
    model, pairs = C.residue_model(s), E.ordered_pairs(S.primary(f))
    for window in (1, 3, 5):
        wanted = C.score_pairs(C.junction_targets(pairs, window), model)
        found = C.with_mean(E.pairs_in_rows(cut), model, C.junction_grams(window)).select("seq_id", "i", "j", "score")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    wanted = C.score_pairs(C.two_sided_targets(pairs), model)
    assert sorted(map(tuple, C.with_mean(E.pairs_in_rows(cut), model, C.two_sided_grams()).select("seq_id", "i", "j", "score").collect())) == sorted(map(tuple, wanted.collect()))


def test_orders_in_rows_are_measured_as_in_tables(spark, tmp_path):
    d = documents(spark, tmp_path)
    s, f, cut = fragments(spark, d)
    prim = S.primary(f)
    order = S.shuffle_fragments(prim, 7)
    predicted, true = order.select("seq_id", "place", "fragment"), prim.select("seq_id", F.col("idx").alias("place"), "fragment")
    rows = metric_queries.order_rows(spark, d)
    wanted = M.compute_all(s.select("seq_id", "seq"), predicted, true, rows.select("seq_id", "reconstruction"))
    names = ["seq_id", "exact_match", "similarity", "edit_similarity", "apa", "lcr", "tau"]
    found = {r.seq_id: r for r in M.order_metrics(rows).select(names).collect()}
    for r in wanted.select(names).collect():
        assert tuple(found.pop(r.seq_id)) == pytest.approx(tuple(r))
    assert not found
    edges, steps = E.confirmed_edges(f), E.order_in_row(cut)
    wanted = E.confirmed_agreement(order.select("seq_id", "place", "idx"), edges)
    assert sorted(map(str, steps.select("seq_id", *E.agreement_in_row()).collect())) == sorted(map(str, wanted.select("seq_id", "realised", "total", "agreement").collect()))


def test_edges_of_a_table_keep_its_places(spark):
    rows = [(1, 0, 4, "AK"), (1, 0, 7, "BR"), (1, 0, 9, "AK"), (1, 1, 0, "AKBR"), (1, 1, 1, "BRAK"), (2, 0, 0, "CK"), (2, 1, 0, "AKBR")]
    found = E.confirmed_edges(spark.createDataFrame(rows, "seq_id long, replica int, pos int, fragment string"))
    assert sorted(map(tuple, found.collect())) == [(1, 7, 9), (1, 9, 7)]


def test_lever_tables_need_no_search(spark, tmp_path, monkeypatch):
    d = documents(spark, tmp_path)
    monkeypatch.setattr(candidate_queries, "found_candidates", None)
    q = registry.queries()
    assert q["a37_distinct_settings"](spark, d).count() == 5 and q["a15_lever_behaviour"](spark, d).count() > 0


@pytest.mark.parametrize("name", ["o1_start_fragment", "o2_greedy_order", "o3_beam_order_soft", "o4_beam_order_hard_fallback", "o5_reconstruct", "o6_search_diagnostics"])
def test_searches_deal_the_sequences_once_and_nothing_else(spark, name):
    from sparkweave.queries import searches

    plan = getattr(searches, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_in_rows_are_those_of_the_tables(spark, tmp_path):
    """Pairs are ranked in the row of a sequence; the table of pairs is neither sorted nor dealt nor written."""
    d = documents(spark, tmp_path)
    s, f, cut = fragments(spark, d)
    prim, edges, model = S.primary(f), E.confirmed_edges(f), C.residue_model(s)
    scores = C.score_pairs(C.junction_targets(E.ordered_pairs(prim), 3), model)
    wanted = M.sample_diagnostics(s, prim, scores, edges).select("seq_id", "fragments", "recovered", F.round("top1", 6), F.round("top3", 6), F.round("mrr", 6), "junctions", "excluded", F.round("recall", 6), "pruned_total")
    found = registry.queries()["m16_sample_diagnostics"](spark, d)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    true = E.consecutive(prim.select("seq_id", F.col("idx").alias("place"), "idx")).select("seq_id", "i", "j")
    wanted = M.junction_ranking(scores, true, edges).select("seq_id", F.round("top1", 6), F.round("top3", 6), F.round("mrr", 6), "junctions")
    assert sorted(map(tuple, registry.queries()["m9_junction_ranking"](spark, d).collect())) == sorted(map(tuple, wanted.collect()))
    for name in ("m9_junction_ranking", "a13_junction_ranking_summary", "m16_sample_diagnostics"):
        df = registry.queries()[name](spark, d)
        assert "Window" not in plan(df) and "Join" not in plan(df), name
        assert len(moves(spark, df)) <= 1, name


def test_scores_of_pairs_need_no_join(spark, tmp_path):
    d = documents(spark, tmp_path)
    for name in ("sc3_score_pairs", "sc10_length_weighted_mean"):
        assert "Join" not in plan(registry.queries()[name](spark, d)), name


def test_local_scores_are_made_in_the_rows(spark, tmp_path):
    """Neighbours are scored in the row of a sequence: nothing is joined, grouped or dealt after the sequences."""
    d = documents(spark, tmp_path)
    s, f, cut = fragments(spark, d)
    prim, edges, model = S.primary(f), E.confirmed_edges(f), C.residue_model(s)
    order = E.order_in_row(cut).select("seq_id", F.posexplode(F.transform("placed", lambda x: x["idx"])).alias("place", "idx"))
    left = E.unconfirmed_junctions(order, edges).join(E.ordered_pairs(prim), ["seq_id", "i", "j"])
    scores = C.score_pairs(C.junction_targets(left, 5), model)
    wanted = C.junction_local_logprob(scores, prim.groupBy("seq_id").agg(F.count("idx").alias("n")))
    found = registry.queries()["sc5_junction_local_logprob"](spark, d)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    agreement = E.confirmed_agreement(order, edges).select("seq_id", "agreement")
    blended = registry.queries()["sc6_blended_validity"](spark, d)
    assert sorted(map(tuple, blended.select("seq_id", "agreement").collect())) == sorted(map(tuple, agreement.collect()))
    for name in ("sc5_junction_local_logprob", "sc6_blended_validity"):
        df = registry.queries()[name](spark, d)
        assert "Aggregate" not in plan(df) and "Join" not in plan(df) and len(moves(spark, df)) == 1, name


def test_searches_of_long_sequences_are_quadratic_only(spark):
    """A pair that comes into a fragment is looked up by its place, not searched for in the whole matrix."""
    cut = spark.createDataFrame([(1, ["MAK", "GGR", "PPE"], [(0, 1)]), (2, ["K"], [])], "seq_id long, primary array<string>, edges array<struct<i:int,j:int>>")
    model = C.residue_model(spark.createDataFrame([("MAKGGRPPEMAKGG",)], "seq string"))
    rows = K.matrix_rows(cut, model, (1, 3))
    for row in rows.collect():
        for j, sums in enumerate(row.incoming):
            into = [x for line in row.matrix for x in line if x.j == j]
            assert sums == [round(sum(1000.0 if x.confirmed else x.scores[w] for x in into), 6) for w in range(2)]
    assert plan(rows).count("flatten(") == 0


def test_edges_of_a_table_move_sequences_once(spark, tmp_path):
    d = documents(spark, tmp_path)
    found = registry.queries()["j1_confirmed_edges_of_a_table"](spark, d)
    assert len(moves(spark, found)) == 1 and "sequences-" not in plan(found) and "fragments-" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, registry.queries()["j1_confirmed_edges"](spark, d).collect()))


def test_fragment_lines_are_compressed(spark, tmp_path):
    _, f, cut = fragments(spark, documents(spark, tmp_path))
    records = S.records_in_rows(cut, 42)
    Q.fragment_jsonl_sink(records, str(tmp_path / "lines"))
    parts = [p.name for p in (tmp_path / "lines").glob("part-*")]
    assert parts and all(p.endswith(".json.gz") for p in parts)
    back = Q.fragment_jsonl_scan(spark, str(tmp_path / "lines"))
    assert sorted(map(str, back.collect())) == sorted(map(str, records.select(*back.columns).collect()))


def test_orders_alone_need_no_grams(spark, tmp_path):
    rows = M.order_metrics(metric_queries.order_rows(spark, documents(spark, tmp_path)))
    assert "grams_shared" not in plan(rows.select("apa", "lcr", "tau")) and "orders_compared" not in plan(rows.select("similarity"))


def test_runs_of_words(spark):
    texts = ["a1 b\tc\n d e " * 31, " \r\n x", "", None, "1 2 3", "y" * 3 + " 4" * 45 + " z"]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    wanted = []
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        for run in range(0, len(words), 20):
            letters = "".join(x for x in "".join(words[run : run + 20]) if x.isascii() and x.isalpha()).upper()
            if letters:
                wanted.append((i * 1_000_000 + run // 20, i, letters))
    assert sorted(map(tuple, Q.sequences(rows).select("seq_id", "doc_id", "seq").collect())) == wanted
