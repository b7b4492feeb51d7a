"""What is computed a batch of rows at a time, against the expressions in a row and against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import batches as B
from sparkweave.operators import candidates as K
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import scoring as C
from sparkweave.operators import segment as S
from sparkweave.sources import sequences as Q
from sparkweave.sources.sequences import once

WINDOWS = (1, 3, 5)
SETTINGS = [
    {"combo": f"{mode}{edges}{window}", "window": window, "mode": mode, "width": width, "edges": edges, "bonus": 0.5}
    for mode, edges, window, width in (("greedy", "hard", 1, 9), ("greedy", "soft", 3, 9), ("beam", "hard", 5, 1), ("beam", "soft", 3, 3), ("beam", "hard", 1, 25))
]


@pytest.fixture(scope="module")
def rows(spark):
    """Sequences of few letters, so that fragments, edges and scores repeat; among them long, one-fragment and unstarted ones."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("AKRMPKKR") for _ in range(draw.randrange(1, 70))) for _ in range(150)] + ["M", "K", "KKKK", "AKAKAKAKAK", "MAK" * 9, "KP" * 20, "".join(draw.choice("AGKRLM") for _ in range(400))]
    seqs = spark.createDataFrame([(i - 3, "xy"[i % 2], t) for i, t in enumerate(texts)], "seq_id long, grp string, seq string")
    return once(seqs.repartition(3).withColumn("cut", B.cut_and_proved(0.3, 3, 42)("seq_id", "seq")).select("seq_id", "grp", "seq", "cut.primary", "cut.edges"), "rows")


def test_cuts_and_edges_are_those_of_the_rows(rows):
    primary = F.col("pieces")[0]
    wanted = S.cut_rows(rows.select("seq_id", "grp", "seq")).select("seq_id", primary.alias("primary"), E.edges_of(primary, F.array_distinct(F.flatten("pieces"))).alias("edges"))
    ordered = lambda df: sorted(map(tuple, df.select("seq_id", "primary", F.array_sort("edges")).collect()))
    assert ordered(rows) == ordered(wanted) and rows.filter("size(edges) > 2").count() > 20


def test_searches_are_those_of_the_rows(rows):
    model = once(C.residue_model(rows), "model")
    wanted = K.search_all(K.matrix_rows(rows, model, WINDOWS), SETTINGS, WINDOWS, 5)
    found = K.search_rows(rows, model, SETTINGS, WINDOWS, 5)
    columns = [c for c in wanted.columns if c != "forced"] + ["forced"]
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(map(tuple, wanted.select(columns).collect()), key=str)
    starts = rows.select("seq_id", B.started(*B.log_billionths(model, C.backoff()), 3)("primary", "edges").alias("start"))
    assert sorted(map(tuple, starts.collect())) == sorted(map(tuple, K.matrix_rows(rows, model, (3,)).select("seq_id", K.start(F.lit(0))).collect()))


def test_searches_without_a_matrix_find_the_same(rows, monkeypatch):
    """Above MATRIX fragments lines are scored when the search stands on them; tiles may hold one sequence."""
    table = (-np.random.default_rng(1).random(B.LETTERS**3) * 40).astype(np.int64) * 100_000_000
    got = rows.collect()
    primary, edges = pa.array([r.primary for r in got]), pa.array([[e.asDict() for e in r.edges] for r in got], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))
    search = B.found(table, -3_258_096_538, SETTINGS, WINDOWS, 3, made=True).func
    wanted = search(primary, edges).to_pylist()
    monkeypatch.setattr(B, "MATRIX", 1)
    assert search(primary, edges).to_pylist() == wanted
    monkeypatch.setattr(B, "TILE", 1)
    assert search(primary, edges).to_pylist() == wanted
    assert search(primary.slice(5, 40), edges.slice(5, 40)).to_pylist() == wanted[5:45] and search(primary[:0], edges[:0]).to_pylist() == []


def test_metrics_are_those_of_the_rows(rows):
    model = C.residue_model(rows)
    search = B.found(*B.log_billionths(model, C.backoff()), SETTINGS, WINDOWS, 3, made=True, random=7)
    each = rows.select("seq_id", F.posexplode(search("primary", "edges", "seq_id")).alias("combo", "x")).select("seq_id", F.col("combo").cast("string").alias("combo"), "x.*")
    each = once(each, "each")
    wanted = {(r.seq_id, r.combo): r for r in K.measured_in_rows(each.select("seq_id", "combo", "path", F.col("made").alias("reconstruction")), rows).collect()}
    for r in each.collect():
        want = wanted.pop((r.seq_id, r.combo))
        assert [r[m] for m in K.METRICS] == pytest.approx([want[m] for m in K.METRICS], abs=2e-6), r
    assert not wanted
    drawn = rows.select("seq_id", S.shuffled(F.col("primary"), 7, F.col("seq_id")).alias("p")).select("seq_id", F.transform("p", lambda x: x["idx"]).alias("path"))
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, each.filter(f"combo = '{len(SETTINGS)}'").select("seq_id", "path").collect()))


def test_edit_distances_against_brute_force(spark):
    draw = random.Random(3)
    pairs = [("".join(draw.choice("ABC") for _ in range(n)), "".join(draw.choice("ABC") for _ in range(n))) for n in (1, 2, 63, 64, 65, 127, 128, 129, 200, 7, 7, 64)]

    def brute(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, last = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
        return line[-1]

    codes = [np.array([ord(x) - 65 for p in pairs for x in p[k]], np.int64) for k in (0, 1)]
    sizes = np.array([len(a) for a, _ in pairs])
    assert B.distances(sizes, codes[0], sizes, codes[1]).tolist() == [brute(a, b) for a, b in pairs]
    texts, targets = [["ABCÉ", None, "", "x" * 130 + "y"], None, ["same", "Same"], ["", "a"], ["a"]], ["ABÉ", "AB", "same", "", None]
    got = B.similarities().func(pa.array(texts, pa.list_(pa.string())), pa.array(targets)).to_pylist()
    wanted = [[None if a is None or t is None else 1.0 if a == t else 1 - brute(a, t) / max(len(a), len(t)) for a in x or []] for x, t in zip(texts, targets)]
    assert got == wanted


def test_grams_and_runs(spark):
    texts = ["ABABAB", "AB", "", None, "ABÉAB", "BAB"]
    rows = B.gram_counts(spark.createDataFrame([(t,) for t in texts], "seq string")).groupBy("gram").sum("n").collect()
    assert dict(map(tuple, rows)) == {"ABA": 2, "BAB": 3, "ABÉ": 1, "BÉA": 1, "ÉAB": 1}
    spaced = "a1b\x0bc\x1cd e f\tG\r\n"
    got = spark.createDataFrame([(spaced,), ("",), (None,), (" \t",)], "text string").select(Q.letters_of_runs(2)("text").alias("runs")).collect()
    assert [r.runs for r in got] == [["ABCD", "EFG"], [], [], []]


def test_ranks_and_true_orders_need_no_folds(rows):
    """m16's parts: the true order as recover_true_order finds it, and each true neighbour's rank by brute force."""
    prim = rows.select("seq_id", F.posexplode("primary").alias("idx", "fragment"))
    wanted = M.recover_true_order(rows.select("seq_id", "seq"), prim)
    found = M.true_order_in_row(rows.select("seq_id", "primary"))
    assert sorted(map(tuple, found.select("seq_id", "path").collect())) == sorted(map(tuple, wanted.select("seq_id", "path").collect()))
    model = once(C.residue_model(rows), "model")
    matrix = {r.seq_id: r.matrix for r in K.matrix_rows(rows, model, (3,)).collect()}
    ranked = K.ranked_path(rows, model, 3, F.sequence(F.lit(0), F.size("primary") - 1), "seq_id")
    assert "aggregate(" not in ranked._jdf.queryExecution().executedPlan().toString()
    for r in ranked.collect():
        lines = [{x.j: x for x in line} for line in matrix[r.seq_id]]
        brute = [(1 + sum(x.scores[0] > lines[i][i + 1].scores[0] for x in lines[i].values()), lines[i][i + 1].confirmed) for i in range(len(lines) - 1)]
        assert [tuple(x) for x in r.ranks] == brute
