"""Candidate orderings of every sequence: many lever settings searched over one table of scores, judged by validity,
and the arms that are made of them.

A sequence's pairs are a matrix in its row, with the scores of all windows, and every setting is a fold over that row.
Validity needs the same matrix and is computed in the row as well. From whole sequences (matrix_rows) no pair ever
moves; tables of pairs that come from elsewhere are gathered once (score_table, gathered).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.rounding import settle
from sparkweave.operators import batches as B
from sparkweave.operators import edges as E
from sparkweave.operators import metrics as M
from sparkweave.operators import scoring as C
from sparkweave.operators import search as O
from sparkweave.operators.segment import draw, let

#: A lever setting: the window of scoring, beam or greedy search, and what a confirmed edge counts for.
SETTING = "struct<combo:string,window:int,mode:string,width:int,edges:string,bonus:double>"

METRICS = ["exact_match", "similarity", "edit_similarity", "apa", "lcr", "tau"]

#: Arms in the order of the ladder.
ARMS = ["baseline", "first", "control", "selected", "ceiling"]


def score_table(prim: DataFrame, edges: DataFrame, model: DataFrame, windows: Sequence[int], k: int = 2) -> DataFrame:
    """seq_id, i, j, scores (one for each window), confirmed, impossible, of all ordered pairs."""
    at = E.ordered_pairs(prim).select("seq_id", "i", "j", "a", "b", E.impossible(F.col("a"), F.col("b")).alias("impossible"), F.explode(F.sequence(F.lit(0), F.least(F.lit(max(windows)), F.length("b")) - 1)).alias("p"))
    targets = at.select("seq_id", "i", "j", "impossible", "p", F.right(F.concat("a", F.substr("b", F.lit(1), F.col("p"))), F.lit(k)).alias("left"), F.substr("b", F.col("p") + 1, F.lit(1)).alias("target"))
    means = [settle(F.avg(F.when(F.col("p") < w, F.col("logp")))) for w in windows]
    scores = C.with_logp(targets, model, k).groupBy("seq_id", "i", "j", "impossible").agg(F.array(*means).alias("scores"))
    marks = edges.select("seq_id", "i", "j", F.lit(True).alias("confirmed"))
    return scores.join(marks, ["seq_id", "i", "j"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def gathered(scores: DataFrame, prim: DataFrame, edges: DataFrame, windows: Sequence[int]) -> DataFrame:
    """One row for each sequence: n, pieces, starts (places of fragments that begin with M), matrix, incoming, n_edges.

    matrix[i] holds the pairs of fragment i with all others, by place; incoming[j] the sums of scores into j, by window.
    A confirmed pair counts as the sentinel in these sums.
    """
    listed = lambda rows, key, value, name: rows.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias(name))
    lines = scores.groupBy("seq_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "scores", "confirmed", "impossible"))).alias("line"))
    worth = [F.when(F.col("confirmed"), F.lit(E.CONFIRMED_SCORE)).otherwise(F.col("scores")[w]) for w in range(len(windows))]
    sums = scores.groupBy("seq_id", "j").agg(F.array(*(F.round(F.sum(x), 6) for x in worth)).alias("sums"))
    total = edges.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_edges"))
    rows = prim.groupBy("seq_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "fragment"))), lambda x: x["fragment"]).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("fragment").startswith("M"), F.col("idx")))).alias("starts"),
    )
    out = rows.join(listed(lines, "i", "line", "matrix"), "seq_id", "left").join(listed(sums, "j", "sums", "incoming"), "seq_id", "left").join(total, "seq_id", "left")
    return out.withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def log_table(model: DataFrame) -> Column:
    """The log probabilities of all grams of three letters A-Z as one constant array, the back-off where the model has none.

    The model has at most ALPHABET ** 3 rows, whatever the corpus; they pass through the driver, as in a broadcast.
    """
    back = model.sparkSession.range(1).select(C.backoff()).first()[0]
    table = [back] * C.ALPHABET**3
    for gram, logp in model.filter("context rlike '^[A-Z]{2}$' and residue rlike '^[A-Z]$'").select(F.concat("context", "residue"), "logp").collect():
        table[sum((ord(x) - 65) * C.ALPHABET**n for x, n in zip(gram, (2, 1, 0), strict=True))] = logp
    return F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")


def pair_scorer(model: DataFrame, windows: Sequence[int]) -> tuple[Callable[[Column, Column], Column], Callable[[Column, Column], list[Column]]]:
    """Two functions: what scores need of a fragment (its text and place), and the scores of a pair of such, one for each window.

    Residues are the letters A-Z and a context has two of them. Of a pair's targets only the first two depend on both
    fragments, so the rest is summed once for each fragment.
    """
    known = log_table(model)
    code = lambda text, at: F.ascii(F.substr(text, at, F.lit(1))) - 65
    logp = lambda x, y, z: F.get(known, (x * C.ALPHABET + y) * C.ALPHABET + z)
    back = C.backoff()

    def inner(text: Column, w: int) -> Column:
        return sum((F.when(F.length(text) > p, logp(code(text, F.lit(p - 1)), code(text, F.lit(p)), code(text, F.lit(p + 1)))).otherwise(0.0) for p in range(2, w)), F.lit(0.0))

    def fragment(text: Column, place: Column) -> Column:
        size = F.length(text)
        return F.struct(
            place.alias("place"), size.alias("size"), F.when(size > 1, code(text, size - 1)).alias("before"), code(text, size).alias("last"), code(text, F.lit(1)).alias("first"), code(text, F.lit(2)).alias("second"),
            F.array(*(inner(text, w) for w in windows)).alias("inner"), (~F.right(text, F.lit(1)).isin("K", "R")).alias("bad_end"), text.startswith("P").alias("bad_start"),
        )

    def scores(a: Column, b: Column) -> list[Column]:
        one = F.coalesce(logp(a["before"], a["last"], b["first"]), back)
        two = F.when(b["size"] > 1, logp(a["last"], b["first"], b["second"])).otherwise(0.0)
        mean = lambda k, w: settle((one + (two if w > 1 else F.lit(0.0)) + b["inner"][k]) / F.least(F.lit(w), b["size"]))
        return [mean(k, w) for k, w in enumerate(windows)]

    return fragment, scores


def scored_pairs(cut: DataFrame, model: DataFrame, window: int) -> DataFrame:
    """seq_id, i, j, size (of the second fragment) and score of all ordered pairs of whole sequences (seq_id, primary). A map over the rows."""
    fragment, scores = pair_scorer(model, (window,))
    rows = cut.select("seq_id", F.explode(F.array(F.transform("primary", fragment))).alias("fragments"))
    pairs = rows.select("seq_id", "fragments", F.explode("fragments").alias("a")).select("seq_id", "a", F.explode("fragments").alias("b")).filter("a.place <> b.place")
    return pairs.select("seq_id", F.col("a.place").alias("i"), F.col("b.place").alias("j"), F.col("b.size").alias("size"), scores(F.col("a"), F.col("b"))[0].alias("score"))


def ranked_path(cut: DataFrame, model: DataFrame, window: int, path: Column, *more: str) -> DataFrame:
    """more and ranks: of whole sequences (seq_id, primary, edges) an array of rank and confirmed, for each two neighbours of
    path. The rank is 1 plus the first one's successors with a strictly better score. A map: no pair leaves its row."""
    ranks = B.ranks(*B.log_billionths(model, C.backoff()), window)
    return cut.select(*more, "primary", "edges", path.alias("path")).select(*more, ranks("primary", "edges", "path").alias("ranks"))


def neighbours(cut: DataFrame, model: DataFrame, window: int, path: Column, *more: str) -> DataFrame:
    """more, n, realised, total and mean: of whole sequences (primary, edges) the neighbours of path that an edge proves, all
    edges, and the mean score of the other neighbours (null without any). A map: neither a pair nor a row moves."""
    unproved = B.unproved(*B.log_billionths(model, C.backoff()), window)
    rows = cut.select(*more, "primary", "edges", path.alias("path")).select(*more, F.size("path").alias("n"), F.size("edges").cast("long").alias("total"), unproved("primary", "edges", "path").alias("x"))
    mean = F.when(F.col("x.unproved") > 0, F.col("x.total") / 1e6 / F.col("x.unproved"))
    return rows.select(*more, "n", (F.col("x.steps") - F.col("x.unproved")).alias("realised"), "total", mean.alias("mean"))


def rank_means(ranks: Column) -> list[Column]:
    """top1, top3, mrr (null without any) and junctions, as metrics.rank_summary has them, of an array of ranks in a row."""
    n = F.size(ranks)
    mean = lambda value: F.when(n > 0, F.aggregate(ranks, F.lit(0.0), lambda s, x: s + value(x["rank"])) / n)
    within = lambda most: mean(lambda r: (r <= most).cast("double"))
    return [within(1).alias("top1"), within(3).alias("top3"), mean(lambda r: 1 / r).alias("mrr"), n.cast("long").alias("junctions")]


def matrix_rows(cut: DataFrame, model: DataFrame, windows: Sequence[int], *more: str) -> DataFrame:
    """What gathered returns (and more), from whole sequences: seq_id and cut, primary (fragments) and edges. A map over the rows."""
    fragment, scores = pair_scorer(model, windows)

    def line(a: Column) -> Column:
        others = F.filter("fragments", lambda b: b["place"] != a["place"])
        proved = F.transform(F.filter("edges", lambda e: e["i"] == a["place"]), lambda e: e["j"])
        pair = lambda b, mine: F.struct(b["place"].alias("j"), F.array(*scores(a, b)).alias("scores"), F.array_contains(mine, b["place"]).alias("confirmed"), (a["bad_end"] | b["bad_start"]).alias("impossible"))
        return let(proved, lambda mine: F.transform(others, lambda b: pair(b, mine)))

    def incoming(j: Column) -> Column:
        # A line lacks its own fragment, so what follows that one stands a place earlier.
        rest = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i != j)
        into = F.transform(rest, lambda i: F.get(F.get(F.col("matrix"), i), F.when(j < i, j).otherwise(j - 1)))
        worth = lambda x, k: F.when(x["confirmed"], F.lit(E.CONFIRMED_SCORE)).otherwise(x["scores"][k])
        return let(into, lambda pairs: F.array(*(F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + worth(x, k)), 6) for k in range(len(windows)))))

    # Exploding an array of one keeps Spark from computing the array again in each expression that reads it.
    rows = cut.select("seq_id", *more, F.size("primary").alias("n"), F.col("primary").alias("pieces"), "edges", F.explode(F.array(F.transform("primary", fragment))).alias("fragments"))
    rows = rows.select("seq_id", *more, "n", "pieces", F.size("edges").cast("long").alias("n_edges"), F.explode(F.array(F.transform("fragments", line))).alias("matrix"))
    starts = F.filter(F.transform("pieces", lambda x, i: F.when(x.startswith("M"), i)), lambda i: i.isNotNull())
    return rows.select("seq_id", *more, "n", "pieces", starts.alias("starts"), "matrix", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.col("n") - 1), incoming))).alias("incoming"), "n_edges")


def _unused(line: Column, path: Column) -> Column:
    return F.filter(line, lambda x: ~F.array_contains(path, x["j"]))


def _gain(pair: Column, window: Column, bonus: Column) -> Column:
    # Scores are settled to six digits already.
    return F.when(pair["confirmed"], F.round(F.lit(E.CONFIRMED_SCORE) + bonus, 6)).otherwise(F.get(pair["scores"], window))


def _steps(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _line(path: Column) -> Column:
    """The matrix line of the path's last fragment."""
    return F.get(F.col("matrix"), F.element_at(path, F.lit(-1)))


def start(window: Column) -> Column:
    """The fragment that a greedy search starts with: see search.start_fragment."""
    places = F.when(F.size("starts") > 0, F.col("starts")).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    incoming = lambda j: F.coalesce(F.get(F.get(F.col("incoming"), j), window), F.lit(0.0))
    return F.array_min(F.transform(places, lambda j: F.struct(incoming(j).alias("incoming"), j.alias("j"))))["j"]


def greedy(window: Column, bonus: Column) -> Column:
    """struct(path, forced, fell_back, placed): the best unused successor each time, possible before impossible."""

    def step(state: Column, _: Column) -> Column:
        bonus_of = lambda x: F.when(~x["impossible"], bonus).otherwise(0.0)
        best = F.array_min(F.transform(_unused(_line(state["path"]), state["path"]), lambda x: F.struct(x["impossible"].alias("impossible"), (-_gain(x, window, bonus_of(x))).alias("cost"), x["j"].alias("j"))))
        return let(best, lambda b: F.struct(F.concat(state["path"], F.array(b["j"])).alias("path"), (state["forced"] + b["impossible"].cast("int")).alias("forced")))

    found = F.aggregate(_steps(F.lit(2), F.col("n")), F.struct(F.array(start(window)).alias("path"), F.lit(0).alias("forced")), step)
    return let(found, lambda x: F.struct(x["path"].alias("path"), x["forced"].alias("forced"), F.lit(False).alias("fell_back"), F.col("n").alias("placed")))


def beam(window: Column, width: Column, soft: Column, bonus: Column) -> Column:
    """The same of a beam search; see search.beam_order for its rules."""
    places = F.when(F.size("starts") > 0, F.col("starts")).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    first = F.transform(places, lambda i: F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("parent"), i.alias("j"), F.array(i).alias("path")))

    def extend(beams: Column, _: Column) -> Column:
        def of(b: Column, rank: Column) -> Column:
            def open_pairs(line: Column, free: Column) -> Column:
                return F.filter(_unused(line, b["path"]), lambda x: ~x["impossible"] & (free | x["confirmed"]))

            usable = let(_line(b["path"]), lambda line: let(soft | ~F.exists(line, lambda x: x["confirmed"]), lambda free: open_pairs(line, free)))
            return F.transform(usable, lambda x: F.struct(F.round(b["cost"] - _gain(x, window, bonus), 6).alias("cost"), rank.alias("parent"), x["j"].alias("j"), F.concat(b["path"], F.array(x["j"])).alias("path")))

        return let(F.flatten(F.transform(beams, of)), lambda new: F.when(F.size(new) > 0, F.slice(F.array_sort(new), F.lit(1), width)).otherwise(beams))

    partial = F.aggregate(_steps(F.lit(2), F.col("n")), first, extend)[0]["path"]

    def complete(path: Column, _: Column) -> Column:
        following = F.array_min(F.transform(_unused(_line(path), path), lambda x: F.struct((-_gain(x, window, bonus)).alias("cost"), x["j"].alias("j"))))
        return F.concat(path, F.array(following["j"]))

    whole = lambda best: F.aggregate(_steps(F.size(best) + 1, F.col("n")), best, complete)
    return let(partial, lambda best: F.struct(whole(best).alias("path"), F.lit(0).alias("forced"), (F.size(best) < F.col("n")).alias("fell_back"), F.size(best).alias("placed")))


def links() -> Column:
    """The pairs of a row's path, from its matrix; null under two fragments."""
    pair = lambda a, b: F.get(F.get(F.col("matrix"), a), F.when(b < a, b).otherwise(b - 1))
    steps = F.col("n") - 1
    return F.when(F.col("n") > 1, F.zip_with(F.slice("path", F.lit(1), steps), F.slice("path", F.lit(2), steps), pair))


def made() -> Column:
    """The fragments of a row in its path's order, joined."""
    return F.array_join(F.transform("path", lambda i: F.get(F.col("pieces"), i)), "")


def search_all(rows: DataFrame, settings: list[dict], windows: Sequence[int], validity_window: int) -> DataFrame:
    """rows: what gathered returns. seq_id, combo, path, forced, fell_back, placed, reconstruction and the parts of validity.

    settings: dicts with the fields of SETTING. validity_window is one of windows, as is each setting's.
    """

    def candidate(s: dict) -> Column:
        window, soft = F.lit(list(windows).index(s["window"])), F.lit(s["edges"] == "soft")
        bonus = F.lit(float(s["bonus"]) if s["edges"] == "soft" else 0.0)
        found = beam(window, F.lit(s["width"]), soft, bonus) if s["mode"] == "beam" else greedy(window, bonus)
        return F.struct(F.lit(s["combo"]).alias("combo"), found.alias("found"))

    each = rows.select("seq_id", "n", "n_edges", "matrix", "pieces", F.explode(F.array(*map(candidate, settings))).alias("c"))
    each = each.select("seq_id", "n", "n_edges", "matrix", "pieces", "c.combo", "c.found.*")
    each = each.withColumn("links", links())
    open_scores = F.transform(F.filter("links", lambda x: ~x["confirmed"]), lambda x: x["scores"][list(windows).index(validity_window)])
    mean = F.when(F.size(open_scores) > 0, F.aggregate(open_scores, F.lit(0.0), lambda a, x: a + x) / F.size(open_scores)).otherwise(0.0)
    realised = F.size(F.filter("links", lambda x: x["confirmed"]))
    each = each.withColumn("mean_lp", F.when(F.col("n") >= 2, settle(mean))).withColumn("agreement", F.when((F.col("n") >= 2) & (F.col("n_edges") > 0), realised / F.col("n_edges")))
    return each.select("seq_id", "combo", "path", "forced", "fell_back", "placed", made().alias("reconstruction"), *C.blended_validity(F.col("mean_lp"), F.col("agreement")))


def search_rows(cut: DataFrame, model: DataFrame, settings: list[dict], windows: Sequence[int], validity_window: int) -> DataFrame:
    """What search_all returns, from whole sequences: seq_id, primary (fragments) and edges. Searched a batch of rows at a time."""
    search = B.found(*B.log_billionths(model, C.backoff()), settings, windows, validity_window, made=True)
    rows = cut.select("seq_id", F.size("edges").alias("n_edges"), search("primary", "edges").alias("found"))
    each = rows.select("seq_id", "n_edges", F.posexplode("found").alias("at", "x"))
    each = each.select("seq_id", F.get(F.array(*(F.lit(s["combo"]) for s in settings)), F.col("at")).alias("combo"), "n_edges", "x.*")
    return each.select("seq_id", "combo", "path", "forced", "fell_back", "placed", F.col("made").alias("reconstruction"), *validity_of(F.size("path"), F.col("n_edges"), F.col))


def validity_of(n: Column, n_edges: Column, found: Callable[[str], Column]) -> list[Column]:
    """What scoring.blended_validity gives of a search (batches.FOUND) of n fragments."""
    mean = F.when(found("unproved") > 0, found("total") / 1e6 / found("unproved")).otherwise(0.0)
    return C.blended_validity(F.when(n >= 2, settle(mean)), F.when((n >= 2) & (n_edges > 0), found("realised") / n_edges))


def measured_rows(cut: DataFrame, model: DataFrame, settings: list[dict], windows: Sequence[int], validity_window: int, random: int) -> DataFrame:
    """cut without edges, with n, n_edges and candidates: path, validity_score and all metrics of each setting and, last and
    without a validity, of the order of the seed random. cut holds whole sequences (search_rows); nothing moves."""
    search = B.found(*B.log_billionths(model, C.backoff()), settings, windows, validity_window, random=random)
    others = [c for c in cut.columns if c != "edges"]
    rows = cut.select(*others, F.size("primary").alias("n"), F.size("edges").cast("long").alias("n_edges"), search("primary", "edges", "seq_id").alias("found"))

    def candidate(x: Column, k: Column) -> Column:
        validity = validity_of(F.col("n"), F.col("n_edges"), lambda name: x[name])[0]
        return F.struct(x["path"].alias("path"), F.when(k < len(settings), F.round(validity, 6)).alias("validity_score"), *(x[m].alias(m) for m in METRICS))

    return rows.select(*others, "n", "n_edges", F.transform("found", candidate).alias("candidates"))


def control_plan(combos: Sequence[str], default: str, iterations: int, seed: int) -> Column:
    """search.random_lever_plan of a row with seq_id: the combos of all iterations in turn, as an array."""
    drawn = F.array_sort(F.array(*(F.struct(draw(seed, F.col("seq_id"), F.lit(c)).alias("draw"), F.lit(c).alias("combo")) for c in combos if c != default)))
    return F.concat(F.array(F.lit(default)), F.transform(F.slice(drawn, 1, iterations - 1), lambda x: x["combo"]))


def with_arms(rows: DataFrame, combos: Sequence[str], plans: dict[str, Column]) -> DataFrame:
    """rows: what measured_rows returns. Adds, for each arm of plans (selected and control; the combos that it tries), history
    (iteration, combo and the candidate) and kept (the earliest candidate of the least validity), and arms: arm and all
    metrics of the five arms, in order. A map: see chosen and arm_values."""
    names = F.array(*map(F.lit, combos))
    fields = ["path", "validity_score", *METRICS]
    attempt = lambda c, i: let(F.get("candidates", F.array_position(names, c).cast("int") - 1), lambda x: F.struct((i + 1).alias("iteration"), c.alias("combo"), *(x[f].alias(f) for f in fields)))
    # Exploding an array of one keeps Spark from repeating what several columns read.
    tried = F.struct(*(F.transform(plan, attempt).alias(arm) for arm, plan in plans.items()))
    rows = rows.select("*", F.explode(F.array(tried)).alias("history"))
    least = lambda arm: F.array_min(F.transform(F.col("history")[arm], lambda x: F.struct(x["validity_score"].alias("score"), x["iteration"].alias("iteration"))))["iteration"]
    kept = F.struct(*(F.get(F.col("history")[arm], least(arm) - 1).alias(arm) for arm in plans))
    rows = rows.select("*", F.explode(F.array(kept)).alias("kept"))
    finite = lambda m: F.array_max(F.filter(F.transform(F.col("history.selected"), lambda x: x[m]), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    of = lambda arm, x: F.struct(F.lit(arm).alias("arm"), *(x[m].alias(m) for m in METRICS))
    five = [of(ARMS[0], F.get("candidates", F.lit(len(combos)))), of(ARMS[1], F.get(F.col("history.selected"), F.lit(0))), of(ARMS[2], F.col("kept.control")), of(ARMS[3], F.col("kept.selected"))]
    return rows.withColumn("arms", F.array(*five, F.struct(F.lit(ARMS[4]).alias("arm"), *(finite(m).alias(m) for m in METRICS))))


def path_metrics(candidates: DataFrame, seqs: DataFrame, prim: DataFrame) -> DataFrame:
    """candidates: seq_id, combo, path, reconstruction. Adds all metrics; equal paths of a sequence are measured once."""
    same = candidates.groupBy("seq_id", "path").agg(F.min("combo").alias("combo"), F.first("reconstruction").alias("reconstruction"), F.collect_list("combo").alias("combos"))
    keyed = same.withColumn("key", F.struct("seq_id", "combo"))
    pieces = prim.select("seq_id", "idx", "fragment")
    predicted = keyed.select("key", "seq_id", F.posexplode("path").alias("place", "idx")).join(pieces, ["seq_id", "idx"]).select(F.col("key").alias("seq_id"), "place", "fragment")
    true = keyed.select("key", "seq_id").join(pieces, "seq_id").select(F.col("key").alias("seq_id"), F.col("idx").alias("place"), "fragment")
    targets = keyed.select("key", "seq_id").join(seqs.select("seq_id", "seq"), "seq_id").select(F.col("key").alias("seq_id"), "seq")
    found = M.compute_all(targets, predicted, true, keyed.select(F.col("key").alias("seq_id"), "reconstruction"))
    measured = found.select(F.col("seq_id.seq_id").alias("seq_id"), F.col("seq_id.combo").alias("least"), *(settle(m).alias(m) for m in METRICS))
    members = keyed.select("seq_id", F.col("combo").alias("least"), F.explode("combos").alias("combo"))
    return candidates.join(members.join(measured, ["seq_id", "least"]).drop("least"), ["seq_id", "combo"])


def measured_in_rows(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """The same from whole sequences, rows: seq_id, seq and primary (the fragments in order). Orders are compared inside the row."""
    same = candidates.join(rows.select("seq_id", "seq", "primary"), "seq_id").groupBy("seq_id", "path").agg(
        F.first("reconstruction").alias("reconstruction"), F.first("seq").alias("seq"), F.first("primary").alias("true"), F.collect_list(F.struct(*(c for c in candidates.columns if c not in ("seq_id", "path", "reconstruction")))).alias("c")
    )
    found = M.order_metrics(same.withColumn("predicted", F.transform("path", lambda i: F.get("true", i))))
    each = found.select("seq_id", "path", "reconstruction", F.explode("c").alias("c"), *(settle(m).alias(m) for m in METRICS))
    return each.select("seq_id", "c.combo", *(f"c.{c}" if c not in ("path", "reconstruction") else c for c in candidates.columns if c not in ("seq_id", "combo")), *METRICS)


def chosen(plan: DataFrame, candidates: DataFrame, margin: float = 0.0, patience: int | None = None) -> DataFrame:
    """plan: seq_id, arm, iteration, combo. seq_id, arm, iteration, combo, validity_score of the candidate that each arm keeps."""
    tried = plan.join(candidates.select("seq_id", "combo", "validity_score"), ["seq_id", "combo"])
    best = O.select_best(tried.select(F.struct("seq_id", "arm").alias("sample"), "iteration", F.col("validity_score").alias("score")), margin, patience)
    best = best.select("sample.*", F.col("best_iteration").alias("iteration"), "used")
    return tried.join(best, ["seq_id", "arm", "iteration"])


def arm_values(plan: DataFrame, candidates: DataFrame, kept: DataFrame, guided: str = "selected", control: str = "control", random: str = "random") -> DataFrame:
    """seq_id, arm and all metrics: five rows for each sequence.

    candidates: with metrics, the combo named random being the baseline's order. first is the guided arm's first
    candidate, ceiling the best value of each metric among the guided arm's candidates.
    """
    of = lambda rows, arm: rows.select("seq_id", F.lit(arm).alias("arm"), *METRICS)
    measured = candidates.select("seq_id", "combo", *METRICS)
    mine = plan.filter(F.col("arm") == guided).join(measured, ["seq_id", "combo"])
    best = kept.select("seq_id", "arm", "combo").join(measured, ["seq_id", "combo"])
    top = O.ceiling(mine.withColumnRenamed("seq_id", "sample"), METRICS).withColumnRenamed("sample", "seq_id")
    parts = [of(measured.filter(F.col("combo") == random), ARMS[0]), of(mine.filter("iteration = 1"), ARMS[1]), of(best.filter(F.col("arm") == control), ARMS[2]), of(best.filter(F.col("arm") == guided), ARMS[3]), of(top, ARMS[4])]
    return reduce(DataFrame.unionByName, parts)


def long_values(values: DataFrame) -> DataFrame:
    """seq_id, arm, metric, value."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return values.select(*(c for c in values.columns if c not in METRICS), F.explode(pairs).alias("x")).select("*", "x.metric", "x.value").drop("x")


def arms_present(values: DataFrame, by: list[str]) -> DataFrame:
    """by and arms: those with any value, in the order of the ladder."""
    used = F.greatest(*(F.col(m).isNotNull() for m in METRICS))
    marks = values.groupBy(*by).agg(*(F.bool_or((F.col("arm") == arm) & used).alias(arm) for arm in ARMS))
    return marks.select(*by, F.filter(F.array(*(F.when(F.col(arm), F.lit(arm)) for arm in ARMS)), lambda x: x.isNotNull()).alias("arms"))


def lever_behaviour(tried: DataFrame, by: list[str]) -> DataFrame:
    """tried: by, seq_id, iteration, levers (map). by, lever, changes, steps, change_share, n_values, counts (map of value to iterations).

    Levers are exploded once. A step is an iteration after a sample's first; it changes a lever whose value differs from
    the one before, a lever that one of them lacks included.
    """
    pairs = tried.select(*by, "seq_id", F.array_sort(F.transform(F.map_entries("levers"), lambda e: e["key"])).alias("names"), "iteration", "levers")
    gathered = pairs.groupBy(*by, "seq_id").agg(F.array_sort(F.collect_list(F.struct("iteration", F.map_entries("levers").alias("levers")))).alias("h"))
    h = F.transform("h", lambda x: F.map_from_entries(x["levers"]))
    steps = F.size("h") - 1
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda x: F.transform(x["levers"], lambda e: e["key"])))))
    rows = gathered.select(*by, steps.alias("steps"), h.alias("h"), F.explode(names).alias("lever"))
    values = F.transform("h", lambda m: F.try_element_at(m, F.col("lever")))
    moved = F.zip_with(F.slice("v", F.lit(1), F.col("steps")), F.slice("v", F.lit(2), F.col("steps")), lambda a, b: (~a.eqNullSafe(b)).cast("int"))
    rows = rows.withColumn("v", values).withColumn("changes", F.when(F.col("steps") > 0, F.aggregate(moved, F.lit(0), lambda a, x: a + x)).otherwise(0))
    shares = rows.groupBy(*by, "lever").agg(F.sum("changes").alias("changes"), F.sum("steps").alias("steps"))
    counts = rows.select(*by, "lever", F.explode("v").alias("value")).filter("value is not null").groupBy(*by, "lever", "value").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(*by, "lever").agg(F.count(F.lit(1)).alias("n_values"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))
    return shares.join(listed, [*by, "lever"]).withColumn("change_share", F.when(F.col("steps") > 0, F.col("changes") / F.col("steps")))
