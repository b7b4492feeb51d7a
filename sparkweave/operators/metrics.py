"""Metrics of a predicted ordering against the true one, and of candidate rankings."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.operators import batches as B
from sparkweave.operators import edges as E
from sparkweave.operators.ranges import pair_orders
from sparkweave.operators.segment import let


def exact_match(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def qgram_similarity(rows: DataFrame, q: int = 3) -> DataFrame:
    """rows: seq_id, a, b. Twice the shared q-grams (with repeats) over all q-grams of both; 1 if neither has any."""
    grams = lambda c: F.when(F.length(c) >= q, F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda p: F.substr(F.col(c), p, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    both = rows.select("seq_id", F.explode(F.transform(grams("a"), lambda g: F.struct(g.alias("g"), F.lit(1).alias("x"), F.lit(0).alias("y")))).alias("r"))
    both = both.unionByName(rows.select("seq_id", F.explode(F.transform(grams("b"), lambda g: F.struct(g.alias("g"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("r")))
    counts = both.groupBy("seq_id", "r.g").agg(F.sum("r.x").alias("x"), F.sum("r.y").alias("y"))
    shares = counts.groupBy("seq_id").agg((2 * F.sum(F.least("x", "y")) / F.sum(F.col("x") + F.col("y"))).alias("similarity"))
    return rows.select("seq_id").join(shares, "seq_id", "left").select("seq_id", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def recover_true_order(targets: DataFrame, pieces: DataFrame) -> DataFrame:
    """targets: seq_id, seq; pieces: seq_id, idx, fragment. Tiles the target from the left, the longest unused fragment first.

    path is null where the fragments do not tile the target.
    """
    lists = pieces.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("fragment")).alias("cost"), "idx", "fragment"))), lambda x: F.struct(x["idx"].alias("idx"), x["fragment"].alias("fragment"))).alias("f"))
    return targets.select("seq_id", "seq").join(lists, "seq_id").select("seq_id", _tiled().alias("path"))


def _tiled() -> Column:
    """The path of recover_true_order in a row with seq and f, the fragments (idx, fragment) from the longest on."""
    first = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("path"))

    def step(state: Column, _: Column) -> Column:
        fits = F.filter("f", lambda x: ~F.array_contains(state["path"], x["idx"]) & (F.substr(F.col("seq"), state["cursor"] + 1, F.length(x["fragment"])) == x["fragment"]))
        further = lambda x: F.struct((state["cursor"] + F.length(x["fragment"])).alias("cursor"), F.concat(state["path"], F.array(x["idx"])).alias("path"))
        return let(F.get(fits, F.lit(0)), lambda x: F.when(x.isNull(), state).otherwise(further(x)))

    whole = lambda s: (s["cursor"] == F.length("seq")) & (F.size(s["path"]) == F.size("f"))
    return let(F.aggregate("f", first, step), lambda s: F.when(whole(s), s["path"]))


def true_order_in_row(rows: DataFrame) -> DataFrame:
    """Adds path, as recover_true_order finds it, to rows with primary (the fragments in order of idx). A map."""
    return rows.withColumn("path", B.true_orders()("primary"))


def with_text(order: DataFrame, prim: DataFrame) -> DataFrame:
    """order: seq_id, place, idx. Adds the fragment."""
    return order.join(prim.select("seq_id", "idx", "fragment"), ["seq_id", "idx"])


def adjacent_pair_accuracy(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """predicted, true: seq_id, place, fragment. Shared neighbouring pairs (as strings, with repeats) over the true ones; 0 under two fragments."""

    def pairs(rows: DataFrame, x: int, y: int) -> DataFrame:
        following = F.lead("fragment").over(Window.partitionBy("seq_id").orderBy("place"))
        return rows.select("seq_id", F.col("fragment").alias("a"), following.alias("b")).filter("b is not null").select("seq_id", "a", "b", F.lit(x).alias("x"), F.lit(y).alias("y"))

    counts = pairs(predicted, 1, 0).unionByName(pairs(true, 0, 1)).groupBy("seq_id", "a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    shares = counts.groupBy("seq_id").agg((F.sum(F.least("x", "y")) / F.sum("y")).alias("apa"))
    return true.select("seq_id").distinct().join(shares, "seq_id", "left").select("seq_id", F.coalesce("apa", F.lit(0.0)).alias("apa"))


def longest_correct_run(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """The longest block of neighbours that both orders have, over the true length.

    Equal tokens meet by a join; a block is a gap-free run on one diagonal.
    """
    p = predicted.select("seq_id", "fragment", F.col("place").alias("p"))
    t = true.select("seq_id", "fragment", F.col("place").alias("t"))
    sizes = true.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    met = p.join(t, ["seq_id", "fragment"]).withColumn("d", F.col("p") - F.col("t"))
    runs = met.withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy("seq_id", "d").orderBy("p"))).groupBy("seq_id", "d", "island").agg(F.count(F.lit(1)).alias("run"))
    best = runs.groupBy("seq_id").agg(F.max("run").alias("best"))
    return sizes.join(best, "seq_id", "left").select("seq_id", (F.coalesce("best", F.lit(0)) / F.col("n")).alias("lcr"))


def match_occurrences(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """seq_id, p, t: the kth copy of a fragment in one order with its kth copy in the other; copies without a partner are dropped."""
    number = lambda rows, name: rows.select("seq_id", "fragment", F.col("place").alias(name), F.row_number().over(Window.partitionBy("seq_id", "fragment").orderBy("place")).alias("k"))
    return number(predicted, "p").join(number(true, "t"), ["seq_id", "fragment", "k"]).select("seq_id", "p", "t")


def kendall_tau(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """(concordant - discordant) over all pairs of matched places; 0 under two."""
    a, b = matches.withColumnsRenamed({"p": "p1", "t": "t1"}), matches.withColumnsRenamed({"p": "p2", "t": "t2"})
    signs = a.join(b, "seq_id").filter("p1 < p2").groupBy("seq_id").agg((F.sum(F.signum((F.col("t2") - F.col("t1")).cast("double"))) / F.count(F.lit(1))).alias("tau"))
    return sizes.select("seq_id").join(signs, "seq_id", "left").select("seq_id", F.coalesce("tau", F.lit(0.0)).alias("tau"))


def compute_all(targets: DataFrame, predicted: DataFrame, true: DataFrame, made: DataFrame) -> DataFrame:
    """All metrics of a prediction: targets (seq_id, seq), made (seq_id, reconstruction), orders with fragments.

    Where the true order is null (no row in true), the ordering metrics are NaN; without a prediction they are 0.
    """
    rows = targets.join(made, "seq_id", "left").withColumn("reconstruction", F.coalesce("reconstruction", F.lit("")))
    sizes = true.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    has = predicted.select("seq_id").distinct().withColumn("has_order", F.lit(True))
    out = rows.select("seq_id", exact_match(F.col("reconstruction"), F.col("seq")).alias("exact_match"), edit_similarity(F.col("reconstruction"), F.col("seq")).alias("edit_similarity"))
    out = out.join(qgram_similarity(rows.select("seq_id", F.col("reconstruction").alias("a"), F.col("seq").alias("b"))), "seq_id")
    for part in (adjacent_pair_accuracy(predicted, true), longest_correct_run(predicted, true), kendall_tau(match_occurrences(predicted, true), sizes)):
        out = out.join(part, "seq_id", "left")
    out = out.join(sizes, "seq_id", "left").join(has, "seq_id", "left")
    undefined = F.when(F.col("has_order").isNull(), 0.0).when(F.col("n").isNull(), float("nan"))
    return out.select("seq_id", "exact_match", "similarity", "edit_similarity", *(undefined.otherwise(F.col(m)).alias(m) for m in ("apa", "lcr", "tau")), F.col("n").isNotNull().alias("true_order_recovered"))


def order_metrics(rows: DataFrame) -> DataFrame:
    """rows: predicted and true (the fragments of two orders, as arrays), reconstruction and seq. Adds all metrics of compute_all.

    Orders are compared inside the row, so nothing moves.
    """

    def shared(x: Counter, y: Counter) -> int:
        return sum(n if n < y[key] else y[key] for key, n in x.items() if key in y)

    def grams_shared(a: pa.Array, b: pa.Array) -> pa.Array:
        """The q-gram similarity (q = 3) of each two texts."""

        def similarity(a: str, b: str) -> float:
            x, y = (Counter(map("".join, zip(t, t[1:], t[2:]))) for t in (a, b))
            grams = max(0, len(a) - 2) + max(0, len(b) - 2)
            return 2 * shared(x, y) / grams if grams else 1.0

        return pa.array(map(similarity, a.to_pylist(), b.to_pylist()), pa.float64())

    def orders_compared(predicted: pa.Array, true: pa.Array) -> pa.Array:
        """Adjacent pair accuracy, longest correct run and Kendall's tau of each two orders."""

        def compared(predicted: list[str], true: list[str]) -> tuple[float, float, float]:
            neighbours = max(0, len(true) - 1)
            apa = shared(Counter(zip(predicted, predicted[1:])), Counter(zip(true, true[1:]))) / neighbours if neighbours else 0.0
            places: dict[str, list[int]] = {}
            for t in range(len(true) - 1, -1, -1):
                places.setdefault(true[t], []).append(t)
            # Runs of equal neighbours by the place where they end in the true order.
            best, ending = 0, {}
            for p in predicted:
                ending = {t: ending.get(t - 1, 0) + 1 for t in places.get(p, ())}
                best = max(best, *ending.values()) if ending else best
            met = [places[p].pop() for p in predicted if places.get(p)]
            signs = sum((t > s) - (t < s) for i, s in enumerate(met) for t in met[i + 1 :])
            return apa, best / len(true) if true else 0.0, signs / (len(met) * (len(met) - 1) // 2) if len(met) > 1 else 0.0

        found = list(map(compared, predicted.to_pylist(), true.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.float64()) for k in range(3)], ["apa", "lcr", "tau"])

    found = rows.withColumn("__o", F.arrow_udf(orders_compared, "struct<apa:double,lcr:double,tau:double>")("predicted", "true"))
    found = found.withColumn("__s", F.arrow_udf(grams_shared, "double")("reconstruction", "seq"))
    return found.select(
        *rows.columns, exact_match(F.col("reconstruction"), F.col("seq")).alias("exact_match"), F.col("__s").alias("similarity"), edit_similarity(F.col("reconstruction"), F.col("seq")).alias("edit_similarity"), "__o.apa", "__o.lcr", "__o.tau"
    )


def ranked_pairs(scores: DataFrame) -> DataFrame:
    """Adds rank: 1 plus the successors of the same fragment with a strictly better score."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("seq_id", "i").orderBy(F.col("score").desc())))


def rank_summary(hits: DataFrame) -> DataFrame:
    """seq_id, top1, top3, mrr, junctions of ranked pairs."""
    return hits.groupBy("seq_id").agg(
        F.avg((F.col("rank") <= 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 3).cast("double")).alias("top3"), F.avg(1 / F.col("rank")).alias("mrr"), F.count(F.lit(1)).alias("junctions")
    )


def junction_ranking(scores: DataFrame, true_pairs: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Rank of each true neighbour among a fragment's successors: 1 plus those with a strictly better score.

    Returns seq_id, top1, top3, mrr, junctions. Pairs in skip are not counted; a sequence without counted ones has no row.
    """
    counted = true_pairs if skip is None else true_pairs.join(skip, ["seq_id", "i", "j"], "left_anti")
    return rank_summary(ranked_pairs(scores).join(counted, ["seq_id", "i", "j"]))


def sample_diagnostics(targets: DataFrame, prim: DataFrame, scores: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each of targets (seq_id, seq), whatever fails: fragments, recovered (whether they tile the target),
    ranks of the true neighbours that edges don't confirm, how many it confirms (excluded), and what cleavage rules prune.

    Ranks are null without a true order or without an unconfirmed neighbour; fragments is 0 where there are none.
    """
    paths = recover_true_order(targets, prim).filter("path is not null").select("seq_id", "path")
    order = paths.select("seq_id", F.posexplode("path").alias("place", "idx"))
    true = E.consecutive(order).select("seq_id", "i", "j")
    excluded = true.join(edges, ["seq_id", "i", "j"], "left_semi").groupBy("seq_id").agg(F.count(F.lit(1)).alias("excluded"))
    return diagnosed(targets, prim, paths, junction_ranking(scores, true, edges), excluded)


def diagnosed(targets: DataFrame, prim: DataFrame, paths: DataFrame, ranking: DataFrame, excluded: DataFrame) -> DataFrame:
    """The rows of sample_diagnostics from their parts, each a row a sequence."""
    pruned = E.filter_recall(prim).select("seq_id", F.col("n").alias("fragments"), "recall", "pruned_total")
    out = targets.select("seq_id").join(pruned, "seq_id", "left").join(paths.select("seq_id", F.lit(True).alias("recovered")), "seq_id", "left")
    out = out.join(ranking, "seq_id", "left").join(excluded, "seq_id", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("seq_id", whole("fragments"), F.coalesce("recovered", F.lit(False)).alias("recovered"), "top1", "top3", "mrr", whole("junctions"), whole("excluded"), "recall", "pruned_total")


def rank_concordance(candidates: DataFrame) -> DataFrame:
    """candidates: sample, validity, quality. Share of comparable pairs in a sample where the lower validity has the higher quality.

    Ties in either are no pairs, infinite validity is left out. Candidates of a sample are few (iterations).
    """
    rows = candidates.filter(~F.isnan("validity") & (F.abs("validity") < float("inf"))).withColumn("__k", F.monotonically_increasing_id())
    a = rows.select("sample", F.col("validity").alias("v1"), F.col("quality").alias("q1"))
    b = rows.select("sample", F.col("validity").alias("v2"), F.col("quality").alias("q2"))
    pairs = a.join(b, "sample").filter("v1 < v2 and q1 <> q2")
    return pairs.groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"), (F.count(F.when(F.col("q1") > F.col("q2"), 1)) / F.count(F.lit(1))).alias("concordance"))


def pooled_concordance(candidates: DataFrame, key: str) -> DataFrame:
    """The same over all candidates of a group, by counting pairs while merging, without pairing (ranges.pair_orders)."""
    rows = candidates.filter(~F.isnan("validity") & (F.abs("validity") < float("inf")))
    found = pair_orders(rows, [key], "validity", "quality")
    total = F.col("same") + F.col("opposite")
    return found.filter(total > 0).select(key, total.alias("pairs"), (F.col("opposite") / total).alias("concordance"))


def breakpoints(n: Column, apa: Column) -> Column:
    """Wrong joins; null under two fragments or where the accuracy is undefined."""
    return F.when((n >= 2) & apa.isNotNull() & ~F.isnan(apa), (n - 1) * (1 - apa))


def classify_error(em: Column, apa: Column, lcr: Column, tau: Column, n: Column, start_ok: Column) -> Column:
    """The shape of a failure, the most specific first. Cut points are fixed values."""
    unknown = apa.isNull() | lcr.isNull() | tau.isNull() | F.isnan(apa) | F.isnan(lcr) | F.isnan(tau)
    return (
        F.when(em >= 1.0, "exact")
        .when(unknown, "unknown")
        .when(tau <= -0.5, "block_reversal")
        .when((F.abs(tau) < 0.15) & (apa <= 0.05), "full_scramble")
        .when((breakpoints(n, apa) <= 2) & (lcr >= 0.5), "local_transposition")
        .when(~start_ok, "wrong_start")
        .otherwise("partial_assembly")
    )


def fragment_count(order: Column, baseline: Column, total: Column) -> Column:
    """Size of the order, else of the baseline's, else n from n(n-1) = total, else 0."""
    solved = F.when(total > 0, F.bround((1 + F.sqrt(1 + 4 * total)) / 2).cast("int"))
    size = lambda c: F.when(F.size(c) > 0, F.size(c))
    return F.coalesce(size(order), size(baseline), solved, F.lit(0))


#: The inclusive bins of fragment counts.
BINS = [("2-4", 2, 4), ("5-9", 5, 9), ("10-19", 10, 19), ("20-49", 20, 49), ("50+", 50, None)]


def fragment_bin(n: Column) -> Column:
    out = F.when(n < 2, "<2")
    for label, low, high in BINS:
        out = out.when((n >= low) & (F.lit(True) if high is None else n <= high), label)
    return out


