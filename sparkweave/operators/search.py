"""Orderings of fragments: greedy and beam search, and choices among candidate orderings.

A sequence's pairs are gathered once, as sorted lists of successors; the search is then a fold inside the row.
So all sequences are searched at once after one aggregation, without a loop of jobs. The lists are as long as
a sequence has pairs, which sequences bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.operators.segment import draw


def start_fragment(scores: DataFrame, prim: DataFrame) -> DataFrame:
    """seq_id, start: of the fragments that begin with M, else of all, the one with the lowest sum of incoming scores; the first of equals."""
    sums = scores.groupBy("seq_id", "j").agg(F.round(F.sum("score"), 6).alias("incoming"))
    rows = prim.join(sums.withColumnRenamed("j", "idx"), ["seq_id", "idx"], "left")
    rank = F.struct((~F.col("fragment").startswith("M")).alias("other"), F.coalesce("incoming", F.lit(0.0)).alias("incoming"), "idx")
    return rows.groupBy("seq_id").agg(F.min(rank).alias("best")).select("seq_id", F.col("best.idx").alias("start"))


def _successors(scores: DataFrame, rank: list[Column], name: str) -> DataFrame:
    """seq_id and an array of (i, next): each fragment's successors j with their gain, in the order of rank."""
    rows = scores.groupBy("seq_id", "i").agg(F.array_sort(F.collect_list(F.struct(*rank, "j", "gain"))).alias("next"))
    return rows.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "next"))).alias(name))


def greedy_order(scores: DataFrame, prim: DataFrame, soft: bool = False, bonus: float = 0.0) -> DataFrame:
    """scores: seq_id, i, j, score, confirmed, impossible. Returns seq_id, path, forced (steps with impossible pairs only).

    The best unused successor, possible before impossible, first of equals; a soft bonus for possible confirmed pairs.
    """
    gain = F.round(F.col("score") + F.when(F.col("confirmed") & ~F.col("impossible"), bonus if soft else 0.0).otherwise(0.0), 6)
    ranked = scores.withColumn("gain", gain)
    lists = _successors(ranked, [F.col("impossible"), (-F.col("gain")).alias("cost")], "lists")
    sizes = prim.groupBy("seq_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = sizes.join(start_fragment(scores, prim), "seq_id").join(lists, "seq_id", "left")
    first = F.struct(F.array("start").alias("path"), F.lit(0).alias("forced"))

    def step(state: Column, _: Column) -> Column:
        left = F.filter(F.element_at(F.col("lists"), F.element_at(state["path"], F.lit(-1))), lambda x: ~F.array_contains(state["path"], x["j"]))
        return F.struct(F.concat(state["path"], F.array(left[0]["j"])).alias("path"), (state["forced"] + left[0]["impossible"].cast("int")).alias("forced"))

    steps = F.when(F.col("n") > 1, F.sequence(F.lit(2), F.col("n"))).otherwise(F.array().cast("array<int>"))
    return rows.select("seq_id", F.aggregate(steps, first, step).alias("s")).select("seq_id", "s.path", "s.forced")


def beam_order(scores: DataFrame, prim: DataFrame, width: int = 3, soft: bool = False, bonus: float = 0.0) -> DataFrame:
    """seq_id, path, fell_back, placed. Keeps the best width partial orders at each length, earlier ones first among equals.

    Hard mode goes only to confirmed successors where a fragment has any; impossible pairs are never taken. If
    no partial order can go on, the best is completed greedily, ignoring what is impossible.
    """
    extra = F.when(F.col("confirmed"), bonus if soft else 0.0).otherwise(0.0)
    ranked = scores.withColumn("gain", F.round(F.col("score") + extra, 6))
    has = F.max("confirmed").over(Window.partitionBy("seq_id", "i"))
    allowed = ranked.withColumn("has", has).filter(~F.col("impossible") & (F.lit(soft) | ~F.col("has") | F.col("confirmed")))
    lists = _successors(allowed, [], "lists")
    every = _successors(ranked, [(-F.col("gain")).alias("cost")], "every")
    starts = prim.groupBy("seq_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("fragment").startswith("M"), F.col("idx")))).alias("m"),
        F.array_sort(F.collect_list("idx")).alias("all"),
    )
    rows = starts.join(lists, "seq_id", "left").join(every, "seq_id", "left")
    beam = lambda i: F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("parent"), i.alias("j"), F.array(i).alias("path"))
    first = F.transform(F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("all")), beam)

    def extend(beams: Column, _: Column) -> Column:
        def of(b: Column, rank: Column) -> Column:
            following = F.coalesce(F.try_element_at(F.col("lists"), b["j"]), F.array().cast("array<struct<j:int,gain:double>>"))
            left = F.filter(following, lambda x: ~F.array_contains(b["path"], x["j"]))
            return F.transform(left, lambda x: F.struct(F.round(b["cost"] - x["gain"], 6).alias("cost"), rank.alias("parent"), x["j"].alias("j"), F.concat(b["path"], F.array(x["j"])).alias("path")))

        new = F.flatten(F.transform(beams, of))
        return F.when(F.size(new) > 0, F.slice(F.array_sort(new), 1, width)).otherwise(beams)

    steps = F.when(F.col("n") > 1, F.sequence(F.lit(2), F.col("n"))).otherwise(F.array().cast("array<int>"))
    found = rows.withColumn("best", F.aggregate(steps, first, extend)[0]["path"])

    def complete(path: Column, _: Column) -> Column:
        left = F.filter(F.element_at(F.col("every"), F.element_at(path, F.lit(-1))), lambda x: ~F.array_contains(path, x["j"]))
        return F.concat(path, F.array(left[0]["j"]))

    missing = F.when(F.size("best") < F.col("n"), F.sequence(F.size("best") + 1, F.col("n"))).otherwise(F.array().cast("array<int>"))
    return found.select("seq_id", F.aggregate(missing, F.col("best"), complete).alias("path"), (F.size("best") < F.col("n")).alias("fell_back"), F.size("best").alias("placed"))


def reconstruct(paths: DataFrame, prim: DataFrame) -> DataFrame:
    """seq_id, path, reconstruction: the fragments in the path's order, joined."""
    pieces = prim.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "fragment"))), lambda x: x["fragment"]).alias("pieces"))
    return paths.join(pieces, "seq_id").select("seq_id", "path", F.array_join(F.transform("path", lambda i: F.element_at("pieces", i + 1)), "").alias("reconstruction"))


def as_order(paths: DataFrame) -> DataFrame:
    """seq_id, place, idx."""
    return paths.select("seq_id", F.posexplode("path").alias("place", "idx"))


# Candidates: rows of sample, iteration, score and more


def select_best(candidates: DataFrame, margin: float = 0.0, patience: int | None = None) -> DataFrame:
    """sample, best_iteration, best_score, used: a candidate replaces the best so far if it is lower by the margin; patience ends the fold."""
    rows = candidates.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("iteration", "score"))).alias("c"))
    limit = F.lit(patience if patience is not None else 1 << 30)
    start = F.struct(F.lit(None).cast("int").alias("iteration"), F.lit(float("inf")).alias("score"), F.lit(0).alias("stale"), F.lit(0).alias("used"))

    def step(best: Column, x: Column) -> Column:
        better = best["iteration"].isNull() | (x["score"] < best["score"] * (1 - margin))
        new = F.struct(F.when(better, x["iteration"].cast("int")).otherwise(best["iteration"]).alias("iteration"), F.when(better, x["score"]).otherwise(best["score"]).alias("score"), F.when(better, 0).otherwise(best["stale"] + 1).alias("stale"), (best["used"] + 1).alias("used"))
        return F.when(best["stale"] >= limit, best).otherwise(new)

    return rows.select("sample", F.aggregate("c", start, step).alias("b")).select("sample", F.col("b.iteration").alias("best_iteration"), F.col("b.score").alias("best_score"), F.col("b.used").alias("used"))


def ceiling(candidates: DataFrame, metrics: list[str]) -> DataFrame:
    """The greatest finite value of each metric over a sample's candidates."""
    finite = lambda m: F.max(F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))).alias(m)
    return candidates.groupBy("sample").agg(*(finite(m) for m in metrics))


def lever_grid(spark, space: dict[str, list]) -> DataFrame:
    """All combinations of the axes' values, numbered; an empty axis is an error."""
    if not space or any(not values for values in space.values()):
        raise ValueError("every axis needs a value")
    return crossed(spark.range(1), space).drop("id")


def crossed(rows: DataFrame, space: dict[str, list]) -> DataFrame:
    """Every row with every combination of the axes' values, as further columns."""
    for name, values in space.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def combo_overrides(combos: DataFrame, base: dict) -> DataFrame:
    """A combination's value where it has one, else the base's; early_stop_patience follows max_iterations unless given."""
    out = combos.select(*combos.columns)
    for name, value in base.items():
        given = F.col(name) if name in combos.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(given, F.lit(value)))
    if "early_stop_patience" in combos.columns:
        return out.withColumn("early_stop_patience", F.coalesce(combos["early_stop_patience"], F.col("max_iterations")))
    return out.withColumn("early_stop_patience", F.col("max_iterations"))


def random_lever_plan(samples: DataFrame, grid: DataFrame, name: Column, iterations: int, seed: int, default: Column) -> DataFrame:
    """sample, iteration, combo: the default first, then a seeded draw without repeats. grid holds bounded rows."""
    drawn = samples.join(F.broadcast(grid.select(name.alias("combo")).filter(F.col("combo") != default)))
    order = Window.partitionBy("sample").orderBy(draw(seed, F.col("sample"), F.col("combo")), "combo")
    rest = drawn.withColumn("iteration", F.row_number().over(order) + 1).filter(F.col("iteration") <= iterations)
    return samples.select("sample", F.lit(1).alias("iteration"), default.alias("combo")).unionByName(rest.select("sample", "iteration", "combo"))


def grid_lever_plan(grid: DataFrame, name: Column, seed: int) -> DataFrame:
    """iteration, combo: the grid in one seeded order. grid holds bounded rows."""
    rows = grid.select(name.alias("combo"))
    return rows.select(F.row_number().over(Window.orderBy(draw(seed, F.col("combo")), "combo")).alias("iteration"), "combo")


def effective_levers(plan: DataFrame, defaults: dict) -> DataFrame:
    """Each iteration's given values, else the last given before, else the default."""
    before = Window.partitionBy("sample").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return plan.select("sample", "iteration", *(F.coalesce(F.last(name, ignorenulls=True).over(before), F.lit(value)).alias(name) for name, value in defaults.items()))


def changed_levers(effective: DataFrame, names: list[str]) -> DataFrame:
    """changed: the names, in order, of the levers that differ from the iteration before; none in the first."""
    along = Window.partitionBy("sample").orderBy("iteration")
    marks = [F.when(F.lag(n).over(along).isNotNull() & (F.lag(n).over(along) != F.col(n)), F.lit(n)) for n in names]
    return effective.select("sample", "iteration", F.concat_ws(",", *marks).alias("changed"))


def attempt_digest(candidates: DataFrame) -> DataFrame:
    """sample, iteration, score, best_so_far, best_iteration_so_far."""
    before = Window.partitionBy("sample").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct("score", "iteration")).over(before)
    return candidates.select("sample", "iteration", "score", best["score"].alias("best_so_far"), best["iteration"].alias("best_iteration_so_far"))
