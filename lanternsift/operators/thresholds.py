"""Threshold analytics over score matrices: sweeps, choices, caps, calibration, policy. Infinity disables a tag."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.operators.metrics import fbeta, ratio


#: Ranges of scores into which a group's points are cut; a group, however large, is spread over so many tasks.
PARTS = 64


def _cut(points: DataFrame, by: list[str], score: str) -> DataFrame:
    """points with _b, the range of the score: about equally many points of a group in each, by approximate quantiles."""
    edges = points.groupBy(*by).agg(F.percentile_approx(score, [i / PARTS for i in range(1, PARTS)], 1000).alias("_e"))
    # A row a group, and groups are a dimension.
    return points.join(F.broadcast(edges), by).withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col(score)))).drop("_e")


def _running(points: DataFrame, by: list[str]) -> DataFrame:
    """points (by, threshold, p, n) with tp and fp, the sums from the highest threshold down to each, and positives and negatives.

    Sums within a range of scores are added to those of the ranges above it, so no task has a whole group.
    """
    cut = _cut(points, by, "threshold")
    whole = Window.partitionBy(*by)
    above = whole.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    ranges = sums.select(*by, "_b", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("_p", "_n")), F.sum("_p").over(whole).alias("positives"), F.sum("_n").over(whole).alias("negatives"))
    within = Window.partitionBy(*by, "_b").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(ranges), [*by, "_b"])
    return joined.withColumns({"tp": F.col("_p0") + F.sum("p").over(within), "fp": F.col("_n0") + F.sum("n").over(within)}).drop("_p0", "_n0", "_b")


def _points(scored: DataFrame, by: list[str]) -> DataFrame:
    """Distinct scores with their positives and negatives: ties are one row and a hot group is pre-aggregated."""
    return scored.groupBy(*by, F.col("score").alias("threshold")).agg(F.count_if("gold").alias("p"), F.count_if(~F.col("gold")).alias("n"))


def sweep(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, tp, fp, positives, precision, recall at each distinct score."""
    out = _running(_points(scored.where(F.col("gold") | F.col("complete")), by), by).where("positives > 0")
    return out.select(*by, "threshold", "tp", "fp", "positives", "negatives", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"))


def _pick(curve: DataFrame, by: list[str], rank: list[Column]) -> DataFrame:
    """The row of the largest rank in each group; the higher threshold wins a tie."""
    keys = [c.alias(f"k{i}") for i, c in enumerate([*rank, F.col("threshold")])]
    best = curve.groupBy(*by).agg(F.max(F.struct(*keys, "precision", "recall", "positives", "admitted")).alias("b"))
    return best.select(*by, F.col(f"b.k{len(rank)}").alias("threshold"), "b.precision", "b.recall", F.col("b.positives").alias("support"), F.col("b.admitted").alias("floor_met"))


def best_threshold(scored: DataFrame, by: list[str], beta: float = 0.5, recall_floor: float = 0.0, precision_floor: float = 0.0, min_support: int = 0) -> DataFrame:
    """F-beta optimum among cuts within the floors; without any, the cut of largest recall (floor_met false)."""
    curve = sweep(scored, by).withColumn("admitted", (F.col("recall") >= recall_floor) & (F.col("precision") >= precision_floor))
    value = F.when(F.col("admitted"), fbeta(F.col("precision"), F.col("recall"), beta)).otherwise(F.col("recall"))
    out = _pick(curve, by, [F.col("admitted"), value])
    return out.withColumn("threshold", F.when(F.col("support") < min_support, F.lit(float("inf"))).otherwise(F.col("threshold")))


def box(scored: DataFrame, by: list[str], precision: float, recall: float, beta: float = 1.0) -> DataFrame:
    """F-beta optimum inside the box, else the unconstrained one."""
    curve = sweep(scored, by).withColumn("admitted", (F.col("recall") >= recall) & (F.col("precision") >= precision))
    return _pick(curve, by, [F.col("admitted"), fbeta(F.col("precision"), F.col("recall"), beta)])


def group_cap(scored: DataFrame, by: list[str], group: str, floor: float, least: int = 20, tail_events: float | None = None) -> DataFrame:
    """The highest threshold at which every group large enough keeps the floor of recall.

    Large enough is least positives, or, with tail_events, so many positives expected below the quantile.
    """
    enough = F.col("n") >= least if tail_events is None else F.col("n") * (1 - floor) >= tail_events
    caps = scored.where("gold").groupBy(*by, group).agg(F.expr(f"percentile(score, {1 - floor})").alias("cap"), F.count(F.lit(1)).alias("n")).where(enough)
    return caps.groupBy(*by).agg(F.min("cap").alias("cap"), F.count(F.lit(1)).alias("n_groups"))


def robust_threshold(scored: DataFrame, by: list[str], group: str, beta: float = 0.5, floor: float = 0.75, margin: float = 0.0, least: int = 20) -> DataFrame:
    """F-beta optimum under the groups' cap and over the floor; else the largest recall under the cap; else the largest."""
    caps = group_cap(scored, by, group, min(floor + margin, 0.999), least).select(*by, "cap")
    curve = sweep(scored, by).join(F.broadcast(caps), by, "left")
    under = F.coalesce(F.col("threshold") <= F.col("cap"), F.lit(False))
    curve = curve.withColumn("admitted", under & (F.col("recall") >= floor))
    value = F.when(F.col("admitted"), fbeta(F.col("precision"), F.col("recall"), beta)).otherwise(F.col("recall"))
    return _pick(curve, by, [F.col("admitted"), under, value])


def veto_ladder(scored: DataFrame, by: list[str], group: str, min_precision: float, beta: float = 0.5, floor: float = 0.75, margin: float = 0.0, min_support: int = 1, least: int = 20, tail_events: float | None = None) -> DataFrame:
    """by, threshold, precision, recall, branch: the robust choice unless its precision is under the bar.

    Then the F-beta optimum over the floor without the groups' cap, else without the floor; if that is under the bar too,
    infinity. The branch says which rung decided; a higher threshold wins ties.
    """
    caps = group_cap(scored, by, group, min(floor + margin, 0.999), least, tail_events).select(*by, "cap")
    curve = sweep(scored, by).join(F.broadcast(caps), by, "left").withColumn("cap", F.coalesce("cap", F.lit(float("inf"))))
    curve = curve.withColumn("f", fbeta(F.col("precision"), F.col("recall"), beta))
    under, over = F.col("threshold") <= F.col("cap"), F.col("recall") >= floor
    point = ["threshold", "precision", "recall", "positives"]

    def best(admit: Column, value: str, name: str) -> Column:
        """The admitted point of largest value, as a struct; NULL if none is admitted."""
        return F.max(F.when(admit, F.struct(F.col(value).alias("v"), *point))).alias(name)

    picks = curve.groupBy(*by).agg(
        best(under & over, "f", "floor_met"), best(under, "recall", "capped_max_recall"), best(F.lit(True), "recall", "uncapped_max_recall"),
        best(over, "f", "precision_floor_uncapped"), best(F.lit(True), "f", "precision_floor_unconstrained"),
    )
    named = lambda *names: F.coalesce(*(F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("branch"), *(F.col(f"{n}.{c}").alias(c) for c in point))) for n in names))
    normal = named("floor_met", "capped_max_recall", "uncapped_max_recall")
    rescue = named("precision_floor_uncapped", "precision_floor_unconstrained")
    chosen = picks.select(*by, normal.alias("a"), rescue.alias("b"))
    ok = lambda c: F.col(f"{c}.precision") >= min_precision
    few = F.col("a.positives") < min_support
    pick = lambda c: F.when(ok("a"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    branch = F.when(few, "below_min_support").when(ok("a") | ok("b"), pick("branch")).otherwise("disabled_low_precision")
    threshold = F.when(few | ~(ok("a") | ok("b")), F.lit(float("inf"))).otherwise(pick("threshold"))
    return chosen.select(*by, threshold.alias("threshold"), pick("precision").alias("precision"), pick("recall").alias("recall"), branch.alias("branch"))


def robust_document_cut(scored: DataFrame, group: str, recall_floor: float, specificity_floor: float, margin: float = 0.0, least: int = 50) -> DataFrame:
    """One row: the cut of largest precision inside the band that every group large enough allows; its middle if it is empty."""
    rows = scored.where(F.col("target").isNotNull())
    high, low = min(recall_floor + margin, 0.999), min(specificity_floor + margin, 0.999)
    sides = rows.groupBy(group).agg(
        F.expr(f"percentile(CASE WHEN target THEN gate END, {1 - high})").alias("up"), F.count_if("target").alias("p"),
        F.expr(f"percentile(CASE WHEN NOT target THEN gate END, {low})").alias("down"), F.count_if(~F.col("target")).alias("n"),
    )
    band = sides.agg(F.coalesce(F.min(F.when(F.col("p") >= least, F.col("up"))), F.lit(float("inf"))).alias("cap"), F.coalesce(F.max(F.when(F.col("n") >= least, F.col("down"))), F.lit(float("-inf"))).alias("base"))
    points = rows.select(F.col("gate").alias("score"), F.col("target").alias("gold"), F.lit(True).alias("complete"), F.lit("doc").alias("scope"))
    curve = sweep(points, ["scope"]).join(F.broadcast(band), how="cross")  # a row
    inside = (F.col("threshold") <= F.col("cap")) & (F.col("threshold") >= F.col("base"))
    best = curve.groupBy("cap", "base").agg(F.max(F.struct(inside.alias("inside"), "precision", "threshold")).alias("b"))
    cut = F.when(F.col("base") > F.col("cap"), (F.col("base") + F.col("cap")) / 2).otherwise(F.col("b.threshold"))
    return best.select("cap", "base", cut.alias("cut"))


def document_cut(scored: DataFrame, recall_floor: float, specificity_floor: float) -> DataFrame:
    """One cut for all documents (gate, target): the largest precision within both floors, else the least deficit."""
    rows = scored.where(F.col("target").isNotNull()).select(F.col("gate").alias("score"), F.col("target").alias("gold"), F.lit(True).alias("complete"), F.lit("doc").alias("scope"))
    curve = sweep(rows, ["scope"]).withColumn("specificity", ratio(F.col("negatives") - F.col("fp"), F.col("negatives")))
    deficit = F.greatest(F.lit(recall_floor) - F.col("recall"), F.lit(0.0)) + F.greatest(F.lit(specificity_floor) - F.col("specificity"), F.lit(0.0))
    curve = curve.withColumn("admitted", (F.col("recall") >= recall_floor) & (F.col("specificity") >= specificity_floor))
    return _pick(curve, ["scope"], [F.col("admitted"), F.when(F.col("admitted"), F.col("precision")).otherwise(-deficit)])


def lower_quantiles(scored: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """by, q, value: the element at floor(q * (n - 1)) of the positives' scores in order."""
    points = _running(_points(scored.where("gold"), by), by).select(*by, "threshold", (F.col("positives") - F.col("tp")).alias("_low"), "p", "positives")
    spots = points.withColumn("q", F.explode(F.array(*(F.lit(q) for q in qs)))).withColumn("_k", F.floor(F.col("q") * (F.col("positives") - 1)))
    return spots.where((F.col("_k") >= F.col("_low")) & (F.col("_k") < F.col("_low") + F.col("p"))).select(*by, "q", F.col("threshold").alias("value"))


def quantile_bank(scored: DataFrame, group: str, recalls: list[float], priority: tuple[str, ...] = (), least: int = 30) -> DataFrame:
    """tag, recall, threshold: the lower quantile at 1 - recall of the positives' scores.

    Priority tags take the least over the groups with enough positives (over all together where none has).
    """
    qs = [round(1 - r, 12) for r in recalls]
    pooled = lower_quantiles(scored, ["tag"], qs).withColumnRenamed("value", "pooled")
    heavy = scored.where(F.col("tag").isin(*priority) if priority else F.lit(False)).where("gold")
    enough = heavy.groupBy("tag", group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("tag", group)
    each = lower_quantiles(heavy.join(F.broadcast(enough), ["tag", group]), ["tag", group], qs).groupBy("tag", "q").agg(F.min("value").alias("least"))
    both = pooled.join(each, ["tag", "q"], "left")
    return both.select("tag", F.round(1 - F.col("q"), 12).alias("recall"), F.coalesce("least", "pooled").alias("threshold"))


def operating_curve(scored: DataFrame, thresholds: DataFrame, scales: list[float], by: str = "tag") -> DataFrame:
    """tp, fp, fn at each scale of every tag's threshold; scales are a small dimension."""
    grid = scored.join(F.broadcast(thresholds.select(by, "threshold")), by).select("*", F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    fired = F.col("score") >= F.col("threshold") * F.col("scale")
    return grid.groupBy("scale").agg(F.count_if(F.col("gold") & fired).alias("tp"), F.count_if(F.col("complete") & ~F.col("gold") & fired).alias("fp"), F.count_if(F.col("gold") & ~fired).alias("fn"))


def wilson_lower(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, z * z
    bound = (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), bound)).otherwise(0.0)


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rank-sum area; ties count half. Runs over distinct scores."""
    points = _running(_points(scored, by), by)
    pairs = points.withColumn("w", F.col("p") * (F.col("negatives") - F.col("fp") + F.col("n") / 2.0))
    return pairs.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(*by, F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"))


def recall_at_specificity(scored: DataFrame, by: list[str], specificity: float) -> DataFrame:
    """by, cut, recall: recall at the cut below which so large a share of the negatives lies."""
    cuts = scored.groupBy(*by).agg(F.expr(f"percentile(CASE WHEN NOT gold THEN score END, {specificity})").alias("cut"))
    hit = scored.where("gold").join(F.broadcast(cuts), by)
    return hit.groupBy(*by, "cut").agg(ratio(F.count_if(F.col("score") >= F.col("cut")), F.count(F.lit(1))).alias("recall"))


def spread(scored: DataFrame, by: str, group: str, q: float = 0.5) -> DataFrame:
    """How far groups differ: range of a score quantile and ratio of prevalences."""
    inner = scored.groupBy(by, group).agg(F.expr(f"percentile(CASE WHEN gold THEN score END, {q})").alias("v"), F.avg(F.col("gold").cast("double")).alias("share"))
    return inner.groupBy(by).agg((F.max("v") - F.min("v")).alias("threshold_spread"), F.try_divide(F.max("share"), F.min("share")).alias("prevalence_ratio"))


def reliability(points: DataFrame, edges: tuple[float, ...] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.01)) -> DataFrame:
    """low, high, n, claimed, actual by band of score; empty bands are left out."""
    band = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        band = F.when((F.col("score") >= low) & (F.col("score") < high), i).otherwise(band)
    out = points.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("claimed"), F.avg(F.col("gold").cast("double")).alias("actual"))
    at = lambda shift: F.get(F.array(*map(F.lit, edges)), F.col("band") + shift)
    return out.select(at(0).alias("low"), at(1).alias("high"), "n", "claimed", "actual")


def calibration_error(bands: DataFrame) -> DataFrame:
    return bands.agg((F.sum(F.col("n") * F.abs(F.col("claimed") - F.col("actual"))) / F.sum("n")).alias("ece"))


def pool_blocks(blocks: list[tuple[float, float, float, float]]) -> list[list[float]]:
    """Isotonic blocks (left, right, sum, weight) from ascending ones; blocks of parts pool to those of the whole."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][2] * out[-1][3] > out[-1][2] * out[-2][3]:
            last = out.pop()
            top = out[-1]
            top[1], top[2], top[3] = last[1], top[2] + last[2], top[3] + last[3]
    return out


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[float, float, float]]:
    """Isotonic blocks (left, right, value) over ascending distinct x with means y and weights w."""
    return [(a, b, s / m) for a, b, s, m in pool_blocks([(xi, xi, yi * wi, wi) for xi, yi, wi in zip(x, y, w)])]


def isotonic(points: DataFrame, by: str, max_knots: int = 64, min_spans: int = 0) -> DataFrame:
    """by, x, y: knots of a flat-in-blocks isotonic curve of each group with min_spans points, and of all as the group NULL.

    Distinct scores are pooled range by range, and only the ranges' blocks meet: a task never has a whole group's scores.
    """
    kind = points.schema[by].dataType.simpleString()
    enough = points.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= min_spans) & F.col(by).isNotNull()).select(by)
    each = points.join(F.broadcast(enough), by).select(F.col(by).alias("_g"), F.lit(False).alias("_all"), "score", "gold")
    every = each.union(points.select(F.lit("").cast(kind) if kind == "string" else F.lit(0).cast(kind), F.lit(True), "score", "gold"))
    grouped = every.groupBy("_g", "_all", "score").agg(F.sum(F.col("gold").cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        blocks = pool_blocks(list(zip(rows["score"], rows["score"], rows["s"], rows["w"])))
        made = pd.DataFrame(blocks, columns=["low", "high", "s", "w"])
        return made.assign(_g=rows["_g"].iloc[0], _all=rows["_all"].iloc[0])[["_g", "_all", "low", "high", "s", "w"]]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("low")
        knots = []
        for a, b, s, m in pool_blocks(list(zip(rows["low"], rows["high"], rows["s"], rows["w"]))):
            knots.append((a, s / m))
            if b > a:
                knots.append((b, s / m))
        if len(knots) > max_knots:
            knots = [knots[i] for i in np.unique(np.linspace(0, len(knots) - 1, max_knots).round().astype(int))]
        name = None if rows["_all"].iloc[0] else rows["_g"].iloc[0]
        return pd.DataFrame({by: [name] * len(knots), "x": [k[0] for k in knots], "y": [k[1] for k in knots]})

    blocks = _cut(grouped, ["_g", "_all"], "score").groupBy("_g", "_all", "_b").applyInPandas(part, f"_g {kind}, _all boolean, low double, high double, s double, w double")
    return blocks.groupBy("_g", "_all").applyInPandas(one, f"`{by}` {kind}, x double, y double")


def calibrated(points: DataFrame, knots: DataFrame, by: str) -> DataFrame:
    """Scores through their group's curve, or through that of all (group NULL) where it has none.

    Linear between knots and flat beyond; at most max_knots a group are broadcast. Without any curve scores stay.
    """
    curve = knots.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_k"))
    common = curve.where(F.col(by).isNull()).agg(F.first("_k").alias("_all"))
    both = points.join(F.broadcast(curve.where(F.col(by).isNotNull())), by, "left").join(F.broadcast(common), how="cross")  # a row
    return both.withColumn("_k", F.coalesce("_k", "_all")).withColumn("calibrated", interpolated(F.col("score"), F.col("_k"))).drop("_k", "_all")


def interpolated(s: Column, k: Column) -> Column:
    """A score through sorted knots (x, y); NULL knots leave it as it is."""
    low = F.try_element_at(F.filter(k, lambda p: p["x"] <= s), F.lit(-1))
    high = F.get(F.filter(k, lambda p: p["x"] >= s), F.lit(0))
    between = low["y"] + (high["y"] - low["y"]) * F.try_divide(s - low["x"], high["x"] - low["x"])
    return F.when(k.isNull(), s).when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).when(high["x"] == low["x"], low["y"]).otherwise(between)


def policy(measured: DataFrame, constraints: DataFrame) -> DataFrame:
    """arm, passed, failed, unmeasured: constraints (scope, metric, at_least, min_support) over (arm, scope, metric, value, support).

    A scope may be a glob of * and ?, and matches every scope it fits. With a column basis of constraints, those of
    ci_lower hold the column ci_lower of measured against the bound instead of value.
    """
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("_scope", r"([.+()\[\]{}^$|\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    rules = constraints.withColumnRenamed("scope", "_scope")
    # Constraints are a dimension of a few rows.
    met = measured.join(F.broadcast(rules), (measured["metric"] == rules["metric"]) & F.regexp_like(F.col("scope"), pattern)).drop(rules["metric"])
    lower = F.col("basis") == "ci_lower" if "basis" in constraints.columns else F.lit(False)
    value = F.when(lower, F.col("ci_lower") if "ci_lower" in measured.columns else F.lit(None)).otherwise(F.col("value"))
    known = value.isNotNull() & (F.col("support") >= F.col("min_support"))
    ok = F.when(known, value >= F.col("at_least"))
    return met.withColumn("ok", ok).groupBy("arm").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("unmeasured"))


def rank_arms(decided: DataFrame, objective: str) -> DataFrame:
    """Feasible arms first, then by objective, then by name; arms are a small dimension."""
    order = [F.desc(F.col("failed") == 0), F.desc(objective), F.col("arm")]
    return decided.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
