"""Variants of a decision over scores and thresholds, each one change: shifts, scalings, caps, implications, votes.

rows: doc_id, tag, score, gold, complete; thresholds: tag, threshold. Tags are a dimension, so thresholds are broadcast.
Every function returns rows with a column fired, to be counted by metrics.tag_counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.operators import thresholds as T


def _cut(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(thresholds.select("tag", "threshold")), "tag", "left")


def plain(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    return _cut(rows, thresholds).withColumn("fired", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))).drop("threshold")


def scaled(rows: DataFrame, thresholds: DataFrame, factor: float) -> DataFrame:
    return plain(rows, thresholds.withColumn("threshold", F.col("threshold") * factor))


def margin(rows: DataFrame, thresholds: DataFrame, by: float) -> DataFrame:
    """A score must clear its threshold by so much."""
    return plain(rows, thresholds.withColumn("threshold", F.col("threshold") + by))


def prevalence_shift(rows: DataFrame, thresholds: DataFrame, scale: float = 1.0) -> DataFrame:
    """Thresholds lowered by the log odds of a tag's share of gold: rare tags need more evidence."""
    share = rows.groupBy("tag").agg(F.avg(F.col("gold").cast("double")).alias("p"))
    odds = F.ln(F.greatest(F.col("p"), F.lit(1e-6)) / (1 - F.least(F.col("p"), F.lit(1 - 1e-6))))
    moved = thresholds.join(F.broadcast(share), "tag").select("tag", (F.col("threshold") - scale * odds).alias("threshold"))
    return plain(rows, moved)


def standardised(rows: DataFrame) -> DataFrame:
    """rows with scores as deviations from their tag's mean; thresholds are to be chosen anew."""
    moments = rows.groupBy("tag").agg(F.avg("score").alias("_m"), F.greatest(F.stddev_pop("score"), F.lit(1e-6)).alias("_s"))
    return rows.join(F.broadcast(moments), "tag").withColumn("score", (F.col("score") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def length_normalised(rows: DataFrame) -> DataFrame:
    """rows with scores divided by the root of how many of their document's aren't zero."""
    active = rows.groupBy("doc_id").agg(F.sqrt(F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("_n"))
    return rows.join(active, "doc_id").withColumn("score", F.col("score") / F.col("_n")).drop("_n")


def top_k(fired: DataFrame, k: int) -> DataFrame:
    """At most k tags a document, those of the largest scores (ties by tag)."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "tag"))
    return fired.withColumn("_r", rank).withColumn("fired", F.col("fired") & (F.col("_r") <= k)).drop("_r")


def implied(fired: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A parent fires with any of its children (child: parent)."""
    table = F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv))
    up = fired.where("fired").select("doc_id", F.try_element_at(table, F.col("tag")).alias("tag")).where("tag IS NOT NULL").distinct().withColumn("_up", F.lit(True))
    return fired.join(up, ["doc_id", "tag"], "left").withColumn("fired", F.col("fired") | F.coalesce("_up", F.lit(False))).drop("_up")


def supported(fired: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A child fires only with its parent (child: parent)."""
    table = F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv))
    parents = fired.where(F.col("fired") & F.col("tag").isin(*pairs.values())).select("doc_id", F.col("tag").alias("_p")).distinct().withColumn("_ok", F.lit(True))
    with_parent = fired.withColumn("_p", F.try_element_at(table, F.col("tag"))).join(parents, ["doc_id", "_p"], "left")
    return with_parent.withColumn("fired", F.col("fired") & (F.col("_p").isNull() | F.coalesce("_ok", F.lit(False)))).drop("_p", "_ok")


def strict_on_weak(rows: DataFrame, thresholds: DataFrame, by: float = 1.0, quantile: float = 0.25) -> DataFrame:
    """Documents whose best score is in the lowest quantile must clear thresholds by a margin."""
    best = rows.groupBy("doc_id").agg(F.max("score").alias("_b"))
    line = best.agg(F.expr(f"percentile(_b, {quantile})").alias("_line"))
    weak = rows.join(best, "doc_id").join(F.broadcast(line), how="cross")  # a row
    need = F.col("threshold") + F.when(F.col("_b") < F.col("_line"), by).otherwise(0.0)
    return _cut(weak, thresholds).withColumn("fired", F.coalesce(F.col("score") >= need, F.lit(False))).drop("threshold", "_b", "_line")


def by_vertical(rows: DataFrame, boxes: dict[str, tuple[float, float]], beta: float = 0.5) -> DataFrame:
    """tag, threshold: each tag's box is that of its prefix (prefix: precision, recall)."""
    parts = [T.box(rows.where(F.col("tag").startswith(p)), ["tag"], precision, recall, beta).select("tag", "threshold") for p, (precision, recall) in sorted(boxes.items())]
    return reduce(DataFrame.union, parts)


def without_unreachable(rows: DataFrame, thresholds: DataFrame, precision: float, recall: float, least: int = 30) -> DataFrame:
    """Thresholds with infinity for tags of enough positives whose curve never enters the box."""
    boxed = T.box(rows, ["tag"], precision, recall).select("tag", "floor_met", "support")
    never = ~F.col("floor_met") & (F.col("support") >= least)
    return thresholds.join(F.broadcast(boxed), "tag", "left").select("tag", F.when(F.coalesce(never, F.lit(False)), F.lit(float("inf"))).otherwise(F.col("threshold")).alias("threshold"))


def cooccurring(fired: DataFrame) -> DataFrame:
    """A tag goes if it never shares gold with the document's strongest fired tag. Pairs of tags are a dimension."""
    gold = fired.where("gold").groupBy("doc_id").agg(F.collect_set("tag").alias("g"))  # a document has as many as there are tags
    seen = gold.select(F.explode("g").alias("_a"), "g").select("_a", F.explode("g").alias("_t")).distinct().withColumn("_met", F.lit(True))
    anchor = fired.where("fired").groupBy("doc_id").agg(F.max_by("tag", F.struct("score", "tag")).alias("_a"))
    both = fired.join(anchor, "doc_id", "left").join(F.broadcast(seen.withColumnRenamed("_t", "tag")), ["_a", "tag"], "left")
    return both.withColumn("fired", F.col("fired") & (F.coalesce("_met", F.lit(False)) | (F.col("tag") == F.col("_a")))).drop("_a", "_met")


def vote(rows: DataFrame, boxes: list[tuple[float, float]], least: int, beta: float = 0.5) -> DataFrame:
    """Fires where at least so many of the differently boxed thresholds do."""
    found = [T.box(rows, ["tag"], p, r, beta).select("tag", "threshold") for p, r in boxes]
    cuts = reduce(DataFrame.union, found).groupBy("tag").agg(F.collect_list("threshold").alias("_cuts"))
    yes = lambda: F.size(F.filter("_cuts", lambda c: F.col("score") >= c))
    return rows.join(F.broadcast(cuts), "tag", "left").withColumn("fired", F.coalesce(yes() >= least, F.lit(False))).drop("_cuts")


def compared(variants: dict[str, DataFrame]) -> DataFrame:
    """variant, tp, fp, fn over all tags; a row that isn't completely labelled is no negative."""
    parts = []
    for name, rows in variants.items():
        ok = F.col("gold") | F.col("complete")
        parts.append(rows.agg(F.lit(name).alias("variant"), F.count_if(F.col("gold") & F.col("fired")).alias("tp"), F.count_if(ok & ~F.col("gold") & F.col("fired")).alias("fp"), F.count_if(F.col("gold") & ~F.col("fired")).alias("fn")))
    return reduce(DataFrame.union, parts)


def trials(grid: dict[str, list], limit: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations of parameters in a fixed order, or a repeatable draw of limit of them (parameters, not data)."""
    from itertools import product
    from random import Random

    every = [dict(zip(grid, values)) for values in product(*grid.values())]
    return every if limit is None or limit >= len(every) else Random(seed).sample(every, limit)


def rank_trials(results: DataFrame, feasible: Column, objectives: list[Column]) -> DataFrame:
    """Trials in order: feasible first, then by objective after objective, then by name; trials are a small table."""
    order = [F.desc(feasible), *(F.desc(o) for o in objectives), F.col("trial")]
    return results.withColumn("feasible", feasible).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def rank_strategies(votes: DataFrame, options: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """tag, option, f2, precision, recall, place: options (name: how, arms) by F2 over rows (doc_id, tag, gold, arm, fired)."""
    from lanternsift.operators.metrics import fbeta, ratio

    wide = votes.groupBy("doc_id", "tag").agg(F.bool_or("gold").alias("gold"), F.collect_set(F.when(F.col("fired"), F.col("arm"))).alias("yes"))
    struct = []
    for name, (how, arms) in sorted(options.items()):
        n = F.size(F.array_intersect("yes", F.array(*map(F.lit, arms))))
        need = {"source": 1, "or": 1, "and": len(arms), "majority": len(arms) // 2 + 1}[how]
        struct.append(F.struct(F.lit(name).alias("option"), (n >= need).alias("p")))
    each = wide.select("tag", "gold", F.explode(F.array(*struct)).alias("o")).select("tag", "gold", "o.option", "o.p")
    n = each.groupBy("tag", "option").agg(F.count_if(F.col("gold") & F.col("p")).alias("tp"), F.count_if(~F.col("gold") & F.col("p")).alias("fp"), F.count_if(F.col("gold") & ~F.col("p")).alias("fn"))
    p, r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    out = n.withColumns({"precision": p, "recall": r}).withColumn("f2", fbeta(F.col("precision"), F.col("recall"), 2.0))
    order = Window.partitionBy("tag").orderBy(*(F.desc(c) for c in ("f2", "precision", "recall", "option")))
    return out.select("tag", "option", "f2", "precision", "recall", F.row_number().over(order).alias("place"))


def mixtures(ranked: dict[str, list[str]], n: int, seed: int, fixed: dict[str, str] | None = None, odds: tuple[float, ...] = (0.65, 0.25, 0.10)) -> list[dict[str, str]]:
    """Configurations tag: option, first every rank for all tags alike, then repeatable draws of the first ranks without repeats.

    ranked: the options of each tag in order, a dimension. Fewer than n are returned only where no more exist.
    """
    from math import prod
    from random import Random

    fixed = fixed or {}
    free = [t for t in sorted(ranked) if t not in fixed]
    deep = min(map(len, ranked.values()))
    made = [fixed | {t: ranked[t][k] for t in free} for k in range(deep)]
    room = prod(min(len(odds), len(ranked[t])) for t in free)
    found = {tuple(sorted(c.items())) for c in made}
    rng, tries = Random(seed), 0
    while len(made) < n and len(found) < room + deep and tries < 1000 * n:
        tries += 1
        c = fixed | {t: rng.choices(ranked[t][: len(odds)], odds[: len(ranked[t])])[0] for t in free}
        key = tuple(sorted(c.items()))
        if key not in found:
            found.add(key)
            made.append(c)
    return made[:n]


def incremental_cut(scored: DataFrame, by: list[str], floor: float, holdout_share: float = 1.0, step: float = 0.01, beta: float = 0.5) -> DataFrame:
    """by, threshold, precision, recall: the best cut on a coarse ladder of thresholds that keeps the floor of recall.

    The floor is raised by one standard error of a recall measured on holdout_share as many positives, so a choice that
    only just holds here still holds there. The ladder is by score, so its rows are bounded by 1 / step.
    """
    from lanternsift.operators.metrics import fbeta, ratio

    usable = scored.where(F.col("gold") | F.col("complete"))
    rung = F.floor(F.col("score") / step).cast("bigint")
    points = usable.groupBy(*by, rung.alias("rung")).agg(F.count_if("gold").alias("p"), F.count_if(~F.col("gold")).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("rung")).rowsBetween(Window.unboundedPreceding, 0)
    curve = points.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "all": F.sum("p").over(Window.partitionBy(*by))}).where(F.col("all") > 0)
    recall, precision = ratio(F.col("tp"), F.col("all")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    error = F.sqrt(F.lit(floor * (1 - floor)) / (F.col("all") * F.lit(holdout_share)))
    curve = curve.withColumns({"recall": recall, "precision": precision, "need": F.least(F.lit(0.999), F.lit(floor) + error)})
    admitted = F.col("recall") >= F.col("need")
    value = F.when(admitted, fbeta(F.col("precision"), F.col("recall"), beta)).otherwise(F.col("recall"))
    best = curve.groupBy(*by).agg(F.max(F.struct(admitted.alias("ok"), value.alias("v"), "rung", "precision", "recall")).alias("b"))
    return best.select(*by, F.round(F.col("b.rung") * step, 9).alias("threshold"), "b.precision", "b.recall", F.col("b.ok").alias("floor_met"))
