"""Span, document and tag metrics. What can't be measured is NULL, never zero, and averages skip it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_KEY = ["doc_id", "type", "start", "end"]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def fbeta(p: Column, r: Column, beta: float) -> Column:
    """NULL unless both are known; zero where the other is unknown but one is zero, or both are."""
    b2 = beta * beta
    full = F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))
    zero = (p.isNull() & (r == 0)) | (r.isNull() & (p == 0))
    return F.when(zero, 0.0).when(p.isNotNull() & r.isNotNull(), full)


def exact_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """type, gold, tp, fp, fn by exact place. A repeated prediction is a false positive."""
    hit = gold.select(*SPAN_KEY).distinct().join(pred.select(*SPAN_KEY).distinct(), SPAN_KEY).groupBy("type").agg(F.count(F.lit(1)).alias("tp"))
    g = gold.groupBy("type").agg(F.count(F.lit(1)).alias("gold"))
    p = pred.groupBy("type").agg(F.count(F.lit(1)).alias("pred"))
    both = g.join(p, "type", "full_outer").join(hit, "type", "left").na.fill(0, ["gold", "pred", "tp"])
    return both.select("type", "gold", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))


def prf(counts: DataFrame, by: str = "type", beta: float = 2.0) -> DataFrame:
    """Precision, recall and F by group, and over all groups as the row of NULL."""
    total = counts.rollup(by).agg(*(F.sum(c).alias(c) for c in ("gold", "tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.withColumns({"precision": p, "recall": r}).withColumn("f", fbeta(F.col("precision"), F.col("recall"), beta))


def partial_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """type, gold, tp, fp, fn: gold spans in order each take the first free overlapping prediction of their type.

    A taken prediction is one row: others of the same place stay free.
    """
    side = lambda df, name: df.groupBy("doc_id", "type").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))
    both = side(gold, "g").join(side(pred, "p"), ["doc_id", "type"], "full_outer")
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = both.select("type", F.coalesce(F.col("g").cast("array<struct<start:int,end:int>>"), none).alias("g"), F.coalesce(F.col("p").cast("array<struct<start:int,end:int>>"), none).alias("p"))
    init = F.struct(F.col("p").alias("free"), F.lit(0).alias("n"))

    def step(acc: Column, g: Column) -> Column:
        meets = F.transform(acc["free"], lambda s, i: F.when((s["start"] < g["end"]) & (g["start"] < s["end"]), i))
        first = F.array_min(meets)
        left = F.filter(acc["free"], lambda s, i: i != first)
        return F.when(first.isNull(), acc).otherwise(F.struct(left.alias("free"), (acc["n"] + 1).alias("n")))

    met = both.select("type", F.size("g").alias("gold"), F.size("p").alias("pred"), F.aggregate("g", init, step, lambda a: a["n"]).alias("n"))
    sums = met.groupBy("type").agg(F.sum("gold").alias("gold"), F.sum("n").alias("tp"), F.sum("pred").alias("pred"))
    return sums.select("type", "gold", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))


def _meet(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def confusion(docs: DataFrame, gold: str, pred: str, labels: tuple[str, ...]) -> DataFrame:
    return docs.groupBy(gold).pivot(pred, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def leaking_documents(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Documents with a gold span that no prediction of its type touches."""
    g, p = gold.alias("g"), pred.alias("p")
    on = (F.col("g.doc_id") == F.col("p.doc_id")) & (F.col("g.type") == F.col("p.type")) & _meet("g", "p")
    return g.join(p, on, "left_anti").select("doc_id").distinct()


def error_taxonomy(gold: DataFrame, pred: DataFrame, undetectable: tuple[str, ...] = ()) -> DataFrame:
    """side, type, kind, n: what became of every gold span, and of predictions that touch no gold."""
    g, p = gold.withColumn("gid", F.struct(*SPAN_KEY)).alias("g"), pred.alias("p")
    near = g.join(p, (F.col("g.doc_id") == F.col("p.doc_id")) & _meet("g", "p"), "left")
    same = F.col("g.type") == F.col("p.type")
    exact = same & (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    flags = near.groupBy("g.gid").agg(F.bool_or(F.coalesce(exact, F.lit(False))).alias("hit"), F.bool_or(F.coalesce(same, F.lit(False))).alias("same"), F.bool_or(F.col("p.type").isNotNull()).alias("any"))
    kind = F.when(F.col("hit"), "hit").when(F.col("gid.type").isin(*undetectable) if undetectable else F.lit(False), "undetectable").when(F.col("same"), "boundary").when(F.col("any"), "type_confusion").otherwise("context_miss")
    lost = flags.select(F.lit("gold").alias("side"), F.col("gid.type").alias("type"), kind.alias("kind"))
    stray = p.join(g, (F.col("g.doc_id") == F.col("p.doc_id")) & _meet("g", "p"), "left_anti").select(F.lit("pred").alias("side"), "type", F.lit("spurious").alias("kind"))
    return lost.union(stray).groupBy("side", "type", "kind").agg(F.count(F.lit(1)).alias("n"))


def document_sweep(docs: DataFrame, cuts: list[float], gate: str = "gate", target: str = "target") -> DataFrame:
    """t, recall, alarm: documents caught and falsely alarmed at each cut; cuts are a small dimension."""
    rows = docs.where(F.col(target).isNotNull()).withColumn("t", F.explode(F.array(*map(F.lit, cuts))))
    fired = F.col(gate) >= F.col("t")
    return rows.groupBy("t").agg(ratio(F.count_if(F.col(target) & fired), F.count_if(target)).alias("recall"), ratio(F.count_if(~F.col(target) & fired), F.count_if(~F.col(target))).alias("alarm"))


def triage(gold: DataFrame, pred: DataFrame, crosswalk: dict[str, str]) -> DataFrame:
    """doc_id, type, start, end, bucket, label of every prediction. gold: doc_id, label, start, end in the source's labels.

    hit: a gold span of the type at the very place; mapped_mismatch: one that has a type of ours overlaps;
    unmodelled_overlap: only gold of other labels does, the first of them is named; spurious: none does.
    """
    table = F.create_map(*(F.lit(x) for kv in sorted(crosswalk.items()) for x in kv))
    g = gold.select("doc_id", "label", "start", "end", F.try_element_at(table, F.col("label")).alias("type")).alias("g")
    p = pred.select(*SPAN_KEY).withColumn("pid", F.struct(*SPAN_KEY)).alias("p")
    near = p.join(g, (F.col("g.doc_id") == F.col("p.doc_id")) & _meet("g", "p"), "left")
    exact = (F.col("g.type") == F.col("p.type")) & (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    first = F.min(F.when(F.col("g.label").isNotNull(), F.struct(F.col("g.start").alias("s"), F.col("g.end").alias("e"), F.col("g.label").alias("l"))))
    flags = near.groupBy("p.pid").agg(F.bool_or(F.coalesce(exact, F.lit(False))).alias("hit"), F.bool_or(F.col("g.type").isNotNull()).alias("mapped"), first.alias("first"))
    bucket = F.when(F.col("hit"), "hit").when(F.col("mapped"), "mapped_mismatch").when(F.col("first").isNotNull(), "unmodelled_overlap").otherwise("spurious")
    return flags.select("pid.*", bucket.alias("bucket"), F.when(bucket == "unmodelled_overlap", F.col("first.l")).alias("label"))


def confusions(triaged: DataFrame, most: int = 12) -> DataFrame:
    """The most frequent pairs of a predicted type and the label it fell on: a report of its top."""
    return triaged.where("bucket = 'unmodelled_overlap'").groupBy("type", "label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type", "label").limit(most)


def triage_summary(triaged: DataFrame, gold: DataFrame, crosswalk: dict[str, str]) -> DataFrame:
    """Precision with and without predictions on labels that aren't modelled, recall, and cards that could be found at all."""
    from lanternsift.functions.validators import digits, luhn_ok

    n = lambda *names: F.count_if(F.col("bucket").isin(*names))
    p = triaged.agg(n("hit").alias("tp"), n("mapped_mismatch").alias("mismatch"), n("unmodelled_overlap").alias("unmodelled"), n("spurious").alias("spurious"))
    number = digits(F.col("text"))
    g = gold.agg(
        F.count_if(F.col("label").isin(*crosswalk)).alias("gold"),
        F.count_if((F.col("label").isin(*(k for k, v in crosswalk.items() if v == "CREDIT_CARD"))) & F.length(number).between(13, 19) & luhn_ok(number)).alias("card_reachable"),
    )
    out = p.crossJoin(g)  # a row each
    tp, wrong, other = F.col("tp"), F.col("mismatch") + F.col("spurious"), F.col("unmodelled")
    return out.withColumns({"precision": ratio(tp, tp + wrong + other), "adjusted_precision": ratio(tp, tp + wrong), "recall": ratio(tp, F.col("gold"))})


def by_locale(gold: DataFrame, pred: DataFrame, locales: DataFrame) -> DataFrame:
    """Exact counts by locale and type; locales: doc_id, locale."""
    both = []
    for rows in (gold, pred):
        both.append(rows.join(locales, "doc_id").select(*SPAN_KEY, "locale"))
    hit = both[0].distinct().join(both[1].distinct(), [*SPAN_KEY, "locale"]).groupBy("locale", "type").agg(F.count(F.lit(1)).alias("tp"))
    n = [rows.groupBy("locale", "type").agg(F.count(F.lit(1)).alias(k)) for rows, k in zip(both, ("gold", "pred"))]
    out = n[0].join(n[1], ["locale", "type"], "full_outer").join(hit, ["locale", "type"], "left").na.fill(0, ["gold", "pred", "tp"])
    return out.select("locale", "type", "gold", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))


def span_gate(counts: DataFrame, catalogue: DataFrame, severe: tuple[str, ...], min_support: int = 30) -> DataFrame:
    """One row of gate metrics over exact counts by type: tags of the catalogue that were never seen count as zero."""
    p = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    known = counts.withColumns({"p": p, "r": r}).withColumn("f2", fbeta(F.col("p"), F.col("r"), 2.0))
    full = catalogue.select("type").distinct().join(known, "type", "left").na.fill(0)
    heavy = F.col("type").isin(*severe) & (F.col("gold") >= min_support)
    return full.agg(
        F.avg("f2").alias("macro_f2"), F.min("f2").alias("f2_min"), F.expr("percentile(f2, 0.5)").alias("f2_median"), F.count_if(F.col("f2") == 0).alias("n_zero"), F.count_if(F.col("f2") < 0.1).alias("n_below_tenth"),
        F.min(F.when(heavy, F.col("r"))).alias("severity_min"), F.avg(F.when(heavy, F.col("r"))).alias("severity_mean"), F.count_if(heavy).alias("n_severe"),
    )


def model_matrix(runs: DataFrame, metric: str = "value") -> DataFrame:
    """runs (model, corpus, n_rows, value, reason) as a row a model and corpus of the full grid; a blank says why.

    Models and corpora are dimensions of a few rows each.
    """
    grid = runs.select("model").distinct().join(F.broadcast(runs.select("corpus").distinct()), how="cross")
    out = grid.join(runs, ["model", "corpus"], "left")
    said = F.when(F.col(metric).isNotNull(), F.lit(None)).when(F.col("n_rows").isNull(), F.lit("not run")).otherwise(F.coalesce("reason", F.lit("not measurable")))
    return out.select("model", "corpus", "n_rows", metric, said.alias("blank"))


def recall_views(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Recall by exact place and type, by type and overlap, and by overlap alone."""
    g, p = gold.withColumn("gid", F.struct(*SPAN_KEY)).alias("g"), pred.alias("p")
    near = g.join(p, (F.col("g.doc_id") == F.col("p.doc_id")) & _meet("g", "p"), "left")
    same = F.coalesce(F.col("g.type") == F.col("p.type"), F.lit(False))
    exact = same & (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    one = near.groupBy("g.gid").agg(F.bool_or(exact).alias("s"), F.bool_or(same).alias("t"), F.bool_or(F.col("p.type").isNotNull()).alias("l"))
    n = F.count(F.lit(1))
    return one.agg(n.alias("gold"), ratio(F.count_if("s"), n).alias("strict"), ratio(F.count_if("t"), n).alias("typed"), ratio(F.count_if("l"), n).alias("located"))


def regressions(now: DataFrame, baseline: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Scores (scope, metric, value) that fell, leakage that rose, and what is missing now."""
    both = baseline.withColumnRenamed("value", "was").join(now.withColumnRenamed("value", "now"), ["scope", "metric"], "full_outer")
    fell = F.when(F.col("metric") == "leakage", F.col("now") > F.col("was") + slack).otherwise(F.col("now") < F.col("was") - slack)
    return both.where(F.col("was").isNotNull() & (F.col("now").isNull() | fell)).select("scope", "metric", "was", "now")


def enumerate_labels(spans: DataFrame, label: str = "type", key: str = "doc_id", examples: int = 6) -> DataFrame:
    """Occurrences, documents and the first distinct examples of each label. Examples are cut in every task already."""
    few = spans.select(label, "text").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("text"))).where(F.col("_r") <= examples)
    shown = few.groupBy(label).agg(F.array_join(F.sort_array(F.collect_list("text")), "|").alias("examples"))
    return spans.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_docs")).join(F.broadcast(shown), label)


def slices(rows: DataFrame, shares: dict[str, str], hit: str, least: float = 0.5) -> DataFrame:
    """Recall by the group with the largest share, or mixed below least."""
    top = F.greatest(*(F.col(c) for c in shares.values()))
    group = F.lit("mixed")
    for name, c in reversed(list(shares.items())):
        group = F.when((F.col(c) == top) & (top >= least), name).otherwise(group)
    return rows.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(hit), F.count(F.lit(1))).alias("recall"))


def tag_counts(scored: DataFrame, fired: Column, by: list[str]) -> DataFrame:
    """support, tp, fn, fp by group. A row that isn't completely labelled is no negative."""
    g, ok = F.col("gold"), F.col("gold") | F.col("complete")
    return scored.groupBy(*by).agg(
        F.count_if(g).alias("support"), F.count_if(g & fired).alias("tp"), F.count_if(g & ~fired).alias("fn"), F.count_if(ok & ~g & fired).alias("fp"), F.count_if(ok & ~g).alias("negatives"),
    )


def masked_metrics(scored: DataFrame, catalogue: DataFrame, fired: Column, by: list[str], beta: float = 2.0) -> DataFrame:
    """By corpus and tag of the frozen catalogue, tags without any row included; precision where negatives exist only."""
    frame = scored.select(*by).distinct().crossJoin(F.broadcast(catalogue.select("tag").distinct()))
    counts = frame.join(tag_counts(scored, fired, [*by, "tag"]), [*by, "tag"], "left").na.fill(0)
    p = F.when(F.col("negatives") > 0, ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    measured = counts.withColumns({"precision": p, "recall": ratio(F.col("tp"), F.col("support"))})
    return measured.withColumn("f", fbeta(F.col("precision"), F.col("recall"), beta))


def equal_groups(metrics: DataFrame, group: str, by: list[str], values: list[str]) -> DataFrame:
    """Mean over groups of each group's mean: each counts the same, NULLs don't count."""
    inner = metrics.groupBy(group, *by).agg(*(F.avg(v).alias(v) for v in values))
    return inner.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values)) if by else inner.agg(*(F.avg(v).alias(v) for v in values))


def top_k_ladder(scored: DataFrame, fired_docs: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """k, precision, recall, f1: a document is a hit where a gold tag is among its k best."""
    most = max(ks)
    # Each task keeps the k best tags of a document (WindowGroupLimit).
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "tag"))).where(F.col("rank") <= most)
    best = ranked.where("gold").groupBy("doc_id").agg(F.min("rank").alias("best"))
    docs = scored.groupBy("doc_id").agg(F.bool_or("gold").alias("has_gold")).join(best, "doc_id", "left").join(fired_docs.select("doc_id").distinct().withColumn("fired", F.lit(True)), "doc_id", "left")
    fired = F.coalesce("fired", F.lit(False))
    out = None
    for k in ks:
        hit = fired & F.coalesce(F.col("best") <= k, F.lit(False))
        row = docs.agg(F.lit(k).alias("k"), ratio(F.count_if(hit), F.count_if(fired)).alias("precision"), ratio(F.count_if(hit & F.col("has_gold")), F.count_if("has_gold")).alias("recall"))
        out = row if out is None else out.union(row)
    return out.withColumn("f1", fbeta(F.col("precision"), F.col("recall"), 1.0))


def document_confusion(docs: DataFrame, fired: Column, target: str = "target", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and rates; documents of unknown target don't count."""
    t = F.col(target)
    known = docs.where(t.isNotNull()).groupBy(*(by or []))
    counts = known.agg(F.count_if(t & fired).alias("tp"), F.count_if(~t & fired).alias("fp"), F.count_if(t & ~fired).alias("fn"), F.count_if(~t & ~fired).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "prevalence": ratio(tp + fn, tp + fp + fn + tn)})


def agreement(judged: DataFrame, min_support: int = 1) -> DataFrame:
    """judged (doc_key, tag, a, b as booleans over shared documents) -> overlap measures and kappa by tag."""
    n = judged.groupBy("tag").agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
    )
    both, a, b, no = (F.col(c).cast("double") for c in ("both", "only_a", "only_b", "neither"))
    total = both + a + b + no
    chance = ((both + a) * (both + b) + (b + no) * (a + no)) / (total * total)
    out = n.where(F.col("both") + F.col("only_a") + F.col("only_b") >= min_support)
    return out.withColumns(
        {
            "f1": F.coalesce(F.try_divide(2 * both, 2 * both + a + b), F.lit(0.0)),
            "jaccard": F.coalesce(F.try_divide(both, both + a + b), F.lit(0.0)),
            "agreement": (both + no) / total,
            "kappa": F.when(chance < 1, F.try_divide((both + no) / total - chance, 1 - chance)),
        }
    )


def worst_group(metrics: DataFrame, by: str, group: str, value: str) -> DataFrame:
    known = metrics.where(F.col(value).isNotNull())
    return known.groupBy(by).agg(F.min(F.struct(F.col(value).alias("v"), F.col(group).alias("g"))).alias("w")).select(by, F.col("w.g").alias("worst"), F.col("w.v").alias("value"))


def false_alarms(clean: DataFrame, fired: Column) -> DataFrame:
    """On documents without anything to find: share alarmed, false tags per 1,000 documents."""
    docs = clean.groupBy("doc_id").agg(F.count_if(fired).alias("n"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), ratio(F.count_if(F.col("n") > 0), F.count(F.lit(1))).alias("alarm_rate"), (1000 * ratio(F.sum("n"), F.count(F.lit(1)))).alias("per_thousand"))


def alarm_tags(clean: DataFrame, fired: Column) -> DataFrame:
    """tag, n: false tags on documents without anything to find."""
    return clean.where(fired).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def implied_precision(sealed: DataFrame, clean: DataFrame, mix: float = 0.5) -> DataFrame:
    """Precision of a mix in which so large a share of the documents is clean. sealed: tp, fp, n_docs; clean: fp, n_docs."""
    scale = (mix / (1 - mix)) if mix < 1 else 0.0
    both = sealed.select("tp", "fp", F.col("n_docs").alias("n")).crossJoin(clean.select(F.col("fp").alias("clean_fp"), F.col("n_docs").alias("clean_n")))  # a row each
    more = F.lit(scale) * F.col("n") / F.col("clean_n") * F.col("clean_fp")
    return both.select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("sealed_precision"), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp") + more).alias("implied_precision"))


def latency_summary(runs: DataFrame, by: str, ms: str, size: str) -> DataFrame:
    """mean, p50, p95 (nearest rank), max and MB/s by group."""
    w = Window.partitionBy(by)
    ranked = runs.withColumns({"_r": F.row_number().over(w.orderBy(ms)), "_n": F.count(F.lit(1)).over(w)})
    place = F.greatest(F.bround(F.lit(0.95) * F.col("_n"), 0).cast("bigint"), F.lit(1))
    out = ranked.groupBy(by).agg(
        F.avg(ms).alias("mean"), F.expr(f"percentile({ms}, 0.5)").alias("p50"), F.max(F.when(F.col("_r") == place, F.col(ms))).alias("p95"), F.max(ms).alias("max"), (F.sum(size) / 1e6 / (F.sum(ms) / 1e3)).alias("mb_s"),
    )
    return out
