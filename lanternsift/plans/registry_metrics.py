"""Registered queries of features, models, metrics, thresholds and token work."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternsift.operators import bootstraps as B
from lanternsift.operators import features as K
from lanternsift.operators import metrics as M
from lanternsift.operators import thresholds as T
from lanternsift.operators import tokens as N
from lanternsift.plans.registry import IDS, base, duck, query, table

# A score for every labelled document and tag; sources are corpora and a fifth of the documents isn't completely labelled.
_scored = """SELECT l.doc_id, d.source AS corpus, l.tag, l.g = 1 AS gold, l.doc_id % 5 <> 0 AS complete, CAST((l.doc_id * 7919) % 750 + 250 * l.g AS DOUBLE) / 1000 AS score
FROM (SELECT doc_id, 'quality' AS tag, quality AS g FROM {labels} UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels}) AS l JOIN {documents} AS d ON l.doc_id = d.doc_id"""


def scored(spark, sf_dir):
    return base(spark, sf_dir, _scored, "labels", "documents")


S = f"WITH s AS ({duck(_scored)}) "

# --- spans against gold

_gold = f"SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'EMAIL' ELSE 'SSN' END AS type, 10 AS gs, 20 AS ge FROM ({IDS}) AS i UNION ALL SELECT k, 'MRN', 30, 38 FROM ({IDS}) AS i WHERE k % 3 = 0"
_pred = f"""SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'URL' ELSE type END AS type, gs + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS gs, ge FROM ({_gold}) AS g WHERE doc_id % 5 <> 0
UNION ALL SELECT k, 'EMAIL', 50, 55 FROM ({IDS}) AS i WHERE k % 5 = 4"""


def _spans(spark, sf_dir):
    name = lambda sql: base(spark, sf_dir, sql, "customer").select("doc_id", "type", F.col("gs").alias("start"), F.col("ge").alias("end"))
    return name(_gold), name(_pred)


GP = f"WITH g AS ({duck(_gold)}), p AS ({duck(_pred)}) "
_counts = """SELECT type, coalesce(gold, 0) AS gold, coalesce(tp, 0) AS tp, coalesce(pred, 0) - coalesce(tp, 0) AS fp, coalesce(gold, 0) - coalesce(tp, 0) AS fn
FROM (SELECT type, count(*) AS gold FROM g GROUP BY type) AS a FULL JOIN (SELECT type, count(*) AS pred FROM p GROUP BY type) AS b USING (type)
LEFT JOIN (SELECT g.type, count(*) AS tp FROM g JOIN p ON g.doc_id = p.doc_id AND g.type = p.type AND g.gs = p.gs AND g.ge = p.ge GROUP BY g.type) AS c USING (type)"""


@query("g_exact_counts", GP + _counts)
def g_exact_counts(spark, sf_dir):
    return M.exact_counts(*_spans(spark, sf_dir))


@query("g_micro_rollup", GP + f"""SELECT type, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  sum(tp) / nullif(sum(tp) + sum(fp), 0) AS precision, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS recall,
  CASE WHEN sum(tp) + sum(fp) = 0 AND sum(tp) + sum(fn) = 0 THEN NULL WHEN sum(tp) = 0 THEN 0 ELSE 5.0 * sum(tp) / (5.0 * sum(tp) + 4.0 * sum(fn) + sum(fp)) END AS f
FROM ({_counts}) AS c GROUP BY ROLLUP (type)""")
def g_micro_rollup(spark, sf_dir):
    return M.prf(M.exact_counts(*_spans(spark, sf_dir)))


# Two touching golds under one, two or three equal predictions, or none: each gold takes one of them.
_twice = f"SELECT k AS doc_id, 'SSN' AS type, 0 AS gs, 5 AS ge FROM ({IDS}) AS i UNION ALL SELECT k, 'SSN', 5, 10 FROM ({IDS}) AS i"
_thrice = f"SELECT k AS doc_id, 'SSN' AS type, 3 AS gs, 7 AS ge FROM ({IDS}) AS i JOIN (VALUES (1), (2), (3)) AS v(n) ON v.n <= i.k % 4"


@query("g_partial", duck(f"""SELECT 'SSN' AS type, 2 * count(*) AS gold, CAST(sum(least(k % 4, 2)) AS BIGINT) AS tp, CAST(sum(k % 4 - least(k % 4, 2)) AS BIGINT) AS fp, CAST(sum(2 - least(k % 4, 2)) AS BIGINT) AS fn FROM ({IDS}) AS i"""))
def g_partial(spark, sf_dir):
    name = lambda sql: base(spark, sf_dir, sql, "customer").select("doc_id", "type", F.col("gs").alias("start"), F.col("ge").alias("end"))
    return M.partial_counts(name(_twice), name(_thrice))


@query("g_leakage", GP + "SELECT DISTINCT doc_id FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.doc_id = p.doc_id AND g.type = p.type AND g.gs < p.ge AND p.gs < g.ge)")
def g_leakage(spark, sf_dir):
    return M.leaking_documents(*_spans(spark, sf_dir))


@query("g_error_taxonomy", GP + """, k AS (SELECT g.type, CASE WHEN bool_or(p.type = g.type AND p.gs = g.gs AND p.ge = g.ge) THEN 'hit' WHEN bool_or(p.type = g.type) THEN 'boundary' WHEN bool_or(p.type IS NOT NULL) THEN 'type_confusion' ELSE 'context_miss' END AS kind
  FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.gs < p.ge AND p.gs < g.ge GROUP BY g.doc_id, g.type, g.gs, g.ge)
SELECT 'gold' AS side, type, kind, count(*) AS n FROM k GROUP BY type, kind UNION ALL
SELECT 'pred', type, 'spurious', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.gs < p.ge AND p.gs < g.ge) GROUP BY type""")
def g_error_taxonomy(spark, sf_dir):
    return M.error_taxonomy(*_spans(spark, sf_dir))


@query("g_recall_views", GP + """SELECT count(*) AS gold, avg(CAST(s AS DOUBLE)) AS strict, avg(CAST(t AS DOUBLE)) AS typed, avg(CAST(l AS DOUBLE)) AS located FROM (
  SELECT CAST(coalesce(bool_or(p.type = g.type AND p.gs = g.gs AND p.ge = g.ge), FALSE) AS INT) AS s, CAST(coalesce(bool_or(p.type = g.type), FALSE) AS INT) AS t, CAST(bool_or(p.type IS NOT NULL) AS INT) AS l
  FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.gs < p.ge AND p.gs < g.ge GROUP BY g.doc_id, g.type, g.gs, g.ge) AS x""")
def g_recall_views(spark, sf_dir):
    return M.recall_views(*_spans(spark, sf_dir))


@query("g_regressions", GP + f""", c AS ({_counts}) SELECT type AS scope, 'recall' AS metric, 0.7 AS was, tp / gold AS now FROM c WHERE gold > 0 AND tp / gold < 0.7 - 1e-6
UNION ALL SELECT 'all', 'leakage', 0.0, 0.5 UNION ALL SELECT 'GONE', 'recall', 0.5, NULL""")
def g_regressions(spark, sf_dir):
    now = M.exact_counts(*_spans(spark, sf_dir)).where("gold > 0").select(F.col("type").alias("scope"), F.lit("recall").alias("metric"), (F.col("tp") / F.col("gold")).alias("value"))
    extra = spark.createDataFrame([("all", "leakage", 0.5)], "scope string, metric string, value double")
    was = now.withColumn("value", F.lit(0.7)).union(spark.createDataFrame([("all", "leakage", 0.0), ("GONE", "recall", 0.5)], "scope string, metric string, value double"))
    return M.regressions(now.union(extra), was)


@query("g_enumerate", GP + """SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, (SELECT string_agg(text, '|' ORDER BY text) FROM (SELECT DISTINCT CAST(doc_id AS STRING) AS text FROM g AS h WHERE h.type = g.type ORDER BY 1 LIMIT 6) AS x) AS examples FROM g GROUP BY type""")
def g_enumerate(spark, sf_dir):
    gold, _ = _spans(spark, sf_dir)
    return M.enumerate_labels(gold.withColumn("text", F.col("doc_id").cast("string")))


# --- documents and tags

_docs = """SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'PII' ELSE 'PHI' END AS gold, CASE doc_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'PII' ELSE 'PHI' END AS pred,
  CAST(doc_id % 100 AS DOUBLE) / 100 AS gate, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 > 0 END AS target FROM {documents}"""


@query("g_confusion", duck(f"""SELECT gold, CAST(count(*) FILTER (WHERE pred = 'NONE') AS BIGINT) AS "NONE", CAST(count(*) FILTER (WHERE pred = 'PII') AS BIGINT) AS "PII", CAST(count(*) FILTER (WHERE pred = 'PHI') AS BIGINT) AS "PHI" FROM ({_docs}) AS d GROUP BY gold"""))
def g_confusion(spark, sf_dir):
    return M.confusion(base(spark, sf_dir, _docs, "documents"), "gold", "pred", ("NONE", "PII", "PHI"))


@query("g_document_confusion", duck(f"""SELECT source, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, (tp + fn) / (tp + fp + fn + tn) AS prevalence FROM (
  SELECT source, CAST(count(*) FILTER (WHERE target AND gate >= 0.5) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT target AND gate >= 0.5) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE target AND gate < 0.5) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT target AND gate < 0.5) AS BIGINT) AS tn
  FROM ({_docs}) AS d WHERE target IS NOT NULL GROUP BY source) AS c"""))
def g_document_confusion(spark, sf_dir):
    return M.document_confusion(base(spark, sf_dir, _docs, "documents"), F.col("gate") >= 0.5, by=["source"])


@query("g_document_sweep", duck(f"""SELECT t, count(*) FILTER (WHERE target AND gate >= t) / count(*) FILTER (WHERE target) AS recall, count(*) FILTER (WHERE NOT target AND gate >= t) / count(*) FILTER (WHERE NOT target) AS alarm
FROM ({_docs}) AS d, (SELECT unnest([0.25, 0.5, 0.75]) AS t) AS ts WHERE target IS NOT NULL GROUP BY t"""))
def g_document_sweep(spark, sf_dir):
    return M.document_sweep(base(spark, sf_dir, _docs, "documents"), [0.25, 0.5, 0.75])


_masked = """frame AS (SELECT c.corpus, t.tag FROM (SELECT DISTINCT corpus FROM s) AS c, (SELECT unnest(['quality', 'toxic', 'unseen']) AS tag) AS t),
n AS (SELECT corpus, tag, count(*) FILTER (WHERE gold) AS support, count(*) FILTER (WHERE gold AND score >= 0.6) AS tp, count(*) FILTER (WHERE gold AND score < 0.6) AS fn,
  count(*) FILTER (WHERE NOT gold AND complete AND score >= 0.6) AS fp, count(*) FILTER (WHERE NOT gold AND complete) AS negatives FROM s GROUP BY corpus, tag),
m AS (SELECT corpus, tag, CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fn, 0) AS BIGINT) AS fn, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(negatives, 0) AS BIGINT) AS negatives FROM frame LEFT JOIN n USING (corpus, tag)),
r AS (SELECT *, CASE WHEN negatives > 0 THEN tp / nullif(tp + fp, 0) END AS precision, tp / nullif(support, 0) AS recall FROM m),
f AS (SELECT *, CASE WHEN (precision IS NULL AND recall = 0) OR (recall IS NULL AND precision = 0) THEN 0 WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN 4 * precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f FROM r)"""


def _measured(spark, sf_dir):
    catalogue = spark.createDataFrame([("quality",), ("toxic",), ("unseen",)], "tag string")
    return M.masked_metrics(scored(spark, sf_dir), catalogue, F.col("score") >= 0.6, ["corpus"])


@query("g_masked_metrics", S + "," + _masked + " SELECT corpus, tag, support, tp, fn, fp, negatives, precision, recall, f FROM f")
def g_masked_metrics(spark, sf_dir):
    return _measured(spark, sf_dir)


@query("g_equal_corpus", S + "," + _masked + " SELECT tag, avg(precision) AS precision, avg(recall) AS recall, avg(f) AS f FROM f GROUP BY tag")
def g_equal_corpus(spark, sf_dir):
    return M.equal_groups(_measured(spark, sf_dir), "corpus", ["tag"], ["precision", "recall", "f"])


@query("g_worst_group", S + "," + _masked + " SELECT tag, arg_min(corpus, (recall, corpus)) AS worst, min(recall) AS value FROM f WHERE recall IS NOT NULL GROUP BY tag")
def g_worst_group(spark, sf_dir):
    return M.worst_group(_measured(spark, sf_dir), "tag", "corpus", "recall")


@query("g_fbeta_family", S + """, n AS (SELECT tag, count(*) FILTER (WHERE gold AND score >= 0.6) AS tp, count(*) FILTER (WHERE gold AND score < 0.6) AS fn, count(*) FILTER (WHERE NOT gold AND complete AND score >= 0.6) AS fp FROM s GROUP BY tag)
SELECT tag, 1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0) AS f05, 2.0 * tp / nullif(2.0 * tp + fn + fp, 0) AS f1, 5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0) AS f2, 10.0 * tp / nullif(10.0 * tp + 9.0 * fn + fp, 0) AS f3, 26.0 * tp / nullif(26.0 * tp + 25.0 * fn + fp, 0) AS f5 FROM n""")
def g_fbeta_family(spark, sf_dir):
    n = M.tag_counts(scored(spark, sf_dir), F.col("score") >= 0.6, ["tag"])
    p, r = M.ratio(F.col("tp"), F.col("tp") + F.col("fp")), M.ratio(F.col("tp"), F.col("support"))
    return n.select("tag", *(M.fbeta(p, r, b).alias(a) for a, b in (("f05", 0.5), ("f1", 1.0), ("f2", 2.0), ("f3", 3.0), ("f5", 5.0))))


@query("g_top_k_ladder", S + """, r AS (SELECT doc_id, gold, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS rank FROM s), b AS (SELECT doc_id, bool_or(gold) AS has_gold, min(rank) FILTER (WHERE gold) AS best, doc_id % 3 <> 0 AS fired FROM r GROUP BY doc_id),
l AS (SELECT k, count(*) FILTER (WHERE fired AND best <= k) AS hit, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE has_gold) AS golds FROM b, (SELECT unnest([1, 3, 5]) AS k) AS ks GROUP BY k)
SELECT k, hit / fired AS precision, hit / golds AS recall, 2 * (hit / fired) * (hit / golds) / (hit / fired + hit / golds) AS f1 FROM l""")
def g_top_k_ladder(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return M.top_k_ladder(rows, rows.where("doc_id % 3 <> 0").select("doc_id"))


@query("g_kappa", """SELECT tag, "both", only_a, only_b, neither, CASE WHEN "both" > 0 THEN 2.0 * "both" / (2 * "both" + only_a + only_b) ELSE 0 END AS f1, "both" / ("both" + only_a + only_b) AS jaccard, ("both" + neither) / n AS agreement,
  (("both" + neither) / n - (("both" + only_a) * ("both" + only_b) + (only_b + neither) * (only_a + neither)) / (n * n)) / (1 - (("both" + only_a) * ("both" + only_b) + (only_b + neither) * (only_a + neither)) / (n * n)) AS kappa
FROM (SELECT tag, CAST(count(*) FILTER (WHERE a AND b) AS BIGINT) AS "both", CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE b AND NOT a) AS BIGINT) AS only_b, CAST(count(*) FILTER (WHERE NOT a AND NOT b) AS BIGINT) AS neither, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT 'quality' AS tag, quality = 1 AS a, doc_id % 4 > 0 AS b FROM labels UNION ALL SELECT 'toxic', toxic = 1, doc_id % 4 = 0 FROM labels) AS j GROUP BY tag) AS c""")
def g_kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    one = lambda tag, a, b: rows.select(F.col("doc_id").alias("doc_key"), F.lit(tag).alias("tag"), a.alias("a"), b.alias("b"))
    return M.agreement(one("quality", F.col("quality") == 1, F.col("doc_id") % 4 > 0).union(one("toxic", F.col("toxic") == 1, F.col("doc_id") % 4 == 0)))


@query("g_false_alarms", S + "SELECT count(*) AS n_docs, count(*) FILTER (WHERE n > 0) / count(*) AS alarm_rate, 1000.0 * sum(n) / count(*) AS per_thousand FROM (SELECT doc_id, count(*) FILTER (WHERE score >= 0.6) AS n FROM s WHERE NOT gold GROUP BY doc_id) AS d")
def g_false_alarms(spark, sf_dir):
    return M.false_alarms(scored(spark, sf_dir).where("NOT gold"), F.col("score") >= 0.6)


@query("g_latency", """SELECT source, avg(ms) AS mean, median(ms) AS p50, max(ms) FILTER (WHERE r = greatest(CAST(round_even(0.95 * n, 0) AS BIGINT), 1)) AS p95, max(ms) AS max, sum(size) / 1e6 / (sum(ms) / 1e3) AS mb_s
FROM (SELECT source, CAST(n_chars % 997 AS DOUBLE) / 10 + 1 AS ms, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY CAST(n_chars % 997 AS DOUBLE) / 10 + 1) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) AS d GROUP BY source""")
def g_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", ((F.col("n_chars") % 997).cast("double") / 10 + 1).alias("ms"), F.col("n_chars").alias("size"))
    return M.latency_summary(rows, "source", "ms", "size")


@query("g_slices", duck("""SELECT "group", count(*) AS n, avg(CAST(hit AS INT)) AS recall FROM (SELECT CASE WHEN greatest(a, b) < 0.5 THEN 'mixed' WHEN a >= b THEN 'first' ELSE 'second' END AS "group", k % 3 > 0 AS hit
  FROM (SELECT k, CAST(k % 10 AS DOUBLE) / 10 AS a, CAST((k * 7) % 10 AS DOUBLE) / 10 AS b FROM (""" + IDS + """) AS i) AS x) AS y GROUP BY "group" """))
def g_slices(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT CAST(k % 10 AS DOUBLE) / 10 AS a, CAST((k * 7) % 10 AS DOUBLE) / 10 AS b, k % 3 > 0 AS hit FROM ({IDS})", "customer")
    return M.slices(rows, {"first": "a", "second": "b"}, "hit")


# --- thresholds

_curve = """u AS (SELECT * FROM s WHERE gold OR complete), pts AS (SELECT tag, score AS threshold, count(*) FILTER (WHERE gold) AS p, count(*) FILTER (WHERE NOT gold) AS n FROM u GROUP BY tag, score),
c AS (SELECT tag, threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY tag) AS BIGINT) AS positives, CAST(sum(n) OVER (PARTITION BY tag) AS BIGINT) AS negatives FROM pts WINDOW w AS (PARTITION BY tag ORDER BY threshold DESC)),
curve AS (SELECT *, tp / (tp + fp) AS precision, tp / positives AS recall FROM c WHERE positives > 0)"""
_f = lambda b2: f"CASE WHEN {b2} * precision + recall = 0 THEN 0 ELSE {1 + b2} * precision * recall / ({b2} * precision + recall) END"


@query("g_threshold_sweep", S + "," + _curve + " SELECT tag, threshold, tp, fp, positives, negatives, precision, recall FROM curve")
def g_threshold_sweep(spark, sf_dir):
    return T.sweep(scored(spark, sf_dir), ["tag"])


_choose = "SELECT tag, threshold, precision, recall, positives AS support, ok AS floor_met FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ok DESC, {v} DESC, threshold DESC) AS r FROM (SELECT *, {ok} AS ok FROM {t}) AS a) AS b WHERE r = 1"


@query("g_best_threshold", S + "," + _curve + " " + _choose.replace("{ok}", "recall >= 0.75").replace("{v}", f"CASE WHEN ok THEN {_f(0.25)} ELSE recall END").replace("{t}", "curve"))
def g_best_threshold(spark, sf_dir):
    return T.best_threshold(scored(spark, sf_dir), ["tag"], 0.5, 0.75)


@query("g_box", S + "," + _curve + " " + _choose.replace("{ok}", "recall >= 0.5 AND precision >= 0.6").replace("{v}", _f(1.0)).replace("{t}", "curve"))
def g_box(spark, sf_dir):
    return T.box(scored(spark, sf_dir), ["tag"], 0.6, 0.5)


_caps = "caps AS (SELECT tag, min(cap) AS cap, count(*) AS n_groups FROM (SELECT tag, corpus, quantile_cont(score, 0.25) AS cap FROM s WHERE gold GROUP BY tag, corpus HAVING count(*) >= 5) AS q GROUP BY tag)"


@query("g_group_cap", S + "," + _caps + " SELECT tag, cap, n_groups FROM caps")
def g_group_cap(spark, sf_dir):
    return T.group_cap(scored(spark, sf_dir), ["tag"], "corpus", 0.75, 5)


@query("g_robust_threshold", S + "," + _curve + "," + _caps + f""" SELECT tag, threshold, precision, recall, positives AS support, ok AS floor_met FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ok DESC, under DESC, CASE WHEN ok THEN {_f(0.25)} ELSE recall END DESC, threshold DESC) AS r
FROM (SELECT *, under AND recall >= 0.75 AS ok FROM (SELECT curve.*, coalesce(threshold <= cap, FALSE) AS under FROM curve LEFT JOIN caps USING (tag)) AS a) AS b) AS c WHERE r = 1""")
def g_robust_threshold(spark, sf_dir):
    return T.robust_threshold(scored(spark, sf_dir), ["tag"], "corpus", least=5)


@query("g_document_cut", duck(f"""WITH d AS ({_docs}), u AS (SELECT gate AS threshold, count(*) FILTER (WHERE target) AS p, count(*) FILTER (WHERE NOT target) AS n FROM d WHERE target IS NOT NULL GROUP BY gate),
c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pos, sum(n) OVER () AS neg FROM u),
m AS (SELECT threshold, tp / (tp + fp) AS precision, tp / pos AS recall, (neg - fp) / neg AS spec, pos FROM c), o AS (SELECT *, recall >= 0.6 AND spec >= 0.3 AS ok, greatest(0.6 - recall, 0) + greatest(0.3 - spec, 0) AS deficit FROM m)
SELECT 'doc' AS scope, threshold, precision, recall, pos AS support, ok AS floor_met FROM o ORDER BY ok DESC, CASE WHEN ok THEN precision ELSE -deficit END DESC, threshold DESC LIMIT 1"""))
def g_document_cut(spark, sf_dir):
    return T.document_cut(base(spark, sf_dir, _docs, "documents"), 0.6, 0.3)


@query("g_lower_quantiles", S + "SELECT tag, q, score AS value FROM (SELECT tag, score, row_number() OVER (PARTITION BY tag ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY tag) AS n FROM s WHERE gold) AS r, (SELECT unnest([0.05, 0.1, 0.25]) AS q) AS qs WHERE i = floor(q * (n - 1))")
def g_lower_quantiles(spark, sf_dir):
    return T.lower_quantiles(scored(spark, sf_dir), ["tag"], [0.05, 0.1, 0.25])


@query("g_operating_curve", S + """SELECT scale, CAST(count(*) FILTER (WHERE gold AND score >= 0.5 * scale) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE complete AND NOT gold AND score >= 0.5 * scale) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE gold AND score < 0.5 * scale) AS BIGINT) AS fn
FROM s, (SELECT unnest([0.5, 1.0, 1.5]) AS scale) AS sc GROUP BY scale""")
def g_operating_curve(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return T.operating_curve(rows, rows.select("tag").distinct().withColumn("threshold", F.lit(0.5)), [0.5, 1.0, 1.5])


@query("g_wilson", S + """, n AS (SELECT corpus, tag, CAST(count(*) FILTER (WHERE gold AND score >= 0.6) AS DOUBLE) AS k, CAST(count(*) FILTER (WHERE gold) AS DOUBLE) AS n FROM s GROUP BY corpus, tag)
SELECT corpus, tag, round(CASE WHEN n > 0 THEN greatest(0, (k / n + 3.8414588206941227 / (2 * n) - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.8414588206941227 / (4 * n * n))) / (1 + 3.8414588206941227 / n)) ELSE 0 END, 12) AS low FROM n""")
def g_wilson(spark, sf_dir):
    n = M.tag_counts(scored(spark, sf_dir), F.col("score") >= 0.6, ["corpus", "tag"])
    return n.select("corpus", "tag", F.round(T.wilson_lower(F.col("tp"), F.col("support")), 12).alias("low"))


@query("g_auc", S + """, r AS (SELECT tag, gold, rank() OVER (PARTITION BY tag ORDER BY score) + (count(*) OVER (PARTITION BY tag, score) - 1) / 2.0 AS r FROM s)
SELECT tag, (sum(r) FILTER (WHERE gold) - count(*) FILTER (WHERE gold) * (count(*) FILTER (WHERE gold) + 1) / 2.0) / (count(*) FILTER (WHERE gold) * count(*) FILTER (WHERE NOT gold)) AS auc FROM r GROUP BY tag""")
def g_auc(spark, sf_dir):
    return T.roc_auc(scored(spark, sf_dir), ["tag"])


@query("g_spread", S + "SELECT tag, max(v) - min(v) AS threshold_spread, max(share) / nullif(min(share), 0) AS prevalence_ratio FROM (SELECT tag, corpus, quantile_cont(score, 0.5) FILTER (WHERE gold) AS v, avg(CAST(gold AS INT)) AS share FROM s GROUP BY tag, corpus) AS i GROUP BY tag")
def g_spread(spark, sf_dir):
    return T.spread(scored(spark, sf_dir), "tag", "corpus")


_bands = "b AS (SELECT low, high, count(*) AS n, avg(score) AS claimed, avg(CAST(gold AS INT)) AS actual FROM s JOIN (SELECT unnest([0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) AS low, unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.01]) AS high) AS e ON score >= low AND score < high GROUP BY low, high)"


@query("g_reliability", S + "," + _bands + " SELECT CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, n, claimed, actual FROM b")
def g_reliability(spark, sf_dir):
    return T.reliability(scored(spark, sf_dir))


@query("g_ece", S + "," + _bands + " SELECT sum(n * abs(claimed - actual)) / sum(n) AS ece FROM b")
def g_ece(spark, sf_dir):
    return T.calibration_error(T.reliability(scored(spark, sf_dir)))


@query("g_isotonic")
def g_isotonic(spark, sf_dir):
    return T.isotonic(scored(spark, sf_dir), "tag")


@query("g_calibrated")
def g_calibrated(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return T.calibrated(rows, T.isotonic(rows, "tag"), "tag").select("doc_id", "tag", F.round("calibrated", 9).alias("calibrated"))


@query("g_bootstrap")
def g_bootstrap(spark, sf_dir):
    rows = scored(spark, sf_dir)
    n = M.tag_counts(rows, F.col("score") >= 0.6, ["tag"]).join(rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "tag")
    return B.recall_interval(n, "tag")


@query("g_bootstrap_fbeta")
def g_bootstrap_fbeta(spark, sf_dir):
    """Compared with a plain bootstrap in tests."""
    fired = F.col("score") >= 0.6
    outcome = F.when(F.col("gold") & fired, "tp").when(F.col("gold"), "fn").when(F.col("complete") & fired, "fp")
    return B.fbeta_intervals(scored(spark, sf_dir).withColumn("outcome", outcome).where("outcome IS NOT NULL").select("doc_id", "tag", "outcome"))


@query("g_bootstrap_flags")
def g_bootstrap_flags(spark, sf_dir):
    n = scored(spark, sf_dir).groupBy("corpus").agg(F.count_if(F.col("score") >= 0.6).alias("yes"), F.count(F.lit(1)).alias("n"))
    return B.flag_interval(n, "corpus")


@query("g_bootstrap_clusters")
def g_bootstrap_clusters(spark, sf_dir):
    return B.cluster_interval(_measured(spark, sf_dir), "tag", "recall")


@query("g_policy", S + """, m AS (SELECT corpus AS arm, tag AS scope, count(*) FILTER (WHERE gold AND score >= 0.6) / nullif(count(*) FILTER (WHERE gold), 0) AS value, count(*) FILTER (WHERE gold) AS support FROM s GROUP BY corpus, tag),
o AS (SELECT arm, CASE WHEN value IS NOT NULL AND support >= 3 THEN value >= CASE scope WHEN 'quality' THEN 0.5 ELSE 0.4 END END AS ok FROM m),
d AS (SELECT arm, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE ok IS NULL) AS BIGINT) AS unmeasured FROM o GROUP BY arm)
SELECT *, CAST(row_number() OVER (ORDER BY failed = 0 DESC, passed DESC, arm) AS INTEGER) AS place FROM d""")
def g_policy(spark, sf_dir):
    n = M.tag_counts(scored(spark, sf_dir), F.col("score") >= 0.6, ["corpus", "tag"])
    measured = n.select(F.col("corpus").alias("arm"), F.col("tag").alias("scope"), F.lit("recall").alias("metric"), M.ratio(F.col("tp"), F.col("support")).alias("value"), "support")
    rules = spark.createDataFrame([("quality", "recall", 0.5, 3), ("toxic", "recall", 0.4, 3)], "scope string, metric string, at_least double, min_support int")
    return T.rank_arms(T.policy(measured, rules), "passed")


# --- features and linear models

# The feature names of a text. Shapes are told apart by existence alone, so lookarounds become context.
_toks = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z][a-zA-Z0-9’''_-]{0,39}|[0-9]+(?:[/.:-][0-9]+){0,5}'), lambda t: regexp_replace(replace(lower(t), '’', ''''), '[0-9]', '0', 'g'))"
_shape = {
    "card": "(^|[^0-9])([0-9][- ]?){13,19}($|[^0-9])", "email": "[-!#$%&''*+/=?^_`.{|}~a-zA-Z0-9]+@[-.a-zA-Z0-9]+[.][a-zA-Z]{2,}", "iban": "(?i)(^|[^0-9A-Z])[A-Z]{2}[0-9]{2}( ?[0-9A-Z]){11,30}($|[^0-9A-Z])",
    "ipv4": "(^|[^0-9])[0-9]{1,3}([.][0-9]{1,3}){3}($|[^0-9])", "ipv6": "(?i)(^|[^a-f0-9])([a-f0-9]{1,4}:){2,7}[a-f0-9]{0,4}($|[^a-f0-9])", "itin": "(^|[^0-9])9[0-9]{2}[ -]?(8[0-8]|7[0-9])[ -]?[0-9]{4}($|[^0-9])", "ssn": "(^|[^0-9])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}($|[^0-9])",
}
_shapes = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN 'r:{n}' END" for n, p in _shape.items())
_words = f"""SELECT doc_id, unnest(list_distinct(list_concat(list_concat(list_transform(toks, lambda x: 'u:' || x), list_concat(list_transform(plain, lambda x: 'p:' || left(x, 5)), list_transform(plain, lambda x: 's:' || right(x, 5)))),
  list_concat(list_transform(range(1, len(toks)), lambda i: 'b:' || toks[i] || '|' || toks[i + 1]), list_concat(list_filter(shapes, lambda x: x IS NOT NULL), [len0]))))) AS w
FROM (SELECT *, list_filter(list_transform(toks, lambda x: regexp_replace(x, '[^0-9a-z]+', '', 'g')), lambda x: regexp_full_match(x, '[a-z]{{6,}}')) AS plain
  FROM (SELECT doc_id, {_toks} AS toks, [{_shapes}] AS shapes, 'm:length:' || CAST(least(20, CAST(floor(log2(greatest(length(coalesce(text, '')), 1) + 1e-9)) AS BIGINT)) AS VARCHAR) AS len0 FROM documents) AS a) AS b"""


@query("f_token_features", f"SELECT w, count(*) AS df FROM ({_words}) AS x GROUP BY w")
def f_token_features(spark, sf_dir):
    return K.feature_sums(table(spark, sf_dir, "documents"), {"df": F.lit(1)}).withColumnRenamed("feature", "w")


@query("f_hashed")
def f_hashed(spark, sf_dir):
    """Compared with the CRC-32 of zlib in tests."""
    return K.hashed_texts(table(spark, sf_dir, "documents")).select("doc_id", F.size("features").alias("n"), F.array_join("features", ",").alias("features"))


@query("f_profiles")
def f_profiles(spark, sf_dir):
    """The read windows are the feature: a profile is defined by the characters, tokens and features that it keeps."""
    return K.profiled(table(spark, sf_dir, "documents")).select("doc_id", "profile", F.size("features").alias("n"), F.array_join("features", ",").alias("features"))


_tags = "SELECT doc_id, 'quality' AS tag, quality = 1 AS gold, doc_id % 5 <> 0 AS complete FROM {labels} UNION ALL SELECT doc_id, 'toxic', toxic = 1, doc_id % 5 <> 0 FROM {labels}"
_model = f"""WITH t AS ({duck(_tags)}), x AS MATERIALIZED ({_words}), docs AS (SELECT doc_id, bool_and(complete) AS complete FROM t GROUP BY doc_id),
seen AS (SELECT x.w, d.doc_id, d.complete FROM x JOIN docs d USING (doc_id)),
bf AS (SELECT w, count(*) AS df, count(*) FILTER (WHERE complete) AS cdf FROM seen GROUP BY w HAVING count(*) >= 2),
bc AS (SELECT t.tag, x.w, count(*) FILTER (WHERE t.complete) AS pc, count(*) FILTER (WHERE NOT t.complete) AS pp FROM x JOIN t USING (doc_id) WHERE t.gold GROUP BY t.tag, x.w),
bt AS (SELECT tag, count(*) FILTER (WHERE complete) AS nc, count(*) FILTER (WHERE gold AND complete) AS npc, count(*) FILTER (WHERE gold AND NOT complete) AS npp, count(*) AS n FROM t GROUP BY tag),
g AS (SELECT bt.tag, bf.w, bf.df, bt.n, (coalesce(pc, 0) + 0.5 * coalesce(pp, 0) + 1.0) / (npc + 0.5 * npp + 2.0) AS p, (greatest(cdf - coalesce(pc, 0), 0) + 1.0) / (nc - npc + 2.0) AS q FROM bf CROSS JOIN bt LEFT JOIN bc ON bc.tag = bt.tag AND bc.w = bf.w),
c AS (SELECT tag, w, df, n, least(greatest(p, 1e-6), 1 - 1e-6) AS p, least(greatest(q, 1e-6), 1 - 1e-6) AS q FROM g),
weights AS (SELECT tag, w AS feature, least(greatest(ln(p / (1 - p)) - ln(q / (1 - q)), -8), 8) AS w, df, n FROM c)"""


def _counts(spark, sf_dir, by_hash=False):
    """Counts of features and tags; by 64-bit hashes where nothing shows the names, so that rows are narrow."""
    return K.counts(table(spark, sf_dir, "documents"), base(spark, sf_dir, _tags, "labels"), by_hash=by_hash)


@query("k_log_odds", _model + " SELECT tag, feature, round(w, 9) AS w FROM weights")
def k_log_odds(spark, sf_dir):
    return K.log_odds(*_counts(spark, sf_dir)).withColumn("w", F.round("w", 9))


@query("k_tempered", _model + " SELECT tag, feature, round(w2, 9) AS w FROM (SELECT tag, feature, least(greatest(raw * pow(ln(n / greatest(df, 1)), 0.65), -8), 8) AS w2 FROM (SELECT tag, w AS feature, ln(p / (1 - p)) - ln(q / (1 - q)) AS raw, df, n FROM c) AS r) AS t")
def k_tempered(spark, sf_dir):
    return K.log_odds(*_counts(spark, sf_dir), idf="plain").withColumn("w", F.round("w", 9))


@query("k_tfidf", _model + " SELECT tag, feature, round(w * pow(least(greatest(ln((n + 1.0) / (df + 1.0)) + 1.0, 1.0), 6.0), 0.65), 9) AS w FROM weights")
def k_tfidf(spark, sf_dir):
    return K.log_odds(*_counts(spark, sf_dir), idf="smooth").withColumn("w", F.round("w", 9))


_scores = """, nx AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id), cells AS (SELECT x.doc_id, weights.tag, weights.w, row_number() OVER (PARTITION BY x.doc_id, weights.tag ORDER BY weights.w DESC) AS r FROM x JOIN weights ON x.w = weights.feature),
sc AS (SELECT doc_id, tag, sum(w) AS total, sum(w) / any_value(nx.n) AS mean, sum(CASE WHEN r <= 3 AND w > 0 THEN w ELSE 0 END) / least(any_value(nx.n), 3) AS top FROM cells JOIN nx USING (doc_id) GROUP BY doc_id, tag)"""


@query("k_scores", _model + _scores + " SELECT doc_id, tag, round(total, 4) AS total, round(mean, 4) AS mean, round(top, 4) AS top FROM sc")
def k_scores(spark, sf_dir):
    by_feature, by_tag = _counts(spark, sf_dir, by_hash=True)
    return K.scores(table(spark, sf_dir, "documents"), K.weights(by_feature, by_tag), [r["tag"] for r in by_tag]).select("doc_id", "tag", *(F.round(c, 4).alias(c) for c in ("total", "mean", "top")))


@query("k_cascade", _model + _scores + " SELECT doc_id, tag FROM sc WHERE doc_id % 100 >= 40 AND total >= 1.5")
def k_cascade(spark, sf_dir):
    by_feature, by_tag = _counts(spark, sf_dir, by_hash=True)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gate = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).cast("double").alias("gate"))
    thresholds = spark.createDataFrame([("quality", 1.5), ("toxic", 1.5)], "tag string, threshold double")
    return K.cascade(gate, 40.0, docs, K.weights(by_feature, by_tag), [r["tag"] for r in by_tag], thresholds)


@query("k_fusion_votes", """SELECT doc_id, tag FROM (SELECT doc_id, 'a' AS tag, doc_id % 2 = 0 OR doc_id % 3 = 0 AS f FROM labels UNION ALL SELECT doc_id, 'b', doc_id % 2 = 0 AND doc_id % 3 = 0 FROM labels UNION ALL
SELECT doc_id, 'c', CAST(doc_id % 2 = 0 AS INT) + CAST(doc_id % 3 = 0 AS INT) + CAST(doc_id % 5 = 0 AS INT) >= 2 FROM labels UNION ALL SELECT doc_id, 'd', doc_id % 5 = 0 FROM labels) AS v WHERE f""")
def k_fusion_votes(spark, sf_dir):
    arms = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), (F.col("doc_id") % m == 0).alias("fired")) for n, m in (("two", 2), ("three", 3), ("five", 5)))))
    tags = F.explode(F.array(*map(F.lit, "abcd"))).alias("tag")
    votes = table(spark, sf_dir, "labels").select("doc_id", tags).select("doc_id", "tag", arms.alias("v")).select("doc_id", "tag", "v.arm", "v.fired")
    plan = [("a", "or", ["two", "three"]), ("b", "and", ["two", "three"]), ("c", "majority", ["two", "three", "five"]), ("d", "source", ["five"])]
    return K.fuse(votes, spark.createDataFrame(plan, "tag string, how string, arms array<string>"))


@query("k_hybrid", "SELECT doc_id, tag FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS tag, doc_id % 2 = 0 AS a FROM labels) AS x WHERE (a AND tag = 'toxic') OR (NOT a AND tag <> 'toxic')")
def k_hybrid(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("tag"))
    return K.hybrid(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 <> 0"), ["toxic"])


@query("k_bag_vectors", "SELECT label, dim - 1 AS dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 9) AS mean, max(CAST(embedding[dim] AS DOUBLE)) AS top FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) AS e GROUP BY label, dim")
def k_bag_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return K.bag_vectors(rows.select("vec_id", "label"), rows.select("vec_id", "embedding"), "label").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 9).alias("mean"), "top")


@query("k_cosine", """WITH e AS (SELECT vec_id, label, dim, CAST(embedding[dim] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) AS a), m AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY label, dim)
SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS cosine FROM e JOIN m USING (label, dim) GROUP BY vec_id""")
def k_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    centre = K.bag_vectors(rows.select("vec_id", "label"), rows.select("vec_id", "embedding"), "label").select("label", "dim", "mean")
    return K.cosine_to(rows, centre).withColumn("cosine", F.round("cosine", 6))


# --- tokens

_tokens = f"""SELECT k AS doc_id, p AS pos, p * 5 AS gs, p * 5 + 4 AS ge, CASE WHEN (k + p) % 4 = 0 THEN 'O' WHEN (k + p) % 4 = 1 THEN 'B-NAME' WHEN (k + p) % 4 = 2 THEN 'I-NAME' ELSE 'B-CITY' END AS label, CAST((k + p) % 10 AS DOUBLE) / 10 AS prob
FROM ({IDS}) AS i CROSS JOIN (SELECT CAST(id AS BIGINT) AS p FROM {{range8}}) AS r"""


def _token_rows(spark, sf_dir):
    return base(spark, sf_dir, _tokens.replace("{range8}", "range(8)"), "customer").select("doc_id", "pos", F.col("gs").alias("start"), F.col("ge").alias("end"), "label", "prob")


_tokens_duck = duck(_tokens).replace("{range8}", "range(8) AS t(id)")


@query("n_bio_decode", f"""WITH t AS (SELECT *, CASE WHEN label = 'O' THEN NULL ELSE split_part(label, '-', 2) END AS type FROM ({_tokens_duck}) AS x),
o AS (SELECT *, CASE WHEN type IS NOT NULL AND (type IS DISTINCT FROM lag(type) OVER w OR label LIKE 'B-%') THEN 1 ELSE 0 END AS opens FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM o)
SELECT doc_id, type, min(gs) AS start, max(ge) AS "end", round(avg(prob), 9) AS confidence FROM i WHERE type IS NOT NULL GROUP BY doc_id, island, type""")
def n_bio_decode(spark, sf_dir):
    return N.bio_decode(_token_rows(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


_name_spans = f"SELECT k AS doc_id, 'NAME' AS type, 5 AS gs, 14 AS ge FROM ({IDS}) AS i"


@query("n_bio_encode", f"""SELECT doc_id, pos, CASE pos WHEN 1 THEN 'B-NAME' WHEN 2 THEN 'I-NAME' ELSE 'O' END AS label FROM ({_tokens_duck}) AS t""")
def n_bio_encode(spark, sf_dir):
    spans = base(spark, sf_dir, _name_spans, "customer").select("doc_id", "type", F.col("gs").alias("start"), F.col("ge").alias("end"))
    return N.bio_encode(_token_rows(spark, sf_dir), spans)


@query("n_word_f", f"""WITH t AS ({_tokens_duck}), g AS (SELECT doc_id, pos, label FROM t WHERE label <> 'O'), p AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN 'B-NAME' ELSE label END AS label FROM t WHERE label <> 'O' AND pos < 6),
n AS (SELECT CAST(count(*) FILTER (WHERE g.pos IS NOT NULL AND p.pos IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE g.pos IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE p.pos IS NULL) AS BIGINT) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.pos = p.pos AND g.label = p.label)
SELECT tp, fp, fn, 26.0 * tp / (26.0 * tp + 25.0 * fn + fp) AS f FROM n""")
def n_word_f(spark, sf_dir):
    rows = _token_rows(spark, sf_dir)
    pred = rows.where("label <> 'O' AND pos < 6").withColumn("label", F.when(F.col("doc_id") % 3 == 0, "B-NAME").otherwise(F.col("label")))
    return N.word_micro_f(rows, pred)


@query("n_adjacent_merge", duck(f"SELECT k AS doc_id, 'PERSON_NAME' AS type, 0 AS start, 9 AS \"end\", round((0.8 * 4 + 0.5 * 4) / 8, 9) AS confidence FROM ({IDS}) AS i WHERE k % 2 = 0 UNION ALL SELECT k, 'PERSON_NAME', unnest([0, 5]), unnest([4, 9]), unnest([0.8, 0.5]) FROM ({IDS}) AS i WHERE k % 2 = 1"))
def n_adjacent_merge(spark, sf_dir):
    ids = base(spark, sf_dir, IDS, "customer").select(F.col("k").alias("doc_id"))
    texts = ids.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Jane, Doe").otherwise("Jane/ Doe").alias("text")).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "Jane Doee").otherwise("Jane/Doee"))
    one = lambda a, b, c: ids.select("doc_id", F.lit("PERSON_NAME").alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("confidence"))
    return N.merge_adjacent(one(0, 4, 0.8).union(one(5, 9, 0.5)), texts).withColumn("confidence", F.round("confidence", 9))


@query("n_chunks", duck(f"SELECT k, CAST(greatest(i * 6 - 2, 0) AS INTEGER) AS start, CAST(least(i * 6 + 8, n) AS INTEGER) AS \"end\" FROM (SELECT k, CAST(k % 40 AS INTEGER) AS n, unnest(range(0, 7)) AS i FROM ({IDS}) AS x) AS y WHERE i * 6 < n"))
def n_chunks(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT k, CAST(k % 40 AS INT) AS n FROM ({IDS})", "customer")
    return rows.select("k", F.explode(N.chunks(F.col("n"), 10, 2)).alias("c")).select("k", F.col("c.start").cast("int").alias("start"), F.col("c.end").cast("int").alias("end"))


@query("n_token_offsets", "SELECT doc_id, len(w) AS n, list_sum(list_transform(w, lambda x: length(x) + 1)) - 1 AS last_end FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL) AS d")
def n_token_offsets(spark, sf_dir):
    w = F.split(F.col("text"), " ")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", w.alias("w"))
    spans = N.token_offsets(F.col("w"), F.transform("w", lambda x: F.lit(True)))
    return rows.select("doc_id", spans.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_max(F.col("s.end")).cast("bigint").alias("last_end"))
