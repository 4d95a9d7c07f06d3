"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic model over surface features, fitted on at most TRAIN_ROWS labelled rows. Its
host and the path level below have posteriors of their own: grouped sums of the evidence, shrunk to the level above
by a strength that the spread between groups gives (method of moments), so a site of a few documents says little and
the global rate fills in. A document's own share is taken out of its groups before they judge it. The three are
combined as log odds.

Documents carry no URL: their source is the host level and their lang the path level; both are parameters.

All features and scores are built-in expressions; groups are pre-aggregated sums, so a host with a third of all rows
costs one row a task. Only the fit's bounded sample and single-row aggregates reach the driver.

Defined cases: a null or empty text has zero for every feature; null hosts and paths are groups of their own; repeated
label rows of a doc_id are averaged (half or more is good), labels with nulls are left out; repeated documents are
scored one by one; without labels of both classes the evidence is 1/2 for all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternsift.llm.common import settle, slim, words_of

#: Labelled rows the evidence model is fitted on, at most (those of the least hash of doc_id).
TRAIN_ROWS = 20_000
RIDGE = 1.0
#: The combined probability of good quality from which a document is kept.
KEEP_AT = 0.5
#: Evidence is kept off 0 and 1 by this much, so that no document outvotes everything by rounding.
FLOOR = 1e-4
#: Shrinkage strengths stay in this range, in documents.
STRENGTH = (5.0, 1e6)
FEATURES = ("symbols", "bangs", "bars", "caps", "digits", "distinct", "length", "ends", "size")


def features(text: Column, words: Column) -> list[Column]:
    """FEATURES of a non-null text and its words."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    return [
        count("[#*$%&<>]") / chars,
        count("!") / n,
        count("[|]") / n,
        count(r"\p{Lu}") / chars,
        count("[0-9]") / chars,
        F.size(F.array_distinct(words)) / n / F.pow(n, F.lit(-0.15)),
        F.least(chars / n, F.lit(20.0)),
        count(r"[.!?](?=\s*(\n|$))") / F.greatest(count("\n") + 1, F.lit(1.0)),
        F.log1p(n),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias over raw features of a ridge logistic regression, by Newton's method."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(len(FEATURES)), 0.0
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(mean: float | None, spread: float | None) -> float:
    """Beta strength whose variance is the spread between groups."""
    if mean is None or spread is None or spread <= 0:
        return STRENGTH[1]
    return float(min(max(mean * (1 - mean) / spread - 1, STRENGTH[0]), STRENGTH[1]))


def _spread(groups: DataFrame, centre: Column) -> float | None:
    """Variance of group rates around their centre beyond what the groups' sizes explain; groups of two or more."""
    rate = F.col("s") / F.col("n")
    excess = F.pow(rate - centre, 2) * F.col("n") - rate * (1 - rate)
    return groups.where("n > 1").agg(F.sum(excess) / F.sum(F.col("n") - 1)).first()[0]


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score and kept of every row."""
    text = F.coalesce("text", F.lit(""))
    base = slim(docs, *dict.fromkeys(("doc_id", "text", host, path))).select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), text.alias("text"), words_of(text).alias("words"))
    base = settle(base.select("doc_id", "host", "path", *(c.cast("double").alias(k) for k, c in zip(FEATURES, features(F.col("text"), F.col("words"))))))

    good = slim(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = base.select("doc_id", *FEATURES).join(F.broadcast(sample), "doc_id").orderBy("doc_id", *FEATURES).toPandas()
    weights, bias = fit(rows[list(FEATURES)].to_numpy(float), rows["good"].to_numpy(float))

    margin = F.lit(bias)
    for k, w in zip(FEATURES, weights):
        margin = margin + F.col(k) * F.lit(float(w))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))
    seen = base.select("doc_id", "host", "path", F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1 - FLOOR)).alias("p"))

    by_path = settle(seen.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s")))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = by_host.agg(F.sum("n"), F.sum("s")).first()
    rate = total[1] / total[0] if total[0] else 0.5
    m_host = _strength(rate, _spread(by_host, F.lit(rate)))
    hosts = by_host.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    groups = by_path.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m_path = _strength(rate, _spread(groups, F.col("host_s") / F.col("host_n")))

    groups = groups.select(F.col("host").alias("h"), F.col("path").alias("q"), F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s")
    joined = seen.join(groups, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    shrunk = lambda s, n, prior, m: (s - F.col("p") + m * prior) / (n - 1 + m)
    joined = joined.withColumn("host_rate", shrunk(F.col("host_s"), F.col("host_n"), F.lit(rate), F.lit(m_host)))
    joined = joined.withColumn("path_rate", shrunk(F.col("path_s"), F.col("path_n"), F.col("host_rate"), F.lit(m_path)))
    inside = lambda c: F.least(F.greatest(c, F.lit(FLOOR)), F.lit(1 - FLOOR))
    odds = _logit(F.col("p")) + _logit(inside(F.col("path_rate"))) - _logit(inside(F.lit(rate)))
    joined = joined.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    return joined.select("doc_id", F.round("p", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), "score", (F.col("score") >= KEEP_AT).alias("kept"))
