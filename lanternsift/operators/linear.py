"""Linear models of the document tagger: training, low-rank factors, heads over embeddings, fusion, equivalence.

Weights are a dimension (tags by hashed buckets); the fits run as Spark ML jobs over sparse vectors, whose state is
a vector of weights however many rows there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vectors(features: DataFrame, buckets: int) -> DataFrame:
    """features (doc_id, features array<int>) with a sparse vector x of ones."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def vector(ids):
        return SparseVector(buckets, sorted(set(ids or [])), [1.0] * len(set(ids or [])))

    return features.withColumn("x", vector("features"))


def fit_gate(features: DataFrame, labels: DataFrame, buckets: int, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic gate. labels: doc_id, target, weight; a NULL target isn't learned from."""
    from pyspark.ml.classification import LogisticRegression

    rows = _vectors(features.join(labels.where("target IS NOT NULL"), "doc_id"), buckets).select("x", F.col("target").cast("double").alias("y"), F.col("weight").cast("double").alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=ridge, maxIter=rounds, standardization=False).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


def fit_heads(features: DataFrame, tags: DataFrame, buckets: int, least: int = 20, ridge: float = 1e-3, rounds: int = 50) -> dict[str, tuple[np.ndarray, float]]:
    """One logistic head a tag with enough positives. tags: doc_id, tag, gold, complete.

    A row that is neither gold nor complete has no weight for its tag. The loop is over tags, a dimension.
    """
    support = tags.where("gold").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("tag").collect()
    out = {}
    for r in support:
        rows = tags.where(F.col("tag") == r["tag"]).select("doc_id", F.col("gold").alias("target"), F.when(F.col("gold") | F.col("complete"), 1.0).otherwise(0.0).alias("weight"))
        out[r["tag"]] = fit_gate(features, rows.where("weight > 0"), buckets, ridge, rounds)
    return out


def weight_rows(spark, heads: dict[str, tuple[np.ndarray, float]]) -> tuple[DataFrame, DataFrame]:
    """Heads as tables: (tag, feature, w) of weights that aren't zero, and (tag, bias)."""
    cells = [(t, int(i), float(w[i])) for t, (w, _) in sorted(heads.items()) for i in np.flatnonzero(w)]
    return spark.createDataFrame(cells, "tag string, feature int, w double"), spark.createDataFrame([(t, b) for t, (_, b) in sorted(heads.items())], "tag string, bias double")


def low_rank(weights: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature embeddings (features x rank) and head (tags x rank) whose product is the best fit to the positive weights."""
    if not 0 < rank <= min(weights.shape):
        raise ValueError("the rank must lie between one and the smaller side")
    u, s, vt = np.linalg.svd(np.maximum(weights, 0.0), full_matrices=False)
    # The sign of each pair of vectors is free: the largest entry of a feature's is positive, so results repeat.
    sign = np.sign(vt[np.arange(rank), np.abs(vt[:rank]).argmax(axis=1)])
    scale = np.sqrt(s[:rank]) * sign
    return vt[:rank].T * scale, u[:, :rank] * scale


def bag_scores(features: DataFrame, embeddings: DataFrame, head: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tag, score: the head over the mean of the features' embeddings.

    features: key, feature; embeddings: feature, dim, x; head: tag, dim, w, both dimensions. A document without any
    known feature has an empty bag and scores zero.
    """
    n = features.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bag = features.join(embeddings, "feature").groupBy(key, "dim").agg(F.sum("x").alias("x"))
    cells = bag.join(F.broadcast(head), "dim").groupBy(key, "tag").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    every = n.join(F.broadcast(head.select("tag").distinct()), how="cross").join(cells, [key, "tag"], "left")
    return every.select(key, "tag", F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("score"))


def content_scores(pooled: DataFrame, scaling: DataFrame, head: DataFrame, bias: DataFrame, key: str) -> DataFrame:
    """key, tag, score of a head over standardised [mean, maximum] vectors.

    pooled: key, dim, mean, top; scaling: part (mean or top), dim, mu, sd; head: tag, part, dim, w; bias: tag, bias.
    """
    parts = pooled.select(key, "dim", F.explode(F.array(F.struct(F.lit("mean").alias("part"), F.col("mean").alias("x")), F.struct(F.lit("top").alias("part"), F.col("top").alias("x")))).alias("p")).select(key, "dim", "p.part", "p.x")
    z = parts.join(F.broadcast(scaling), ["part", "dim"]).withColumn("z", (F.col("x") - F.col("mu")) / F.col("sd"))
    s = z.join(F.broadcast(head), ["part", "dim"]).groupBy(key, "tag").agg(F.sum(F.col("z") * F.col("w")).alias("s"))
    return s.join(F.broadcast(bias), "tag").select(key, "tag", (F.col("s") + F.col("bias")).alias("score"))


def scaling_of(pooled: DataFrame) -> DataFrame:
    """part, dim, mu, sd of pooled vectors."""
    sides = [pooled.groupBy("dim").agg(F.avg(c).alias("mu"), F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias("sd")).withColumn("part", F.lit(c)) for c in ("mean", "top")]
    return sides[0].union(sides[1]).select("part", "dim", "mu", "sd")


def fuse_content(cascade: DataFrame, content: DataFrame, picks: dict[str, str]) -> DataFrame:
    """doc_id, tag that fire: by tag the cascade's word, the content's, either or both (cascade unless picked)."""
    both = cascade.select("doc_id", "tag").distinct().withColumn("a", F.lit(True)).join(content.select("doc_id", "tag").distinct().withColumn("b", F.lit(True)), ["doc_id", "tag"], "full_outer")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    rule = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(picks.items()) for x in kv)), F.col("tag")), F.lit("cascade")) if picks else F.lit("cascade")
    return both.where(F.when(rule == "content", b).when(rule == "or", a | b).when(rule == "and", a & b).otherwise(a)).select("doc_id", "tag")


def fuse_documents(cascade: DataFrame, content: DataFrame, rule: str) -> DataFrame:
    """doc_id of documents that fire as a whole under the rule; cascade and content: doc_id of those that fire by each."""
    a, b = cascade.select("doc_id").distinct(), content.select("doc_id").distinct()
    return {"cascade": lambda: a, "content": lambda: b, "or": lambda: a.union(b).distinct(), "and": lambda: a.join(b, "doc_id", "left_semi")}[rule]()


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side; none if a cached and a direct result agree."""
    names = sorted(a.columns)
    x, y = a.select(*names), b.select(*names)
    return x.exceptAll(y).withColumn("side", F.lit("first")).union(y.exceptAll(x).withColumn("side", F.lit("second")))


def histogram(value: Column, width: int = 40) -> Column:
    """A share between 0 and 1 as a bar."""
    return F.when(value.isNotNull(), F.repeat(F.lit("#"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * width).cast("int")))


def table_lines(rows: DataFrame, columns: dict[str, tuple[int, str]], order: list[Column], bar: str | None = None) -> DataFrame:
    """line, text: a report of fixed widths, headed by the names. columns: name to (width, %-format or s).

    A report is read by people: rows are a summary, numbered in one task.
    """
    from pyspark.sql import Window

    def cell(name: str, width: int, form: str) -> Column:
        c = F.col(name)
        shown = F.when(c.isNull(), F.lit("n/a")).otherwise(c.cast("string") if form == "s" else F.format_string(form, c))
        return F.rpad(shown, width, " ") if form == "s" else F.lpad(shown, width, " ")

    head = " ".join(n.ljust(w) if f == "s" else n.rjust(w) for n, (w, f) in columns.items())
    body = F.concat_ws(" ", *(cell(n, w, f) for n, (w, f) in columns.items()), *([histogram(F.col(bar))] if bar else []))
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("line"), F.rtrim(body).alias("text"))
    return rows.sparkSession.createDataFrame([(0, head.rstrip())], "line int, text string").union(numbered)
