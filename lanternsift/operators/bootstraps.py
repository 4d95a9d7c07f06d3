"""Bootstrap intervals. Draws are over counts or bounded blocks of documents; every one is repeatable by its seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS = 1000
#: Draws whose weights are held at a time.
BLOCK = 250


def recall_interval(counts: DataFrame, by: str, draws: int = DRAWS, seed: int = 17, confidence: float = 0.95) -> DataFrame:
    """by, recall, low, high of rows (by, tp, fn, n): documents drawn with replacement, as multinomial draws of (tp, fn, other)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tp, fn, n = (int(part[c].sum()) for c in ("tp", "fn", "n"))
        low = high = recall = None
        if tp + fn:
            got = np.random.default_rng(seed).multinomial(n, np.array([tp, fn, n - tp - fn]) / n, draws)
            support = got[:, 0] + got[:, 1]
            rates = got[support > 0, 0] / support[support > 0]
            recall = tp / (tp + fn)
            low, high = np.quantile(rates, ((1 - confidence) / 2, (1 + confidence) / 2))
        return pd.DataFrame({by: part[by].iloc[:1], "recall": [recall], "low": [low], "high": [high]}).astype({"recall": float, "low": float, "high": float})

    kind = counts.schema[by].dataType.simpleString()
    return counts.select(by, "tp", "fn", "n").groupBy(by).applyInPandas(one, f"{by} {kind}, recall double, low double, high double")


def _f(p: np.ndarray, r: np.ndarray, beta: float) -> np.ndarray:
    b2 = beta * beta
    bottom = b2 * p + r
    return np.divide((1 + b2) * p * r, bottom, out=np.zeros_like(bottom), where=bottom > 0)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def fbeta_intervals(outcomes: DataFrame, beta: float = 2.0, draws: int = DRAWS, seed: int = 23, confidence: float = 0.95, parts: int = 64) -> DataFrame:
    """measure (macro, micro), value, low, high of F-beta over documents drawn with replacement.

    outcomes: doc_id, tag, outcome (tp, fp or fn). A draw weighs each document by a Poisson number of its own (the limit of
    the multinomial for many documents), so documents are drawn where they are: each of the parts adds up its weighted
    counts by draw and tag, and only these sums meet.
    """
    wide = outcomes.groupBy("doc_id", "tag").agg(*(F.count_if(F.col("outcome") == c).cast("double").alias(c) for c in ("tp", "fp", "fn")))

    def weighted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "tag"])
        names, tag = np.unique(part["tag"].to_numpy(object).astype(str), return_inverse=True)
        docs, row = np.unique(part["doc_id"].to_numpy(), return_inverse=True)
        cells = np.zeros((3, len(docs), len(names)))
        for k, c in enumerate(("tp", "fp", "fn")):
            np.add.at(cells[k], (row, tag), part[c].to_numpy(float))
        rng, sums = np.random.default_rng([seed, int(part["_part"].iloc[0])]), [cells.sum(axis=1)[:, None, :]]
        for lo in range(0, draws, BLOCK):
            w = rng.poisson(1.0, (min(BLOCK, draws - lo), len(docs))).astype(float)
            sums.append(np.stack([w @ c for c in cells]))
        tp, fp, fn = np.concatenate(sums, axis=1)  # (draw, tag); draw 0 is the sample itself
        draw = np.repeat(np.arange(len(tp)), len(names))
        return pd.DataFrame({"draw": draw.astype(np.int32), "tag": np.tile(names, len(tp)), "tp": tp.ravel(), "fp": fp.ravel(), "fn": fn.ravel()})

    spread = wide.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    sums = spread.groupBy("_part").applyInPandas(weighted, "draw int, tag string, tp double, fp double, fn double")
    by_draw = sums.groupBy("draw", "tag").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))

    def measured(part: pd.DataFrame) -> pd.DataFrame:
        tp, fp, fn = (part[c].to_numpy(float) for c in ("tp", "fp", "fn"))
        macro = _f(_over(tp, tp + fp), _over(tp, tp + fn), beta).mean()
        whole = [np.array([x.sum()]) for x in (tp, fp, fn)]
        micro = _f(_over(whole[0], whole[0] + whole[1]), _over(whole[0], whole[0] + whole[2]), beta)[0]
        return pd.DataFrame({"draw": [part["draw"].iloc[0]] * 2, "measure": ["macro", "micro"], "f": [macro, micro]})

    each = by_draw.groupBy("draw").applyInPandas(measured, "draw int, measure string, f double")
    a = (1 - confidence) / 2
    return each.groupBy("measure").agg(F.max(F.when(F.col("draw") == 0, F.col("f"))).alias("value"), F.expr(f"percentile(CASE WHEN draw > 0 THEN f END, {a})").alias("low"), F.expr(f"percentile(CASE WHEN draw > 0 THEN f END, {1 - a})").alias("high"))


def flag_interval(counts: DataFrame, by: str, draws: int = DRAWS, seed: int = 29, confidence: float = 0.95) -> DataFrame:
    """by, rate, low, high of a yes-or-no outcome; counts: by, yes, n. Draws of n flags are binomial."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        yes, n = int(part["yes"].sum()), int(part["n"].sum())
        rate = low = high = None
        if n:
            rate = yes / n
            low, high = np.quantile(np.random.default_rng(seed).binomial(n, rate, draws) / n, ((1 - confidence) / 2, (1 + confidence) / 2))
        return pd.DataFrame({by: part[by].iloc[:1], "rate": [rate], "low": [low], "high": [high]}).astype({"rate": float, "low": float, "high": float})

    kind = counts.schema[by].dataType.simpleString()
    return counts.select(by, "yes", "n").groupBy(by).applyInPandas(one, f"{by} {kind}, rate double, low double, high double")


def cluster_interval(values: DataFrame, by: str, value: str = "value", draws: int = DRAWS, seed: int = 31, confidence: float = 0.95) -> DataFrame:
    """by, value, low, high: the mean over corpora, with whole corpora drawn; a corpus is a row, so groups are small."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(part[value].dropna().to_numpy(float))
        mean = low = high = None
        if len(x):
            got = np.random.default_rng(seed).choice(x, (draws, len(x))).mean(axis=1)
            mean, (low, high) = x.mean(), np.quantile(got, ((1 - confidence) / 2, (1 + confidence) / 2))
        return pd.DataFrame({by: part[by].iloc[:1], "value": [mean], "low": [low], "high": [high]}).astype({"value": float, "low": float, "high": float})

    kind = values.schema[by].dataType.simpleString()
    return values.select(by, value).groupBy(by).applyInPandas(one, f"{by} {kind}, value double, low double, high double")
