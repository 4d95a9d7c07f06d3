"""Hashed text features, sufficient statistics and linear scores of the document tagger."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lanternsift.functions.fence import behind, fenced
from lanternsift.operators import feature_text as T

BUCKETS = 1 << 17
#: Named read windows: characters, tokens and features that a profile keeps. Whole texts are read unless one is asked for.
PROFILES = {"fast": (1_000, 768, 512), "standard": (4_000, 768, 512), "deep": (12_000, 2_048, 1_024)}
_RUN = r"[0-9]+(?:[/.:-][0-9]+){0,5}"
TOKEN = rf"[a-zA-Z][a-zA-Z0-9’'_-]{{0,39}}|{_RUN}"
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_IP = r"[0-9]{1,3}"
SHAPES = {
    "card": r"(?<![0-9])(?:[0-9][- ]?){13,19}(?![0-9])",
    "email": r"[-!#$%&'*+/=?^_`.{|}~a-zA-Z0-9]+@[-.a-zA-Z0-9]+[.][a-zA-Z]{2,}",
    "iban": r"(?i)(?<![0-9A-Z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Z])",
    "ipv4": rf"(?<![0-9]){_IP}(?:[.]{_IP}){{3}}(?![0-9])",
    "ipv6": r"(?i)(?<![a-f0-9])(?:[a-f0-9]{1,4}:){2,7}[a-f0-9]{0,4}(?![a-f0-9])",
    "itin": r"(?<![0-9])9[0-9]{2}[ -]?(?:8[0-8]|7[0-9])[ -]?[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![0-9])",
}


def normal_tokens(text: Column, max_tokens: Column | int | None = None) -> Column:
    """Tokens in lower case with digits as 0; values don't survive, shapes do. All of a text's, or the first max_tokens."""
    # One pass over the text instead of three over each token; tokens are ASCII but for the apostrophe.
    folded = F.translate(text, _UPPER + "’" + _DIGITS, _UPPER.lower() + "'" + "0" * len(_DIGITS))
    found = F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))
    return found if max_tokens is None else F.slice(found, F.lit(1), max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens))


def feature_names(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and names: the distinct word, affix, bigram, shape and length features of each text (feature_text)."""

    @F.arrow_udf("array<string>")
    def named(texts: pa.Array) -> pa.Array:
        return _lists([pa.array(T.names(raw, n), pa.binary()) for raw, n in T.texts(texts)], pa.binary()).cast(pa.list_(pa.string()))

    return docs.select(key, named(F.col(text)).alias("names"))


def _lists(rows: list[pa.Array], kind: pa.DataType) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.concat_arrays(rows) if rows else pa.array([], kind))


def feature_sums(docs: DataFrame, sums: dict[str, Column], text: str = "text", by_hash: bool = False) -> DataFrame:
    """feature (its name or 64-bit hash) and, of each number, the sum over the documents that have the feature.

    Each task adds up a bounded number of features first, so they are shuffled by feature and not by document.
    """
    width, add = len(sums), T.hashed_sums if by_hash else T.named_sums
    numbers = F.array(*(c.cast("bigint") for c in sums.values()))
    parts = docs.select(F.col(text), numbers.alias("v")).mapInArrow(lambda batches: add(batches, width), f"feature {'bigint' if by_hash else 'string'}, " + ", ".join(f"s{i} bigint" for i in range(width)))
    return parts.groupBy("feature").agg(*(F.sum(f"s{i}").alias(n) for i, n in enumerate(sums)))


def hashed(names: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, most: Column | int | None = None) -> DataFrame:
    """key and features: sorted distinct CRC-32 buckets, thinned evenly to most where that is given."""
    ids = F.array_sort(F.array_distinct(F.transform("names", lambda n: F.crc32(n.cast("binary")).bitwiseAND(F.lit(buckets - 1)))))
    if most is None:
        return names.select(key, ids.alias("features"))
    base = fenced(names.select(key, "names"), {"_f": ids})
    f, n, most = F.col("_f"), F.size("_f"), most if isinstance(most, Column) else F.lit(most)
    thin = F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.get(f, F.floor(i * (n / most.cast("double"))).cast("int")))
    return base.select(key, behind(F.when(n > most, thin).otherwise(f)).alias("features"))


def hashed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """As hashed(feature_names(docs)), without the names between."""

    @F.arrow_udf("array<bigint>")
    def ids(texts: pa.Array) -> pa.Array:
        return _lists([pa.array(T.buckets(raw, n, buckets), pa.int64()) for raw, n in T.texts(texts)], pa.int64())

    return docs.select(key, ids(F.col(text)).alias("features"))


def profiled(docs: DataFrame, profiles: dict[str, tuple[int, int, int]] | None = None, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """key, profile and features of every read window, from one read of the table."""
    windows = sorted((profiles or PROFILES).items())

    @F.arrow_udf("array<struct<profile:string,features:array<bigint>>>")
    def each(texts: pa.Array) -> pa.Array:
        made = []
        for raw, n in T.texts(texts):
            whole = None if n == len(raw) else raw.decode("utf-8", "replace")
            cuts, ids = {}, {}  # windows that see the same of a text share its buckets
            for _, (chars, tokens, most) in windows:
                if (size := min(n, chars)) not in cuts:
                    cut = raw if size == n else raw[:size] if whole is None else whole[:size].encode()
                    cuts[size] = cut, T.tokens(cut)
                cut, found = cuts[size]
                if (seen := (size, min(len(found), tokens))) not in ids:
                    ids[seen] = T.buckets(cut, size, buckets, found[:tokens])
                made.append(pa.array(T.thinned(ids[seen], most), pa.int64()))
        items = pa.StructArray.from_arrays([pa.array([p for p, _ in windows] * len(texts), pa.string()), _lists(made, pa.int64())], ["profile", "features"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(windows)), items)

    return docs.select(key, F.explode(each(F.col(text))).alias("p")).select(key, "p.profile", "p.features")


def csr(features: DataFrame, key: str = "doc_id") -> tuple:
    """indptr, indices and keys of a bounded part of features, for linear algebra in one place; a corpus stays a table."""
    rows = features.orderBy(key).select(key, "features").toArrow()
    sizes = [len(f) for f in rows["features"].to_pylist()]
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array([i for f in rows["features"].to_pylist() for i in f], np.int32), rows[key].to_numpy()


def counts(docs: DataFrame, tags: DataFrame, key: str = "doc_id", text: str = "text", by_hash: bool = False) -> tuple[DataFrame, list[Row]]:
    """(feature, df, complete_df and pos_complete_i, pos_partial_i of each tag), and the tags' own counts, a dimension.

    tags: key, tag, gold, complete, one row a document and tag. Only texts with tags are read for features, once.
    """
    gold, complete = F.coalesce("gold", F.lit(False)), F.coalesce("complete", F.lit(False))
    by_tag = tags.groupBy("tag").agg(
        F.count_if(complete).alias("n_complete"), F.count_if(gold & complete).alias("n_pos_complete"),
        F.count_if(gold & ~complete).alias("n_pos_partial"), F.count(F.lit(1)).alias("n"),
    ).orderBy("tag").collect()
    cells = {f"pos_{kind}_{i}": F.count_if((F.col("tag") == r["tag"]) & gold & ok) for i, r in enumerate(by_tag) for kind, ok in (("complete", complete), ("partial", ~complete))}
    labels = tags.groupBy(key).agg(F.bool_and("complete").alias("complete_df"), *(c.alias(n) for n, c in cells.items()))
    seen = docs.select(key, text).join(labels, key)
    numbers = {"df": F.lit(1), "complete_df": F.coalesce(F.col("complete_df").cast("int"), F.lit(0)), **{n: F.col(n) for n in cells}}
    return feature_sums(seen, numbers, text, by_hash), by_tag


def weights(by_feature: DataFrame, by_tag: list[Row], alpha: float = 1.0, partial: float = 0.5, min_df: int = 2, clip: float = 8.0, idf: str | None = None, power: float = 0.65) -> DataFrame:
    """feature and w, the weights of all tags in the order of by_tag. Smoothing gives unseen cells a weight too."""
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    bounded = lambda c: F.least(F.greatest(c, F.lit(-clip)), F.lit(clip))

    def weight(i: int, r: Row) -> Column:
        pos = F.col(f"pos_complete_{i}") + partial * F.col(f"pos_partial_{i}")
        neg = F.greatest(F.col("complete_df") - F.col(f"pos_complete_{i}"), F.lit(0))
        n_pos, n_neg = r["n_pos_complete"] + partial * r["n_pos_partial"], max(r["n_complete"] - r["n_pos_complete"], 0)
        p, q = inside((pos + alpha) / F.lit(n_pos + 2 * alpha)), inside((neg + alpha) / F.lit(n_neg + 2 * alpha))
        w = F.ln(p / (1 - p)) - F.ln(q / (1 - q))
        factor = {
            None: F.lit(1.0),
            "plain": F.pow(F.ln(F.lit(r["n"]) / F.greatest(F.col("df"), F.lit(1))), F.lit(power)),
            "smooth": F.pow(F.least(F.greatest(F.ln(F.lit(r["n"] + 1.0) / (F.col("df") + 1.0)) + 1.0, F.lit(1.0)), F.lit(6.0)), F.lit(power)),
        }[idf]
        return bounded(w) * factor if idf == "smooth" else bounded(w * factor)

    return by_feature.where(F.col("df") >= min_df).select("feature", F.array(*(weight(i, r) for i, r in enumerate(by_tag))).cast("array<double>").alias("w"))


def log_odds(by_feature: DataFrame, by_tag: list[Row], **options) -> DataFrame:
    """tag, feature, w: every frequent feature meets every tag of the dimension."""
    names = F.array(*(F.lit(r["tag"]) for r in by_tag)).cast("array<string>")
    return weights(by_feature, by_tag, **options).select("feature", F.explode(F.arrays_zip(names.alias("tag"), F.col("w").alias("w"))).alias("c")).select("c.tag", "feature", "c.w")


def scores(docs: DataFrame, weights: DataFrame, tags: list[str], key: str = "doc_id", text: str = "text", k: int = 3, chunk_bytes: int = 16 << 20) -> DataFrame:
    """key, tag, total, mean, top: the sum and mean of weights and the mean of the k best of max(w, 0), zeros included.

    weights: feature (hash) and w, of all tags. Documents lie in chunks of bounded text; a chunk asks for the weights of
    its distinct features and adds them up at its texts, so that no row is made for a document and feature.
    """
    safe = docs.where(F.col(key).isNotNull()).select(key, text)
    size = safe.agg(F.sum(F.octet_length(text)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    n = max(1, -(-((size["n"] or 0) + 64 * size["rows"]) // chunk_bytes))
    chunked = safe.select(F.pmod(F.hash(key), F.lit(n)).alias("_c"), key, text).repartition(n, "_c")
    asked = chunked.select("_c", text).sortWithinPartitions("_c").mapInArrow(T.vocabulary, "_c int, feature bigint")
    known = asked.join(weights, "feature").select("_c", "feature", "w")
    kind = docs.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("tag", StringType()), *(StructField(c, DoubleType()) for c in ("total", "mean", "top"))])

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        return T.chunk_scores(texts, found, tags, k, pa.schema([(key, texts.schema.field(1).type), ("tag", pa.string()), *((c, pa.float64()) for c in ("total", "mean", "top"))]))

    return chunked.groupBy("_c").cogroup(known.groupBy("_c")).applyInArrow(score, schema)


def predict(scored: DataFrame, thresholds: DataFrame, value: str = "total") -> DataFrame:
    return scored.join(F.broadcast(thresholds), "tag").where(F.col(value) >= F.col("threshold")).select("doc_id", "tag")


def cascade(gate: DataFrame, cut: float, docs: DataFrame, weights: DataFrame, tags: list[str], thresholds: DataFrame) -> DataFrame:
    """Tags of documents whose gate opens; the heads never see the others."""
    open_ = gate.where(F.col("gate") >= cut).select("doc_id")
    return predict(scores(docs.join(open_, "doc_id", "left_semi"), weights, tags), thresholds)


def hybrid(a: DataFrame, b: DataFrame, priority: list[str]) -> DataFrame:
    """Priority tags from a, all others from b."""
    return a.where(F.col("tag").isin(*priority)).unionByName(b.where(~F.col("tag").isin(*priority)))


def fuse(votes: DataFrame, strategies: DataFrame) -> DataFrame:
    """votes (doc_id, tag, arm, fired) and strategies (tag, how, arms) -> doc_id, tag that fire; how: source, or, and, majority."""
    cast = votes.join(F.broadcast(strategies), "tag").where(F.array_contains("arms", F.col("arm")))
    sums = cast.groupBy("doc_id", "tag", "how").agg(F.count_if("fired").alias("yes"), F.first(F.size("arms")).alias("n"))
    fires = F.when(F.col("how").isin("or", "source"), F.col("yes") >= 1).when(F.col("how") == "and", F.col("yes") == F.col("n")).otherwise(F.col("yes") >= F.floor(F.col("n") / 2) + 1)
    return sums.where(fires).select("doc_id", "tag")


def bag_vectors(members: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """key, dim, mean, top: mean and maximum of the members' vectors, dimension by dimension."""
    dims = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return members.join(dims, "vec_id").groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.max(F.col("x").cast("double")).alias("top"))


def cosine_to(vectors: DataFrame, centre: DataFrame) -> DataFrame:
    """vec_id, cosine to the mean vector of its label; centres are a small dimension, by label and dimension."""
    dims = vectors.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    both = dims.join(F.broadcast(centre), ["label", "dim"])
    return both.groupBy("vec_id").agg((F.sum(F.col("x") * F.col("mean")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("mean") * F.col("mean")))).alias("cosine"))
