"""Corpus preparation: normal form, digests, leakage, audits, tag folding, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.functions.fence import behind, fenced


def normal_text(text: Column) -> Column:
    """Trimmed, white space runs as one blank, case folded (sharp s as ss)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def digest(text: Column) -> Column:
    return F.sha2(normal_text(F.coalesce(text, F.lit(""))), 256)


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("digest", digest(F.col(text)))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """digest groups of two or more: how many rows, and the first id."""
    return with_digest(docs).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def leaked(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Rows of train whose text also occurs in evaluation; empty texts are no evidence."""
    seen = with_digest(evaluation).where(normal_text(F.coalesce("text", F.lit(""))) != "").select("digest").distinct()
    return with_digest(train).join(seen, "digest", "left_semi")


def without(docs: DataFrame, excluded: DataFrame, keys: list[str], error: str | None = None) -> DataFrame:
    """Rows that aren't excluded and, where a column of read errors is named, could be read."""
    docs = docs if error is None else docs.where(F.col(error).isNull())
    return docs.join(excluded.select(*keys).distinct(), keys, "left_anti")


#: Needle runs that are broadcast at most; beyond, both sides are shuffled.
MAX_BROADCAST = 2_000_000


def containing(docs: DataFrame, needles: DataFrame, words: int = 8) -> DataFrame:
    """Pairs of documents and needles that share a run of words.

    Words become hashes first and a run is a 128-bit hash of its words' hashes, so rows are narrow and equal runs need no
    second look. Only the needles' runs are sent around, behind a check of how many they are.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
        hashed = fenced(df.select(F.col(key), "text"), {"h": F.transform(w, lambda x: F.xxhash64(x))}).where(F.col("_fence") & (F.size("h") >= words))
        at = F.transform(F.sequence(F.lit(1), F.size("h") - words + 1), lambda i: F.slice(F.col("h"), i, F.lit(words)))
        run = hashed.select(key, F.explode(behind(at)).alias("r"))
        return run.select(key, F.xxhash64("r").alias("k1"), F.xxhash64(F.lit(1), F.col("r")).alias("k2"))

    probe = runs(needles, "item_id").distinct()
    small = probe.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return runs(docs, "doc_id").join(F.broadcast(probe) if small else probe, ["k1", "k2"]).select("doc_id", "item_id").distinct()


def audit(rows: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Per corpus: rows, readable, distinct, duplicates within, labelled, mean length."""
    known = with_digest(rows)
    return known.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("text").isNotNull() & (F.length("text") > 0)).alias("n_readable"),
        F.count_distinct("digest").alias("n_distinct"),
        (F.count(F.lit(1)) - F.count_distinct("digest")).alias("n_duplicates"),
        F.count_if("label_complete").alias("n_complete"),
        F.avg(F.length("text").cast("double")).alias("mean_chars"),
    )


def audit_tags(rows: DataFrame, tags: str = "tags", corpus: str = "corpus", priority: tuple[str, ...] = ()) -> DataFrame:
    """Per corpus and tag: rows, those completely labelled, and whether the tag is one that must be supported."""
    each = rows.select(corpus, "label_complete", F.explode(F.array_distinct(tags)).alias("tag"))
    return each.groupBy(corpus, "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("label_complete").alias("n_complete")).withColumn("priority", F.col("tag").isin(*priority) if priority else F.lit(False))


def audit_errors(rows: DataFrame, error: str = "error", corpus: str = "corpus") -> DataFrame:
    """Per corpus and kind of read error: rows."""
    return rows.where(F.col(error).isNotNull()).groupBy(corpus, F.substring_index(error, ":", 1).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def fold_tags(tags: Column, mapping: dict[str, str]) -> Column:
    """Many tags to one; a set, in order; idempotent where no target is a source."""
    table = F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t))))


def sensitive(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.rlike("^sensitive_(?:pci|phi|pii)_"))))


def tag_slug(name: Column, vertical: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), "[().,'-]", "")
    return F.concat(F.lit("sensitive_"), vertical, F.lit("_"), F.regexp_replace(F.trim(plain), r"\s+", "_"))


def verdict(judged: Column, confirmed: Column, positive: Column) -> Column:
    """Three-valued document truth: a judge's word first, then positives; no evidence stays unknown."""
    return F.when(judged == "clean", F.lit(False)).when(judged == "sensitive", F.lit(True)).when(positive, F.lit(True)).when(confirmed, F.lit(False))


def assert_absence(rows: DataFrame, truth: str, ambiguous: Column, most: float = 0.02) -> DataFrame:
    """Fails the query unless there is a negative and the ambiguous share is at most most; one row."""
    share = F.count_if(ambiguous) / F.count(F.lit(1))
    checked = rows.agg(F.count_if(~F.col(truth)).alias("n_negative"), share.alias("ambiguous_share"))
    fine = (F.col("n_negative") >= 1) & (F.col("ambiguous_share") <= most)
    return checked.where(F.assert_true(fine, F.lit("absence contract broken")).isNull())


def bucket(key: Column, buckets: int) -> Column:
    """Portable hash bucket: the first eight hex digits of SHA-256."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint") % buckets


def hash_split(rows: DataFrame, key: Column, share: float = 0.15, name: str = "held") -> DataFrame:
    """Held-out flag by key; rows with one key always fall on one side."""
    return rows.withColumn(name, bucket(key, 10_000) < round(share * 10_000))


def crc_bucket(key: Column, buckets: int) -> Column:
    """CRC-32 of the key's UTF-8 bytes; the same in zlib."""
    return F.crc32(key.cast("binary")) % buckets


def digest_split(docs: DataFrame, tenth: int = 10, fallback: Column | None = None) -> DataFrame:
    """Copies of a text fall on one side whatever their ids; rows without a text go by CRC-32 of the fallback key."""
    by_text = F.conv(F.left("digest", F.lit(8)), 16, 10).cast("bigint") % tenth == 0
    held = by_text if fallback is None else F.when(F.col("text").isNull(), crc_bucket(fallback, tenth) == 0).otherwise(by_text)
    return with_digest(docs).withColumn("held", held).drop("digest")


def calibration_split(rows: DataFrame, dataset: Column, uid: Column, salt: str = "", fifth: int = 5, name: str = "calibration") -> DataFrame:
    """A fifth of the rows by CRC-32 of dataset and id; a salt gives a split of its own."""
    key = F.concat_ws("::", *([F.lit(salt)] if salt else []), dataset, uid)
    return rows.withColumn(name, crc_bucket(key, fifth) == 0)


_TWO64 = 1 << 64
_GOLDEN, _REMIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _times(a: Column, factor: int) -> Column:
    """Product of unsigned 64-bit numbers modulo 2^64, as decimals; by halves, since the whole product has 128 bits."""
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    hi, lo = F.floor(a / big(1 << 32)).cast("decimal(20,0)"), (a % big(1 << 32)).cast("decimal(20,0)")
    f_hi, f_lo = (F.lit(str(x)).cast("decimal(10,0)") for x in divmod(factor, 1 << 32))
    cross = ((hi * f_lo + lo * f_hi) % big(1 << 32)).cast("decimal(10,0)")
    return ((cross * F.lit(str(1 << 32)).cast("decimal(10,0)") + lo * f_lo) % big(_TWO64)).cast("decimal(20,0)")


def _xor(a: Column, mask: int) -> Column:
    """Exclusive or of an unsigned 64-bit decimal with a number, as a decimal."""
    two64 = F.lit(str(_TWO64)).cast("decimal(20,0)")
    signed = F.when(a >= F.lit(str(1 << 63)).cast("decimal(20,0)"), a - two64).otherwise(a).cast("bigint")
    x = signed.bitwiseXOR(F.lit(mask - _TWO64 if mask >> 63 else mask)).cast("decimal(20,0)")
    return F.when(x < 0, x + two64).otherwise(x)


def corpus_seed(name: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little")


def ordinal_hash(ordinal: Column, corpus: Column, corpora: list[str]) -> Column:
    """Unsigned 64-bit identity of a row by its place in its corpus. corpora: the dimension of all corpus names."""
    mixed = _times(ordinal.cast("decimal(20,0)"), _GOLDEN)
    out = F.lit(None).cast("decimal(20,0)")
    for name in corpora:
        out = F.when(corpus == name, _xor(mixed, corpus_seed(name))).otherwise(out)
    return out


def carve(identity: Column, share: float = 0.15) -> Column:
    """Whether a row is in the held-in calibration part."""
    return (identity % F.lit(10_000)).cast("int") < round(share * 10_000)


def carve_again(identity: Column, share: float = 0.2) -> Column:
    """A second cut of the same identity, mixed anew so that it isn't correlated with the first."""
    shifted = F.floor(_times(identity, _REMIX) / F.lit(1 << 17).cast("decimal(20,0)")).cast("decimal(20,0)")
    return (shifted % F.lit(1_000)).cast("int") < round(share * 1_000)


def positional_split(rows: DataFrame, family: str, key: str, share: float = 0.2) -> DataFrame:
    """The first rows of each family by key digest go to evaluation; a family of two or more has at least one there."""
    w = Window.partitionBy(family)
    ranked = rows.withColumns({"_rank": F.row_number().over(w.orderBy(F.sha2(F.col(key).cast("string"), 256))), "_n": F.count(F.lit(1)).over(w)})
    most = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.floor(F.col("_n") * share))).otherwise(0)
    return ranked.withColumn("held", F.col("_rank") <= most).drop("_rank", "_n")


def evenly_spaced(rows: DataFrame, family: str, key: str, k: int) -> DataFrame:
    """At most k rows of each family at evenly spaced positions."""
    w = Window.partitionBy(family)
    ranked = rows.withColumns({"_at": F.row_number().over(w.orderBy(key)) - 1, "_n": F.count(F.lit(1)).over(w)})
    spots = F.when(F.col("_n") <= k, F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)).cast("int")))
    return ranked.where(F.array_contains(spots, F.col("_at"))).drop("_at", "_n")


def first_by_hash(rows: DataFrame, family: str, key: str, k: int, seed: str = "") -> DataFrame:
    """A repeatable sample: the k rows of least digest of seed and key in each family; another seed, another sample."""
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(family).orderBy(order))).where(F.col("_rank") <= k).drop("_rank")


def folds(rows: DataFrame, source: str) -> DataFrame:
    """Leave one source out: every row in every fold, as train or evaluation. Sources are a dimension."""
    held = rows.select(F.col(source).alias("fold")).distinct()
    return rows.crossJoin(F.broadcast(held)).withColumn("role", F.when(F.col(source).eqNullSafe(F.col("fold")), "evaluation").otherwise("train"))


def freeze(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A snapshot of rows: a digest of the columns of each key, to be written and compared later by snapshot_changes."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))


def snapshot_totals(frozen: DataFrame) -> DataFrame:
    """rows and one digest over all of a snapshot, whatever its order."""
    lanes = [F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{i}") for i in range(4)]
    sums = frozen.agg(F.count(F.lit(1)).alias("n_rows"), *lanes)
    return sums.select("n_rows", F.sha2(F.concat_ws("/", *(F.col(f"d{i}").cast("string") for i in range(4))), 256).alias("digest"))


def fold_counts(rows: DataFrame, source: str) -> DataFrame:
    """fold, role, n: how many rows each fold trains and evaluates on, from counts by source."""
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return folds(counts, source).groupBy("fold", "role").agg(F.sum("n").alias("n"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, digest_: str) -> DataFrame:
    """Keys added, removed or changed between two snapshots."""
    b, a = before.select(key, F.col(digest_).alias("was")), after.select(key, F.col(digest_).alias("now"))
    both = b.join(a, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def frozen_catalogue(rows: DataFrame, tags: str) -> DataFrame:
    """Dense ids of all tags in order of the alphabet; a dimension."""
    found = rows.select(F.explode(tags).alias("tag")).distinct()
    return found.withColumn("tag_id", F.row_number().over(Window.orderBy("tag")) - 1)
