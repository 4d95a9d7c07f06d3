"""Language identification: family first, then one-versus-one linear support vector machines within it.

Texts are lower-cased, everything but letters becomes one blank, and hashed three- and four-byte grams are averaged.
A linear machine on such averages is a mean of gram weights, so a text of any length is read once whatever the number
of machines. Families are told apart by machines between families, languages by machines between the languages of the
chosen family alone; each machine has a vote and ties go to the larger sum of margins.

Machines are fitted in tasks of their own on at most PER_LANG labelled texts of each language (those of the least hash
of doc_id); the weights, bounded by the square of the languages, go to the driver and back.

Defined cases: a null text or one without a letter is "und" with score 0; a null lang is no label; a null doc_id is
never learned from and not held out; repeated rows are predicted one by one; without any label everything is "und";
with one language all texts with a letter are that language; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.llm.common import slim

PER_LANG = 400
BITS = 13
UNKNOWN = "und"
PAD = 3
#: Bytes of text whose grams are looked up at a time.
BLOCK = 1 << 21
ROUNDS = 300
RIDGE = 1e-4
#: Public family of languages by ISO 639-1 code; a language that isn't listed is a family of its own.
FAMILIES = {
    code: family
    for family, codes in {
        "germanic": "en de nl af sv da no nb nn is fy lb yi",
        "romance": "fr es it pt ro ca gl oc la",
        "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
        "uralic": "fi et hu",
        "turkic": "tr az kk uz tk ky tt",
        "indic": "hi bn mr ne pa gu ur sa",
        "semitic": "ar he mt am",
        "baltic": "lt lv",
        "celtic": "ga cy gd br",
        "iranian": "fa ku ps tg",
        "sinitic": "zh yue",
        "dravidian": "ta te kn ml",
        "austronesian": "id ms tl jv su",
    }.items()
    for code in codes.split()
}


def family(lang: str) -> str:
    return FAMILIES.get(lang.lower().split("-")[0], "=" + lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def clean(texts: pa.Array) -> pa.Array:
    """Lower case, letters only, one blank between and around words, and PAD zero bytes, so that no gram meets the next text."""
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL]+", " ")
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_trim_whitespace(bare), pa.scalar(" " + PAD * "\0", pa.large_string()), pa.scalar("", pa.large_string()))


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three- and of the four-byte gram that starts at each byte but the last PAD."""
    x = data.astype(np.uint32)
    v = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16)
    shift, mult = np.uint32(32 - BITS), np.uint32(0x9E3779B1)
    return (v * mult) >> shift, ((v ^ (x[3:] * np.uint32(0x85EBCA6B))) * mult) >> shift


def means(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text the mean row of the table over its grams; table: buckets x outputs."""
    out = np.zeros((len(texts), table.shape[1]))
    ready = clean(texts)
    offsets = np.frombuffer(ready.buffers()[1], np.int64)[ready.offset : ready.offset + len(ready) + 1]
    data = np.frombuffer(ready.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets) - PAD
    i = 0
    while i < len(lengths):
        j = i + 1
        while j < len(lengths) and offsets[j + 1] - offsets[i] <= BLOCK:
            j += 1
        start, end = int(offsets[i]), int(offsets[j]) - PAD
        for lo in range(start, end, BLOCK):  # a longer text is read in blocks
            hi = min(lo + BLOCK, end) if j == i + 1 else end
            three, four = _grams(data[lo : hi + PAD])
            rows = table[three] + table[four]
            if j == i + 1:
                out[i] += rows.sum(axis=0)
                continue
            inner = offsets[i + 1 : j] - lo
            for k in range(1, PAD + 1):
                rows[inner - k] = 0
            out[i:j] = np.add.reduceat(rows, offsets[i:j] - lo, axis=0)
            break
        i = j
    return out / np.maximum(2 * lengths, 1)[:, None]


def _histogram(texts: pa.Array) -> np.ndarray:
    """Gram averages themselves, for the bounded texts of a fit."""
    rows = np.zeros((len(texts), 1 << BITS), np.float32)
    for k, t in enumerate(clean(texts).to_pylist()):
        three, four = _grams(np.frombuffer(t.encode(), np.uint8))
        rows[k] = (np.bincount(three, minlength=1 << BITS) + np.bincount(four, minlength=1 << BITS)) / max(2 * len(three), 1)
    return rows


def fit_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss; y is 1 or -1. Accelerated descent from zero: the same result each time."""
    scale = 1.0 / max(float(np.sqrt((x * x).sum(axis=1).mean())), 1e-12)
    z = np.column_stack((x * scale, np.ones(len(x), x.dtype)))
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    # The power method bounds the curvature.
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v)
    step = 1 / (2.2 * np.linalg.norm(z.T @ (weight * (z @ v))) + RIDGE)
    w, ahead = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for k in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        grad = -2 * (z.T @ (weight * y * slack)) + RIDGE * ahead
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1] * scale, float(w[-1])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """Machines between families and between the languages of each family, from rows of doc_id, text, lang."""
    pool = slim(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    families = sorted({family(x) for x in langs})
    pairs = [("family", a, b) for a, b in combinations(families, 2)]
    pairs += [("lang", a, b) for f in families for a, b in combinations([x for x in langs if family(x) == f], 2)]
    model = {"langs": langs, "families": families, "pairs": pairs, "table": np.zeros((1 << BITS, len(pairs)), np.float32), "bias": np.zeros(len(pairs))}
    if not pairs:
        return model
    # Rows below a hash limit first, then the exact bound: the second step sorts a few rows a language only.
    share = F.create_map(*(F.lit(v) for x in langs for v in (x, int(min(1.0, 2 * per_lang / counts[x] + 1e-5) * 1_000_000))))
    hashed = F.xxhash64("doc_id", F.lit("lang"))
    few = pool.where(F.pmod(hashed, F.lit(1_000_000)) < share[F.col("lang")]).where(F.col("text").rlike(r"\p{L}"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))).where(F.col("k") <= per_lang)
    sides = {x: [(k, 1 if (family(x) if kind == "family" else x) == a else -1) for k, (kind, a, b) in enumerate(pairs) if (family(x) if kind == "family" else x) in (a, b)] for x in langs}
    machine = F.create_map(*(c for x in langs for c in (F.lit(x), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in sides[x])) if sides[x] else F.array().cast("array<struct<k:int,s:int>>"))))
    rows = few.select("doc_id", "text", F.explode(machine[F.col("lang")]).alias("m")).select("doc_id", "text", F.col("m.k").alias("machine"), F.col("m.s").alias("side"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"], kind="stable")
        w, b = fit_machine(_histogram(pa.array(part["text"])), part["side"].to_numpy(float))
        return pd.DataFrame({"machine": [int(part["machine"].iloc[0])], "w": [w.astype(float)], "b": [b]})

    for r in rows.groupBy("machine").applyInPandas(one, "machine int, w array<double>, b double").collect():
        model["table"][:, r["machine"]] = r["w"]
        model["bias"][r["machine"]] = r["b"]
    return model


def decide(margins: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of machine margins."""

    def contest(names: list[str], kind: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
        worst = np.full((len(rows), len(names)), np.inf)
        at = {n: i for i, n in enumerate(names)}
        for k, (what, a, b) in enumerate(model["pairs"]):
            if what == kind and a in at and b in at:
                for name, m in ((a, rows[:, k]), (b, -rows[:, k])):
                    votes[:, at[name]] += m > 0
                    sums[:, at[name]] += np.clip(m, -1, 1)
                    worst[:, at[name]] = np.minimum(worst[:, at[name]], m)
        best = (votes + (sums + len(names)) / (4 * len(names))).argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * np.clip(worst[np.arange(len(rows)), best], -9, 9)))
        return best, sure

    top, score = contest(model["families"], "family", margins)
    out = np.empty(len(margins), object)
    for i, f in enumerate(model["families"]):
        rows = np.flatnonzero(top == i)
        names = [x for x in model["langs"] if family(x) == f]
        best, sure = contest(names, "lang", margins[rows])
        out[rows] = np.array(names, object)[best]
        score[rows] *= sure
    return list(out), score


def predict_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2)
        known = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        langs, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if model["langs"] and known.any():
            rows = np.flatnonzero(known)
            found, sure = decide(means(texts.take(pa.array(rows)), model["table"]) + model["bias"], model)
            langs[rows], score[rows] = found, sure
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs.tolist(), pa.string()), pa.array(np.round(score, 6))], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the prediction sees the text alone."""
    model = model or train(docs)
    base = slim(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(lambda it: predict_batches(it, model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
