"""Token-level work around a learned tagger: chunks with a halo, BIO coding and decoding, snapping and merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.functions import validators as V
from lanternsift.functions.taxonomy import CHECKSUMMED

#: All code points that are white space to a word, beyond ASCII too.
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def running(sizes: Column) -> Column:
    """For each element of an array of int the sum of those before it."""
    return F.arrow_udf(_running, "array<int>")(sizes)


def _running(sizes: pa.Array) -> pa.Array:
    """One cumulative sum for a whole batch of arrays."""
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    before = np.concatenate(([0], np.cumsum(flat)))
    made = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(made.astype(np.int32)))


def space_places(text: Column) -> Column:
    """Places of all white space code points of a text; a lone surrogate is one code point and none of them."""
    return F.arrow_udf(_space_places, "array<int>")(text)


def _space_places(texts: pa.Array) -> pa.Array:
    table = np.zeros(max(SPACES) + 1, bool)
    table[SPACES] = True
    out = []
    for t in texts.to_pylist():
        code = np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32)
        low = np.flatnonzero(code < len(table))
        out.append(low[table[code[low]]].astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def tokenised(text: Column, path: str) -> Column:
    """id, start and end (code points) of a tokenizer's tokens, never truncated. Each worker loads the file once."""
    return F.arrow_udf(_TOKENS)(lambda texts: _items([_encoded(path, t) for t in texts]))(text)


def tokenised_rows(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and t, the tokens of each text: as tokenised(), in batches of bounded size however many texts come in one."""

    def encode(batches):
        for b in batches:
            held, size, first = [], 0, 0
            for at, t in enumerate(b.column(1)):
                held.append(_encoded(path, t))
                size += held[-1].shape[1]
                if size >= TOKENS_HELD or at + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), _items(held)], [key, "t"])
                    held, size, first = [], 0, at + 1

    rows = docs.select(key, text)
    return rows.mapInArrow(encode, f"`{key}` {rows.schema[key].dataType.simpleString()}, t {_TOKENS}")


_TOKENS = "array<struct<id:int,start:int,end:int>>"
#: Tokens that a worker holds before it passes them on.
TOKENS_HELD = 1 << 18


def _encoded(path: str, text: pa.Scalar) -> np.ndarray:
    """Ids, starts and ends as rows. The library's encoding, a hundred bytes and more a token, is dropped with its text."""
    found = _tokenizer(path).encode(text.as_py() or "", add_special_tokens=False)
    offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
    return np.stack((np.array(found.ids, np.int32), offsets[:, 0], offsets[:, 1]))


def _items(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([r.shape[1] for r in rows]))).astype(np.int32)
    columns = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["id", "start", "end"]))


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        if len(_TOKENIZERS) >= 4:
            _TOKENIZERS.pop(next(iter(_TOKENIZERS)))
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _TOKENIZERS[path] = tok
    return _TOKENIZERS[path]


def revalidates(kind: Column, text: Column) -> Column:
    """Whether a model's span stands up to the check of its type; types without a check pass."""
    n = V.digits(text)
    bare = F.trim(text)
    checks = {
        "CREDIT_CARD": F.length(n).between(13, 19) & V.luhn_ok(n),
        "SSN": (F.length(n) == 9) & V.ssn_ok(F.substring(n, 1, 3), F.substring(n, 4, 2), F.substring(n, 6, 4)),
        "IP_ADDRESS": V.ipv4_ok(bare) | V.ipv6_ok(bare),
        "EMAIL": F.contains(text, F.lit("@")) & F.contains(F.substring_index(text, "@", -1), F.lit(".")),
        "URL": F.contains(text, F.lit(".")) | F.contains(text, F.lit(":")),
        "BANK_ROUTING": V.aba_ok(n),
        "VEHICLE_ID": V.vin_ok(text),
        "SWIFT_BIC": V.swift_ok(text),
        "MAC_ADDRESS": V.mac_ok(text),
        "TAX_ID": V.ein_ok(n),
    }
    out = F.lit(True)
    for name, ok in checks.items():
        out = F.when(kind == name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def finished(spans: Column, min_confidence: float = 0.50, revalidate: bool = True) -> Column:
    """A tagger's spans with confidence enough, and, of types with a check digit or structure, those that pass it."""
    ok = lambda s: s["confidence"] >= min_confidence
    if not revalidate:
        return F.filter(spans, ok)
    return F.filter(spans, lambda s: ok(s) & (~s["type"].isin(*CHECKSUMMED) | revalidates(s["type"], s["text"])))


def chunks(n: Column, window: int, context: int) -> Column:
    """Windows (start, end, keep_from, keep_to) over n tokens: kept parts tile the text once, context lies around them."""
    stride = window - 2 * context
    if stride <= 0:
        raise ValueError("the window must be wider than its context on both sides")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / stride).cast("int") - 1, F.lit(0)))
    made = F.transform(
        starts,
        lambda i: F.struct(
            F.greatest(i * stride - context, F.lit(0)).alias("start"), F.least(i * stride + stride + context, n).alias("end"),
            (i * stride).alias("keep_from"), F.least(i * stride + stride, n).alias("keep_to"),
        ),
    )
    return F.filter(made, lambda c: c["keep_from"] < c["keep_to"])


def token_offsets(tokens: Column, blanks: Column) -> Column:
    """(start, end, token) of tokens that are followed by a blank or not; tokens and blanks must be columns by themselves."""
    sizes = F.zip_with(tokens, blanks, lambda t, b: F.length(t) + F.when(b, 1).otherwise(0))
    return F.zip_with(tokens, running(sizes), lambda t, at: F.struct(at.alias("start"), (at + F.length(t)).alias("end"), t.alias("token")))


def bio_encode(tokens: DataFrame, spans: DataFrame, tokens_each: int = 250_000) -> DataFrame:
    """tokens (doc_id, pos, start, end) by spans (doc_id, type, start, end) -> doc_id, pos, label; first token B, then I.

    Documents are spread once, so that a task sorts about tokens_each tokens however many there are; partitions of a
    number that is asked for aren't put together again, and neither side is broadcast by the size of its files.
    """
    n = max(1, -(-tokens.count() // tokens_each))
    t, s = tokens.repartition(n, "doc_id").alias("t"), spans.repartition(n, "doc_id").hint("merge").alias("s")
    on = (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.start") < F.col("s.end")) & (F.col("s.start") < F.col("t.end"))
    met = t.join(s, on, "left").select("t.doc_id", "t.pos", F.col("s.type").alias("type"), F.col("s.start").alias("span"))
    one = met.groupBy("doc_id", "pos").agg(F.min(F.struct("span", "type")).alias("m"))
    before = F.lag("m.span").over(Window.partitionBy("doc_id").orderBy("pos"))
    label = F.when(F.col("m.type").isNull(), "O").when(F.col("m.span").eqNullSafe(before), F.concat(F.lit("I-"), F.col("m.type"))).otherwise(F.concat(F.lit("B-"), F.col("m.type")))
    return one.select("doc_id", "pos", label.alias("label"))


def bio_decode(labelled: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, label, prob) -> doc_id, type, start, end, confidence.

    A token opens a span when its type changes, when the token before is outside, or when it is B and starts a word
    (it doesn't touch the token before); else it extends the open one.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    kind = F.when(F.col("label") != "O", F.substring_index("label", "-", -1))
    base = labelled.withColumn("type", kind)
    opens = F.col("type").isNotNull() & (~F.col("type").eqNullSafe(F.lag("type").over(w)) | (F.col("label").startswith("B-") & (F.col("start") > F.coalesce(F.lag("end").over(w), F.lit(-1)))))
    islands = base.withColumn("island", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("type").isNotNull())
    return islands.groupBy("doc_id", "island", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("prob").alias("confidence")).drop("island")


def merge_adjacent(spans: DataFrame, texts: DataFrame, types: tuple[str, ...] = ("ADDRESS", "PERSON_NAME"), gap: str = r"(?U)^[\s,]{0,2}$") -> DataFrame:
    """Join neighbours of one type over a small gap; confidence is weighted by width."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    base = spans.join(texts, "doc_id").withColumns({"_end": F.lag("end").over(w), "_type": F.lag("type").over(w)})
    between = F.substring(F.col("text"), F.col("_end") + 1, F.col("start") - F.col("_end"))
    joins = F.col("type").isin(*types) & F.col("type").eqNullSafe(F.col("_type")) & (F.col("start") >= F.col("_end")) & between.rlike(gap)
    grouped = base.withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    width = F.col("end") - F.col("start")
    return grouped.groupBy("doc_id", "type", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum(F.col("confidence") * width) / F.sum(width)).alias("confidence")).drop("island")


def snap(spans: Column, text: Column) -> Column:
    """Grow edges out of a run of letters or digits, but not into the neighbours; spans is sorted by place."""
    at = lambda i: F.get(spans, i)

    def grow(s: Column, i: Column) -> Column:
        low = F.coalesce(at(i - 1)["end"], F.lit(0))
        high = F.coalesce(at(i + 1)["start"], F.length(text))
        left, right = F.substring(text, low + 1, s["start"] - low), F.substring(text, s["end"] + 1, high - s["end"])
        inside = F.substring(text, s["start"] + 1, 1).rlike(r"(?U)\w"), F.substring(text, s["end"], 1).rlike(r"(?U)\w")
        start = s["start"] - F.when(inside[0], F.length(F.regexp_extract(left, r"(?U)\w+$", 0))).otherwise(0)
        end = s["end"] + F.when(inside[1], F.length(F.regexp_extract(right, r"(?U)^\w+", 0))).otherwise(0)
        return F.struct(s["type"].alias("type"), start.alias("start"), end.alias("end"))

    return F.transform(spans, grow)


def word_micro_f(gold: DataFrame, pred: DataFrame, beta: float = 5.0) -> DataFrame:
    """Micro F over (doc_id, pos, label) triples that aren't O."""
    key = ["doc_id", "pos", "label"]
    g, p = (d.where("label <> 'O'").select(*key).distinct() for d in (gold, pred))
    both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), key, "full_outer")
    n = both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    b2 = beta * beta
    return n.withColumn("f", F.try_divide((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")))


def tag_with(docs: DataFrame, model, schema: str = "array<struct<type:string,start:int,end:int,text:string,confidence:double,detector:string>>") -> DataFrame:
    """docs (doc_id, text, ...) with spans from an injected tagger: a picklable function from a list of texts to lists of span tuples.

    A missing model is an error, never an empty answer.
    """
    if model is None:
        raise FileNotFoundError("no tagger was given; scan without one instead")

    @F.pandas_udf(schema)
    def tagged(texts):
        import pandas as pd

        names = ("type", "start", "end", "text", "confidence", "detector")
        return pd.Series([[dict(zip(names, s)) for s in spans] for spans in model([t or "" for t in texts])])

    return docs.withColumn("model_spans", tagged("text"))
