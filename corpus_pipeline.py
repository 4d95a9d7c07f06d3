"""A corpus pipeline of five stages over documents; each stage's output is written and read again as the next one's docs.

Quality rules drop failed lines and rejected documents, line dedup drops shared lines, near-dedup keeps one document of
each group of near copies (five-word shingles, similarity 0.8), decontamination drops documents that hold a benchmark item, and BPE encodes the rest.
All stages but the last return the columns of documents, with text and n_chars brought up to date. A stage's extra
columns are carried along; whatever their names, they don't meet its working columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternsift.llm import bpe, decontamination, line_dedup, near_copies, quality_rules, simhash
from lanternsift.llm.common import discard, settle, shared_dir, table
from lanternsift.llm.queries import tokenizer_path


def _with_text(columns: list[str], row: str, text: str) -> list:
    """The columns of documents from a struct of the others and the new text."""
    made = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return [made.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    judged = quality_rules.judge(packed, keep=("row",)).where("kept")
    return judged.select(*_with_text(docs.columns, "row", "clean_text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(docs, carry=tuple(c for c in docs.columns if c != "text"))
    return deduped.select(*_with_text(docs.columns, "carried", "kept_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.firsts(docs, near_copies.near_copies(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), with_decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", tokens),
]

#: SimHash and BPE are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before, path = path, shared_dir(spark)
        docs = settle(stage(spark, docs, sf_dir), path)
        if before:  # nothing refers to the stage before the last any more
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
