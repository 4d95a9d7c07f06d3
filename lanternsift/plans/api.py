"""The public surface: scan, classify, report over any DataFrame with a text column, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternsift.functions.fence import behind, fenced
from lanternsift.functions.names import person_names, tokens
from lanternsift.functions.spans import empty_spans
from lanternsift.operators import scanner
from lanternsift.operators.classify import classify, report_json
from lanternsift.operators.detectors import Detector, candidates, digit_run, registry
from lanternsift.operators.resolve import resolve
from lanternsift.operators.tokens import finished


def scan(
    docs: DataFrame, text: str = "text", detectors: list[Detector] | None = None, names: bool = True, extra: Column | None = None, as_of: Column | None = None, min_confidence: float = 0.50, revalidate: bool = True
) -> DataFrame:
    """docs with entities, the resolved spans of each row. extra: spans of a learned tagger to be fused in, those that
    have min_confidence and, where their type has a check, pass it (operators.tokens.finished).

    A narrow projection: one Arrow pass over the text column (operators.scanner). Detectors that aren't registered ones
    go by columns.
    """
    extra = None if extra is None else finished(extra, min_confidence, revalidate)
    keys = None if detectors is None else scanner.keys_of(detectors)
    if detectors is not None and keys is None:
        return scan_columns(docs, text, detectors, names, extra, as_of)
    year = F.coalesce(F.year(as_of if as_of is not None else F.current_date()), F.lit(0))
    return docs.withColumn("entities", scanner.entities(F.col(text), year, keys, names, extra))


def scan_columns(docs: DataFrame, text: str = "text", detectors: list[Detector] | None = None, names: bool = True, extra: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """The scan in built-in expressions: the form for detectors made by callers, and what the Arrow pass is tested against.

    Guards and tokens are columns of their own, so each is computed once a row.
    """
    safe = F.coalesce(F.col(text), F.lit(""))
    base = fenced(docs, {"_low": F.lower(safe), "_run": digit_run(safe), "_toks": tokens(safe, F.lower(safe)) if names else F.lit(None)})
    found = candidates(safe, detectors or registry(as_of), True, F.col("_low"), F.col("_run"))
    if names:
        found = F.concat(found, F.when(F.size("_toks") > 0, person_names(safe, F.col("_toks"))).otherwise(empty_spans()))
    if extra is not None:
        found = F.concat(found, F.coalesce(extra, empty_spans()))
    base = fenced(base.withColumn("_found", behind(found)).drop("_fence"), {})
    return base.withColumn("entities", F.when(F.col("_fence") & (F.size("_found") > 0), resolve(F.col("_found"))).otherwise(empty_spans())).drop("_low", "_run", "_toks", "_found", "_fence")


def report(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """scan and classify."""
    return classify(scan(docs, text, **options), text)


def spans(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a span: key, type, start, end, text, confidence, detector."""
    return scanned.select(key, F.explode("entities").alias("e")).select(key, "e.type", "e.start", "e.end", "e.text", "e.confidence", "e.detector")


def any_found(scanned: DataFrame) -> DataFrame:
    """One row: whether any document has any entity."""
    return scanned.agg(F.coalesce(F.bool_or(F.size("entities") > 0), F.lit(False)).alias("found"))


__all__ = ["any_found", "classify", "report", "report_json", "scan", "scan_columns", "spans"]
