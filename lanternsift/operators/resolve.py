"""Overlap resolution and fusion of rule and model spans, as folds within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternsift.functions.spans import greedy, overlaps
from lanternsift.functions.taxonomy import CHECKSUMMED, PHI_SPECIFIC


def is_model(span: Column) -> Column:
    return span["detector"].startswith("onnx/")


def tier(span: Column, models: Column) -> Column:
    """0: checksummed or promoted rule; 1: model; 2: cue rule. Without any model span all are 0.

    A cue rule is promoted when a model span of its type is shorter than it where they overlap, or when it is specific
    to health and no model span that is so overlaps it.
    """
    cuts = F.exists(models, lambda m: (m["type"] == span["type"]) & overlaps(m, span) & (m["end"] - m["start"] < span["end"] - span["start"]))
    health = F.exists(models, lambda m: m["type"].isin(*PHI_SPECIFIC) & overlaps(m, span))
    promoted = cuts | (span["type"].isin(*PHI_SPECIFIC) & ~health)
    return (
        F.when(F.size(models) == 0, 0)
        .when(is_model(span), 1)
        .when(span["type"].isin(*CHECKSUMMED) | promoted, 0)
        .otherwise(2)
    )


def _order(span: Column, first: Column) -> list[Column]:
    return [first, -span["confidence"], span["start"] - span["end"], span["start"], span["detector"], span["end"], span["type"]]


def resolve(spans: Column) -> Column:
    """Best spans first by tier, confidence, length, place and detector; what overlaps an accepted span goes."""
    models = F.filter(spans, is_model)
    return greedy(spans, lambda s: _order(s, tier(s, models)))


def resolve_by(spans: Column, how: str) -> Column:
    """Other fusions for comparison: rules_first, checksum_first or longest_wins."""
    rules = {
        "rules_first": lambda s: F.when(is_model(s), 1).otherwise(0),
        "checksum_first": lambda s: F.when(s["type"].isin(*CHECKSUMMED) & ~is_model(s), 0).when(is_model(s), 1).otherwise(2),
        "longest_wins": lambda s: s["start"] - s["end"],
    }
    return greedy(spans, lambda s: _order(s, rules[how](s)))
