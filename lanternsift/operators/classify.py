"""Document classification: label, risk and reasons from the resolved spans of a row. No shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternsift.functions.taxonomy import COMBOS, PHI_SPECIFIC, TYPES

CONTEXT = sorted(
    """admission,care provider,clinic,diagnosed,diagnosis,discharge,dosage,health care provider,health plan,healthcare provider,hipaa,hospital,icd-10,icd-9,
    inpatient,lab results,medical history,medical provider,medical record,medication,outpatient,patient,physician,prescription,rx,symptoms,treatment""".replace("\n    ", "").split(","),
    key=len,
    reverse=True,
)
CAP = 3
PHI_BONUS = 15


def medical_context(text: Column) -> Column:
    return text.rlike(r"(?iU)(?<!\w)(?:" + "|".join(CONTEXT) + r")(?!\w)")


def _lookup(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def combos(types: Column) -> list[tuple[str, int, Column]]:
    """Each combination with whether it counts: a pair doesn't where the triple that holds it does."""
    found, taken = [], []
    for members, bonus in COMBOS:
        here = F.lit(True)
        for m in members:
            here = here & F.array_contains(types, m)
        for larger, there in taken:
            if set(members) < set(larger):
                here = here & ~there
        taken.append((members, here))
        found.append(("+".join(members), bonus, here))
    return found


def classify(docs: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """docs with label, risk_score, counts, direct_count, quasi_count, combos and reasons."""
    e = F.col(entities)
    weight, direct = _lookup({k: v[1] for k, v in TYPES.items()}), _lookup({k: v[2] for k, v in TYPES.items()})
    base = docs.withColumn("_types", F.array_sort(F.array_distinct(F.transform(e, lambda s: s["type"]))))
    base = base.withColumn(
        "_stats",
        F.transform("_types", lambda t: F.struct(t.alias("t"), F.size(F.filter(e, lambda s: s["type"] == t)).alias("n"), F.aggregate(F.filter(e, lambda s: s["type"] == t), F.lit(0.0), lambda a, s: a + s["confidence"]).alias("c"))),
    )
    stats, types = F.col("_stats"), F.col("_types")
    label = (
        F.when(F.size(types) == 0, "NONE")
        .when(F.exists(types, lambda t: t.isin(*PHI_SPECIFIC)) | medical_context(F.coalesce(F.col(text), F.lit(""))), "PHI")
        .otherwise("PII")
    )
    part = lambda s: F.least(s["n"], F.lit(CAP)) * weight[s["t"]] * s["c"] / s["n"]
    hits = combos(types)
    bonus = sum((F.when(here, points).otherwise(0) for _, points, here in hits), F.lit(0))
    base = base.withColumn("label", label)
    raw = F.aggregate(stats, F.lit(0.0), lambda a, s: a + part(s)) + bonus + F.when(F.col("label") == "PHI", PHI_BONUS).otherwise(0)
    names = F.array_compact(F.array(*(F.when(here, F.lit(name)) for name, _, here in hits)))
    reasons = F.concat(
        F.transform(stats, lambda s: F.format_string("%s: %d found, +%s", s["t"], s["n"], F.bround(part(s), 1).cast("string"))),
        F.array_compact(F.array(*(F.when(here, F.lit(f"combination {name}, +{points}")) for name, points, here in hits))),
    )
    count = lambda want: F.size(F.filter(e, lambda s: direct[s["type"]] == want))
    return base.withColumns(
        {
            "risk_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)),
            "counts": F.map_from_arrays(types, F.transform(stats, lambda s: s["n"])),
            "direct_count": count(True),
            "quasi_count": count(False),
            "combos": names,
            "reasons": reasons,
        }
    ).drop("_types", "_stats")


def report_json(docs: DataFrame, entities: str = "entities") -> Column:
    """The report of a classified row as JSON; confidence to four places, risk to two."""
    spans = F.transform(entities, lambda s: s.withField("confidence", F.round(s["confidence"], 4)))
    return F.to_json(F.struct("label", F.round("risk_score", 2).alias("risk_score"), spans.alias("entities"), "counts", "reasons", "direct_count", "quasi_count", "combos"))
