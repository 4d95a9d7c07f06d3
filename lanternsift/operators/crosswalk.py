"""From found identifiers and source labels to document tags: crosswalks, row normalisation, completeness, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternsift.functions.taxonomy import COARSE, TAGS

VERTICALS = "^sensitive_(?:pci|phi|pii)_"


def _table(pairs: dict[str, object]) -> Column:
    return F.create_map(*(c for k, v in sorted(pairs.items()) for c in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v))))


def entity_tags(entities: Column) -> Column:
    """Sorted distinct document tags of a row's spans; an IP address is told apart by its text."""
    known = _table(TAGS)
    address = lambda e: F.array(F.when(F.contains(e["text"], F.lit(":")), F.lit("sensitive_pii_ipv6")).otherwise(F.lit("sensitive_pii_ipv4")))
    one = lambda e: F.when(e["type"] == "IP_ADDRESS", address(e)).otherwise(F.coalesce(F.try_element_at(known, e["type"]), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(entities, one))))


def coarse_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")


def normalise(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """rows (dataset, gold, pii_entities, document_type, label) with labels, native_labels and label_complete.

    gold is NULL where a source emits none. Tags of the three verticals are labels and everything else is native; coarse
    entity names add the tag they stand for. A source with gold is complete for its catalogue, one with entity names
    alone is a source of positives.
    """
    empty = F.array().cast("array<string>")
    gold, names = F.coalesce("gold", empty), F.filter(F.transform(F.coalesce("pii_entities", empty), coarse_name), lambda n: n != "")
    table = _table(COARSE)
    mapped = F.array_compact(F.transform(names, lambda n: F.try_element_at(table, n)))
    unmapped = F.transform(F.filter(names, lambda n: F.try_element_at(table, n).isNull()), lambda n: F.concat(F.lit("coarse_pii::"), n))
    said = F.coalesce(F.nullif(F.col("document_type"), F.lit("")), F.nullif(F.col("label"), F.lit("")))
    native = F.when(said.isNotNull(), F.array(F.concat(F.lit("native::"), said))).otherwise(empty)
    ordered = lambda *parts: F.array_sort(F.array_distinct(F.concat(*parts)))
    labels = ordered(F.filter(gold, lambda t: t.rlike(VERTICALS)), mapped)
    return rows.withColumns(
        {
            "labels": labels,
            "native_labels": ordered(F.filter(gold, lambda t: ~t.rlike(VERTICALS)), unmapped, native),
            "label_complete": F.col("gold").isNotNull() & ((F.size(labels) > 0) | F.col(dataset).startswith("pii")),
        }
    )


def _is_size(part: Column) -> Column:
    return part.rlike("^[0-9.]*[0-9][0-9.]*k*$")


def canonical_stem(name: Column) -> Column:
    """A corpus name without the row counts that folder names begin or end with."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    head = F.when((F.size(parts) > 0) & _is_size(F.get(parts, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    last = F.try_element_at(head, F.lit(-1))
    body = F.array_join(F.when((F.size(head) > 0) & _is_size(last), F.slice(head, 1, F.greatest(F.size(head) - 1, F.lit(0)))).otherwise(head), "_")
    tail = F.regexp_extract(body, "-([^-]*)$", 1)
    return F.when((tail != "") & _is_size(tail), F.regexp_replace(body, "-[^-]*$", "")).otherwise(body)


def declared_complete(rows: DataFrame, stems: list[str], dataset: str = "dataset") -> DataFrame:
    """Corpora declared complete are so where they have gold, whatever was inferred."""
    declared = canonical_stem(F.col(dataset)).isin(*stems) if stems else F.lit(False)
    return rows.withColumn("label_complete", F.col("label_complete") | (declared & F.col("gold").isNotNull()))


def document_gold(rows: DataFrame, judged_stems: list[str], verdict: Column, reason: Column, dataset: str = "dataset") -> DataFrame:
    """doc_has_pii and doc_gold_source of normalised rows: a judge's word, a complete catalogue, or positives alone."""
    judged = canonical_stem(F.col(dataset)).isin(*judged_stems) if judged_stems else F.lit(False)
    some = F.size("labels") > 0
    return rows.withColumns(
        {
            "doc_has_pii": F.when(judged, verdict).when(F.col("label_complete"), some).when(some, F.lit(True)),
            "doc_gold_source": F.when(judged, reason).when(F.col("label_complete"), F.lit("complete_catalogue")).otherwise(F.lit("positive_only")),
        }
    )


def admissible(clean: DataFrame, known: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Keys of clean that no known corpus (key, split, has_entities) holds, and one row of why the others may not be used."""
    keys = clean.select(key).distinct()
    seen = known.groupBy(key).agg(F.bool_or(F.col("split") == "eval").alias("sealed"), F.bool_or("has_entities").alias("conflict"))
    both = keys.join(seen, key, "left")
    why = both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sealed").isNotNull()).alias("overlap"),
        F.count_if("sealed").alias("in_sealed_eval"),
        F.count_if("conflict").alias("label_conflict"),
        F.count_if(F.col("sealed").isNull()).alias("usable"),
    )
    return both.where("sealed IS NULL").select(key), why


#: What a synthetic document that should hold nothing must not hold: shapes of identifiers, and phrases that give it away.
SHAPES = {
    "card": r"(?<![0-9])(?:[0-9][- ]?){13,19}(?![0-9])",
    "dob_value": r"(?i)(?:birth ?date|date of birth|dob)\s*[:=]\s*[0-9]",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "iban": r"(?<![0-9A-Z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Z])",
    "ipv4": r"(?<![0-9])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9])",
    "ipv6": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){3,7}|(?:[0-9a-f]{1,4})?::(?:[0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})(?![0-9a-f:])",
    "itin": r"(?<![0-9])9[0-9]{2}[- ]?[78][0-9][- ]?[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])[(]?[0-9]{3}[)]?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])",
    "street_address": r"(?i)\b[0-9]{1,5}\s+[a-z]+(?:\s+[a-z]+)?\s+(?:avenue|ave|boulevard|blvd|court|ct|drive|dr|lane|ln|road|rd|street|st)\b",
}
TELLS = r"(?i)\b(?:fictitious|(?:dummy|placeholder) data|for illustrative purposes|sample (?:document|only)|no (?:actual|genuine|personal|real) (?:data|identifiers|information)|this is an? (?:example|mock|sample|template|test) (?:document|file|record)|does not contain (?:any )?(?:actual|real) \w+)\b"


def verify_clean(docs: DataFrame, text: str = "text", slug: str = "slug") -> DataFrame:
    """docs with reasons to reject a document that should hold nothing, and warnings. Without reasons it may be used."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = [F.when(t.rlike(p), F.lit(f"identifier:{n}")) for n, p in SHAPES.items()]
    low, s = F.lower(t), F.coalesce(F.col(slug), F.lit(""))
    echo = (s != "") & (F.contains(low, s) | F.contains(low, F.replace(s, F.lit("_"), F.lit(" "))))
    return docs.withColumns(
        {
            "reasons": F.array_compact(F.array(*found, F.when(t.rlike(TELLS), F.lit("tell:disclaimer")))),
            "warnings": F.array_compact(F.array(F.when(echo, F.lit("echoes_class_name")))),
        }
    )
