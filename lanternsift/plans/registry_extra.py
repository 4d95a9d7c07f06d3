"""Registered queries of crosswalks, normalisation, splits, model spans, triage, transforms and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternsift.operators import corpus as C
from lanternsift.operators import crosswalk as X
from lanternsift.operators import linear as L
from lanternsift.operators import metrics as M
from lanternsift.operators import thresholds as T
from lanternsift.operators import tokens as N
from lanternsift.operators import transforms as R
from lanternsift.operators.detectors import registry
from lanternsift.plans import api
from lanternsift.plans.registry import IDS, _pieces, base, duck, query, table
from lanternsift.plans.registry_metrics import S, _caps, _curve, _docs, _f, scored
from lanternsift.sources.rendered import PLANTS, rendered

# --- crosswalk and normalisation

_kinds = """CASE k % 7 WHEN 0 THEN 'IP_ADDRESS' WHEN 1 THEN 'CREDIT_CARD' WHEN 2 THEN 'MRN' WHEN 3 THEN 'IP_ADDRESS' WHEN 4 THEN 'ADDRESS' WHEN 5 THEN 'URL' ELSE 'EMAIL' END"""


@query("e_entity_tags", duck(f"""SELECT k, list_aggregate(list_sort(list_distinct(list_concat(['sensitive_pii_full_name'], CASE k % 7 WHEN 0 THEN ['sensitive_pii_ipv4'] WHEN 1 THEN ['sensitive_pci_credit_card', 'sensitive_pci_credit_card_number']
  WHEN 2 THEN ['sensitive_phi_medical_record_number_mrn'] WHEN 3 THEN ['sensitive_pii_ipv6'] WHEN 4 THEN ['sensitive_pii_address', 'sensitive_pii_street_number_and_name'] WHEN 5 THEN [] ELSE ['sensitive_pii_email'] END))), 'string_agg', ',') AS tags FROM ({IDS}) AS i"""))
def e_entity_tags(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT k, array(named_struct('type', {_kinds}, 'text', CASE WHEN k % 7 = 3 THEN '::1' ELSE '10.0.0.1' END), named_struct('type', 'PERSON_NAME', 'text', 'x')) AS e FROM ({IDS})", "customer")
    return rows.select("k", F.array_join(X.entity_tags(F.col("e")), ",").alias("tags"))


@query("e_document_tags", f"""SELECT DISTINCT doc_id, 'sensitive_pii_email' AS tag FROM ({_pieces.replace('{p}', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-.]+[.][A-Za-z][A-Za-z]+')}) AS s WHERE NOT regexp_matches(split_part(text, '@', 1), '^[.]|[.]$')""")
def e_document_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = api.scan(docs, detectors=[d for d in registry() if d.name == "email"], names=False)
    return found.select("doc_id", F.explode(X.entity_tags(F.col("entities"))).alias("tag"))


_raw = f"""SELECT k, CASE k % 3 WHEN 0 THEN 'pii_set_10k' WHEN 1 THEN 'other-5k' ELSE '900_silver_2.5k' END AS dataset,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN array('sensitive_pii_email', 'memo') WHEN 2 THEN array('memo') ELSE array('sensitive_phi_x', 'sensitive_phi_x') END AS gold,
  CASE k % 5 WHEN 0 THEN array('  Zip   Code ', 'MRN') WHEN 1 THEN array('odd  Thing', '') ELSE NULL END AS pii_entities,
  CASE WHEN k % 2 = 0 THEN 'letter' END AS document_type, CASE WHEN k % 6 = 1 THEN 'form' END AS label FROM ({IDS})"""
_raw_duck = duck(_raw).replace("array(", "list_value(") + " AS i"
_normal = f"""SELECT *, list_sort(list_distinct(list_concat(list_filter(coalesce(gold, []), lambda t: starts_with(t, 'sensitive_')), CASE k % 5 WHEN 0 THEN ['sensitive_pii_zip_code', 'sensitive_phi_medical_record_number_mrn'] ELSE [] END))) AS labels,
  list_sort(list_distinct(list_concat(list_concat(list_filter(coalesce(gold, []), lambda t: NOT starts_with(t, 'sensitive_')), CASE k % 5 WHEN 1 THEN ['coarse_pii::odd thing'] ELSE [] END), CASE WHEN k % 2 = 0 THEN ['native::letter'] WHEN k % 6 = 1 THEN ['native::form'] ELSE [] END))) AS natives
FROM ({_raw_duck}) AS r"""
_complete = "gold IS NOT NULL AND (len(labels) > 0 OR k % 3 = 0)"


@query("p_normalise", f"SELECT k, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(array_to_string(natives, ','), '') AS native_labels, {_complete} AS label_complete FROM ({_normal}) AS n")
def p_normalise(spark, sf_dir):
    rows = X.normalise(base(spark, sf_dir, _raw, "customer"))
    return rows.select("k", F.array_join("labels", ",").alias("labels"), F.array_join("native_labels", ",").alias("native_labels"), "label_complete")


@query("p_stems", duck(f"SELECT k, CASE k % 6 WHEN 0 THEN 'notes2_eval' WHEN 1 THEN 'notes2_eval' WHEN 2 THEN 'letters2-graded' WHEN 3 THEN 'plain' WHEN 4 THEN '' ELSE 'a_b' END AS stem FROM ({IDS}) AS i"))
def p_stems(spark, sf_dir):
    names = "CASE k % 6 WHEN 0 THEN '30000_notes2_eval_25.15k' WHEN 1 THEN 'notes2_eval_30k' WHEN 2 THEN '23693_letters2-graded-12.86k' WHEN 3 THEN 'plain' WHEN 4 THEN '12' ELSE 'a__b' END"
    return base(spark, sf_dir, f"SELECT k, {names} AS name FROM ({IDS})", "customer").select("k", X.canonical_stem(F.col("name")).alias("stem"))


@query("p_document_gold", f"""SELECT k, CASE WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN TRUE END WHEN c THEN len(labels) > 0 WHEN len(labels) > 0 THEN TRUE END AS doc_has_pii,
  CASE WHEN k % 3 = 1 THEN 'judge' WHEN c THEN 'complete_catalogue' ELSE 'positive_only' END AS source FROM (SELECT *, ({_complete}) OR (k % 3 = 2 AND gold IS NOT NULL) AS c FROM ({_normal}) AS n) AS m""")
def p_document_gold(spark, sf_dir):
    rows = X.declared_complete(X.normalise(base(spark, sf_dir, _raw, "customer")), ["silver"])
    judged = X.document_gold(rows, ["other"], F.when(F.col("k") % 2 == 0, F.lit(True)), F.lit("judge"))
    return judged.select("k", "doc_has_pii", F.col("doc_gold_source").alias("source"))


@query("p_admissible", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p_admissible(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit("train").alias("split"), (F.col("toxic") == 1).alias("has_entities"))
    return X.admissible(table(spark, sf_dir, "documents"), known)[0]


@query("p_admissible_why", """SELECT count(*) AS total, count(l.doc_id) AS overlap, CAST(count(*) FILTER (WHERE l.sealed) AS BIGINT) AS in_sealed_eval, CAST(count(*) FILTER (WHERE l.conflict) AS BIGINT) AS label_conflict, count(*) - count(l.doc_id) AS usable
FROM (SELECT DISTINCT doc_id FROM documents) AS d LEFT JOIN (SELECT doc_id, bool_or(doc_id % 3 = 0) AS sealed, bool_or(toxic = 1) AS conflict FROM labels GROUP BY doc_id) AS l USING (doc_id)""")
def p_admissible_why(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "eval").otherwise("train").alias("split"), (F.col("toxic") == 1).alias("has_entities"))
    return X.admissible(table(spark, sf_dir, "documents"), known)[1]


@query("p_exclusions_readable", "SELECT source, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 GROUP BY source")
def p_exclusions_readable(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 7 == 0, "OSError: no").alias("error"))
    return C.without(docs, docs.where("doc_id % 5 = 0"), ["doc_id"], "error").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p_audit_tags", "SELECT source AS corpus, tag, count(*) AS n, CAST(count(*) FILTER (WHERE doc_id % 2 = 0) AS BIGINT) AS n_complete, tag = 'toxic' AS priority FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'fine' END AS tag FROM labels) AS l JOIN documents d USING (doc_id) GROUP BY source, tag")
def p_audit_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("corpus")), "doc_id")
    return C.audit_tags(rows.select("corpus", (F.col("doc_id") % 2 == 0).alias("label_complete"), F.array(F.when(F.col("toxic") == 1, "toxic").otherwise("fine")).alias("tags")), priority=("toxic",))


@query("p_audit_errors", "SELECT source AS corpus, CASE WHEN doc_id % 6 = 0 THEN 'OSError' ELSE 'BadZipFile' END AS error, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL")
def p_audit_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.when(F.col("doc_id") % 6 == 0, "OSError: gone").when(F.col("doc_id") % 3 == 0, "BadZipFile").alias("error"))
    return C.audit_errors(rows)



@query("p_verify_clean", duck(f"""SELECT k, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'identifier:email' WHEN 2 THEN 'identifier:phone' WHEN 3 THEN 'tell:disclaimer' WHEN 4 THEN 'identifier:ipv4' ELSE 'identifier:dob_value' END AS reasons, CASE WHEN k % 6 = 0 THEN 'echoes_class_name' ELSE '' END AS warnings FROM ({IDS}) AS i"""))
def p_verify_clean(spark, sf_dir):
    text = "CASE k % 6 WHEN 0 THEN 'A Data Dictionary of terms' WHEN 1 THEN 'ask a@b.org' WHEN 2 THEN 'ring 415-555-2671' WHEN 3 THEN 'This is dummy data.' WHEN 4 THEN 'at 10.0.0.1' ELSE 'DOB: 1 May' END"
    rows = X.verify_clean(base(spark, sf_dir, f"SELECT k, {text} AS text, 'data_dictionary' AS slug FROM ({IDS})", "customer"))
    return rows.select("k", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"))


# --- splits


@query("s_crc32_split")
def s_crc32_split(spark, sf_dir):
    """Compared with zlib in tests: SQL has no CRC-32 here."""
    docs = C.calibration_split(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id").cast("string"))
    return C.calibration_split(docs, F.col("source"), F.col("doc_id").cast("string"), "fusion", name="salted").select("doc_id", "calibration", "salted")


_seed = C.corpus_seed("documents")
_half = lambda a, f: f"((((({a}) // 4294967296) * {f % (1 << 32)} + (({a}) % 4294967296) * {f >> 32}) % 4294967296) * 4294967296 + (({a}) % 4294967296) * {f % (1 << 32)}) % 18446744073709551616"
_identity = f"SELECT doc_id, CAST(xor(CAST({_half('CAST(doc_id AS HUGEINT)', C._GOLDEN)} AS UBIGINT), CAST({_seed} AS UBIGINT)) AS HUGEINT) AS h FROM documents"


@query("s_ordinal_carve", f"SELECT doc_id, h % 10000 < 1500 AS calibration, CAST({_half('h', C._REMIX)} AS HUGEINT) // 131072 % 1000 < 200 AS part_a FROM ({_identity}) AS i")
def s_ordinal_carve(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", C.ordinal_hash(F.col("doc_id"), F.lit("documents"), ["documents"]).alias("h"))
    return rows.select("doc_id", C.carve(F.col("h")).alias("calibration"), C.carve_again(F.col("h")).alias("part_a"))


@query("s_seeded_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s7' || CAST(doc_id AS STRING))) AS r FROM documents) AS x WHERE r <= 4")
def s_seeded_sample(spark, sf_dir):
    """A sample of a stated size is the operator."""
    return C.first_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4, "s7")


@query("s_snapshot_freeze", "SELECT lang, count(*) AS n_rows, TRUE AS repeats FROM documents GROUP BY lang")
def s_snapshot_freeze(spark, sf_dir):
    """A snapshot of each language in two orders has one digest."""
    docs = table(spark, sf_dir, "documents")
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]
    out = None
    for lang in langs:
        frozen = C.freeze(docs.where(F.col("lang").eqNullSafe(F.lit(lang))), "doc_id", ["text", "source"])
        a, b = C.snapshot_totals(frozen), C.snapshot_totals(frozen.repartition(3)).select(F.col("digest").alias("again"))
        row = a.crossJoin(b).select(F.lit(lang).alias("lang"), "n_rows", (F.col("digest") == F.col("again")).alias("repeats"))
        out = row if out is None else out.union(row)
    return out


# --- model spans

_CHECKED = {"card": "CREDIT_CARD", "ssn": "SSN", "routing": "BANK_ROUTING", "vin": "VEHICLE_ID", "swift": "SWIFT_BIC", "mac": "MAC_ADDRESS", "tax_id": "TAX_ID"}


@query("n_revalidate", " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, ident, ok FROM ({PLANTS[k].checks()}) AS {k}" for k, t in _CHECKED.items()))
def n_revalidate(spark, sf_dir):
    out = None
    for kind, type_ in _CHECKED.items():
        rows = rendered(spark, sf_dir, PLANTS[kind]).select("doc_id", F.lit(type_).alias("type"), "ident", N.revalidates(F.lit(type_), F.col("ident")).alias("ok"))
        out = rows if out is None else out.union(rows)
    return out


@query("n_finish", duck(f"SELECT k, CASE WHEN k % 10 >= 5 THEN CASE WHEN k % 2 = 0 THEN 'EMAIL,USER_ID' ELSE 'USER_ID' END ELSE '' END AS kept FROM ({IDS}) AS i"))
def n_finish(spark, sf_dir):
    spans = "array(named_struct('type', 'EMAIL', 'start', 0, 'end', 5, 'text', CASE WHEN k % 2 = 0 THEN 'a@b.c' ELSE 'a@bcd' END, 'confidence', c, 'detector', 'onnx/x'), named_struct('type', 'USER_ID', 'start', 6, 'end', 9, 'text', 'bob', 'confidence', c, 'detector', 'onnx/x'))"
    rows = base(spark, sf_dir, f"SELECT k, {spans} AS s FROM (SELECT k, CAST(k % 10 AS DOUBLE) / 10 AS c FROM ({IDS}))", "customer")
    return rows.select("k", F.array_join(F.transform(N.finished(F.col("s")), lambda e: e["type"]), ",").alias("kept"))


@query("n_space_mask", "SELECT doc_id, length(text) - length(regexp_replace(text, '[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS n FROM documents WHERE text IS NOT NULL")
def n_space_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(N.space_places(F.col("text"))).cast("bigint").alias("n"))


@query("n_tokenise")
def n_tokenise(spark, sf_dir):
    """Compared with the tokenizers library in tests."""
    import public_tokenizers

    rows = N.tokenised_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("t").alias("n"), F.coalesce(F.array_max("t.end"), F.lit(0)).alias("last_end"))


# --- triage and gates

_WALK = {"mail": "EMAIL", "card": "CREDIT_CARD"}
_tgold = f"SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'card' ELSE 'odd' END AS label, 10 AS gs, 20 AS ge, CASE WHEN k % 2 = 0 THEN '4111111111111111' ELSE '4111111111111112' END AS text FROM ({IDS}) AS i"
_tpred = f"SELECT k AS doc_id, 'EMAIL' AS type, CASE k % 4 WHEN 1 THEN 12 WHEN 2 THEN 30 ELSE 10 END AS gs, CASE k % 4 WHEN 2 THEN 40 ELSE 20 END AS ge FROM ({IDS}) AS i WHERE k % 5 <> 0"
_tbucket = "CASE WHEN k % 4 = 2 THEN 'spurious' WHEN k % 3 = 2 THEN 'unmodelled_overlap' WHEN k % 3 = 0 AND k % 4 <> 1 THEN 'hit' ELSE 'mapped_mismatch' END"


def _triage_in(spark, sf_dir):
    gold = base(spark, sf_dir, _tgold, "customer").select("doc_id", "label", F.col("gs").alias("start"), F.col("ge").alias("end"), "text")
    return gold, base(spark, sf_dir, _tpred, "customer").select("doc_id", "type", F.col("gs").alias("start"), F.col("ge").alias("end"))


@query("g_triage", duck(f"SELECT k AS doc_id, {_tbucket} AS bucket, CASE WHEN {_tbucket} = 'unmodelled_overlap' THEN 'odd' END AS label FROM ({IDS}) AS i WHERE k % 5 <> 0"))
def g_triage(spark, sf_dir):
    return M.triage(*_triage_in(spark, sf_dir), _WALK).select("doc_id", "bucket", "label")


@query("g_confusion_top", duck(f"SELECT 'EMAIL' AS type, 'odd' AS label, count(*) AS n FROM ({IDS}) AS i WHERE k % 5 <> 0 AND {_tbucket} = 'unmodelled_overlap' HAVING count(*) > 0"))
def g_confusion_top(spark, sf_dir):
    """The twelve most frequent confusions: the report is the operator."""
    return M.confusions(M.triage(*_triage_in(spark, sf_dir), _WALK))


@query("g_triage_summary", duck(f"""SELECT tp, mismatch, unmodelled, spurious, gold, card_reachable, tp / (tp + mismatch + unmodelled + spurious) AS precision, tp / (tp + mismatch + spurious) AS adjusted_precision, tp / gold AS recall FROM
  (SELECT CAST(count(*) FILTER (WHERE b = 'hit') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE b = 'mapped_mismatch') AS BIGINT) AS mismatch, CAST(count(*) FILTER (WHERE b = 'unmodelled_overlap') AS BIGINT) AS unmodelled, CAST(count(*) FILTER (WHERE b = 'spurious') AS BIGINT) AS spurious FROM (SELECT {_tbucket} AS b FROM ({IDS}) AS i WHERE k % 5 <> 0) AS x) AS y,
  (SELECT CAST(count(*) FILTER (WHERE k % 3 <> 2) AS BIGINT) AS gold, CAST(count(*) FILTER (WHERE k % 3 = 1 AND k % 2 = 0) AS BIGINT) AS card_reachable FROM ({IDS}) AS i) AS g"""))
def g_triage_summary(spark, sf_dir):
    gold, pred = _triage_in(spark, sf_dir)
    return M.triage_summary(M.triage(gold, pred, _WALK), gold, _WALK)


@query("g_by_locale", duck(f"""SELECT locale, type, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pred - tp) AS BIGINT) AS fp, CAST(sum(gold - tp) AS BIGINT) AS fn FROM (
  SELECT CASE WHEN k % 2 = 0 THEN 'us' ELSE 'intl' END AS locale, 'EMAIL' AS type, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS gold, CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS pred, CASE WHEN k % 5 <> 0 AND k % 3 = 0 AND k % 4 IN (0, 3) THEN 1 ELSE 0 END AS tp FROM ({IDS}) AS i
  UNION ALL SELECT CASE WHEN k % 2 = 0 THEN 'us' ELSE 'intl' END, 'CREDIT_CARD', 1, 0, 0 FROM ({IDS}) AS i WHERE k % 3 = 1) AS c GROUP BY locale, type HAVING sum(gold) + sum(pred) > 0"""))
def g_by_locale(spark, sf_dir):
    gold, pred = _triage_in(spark, sf_dir)
    mapped = gold.where("label <> 'odd'").withColumn("type", F.when(F.col("label") == "mail", "EMAIL").otherwise("CREDIT_CARD"))
    return M.by_locale(mapped, pred, gold.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "us").otherwise("intl").alias("locale")))


_tagn = "n AS (SELECT tag, corpus, count(*) FILTER (WHERE gold) AS gold, count(*) FILTER (WHERE gold AND score >= 0.6) AS tp, count(*) FILTER (WHERE NOT gold AND complete AND score >= 0.6) AS fp FROM s GROUP BY tag, corpus)"


@query("g_span_gate", S + ", " + _tagn + """, c AS (SELECT tag || '/' || corpus AS type, gold, tp, fp, gold - tp AS fn FROM n), f AS (SELECT type, gold, coalesce(tp / nullif(tp + fn, 0), 0) AS r, CASE WHEN tp = 0 THEN 0 ELSE 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) END AS f2 FROM (SELECT * FROM c UNION ALL SELECT 'never', 0, 0, 0, 0) AS u)
SELECT avg(f2) AS macro_f2, min(f2) AS f2_min, median(f2) AS f2_median, CAST(count(*) FILTER (WHERE f2 = 0) AS BIGINT) AS n_zero, CAST(count(*) FILTER (WHERE f2 < 0.1) AS BIGINT) AS n_below_tenth, min(r) FILTER (WHERE type LIKE 'quality/%' AND gold >= 5) AS severity_min, avg(r) FILTER (WHERE type LIKE 'quality/%' AND gold >= 5) AS severity_mean, CAST(count(*) FILTER (WHERE type LIKE 'quality/%' AND gold >= 5) AS BIGINT) AS n_severe FROM f""")
def g_span_gate(spark, sf_dir):
    n = M.tag_counts(scored(spark, sf_dir), F.col("score") >= 0.6, ["tag", "corpus"])
    counts = n.select(F.concat_ws("/", "tag", "corpus").alias("type"), F.col("support").alias("gold"), "tp", "fp", "fn")
    catalogue = counts.select("type").union(spark.createDataFrame([("never",)], "type string"))
    severe = tuple(r["type"] for r in counts.where(F.col("type").startswith("quality/")).select("type").collect())
    return M.span_gate(counts, catalogue, severe, 5)


@query("g_model_matrix", """SELECT m.model, c.source AS corpus, CASE WHEN m.model = 'a' OR c.r % 2 = 0 THEN n END AS n_rows, CASE WHEN m.model = 'a' THEN n / 1000.0 END AS value, CASE WHEN m.model = 'a' THEN NULL WHEN c.r % 2 = 0 THEN 'no negatives' ELSE 'not run' END AS blank
FROM (SELECT unnest(['a', 'b']) AS model) AS m, (SELECT source, count(*) AS n, CAST(substr(source, 4) AS INT) AS r FROM documents GROUP BY source) AS c""")
def g_model_matrix(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("corpus")).agg(F.count(F.lit(1)).alias("n_rows"))
    a = n.select(F.lit("a").alias("model"), "corpus", "n_rows", (F.col("n_rows") / 1000).alias("value"), F.lit(None).cast("string").alias("reason"))
    b = n.where(F.substring("corpus", 4, 9).cast("int") % 2 == 0).select(F.lit("b").alias("model"), "corpus", "n_rows", F.lit(None).cast("double").alias("value"), F.lit("no negatives").alias("reason"))
    return M.model_matrix(a.union(b))


@query("g_alarm_tags", S + "SELECT tag, count(*) AS n FROM s WHERE NOT gold AND score >= 0.6 GROUP BY tag")
def g_alarm_tags(spark, sf_dir):
    return M.alarm_tags(scored(spark, sf_dir).where("NOT gold"), F.col("score") >= 0.6)


@query("g_implied_precision", S + """SELECT tp / (tp + fp) AS sealed_precision, tp / (tp + fp + (0.4 / 0.6) * n / clean_n * clean_fp) AS implied_precision FROM (SELECT count(*) FILTER (WHERE gold AND score >= 0.6) AS tp, count(*) FILTER (WHERE NOT gold AND complete AND score >= 0.6) AS fp, count(DISTINCT doc_id) AS n FROM s) AS a,
  (SELECT count(*) FILTER (WHERE score >= 0.6) AS clean_fp, count(DISTINCT doc_id) AS clean_n FROM s WHERE NOT gold) AS b""")
def g_implied_precision(spark, sf_dir):
    rows, fired = scored(spark, sf_dir), F.col("score") >= 0.6
    sealed = rows.agg(F.count_if(F.col("gold") & fired).alias("tp"), F.count_if(~F.col("gold") & F.col("complete") & fired).alias("fp"), F.count_distinct("doc_id").alias("n_docs"))
    clean = rows.where("NOT gold").agg(F.count_if(fired).alias("fp"), F.count_distinct("doc_id").alias("n_docs"))
    return M.implied_precision(sealed, clean, 0.4)


@query("g_report_lines")
def g_report_lines(spark, sf_dir):
    """A rendered report; compared with Python's format in tests."""
    n = M.tag_counts(scored(spark, sf_dir), F.col("score") >= 0.6, ["tag"]).withColumn("recall", M.ratio(F.col("tp"), F.col("support")))
    return L.table_lines(n, {"tag": (18, "s"), "support": (6, "%d"), "tp": (6, "%d"), "recall": (7, "%.2f")}, [F.col("tag")], "recall")


# --- thresholds


@query("g_min_support", S + "," + _curve + f""" SELECT corpus || '/' || tag AS tag, CASE WHEN positives < 6 THEN 'Infinity'::DOUBLE ELSE threshold END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY corpus, tag ORDER BY {_f(0.25)} DESC, threshold DESC) AS r FROM (SELECT *, tp / (tp + fp) AS precision, tp / positives AS recall FROM
  (SELECT corpus, tag, threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY corpus, tag) AS positives FROM (SELECT corpus, tag, score AS threshold, count(*) FILTER (WHERE gold) AS p, count(*) FILTER (WHERE NOT gold) AS n FROM u GROUP BY corpus, tag, score) AS pt WINDOW w AS (PARTITION BY corpus, tag ORDER BY threshold DESC)) AS z WHERE positives > 0) AS y) AS x WHERE r = 1""")
def g_min_support(spark, sf_dir):
    best = T.best_threshold(scored(spark, sf_dir), ["corpus", "tag"], min_support=6)
    return best.select(F.concat_ws("/", "corpus", "tag").alias("tag"), "threshold")


@query("g_tail_cap", S + "SELECT tag, min(cap) AS cap, count(*) AS n_groups FROM (SELECT tag, corpus, quantile_cont(score, 0.25) AS cap FROM s WHERE gold GROUP BY tag, corpus HAVING count(*) * 0.25 >= 2) AS q GROUP BY tag")
def g_tail_cap(spark, sf_dir):
    return T.group_cap(scored(spark, sf_dir), ["tag"], "corpus", 0.75, tail_events=2)


def _ladder(bar: float) -> str:
    pick = lambda where, v: f"(SELECT arg_max({{'t': threshold, 'p': precision, 'r': recall}}, ({v}, threshold)) FROM k WHERE k.tag = t.tag AND {where})"
    return S + "," + _curve + "," + _caps + f""", k AS (SELECT curve.*, coalesce(cap, 'Infinity'::DOUBLE) AS cap, {_f(0.25)} AS f FROM curve LEFT JOIN caps USING (tag)),
a AS (SELECT t.tag, {pick('threshold <= cap AND recall >= 0.75', 'f')} AS a1, {pick('threshold <= cap', 'recall')} AS a2, {pick('TRUE', 'recall')} AS a3, {pick('recall >= 0.75', 'f')} AS b1, {pick('TRUE', 'f')} AS b2 FROM (SELECT DISTINCT tag FROM k) AS t),
chosen AS (SELECT tag, coalesce(a1, a2, a3) AS x, CASE WHEN a1 IS NOT NULL THEN 'floor_met' WHEN a2 IS NOT NULL THEN 'capped_max_recall' ELSE 'uncapped_max_recall' END AS bx, coalesce(b1, b2) AS y, CASE WHEN b1 IS NOT NULL THEN 'precision_floor_uncapped' ELSE 'precision_floor_unconstrained' END AS bz FROM a)
SELECT tag, CASE WHEN x.p >= {bar} THEN x.t WHEN y.p >= {bar} THEN y.t ELSE 'Infinity'::DOUBLE END AS threshold, CASE WHEN x.p >= {bar} THEN x.p ELSE y.p END AS precision, CASE WHEN x.p >= {bar} THEN x.r ELSE y.r END AS recall, CASE WHEN x.p >= {bar} THEN bx WHEN y.p >= {bar} THEN bz ELSE 'disabled_low_precision' END AS branch FROM chosen"""


for _name, _bar in (("g_veto_ladder", 0.65), ("g_veto_ladder_strict", 0.999)):
    query(_name, _ladder(_bar))(lambda spark, sf_dir, bar=_bar: T.veto_ladder(scored(spark, sf_dir), ["tag"], "corpus", bar, least=5))


@query("g_robust_document_cut", duck(f"""WITH d AS (SELECT * FROM ({_docs}) AS x WHERE target IS NOT NULL), g AS (SELECT source, quantile_cont(gate, 0.4) FILTER (WHERE target) AS up, count(*) FILTER (WHERE target) AS p, quantile_cont(gate, 0.3) FILTER (WHERE NOT target) AS down, count(*) FILTER (WHERE NOT target) AS n FROM d GROUP BY source),
b AS (SELECT coalesce(min(up) FILTER (WHERE p >= 5), 'Infinity'::DOUBLE) AS cap, coalesce(max(down) FILTER (WHERE n >= 5), '-Infinity'::DOUBLE) AS base FROM g),
u AS (SELECT gate AS t, count(*) FILTER (WHERE target) AS p, count(*) FILTER (WHERE NOT target) AS n FROM d GROUP BY gate), c AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM u WINDOW w AS (ORDER BY t DESC)),
r AS (SELECT t, row_number() OVER (ORDER BY t <= cap AND t >= base DESC, tp / (tp + fp) DESC, t DESC) AS k FROM c, b)
SELECT cap, base, CASE WHEN base > cap THEN (base + cap) / 2 ELSE t END AS cut FROM b, r WHERE k = 1"""))
def g_robust_document_cut(spark, sf_dir):
    return T.robust_document_cut(base(spark, sf_dir, _docs, "documents"), "source", 0.6, 0.3, least=5)


_low = "(SELECT {keys}, q, score AS v FROM (SELECT {keys}, score, row_number() OVER (PARTITION BY {keys} ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM s WHERE gold) AS r, (SELECT unnest([0.05, 0.1, 0.5]) AS q) AS qs WHERE i = floor(q * (n - 1)) {more})"


@query("g_quantile_bank", S + f"SELECT p.tag, round(1 - p.q, 12) AS recall, coalesce(e.v, p.v) AS threshold FROM {_low.format(keys='tag', more='')} AS p LEFT JOIN (SELECT tag, q, min(v) AS v FROM {_low.format(keys='tag, corpus', more=chr(65) + 'ND n >= 8')} AS x WHERE tag = 'toxic' OR tag = 'quality' GROUP BY tag, q) AS e ON p.tag = e.tag AND p.q = e.q AND p.tag = 'quality'")
def g_quantile_bank(spark, sf_dir):
    return T.quantile_bank(scored(spark, sf_dir), "corpus", [0.95, 0.9, 0.5], ("quality",), 8)


@query("g_recall_at_specificity", S + ", c AS (SELECT tag, quantile_cont(score, 0.8) FILTER (WHERE NOT gold) AS cut FROM s GROUP BY tag) SELECT tag, cut, count(*) FILTER (WHERE score >= cut) / count(*) AS recall FROM s JOIN c USING (tag) WHERE gold GROUP BY tag, cut")
def g_recall_at_specificity(spark, sf_dir):
    return T.recall_at_specificity(scored(spark, sf_dir), ["tag"], 0.8)


@query("g_policy_globs", S + """, m AS (SELECT corpus AS arm, tag, count(*) FILTER (WHERE gold AND score >= 0.6) / nullif(count(*) FILTER (WHERE gold), 0) AS value, count(*) FILTER (WHERE gold) AS support FROM s GROUP BY corpus, tag),
o AS (SELECT arm, CASE WHEN value IS NOT NULL AND support >= 3 THEN value >= 0.5 END AS ok FROM m UNION ALL SELECT arm, CASE WHEN value IS NOT NULL AND support >= 1 THEN value - 0.1 >= 0.4 END FROM m WHERE tag = 'toxic')
SELECT arm, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE ok IS NULL) AS BIGINT) AS unmeasured FROM o GROUP BY arm""")
def g_policy_globs(spark, sf_dir):
    n = M.tag_counts(scored(spark, sf_dir), F.col("score") >= 0.6, ["corpus", "tag"])
    value = M.ratio(F.col("tp"), F.col("support"))
    measured = n.select(F.col("corpus").alias("arm"), F.concat(F.lit("tag."), F.col("tag")).alias("scope"), F.lit("recall").alias("metric"), value.alias("value"), (value - 0.1).alias("ci_lower"), "support")
    rules = spark.createDataFrame([("tag.*", "recall", 0.5, 3, "value"), ("tag.t?xic", "recall", 0.4, 1, "ci_lower")], "scope string, metric string, at_least double, min_support int, basis string")
    return T.policy(measured, rules)


# --- transforms and searches

_cuts = "t AS (SELECT 'quality' AS tag, 0.5 AS cut UNION ALL SELECT 'toxic', 0.6)"
_variant = "SELECT '{name}' AS variant, CAST(count(*) FILTER (WHERE gold AND ({fired})) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT gold AND complete AND ({fired})) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE gold AND NOT ({fired})) AS BIGINT) AS fn FROM z"
_z = """z AS (SELECT s.*, cut, avg(CAST(gold AS DOUBLE)) OVER (PARTITION BY s.tag) AS share, avg(score) OVER (PARTITION BY s.tag) AS mu, stddev_pop(score) OVER (PARTITION BY s.tag) AS sd, count(*) FILTER (WHERE score <> 0) OVER (PARTITION BY doc_id) AS nz, max(score) OVER (PARTITION BY doc_id) AS best,
  row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s.tag) AS place, bool_or(s.tag = 'toxic' AND score >= cut) OVER (PARTITION BY doc_id) AS child, bool_or(s.tag = 'quality' AND score >= cut) OVER (PARTITION BY doc_id) AS parent FROM s JOIN t ON s.tag = t.tag),
line AS (SELECT quantile_cont(best, 0.25) AS line FROM (SELECT DISTINCT doc_id, best FROM z) AS b)"""
_VARIANTS = {
    "plain": "score >= cut", "scaled": "score >= cut * 1.2", "margin": "score >= cut + 0.1", "prevalence": "score >= cut - 0.1 * ln(share / (1 - share))",
    "standardised": "(score - mu) / sd >= cut", "length": "score / sqrt(greatest(nz, 1)) >= cut", "top_1": "score >= cut AND place <= 1", "implied": "score >= cut OR (tag = 'quality' AND child)", "supported": "score >= cut AND (tag <> 'toxic' OR parent)",
    "strict": "score >= cut + CASE WHEN best < (SELECT line FROM line) THEN 0.2 ELSE 0 END",
}


@query("g_transforms", S + "," + _cuts + "," + _z + " " + " UNION ALL ".join(_variant.format(name=n, fired=f) for n, f in _VARIANTS.items()))
def g_transforms(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "tag", "score", "gold", "complete")
    cuts = spark.createDataFrame([("quality", 0.5), ("toxic", 0.6)], "tag string, threshold double")
    plain, pairs = R.plain(rows, cuts), {"toxic": "quality"}
    return R.compared(
        {
            "plain": plain, "scaled": R.scaled(rows, cuts, 1.2), "margin": R.margin(rows, cuts, 0.1), "prevalence": R.prevalence_shift(rows, cuts, 0.1), "standardised": R.plain(R.standardised(rows), cuts),
            "length": R.plain(R.length_normalised(rows), cuts), "top_1": R.top_k(plain, 1), "implied": R.implied(plain, pairs), "supported": R.supported(plain, pairs), "strict": R.strict_on_weak(rows, cuts, 0.2),
        }
    )


def _boxed(name: str, precision: float, recall: float) -> str:
    return f"{name} AS (SELECT tag, threshold AS cut, ok FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ok DESC, {_f(0.25)} DESC, threshold DESC) AS r FROM (SELECT *, recall >= {recall} AND precision >= {precision} AS ok FROM curve) AS a) AS b WHERE r = 1)"


@query("g_transforms_boxed", S + "," + _curve + "," + _boxed("b1", 0.5, 0.9) + "," + _boxed("b2", 0.6, 0.5) + "," + _boxed("b3", 0.9, 0.1) + """,
v AS (SELECT s.*, CAST(score >= b1.cut AS INT) + CAST(score >= b2.cut AS INT) + CAST(score >= b3.cut AS INT) AS yes, CASE WHEN s.tag = 'quality' THEN b1.cut ELSE b2.cut END AS vertical, CASE WHEN b3.ok THEN 0.5 ELSE 'Infinity'::DOUBLE END AS reach FROM s JOIN b1 ON s.tag = b1.tag JOIN b2 ON s.tag = b2.tag JOIN b3 ON s.tag = b3.tag),
z AS (SELECT v.*, arg_max(tag, (score, tag)) FILTER (WHERE score >= 0.5) OVER (PARTITION BY doc_id) AS anchor, (SELECT count(*) > 0 FROM (SELECT doc_id FROM s WHERE gold GROUP BY doc_id HAVING count(DISTINCT tag) = 2) AS p) AS met FROM v) """
+ " UNION ALL ".join(_variant.format(name=n, fired=f) for n, f in {"majority": "yes >= 2", "all": "yes >= 3", "vertical": "score >= vertical", "reachable": "score >= reach", "cooccurring": "score >= 0.5 AND (tag = anchor OR met)"}.items()))
def g_transforms_boxed(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "tag", "score", "gold", "complete")
    half = rows.select("tag").distinct().withColumn("threshold", F.lit(0.5))
    boxes = [(0.5, 0.9), (0.6, 0.5), (0.9, 0.1)]
    return R.compared(
        {
            "majority": R.vote(rows, boxes, 2), "all": R.vote(rows, boxes, 3), "vertical": R.plain(rows, R.by_vertical(rows, {"quality": boxes[0], "toxic": boxes[1]})),
            "reachable": R.plain(rows, R.without_unreachable(rows, half, 0.9, 0.1, 1)), "cooccurring": R.cooccurring(R.plain(rows, half)),
        }
    )


@query("g_trials", S + """, g AS (SELECT 'm' || CAST(a AS STRING) || '/' || CAST(b AS STRING) AS trial, a, b FROM (SELECT unnest([1, 2, 3]) AS a) AS x, (SELECT unnest([5, 7]) AS b) AS y),
r AS (SELECT trial, count(*) FILTER (WHERE gold AND score >= 0.1::DOUBLE * a * b / 2) / count(*) FILTER (WHERE gold) AS recall, coalesce(count(*) FILTER (WHERE gold AND score >= 0.1::DOUBLE * a * b / 2) / nullif(count(*) FILTER (WHERE score >= 0.1::DOUBLE * a * b / 2), 0), 0) AS precision FROM s, g GROUP BY trial)
SELECT trial, recall, precision, recall >= 0.5 AS feasible, CAST(row_number() OVER (ORDER BY recall >= 0.5 DESC, precision DESC, recall DESC, trial) AS INTEGER) AS place FROM r""")
def g_trials(spark, sf_dir):
    params = [(f"m{p['a']}/{p['b']}", p["a"], p["b"]) for p in R.trials({"a": [1, 2, 3], "b": [5, 7]})]
    grid = spark.createDataFrame(params, "trial string, a int, b int")
    fired = F.col("score") >= F.lit(0.1) * F.col("a") * F.col("b") / 2
    rows = scored(spark, sf_dir).join(F.broadcast(grid), how="cross").groupBy("trial")  # trials are parameters, a few rows
    got = rows.agg(M.ratio(F.count_if(F.col("gold") & fired), F.count_if("gold")).alias("recall"), F.coalesce(M.ratio(F.count_if(F.col("gold") & fired), F.count_if(fired)), F.lit(0.0)).alias("precision"))
    return R.rank_trials(got, F.col("recall") >= 0.5, [F.col("precision"), F.col("recall")])


_votes = "SELECT l.doc_id, l.tag, l.g = 1 AS gold, l.doc_id % 2 = 0 AS two, l.doc_id % 3 = 0 AS three FROM (SELECT doc_id, 'quality' AS tag, quality AS g FROM {labels} UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels}) AS l"


@query("g_strategies", duck(f"""WITH v AS ({_votes}), o AS (SELECT tag, gold, option, p FROM v, LATERAL (SELECT unnest(['and', 'or', 'two', 'three']) AS option, unnest([two AND three, two OR three, two, three]) AS p) AS x),
n AS (SELECT tag, option, count(*) FILTER (WHERE gold AND p) AS tp, count(*) FILTER (WHERE NOT gold AND p) AS fp, count(*) FILTER (WHERE gold AND NOT p) AS fn FROM o GROUP BY tag, option),
f AS (SELECT tag, option, CASE WHEN tp = 0 THEN 0 ELSE 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) END AS f2, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM n)
SELECT tag, option, f2, precision, recall FROM f"""))
def g_strategies(spark, sf_dir):
    v = base(spark, sf_dir, _votes, "labels").select("doc_id", "tag", "gold", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("fired")) for a in ("two", "three")))).alias("x"))
    ranked = R.rank_strategies(v.select("doc_id", "tag", "gold", "x.arm", "x.fired"), {"and": ("and", ["two", "three"]), "or": ("or", ["two", "three"]), "two": ("source", ["two"]), "three": ("source", ["three"])})
    return ranked.drop("place")


@query("g_incremental_cut", S + f"""SELECT tag, round(rung * 0.05, 9) AS threshold, precision, recall, ok AS floor_met FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ok DESC, CASE WHEN ok THEN {_f(0.25)} ELSE recall END DESC, rung DESC) AS k FROM (SELECT *, recall >= least(0.999, 0.8 + sqrt(0.8 * 0.2 / (positives * 0.5))) AS ok FROM (
  SELECT tag, rung, tp / (tp + fp) AS precision, tp / positives AS recall, positives FROM (SELECT tag, rung, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY tag) AS positives FROM (SELECT tag, floor(score / 0.05) AS rung, count(*) FILTER (WHERE gold) AS p, count(*) FILTER (WHERE NOT gold) AS n FROM s WHERE gold OR complete GROUP BY ALL) AS a WINDOW w AS (PARTITION BY tag ORDER BY rung DESC)) AS b WHERE positives > 0) AS c) AS d) AS e WHERE k = 1""")
def g_incremental_cut(spark, sf_dir):
    return R.incremental_cut(scored(spark, sf_dir), ["tag"], 0.8, 0.5, 0.05)


# --- linear models

_fired = "SELECT doc_id, t.tag, doc_id % {m} = 0 AS f FROM {{labels}} CROSS JOIN (SELECT 'a' AS tag UNION ALL SELECT 'b' UNION ALL SELECT 'c' UNION ALL SELECT 'd') AS t"


@query("k_content_fusion", "SELECT doc_id, tag FROM (SELECT doc_id, unnest(['a', 'b', 'c', 'd']) AS tag, unnest([doc_id % 2 = 0, doc_id % 3 = 0, doc_id % 2 = 0 OR doc_id % 3 = 0, doc_id % 6 = 0]) AS f FROM labels) AS x WHERE f")
def k_content_fusion(spark, sf_dir):
    arm = lambda m: base(spark, sf_dir, _fired.format(m=m).replace("{{", "{").replace("}}", "}"), "labels").where("f").select("doc_id", "tag")
    return L.fuse_content(arm(2), arm(3), {"b": "content", "c": "or", "d": "and"})


@query("k_document_fusion", "SELECT doc_id, unnest(['and', 'content', 'or']) AS rule, unnest([a AND b, b, a OR b]) AS fires FROM (SELECT doc_id, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b FROM labels) AS x")
def k_document_fusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id")
    out = None
    for rule in ("and", "content", "or"):
        hit = L.fuse_documents(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0"), rule).withColumn("fires", F.lit(True))
        part = rows.join(hit, "doc_id", "left").select("doc_id", F.lit(rule).alias("rule"), F.coalesce("fires", F.lit(False)).alias("fires"))
        out = part if out is None else out.union(part)
    return out


@query("k_equivalence", "SELECT doc_id, source, 'first' AS side FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, source, 'second' FROM documents WHERE doc_id % 10 = 1")
def k_equivalence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return L.differing(docs.where("doc_id % 10 <> 1"), docs.where("doc_id % 10 <> 0"))


_emb = "SELECT vec_id, label, dim, CAST(embedding[dim] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) AS a"


@query("k_bag_scores", f"SELECT label, tag, round(sum(x * w) / count(DISTINCT vec_id), 9) AS score FROM ({_emb}) AS e, LATERAL (SELECT unnest(['p', 'q']) AS tag, unnest([CAST(dim % 3 AS DOUBLE) / 10, CAST(dim % 5 AS DOUBLE) / 10]) AS w) AS h GROUP BY label, tag")
def k_bag_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    cells = rows.select(F.col("vec_id").alias("feature"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    head = cells.select("dim").distinct().select("dim", F.explode(F.array(F.struct(F.lit("p").alias("tag"), F.lit(3).alias("m")), F.struct(F.lit("q").alias("tag"), F.lit(5).alias("m")))).alias("h")).select("h.tag", "dim", (((F.col("dim") + 1) % F.col("h.m")).cast("double") / 10).alias("w"))
    out = L.bag_scores(rows.select("label", F.col("vec_id").alias("feature")), cells, head, "label")
    return out.select("label", "tag", F.round("score", 9).alias("score"))


@query("k_content_scores", f"""WITH e AS ({_emb}), p AS (SELECT label, dim, avg(x) AS mean, max(x) AS top FROM e GROUP BY label, dim), m AS (SELECT dim, avg(mean) AS mm, greatest(stddev_pop(mean), 1e-9) AS sm, avg(top) AS mt, greatest(stddev_pop(top), 1e-9) AS st FROM p GROUP BY dim)
SELECT label, 'p' AS tag, round(sum((mean - mm) / sm * 0.5 + (top - mt) / st * (CAST(dim % 3 AS DOUBLE) / 10)) + 0.25, 6) AS score FROM p JOIN m USING (dim) GROUP BY label""")
def k_content_scores(spark, sf_dir):
    from lanternsift.operators import features as K

    rows = table(spark, sf_dir, "embeddings")
    pooled = K.bag_vectors(rows.select("vec_id", "label"), rows.select("vec_id", "embedding"), "label")
    dims = pooled.select("dim").distinct()
    head = dims.select(F.lit("p").alias("tag"), F.lit("mean").alias("part"), "dim", F.lit(0.5).alias("w")).union(dims.select(F.lit("p"), F.lit("top"), "dim", ((F.col("dim") + 1) % 3).cast("double") / 10))
    out = L.content_scores(pooled, L.scaling_of(pooled), head, spark.createDataFrame([("p", 0.25)], "tag string, bias double"), "label")
    return out.select("label", "tag", F.round("score", 6).alias("score"))
