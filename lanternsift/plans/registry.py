"""Registered queries: each operator over a whole table, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternsift.functions import validators as V
from lanternsift.operators import corpus as C
from lanternsift.operators import features as K
from lanternsift.operators import metrics as M
from lanternsift.operators import thresholds as T
from lanternsift.operators import tokens as N
from lanternsift.operators.classify import classify
from lanternsift.operators.detectors import registry
from lanternsift.operators.resolve import resolve
from lanternsift.plans import api
from lanternsift.sources import readers as R
from lanternsift.sources.rendered import PLANTS, luhn_sum, pad, rendered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A relation that both engines derive by the same SQL."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"_in_{t}")
        sql = sql.replace(f"{{{t}}}", f"_in_{t}")
    return spark.sql(sql)


def duck(sql: str) -> str:
    for t in ("documents", "labels", "customer", "benchmark", "pages", "events", "conversations", "embeddings", "orders", "lineitem"):
        sql = sql.replace(f"{{{t}}}", t)
    return sql


# --- planted identifiers: detectors and validators

DETECTOR = {
    "email": "email", "phone": "phone_us", "ssn": "ssn", "licence": "us_driver_license", "card": "credit_card", "account": "account_number", "ipv4": "ip_address", "ipv6": "ipv6", "url": "url",
    "dob": "date_dob", "health_plan": "health_plan_id", "mrn": "mrn", "routing": "bank_routing", "vin": "vehicle_id", "swift": "swift_bic", "mac": "mac_address", "fax": "fax", "tax_id": "tax_id", "address": "gazetteer",
}


def _planted(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rendered(spark, sf_dir, PLANTS[kind])
        if kind == "name":
            found = api.scan(docs, detectors=registry()[:1])
        else:
            found = api.scan(docs, detectors=[d for d in registry(F.lit("2024-01-01").cast("date")) if d.name == DETECTOR[kind]], names=False)
        return api.spans(found).select("doc_id", "type", "start", "end", "text", "confidence")

    return run


for _kind, _plant in PLANTS.items():
    query(f"d_planted_{_kind}", _plant.truth())(_planted(_kind))

CHECK = {
    "phone": ("v_nanp", lambda c: V.nanp_ok(F.substring(c, 2, 3), F.substring(c, 7, 3))),
    "ssn": ("v_ssn", lambda c: V.ssn_ok(F.substring(c, 1, 3), F.substring(c, 5, 2), F.substring(c, 8, 4))),
    "card": ("v_luhn", V.luhn_ok),
    "ipv6": ("v_ipv6", V.ipv6_ok),
    "routing": ("v_aba", V.aba_ok),
    "vin": ("v_vin", V.vin_ok),
    "swift": ("v_swift", V.swift_ok),
    "mac": ("v_mac", V.mac_ok),
    "tax_id": ("v_ein", lambda c: V.ein_ok(V.digits(c))),
}


def _checked(kind: str):
    return lambda spark, sf_dir: rendered(spark, sf_dir, PLANTS[kind]).select("doc_id", "ident", CHECK[kind][1](F.col("ident")).alias("ok"))


for _kind, (_name, _) in CHECK.items():
    query(_name, PLANTS[_kind].checks())(_checked(_kind))

IDS = "SELECT CAST(c_custkey AS BIGINT) AS k FROM {customer}"


@query("v_iin", duck(f"""SELECT k, n, substr(n, 1, 1) = '4' OR substr(n, 1, 2) BETWEEN '51' AND '55' OR substr(n, 1, 4) BETWEEN '2221' AND '2720' OR substr(n, 1, 2) IN ('34', '37', '65') OR substr(n, 1, 4) = '6011' AS ok
FROM (SELECT k, {pad('k * 7', 5)} || '00000000000' AS n FROM ({IDS}) AS i) AS x"""))
def v_iin(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT k, {pad('k * 7', 5)} || '00000000000' AS n FROM ({IDS})", "customer")
    return rows.select("k", "n", V.card_iin_known(F.col("n")).alias("ok"))


@query("v_ipv4", duck(f"SELECT k, CAST(k % 400 AS STRING) || '.1.' || CAST(k % 260 AS STRING) || '.0' AS ip, k % 400 <= 255 AND k % 260 <= 255 AS ok FROM ({IDS}) AS i"))
def v_ipv4(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT k, CAST(k % 400 AS STRING) || '.1.' || CAST(k % 260 AS STRING) || '.0' AS ip FROM ({IDS})", "customer")
    return rows.select("k", "ip", V.ipv4_ok(F.col("ip")).alias("ok"))


@query("v_dob", duck(f"""SELECT k, 1880 + k % 160 AS y, k % 14 AS m, k % 33 AS d,
  TRY_CAST(CAST(1880 + k % 160 AS STRING) || '-' || {pad('k % 14', 2)} || '-' || {pad('k % 33', 2)} AS DATE) IS NOT NULL AND 1880 + k % 160 BETWEEN 1900 AND 2024 AS ok FROM ({IDS}) AS i"""))
def v_dob(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT k, 1880 + k % 160 AS y, k % 14 AS m, k % 33 AS d FROM ({IDS})", "customer")
    return rows.select("k", "y", "m", "d", V.plausible_dob(*(F.col(c).cast("string") for c in "ymd"), F.lit("2024-06-01").cast("date")).alias("ok"))


# --- detectors over documents

_pieces = """SELECT doc_id, i, hits[i] AS text, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos
FROM (SELECT doc_id, hits, pieces, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM documents WHERE text IS NOT NULL) AS a WHERE len(hits) > 0) AS b"""


def _on_documents(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return api.spans(api.scan(docs, detectors=[d for d in registry() if d.name == name], names=False)).select("doc_id", "start", "end", "text", "confidence")

    return run


query(
    "d_email_spans",
    f"""SELECT doc_id, CAST(pos AS INTEGER) AS start, CAST(pos + length(text) AS INTEGER) AS "end", text, CAST(0.95 AS DOUBLE) AS confidence
FROM ({_pieces.replace('{p}', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-.]+[.][A-Za-z][A-Za-z]+')}) AS s WHERE NOT regexp_matches(split_part(text, '@', 1), '^[.]|[.]$')""",
)(_on_documents("email"))

# Dotted numbers tile without lookarounds: a match is a maximal one of four groups, which no version cue precedes.
_left = "substr(text0, greatest(CAST(pos AS BIGINT) - 24, 0) + 1, least(CAST(pos AS BIGINT), 24))"
_version = "(?i)(\\bv|\\b(build|firmware|patch|release|rev|revision|schema|shipped|upgrade|ver|version)\\b[^0-9A-Za-z_]{0,3})$"
query(
    "d_ipv4_spans",
    f"""SELECT s.doc_id, CAST(pos AS INTEGER) AS start, CAST(pos + length(s.text) AS INTEGER) AS "end", s.text, CAST(0.7 AS DOUBLE) AS confidence
FROM ({_pieces.replace('{p}', '[0-9]+(?:[.][0-9]+)*')}) AS s JOIN (SELECT doc_id, text AS text0 FROM documents) AS d ON s.doc_id = d.doc_id
WHERE regexp_full_match(s.text, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}') AND NOT list_contains(list_transform(string_split(s.text, '.'), lambda x: CAST(x AS INT) > 255 OR (length(x) > 1 AND x[1] = '0')), TRUE)
  AND NOT regexp_matches({_left}, '{_version}')""",
)(_on_documents("ip_address"))

#: Cue rules and lookarounds are beyond SQL; tests compare these with a plain search by Python's re.
query("d_card_spans")(_on_documents("credit_card"))
query("d_phone_spans")(_on_documents("phone_us"))


# --- resolution and classification

_span_sets = """SELECT k, kind, type, "start", "end", confidence, detector FROM (
  SELECT k, 'a' AS kind, 'PHONE_US' AS type, 0 AS "start", 12 AS "end", 0.85 AS confidence, 'regex/phone_us' AS detector FROM ids UNION ALL
  SELECT k, 'b', 'FAX_NUMBER', 0, 12, CASE WHEN k % 2 = 0 THEN 0.90 ELSE 0.80 END, 'regex/fax' FROM ids UNION ALL
  SELECT k, 'c', 'EMAIL', 20, 30, 0.95, 'regex/email' FROM ids UNION ALL
  SELECT k, 'd', 'URL', 29, 40, 0.85, 'regex/url' FROM ids WHERE k % 3 = 0 UNION ALL
  SELECT k, 'e', 'MRN', 50, 58, 0.85, 'regex/mrn' FROM ids UNION ALL
  SELECT k, 'f', 'USER_ID', 50, 60, 0.99, 'onnx/ner-v1' FROM ids WHERE k % 5 = 0 UNION ALL
  SELECT k, 'g', 'ACCOUNT_NUMBER', 70, 78, 0.80, 'regex/account_number' FROM ids UNION ALL
  SELECT k, 'h', 'USER_ID', 72, 90, 0.60, 'onnx/ner-v1' FROM ids WHERE k % 5 = 0) AS s"""
_ids = f"WITH ids AS ({IDS}) "


# With a model span in the row: checksummed and promoted rules, then the model, then cue rules. MRN is specific to health, so it is promoted.
@query("c_fusion_tiers", duck(_ids) + f"""SELECT k AS doc_id, kind FROM (SELECT s.*, CASE
    WHEN kind = 'a' THEN k % 2 = 1 WHEN kind = 'b' THEN k % 2 = 0 WHEN kind = 'd' THEN FALSE
    WHEN kind IN ('c', 'e') THEN TRUE WHEN kind = 'f' THEN FALSE
    WHEN kind = 'g' THEN k % 5 <> 0 ELSE TRUE END AS stays FROM ({_span_sets}) AS s) AS t WHERE stays""")
def c_fusion_tiers(spark, sf_dir):
    rows = base(spark, sf_dir, _ids + _span_sets.replace('"start"', "`start`").replace('"end"', "`end`"), "customer")
    span = F.struct("type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("kind").alias("text"), F.col("confidence").cast("double").alias("confidence"), "detector")
    kept = rows.groupBy("k").agg(F.collect_list(span).alias("s")).select("k", F.explode(resolve(F.col("s"))).alias("e"))
    return kept.select(F.col("k").alias("doc_id"), F.col("e.text").alias("kind"))


_case_text = """CASE k % 6 WHEN 0 THEN 'nothing here' WHEN 1 THEN 'mail a@b.org' WHEN 2 THEN 'the patient, mail a@b.org' WHEN 3 THEN 'MRN: 1234567'
  WHEN 4 THEN 'met Mary Smith, DOB: 01/02/1980, at 12 Maple Street now' ELSE 'a@b.org c@d.org e@f.org g@h.org' END"""


@query("e_report", duck(_ids) + """SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN 'NONE' WHEN 2 THEN 'PHI' WHEN 3 THEN 'PHI' ELSE 'PII' END AS label,
  CAST(CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 9.5 WHEN 2 THEN 24.5 WHEN 3 THEN 40.5 WHEN 4 THEN 62.5 ELSE 28.5 END AS DOUBLE) AS risk,
  CAST(CASE k % 6 WHEN 0 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 4 ELSE 1 END AS BIGINT) AS direct_count, CAST(CASE k % 6 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS quasi_count,
  CASE k % 6 WHEN 4 THEN 'PERSON_NAME+DATE_DOB+ADDRESS' ELSE '' END AS combos FROM ids""")
def e_report(spark, sf_dir):
    docs = base(spark, sf_dir, _ids + f"SELECT k AS doc_id, {_case_text} AS text FROM ids", "customer")
    r = api.report(docs, as_of=F.lit("2024-01-01").cast("date"))
    return r.select("doc_id", "label", F.round("risk_score", 6).alias("risk"), F.col("direct_count").cast("bigint").alias("direct_count"), F.col("quasi_count").cast("bigint").alias("quasi_count"), F.array_join("combos", ",").alias("combos"))


@query("e_label_counts", duck(_ids) + """SELECT CASE k % 6 WHEN 0 THEN 'NONE' WHEN 2 THEN 'PHI' WHEN 3 THEN 'PHI' ELSE 'PII' END AS label, count(*) AS n,
  avg(CAST(CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 9.5 WHEN 2 THEN 24.5 WHEN 3 THEN 40.5 WHEN 4 THEN 62.5 ELSE 28.5 END AS DOUBLE)) AS mean_risk FROM ids GROUP BY 1""")
def e_label_counts(spark, sf_dir):
    return e_report(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk"))


@query("e_scan_documents")
def e_scan_documents(spark, sf_dir):
    """The full scan and classification of documents; tests compare it with the column form, which searches whole texts."""
    r = api.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "label", F.round("risk_score", 6).alias("risk"), F.size("entities").cast("bigint").alias("n"), F.to_json("entities").alias("entities"))


# --- sources

@query("a_html_text", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def a_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.strip_tags(F.col("html")).alias("text"))


@query("a_slice", "SELECT doc_id, lang FROM documents WHERE doc_id >= 100 AND doc_id < 300")
def a_slice(spark, sf_dir):
    """The operator is a slice: the range is its argument."""
    return R.slice_of(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 300)


@query("a_filter_scan", "SELECT doc_id, source FROM documents WHERE lang IN ('*', 'de')")
def a_filter_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("*", "de")).select("doc_id", "source")


@query("a_paths", duck(f"""SELECT k, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'docs/' || CAST(k AS STRING) WHEN k % 4 = 2 THEN 'f' || CAST(k AS STRING) ELSE NULL END AS path FROM ({IDS}) AS i"""))
def a_paths(spark, sf_dir):
    rows = base(spark, sf_dir, f"""SELECT k, CASE WHEN k % 4 = 0 THEN '/etc/x' WHEN k % 4 = 1 THEN 'docs/' || CAST(k AS STRING) WHEN k % 4 = 3 THEN 'a/../b' ELSE '  ' END AS text_path,
      CASE WHEN k % 4 = 2 THEN 'f' || CAST(k AS STRING) END AS path, CAST(NULL AS STRING) AS file, CAST(NULL AS STRING) AS doc_path, CAST(NULL AS STRING) AS zip_path FROM ({IDS})""", "customer")
    return rows.select("k", R.document_path().alias("path"))


@query("a_marked", duck(f"""SELECT k, 'see ' || CAST(k AS STRING) || ' and x' || CAST(k AS STRING) AS plain, unnest(['SSN', 'EMAIL']) AS type,
  unnest([4, 9 + length(CAST(k AS STRING))]) AS start, unnest([4 + length(CAST(k AS STRING)), 10 + 2 * length(CAST(k AS STRING))]) AS "end", unnest([CAST(k AS STRING), 'x' || CAST(k AS STRING)]) AS text FROM ({IDS}) AS i"""))
def a_marked(spark, sf_dir):
    rows = base(spark, sf_dir, f"SELECT k, 'see [[SSN:' || CAST(k AS STRING) || ']] and [[EMAIL:x' || CAST(k AS STRING) || ']]' AS text FROM ({IDS})", "customer")
    plain, spans = R.marked(F.col("text"))
    return rows.select("k", plain.alias("plain"), F.explode(spans).alias("s")).select("k", "plain", "s.type", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), "s.text")


@query("a_span_lists", duck(f"SELECT k, 1 AS start, CAST(k % 50 AS INTEGER) AS \"end\", 'it''s' AS text, 'name' AS label FROM ({IDS}) AS i"))
def a_span_lists(spark, sf_dir):
    rows = base(spark, sf_dir, f"""SELECT k, CASE WHEN k % 2 = 0 THEN '[{{"start": 1, "end": ' || CAST(k % 50 AS STRING) || ', "text": "it\\'s", "label": "name"}}]'
      ELSE '[{{\\'start\\': 1, \\'end\\': ' || CAST(k % 50 AS STRING) || ', \\'text\\': "it\\'s", \\'label\\': \\'name\\'}}]' END AS spans FROM ({IDS})""", "customer")
    return rows.select("k", F.explode(R.parse_spans(F.col("spans"))).alias("s")).select("k", "s.start", "s.end", "s.text", "s.label")


@query("a_turns_joined", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def a_turns_joined(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count(F.lit(1)).alias("n"))
    return parts.select("conv_id", F.array_join(F.col("t.text"), "\n").alias("text"), "n")


@query("a_json_props", "SELECT event_id, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL")
def a_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.json_array_length(F.to_json(F.json_object_keys("props"))).cast("bigint").alias("n_keys"))


# --- corpus preparation

_norm = "replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"
_digest = f"sha256({_norm})"


@query("p_exact_dups", f"SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {_digest} AS digest FROM documents) AS d GROUP BY digest HAVING count(*) > 1")
def p_exact_dups(spark, sf_dir):
    return C.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("p_leakage", f"""WITH d AS (SELECT doc_id, source, {_digest} AS digest FROM documents)
SELECT doc_id, source FROM d WHERE doc_id % 5 <> 0 AND digest IN (SELECT digest FROM d WHERE doc_id % 5 = 0)""")
def p_leakage(spark, sf_dir):
    """Train is four fifths of the ids and evaluation the rest: the split is the operator's input."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return C.leaked(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")).select("doc_id", "source")


@query("p_exclusions", f"""WITH d AS (SELECT doc_id, source, {_digest} AS digest FROM documents)
SELECT source, count(*) AS n FROM d WHERE doc_id % 5 <> 0 AND digest NOT IN (SELECT digest FROM d WHERE doc_id % 5 = 0) GROUP BY source""")
def p_exclusions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    train = docs.where("doc_id % 5 <> 0")
    return C.without(train, C.leaked(train, docs.where("doc_id % 5 = 0")), ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_words = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
_grams = "SELECT DISTINCT {key}, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, {w} AS w FROM {t}) AS a WHERE len(w) >= 8) AS b"


@query("p_decontaminate", f"SELECT DISTINCT doc_id, item_id FROM ({_grams.replace('{key}', 'doc_id').replace('{w}', _words).replace('{t}', 'documents')}) AS d JOIN ({_grams.replace('{key}', 'item_id').replace('{w}', _words).replace('{t}', 'benchmark')}) AS b USING (g)")
def p_decontaminate(spark, sf_dir):
    return C.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("p_audit", f"""SELECT corpus, count(*) AS n_rows, CAST(count(*) FILTER (WHERE text IS NOT NULL AND length(text) > 0) AS BIGINT) AS n_readable, count(DISTINCT digest) AS n_distinct,
  count(*) - count(DISTINCT digest) AS n_duplicates, CAST(count(*) FILTER (WHERE label_complete) AS BIGINT) AS n_complete, avg(CAST(length(text) AS DOUBLE)) AS mean_chars
FROM (SELECT d.source AS corpus, d.text, l.doc_id IS NOT NULL AS label_complete, {_digest.replace('text', 'd.text')} AS digest FROM documents d LEFT JOIN labels l USING (doc_id)) AS x GROUP BY corpus""")
def p_audit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    return C.audit(docs.join(labels, "doc_id", "left").select(F.col("source").alias("corpus"), "text", F.col("has").isNotNull().alias("label_complete")))


@query("p_tag_fold", """SELECT doc_id, list_aggregate(list_sort(list_distinct(list_transform(tags, lambda t: CASE t WHEN 'quality' THEN 'good' WHEN 'fine' THEN 'good' ELSE t END))), 'string_agg', ',') AS tags
FROM (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'fine', CASE WHEN doc_id % 2 = 0 THEN 'odd' END], lambda x: x IS NOT NULL) AS tags FROM labels) AS l""")
def p_tag_fold(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.lit("fine"), F.when(F.col("doc_id") % 2 == 0, "odd")))
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(C.fold_tags(tags, {"quality": "good", "fine": "good"}), ",").alias("tags"))


@query("p_verdict", """SELECT CASE WHEN doc_id % 7 = 0 THEN FALSE WHEN doc_id % 7 = 1 THEN TRUE WHEN toxic = 1 THEN TRUE WHEN quality = 1 THEN FALSE END AS truth, count(*) AS n FROM labels GROUP BY 1""")
def p_verdict(spark, sf_dir):
    judged = F.when(F.col("doc_id") % 7 == 0, "clean").when(F.col("doc_id") % 7 == 1, "sensitive")
    rows = table(spark, sf_dir, "labels").select(C.verdict(judged, F.col("quality") == 1, F.col("toxic") == 1).alias("truth"))
    return rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"))


@query("p_absence", "SELECT CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS n_negative, CAST(0.0 AS DOUBLE) AS ambiguous_share FROM labels")
def p_absence(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("truth"), F.col("toxic").isNull().alias("odd"))
    return C.assert_absence(rows, "truth", F.col("odd"))


@query("p_slugs", duck("SELECT DISTINCT source, 'sensitive_pii_' || replace(source || ' & co', ' & ', '_and_') AS slug FROM documents"))
def p_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", C.tag_slug(F.concat(F.lit("("), F.col("source"), F.lit(")' & co.")), F.lit("pii")).alias("slug"))


_bucket = "CAST(('0x' || substr(sha256({x}), 1, 8)) AS UBIGINT)"


@query("s_hash_split", f"SELECT doc_id, {_bucket.replace('{x}', chr(99) + 'oncat(source, ' + repr('|') + ', doc_id)')} % 10000 < 1500 AS held FROM documents")
def s_hash_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.hash_split(docs, F.concat_ws("|", "source", F.col("doc_id").cast("string"))).select("doc_id", "held")


@query("s_grouped_split", f"SELECT source, count(*) AS n, {_bucket.replace('{x}', 'source')} % 10000 < 3000 AS held FROM documents GROUP BY source")
def s_grouped_split(spark, sf_dir):
    return C.hash_split(table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), F.col("source"), 0.3)


@query("s_digest_split", f"SELECT doc_id, {_bucket.replace('{x}', _norm)} % 10 = 0 AS held FROM documents")
def s_digest_split(spark, sf_dir):
    return C.digest_split(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "held")


_at = "row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS STRING)))"


@query("s_positional_split", f"SELECT doc_id, r <= (CASE WHEN n >= 2 THEN greatest(1, floor(n * 0.2)) ELSE 0 END) AS held FROM (SELECT doc_id, {_at} AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) AS x")
def s_positional_split(spark, sf_dir):
    return C.positional_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "held")


@query("s_linspace_sample", """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents) AS x
WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda i: floor(i * (n - 1) / 7)), pos)""")
def s_linspace_sample(spark, sf_dir):
    return C.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 8)


@query("s_hash_sample", f"SELECT doc_id, source FROM (SELECT doc_id, source, {_at} AS r FROM documents) AS x WHERE r <= 5")
def s_hash_sample(spark, sf_dir):
    return C.first_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("s_leave_one_out", "SELECT f.fold, CASE WHEN d.source = f.fold THEN 'evaluation' ELSE 'train' END AS role, count(*) AS n FROM documents d, (SELECT DISTINCT source AS fold FROM documents) AS f GROUP BY 1, 2")
def s_leave_one_out(spark, sf_dir):
    return C.fold_counts(table(spark, sf_dir, "documents").select("source"), "source")


@query("s_snapshot_diff", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 11 = 0 AND doc_id % 13 <> 0) OR (doc_id % 13 = 0 AND doc_id % 11 <> 0) OR (doc_id % 17 = 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)")
def s_snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    after = docs.where("doc_id % 11 <> 0").withColumn("digest", F.when(F.col("doc_id") % 17 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return C.snapshot_changes(docs.where("doc_id % 13 <> 0"), after, "doc_id", "digest")


@query("f_catalogue", "SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_id FROM (SELECT DISTINCT source || '/' || lang AS tag FROM documents) AS t")
def f_catalogue(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.array(F.concat_ws("/", "source", "lang")).alias("tags"))
    return C.frozen_catalogue(rows, "tags").withColumn("tag_id", F.col("tag_id").cast("bigint"))
