"""Resolution, classification, metrics and thresholds on small fixtures; queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanternsift.functions.spans import coalesce_intervals
from lanternsift.operators import bootstraps as B
from lanternsift.operators import corpus as C
from lanternsift.operators import features as K
from lanternsift.operators import metrics as M
from lanternsift.operators import thresholds as T
from lanternsift.operators import tokens as N
from lanternsift.operators.resolve import resolve, resolve_by
from lanternsift.plans import api
from lanternsift.plans.queries import oracle_sql, queries
from lanternsift.sources import readers as R

SF = "/root/testdata/sf0.001"
SPAN = "struct<type:string,start:int,end:int,text:string,confidence:double,detector:string>"


def spans(spark, rows, fold=resolve):
    df = spark.createDataFrame([([(t, a, b, "x", c, d) for t, a, b, c, d in rows],)], f"s array<{SPAN}>")
    return [(e["type"], e["start"], e["end"]) for e in df.select(fold(F.col("s")).alias("r")).first()["r"]]


def test_overlaps_go_to_the_better_span(spark):
    assert spans(spark, [("PHONE_US", 0, 12, 0.85, "regex/phone_us"), ("FAX_NUMBER", 0, 12, 0.90, "regex/fax"), ("EMAIL", 12, 20, 0.95, "regex/email")]) == [("FAX_NUMBER", 0, 12), ("EMAIL", 12, 20)]
    assert spans(spark, [("URL", 0, 5, 0.85, "regex/url"), ("EMAIL", 0, 9, 0.85, "regex/email")]) == [("EMAIL", 0, 9)]
    assert spans(spark, []) == []


def test_model_spans_rank_between_checks_and_cues(spark):
    model = ("USER_ID", 0, 9, 0.99, "onnx/ner-v1")
    assert spans(spark, [model, ("SSN", 2, 9, 0.7, "regex/ssn")]) == [("SSN", 2, 9)]
    assert spans(spark, [model, ("ACCOUNT_NUMBER", 2, 9, 0.8, "regex/account_number")]) == [("USER_ID", 0, 9)]
    assert spans(spark, [("ACCOUNT_NUMBER", 4, 9, 0.9, "onnx/ner-v1"), ("ACCOUNT_NUMBER", 2, 9, 0.8, "regex/account_number")]) == [("ACCOUNT_NUMBER", 2, 9)]
    assert spans(spark, [model, ("MRN", 2, 9, 0.8, "regex/mrn")]) == [("MRN", 2, 9)]
    assert spans(spark, [model, ("ACCOUNT_NUMBER", 2, 9, 0.8, "regex/account_number")], lambda s: resolve_by(s, "rules_first")) == [("ACCOUNT_NUMBER", 2, 9)]
    assert spans(spark, [model, ("SSN", 2, 9, 0.7, "regex/ssn")], lambda s: resolve_by(s, "longest_wins")) == [("USER_ID", 0, 9)]


def test_classification_rules(spark):
    texts = ["", "a@b.org", "the patient a@b.org", "impatient a@b.org", "MRN: 1234567", "met Mary Smith, DOB: 01/02/1980, at 12 Maple Street now", "a@b.org c@d.org e@f.org g@h.org"]
    rows = api.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["label"] for r in rows] == ["NONE", "PII", "PHI", "PII", "PHI", "PII", "PII"]
    assert [round(r["risk_score"], 6) for r in rows] == [0, 9.5, 24.5, 9.5, 40.5, 62.5, 28.5]
    assert rows[5]["combos"] == ["PERSON_NAME+DATE_DOB+ADDRESS"] and rows[6]["counts"] == {"EMAIL": 4}
    assert api.any_found(api.scan(spark.createDataFrame([("x",)], "text string"))).first()["found"] is False


def test_scan_is_independent_of_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = (api.spans(api.scan(docs.repartition(n))) for n in (1, 7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([([(5, 9), (0, 3), (3, 4), (8, 12)],)], "w array<struct<start:int,end:int>>")
    assert [tuple(w) for w in df.select(coalesce_intervals(F.col("w")).alias("r")).first()["r"]] == [(0, 4), (5, 12)]


def test_unknown_is_null_not_zero(spark):
    rows = [("a", 1, "x", True, True, 0.9), ("b", 2, "x", True, False, 0.9), ("b", 3, "x", False, False, 0.9)]
    df = spark.createDataFrame(rows, "corpus string, doc_id int, tag string, gold boolean, complete boolean, score double")
    got = {(r["corpus"], r["tag"]): r for r in M.masked_metrics(df, spark.createDataFrame([("x",), ("never",)], "tag string"), F.col("score") >= 0.5, ["corpus"]).collect()}
    assert got["b", "x"]["precision"] is None and got["b", "x"]["recall"] == 1.0 and got["b", "x"]["fp"] == 0
    assert got["a", "never"]["recall"] is None


def test_ties_are_cut_between_distinct_scores_only(spark):
    df = spark.createDataFrame([("t", s, g, True) for s, g in [(0.9, True), (0.5, True), (0.5, False), (0.1, False)]], "tag string, score double, gold boolean, complete boolean")
    curve = {r["threshold"]: (r["tp"], r["fp"]) for r in T.sweep(df, ["tag"]).collect()}
    assert curve == {0.9: (1, 0), 0.5: (2, 1), 0.1: (2, 2)}
    assert T.roc_auc(df, ["tag"]).first()["auc"] == pytest.approx(0.875)


def test_isotonic_pools(spark):
    got = T.pool_adjacent(np.arange(5.0), np.array([2.0, 7, 3, 4, 9]), np.array([1.0, 1, 1, 2, 1]))
    assert [(a, b) for a, b, _ in got] == [(0, 0), (1, 3), (4, 4)] and got[1][2] == pytest.approx(4.5)


def _isotonic_by_hand(points):
    """The least upper mean over the greatest lower mean, at every distinct score."""
    xs = sorted({x for x, _ in points})
    mean = lambda a, b: np.mean([y for x, y in points if a <= x <= b])
    return {x: max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs}


def test_calibration(spark):
    draw = np.random.default_rng(3)
    rows = [("t", float(s) / 20, bool(draw.random() < s / 20), True) for s in draw.integers(0, 21, 120)] + [("few", 0.5, True, True), (None, 0.25, False, True)]
    df = spark.createDataFrame(rows, "tag string, score double, gold boolean, complete boolean")
    knots = T.isotonic(df, "tag", min_spans=10)
    assert {r["tag"] for r in knots.collect()} == {"t", None}
    own = _isotonic_by_hand([(s, g) for t, s, g, _ in rows if t == "t"])
    every = _isotonic_by_hand([(s, g) for _, s, g, _ in rows])
    asked = spark.createDataFrame([(t, s) for t in ("t", "few", "new", None) for s in sorted(own)], "tag string, score double")
    for r in T.calibrated(asked, knots, "tag").collect():
        if r["tag"] == "t":
            assert r["calibrated"] == pytest.approx(own[r["score"]])
        elif r["score"] in every:  # types without a curve of their own have that of all
            assert r["calibrated"] == pytest.approx(every[r["score"]])
    one = spark.createDataFrame([("a", 0.2, False), ("a", 0.4, True)], "tag string, score double, gold boolean")
    between = T.calibrated(spark.createDataFrame([("a", 0.3), ("a", 2.0), ("a", -1.0)], "tag string, score double"), T.isotonic(one, "tag"), "tag").collect()
    assert [round(r["calibrated"], 9) for r in between] == [0.5, 1.0, 0.0]
    assert T.calibrated(asked, knots.limit(0), "tag").where("calibrated <> score").count() == 0


def test_bootstraps(spark):
    counts = spark.createDataFrame([("a", 80, 20, 5000), ("b", 0, 0, 10), ("c", 3, 1, 4)], "tag string, tp int, fn int, n int")
    boot = {r["tag"]: r for r in B.recall_interval(counts, "tag").collect()}
    rng = np.random.default_rng(1)
    flags = np.concatenate((np.ones(80), np.zeros(20), np.full(4900, np.nan)))
    plain = [np.nanmean(rng.choice(flags, 5000)) for _ in range(800)]
    assert boot["a"]["recall"] == 0.8 and boot["b"]["recall"] is None
    assert np.allclose([boot["a"]["low"], boot["a"]["high"]], np.quantile(plain, (0.025, 0.975)), atol=0.02)
    assert {r["tag"]: r for r in B.recall_interval(counts, "tag").collect()} == boot

    draw = np.random.default_rng(7)
    rows = [(i, t, str(draw.choice(["tp", "fp", "fn"], p=p))) for i in range(600) for t, p in (("x", [0.6, 0.2, 0.2]), ("y", [0.3, 0.3, 0.4])) if draw.random() < 0.7]
    got = {r["measure"]: r for r in B.fbeta_intervals(spark.createDataFrame(rows, "doc_id long, tag string, outcome string"), draws=400).collect()}
    cells = np.zeros((600, 2, 3))
    for i, t, o in rows:
        cells[i, "xy".index(t), ["tp", "fp", "fn"].index(o)] += 1
    f2 = lambda c: 5 * c[..., 0] / (5 * c[..., 0] + 4 * c[..., 2] + c[..., 1])
    plain = np.array([(f2(c).mean(), f2(c.sum(axis=0))) for c in (cells[draw.integers(0, 600, 600)].sum(axis=0) for _ in range(600))])
    for k, name in enumerate(("macro", "micro")):
        assert got[name]["value"] == pytest.approx((f2(cells.sum(axis=0)).mean(), f2(cells.sum(axis=(0, 1))))[k])
        assert np.allclose([got[name]["low"], got[name]["high"]], np.quantile(plain[:, k], (0.025, 0.975)), atol=0.015)
    flags = B.flag_interval(spark.createDataFrame([("a", 30, 100), ("b", 0, 0)], "corpus string, yes int, n int"), "corpus").collect()
    assert {r["corpus"]: r["rate"] for r in flags} == {"a": 0.3, "b": None} and flags[0]["low"] < 0.3 < flags[0]["high"]
    cluster = B.cluster_interval(spark.createDataFrame([("t", float(v)) for v in range(5)], "tag string, value double"), "tag").first()
    assert cluster["value"] == 2 and 0 < cluster["low"] < 2 < cluster["high"] < 4


def test_features_hide_values_and_are_stable(spark):
    docs = spark.createDataFrame([(1, "SSN 123-45-6789 filed"), (2, "SSN 987-65-4321 filed"), (3, None), (4, "w " * 5000 + "x" * 50)], "doc_id int, text string")
    got = {r["doc_id"]: r["features"] for r in K.hashed(K.feature_names(docs), most=16).collect()}
    assert got[1] == got[2] and len(got[3]) == 1 and all(len(f) <= 16 and f == sorted(set(f)) for f in got.values())


def test_splits_keep_groups_and_copies_together(spark):
    docs = spark.createDataFrame([(i, f"s{i % 7}", f"Text  {i % 50} ß") for i in range(500)], "doc_id int, source string, text string")
    split = C.digest_split(docs)
    assert split.groupBy("text").agg(F.count_distinct("held").alias("n")).where("n > 1").count() == 0
    assert C.leaked(docs.where("doc_id < 50"), docs.where("doc_id >= 450").withColumn("text", F.upper("text"))).count() == 50


def test_bio_round_trip(spark):
    toks = spark.createDataFrame([(1, p, p * 5, p * 5 + 4) for p in range(8)], "doc_id int, pos int, start int, end int")
    want = [(1, "NAME", 5, 14), (1, "CITY", 25, 29)]
    labels = N.bio_encode(toks, spark.createDataFrame(want, "doc_id int, type string, start int, end int"))
    back = N.bio_decode(toks.join(labels, ["doc_id", "pos"]).withColumn("prob", F.lit(1.0)))
    assert sorted((r["doc_id"], r["type"], r["start"], r["end"]) for r in back.collect()) == sorted(want)


def test_a_missing_tagger_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        N.tag_with(spark.createDataFrame([("x",)], "text string"), None)
    model = lambda texts: [[("USER_ID", 0, len(t), t, 0.9, "onnx/ner-v1")] if t else [] for t in texts]
    tagged = N.tag_with(spark.createDataFrame([("bob7",), (None,)], "text string"), model)
    assert [[e["text"] for e in r["entities"]] for r in api.scan(tagged, extra=F.col("model_spans")).collect()] == [["bob7"], []]


def test_snap_and_chunks(spark):
    df = spark.createDataFrame([("id abc123 end", [("X", 4, 8)])], "text string, s array<struct<type:string,start:int,end:int>>")
    assert [(e["start"], e["end"]) for e in df.select(N.snap(F.col("s"), F.col("text")).alias("r")).first()["r"]] == [(3, 9)]
    with pytest.raises(ValueError):
        N.chunks(F.lit(10), 4, 2)


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text('{"rows": [{"uid": "a", "n": 1}, {"uid": "b", "n": 2}]}')
    assert sorted(tuple(r) for r in R.manifest(spark, str(tmp_path / "m"), "uid string, n int").collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "m" / "labels.jsonl").write_text('{"uid": "c", "n": 3}\n\n')
    assert [tuple(r) for r in R.manifest(spark, str(tmp_path / "m"), "uid string, n int").collect()] == [("c", 3)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<p>x &amp; y</p>")
    (tmp_path / "d" / "b.docx").write_bytes(b"no zip")
    got = {r["kind"]: r for r in R.documents(spark, str(tmp_path / "d")).collect()}
    assert got["html"]["text"] == "x & y" and got["docx"]["text"] is None and got["docx"]["error"]


def test_stream_scan(spark, tmp_path):
    from lanternsift.streaming.alerts import alerts, scanned

    spark.createDataFrame([("2024-01-01 00:00:00", "mail a@b.org")], "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = alerts(scanned(stream)).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["type"], r["n"]) for r in spark.table("seen").collect()] == [("EMAIL", 1)]


def rows(columns, data):
    def plain(v):
        return round(v, 7) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "customer", "benchmark", "pages", "events", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    decimal = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert rows(names, [[r[c] for c in names] for r in df.collect()]) == rows(names, [[decimal(r[i]) for i in at] for r in want.fetchall()])


def test_entry(spark):
    got = {r["label"]: r["n"] for r in entry.entry(spark).collect()}
    assert sum(got.values()) == spark.read.parquet(f"{SF}/documents.parquet").count()
