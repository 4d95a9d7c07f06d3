"""What SQL can't express, against plain Python; readers, models and searches on small fixtures."""

import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternsift.operators import corpus as C
from lanternsift.operators import features as K
from lanternsift.operators import linear as L
from lanternsift.operators import metrics as M
from lanternsift.operators import scanner
from lanternsift.operators import tokens as N
from lanternsift.operators import transforms as R
from lanternsift.plans.queries import queries
from lanternsift.sources import readers as S

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name,key", [("d_phone_spans", "phone_us"), ("d_card_spans", "credit_card"), ("d_ipv4_spans", "ip_address")])
def test_spans_equal_a_plain_search(spark, name, key):
    pattern = scanner.python_pattern(scanner.REGISTRY[key].pattern)
    docs = documents(spark)
    want = sorted((i, m.start(), m.end(), m[0]) for i, r in docs.items() for m in pattern.finditer(r["text"] or "") if scanner.CHECKS[key](r["text"], m, 2024) is not None)
    got = sorted((r["doc_id"], r["start"], r["end"], r["text"]) for r in queries()[name](spark, SF).collect())
    assert got == want and want


def _names(text):
    w = [re.sub("[0-9]", "0", t.lower().replace("’", "'")) for t in re.findall(r"[a-zA-Z][a-zA-Z0-9’'_-]{0,39}|[0-9]+(?:[/.:-][0-9]+){0,5}", text)]
    out = {f"u:{x}" for x in w} | {f"b:{a}|{b}" for a, b in zip(w, w[1:])}
    plain = [p for p in (re.sub("[^0-9a-z]+", "", x) for x in w) if re.fullmatch("[a-z]{6,}", p)]
    out |= {f"p:{x[:5]}" for x in plain} | {f"s:{x[-5:]}" for x in plain}
    out |= {f"r:{n}" for n, p in K.SHAPES.items() if re.search(p, text)}
    return out | {f"m:length:{min(20, int(np.floor(np.log2(max(len(text), 1) + 1e-9))))}"}


def test_hashed_features_equal_zlib(spark):
    want = {i: ",".join(map(str, sorted({zlib.crc32(n.encode()) & K.BUCKETS - 1 for n in _names(r["text"] or "")}))) for i, r in documents(spark).items()}
    assert {r["doc_id"]: r["features"] for r in queries()["f_hashed"](spark, SF).collect()} == want


def test_profiles_are_read_windows(spark):
    got = {(r["doc_id"], r["profile"]): r["features"] for r in queries()["f_profiles"](spark, SF).collect()}
    for i, r in documents(spark).items():
        for name, (chars, tokens, most) in K.PROFILES.items():
            text = (r["text"] or "")[:chars]
            cut = [m.end() for m in re.finditer(r"[a-zA-Z][a-zA-Z0-9’'_-]{0,39}|[0-9]+(?:[/.:-][0-9]+){0,5}", text)]
            if len(cut) > tokens:
                continue
            ids = sorted({zlib.crc32(n.encode()) & K.BUCKETS - 1 for n in _names(text)})
            ids = [ids[int(k * (len(ids) / most))] for k in range(most)] if len(ids) > most else ids
            assert got[i, name] == ",".join(map(str, ids))
    indptr, indices, keys = K.csr(K.hashed(K.feature_names(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string"))))
    assert list(keys) == [1, 2] and indptr[-1] == len(indices) and indptr[1] == 4


def test_crc_splits_equal_zlib(spark):
    docs = documents(spark)
    key = lambda i: f"{docs[i]['source']}::{i}".encode()
    for r in queries()["s_crc32_split"](spark, SF).collect():
        assert r["calibration"] == (zlib.crc32(key(r["doc_id"])) % 5 == 0) and r["salted"] == (zlib.crc32(b"fusion::" + key(r["doc_id"])) % 5 == 0)
    blank = C.digest_split(spark.createDataFrame([("x", None), ("y", "text")], "id string, text string"), fallback=F.col("id")).collect()
    assert [r["held"] for r in blank][0] == (zlib.crc32(b"x") % 10 == 0)


def test_ordinal_hash_wraps_like_unsigned_numbers(spark):
    ns = [0, 1, 2, 12345, 10**9, 2**40 + 7]
    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", C.ordinal_hash(F.col("n"), F.lit("c"), ["b", "c"]).alias("h")).select("n", "h", C.carve(F.col("h")).alias("a"), C.carve_again(F.col("h")).alias("b")).collect()
    for r in rows:
        h = r["n"] * C._GOLDEN % 2**64 ^ C.corpus_seed("c")
        assert (int(r["h"]), r["a"], r["b"]) == (h, h % 10_000 < 1500, ((h * C._REMIX % 2**64) >> 17) % 1000 < 200)


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["it's a test, ñandú 日本 🙂", "", None, "x " * 2000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", N.tokenised(F.col("text"), path).alias("t")).orderBy("i").collect()
    for r, t in zip(got, texts):
        e = tok.encode(t or "", add_special_tokens=False)
        assert [(x["id"], x["start"], x["end"]) for x in r["t"]] == [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]


def test_space_places(spark):
    texts = ["a b\u00a0c\u3000d\x1ce\u200bf", None, "", "\t\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", N.space_places(F.col("text")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [[i for i, c in enumerate(t or "") if c.isspace()] for t in texts]


def test_model_spans_are_checked_before_fusion(spark):
    from lanternsift.plans import api

    span = lambda kind, text, c: (kind, 0, len(text), text, c, "onnx/x")
    cases = [("CREDIT_CARD", "4111 1111 1111 1111", True), ("CREDIT_CARD", "4111 1111 1111 1112", False), ("SSN", "123 45 6789", True), ("SSN", "000 45 6789", False), ("IP_ADDRESS", " 10.0.0.1", True), ("IP_ADDRESS", "10.0.0", False),
             ("EMAIL", "a@b.c", True), ("EMAIL", "a.b@c", False), ("URL", "x:y", True), ("URL", "xy", False), ("MAC_ADDRESS", "00:1A:2b:3c:4d:5e", True), ("MAC_ADDRESS", "001A", False), ("USER_ID", "whatever", True)]
    rows = spark.createDataFrame([(i, "zzz", [span(k, t, 0.9), span("USER_ID", "low", 0.2)]) for i, (k, t, _) in enumerate(cases)], "i int, text string, s array<struct<type:string,start:int,end:int,text:string,confidence:double,detector:string>>")
    got = {r["i"]: [e["text"] for e in r["entities"]] for r in api.scan(rows, extra=F.col("s")).collect()}
    assert got == {i: [t] if ok else [] for i, (_, t, ok) in enumerate(cases)}
    every = {r["i"]: len(r["entities"]) for r in api.scan(rows, extra=F.col("s"), min_confidence=0.95, revalidate=False).collect()}
    assert set(every.values()) == {0}


def test_report_lines(spark):
    rows = spark.createDataFrame([("aa", 3, 0.5), ("b", 12, None)], "tag string, n int, recall double")
    got = [r["text"] for r in L.table_lines(rows, {"tag": (6, "s"), "n": (4, "%d"), "recall": (7, "%.2f")}, [F.col("tag")], "recall").orderBy("line").collect()]
    assert got == [f"{'tag':<6} {'n':>4} {'recall':>7}", f"{'aa':<6} {3:>4} {0.5:>7.2f} " + "#" * 20, f"{'b':<6} {12:>4} {'n/a':>7}"]


def test_gate_and_heads_learn(spark):
    draw = np.random.default_rng(2)
    rows = [(i, sorted(draw.choice(np.arange(2, 64), 6, replace=False).tolist() + [i % 2])) for i in range(400)]
    features = spark.createDataFrame(rows, "doc_id int, features array<int>")
    labels = spark.createDataFrame([(i, i % 2 == 1 if i < 300 else None, 1.0) for i in range(400)], "doc_id int, target boolean, weight double")
    w, b = L.fit_gate(features, labels, 64)
    assert w[1] > 0.5 > -0.5 > w[0] and all((w[f].sum() + b > 0) == (i % 2 == 1) for i, f in rows)
    tags = features.select("doc_id", F.lit("odd").alias("tag"), (F.col("doc_id") % 2 == 1).alias("gold"), (F.col("doc_id") < 200).alias("complete")).union(features.select("doc_id", F.lit("rare"), F.col("doc_id") < 3, F.lit(True)))
    heads = L.fit_heads(features, tags, 64)
    assert list(heads) == ["odd"] and heads["odd"][0][1] > 0
    weights, bias = L.weight_rows(spark, heads)
    scored = K.scores(features.select("doc_id", F.explode("features").alias("feature")), weights)
    hits = scored.join(bias, "tag").where("(total + bias > 0) = (doc_id % 2 = 1)").count()
    assert hits == 400


def test_low_rank(spark):
    w = np.random.default_rng(4).standard_normal((5, 30))
    e, h = L.low_rank(w, 5)
    assert np.allclose(h @ e.T, np.maximum(w, 0)) and e.shape == (30, 5)
    e2, h2 = L.low_rank(w, 2)
    best = np.linalg.svd(np.maximum(w, 0), compute_uv=False)
    assert np.linalg.norm(np.maximum(w, 0) - h2 @ e2.T) == pytest.approx(np.sqrt((best[2:] ** 2).sum()))
    with pytest.raises(ValueError):
        L.low_rank(w, 6)


def test_searches_repeat():
    assert len(R.trials({"a": [1, 2], "b": "xyz"})) == 6 and R.trials({"a": [1, 2], "b": "xyz"}, 3, 1) == R.trials({"a": [1, 2], "b": "xyz"}, 3, 1)
    ranked = {"t": ["p", "q", "r"], "u": ["q", "p", "r"], "v": ["r", "q", "p"]}
    made = R.mixtures(ranked, 9, 5, {"v": "fixed"})
    assert made == R.mixtures(ranked, 9, 5, {"v": "fixed"}) and len({tuple(sorted(m.items())) for m in made}) == len(made) == 9 and all(m["v"] == "fixed" for m in made)
    assert made[0] == {"t": "p", "u": "q", "v": "fixed"} and len(R.mixtures(ranked, 500, 5)) == 27


def test_partial_match_takes_one_of_equal_predictions(spark):
    cols = "doc_id int, type string, start int, end int"
    gold, pred = spark.createDataFrame([(1, "A", 0, 5), (1, "A", 5, 10), (2, "B", 0, 3)], cols), spark.createDataFrame([(1, "A", 3, 7), (1, "A", 3, 7), (3, "C", 0, 1)], cols)
    assert sorted(tuple(r) for r in M.partial_counts(gold, pred).collect()) == [("A", 2, 2, 0, 0), ("B", 1, 0, 0, 1), ("C", 0, 0, 1, 0)]


def test_text_readers(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n')
    with pytest.raises(ValueError, match=r"bad\.jsonl:3"):
        S.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int")
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in S.json_lines(spark, str(tmp_path / "good.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "raw.txt").write_bytes(b"caf\xe9 ok")
    assert S.text_files(spark, str(tmp_path / "raw.txt")).first()["text"] == "caf\ufffd ok"
    schema = "name string, pctwhite double, pctblack double"
    table = "name,pctwhite,pctblack\nMU\xd1OZ,3.5,(S)\n".encode("latin-1")
    (tmp_path / "names.csv").write_bytes(table)
    with zipfile.ZipFile(tmp_path / "names.zip", "w") as z:
        z.writestr("names.csv", table)
    for f in ("names.csv", "names.zip"):
        assert [tuple(r) for r in S.surname_shares(spark, str(tmp_path / f), schema).collect()] == [("MU\xd1OZ", 3.5, 0.0)]
    (tmp_path / "clean.csv").write_text('doc_id,kind\n7,"a, b"\n')
    assert S.clean_manifest(spark, str(tmp_path / "clean.csv")).first()["kind"] == "a, b"
    (tmp_path / "tags.csv").write_text("name,vertical\nDate of Birth (DOB),PII\n,\n")
    assert [r["tag"] for r in S.tag_catalogue(spark, str(tmp_path / "tags.csv")).collect()] == ["sensitive_pii_date_of_birth_dob"]


def test_file_readers(spark, tmp_path):
    body = zlib.compress(b"BT (Hello \\(you\\)) Tj [(wor) -20 (ld)] TJ ET")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\nstream\n" + body + b"\nendstream")
    (tmp_path / "d" / "b.bin").write_bytes(b"\x00\x01some words\x00\x02no\x00")
    (tmp_path / "d" / "c.pdf").write_bytes(b"not one")
    with zipfile.ZipFile(tmp_path / "d" / "e.docx", "w") as z:
        z.writestr("b.xml", "<t>two</t>")
        z.writestr("a.xml", "<t>one</t>")
    got = {r["path"].rsplit("/", 1)[1]: r for r in S.documents(spark, str(tmp_path / "d")).collect()}
    assert got["a.pdf"]["text"] == "Hello (you) world" and got["b.bin"]["text"] == "some words" and got["c.pdf"]["error"] == "ValueError" and got["e.docx"]["text"] == "one two"
    for n in ("10_pii_x_5k", "other_3k", "twin_1", "twin_2"):
        (tmp_path / "root" / n).mkdir(parents=True)
    root = str(tmp_path / "root")
    assert S.dataset_dirs(spark, root) == ["10_pii_x_5k", "other_3k", "twin_1", "twin_2"] and S.resolve_dataset(spark, root, "pii_x").endswith("10_pii_x_5k")
    with pytest.raises(FileNotFoundError):
        S.resolve_dataset(spark, root, "none")
    with pytest.raises(ValueError):
        S.resolve_dataset(spark, root, "twin")


def test_caches_models_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [1, 2]), ("b", 2, [3])], "corpus string, doc_id int, features array<int>")
    S.write_feature_cache(rows, str(tmp_path / "cache"))
    assert S.feature_cache(spark, str(tmp_path / "cache")).count() == 2 and S.feature_cache(spark, str(tmp_path / "cache"), ["b"]).first()["doc_id"] == 2
    weights, cuts = spark.createDataFrame([("t", 1, 0.5)], "tag string, feature int, w double"), spark.createDataFrame([("t", 0.1)], "tag string, threshold double")
    S.save_model(spark, str(tmp_path / "m"), "linear", {"weights": weights, "thresholds": cuts})
    model = S.weights_model(spark, str(tmp_path / "m"))
    assert model["weights"].collect() == weights.collect() and model["thresholds"].collect() == cuts.collect()
    S.save_model(spark, str(tmp_path / "n"), "odd", {})
    with pytest.raises(ValueError):
        S.weights_model(spark, str(tmp_path / "n"))
    S.write_jsonl(rows, str(tmp_path / "out"))
    assert S.json_lines(spark, str(tmp_path / "out"), "corpus string, doc_id int, features array<int>").exceptAll(rows).count() == 0
    (tmp_path / "runs.jsonl").write_text('{"run": "r1", "params": {"a": "1"}, "metrics": {"f": 0.5}}\n{"run": "r2", "metr')
    assert [tuple(r)[::2] for r in S.runs_of(spark, str(tmp_path / "runs.jsonl")).collect()] == [("r1", "f")]
    for split in ("train-0", "train-1", "test-0"):
        spark.createDataFrame([(split, 1)], "name string, other int").coalesce(1).write.parquet(str(tmp_path / "splits" / f"{split}.parquet"))
    assert sorted(r["name"] for r in S.parquet_split(spark, str(tmp_path / "splits"), "train", ["name"]).collect()) == ["train-0", "train-1"]


def test_package_verification(spark, tmp_path):
    import hashlib

    for name, content in (("a", b"1"), ("b", b"22"), ("c", b"333"), ("x", b"4")):
        (tmp_path / name).write_bytes(content)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a", digest(b"1"), 1), ("b", digest(b"no"), 2), ("c", digest(b"333"), 9), ("gone", "0", 1)], "file string, sha256 string, bytes long")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(tuple(r) for r in S.verify_package(files, manifest).collect()) == [("b", "digest"), ("c", "size"), ("gone", "missing"), ("x", "extra")]


def test_scores_equal_a_plain_sum(spark, monkeypatch):
    """Ids that come twice are one document, chunks are many, and sums are passed on in parts."""
    from lanternsift.operators import feature_text as T

    texts = [(1, "alpha beta gamma"), (1, "alpha beta"), (2, None), (3, "Beta-alpha’s 12/04 gamma gamma"), (4, "nothing known"), (None, "alpha")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for mode in (False, True):
        monkeypatch.setattr(T, "SUMMED", 2)
        monkeypatch.setattr(T, "HASHED", 2)
        vectors = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts]), pa.array([[1, i] for i in range(len(texts))], pa.list_(pa.int64()))], ["text", "v"])
        got = {}
        for b in (T.hashed_sums if mode else T.named_sums)(iter([vectors]), 2):
            for r in b.to_pylist():
                at = got.setdefault(r["feature"], [0, 0])
                at[0], at[1] = at[0] + r["s0"], at[1] + r["s1"]
        want = {}
        for i, (_, t) in enumerate(texts):
            for n in _names(t or ""):
                at = want.setdefault(n, [0, 0])
                at[0], at[1] = at[0] + 1, at[1] + i
        assert sorted(got.values()) == sorted(want.values()) and (mode or got == want)
    known = {"u:alpha": [1.5, -1.0], "u:gamma": [-0.5, 2.0], "b:alpha|beta": [0.25, 0.0], "u:beta": [2.0, 3.0], "u:delta": [9.0, 9.0]}
    weights = spark.createDataFrame([(h, known[n]) for n in known for h in [int(T.hash_of(n.encode()))]], "feature long, w array<double>")
    got = {(r["doc_id"], r["tag"]): (r["total"], r["mean"], r["top"]) for r in K.scores(docs, weights, ["a", "b"], k=2, chunk_bytes=80).collect()}
    want = {}
    for i in (1, 3):
        every = [n for d, t in texts if d == i for n in _names(t)]
        for j, tag in enumerate("ab"):
            w = [known[n][j] for n in every if n in known]
            want[i, tag] = (sum(w), sum(w) / len(every), sum(sorted((max(x, 0.0) for x in w), reverse=True)[:2]) / 2)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_tokens_come_in_bounded_batches(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(N, "TOKENS_HELD", 8)
    docs = spark.createDataFrame([(i, None if i == 3 else "one two three four " * (i % 5)) for i in range(40)], "i int, text string").coalesce(1)
    rows = N.tokenised_rows(docs, path, "i")
    want = {r["i"]: r["t"] for r in docs.select("i", N.tokenised(F.col("text"), path).alias("t")).collect()}
    assert {r["i"]: r["t"] for r in rows.collect()} == want and len(want) == 40


def test_a_batch_of_texts_is_never_held_as_strings():
    import tracemalloc

    texts = pa.array(["mail a@b.org " + "x" * 20_000] * 500)
    tracemalloc.start()
    found = scanner._each(lambda s: scanner.find(s, ["email"], False, 2024), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 500 and all(len(f) == 1 for f in found) and peak < texts.nbytes / 4


def test_bio_encode_spreads_tokens(spark):
    tokens = spark.range(4000).selectExpr("id div 8 AS doc_id", "id % 8 AS pos", "id % 8 * 5 AS start", "id % 8 * 5 + 4 AS end")
    spans = spark.range(500).selectExpr("id AS doc_id", "'NAME' AS type", "5 AS start", "14 AS end")
    labels = N.bio_encode(tokens, spans, tokens_each=100)
    assert labels.rdd.getNumPartitions() == 40
    assert {(r["doc_id"], r["pos"]): r["label"] for r in labels.collect()} == {(d, p): {1: "B-NAME", 2: "I-NAME"}.get(p, "O") for d in range(500) for p in range(8)}
