"""The corpus operators against brute force on small tables, edge rows included."""

import hashlib
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanternsift.llm import bpe, chat, components, decontamination, html_text, language_id, line_dedup, quality_classifier, quality_rules, simhash, substring_dedup
from lanternsift.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
WHITE = "[^\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, text_ string, drop string, fp string"
LINE = "A line that is long enough to count, indeed."
EDGE = [
    (1, None), (2, ""), (3, "one"), (4, "two words"), (5, f"{LINE}\nother\n{LINE}"), (6, f"  {LINE.upper()}\t\nx"), (7, f"{LINE}\n\n"), (8, LINE), (9, "ñandú çédille ß 日本語 🙂 " * 30),
    (10, "same text here and there, again and again, until it is long enough to be more than a hundred bytes, or so it seems. " * 3),
    (11, "same text here and there, again and again, until it is long enough to be more than a hundred bytes, or so it seems. " * 3),
    (12, "a b c " * 40000), (13, "x" * 300), (14, "\n" * 50), (15, "<|endoftext|> in a text, it's we'll <|startoftext|>x"), (16, "   tail"), (17, "é é ΑΣ İ"),
    (18, " ".join(f"w{i}" for i in range(200))), (18, " ".join(f"w{i}" for i in range(200))), (None, LINE), (None, None), (19, "!!! ??? ***"), (20, "|a|b|c|d|\n" * 20),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None, None, "k", "t", "d", "f") for i, t in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sql_queries(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, SF)
        want = con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
        assert got == sorted((tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()), key=repr), name


# --- line dedup


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    owner = {k: max(h, key=lambda i: (i is not None, i)) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in owner or owner[key(x)] == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, edge, empty, batches):
    got = line_dedup.dedup_lines(edge, batches=batches).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_hand(EDGE)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_are_compacted_and_settled_keys_are_not_added(spark):
    docs = spark.createDataFrame([(i, f"{LINE}\nunique line number {i} of all") for i in range(40)], "doc_id long, text string")
    runs, _ = line_dedup.build_runs(line_dedup.line_rows(docs), batches=7)
    assert len(runs.levels) > 1 and len(runs.paths) < 7
    stored = spark.read.parquet(*runs.paths)
    assert stored.count() <= 41 + 3 and runs.shared().count() == 1 and runs.shared().first()["owner"] == 39


# --- substring dedup


def removed_by_hand(rows, span):
    seen, order = {}, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = defaultdict(set)
    for i, t in order:
        raw = (t or "").encode()
        for a in range(len(raw) - span + 1):
            first = seen.setdefault(raw[a : a + span], (i, a))
            if first != (i, a):
                out[i].update(range(a, a + span))
    result = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = {x for x in out[i] if x < len(raw)}
        n = sum(1 for x in gone if x - 1 not in gone)
        kept = bytes(c for x, c in enumerate(raw) if x not in gone)
        result.append((i, len(raw), len(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=repr)


@pytest.mark.parametrize("change", [{}, {"HOT": 1}, {"GROUP": 1}, {"BATCH": 50, "BLOCK": 400}])
def test_substring_dedup(spark, edge, empty, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(substring_dedup, k, v)
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words, n))
    common = [text(40) for _ in range(4)]
    rows = [(int(i), text(12) + common[rng.integers(4)][int(rng.integers(20)) :] + text(12) + common[rng.integers(4)]) for i in rng.permutation(60)]
    rows += [(i, t) for i, t in EDGE if t is None or len(t) < 2000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(df)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == removed_by_hand(rows, 100)
    assert all(len(r["kept"]) + r["n_removed"] == r["n_bytes"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got.collect())
    if not change:
        assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.remove_repeats(edge).count() == len(EDGE)


@pytest.mark.parametrize("letters,span", [(1, 9), (2, 20), (3, 100), (200, 7)])
def test_suffix_ranks(letters, span):
    data = np.random.default_rng(letters).integers(97, 97 + letters, 700).astype(np.uint8)
    data[300:500] = data[50:250]
    raw = data.tobytes() + bytes(2 * span)
    order = sorted({raw[i : i + span] for i in range(len(data))})
    rank = substring_dedup.suffix_ranks(data, span)
    place = {w: k for k, w in enumerate(order)}
    dense = {r: k for k, r in enumerate(sorted(set(rank.tolist())))}
    assert [dense[r] for r in rank.tolist()] == [place[raw[i : i + span]] for i in range(len(data))]


# --- quality


def test_quality_rules(spark, edge, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(edge).collect()}
    for i, t in EDGE:
        words = re.findall(WHITE, t or "")
        grams = defaultdict(list)
        for k in range(len(words) - 2):
            grams[tuple(words[k : k + 3])].append(k)
        repeat = {k + d for v in grams.values() if len(v) > 1 for k in v for d in range(3)}
        spoken = [x for x in (t or "").split("\n") if re.search(WHITE, x)]
        r = got[i, len(words)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, words)), len(re.findall("[#*$%&|<>]", t or "")), len(spoken) - len(set(spoken)), len(repeat))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
    assert quality_rules.judge(empty).where("kept").count() == 0


def test_lines_fail_by_rule(spark):
    prose = "These are plain words in a plain sentence that says nothing much. " * 8
    rows = [(1, prose), (2, prose + "\nHome | About | Contact | Login"), (3, ("WIN!! NOW!! " * 20 + "\n") * 5), (4, prose + "\nAccept cookies now"), (5, prose + "\n" + "$$$ *** " * 300)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_lines_failed"] for i in range(1, 6)] == [0, 1, 5, 1, 1] and got[2]["clean_text"] == prose.rstrip("\n") and not got[5]["kept"]


def test_quality_classifier(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score(docs, labels.where("doc_id % 2 = 0"))
    assert got.count() == docs.count()
    held = got.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in held]) > 0.97
    assert all(r["kept"] for r in held if r["quality"] == 1)
    no_labels = labels.limit(0)
    assert quality_classifier.score(edge, no_labels).count() == len(EDGE)
    assert quality_classifier.score(empty, labels).count() == 0


def test_sparse_hosts_are_shrunk_more(spark):
    rows = [(i, "plain words only here", "en", "big") for i in range(200)] + [(300 + i, "*** $$$ !!!", "en", "big2") for i in range(200)] + [(600, "*** $$$ !!!", "en", "tiny"), (601, "*** $$$ !!!", "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 500, 3)], "doc_id long, quality int, toxic int")
    rate = {r["doc_id"]: r["path_rate"] for r in quality_classifier.score(docs, labels).collect()}
    assert rate[300] < rate[600] < rate[0]


# --- chat


def test_chat(spark, empty):
    schema = "conv_id long, turn long, role string, text string, speaker string"
    rows = [(1, 0, "system", "be kind", ""), (1, 1, "ann", "hi", ""), (1, 2, "bob", None, ""), (1, 3, "ann", "bye", ""), (None, None, None, "x", ""), (2, 0, "system", "only", ""), (3, 1, "a", "t", ""), (3, 1, "a", "t", "")]
    rows += [(4, i, "ab"[i % 2], f"turn {i}", "") for i in range(600)]
    got = chat.perspectives(spark.createDataFrame(rows, schema)).collect()
    by = {(r["conv_id"], r["speaker"], r["part"]): r for r in got}
    ann = by[1, "ann", 0]
    assert ann["rendered"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi", "bye"]
    assert [by[1, "bob", 0]["rendered"][m["start"] : m["end"]] for m in by[1, "bob", 0]["mask"]] == [""]
    assert by[None, "unknown", -1]["n_turns"] == 1 and by[3, "a", 0]["n_turns"] == 2 and not any(k[0] == 2 for k in by)
    parts = [by[4, "a", p] for p in range(3)]
    assert [p["first_char"] for p in parts] == [0, len(parts[0]["rendered"]), len(parts[0]["rendered"]) + len(parts[1]["rendered"])]
    assert chat.perspectives(spark.createDataFrame([], schema)).count() == 0


def test_turns_of_one_number_are_cut_into_pieces(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 7, "ab"[i % 2], f"t{i % 50}") for i in range(400)] + [(None, None, "a", "same")] * 90 + [(2, 1, "a", "x"), (2, 2, "b", "y")]
    df = spark.createDataFrame(rows, schema).repartition(5)
    whole, cut = chat.perspectives(df).collect(), chat.perspectives(df, part_rows=32).collect()
    assert all(r["n_turns"] <= 32 for r in cut) and {r["piece"] for r in whole} == {0}
    for r in whole:
        of = sorted((c for c in cut if (c["conv_id"], c["speaker"], c["part"]) == (r["conv_id"], r["speaker"], r["part"])), key=lambda c: c["piece"])
        assert "".join(c["rendered"] for c in of) == r["rendered"] and [c["first_char"] for c in of] == [sum(len(x["rendered"]) for x in of[:k]) for k in range(len(of))]
        assert [(m["start"] + c["first_char"], m["end"] + c["first_char"]) for c in of for m in c["mask"]] == [tuple(m) for m in r["mask"]]


# --- html


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html as H

    for r, got in zip(pages.orderBy("page_id").collect(), html_text.extract_pages(pages).orderBy("page_id").collect()):
        body = re.search(r"(?s)<article>(.*)</article>", r["html"]).group(1)
        blocks = [" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got["text"] == "\n\n".join(b for b in blocks if b) and got["n_chars"] == len(got["text"])


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<nav>a</nav>", ""),
        ('<body><header><h1>Site</h1></header><div class="sidebar">x, y.</div><div id=main><h2>T</h2><p>Hello, world &amp; all.<p>Second, one.<ul><li>one<li>two</ul><div class=comments><p>nice!</p></div></div><footer>c</footer>', "T\n\nHello, world & all.\n\nSecond, one.\n\none\n\ntwo"),
        ("<article><header><h1>Title</h1></header><p>Text, of the page.</p><script>no()</script><form><p>mail</p></form></article>", "Title\n\nText, of the page."),
        ("<p>cut &am", "cut &am"), ("<div>" * 2000 + "deep, text." + "</div>" * 2000, "deep, text."),
        ('<main><p>A, b.</p><div role="navigation"><p>m</p></div><div hidden><p>h</p></div><div class="cookie-notice">c</div><p>D, e.</p></main>', "A, b.\n\nD, e."),
    ],
)
def test_html_cases(page, want):
    assert html_text.extract(page) == want


def test_html_blocks_by_hand():
    prose = "This is a sentence, and one more. " * 4
    links = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "Sport")) + "</ul>"
    p = f"<p>{prose}</p>"
    cases = [
        (f"<body><div>{links}</div><div>{p}{p}</div><div><p>Copyright 2020 Foo Inc.</p></div></body>", [prose, prose]),
        (f'<div class="top"><a>One</a><a>Two</a></div><div>{p}</div>', [prose]),
        (f'<article><h1>T</h1>{p}<div class="related-work"><p>Kept.</p></div><div class="share-price"><p>Kept, 5.</p></div><p id="social-history">Kept too.</p></article>', ["T", prose, "Kept.", "Kept, 5.", "Kept too."]),
        (f"<div><h2>Head</h2>{p}<ul><li>a thing</li><li>more of it</li></ul>{links}</div>", ["Head", prose, "a thing", "more of it"]),
        (f"<main>{p}<section id=comments>{p}</section><div class='comment-list'>{p}</div><aside>{p}</aside><p hidden>x</p></main>", [prose]),
        (f"<div><div>{p}{p}</div><div><p>Short one.</p></div><div>{p}{p}</div></div>", [prose, prose, "Short one.", prose, prose]),
        (f"<div>{'<div>' * 3000}{p}<nav>menu, of things.</nav>{'</div>' * 3000}</div>", [prose]),
        ("<a href=/>Only</a> <a href=/x>links</a>", []), ("x < y & z &lt;b&gt; <3", ["x < y & z <b> <3"]), ("<p>a<!-- never closed <p>b", ["a"]), ("<p>a<script>b</p>", ["a"]), ('<p title="a>b">c</p>', ["c"]),
    ]
    for page, want in cases:
        assert html_text.extract(page).split("\n\n") == ([" ".join(w.split()) for w in want] or [""]), page[:80]


def test_html_hostile_pages_are_linear():
    import time

    for page in ("<a " * 200_000, "<!--" * 150_000, "<div>" * 100_000, "<i>" * 40_000 + "<hr>" * 40_000, "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000, "<table>" + "<tr><td>" * 40_000, "<ul><li>" + "<p><i>" * 40_000, '<a href="' * 50_000, "<" * 200_000, "</x>" * 100_000, "&" * 200_000):
        t = time.perf_counter()
        html_text.extract(page)
        assert time.perf_counter() - t < 6, page[:12]


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, key string"
    rows = [(1, "u", "<p>A, b.</p>", "t", 0, "k"), (1, "u", "<p>A, b.</p>", "t", 0, "k"), (None, None, None, None, None, None), (2, "v", "", "t", 1, "k")]
    got = sorted(map(tuple, html_text.extract_pages(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, "u", "A, b.", 5), (1, "u", "A, b.", 5), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_text.extract_pages(spark.createDataFrame([], schema)).count() == 0


# --- BPE


def test_bpe(spark, edge, empty, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in EDGE:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids, tok.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, bpe.encode(edge, tokenizer_path()).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_bpe_blocks_and_small_tables(spark):
    import pyarrow as pa

    texts = [t for _, t in EDGE if t] + ["a b c d " * 400]
    whole = lambda **k: pa.Table.from_batches(bpe.encode_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "_text"])]), tokenizer_path(), ["doc_id"], True, True, **k)).to_pylist()
    assert whole(block=64) == whole()
    table = bpe.WordTable(tokenizer_path(), limit=3)
    flat, counts, _ = table.look_up(["some", "words", "here", "now"])
    assert len(flat) == counts.sum() and len(counts) == 4


# --- language


def test_language_held_out(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, per_lang=120)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language_id.identify(edge, model).collect()}
    assert len(odd) == len({i for i, _ in EDGE}) and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 14, 19))
    assert language_id.identify(empty).count() == 0
    one = spark.createDataFrame([(i, "some words", "en") for i in range(9)] + [(99, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(one).collect()} == {"en", "und"}


def test_long_texts_are_read_in_blocks(monkeypatch):
    import pyarrow as pa

    table = np.random.default_rng(0).standard_normal((1 << language_id.BITS, 3)).astype(np.float32)
    texts = pa.array(["short", "a longer text of words " * 200, "", None, "x"])
    whole = language_id.means(texts, table)
    monkeypatch.setattr(language_id, "BLOCK", 64)
    assert np.allclose(whole, language_id.means(texts, table), atol=1e-5)


# --- decontamination


def test_decontamination(spark, edge, empty):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda s: " " + " ".join(re.findall(r"[^\W_]+", (s or "").lower())) + " "
    held = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    want = {(i, b["item_id"]) for b in bench.collect() for i, t in held if norm(b["text"]) in t}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()} == want and want
    item = bench.first()["text"].split()
    planted = [w for k, w in enumerate(item) if k % 9]  # a paraphrase that drops every ninth word
    extra = spark.createDataFrame([(10**6, "some other words before " * 9 + " ".join(planted) + " and some after it " * 9), (None, " ".join(item)), (10**6 + 1, " ".join(sorted(item)))], "doc_id long, text string")
    rows = decontamination.leaks(docs.select("doc_id", "text").union(extra), bench.limit(1)).collect()
    assert {None, 10**6} <= {r["doc_id"] for r in rows} and 10**6 + 1 not in {r["doc_id"] for r in rows}
    assert decontamination.leaks(edge, bench).count() == 0 and decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "too short")], "item_id long, text string")
    assert decontamination.leaks(docs, odd).count() == 0
    split = decontamination.leaks(docs, bench, passages=7, vocabulary=300)  # many blocks, several readings, items in two blocks
    assert {(r["doc_id"], r["item_id"]) for r in split.collect()} == want


def test_lcs():
    assert decontamination._lcs([1, 2, 3, 4, 9], np.array([1, 3, 4, 5])) == 3 and decontamination._lcs([], np.array([1])) == 0


# --- SimHash


def fingerprint_by_hand(text):
    w = re.findall(WHITE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(prints, radius):
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in prints}


def test_simhash(spark, edge, empty):
    got = simhash.near_duplicates(edge).collect()
    prints = {t: fingerprint_by_hand(t) for _, t in EDGE}
    groups = groups_by_hand(sorted(set(prints.values())), 2)
    least = defaultdict(list)
    for i, t in EDGE:
        least[groups[prints[t]]] += [i] if i is not None else []
    want = sorted(((i, f"{prints[t]:016x}", min(least[groups[prints[t]]], default=None)) for i, t in EDGE), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.representatives(edge).collect()]
    assert len(kept) == len(set(kept)) == len({c for _, _, c in want})


@pytest.mark.parametrize("radius,small", [(2, 64), (2, 1), (4, 64), (4, 2)])
def test_no_link_is_lost(spark, monkeypatch, radius, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(radius + small)
    prints = set()
    for b in rng.integers(0, 2**63, 25, dtype=np.uint64).tolist():
        prints.add(b)
        for _ in range(3):
            x = b
            for i in rng.choice(64, rng.integers(1, radius + 2), replace=False):
                x ^= 1 << int(i)
            prints.add(x)
    signed = sorted(map(simhash._signed, prints))
    want = groups_by_hand(signed, radius)
    got = {r["node"]: r["root"] for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius)).collect()}
    assert all(got.get(x, x) == want[x] for x in signed)


def test_masks_cover():
    from itertools import combinations

    masks = simhash.covering_masks(2)
    assert len(masks) == 7 and all(any(not m & (1 << a | 1 << b) for m in masks) for a, b in combinations(range(64), 2))


def test_components_of_a_long_chain(spark):
    n = 150
    got = components.components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 500)], "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(n + 1)}
