"""The pipeline and its near-copy stage against plain Python over all pairs."""

import hashlib
import random
import re
import struct

import corpus_pipeline
from test_llm import EDGE, SF, WHITE, docs_of, lines_by_hand

from lanternsift.llm import near_copies, quality_rules
from lanternsift.llm.queries import tokenizer_path


def _set(text):
    w = re.findall(WHITE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(zip(*(w[i:] for i in range(5)))) or frozenset([tuple(w)])


def _kept(rows, prints=None):
    """Ids that stay where all pairs of the similarity are linked, or those of them with a fingerprint within the radius."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))
    close = lambda a, b: prints is None or any(((x ^ y) & (1 << 64) - 1).bit_count() <= near_copies.RADIUS for x, y in zip(prints[a], prints[b]))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if 5 * (both := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - both) and (sets[a] == sets[b] or close(a, b)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def _planted():
    """Texts about the limit: copies with some words replaced, parts of texts, and texts that share most short runs only."""
    draw, rows = random.Random(5), []
    for k in range(40):
        w = [f"w{draw.randrange(30000)}" for _ in range(draw.choice((8, 40, 150, 600)))]
        rows.append(" ".join(w))
        for share in (0.01, 0.02, 0.03, 0.05):
            rows.append(" ".join(f"x{draw.randrange(30000)}" if draw.random() < share else x for x in w))
        rows.append(" ".join(w[: int(len(w) * draw.choice((0.7, 0.79, 0.8, 0.82, 0.9)))]))
        every = [x if i % 9 else f"y{draw.randrange(30000)}" for i, x in enumerate(w)]
        rows.append(" ".join(every))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_stage_equals_all_pairs_within_the_radius(spark, monkeypatch):
    documents = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for rows in (_planted(), documents):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = _kept(rows, [near_copies.word_prints(t) for _, t in rows])
        got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
        assert got == want
        # No document without a near copy goes, and few near copies stay: the planted ones lie about the limit.
        every = set(_kept(rows))
        assert every <= set(got) and len(set(got) - every) <= (0.1 if rows is not documents else 0.03) * (len(rows) - len(every))
        monkeypatch.setattr(near_copies, "SMALL", 1)
        by_points = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
        assert every <= by_points and len(by_points - set(got)) <= 0.05 * len(rows)
        monkeypatch.setattr(near_copies, "SMALL", 64)


def test_a_hot_group_of_different_near_copies(spark):
    """Three hundred texts that differ in a word each, in one bucket: by points, not by pairs."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w if k != i else f"x{i}" for k, w in enumerate(words))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["component_id"] for r in near_copies.near_copies(docs).collect()} == {0}


def _crowd(groups, seed=7):
    """Texts of the same words in other orders, so of the same fingerprints: one bucket of many groups of near copies.

    Each group is a chain of four texts, of which only neighbours reach the similarity for sure.
    """
    draw, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(120)]
    for _ in range(groups):
        w = draw.sample(words, len(words))
        for k in range(4):
            rows.append(" ".join(w))
            w[30 * k : 30 * k + 7] = reversed(w[30 * k : 30 * k + 7])
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_a_crowded_bucket_loses_no_link(spark, monkeypatch):
    """More than SMALL texts of one bucket whose least one is no near copy of most: all links between the others count."""
    rows = _crowd(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _kept(rows, [near_copies.word_prints(t) for _, t in rows])
    assert len(want) == 40 == len(_kept(rows))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want
    # In many chunks, and with every bucket treated as a large one, the result is that of all pairs again.
    monkeypatch.setattr(near_copies, "CHUNK", 40_000)
    monkeypatch.setattr(near_copies, "PILOTS", 2)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want
    monkeypatch.setattr(near_copies, "SMALL", 1)
    rows = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _kept(rows, [near_copies.word_prints(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_texts_of_one_set_keep_their_own_fingerprints(spark):
    """A round of words said once or often has one set of shingles; a near copy of either way of saying it is linked."""
    rows, draw = [], random.Random(3)
    for k in range(6):
        w = [f"w{k}x{i}" for i in range(100)]
        heavy = w + w[:20] * 30
        rows += [" ".join(w + w[:4]), " ".join(w * 2 + w[:4])]  # the same turn, once and twice
        for base in (w + w[:20], heavy):
            rows += [" ".join(base), " ".join(base[:50] + [f"y{k}"] + base[51:])]
        rows.append(" ".join(w[:20] * 30 + w + w[:20]))
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    want = _kept(rows, [near_copies.word_prints(t) for _, t in rows])
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_edge_rows_keep_their_groups(spark):
    rows = [(i, t) for i, t in EDGE]
    out = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    groups = {(r["doc_id"], r["component_id"]) for r in out.collect()}
    assert out.count() == len(rows) and {(1, 1), (2, 1), (14, 1), (None, 1), (10, 10), (11, 10), (18, 18), (None, 7), (8, 7), (7, 7), (6, 6)} <= groups


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from tokenizers import Tokenizer

    judged = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}  # compared with plain Python in test_llm
    rows = [(i, judged[i]["clean_text"]) for i in sorted(docs_of(spark)) if judged[i]["kept"]]
    rows = sorted((i, t) for i, _, _, t in lines_by_hand(rows))
    kept = set(_kept(rows, [near_copies.word_prints(t) for _, t in rows]))
    norm = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [i for i, t in rows if i in kept and not any(x in norm(t) for x in items)]
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in rows if i in set(want)}
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_tokens"], r["ids"], r["ids_sha256"]) for r in got] == [(i, len(ids[i]), ids[i], hashlib.sha256(struct.pack(f"<{len(ids[i])}I", *ids[i])).hexdigest()) for i in want]
