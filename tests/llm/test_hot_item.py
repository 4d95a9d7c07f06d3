"""Decontamination of an item that leaked into a third of the long documents."""

import random
import re

from lanternsift.llm import decontamination

SF = "/root/testdata/sf0.01"


def test_copies_of_a_hot_item_are_found(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hot = min(bench.collect(), key=lambda r: r["item_id"])
    docs, planted, long = [], set(), 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        w = (r["text"] or "").split()
        long += len(w) >= 100
        if len(w) >= 100 and long % 3 == 0:
            at = r["doc_id"] * 37 % len(w)
            w[at:at] = hot["text"].split()
            planted.add(r["doc_id"])
        docs.append((r["doc_id"], " ".join(w)))
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert planted <= {r["doc_id"] for r in found.where(f"item_id = {hot['item_id']}").collect()}


def test_paraphrases_are_found_and_clean_documents_are_not(spark):
    """Every item in four paraphrases, each in a document of its own: at least nine of ten are found, and nothing else."""
    draw = random.Random(5)
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    texts = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    held = {(i, k) for i, t in texts.items() for k, w in items.items() if " ".join(w) in " ".join(t)}
    plain = [t for i, t in sorted(texts.items()) if len(t) >= 100 and not any(i == j for j, _ in held)]
    vocabulary = [w for t in plain for w in t]
    swapped = lambda w: [x for a, b in zip(w[::2], w[1::2]) for x in ((a, b) if draw.random() < 0.5 else (b, a))]
    kinds = {
        "replaced": lambda w: [draw.choice(vocabulary) if draw.random() < 0.2 else x for x in w],
        "dropped": lambda w: [x for x in w if draw.random() >= 0.2],
        "swapped": swapped,
        "inserted": lambda w: [y for x in w for y in ((x, draw.choice(vocabulary)) if draw.random() < 0.2 else (x,))],
    }
    rows, want = [], {}
    for k, w in items.items():
        for name, change in kinds.items():
            t = list(plain[len(rows) % len(plain)])
            at = draw.randrange(len(t))
            t[at:at] = change(w)
            want[len(rows)] = (k, name)
            rows.append((len(rows), " ".join(t)))
    clean = [(10**6 + i, " ".join(t)) for i, t in enumerate(plain)]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark.createDataFrame(rows + clean, "doc_id long, text string"), bench).collect()}
    assert found <= {(i, k) for i, (k, _) in want.items()}
    for name in kinds:
        of = [(i, k) for i, (k, n) in want.items() if n == name]
        assert sum(p in found for p in of) >= 0.9 * len(of), name
