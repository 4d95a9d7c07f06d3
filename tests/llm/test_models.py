"""The quality classifier's shrinkage and the language machines' voting against plain Python."""

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from lanternsift.llm import language_id, quality_classifier

SF = "/root/testdata/sf0.001"


def _features(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").strip(" \t\n\x0b\f\r")) if w]
    n, chars = max(len(words), 1), max(len(text or ""), 1)
    t = text or ""
    return [
        len(re.findall(r"[#*$%&<>]", t)) / chars, t.count("!") / n, t.count("|") / n, sum(c.isupper() for c in t) / chars, len(re.findall("[0-9]", t)) / chars,
        len(set(words)) / n / n**-0.15, min(chars / n, 20.0), len(re.findall(r"[.!?](?=\s*(?:\n|$))", t)) / max(t.count("\n") + 1, 1), math.log1p(n),
    ]


def _fit(x, y):
    """Ridge logistic regression on standardised features, by plain gradient steps with backtracking."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    ridge = np.array([quality_classifier.RIDGE] * x.shape[1] + [1e-6])
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * (ridge * w * w).sum()
    w, step = np.zeros(z.shape[1]), 1.0
    for _ in range(200_000):
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) + ridge * w
        if np.abs(g).max() < 1e-7:
            break
        while loss(w - step * g) > loss(w) - 0.4 * step * (g @ g):
            step /= 2
        w, step = w - step * g, step * 1.5
    return lambda v: 1 / (1 + math.exp(-float(np.clip(((np.array(v) - mean) / scale) @ w[:-1] + w[-1], -30, 30))))


def test_quality_equals_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    votes = defaultdict(list)
    for r in labels.collect():
        votes[r["doc_id"]].append(r["quality"])
    good = {i: float(np.mean(v) >= 0.5) for i, v in votes.items()}
    x = {r["doc_id"]: _features(r["text"]) for r in rows}
    taught = sorted(i for i in good if i in x)
    p_of = _fit(np.array([x[i] for i in taught]), np.array([good[i] for i in taught]))
    low = quality_classifier.FLOOR
    p = {i: min(max(p_of(v), low), 1 - low) for i, v in x.items()}
    host, path = defaultdict(list), defaultdict(list)
    for r in rows:
        host[r["source"]].append(p[r["doc_id"]])
        path[r["source"], r["lang"]].append(p[r["doc_id"]])
    rate = np.mean(list(p.values()))

    def strength(groups, centre):
        top = bottom = 0.0
        for k, v in groups.items():
            if len(v) > 1:
                m = np.mean(v)
                top += (m - centre(k)) ** 2 * len(v) - m * (1 - m)
                bottom += len(v) - 1
        spread = top / bottom
        return float(np.clip(rate * (1 - rate) / spread - 1, *quality_classifier.STRENGTH)) if spread > 0 else quality_classifier.STRENGTH[1]

    m_host, m_path = strength(host, lambda k: rate), strength(path, lambda k: np.mean(host[k[0]]))
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    logit = lambda v: math.log(min(max(v, low), 1 - low) / (1 - min(max(v, low), 1 - low)))
    for r in rows:
        i, own = r["doc_id"], p[r["doc_id"]]
        h, q = host[r["source"]], path[r["source"], r["lang"]]
        host_rate = (sum(h) - own + m_host * rate) / (len(h) - 1 + m_host)
        path_rate = (sum(q) - own + m_path * host_rate) / (len(q) - 1 + m_path)
        score = 1 / (1 + math.exp(-(logit(own) + logit(path_rate) - logit(rate))))
        assert np.allclose([got[i]["evidence"], got[i]["host_rate"], got[i]["path_rate"], got[i]["score"]], [own, host_rate, path_rate, score], atol=2e-4), i
        assert got[i]["kept"] == (got[i]["score"] >= quality_classifier.KEEP_AT)


def test_repeated_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "plain words only here." if i % 2 else "*** $$$ !!!", "en", "s", 1.0, True, "x") for i in range(60)], "doc_id long, text string, lang string, source string, p double, good boolean, host string")
    labels = spark.createDataFrame([(i, q, 0, 1.0) for i in range(0, 40) for q in ((1, 1, 0) if i % 2 else (0, 0, 1))] + [(None, 1, 0, 1.0), (3, None, 0, 1.0)], "doc_id long, quality int, toxic int, score double")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, labels).collect()}
    assert got == {i: i % 2 == 1 for i in range(60)}


def _vote(names, pairs, margins):
    """One against one: a vote for each machine's side, ties by the sum of margins cut at one."""
    votes, sums, worst = defaultdict(int), defaultdict(float), defaultdict(lambda: math.inf)
    for (a, b), m in zip(pairs, margins):
        for name, side in ((a, m), (b, -m)):
            votes[name] += side > 0
            sums[name] += max(-1, min(1, side))
            worst[name] = min(worst[name], side)
    best = max(names, key=lambda n: (votes[n], sums[n]))
    return best, 1 / (1 + math.exp(-4 * max(-9, min(9, worst[best]))))


def test_decisions_equal_plain_votes():
    langs = ["ca", "de", "en", "es", "fr", "nl", "xx"]
    families = sorted({language_id.family(x) for x in langs})
    pairs = [("family", a, b) for k, a in enumerate(families) for b in families[k + 1 :]]
    pairs += [("lang", a, b) for f in families for k, a in enumerate(langs) for b in langs[k + 1 :] if language_id.family(a) == language_id.family(b) == f]
    margins = np.random.default_rng(3).normal(0, 1, (500, len(pairs)))
    got, score = language_id.decide(margins, {"langs": langs, "families": families, "pairs": pairs})
    for k, row in enumerate(margins):
        of = lambda kind, names: [((a, b), row[i]) for i, (what, a, b) in enumerate(pairs) if what == kind and a in names and b in names]
        top = of("family", families)
        family, sure = _vote(families, [p for p, _ in top], [m for _, m in top])
        inner = [x for x in langs if language_id.family(x) == family]
        rest = of("lang", inner)
        lang, own = _vote(inner, [p for p, _ in rest], [m for _, m in rest])
        assert got[k] == lang and math.isclose(score[k], sure * own, rel_tol=1e-9)


def test_machines_reach_the_least_loss():
    """The fitted machine's loss is within a thousandth of what long subgradient descent reaches."""
    draw = np.random.default_rng(5)
    x = draw.normal(0, 1, (80, 5)) + np.array([0.8, 0, 0, 0, 0]) * np.repeat([1, -1], 40)[:, None]
    y = np.repeat([1.0, -1.0], 40)
    scale = 1 / math.sqrt((x * x).sum(axis=1).mean())

    def loss(w, b):
        v = np.append(w / scale, b)
        return np.mean(np.maximum(0, 1 - y * (x @ w + b)) ** 2) + language_id.RIDGE / 2 * (v @ v)

    w, b = language_id.fit_machine(x, y)
    best = loss(w, b)
    z, v = np.column_stack((x * scale, np.ones(80))), np.zeros(6)
    for _ in range(40_000):
        slack = np.maximum(0, 1 - y * (z @ v))
        v -= 0.05 * (-2 * z.T @ (y * slack) / 80 + language_id.RIDGE * v)
    assert best <= loss(v[:-1] * scale, v[-1]) + 1e-3


def test_gram_means_equal_a_plain_count():
    table = np.random.default_rng(0).normal(0, 1, (1 << language_id.BITS, 2)).astype(np.float32)
    texts = ["Ab 1 cd!", "ÀÉ", "", None, "x y"]
    got = language_id.means(pa.array(texts), table)
    for t, row in zip(texts, got):
        bare = " " + " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())) + " "
        raw = (bare if bare.strip() else "  ").encode() + b"\0" * language_id.PAD
        three, four = language_id._grams(np.frombuffer(raw, np.uint8))
        n = len(raw) - language_id.PAD
        assert np.allclose(row, (table[three].sum(axis=0) + table[four].sum(axis=0)) / (2 * n), atol=1e-5)
