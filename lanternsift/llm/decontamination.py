"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set. Its items are cut into passages of PASSAGE words, and these taken in blocks of
PASSAGES, so what a task holds of it has a fixed bound, however many or long the items are. The texts are read once for
every VOCABULARY words of the benchmark; what is kept of them are the places of these words, the only ones that can match.
For a block

1. document frequencies over all documents give the TF-IDF weights;
2. a randomised SVD of the TF-IDF passages (Halko, Martinsson and Tropp, 2011) finds the latent space: every task
   multiplies its passages with the sketch and adds up its share of the product, the driver orthonormalises a matrix of
   the block's words by RANK;
3. windows of all documents are projected, and those with a large cosine to an item's passage become candidates, or
   with a large share of the passage's length, since a common item's words weigh little beside rare ones;
4. a candidate is confirmed by the longest common subsequence of words with the passage and by its answer: the share
   of the passage's TF-IDF weight, mostly in its rare words, that the window holds.

Defined cases: a null or empty text or item has no words and no match; an item of fewer than MIN_WORDS words is no
evidence and never matches; repeated items and rows match one by one (equal pairs are returned once); null ids stay
null; ids are whole numbers; other columns are left alone; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternsift.llm.common import discard, settle, shared_dir, slim

#: Passages of a block, and words of the benchmark for which the texts are read once.
PASSAGES = 1_024
VOCABULARY = 1_000_000
#: Words of a passage of an item; longer items are cut into several.
PASSAGE = 48
MIN_WORDS = 8
#: Words of a document window, and of the step between windows.
WINDOW, STEP = 64, 32
RANK = 256
OVERSAMPLE = 32
POWER = 1
MIN_COSINE = 0.35
MIN_LCS = 0.6
MIN_ANSWER = 0.5
#: Characters of text that are split at a time.
BLOCK_CHARS = 4_000_000
#: Passages or windows whose vectors are formed at a time.
GROUPS = 2048
#: Documents whose words are weighed at a time.
ROWS = 1000
SEED = 11


def split_words(texts: pa.Array) -> pa.LargeListArray:
    """Lower-case runs of letters and digits; edges may leave empty strings, which match nothing."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN]+")


class Block:
    """The passages of a block: their words, weights and latent vectors, and the limits of a match."""

    def __init__(self, passages: list[tuple[int | None, list[str]]], limits: tuple[float, float, float] = (MIN_COSINE, MIN_LCS, MIN_ANSWER)):
        self.limits = limits
        self.ids = sorted({i for i, _ in passages}, key=lambda i: (i is not None, i))
        at = {i: k for k, i in enumerate(self.ids)}
        self.owner = [at[i] for i, _ in passages]
        self.vocabulary = sorted({w for _, ws in passages for w in ws})
        place = {w: i for i, w in enumerate(self.vocabulary)}
        self.passages = [np.array([place[w] for w in ws], np.int32) for _, ws in passages]

    def among(self, words: dict[str, int]) -> None:
        """words: all words whose places are noted; of each, its number in this block or -1."""
        self.local = np.full(len(words), -1, np.int32)
        self.local[[words[w] for w in self.vocabulary]] = np.arange(len(self.vocabulary))

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.idf = np.log((n_docs + 1) / (df + 1.0)) + 1.0
        # No word is without weight: an item that leaked into many documents makes its own words common.
        self.weight = self.idf.astype(np.float32)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all passages end to end, and where each passage starts."""
        sizes = [len(p) for p in self.passages]
        return np.concatenate(self.passages), np.cumsum(sizes) - sizes

    def settle_space(self, basis: np.ndarray) -> None:
        """basis: words x RANK, orthonormal. Words become latent vectors, passages unit vectors."""
        self.latent = (basis * self.weight[:, None]).astype(np.float32)
        flat, starts = self.rows()
        full = np.add.reduceat(self.latent[flat], starts, axis=0)
        self.queries = full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
        self.norms = np.array([_norm(p, self.weight) for p in self.passages], np.float32)
        # What the space keeps of a passage; a window can't be expected to keep more.
        self.kept = np.linalg.norm(full, axis=1) / np.maximum(self.norms, 1e-9)
        self.answer = [{int(w): float(self.weight[w]) for w in np.unique(p)} for p in self.passages]


def _norm(words: np.ndarray, weight: np.ndarray) -> float:
    own, n = np.unique(words, return_counts=True)
    return float(np.sqrt(((weight[own] * n) ** 2).sum()))


def _places(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    """doc_id, steps between the places of known words, and the words; rows without any are left out."""
    known = pa.array(vocabulary, pa.large_string())
    for b in batches:
        texts = b.column(1)
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        groups = (np.cumsum(lengths) // BLOCK_CHARS).astype(np.int64)
        for g in np.unique(groups):
            rows = np.flatnonzero(groups == g)
            lo, n = int(rows[0]), len(rows)
            lists = split_words(texts.slice(lo, n))
            found = pc.index_in(lists.flatten(), value_set=known)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            bounds = lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            owner = np.searchsorted(bounds, at, side="right") - 1
            counts = np.bincount(owner, minlength=n)
            step = np.diff(at, prepend=0)
            first = np.cumsum(counts) - counts
            some = counts > 0
            step[first[some]] = at[first[some]] - bounds[:-1][some]
            words = found.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int32)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            out = pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.ListArray.from_arrays(offsets, pa.array(step.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(words))], ["doc_id", "steps", "words"])
            yield out.filter(pa.array(some))
        pa.default_memory_pool().release_unused()


def _flat(b: pa.RecordBatch, local: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and word of every known word of a batch, or of a block's words by their numbers in it."""
    steps, words = b.column(b.schema.get_field_index("steps")), b.column(b.schema.get_field_index("words"))
    bounds = steps.offsets.to_numpy() - steps.offsets[0].as_py()
    sizes = np.diff(bounds)
    total = np.cumsum(steps.flatten().to_numpy().astype(np.int64))
    before = np.concatenate(([0], total))[bounds[:-1]]
    row, place, word = np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(before, sizes), words.flatten().to_numpy()
    if local is None:
        return row, place, word
    word = local[word]
    own = word >= 0
    return row[own], place[own], word[own]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)
        pa.default_memory_pool().release_unused()


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for b in batches:
        row, _, word = _flat(b)
        df += np.bincount(np.unique(row * size + word) % size, minlength=size)
    some = np.flatnonzero(df)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["word", "df"])


def _windows(row: np.ndarray, place: np.ndarray, word: np.ndarray, width: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of word positions (indices) by window; every word is in width / step windows."""
    for shift in range(0, width, step):
        key = (row << 32) + (place + shift) // width
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        yield heads, np.diff(np.concatenate((heads, [len(key)])))


def _sketch(batches: Iterator[pa.RecordBatch], local: np.ndarray, weight: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's share of A' A S for unit TF-IDF passages A, as rows of word and vector."""
    total, touched = np.zeros_like(sketch, dtype=np.float64), np.zeros(len(weight), bool)
    for b in _slices(batches):
        row, place, word = _flat(b, local)
        if not len(word):
            continue
        heads, sizes = next(_windows(row, place, word, WINDOW, WINDOW))
        passage = np.repeat(np.arange(len(heads)), sizes)
        # Repeats of a word in a passage are summed by adding its row as often as it occurs.
        cells, count = np.unique(passage.astype(np.int64) * len(weight) + word, return_counts=True)
        norms = np.sqrt(np.bincount(cells // len(weight), (weight[cells % len(weight)] * count) ** 2, len(heads)))
        value = (weight[cells % len(weight)] * count / norms[cells // len(weight)]).astype(np.float32)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(cells // len(weight)) > 0)))
        for lo in range(0, len(starts), GROUPS):
            a = starts[lo]
            z = starts[lo + GROUPS] if lo + GROUPS < len(starts) else len(cells)
            w, v, p = cells[a:z] % len(weight), value[a:z], cells[a:z] // len(weight)
            y = _sums(sketch, w, v, starts[lo : lo + GROUPS] - a)
            order = np.argsort(w, kind="stable")
            w, v, p = w[order], v[order], (p - p[0])[order]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(w)]):
                total[w[i]] += v[i:j] @ y[p[i:j]]
            touched[w[first]] = True
    some = np.flatnonzero(touched)
    if len(some):
        yield _vectors(some, total[some])


def _sums(table: np.ndarray, word: np.ndarray, value: np.ndarray | None, heads: np.ndarray) -> np.ndarray:
    """Sums of table rows, by value, over the segments of word that begin at heads; segments are short, so place by place."""
    sizes = np.diff(np.concatenate((heads, [len(word)])))
    order = np.argsort(-sizes, kind="stable")
    at, left = heads[order], sizes[order]
    rows = table[word[at]] if value is None else table[word[at]] * value[at, None]
    for k in range(1, int(left[0])):
        n = int(np.searchsorted(-left, -k))  # the segments with more than k words
        more = table[word[at[:n] + k]]
        rows[:n] += more if value is None else more * value[at[:n] + k, None]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def _vectors(words: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], ["word", "v"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by word of the tasks' shares; a partition holds its words' sums alone."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for w, v in zip(b.column(0).to_pylist(), b.column(1)):
            row = np.frombuffer(v.as_buffer(), "<f4").astype(np.float64)
            total[w] = total[w] + row if w in total else row
    if total:
        yield _vectors(np.array(list(total), np.int64), np.array(list(total.values())))


def _lcs(a: list[int], b: np.ndarray) -> int:
    """Longest common subsequence, a bit-vector row at a time (Hyyrö 2004)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        m = masks.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(b) - row.bit_count()


def _search(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    min_cosine, min_lcs, min_answer = block.limits
    limit, square = min_cosine * block.kept, block.weight**2
    for b in _slices(batches):
        row, place, word = _flat(b, block.local)
        ids, out = b.column(0), []
        if not len(word):
            continue
        crow, cplace, cword = row, place, word
        lows = np.searchsorted(row, np.arange(len(ids)))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for shift, (heads, sizes) in zip(range(0, WINDOW, STEP), _windows(crow, cplace, cword, WINDOW, STEP)):
            for lo in range(0, len(heads), GROUPS):
                h, n = heads[lo : lo + GROUPS], sizes[lo : lo + GROUPS]
                a, z = h[0], h[-1] + n[-1]
                x = _sums(block.latent, cword[a:z], None, h - a)
                dot = x @ block.queries.T
                # A window's length is that of its distinct words at least; only where that may do are repeats counted.
                least = np.sqrt(np.add.reduceat(square[cword[a:z]], h - a))
                some = (dot >= limit * np.minimum(least[:, None] * 0.999, block.norms)).any(axis=1)
                window = np.repeat(np.arange(len(h)), n)
                own = some[window]
                cells, count = np.unique(window[own].astype(np.int64) * len(block.weight) + cword[a:z][own], return_counts=True)
                norm = np.sqrt(np.bincount(cells // len(block.weight), (block.weight[cells % len(block.weight)] * count) ** 2, len(h)))
                cosine = dot / np.where(some, norm, np.inf)[:, None]
                # Rare words beside a hot item are most of the window's length: as much of the passage's own length will do.
                for i, q in zip(*np.nonzero((cosine * np.maximum(norm[:, None] / block.norms, 1.0) >= limit) & some[:, None])):
                    r = int(crow[h[i]])
                    key = (r, block.owner[q])
                    own = block.passages[q]
                    start = (int(cplace[h[i]]) + shift) // WINDOW * WINDOW - shift - STEP
                    end = start + WINDOW + 2 * STEP
                    low = lows[r]
                    high = lows[r + 1] if r + 1 < len(ids) else len(row)
                    s, e = low + np.searchsorted(place[low:high], (start, end))
                    near = word[s:e]
                    have = set(near.tolist())
                    weights = block.answer[q]
                    answer = sum(v for w, v in weights.items() if w in have) / max(sum(weights.values()), 1e-9)
                    if answer < min_answer:
                        continue
                    lcs = _lcs(near.tolist(), own) / len(own)
                    if lcs >= min_lcs:
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (round(lcs, 6), round(answer, 6), round(float(cosine[i, q]), 4)))
        for (r, k), (lcs, answer, cosine) in best.items():
            out.append((ids[r].as_py(), block.ids[k], cosine, lcs, answer))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])], ["doc_id", "item_id", "cosine", "lcs", "answer"])


SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double"


def latent_space(places: DataFrame, block: Block, rank: int = RANK, power: int = POWER) -> np.ndarray:
    """Orthonormal basis (words x rank) of the leading right singular space of all TF-IDF passages, the block's included."""
    size = len(block.vocabulary)
    width = min(rank + OVERSAMPLE, size)
    basis = np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)
    weight = block.weight
    own = np.zeros((len(block.passages), size), np.float32) if size * len(block.passages) <= 1 << 26 else None
    rows = []
    for k, p in enumerate(block.passages):
        w, n = np.unique(p, return_counts=True)
        v = weight[w] * n
        v = v / max(float(np.linalg.norm(v)), 1e-9)
        rows.append((w, v))
        if own is not None:
            own[k, w] = v
    for _ in range(power + 1):
        product = np.zeros((size, width))
        shares = places.mapInArrow(lambda it, s=basis: _sketch(it, block.local, weight, s), "word bigint, v binary")
        for r in shares.repartition("word").mapInArrow(_add_up, "word bigint, v binary").collect():
            product[r["word"]] = np.frombuffer(r["v"], "<f4")
        n = max(float(np.abs(product).max()), 1.0)
        product /= n
        # The queries must lie in the space whatever the corpus looks like: their passages weigh as much as all others.
        if own is not None:
            product += own.T @ (own @ basis)
        else:
            for w, v in rows:
                product[w] += np.outer(v, v @ basis[w])
        basis = np.linalg.qr(product)[0].astype(np.float32)
    return basis[:, : min(rank, width)]


def _blocks(queries: DataFrame, most: int, limits: tuple[float, float, float]) -> Iterator[Block]:
    """Blocks of passages from items that come one partition at a time; the driver holds one block's."""
    held: list[tuple[int | None, list[str]]] = []
    for r in queries.toLocalIterator():
        words = [w for w in split_words(pa.array([r["text"]], pa.string()))[0].as_py() if w]
        if len(words) < MIN_WORDS:
            continue
        for part in np.array_split(np.arange(len(words)), max(1, round(len(words) / PASSAGE))):
            held.append((r["item_id"], [words[i] for i in part]))
            if len(held) >= most:
                yield Block(held, limits)
                held = []
    if held:
        yield Block(held, limits)


def _groups(blocks: Iterator[Block], most: int) -> Iterator[tuple[list[Block], dict[str, int]]]:
    """Blocks that share one reading of the texts, and the numbers of all their words."""
    group, words = [], {}
    for block in blocks:
        if group and len(words) + len(block.vocabulary) > most:
            yield group, words
            group, words = [], {}
        group.append(block)
        for w in block.vocabulary:
            words.setdefault(w, len(words))
    if group:
        yield group, words


def leaks(docs: DataFrame, benchmark: DataFrame, passages: int = PASSAGES, vocabulary: int = VOCABULARY, limits: tuple[float, float, float] = (MIN_COSINE, MIN_LCS, MIN_ANSWER)) -> DataFrame:
    """Pairs (doc_id, item_id) of contaminated documents and the items they hold, with the evidence; one row a pair."""
    spark: SparkSession = docs.sparkSession
    base = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    queries = slim(benchmark, "item_id", "text").select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    n_docs = base.count()
    found = []
    for group, words in _groups(_blocks(queries, passages, limits), vocabulary):
        known, size, path = list(words), len(words), shared_dir(spark)
        places = settle(base.mapInArrow(lambda it, v=known: _places(it, v), "doc_id bigint, steps array<int>, words array<int>"), path)
        df = np.zeros(size, np.int64)
        counted = places.mapInArrow(lambda it, n=size: _frequencies(it, n), "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
        df[counted["word"].to_numpy()] = counted["df"].to_numpy()
        for block in group:
            block.among(words)
            block.weigh(df[[words[w] for w in block.vocabulary]], n_docs)
            block.settle_space(latent_space(places, block))
            hits = places.mapInArrow(lambda it, b=block: _search(it, b), SCHEMA)
            found.append(settle(hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs", "answer")))))
        discard(spark, path)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    # An item that two blocks share has a row in each.
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs", "answer")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has no leak."""
    dirty = leaks(docs, benchmark).select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col("_dirty")), "left_anti")
