"""Exact substring dedup by prefix-free parsing.

A rolling hash of WINDOW bytes is taken at every byte; in each run of SPAN bytes the place of the least hash is a
trigger. Triggers depend on the bytes of the run alone, so equal runs have them at equal places, and all runs that
share a trigger make one phrase: the text from the first of these runs to the end of the last. A text is the sequence
of its phrases (the parse); the distinct phrases of the corpus are the dictionary. Two equal runs always lie at the
same place of phrases with the same trigger hash, so

1. occurrences of one dictionary phrase after its first in corpus order are repeated whole, however many there are;
2. a phrase whose trigger hash no other phrase has can't share a run with any other and is done;
3. the other dictionary phrases, read at their first occurrence only, are gathered by trigger, and the suffix array of
   their texts is built (Larsson and Sadakane, 2007: ranks by eight bytes, doubled and refined only where suffixes still
   tie, up to SPAN bytes). Suffixes of one rank are equal strings; the parse says where each occurs first, and put in its
   order all but the first of a rank are repeats.

Work on highly repetitive text is that of its dictionary. Rows for one trigger or run are cut to a bounded number in
each task before they are shuffled: later copies in a task are settled there, and a trigger that is frequent in a task
is spread by phrase, with one marker row for the other tasks. Phrases of such a crowd are compared run by run under
128-bit names instead of in one suffix array.

Defined cases: a null or empty text has no bytes and nothing is removed; texts shorter than SPAN are kept; rows that
share a doc_id are one place in corpus order: they don't repeat each other, and what is removed in one is removed in
all; a null doc_id comes before all others; an empty table gives an empty result; a very long text is parsed in
overlapping blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.llm.common import settle, slim

SPAN = 100
WINDOW = 32
#: Bytes that are hashed at a time; bounds a worker's memory for any text.
BLOCK = 1 << 20
#: Rows of one trigger that a task sends before it spreads the rest by phrase.
HOT = 16
#: Rows under one trigger that are compared together; the phrases of a larger crowd are compared run by run.
GROUP = 4096
#: Phrases of a task that are looked through together for copies.
BATCH = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
PLAIN, COPY, SPREAD, MARK = 0, 1, 2, 3


def _mix(a: np.ndarray, b: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Name of a pair of names; not linear, so no family of texts collides by construction."""
    x = a * _M1
    x ^= x >> np.uint64(29)
    x += b
    x ^= salt
    x *= _M2
    x ^= x >> np.uint64(32)
    x *= _M3
    x ^= x >> np.uint64(28)
    return x


def _names(data: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Names of all substrings of the length by doubling: equal names for equal substrings."""
    salt_ = np.uint64(salt)
    at = _mix(data.astype(np.uint64) + np.uint64(1), np.zeros(1, np.uint64), salt_)
    size, out, done = 1, None, 0
    while True:
        if length & size:
            n = len(data) - (done + size) + 1
            out = at[:n].copy() if out is None else _mix(out[:n], at[done : done + n], salt_ + np.uint64(done))
            done += size
        if done == length:
            return out
        n = len(data) - 2 * size + 1
        at = _mix(at[:n], at[size : size + n], salt_ + np.uint64(size))
        size *= 2


def parse(data: np.ndarray, valid: np.ndarray, span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a block: trigger name, phrase name, first start of a run, number of runs. valid: starts of runs that count."""
    grams = _names(data, window, 0x51)
    wide = span - window + 1
    keys = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    best, size = keys, 1
    while size < wide:  # least key of every wide places, by doubling
        step = min(size, wide - size)
        n = len(best) - step
        best = np.minimum(best[:n], best[step:])
        size += step
    starts = np.flatnonzero(valid)
    place = (best[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first = starts[head]
    count = np.diff(np.concatenate((head, [len(starts)])))
    # A phrase is named by its length and the names of the first and the last run: between them lies all of it.
    runs = _names(data, span, 0x77)
    name = _mix(runs[first], runs[first + count - 1], np.uint64(0x99)) + count.astype(np.uint64) * _M2
    return grams[place[head]], name, first, count


def _blocks(pieces: list[tuple[int | None, int, bytes]], span: int, window: int) -> tuple[np.ndarray, ...] | None:
    """Phrases of some pieces (doc_id, offset, bytes) at once: doc_id, is null, trigger, name, start, count."""
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    if len(data) < span:
        return None
    ends = np.cumsum(sizes)
    valid = np.arange(len(data) - span + 1) + span <= np.repeat(ends, sizes)[: len(data) - span + 1]
    if not valid.any():
        return None
    trigger, name, first, count = parse(data, valid, span, window)
    owner = np.searchsorted(ends, first, side="right")
    start = first - (ends - sizes)[owner] + np.array([p[1] for p in pieces], np.int64)[owner]
    ids = np.array([-1 if p[0] is None else p[0] for p in pieces], np.int64)[owner]
    return ids, np.array([p[0] is None for p in pieces])[owner], trigger, name, start, count


def _pieces(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[int | None, int, bytes]]:
    for b in batches:
        for id_, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for i in range(0, max(len(raw) - span + 1, 0), BLOCK):
                yield id_, i, raw[i : i + BLOCK + span - 1]


def _settle_task(trigger: np.ndarray, name: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one task's phrases: the routing key, the kind, and which hot triggers need a marker."""
    kind = np.zeros(len(trigger), np.int64)
    at = np.lexsort((order, name, trigger))
    t, p, o = trigger[at], name[at], order[at]
    head = np.concatenate(([True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])))
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    copy = o > o[lead]  # strictly later in corpus order than the first of this task
    kind[at[copy]] = COPY
    rest = at[~copy]
    heads = np.concatenate(([True], trigger[rest][1:] != trigger[rest][:-1])) if len(rest) else np.empty(0, bool)
    starts = np.flatnonzero(heads)
    sizes = np.diff(np.concatenate((starts, [len(rest)])))
    hot = sizes > HOT
    kind[rest[np.repeat(hot, sizes)]] = SPREAD
    key = np.where(kind == PLAIN, trigger, _mix(name, np.where(kind == COPY, order.astype(np.uint64), trigger), np.uint64(0x33)))
    return key, kind, trigger[rest[starts[hot]]] if len(rest) else trigger[:0]


def _flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, null, trigger, name, start, count = (np.concatenate(x) for x in zip(*held))
    # Corpus order as one number; rows of one doc_id at one start are one place.
    by = np.lexsort((start, ids, ~null))
    step = (ids[by][1:] != ids[by][:-1]) | (start[by][1:] != start[by][:-1]) | (null[by][1:] != null[by][:-1])
    rank = np.empty(len(ids), np.int64)
    rank[by] = np.cumsum(np.concatenate(([False], step)))
    key, kind, marks = _settle_task(trigger, name, rank)
    name = np.where(kind == COPY, np.uint64(0), name)  # settled: zeros compress away
    n = len(marks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((key, marks)).view(np.int64)),
            pa.array(np.concatenate((name, np.zeros(n, np.uint64))).view(np.int64)),
            pa.array(np.concatenate((ids, np.zeros(n, np.int64))), mask=np.concatenate((null, np.ones(n, bool)))),
            pa.array(np.concatenate((start << 12 | count << 2 | kind, np.full(n, MARK)))),
        ],
        ["key", "phrase", "doc_id", "meta"],
    )


def _parse_batches(batches: Iterator[pa.RecordBatch], span: int, window: int) -> Iterator[pa.RecordBatch]:
    pieces, size, held, phrases = [], 0, [], 0
    for piece in _pieces(batches, span):
        pieces.append(piece)
        size += len(piece[2])
        if size >= BLOCK:
            if (found := _blocks(pieces, span, window)) is not None:
                held.append(found)
                phrases += len(found[0])
            pieces, size = [], 0
            if phrases >= BATCH:
                yield _flush(held)
                held, phrases = [], 0
    if pieces and (found := _blocks(pieces, span, window)) is not None:
        held.append(found)
    if held:
        yield _flush(held)


def suffix_ranks(data: np.ndarray, span: int) -> np.ndarray:
    """For every place of data the rank of the suffix there by its first span bytes: equal ranks for equal bytes, in order.

    Bytes beyond the end count as zero. Suffixes are ranked by eight bytes and refined by doubling; a suffix that ties
    with no other keeps its rank, so work goes down to what repeats.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(span + 8, np.uint8)))
    first, width = np.zeros(n + span, np.uint64), min(8, span)
    for k in range(width):
        first = first << np.uint64(8) | padded[k : k + n + span].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + span, np.int64)
    head = np.flatnonzero(np.concatenate(([True], first[order][1:] != first[order][:-1])))
    size = np.diff(np.concatenate((head, [n + span])))
    rank[order] = np.repeat(head, size)
    tied = order[np.repeat(size > 1, size)]
    while width < span:
        step = min(width, span - width)
        tied = tied[tied + step < n + span]
        if not len(tied):
            break
        own, later = rank[tied], rank[tied + step]
        by = np.lexsort((later, own))
        tied, own, later = tied[by], own[by], later[by]
        new_own = np.concatenate(([True], own[1:] != own[:-1]))
        new = new_own | np.concatenate(([True], later[1:] != later[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate((head, [len(tied)])))
        group = np.flatnonzero(new_own)[np.cumsum(new_own) - 1]
        rank[tied] = own + np.repeat(head, size) - group
        tied = tied[np.repeat(size > 1, size)]
        width += step
    return rank[:n]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_offsets(sizes).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _open_rows(parts: list[tuple], span: int) -> Iterator[pa.RecordBatch]:
    """parts: doc_id, first start, number of runs, trigger key or None, bytes. Rows to be compared under a key.

    A phrase of a trigger goes as its text under it; those of a frequent trigger go run by run, each with the second
    half of its name under the first, and later copies in this batch are settled here.
    """
    n = np.array([p[2] for p in parts], np.int64)
    ids, starts = np.array([-1 if p[0] is None else p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    null, spread = np.array([p[0] is None for p in parts]), np.array([p[3] is None for p in parts])
    columns = ["key", "doc_id", "meta", "bytes"]
    if not spread.all():
        cold = np.flatnonzero(~spread)
        key = pa.array([parts[i][3] for i in cold], pa.int64())
        yield pa.RecordBatch.from_arrays([key, pa.array(ids[cold], mask=null[cold]), pa.array(starts[cold] << 2), pa.array([parts[i][4] for i in cold], pa.binary())], columns)
    if spread.any():
        hot = np.flatnonzero(spread)
        n = n[hot]
        data = np.frombuffer(b"".join(parts[i][4] for i in hot), np.uint8)
        first, within = _offsets(n + span - 1)[:-1], np.arange(n.sum()) - np.repeat(_offsets(n)[:-1], n)
        h1, h2 = (_names(data, span, salt)[np.repeat(first, n) + within] for salt in (0x1357, 0x2468))
        where, id_, null = np.repeat(starts[hot], n) + within, np.repeat(ids[hot], n), np.repeat(null[hot], n)
        later = _later(np.lexsort((where, id_, ~null, h2, h1)), (h1, h2), (id_, where, null))
        # A settled copy is routed by its own place, away from the others of its name.
        key = np.where(later, _mix(h1, where.astype(np.uint64) + id_.astype(np.uint64) * _M1, np.uint64(0x44)), h1)
        sizes = np.where(later, 0, 8)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(id_, mask=null), pa.array(where << 2 | 2 | later), _binary(h2[~later], sizes)], columns)


def _later(order: np.ndarray, same: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows of equal values lie after the first of them; order sorts by values and then by place. One place is one row."""
    out = np.zeros(len(order), bool)
    if len(order):
        fresh = np.zeros(len(order), bool)
        fresh[0] = True
        for x in same:
            fresh[1:] |= x[order][1:] != x[order][:-1]
        lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        for x in place:
            out[order] |= x[order] != x[lead]
    return out


def _runs_of(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for b in batches:
        for id_, text, open_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for p in open_:
                start = p["meta"] >> 12
                # Phrases of rows that share a doc_id may come from a longer text than this one.
                count = min(p["meta"] >> 2 & 1023, len(raw) - span - start + 1)
                if count > 0:
                    parts.append((id_, start, count, p["key"], raw[start : start + count + span - 1]))
                    size += count
                if size >= BATCH:
                    yield from _open_rows(parts, span)
                    parts, size = [], 0
    if parts:
        yield from _open_rows(parts, span)


def _repeats(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> removed intervals, as doc_id and start << 20 | length.

    Whole keys are taken together up to BATCH bytes: a key has the texts of GROUP phrases at most, or the one run of a name.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if cut:
            yield from _repeats_of(table.slice(0, cut), span)
            held = table.slice(cut).to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield from _repeats_of(pa.Table.from_batches(held), span)


def _repeats_of(table: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
    key, meta = table["key"].to_numpy(), table["meta"].to_numpy()
    null = table["doc_id"].is_null().to_numpy()
    ids = table["doc_id"].fill_null(-1).to_numpy()
    start, kind = meta >> 2, meta & 3
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.flatnonzero(kind == 3), start[kind == 3], np.full((kind == 3).sum(), span))]
    named = np.flatnonzero(kind == 2)
    if len(named):
        name = np.frombuffer(b"".join(table["bytes"].take(pa.array(named)).to_pylist()), np.uint64)
        order = np.lexsort((start[named], ids[named], ~null[named], name, key[named]))
        gone = named[_later(order, (key[named], name), (ids[named], start[named], null[named]))]
        found.append((gone, start[gone], np.full(len(gone), span)))
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        texts = table["bytes"].take(pa.array(rows)).to_pylist()
        sizes = np.array(list(map(len, texts)), np.int64)
        runs = sizes - span + 1
        within = np.arange(runs.sum()) - np.repeat(_offsets(runs)[:-1], runs)
        rank = suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), span)[np.repeat(_offsets(sizes)[:-1], runs) + within]
        of = np.repeat(rows, runs)
        where = start[of] + within
        later = _later(np.lexsort((where, ids[of], ~null[of], rank)), (rank,), (ids[of], where, null[of]))
        # Neighbouring repeated runs of a phrase are one interval.
        edge = np.diff(np.concatenate(([0], later.astype(np.int8), [0])))
        first = np.concatenate(([False], of[1:] != of[:-1], [False]))
        opens = np.flatnonzero((edge == 1) | (first & np.concatenate((later, [False])) & np.concatenate(([False], later))))
        closes = np.flatnonzero((edge == -1) | (first & np.concatenate((later, [False])) & np.concatenate(([False], later))))
        found.append((of[opens], where[opens], closes - opens + span - 1))
    at, begin, length = (np.concatenate(x) for x in zip(*found))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at], mask=null[at]), pa.array(begin << 20 | length)], ["doc_id", "gone"])


def _spans(where: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals; touching intervals are one run."""
    order = np.argsort(where, kind="stable")
    where, ends = where[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], where[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(where) - 1]))
    return list(zip(where[fresh].tolist(), ends[last].tolist()))


def _cut(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, marks in zip(b.column(1), b.column(2)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            spans, kept, last = [], [], 0
            if marks.is_valid and len(marks):
                meta = marks.values.to_numpy(zero_copy_only=False)
                starts = meta >> 20
                spans = [(s, min(e, len(raw))) for s, e in _spans(starts, starts + (meta & 0xFFFFF)) if s < len(raw)]
            for s, e in spans:
                kept.append(raw[last:s])
                last = e
            kept.append(raw[last:])
            left = b"".join(kept)
            rows.append((len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(left).hexdigest(), left if full else None, spans))
        columns = [b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string())))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if full:
            columns += [pa.array([r[4] for r in rows], pa.binary()), pa.array([[{"start": s, "end": e} for s, e in r[5]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names += ["kept", "spans"]
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, span: int = SPAN, window: int = WINDOW, full: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with full also the kept bytes and the removed spans."""
    if not 0 < window <= span < 1024:
        raise ValueError("0 < window <= span < 1024")
    base = slim(docs, "doc_id", "text")
    base = base.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    phrases = base.mapInArrow(lambda it: _parse_batches(it, span, window), "key bigint, phrase bigint, doc_id bigint, meta bigint")
    # One shuffle and one sort by (key, phrase, corpus order). A trigger has HOT + 1 rows a task at most, and they spill.
    order = [F.col("doc_id").asc_nulls_first(), F.col("meta")]
    by_phrase = Window.partitionBy("key", "phrase").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy("key").orderBy("phrase", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind, start, count = F.col("meta").bitwiseAND(3), F.shiftright("meta", 12), F.shiftright("meta", 2).bitwiseAND(1023)
    ranked = (
        phrases.repartition("key")
        .withColumn("first", F.first(F.struct(F.col("doc_id").alias("d"), start.alias("s"))).over(by_phrase))
        .withColumn("company", F.first("phrase").over(by_key) != F.last("phrase").over(by_key))
        .withColumn("crowd", (F.max(kind).over(by_key) >= SPREAD) | (F.count(F.lit(1)).over(by_key) > GROUP))
        .where(kind != MARK)
    )
    later = ~(F.col("first.d").eqNullSafe(F.col("doc_id")) & (F.col("first.s") == start))
    gone = F.when((kind == COPY) | later, True).when((kind == SPREAD) | F.col("company"), False)
    found = ranked.select("doc_id", "meta", gone.alias("gone"), F.when(~gone & ~F.col("crowd"), F.col("key")).alias("key"))
    found = settle(found.where("gone IS NOT NULL"))

    opened = found.where("NOT gone").groupBy("doc_id").agg(F.collect_list(F.struct("meta", "key")).alias("open")).withColumnRenamed("doc_id", "at_id")
    opened = base.join(opened, F.col("doc_id").eqNullSafe(F.col("at_id"))).select("doc_id", "text", "open")
    rows = opened.mapInArrow(lambda it: _runs_of(it, span), "key bigint, doc_id bigint, meta bigint, bytes binary")
    marks = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _repeats(it, span), "doc_id bigint, gone bigint")
    whole = found.where("gone").select("doc_id", F.shiftleft(start, 20).bitwiseOR(count + (span - 1)).alias("gone"))
    marks = whole.union(marks).groupBy("doc_id").agg(F.collect_list("gone").alias("gone")).withColumnRenamed("doc_id", "mark_id")
    joined = base.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")), "left").select("doc_id", "text", "gone")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary, spans array<struct<start: bigint, end: bigint>>" if full else "")
    return joined.mapInArrow(lambda it: _cut(it, full), schema)
