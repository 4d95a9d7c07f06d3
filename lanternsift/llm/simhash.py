r"""SimHash near-dedup by covering locality-sensitive hashing (Pagh, SODA 2016).

A fingerprint is the bitwise majority of 64-bit hashes of word shingles. For radius r every bit position gets a vector
of r + 1 bits; the mask of a non-zero vector v keeps the positions whose vector has odd product with v. Any r positions
are all dropped by at least one of the 2^(r+1) - 1 masks, so each pair within the radius meets in some table: no link
is lost, whatever the data.

No table's pairs are emitted. A small bucket gives the links that connect it, one a fingerprint; the members of a large
one are expanded to the points half the radius away on the dropped positions, where those that belong together meet
(see links). A bucket of n fingerprints costs O(n) rows, hot or not.

Defined cases: a null or empty text has no words and fingerprint zero, and links like any other; a text of fewer words
than a shingle is one shingle; repeated rows share a fingerprint and so a component; null doc_ids take part and are
never the component's id unless it holds nothing else; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.llm.common import settle, slim, spread
from lanternsift.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Draws of position vectors that are tried for the masks.
DRAWS = 100
#: Fingerprints of a bucket that are compared in place; a larger bucket goes by points.
SMALL = 64
#: Rows over all tables that a task makes of its fingerprints.
ROWS_EACH = 4_000_000
#: Shingle hashes whose bits are counted at a time; bounds a worker's memory for any text.
BLOCK = 1 << 17


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; whatever radius positions differ, one mask keeps none of them.

    That holds for any vectors of the positions; of some fixed draws those are taken whose poorest mask keeps most.
    """
    n = 2 ** (radius + 1)
    draws = [[i % (n - 1) + 1 for i in range(bits)]] + [np.random.default_rng(seed).integers(1, n, bits).tolist() for seed in range(DRAWS)]
    masks = ([sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n)] for vectors in draws)
    return max(masks, key=lambda found: min(m.bit_count() for m in found))


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        if words:
            yield np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for i in range(0, len(words) - shingle + 1, BLOCK):
        pairs = zip(starts[i : i + BLOCK].tolist(), ends[i + shingle - 1 : i + BLOCK + shingle - 1].tolist())
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    total, counts = 0, np.zeros(64, np.int64)
    for h in _hashes(text, shingle):
        total += len(h)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _pairs_within(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Buckets of SMALL fingerprints at most -> links that connect those of a bucket that the radius connects."""
    for b in batches:
        u, v = [], []
        for fps in b.column(0):
            x = np.sort(fps.values.to_numpy(zero_copy_only=False))
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            left = np.ones(len(x), bool)
            for i in range(len(x)):
                if not left[i]:
                    continue
                left[i], front = False, [i]
                while front:
                    new = np.flatnonzero(near[front.pop()] & left)
                    left[new] = False
                    front += new.tolist()
                    u += x[new].tolist()
                    v += [int(x[i])] * len(new)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _points_about(batches: Iterator[pa.RecordBatch], masks: list[int], flips: int) -> Iterator[pa.RecordBatch]:
    """fp and its points up to flips bits away on the positions that its table's mask drops."""
    sets = []
    for m in masks:
        drops = [1 << i for i in range(64) if not m >> i & 1]
        sets.append(np.array([sum(c) for k in range(flips + 1) for c in combinations(drops, k)], np.uint64).view(np.int64))
    for b in batches:
        for fp, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sets[t]), fp)), pa.array(sets[t] ^ np.int64(fp))], ["fp", "point"])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints: enough to connect all that the radius connects.

    Buckets of SMALL fingerprints at most are compared in place. The members of larger ones are expanded to the points
    half the radius away on the dropped positions: two fingerprints within the radius share such a point, two that
    share one are within it, and each point links its members to the least of them.
    """
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be even: points lie half of it away")
    masks, flips = covering_masks(radius), radius // 2
    table = lambda i, m: F.struct(F.lit(i).alias("t"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key"))
    rows = spread(prints, "fp", ROWS_EACH // len(masks)).select("fp", F.explode(F.array(*(table(i, m) for i, m in enumerate(masks)))).alias("k")).select("fp", "k.t", "k.key")
    busy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Members of busy buckets are few; both ways read them.
    members = settle(rows.join(busy.hint("merge"), "key"))
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    near = small.mapInArrow(lambda it: _pairs_within(it, radius), "u bigint, v bigint")
    points = members.where(F.col("n") > SMALL).select("fp", "t").mapInArrow(lambda it: _points_about(it, masks, flips), "fp bigint, point bigint")
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top").select("point", "v")
    far = points.join(least.hint("merge"), "point").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    return near.union(far).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (bigint of the 64 bits), fingerprint (16 hex digits), component_id: one row for each row of docs."""
    base = slim(docs, "doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    prints = settle(base.mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {kind}, fp bigint"))
    # One row for each distinct fingerprint: thousands of copies are one node, and a third of all rows is one too.
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(ids, "root").select("fp", "component_id")
    # The right side has one row a key; the adaptive skew join splits a fingerprint that many documents share.
    return prints.join(by_print, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each component: that of its id, and of repeated rows of this id the first by text."""
    return firsts(docs, near_duplicates(docs, shingle, radius))


def firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that groups (doc_id, component_id) names a component after; of repeated rows the first by text."""
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    stays = stays.select(F.col("doc_id").alias("_stays"), "_rows")
    kept = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_stays")))
    # Rows that share an id are rare: only they are ranked.
    once = kept.where("_rows = 1").select(*docs.columns)
    ranked = kept.where("_rows > 1").withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return once.unionByName(ranked.where("_rank = 1").select(*docs.columns))
