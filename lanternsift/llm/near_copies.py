"""Near copies by SimHash: covering tables give the candidates, exact similarity of five-word shingles the links.

A fingerprint of shingles is too far from that of a near copy: at a similarity of 0.8 about ten of 64 bits differ. So
a text has PRINTS fingerprints of its words, each weighted by the square root of how often it occurs, which keeps common
words from deciding: a replaced word changes one feature instead of five. Candidates are texts with any of these
fingerprints within RADIUS bits. The covering masks of the SimHash operator meet every such pair in some table, whatever
the data. Of the pairs of a similarity of 0.8 and more six prints of radius 2 met 94 % (README has the measurement), and no
document without such a partner is linked, since every candidate is compared shingle by shingle.

Equal sets of shingles are one node, however many rows hold them; it has every fingerprint of its texts. All pairs of a
bucket of SMALL nodes at most are compared. The members of a larger one are expanded to the points half the radius away
on the positions that its mask drops, where those that belong together meet, and each point links its members to the
least of them: n rows, not n^2. Two members may be near copies where neither is one of the least, so what these links
connect, confirmed or not, is a region, which holds every pair of a larger bucket that is within the radius. Members of
a region that confirmed links already connect need no more; all others are compared, chunk by chunk, so that no link
between two components is lost. The size of a bucket changes how its links are found, never which components come out.

Defined cases as in simhash: a text of fewer words than a shingle is one shingle, texts without words are copies of each
other, null doc_ids take part and are never the component's id unless it holds nothing else; extra columns are left
alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.llm.common import settle, slim, spread
from lanternsift.llm.components import components
from lanternsift.llm.simhash import _hashes, _points_about, _signed, covering_masks

SHINGLE = 5
#: Pairs count as near copies from NEAR / OF on.
NEAR, OF = 4, 5
#: Fingerprints of a text, and the bits in which one of them may differ.
PRINTS = 6
RADIUS = 2
#: Nodes of a bucket that are paired in place; a larger bucket goes by points.
SMALL = 64
#: Bytes of sets in a chunk of a region, and what a row of it counts beside its set; two chunks are a task's memory.
CHUNK = 32 << 20
ROW = 2048
#: Nodes of a region, about, that every chunk of it is compared with first: they join the parts of a large group.
PILOTS = 64
#: Bits of the filter that tells which sets are compared; a false positive costs a row.
FILTER = 1 << 22
#: Shingles of sets that are held at a time.
ROWS = 1 << 16
#: Distinct words whose bits are added up at a time; bounds a worker's memory for any text.
BLOCK = 1 << 14
#: Nodes of a task that spreads them over the tables.
NODES = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.arange(1, 65, dtype=np.uint64) * _M1


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    parts = list(_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def word_prints(text: str | None, prints: int = PRINTS) -> list[int]:
    """Fingerprints of the words; weights are whole numbers, so the order of addition is nothing."""
    from xxhash import xxh64_intdigest

    counts = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not counts:
        return [0] * prints
    total = np.zeros(64 * prints, np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, counts), np.uint64, len(counts))
    weight = np.rint(16 * np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))).astype(np.float32)
    for i in range(0, len(hashes), BLOCK):
        h, w = hashes[i : i + BLOCK], weight[i : i + BLOCK]
        for k in range(prints):
            x = (h + _SALTS[k : k + 1]) * _M2
            x ^= x >> np.uint64(29)
            x *= _M1
            x ^= x >> np.uint64(32)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total[64 * k : 64 * k + 64] += np.rint(w @ (2 * bits - 1)).astype(np.int64)
    packed = np.packbits(total > 0).tobytes()
    return [int.from_bytes(packed[8 * k : 8 * k + 8], "big", signed=True) for k in range(prints)]


def _set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(hashes.tobytes()))


def _nodes(batches: Iterator[pa.RecordBatch], shingle: int, prints: int) -> Iterator[pa.RecordBatch]:
    """doc_id, hash, the id and size of the set, and the fingerprints; equal texts of a task are read once for these.

    Texts of one set may count their words differently, so their fingerprints are their own.
    """
    seen: dict[int, list[int]] = {}
    for b in batches:
        ids, sizes, fps = [], [], []
        for t, key in zip(b.column(1), b.column(2).to_pylist()):
            text = t.as_py()
            hashes = shingle_set(text, shingle)
            ids.append(_set_id(hashes))
            sizes.append(len(hashes))
            if key not in seen:
                if len(seen) > ROWS:
                    seen.clear()
                seen[key] = word_prints(text, prints)
            fps.append(seen[key])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "hash", "set", "size", "fps"])


def _alike(nu: np.ndarray | int, nv: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity."""
    return OF * np.minimum(nu, nv) >= NEAR * np.maximum(nu, nv)


def _pairs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Small buckets of (fp, set, size) -> all pairs within the radius whose sizes can reach the similarity."""
    for b in batches:
        u, v = [], []
        members = b.column(0)
        bounds, rows = members.offsets.to_numpy(), members.flatten()
        fp, set_, size = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        bounds = bounds - bounds[0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            x, s, n = fp[lo:hi], set_[lo:hi], size[lo:hi]
            near = (np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius) & (s[:, None] < s[None, :]) & _alike(n[:, None], n[None, :])
            i, j = np.nonzero(near)
            u.append(s[i])
            v.append(s[j])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def _wanted(batches: Iterator[pa.RecordBatch], shingle: int, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose hash has its slot, once a task."""
    held, rows, seen = [], 0, set()
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([h.tobytes() for _, h in held], pa.binary())], ["set", "hashes"])
    for b in batches:
        for k in np.flatnonzero(slots[b.column(0).to_numpy() & FILTER - 1]).tolist():
            hashes = shingle_set(b.column(1)[k].as_py(), shingle)
            i = _set_id(hashes)
            if i in seen:
                continue
            if len(seen) > ROWS:
                seen.clear()
            seen.add(i)
            held.append((i, hashes))
            rows += len(hashes)
            if rows >= ROWS:
                yield batch()
                held, rows = [], 0
    if held:
        yield batch()


def _reach(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= NEAR * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = [], []
        for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            if _reach(*(np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))):
                u.append(i)
                v.append(j)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _across(rows: pa.Table, radius: int) -> pa.Table:
    """The rows of chunks a and b -> links that connect those of different roots that near copies among them connect.

    Sets that reach the similarity share one of their least hashes (prefix filtering); only sets that do are compared.
    """
    chunk, root, set_, size = (rows[c].to_numpy() for c in ("chunk", "root", "set", "size"))
    a, b = rows["a"][0].as_py(), rows["b"][0].as_py()
    fps = rows["fps"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(set_), -1)
    held = [np.frombuffer(h.as_buffer(), np.uint64) for c in rows["hashes"].chunks for h in c]
    least = [h[: len(h) - -(-NEAR * len(h) // OF) + 1] for h in held]
    label = np.unique(root, return_inverse=True)[1]
    left, right = sorted((np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)), key=len)
    of = np.repeat(right, [len(least[j]) for j in right])
    shared = np.concatenate([least[j] for j in right])
    order = np.argsort(shared)
    of, shared = of[order], shared[order]
    u, v = [], []
    for i in left:
        j = right[(label[right] != label[i]) & _alike(size[i], size[right])]
        j = j[(np.bitwise_count(fps[j] ^ fps[i]) <= radius).any(axis=1)]
        if not len(j):
            continue
        meets = np.zeros(len(set_), bool)
        for lo, hi in zip(np.searchsorted(shared, least[i]), np.searchsorted(shared, least[i], "right")):
            meets[of[lo:hi]] = True
        for k in j[meets[j]]:
            if label[k] != label[i] and _reach(held[i], held[k]):
                u.append(set_[i])
                v.append(set_[k])
                label[label == label[k]] = label[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def candidates(nodes: DataFrame, prints: int = PRINTS, radius: int = RADIUS) -> DataFrame:
    """nodes (set, size, fps) -> u, v, hub: pairs of sets that have one fingerprint within the radius of each other.

    Those of large buckets are links to hubs; they connect all that is within the radius there.
    """
    masks, flips = covering_masks(radius), radius // 2
    cell = lambda k, t, m: F.struct(
        F.lit(t).alias("t"), F.get("fps", F.lit(k)).alias("fp"), F.xxhash64(F.lit(k), F.lit(t), F.get("fps", F.lit(k)).bitwiseAND(F.lit(_signed(m)))).alias("key")
    )
    cells = F.explode(F.array(*(cell(k, t, m) for k in range(prints) for t, m in enumerate(masks)))).alias("c")
    rows = spread(nodes, "set", NODES).select("set", "size", cells).select("set", "size", "c.t", "c.fp", "c.key")
    # Only the members of buckets of two and more go on; they are few.
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    members = settle(counted)
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("fp", "set", "size")).alias("m")).select("m")
    near = small.mapInArrow(lambda it: _pairs(it, radius), "u bigint, v bigint")
    large = members.where(F.col("n") > SMALL)
    least = large.groupBy("fp").agg(F.min("set").alias("v"))
    # Many sets of one fingerprint are linked to the least of them, and the least ones of several by points.
    same = large.select("fp", F.col("set").alias("u")).distinct().join(least.hint("merge"), "fp").select("u", "v")
    spots = large.select("fp", "t").distinct().mapInArrow(lambda it: _points_about(it, masks, flips), "fp bigint, point bigint")
    points = spots.distinct().join(least.hint("merge"), "fp").select("point", F.col("v").alias("set"))
    centre = points.groupBy("point").agg(F.min("set").alias("v"), F.max("set").alias("top")).where("v < top").select("point", "v")
    far = points.join(centre.hint("merge"), "point").select(F.col("set").alias("u"), "v")
    hubs = same.union(far).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(True).alias("hub"))
    return near.select("u", "v", F.lit(False).alias("hub")).union(hubs).groupBy("u", "v").agg(F.max("hub").alias("hub"))


def shingles(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """texts (hash, text), candidates and nodes (set, hash) -> set, hashes of what the candidates are made of, settled.

    Only these texts are shingled again, and among them only these are shuffled.
    """
    named = pairs.select(F.col("u").alias("set")).union(pairs.select("v")).distinct()
    ends = nodes.join(named.hint("merge"), "set").select(F.col("hash").bitwiseAND(FILTER - 1).alias("slot")).distinct().toArrow()
    slots = np.zeros(FILTER, bool)
    slots[ends["slot"].to_numpy()] = True
    found = texts.mapInArrow(lambda it: _wanted(it, shingle, slots), "set bigint, hashes binary").join(named.hint("merge"), "set", "left_semi")
    return settle(found.groupBy("set").agg(F.first("hashes").alias("hashes")))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) of the candidates that reach the similarity."""
    half = pairs.join(sets.hint("merge"), F.col("u") == F.col("set")).select("u", "v", F.col("hashes").alias("x"))
    both = half.join(sets.hint("merge"), F.col("v") == F.col("set")).select("u", "v", "x", F.col("hashes").alias("y"))
    return both.mapInArrow(_confirmed, "u bigint, v bigint")


def _compared(members: DataFrame, apart: bool, sets: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """members (region, root, set, bytes) -> edges (u, v) between roots: of each chunk and the pilots, or of all chunks.

    A root larger than a chunk has chunks of its own, which needn't be compared with each other; the others share chunks.
    """
    parts = lambda total: F.ceil(total / F.lit(float(CHUNK)))
    whole = members.groupBy("region", "root").agg(F.sum("bytes").alias("own"))
    pure, region = F.col("own") > CHUNK, Window.partitionBy("region")
    shared = parts(F.sum(F.when(~pure, F.col("own"))).over(region))
    whole = whole.select("region", "root", F.when(pure, F.col("root")).alias("pure"), F.when(pure, parts(F.col("own"))).otherwise(shared).alias("parts"))
    part = F.pmod(F.when(F.col("pure").isNull(), F.xxhash64("root")).otherwise(F.xxhash64("set")), F.col("parts"))
    placed = settle(members.join(whole.hint("merge"), ["region", "root"]).select("region", "root", "set", "pure", F.xxhash64("region", F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), part).alias("chunk")))
    chunks = placed.select("region", "chunk", "pure").distinct()
    if apart:
        other = chunks.select("region", F.col("chunk").alias("b"), F.col("pure").alias("q"))
        pairs = chunks.withColumnRenamed("chunk", "a").join(other.hint("merge"), "region").where((F.col("a") <= F.col("b")) & ~F.coalesce(F.col("pure") == F.col("q"), F.lit(False)))
        pairs = pairs.select("a", "b").distinct()
        ends = pairs.select("a", "b", F.col("a").alias("chunk")).union(pairs.where("a < b").select("a", "b", F.col("b").alias("chunk")))
        rows = placed.select("chunk", "root", "set").join(ends.hint("merge"), "chunk")
    else:
        every = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PILOTS))).alias("every"))
        pilots = placed.join(every.hint("merge"), "region").where(F.pmod(F.xxhash64("set", F.lit(1)), "every") == 0).select("region", "root", "set")
        pilots = pilots.join(chunks.select("region", "chunk").hint("merge"), "region").select("chunk", "root", "set")
        rows = placed.select("chunk", "root", "set").union(pilots).distinct().select("chunk", "root", "set", F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    full = rows.join(nodes.hint("merge"), "set").join(sets.hint("merge"), "set").select("a", "b", "chunk", "root", "set", "size", "fps", "hashes")
    return full.groupBy("a", "b").applyInArrow(lambda t: _across(t, radius), "u bigint, v bigint")


def connected(edges: DataFrame, hubs: DataFrame, sets: DataFrame, nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """edges, links to hubs (u, v), sets (set, hashes) and nodes (set, size, fps) -> (node, root) by all links.

    Chunks by themselves come first, with the pilots of their region: that joins a large group which has no good hub, so
    that few roots are left when every chunk meets every other.
    """
    roots = components(edges)
    if hubs.isEmpty():
        return roots
    regions = settle(components(hubs).select(F.col("node").alias("set"), F.col("root").alias("region")))
    weights = nodes.groupBy("set").agg(F.sum(8 * F.col("size").cast("bigint") + ROW).alias("bytes"))
    for apart in (False, True):
        named = regions.join(roots.select(F.col("node").alias("set"), "root").hint("merge"), "set", "left").select("set", "region", F.coalesce("root", "set").alias("root"))
        mixed = named.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low < top").select("region")
        weighed = named.join(mixed.hint("merge"), "region").join(weights.hint("merge"), "set")
        if apart:  # the members of a region of one chunk have all met
            wide = weighed.groupBy("region").agg(F.sum("bytes").alias("all")).where(F.col("all") > CHUNK).select("region")
            weighed = weighed.join(wide.hint("merge"), "region")
        members = settle(weighed.select("region", "root", "set", "bytes"))
        if members.isEmpty():
            break
        edges = edges.union(settle(_compared(members, apart, sets, nodes, radius)))
        roots = components(edges)
    return roots


def near_copies(docs: DataFrame, shingle: int = SHINGLE, prints: int = PRINTS, radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id, the least doc_id of those that links connect: one row for each row of docs."""
    base = slim(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = settle(base.mapInArrow(lambda it: _nodes(it, shingle, prints), f"doc_id {kind}, hash bigint, set bigint, size int, fps array<bigint>"))
    first = F.first(F.struct("hash", "size")).alias("f")
    nodes = settle(rows.groupBy("set").agg(F.min("doc_id").alias("least_id"), first, F.collect_set("fps").alias("all")).select("set", "least_id", "f.*", "all"))
    by_print = nodes.where("size > 0").select("set", "size", F.explode("all").alias("fps"))
    pairs = settle(candidates(by_print, prints, radius))
    sets = shingles(base.select("hash", "text"), pairs, nodes.select("set", "hash"), shingle)
    edges = settle(links(pairs.select("u", "v"), sets))
    roots = connected(edges, pairs.where("hub").select("u", "v"), sets, by_print, radius)
    named = nodes.join(roots, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"), "least_id")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.select("doc_id", "set").join(named.join(ids, "root").select("set", "component_id"), "set").select("doc_id", "component_id")
