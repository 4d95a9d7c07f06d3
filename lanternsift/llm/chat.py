"""Chat formatting by multi-party perspective rotation, in built-in expressions only.

Every participant of a conversation gets a rendering in which its own turns are the assistant's and those of all others
are named user turns; the mask lists the character ranges of the assistant's words, the only ones a loss may see.
System turns stay system turns in every perspective and are no participant.

A rendering is cut into parts of PART_TURNS turn numbers, and a part into pieces of PART_ROWS turns, so no row grows
with its conversation: one that holds a third of all rows becomes many rows, spread over the cluster, and so do any number
of turns that share a number or have none. Parts beyond PART_ROWS turns are found by a count; only they are sorted, over
range partitions, and numbered from the partitions' counts. first_char says where a piece begins in the whole rendering;
masks are relative to their piece.

Defined cases: a null text is rendered as empty; a null role is a participant named "unknown"; a null turn comes before
all others; rows that share a turn are ordered by role and text, repeated rows are all rendered; a null conv_id is a
conversation of its own; a conversation of system turns only has no participant and no row; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternsift.llm.common import settle, slim

PART_TURNS = 256
PART_ROWS = 4096
SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _pieces(base: DataFrame, part_rows: int) -> DataFrame:
    """conv_id, part, piece and its turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")  # the number leads; nulls sort first
    sizes = base.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    crowded = sizes.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.lit(True).alias("_crowd"))
    marked = base.join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").drop("_c", "_p")
    calm = marked.where("_crowd IS NULL").groupBy("conv_id", "part").agg(turns).select("conv_id", "part", F.lit(0).cast("bigint").alias("piece"), "turns")
    order = ["conv_id", "part", "turn", "role", "text", "_id"]  # the id spreads rows that are equal in everything
    sorted_ = marked.where("_crowd").withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)).drop("_id", "_crowd"))
    # A row for each task that holds some of a part; a part has as many as there are tasks at most.
    held = placed.groupBy("conv_id", "part", "_task").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id", "part").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("_task").alias("_t"), "_low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.join(held, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("_task") == F.col("_t")))
    piece = F.floor((F.col("_at") - F.col("_low") + F.col("_before")) / part_rows).cast("bigint")
    return calm.union(ranked.withColumn("piece", piece).groupBy("conv_id", "part", "piece").agg(turns))


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, speaker, part, piece, first_char, n_turns, n_target, rendered, mask (array of start and end)."""
    base = slim(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("bigint").alias("part"),
    )
    speakers = base.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    seen = _pieces(base, part_rows).join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "part", "piece", "speaker", "turns")
    mine = lambda t: (t["role"] == F.col("speaker")) & (t["role"] != SYSTEM)
    head = lambda t: F.concat(
        F.lit(OPEN),
        F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).when(mine(t), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"])),
        F.lit("\n"),
    )
    pieces = seen.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("h"), t["text"].alias("t"), mine(t).alias("m"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["h"])
        end = begin + F.length(p["t"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(p["m"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    done = pieces.select(
        "conv_id", "speaker", "part", "piece",
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["m"])).cast("bigint").alias("n_target"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["h"], p["t"], F.lit(CLOSE))), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda acc: acc["mask"]).alias("mask"),
    )
    before = Window.partitionBy("conv_id", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.length("rendered").cast("bigint")).over(before), F.lit(0)).cast("bigint")
    return done.select("conv_id", "speaker", "part", "piece", first.alias("first_char"), "n_turns", "n_target", "rendered", "mask")


def digest(rotated: DataFrame) -> DataFrame:
    """Flat columns for comparison: the mask as text, the rendering as text and digest."""
    marks = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rotated.select("conv_id", "speaker", "part", "piece", "first_char", "n_turns", "n_target", "rendered", marks.alias("mask_spans"))


ORACLE_SQL = f"""
WITH b AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / {float(PART_TURNS)}) AS BIGINT), -1) AS part FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // {PART_ROWS} AS piece FROM b),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM b WHERE role <> '{SYSTEM}'),
p AS (
  SELECT b.conv_id, b.part, b.piece, s.speaker, b.turn, b.role, b.text, b.role = s.speaker AS mine,
         '{OPEN}' || CASE WHEN b.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN b.role = s.speaker THEN 'assistant' ELSE 'user name=' || b.role END || chr(10) AS h
  FROM n AS b JOIN s ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(h) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, part, piece ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM p),
g AS (
  SELECT conv_id, speaker, part, piece, count(*) AS n_turns, CAST(count(*) FILTER (WHERE mine) AS BIGINT) AS n_target,
         string_agg(h || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
         coalesce(string_agg(CAST(CAST(off + length(h) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off + length(h) + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE mine), '') AS mask_spans
  FROM o GROUP BY conv_id, speaker, part, piece)
SELECT conv_id, speaker, part, piece, n_turns, n_target, rendered, mask_spans,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_char
FROM g
"""
