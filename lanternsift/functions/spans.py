"""Spans of text as arrays of structs, in built-in expressions: extraction with offsets, overlap, folding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: type, start (inclusive) and end (exclusive) in code points, text, confidence, detector.
SPAN = "struct<type:string,start:int,end:int,text:string,confidence:double,detector:string>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as (start, end, hit). A group must be a suffix of the match.

    Built-ins give no offsets, but pieces between matches and the matches themselves tile the text.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tiles = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    if group:
        tiles = F.zip_with(tiles, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda t, g: F.struct(t["p"].alias("p"), t["h"].alias("h"), g.alias("g")))
    else:
        tiles = F.transform(tiles, lambda t: F.struct(t["p"].alias("p"), t["h"].alias("h"), t["h"].alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t["p"]) + F.length(t["h"])
        found = F.struct((end - F.length(t["g"])).alias("start"), end.alias("end"), t["g"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(tiles, start, step, lambda acc: acc["out"])


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def guarded(guard: Column, spans: Column) -> Column:
    """Spans only where a cheap test holds; the optimizer won't derive it from the pattern."""
    return F.when(guard, spans).otherwise(empty_spans())


def left_of(text: Column, start: Column, n: int) -> Column:
    """Up to n code points before a start."""
    low = F.greatest(start - n, F.lit(0))
    return F.substring(text, low + 1, start - low)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy(spans: Column, rank: Callable[[Column], list[Column]]) -> Column:
    """Accept spans in order of rank unless they overlap one accepted before; result by place. O(n * accepted) a row."""
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(*(c.alias(f"k{i}") for i, c in enumerate(rank(s))), s.alias("s"))))
    free = lambda acc, s: ~F.exists(acc, lambda t: overlaps(t, s))
    kept = F.aggregate(keyed, empty_spans(), lambda acc, k: F.when(free(acc, k["s"]), F.concat(acc, F.array(k["s"]))).otherwise(acc))
    placed = F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s"))))
    return F.transform(placed, lambda p: p["s"])


def coalesce_intervals(intervals: Column) -> Column:
    """Merge overlapping or touching (start, end) structs into maximal ones, in order."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= w["start"]), joined).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(F.sort_array(intervals.cast(kind)), F.array().cast(kind), step)
