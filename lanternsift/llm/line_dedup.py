r"""Line dedup over levelled sorted runs of line hashes, in built-in expressions only.

State is a set of runs, each a table sorted by a 128-bit line hash with how many documents hold the line and the
largest doc_id among them. A new batch is reduced to one row a key, merge-anti-joined with the keys that the runs
have settled, and added as a run of level 0. When a level holds FANOUT runs they are merged into one run of
the next level, so a key is rewritten O(log batches) times. The decision (a line found in enough documents stays in
the largest doc_id alone) reads the merged runs once.

Defined cases: a null or empty text is one empty line; keys shorter than min_chars are never touched; a doc_id that
occurs on several rows counts as one document and each of its rows is cleaned; a null doc_id counts as one document
below all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternsift.llm.common import ascii_lower, discard, settle, shared_dir, slim, strip_white, wide_hash

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 3
BATCHES = 3

KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return ascii_lower(strip_white(line))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row_key (tells apart rows of one doc_id), pos, k1, k2 of every line with a key long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = slim(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("row_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    k1, k2 = wide_hash(F.col("key"))
    return keyed.select("doc_id", "row_key", "pos", k1.alias("k1"), k2.alias("k2"))


class LineRuns:
    """The levelled runs; every run lives in shared storage, so a lost executor loses no state.

    Batches come in descending order of doc_id: the first that holds a key names its owner, and once a key has
    min_docs documents no later batch can change its fate. So each batch is merge-anti-joined with the settled keys
    of the runs, and only what is left is added as its own run: a line that a third of all documents hold costs one
    row a batch at most, and none once it is settled.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]

    @property
    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, df: DataFrame) -> str:
        path = shared_dir(self.spark)
        settle(df.sortWithinPartitions(*KEY), path)
        return path

    @staticmethod
    def _merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def add(self, rows: DataFrame) -> None:
        """Reduce a batch to its run and add it. Batches must not share documents: their counts are added."""
        run = rows.groupBy(*KEY).agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("owner"))
        if self.paths:
            run = run.join(self.shared().select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(run))
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                merged = self._write(self._merge(self.spark.read.parquet(*old)))
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                for p in old:
                    discard(self.spark, p)
            level += 1

    def shared(self) -> DataFrame:
        """One row for each key of enough documents over all runs, with its owner."""
        return self._merge(self.spark.read.parquet(*self.paths)).where(F.col("n_docs") >= self.min_docs)


def build_runs(rows: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> tuple[LineRuns, DataFrame]:
    """Feed rows to fresh runs in batches of whole documents; also the rows, settled once for all batches."""
    rows = settle(rows)
    runs = LineRuns(rows.sparkSession, min_docs)
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []), reverse=True)
    id_, above = F.col("doc_id"), None
    for cut in [*cuts, None]:
        low = F.lit(True) if above is None else F.coalesce(id_ < above, F.lit(True))
        runs.add(rows.where(low if cut is None else low & F.coalesce(id_ >= cut, F.lit(False))))
        above = cut
    return runs, rows


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row; lines of shared keys stay in the largest doc_id alone.

    carry: columns of docs to take along, as the fields of one struct named carried.
    """
    runs, rows = build_runs(line_rows(docs, min_chars), min_docs, batches)
    shared = runs.shared().select(*KEY, "owner")
    # One row a key on the right: a key that a third of all rows hold is split by the adaptive skew join.
    lost = (
        rows.join(shared, KEY)
        .where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("lost_id"), F.col("row_key").alias("lost_key"), "drop")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("row_key"), *more)
    joined = base.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("row_key") == F.col("lost_key")), "left")
    taken = ["carried"] if carry else []
    lines = joined.select("doc_id", "text", F.split("text", "\n").alias("lines"), "drop", *taken)
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return lines.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get(F.col("lines"), i)), "\n")).alias("kept_text"),
        *taken,
    )


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (
  SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
f AS (
  SELECT l.doc_id, l.i, l.line, shared.k IS NOT NULL AND l.doc_id <> shared.owner AS gone FROM l LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
