"""Quality rules by line-first cleaning, in built-in expressions only.

Each line is judged by itself (punctuation, navigation, boilerplate), failed lines go, and a document that lost
too much of its text goes with them. The whole computation is a narrow projection: no shuffle, no Python.

Defined cases: a null text has no word and no line, so it fails the word minimum; an empty table gives an empty
result; repeated rows are judged one by one; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternsift.llm.common import WHITE_CLASS, slim, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails on punctuation when symbols exceed this share of its characters, or exclamation marks this share of its words.
MAX_SYMBOL_PERCENT = 10
MAX_BANG_PERCENT = 50
#: A line is navigation when it has at least MIN_BARS separators and one for every WORDS_PER_BAR words.
MIN_BARS = 3
WORDS_PER_BAR = 4
#: Stock phrases; they fail a line of at most BOILERPLATE_WORDS words only, so prose that mentions them stays.
BOILERPLATE = r"all rights reserved|cookie policy|accept (all )?cookies|terms of (use|service)|privacy policy|click here|enable javascript|subscribe (now|to our)|sign (in|up) (now|to)|share this"
BOILERPLATE_WORDS = 30
#: A document goes when failed lines held more than this share of its characters in words.
MAX_LOST_PERCENT = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """True for a line that breaks a rule; a line without words never does."""
    words = _count(line, f"[^{WHITE_CLASS[1:-1]}]+")
    chars = F.length(line)
    punctuation = (_count(line, SYMBOLS) * 100 > chars * MAX_SYMBOL_PERCENT) | (_count(line, "!") * 100 > words * MAX_BANG_PERCENT)
    bars = _count(line, "[|]")
    navigation = (bars >= MIN_BARS) & (bars * WORDS_PER_BAR >= words)
    boilerplate = (words <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE)
    return (words > 0) & (punctuation | navigation | boilerplate)


def _chars_in_words(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WHITE_CLASS + "+", ""))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the kept columns, the base figures, the lines' verdict and the cleaned text."""
    t = F.col("_text")
    # Every array is a named column of its own step: a lambda that held its expression would compute it per element.
    base = slim(docs, *keep, text).withColumnRenamed(text, "_text") if text not in keep else slim(docs, *keep).withColumn("_text", F.col(text))
    base = base.select(*keep, "_text", words_of(t).alias("_words"), F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.split(t, "\n")).alias("_lines"))
    w = F.col("_words")
    base = base.select(
        *keep, "_text", "_lines",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.when(F.size(w) < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        .alias("_grams"),
        F.filter(F.col("_lines"), lambda x: ~line_fails(x)).alias("_good"),
    )
    grams = F.col("_grams")
    base = base.withColumn(
        "_sorted",
        # Sorting is for texts with some repeat only; most have none and stop at the distinct count.
        F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    s = F.col("_sorted")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    base = base.withColumn("_at", F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))
    at = F.col("_at")
    spoken = F.filter(F.col("_lines"), lambda x: x.rlike(f"[^{WHITE_CLASS[1:-1]}]"))
    base = base.select(
        *keep, "_text", "n_words", "word_chars",
        F.coalesce(_count(t, SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long").alias("n_dup_lines"),
        F.when(at.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))).cast("long").alias("n_repeat_words"),
        F.array_join(F.col("_good"), "\n").alias("clean_text"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_lines_failed"),
    )
    # A filter on the verdict must not sink into the steps above and evaluate their arrays inside its lambdas; it can't
    # pass a column that isn't deterministic, and the verdicts refer to this one without depending on its value.
    base = base.withColumn("_fence", F.monotonically_increasing_id() >= 0)
    failed = F.col("_fence") & ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    base = base.withColumn("base_failed", failed)
    lost = F.col("word_chars") - _chars_in_words(F.col("clean_text"))
    return base.drop("_text").withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)).drop("_fence")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(lines) AS l FROM w),
judged AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, length(l) AS c,
         len(regexp_extract_all(l, '{SYMBOLS}')) AS sym, length(l) - length(replace(l, '!', '')) AS bangs,
         length(l) - length(replace(l, '|', '')) AS bars,
         length(regexp_replace(l, '{WHITE_CLASS}+', '', 'g')) AS wc
  FROM lines),
lost AS (
  SELECT doc_id,
         sum(CASE WHEN n > 0 AND (sym * 100 > c * {MAX_SYMBOL_PERCENT} OR bangs * 100 > n * {MAX_BANG_PERCENT}
              OR (bars >= {MIN_BARS} AND bars * {WORDS_PER_BAR} >= n)
              OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(l), '{BOILERPLATE}'))) THEN wc ELSE 0 END) AS gone
  FROM judged GROUP BY doc_id),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM judged WHERE n > 0 GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost.gone, 0) AS gone
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AND gone * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept
FROM base
"""
