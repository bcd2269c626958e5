"""Line-first cleaning with DataFrame functions only.

Each line is judged by three rules, failing lines are removed, and a document that loses too
much of its text is rejected:

* punctuation: over ``MARK_SHARE`` percent of its visible characters are neither letters nor
  digits, or it is short (under ``SHORT_WORDS`` words) and doesn't end in a closing mark;
* navigation: one word in five or more is a bare separator (| > / and the like), three at least;
* boilerplate: it holds a phrase of ``BOILERPLATE`` (licence, rights, cookie and account lines).

Everything stays in one row per document: no shuffle, no Python. Repeated 5-word windows are
found inside the row by 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import tune

SPACE, NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
MARK_SHARE, SHORT_WORDS, LOST_PERCENT = 20, 4, 50
CLOSING = r"[.!?\x{2026}:;\x22'\x{201D}\x{2019}\x{BB})\x{3002}]\s*$"
SEPARATOR = r"(?<!\S)[|>/\x{BB}\x{B7}\x{2022}\x{2013}\x{2014}-]+(?!\S)"
BOILERPLATE = (
    "all rights reserved|(licensed|released) under|is licensed|copyright [(0-9]|privacy policy|cookie policy|uses cookies|terms of (use|service)|"
    "subscribe to|sign up for|log in to|click here to|enable javascript|powered by|skip to (main )?content"
)


def _pick(array: Column, at: Column | int) -> Column:
    return F.get(array, F.lit(at) if isinstance(at, int) else at)


def _line_fails(line: Column) -> Column:
    visible = F.length(F.regexp_replace(line, SPACE, ""))
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    marks = F.regexp_count(line, F.lit(r"[^\p{L}\p{N}\p{M}\s]")) * 100 > visible * MARK_SHARE
    unfinished = (n_words < SHORT_WORDS) & ~line.rlike(CLOSING)
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    return marks | unfinished | ((separators >= 3) & (separators * 5 >= n_words)) | F.lower(line).rlike(BOILERPLATE)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text, clean_text, n_lines, n_lines_removed, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    A null text has no words and no lines: all counts are 0, base_failed is true, clean_text is
    empty. Rows are judged one by one, so repeated rows and null doc_ids stay as they are; an
    empty table gives no rows. Only doc_id and text are read.
    """
    tune(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("body", F.coalesce("text", F.lit("")))
    base = base.withColumn("ws", F.filter(F.split("body", SPACE), lambda w: w != "")).withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(NOT_SPACE)))
    base = base.withColumn("n_words", F.size("ws").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size("ws") - WINDOW), lambda i: F.xxhash64(*[_pick(F.col("ws"), i + k) for k in range(WINDOW)]))
    base = base.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window; only the others sort.
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    base = base.withColumn("sorted", F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # get() is null beyond the ends, which equals no hash.
    same = lambda j, k: _pick(F.col("sorted"), j)["h"].eqNullSafe(F.get(F.col("sorted"), k)["h"])
    places = F.filter(F.transform(F.sequence(F.lit(0), F.size("sorted") - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), _pick(F.col("sorted"), j)["i"])), lambda i: i.isNotNull())
    base = base.withColumn("places", F.when(F.col("sorted").isNotNull(), F.sort_array(places)))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    merged = F.aggregate("places", state, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("end")), lambda a: a["n"])
    base = base.withColumn("good", F.filter("lines", lambda x: ~_line_fails(x)))
    visible = lambda c: F.length(F.regexp_replace(c, SPACE, "")).cast("long")
    base = base.select(
        "doc_id", "text", F.array_join("good", "\n").alias("clean_text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        "n_words", F.length(F.array_join("ws", "")).cast("long").alias("word_chars"), F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(F.when(F.col("places").isNotNull(), merged), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    lost = 100 * (F.col("word_chars") - visible(F.col("clean_text"))) > LOST_PERCENT * F.col("word_chars")
    return base.withColumn("kept", ~F.col("base_failed") & ~lost)


def clean(docs: DataFrame) -> DataFrame:
    """The cleaned documents that are kept: doc_id and text."""
    return measure(docs).filter("kept").select("doc_id", F.col("clean_text").alias("text"))
