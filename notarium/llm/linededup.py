r"""Line dedup by overlapping three-line windows (operator 5, DataFrame functions only).

Each run of WINDOW consecutive lines (of those that hold a word) is hashed to 128 bits, so that at any number of windows
different ones don't meet; windows that occur more than once anywhere keep their first occurrence, in order of doc_id
and position; the lines of all later occurrences are put together and removed.  Counting is one aggregation by hash
with partial sums, so that a window of which a third of all documents have a copy is one row per task; finding the
later occurrences is a join by hash against one row per repeated window.  What is gathered per document is its own
window positions, by doc_id and a hash of the row.

Defined cases: a null or blank text has no lines and keeps its text; a document of fewer than WINDOW lines has no
window and loses nothing; rows that share doc_id and text are one occurrence; a null doc_id comes last in order; a text
that loses no line is passed on byte for byte, any other is its remaining lines joined; an empty table gives no rows;
columns that clash with those that are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

WINDOW = 3
_LAST = 2**63 - 1
_ADDED = ("n_lines", "n_removed", "_row", "_key", "_ord", "_by", "_lines", "_starts", "_kept")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, ord, pos, h): every window of every document; h is the md5 of its lines' md5s."""
    hashed = docs.select(
        F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), F.transform(lines(F.col("text")), lambda x: F.md5(x.cast("binary"))).alias("hl"),
    )
    runs = F.when(
        F.size("hl") >= window,
        F.transform(F.sequence(F.lit(0), F.size("hl") - window), lambda i: F.unhex(F.md5(F.concat(*[F.get(F.col("hl"), i + j) for j in range(window)]).cast("binary")))),
    )
    return hashed.select("row", "ord", F.posexplode(runs).alias("pos", "h"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the later occurrences of repeated windows removed from text, and n_lines, n_removed."""
    passed = [c for c in docs.columns if c.lower() not in _ADDED]
    windows = line_windows(docs, window)
    # written down: the join then reads two plain exchanges, of which Spark splits the parts with hot windows
    repeated = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first")).where("n > 1")
    repeated = materialise(repeated.select("h", "first"), "repeated")
    later = windows.join(repeated, "h").where(F.struct("ord", "pos") > F.col("first"))
    starts = later.groupBy(F.col("row").alias("_key"), F.col("ord").alias("_by")).agg(F.collect_set("pos").alias("_starts"))
    rows = docs.select(*passed, F.xxhash64("doc_id", "text").alias("_row"), F.coalesce("doc_id", F.lit(_LAST)).alias("_ord"))
    joined = rows.join(starts, (F.col("_row") == F.col("_key")) & (F.col("_ord") == F.col("_by")), "left").select(*passed, "_starts", lines(F.col("text")).alias("_lines"))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + window - 1))))
    kept = F.when(F.col("_starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered))
    counted = joined.withColumn("_kept", kept)
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get(F.col("_lines"), i)), "\n"))
    removed = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept"))
    return counted.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in passed], F.size("_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"),
    )
