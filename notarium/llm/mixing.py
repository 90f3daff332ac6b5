"""Mixing sources to target weights (operator 6).

Tokens (words) are summed per source, with partial sums before the only shuffle; from the small source table come
each source's target and repetition rate; each document is then taken floor(rate) times and once more when a hash of
its id falls under the rate's fraction.  The source table, not the documents, is what the documents are joined with.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; a
source without words has target 0 and rate 0; an empty table gives no rows; repeated rows are rows of their own (those
of one id share the outcome of the draw); extra columns pass through `mix_documents`, and the columns it adds replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import shielded

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
_ADDED = ("size", "source_size", "target", "rate", "copies")


def text_size(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Resharing what stands above `most` times a source's size until none does ends at the level L with
    sum(min(most * size, L * weight)) = all words.  Sources are put in order of most * size / weight; when the first k
    are full, L is the rest of the words over the rest of the weights, and the sources that are full are just those
    before the first k at which L is not above the next source's own bound.  All of that is two running sums over the
    source table, which has one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    weighted = sums.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
    by_bound = W.orderBy((most * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_bound.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    level = (over("source_size", everything) - most * over("source_size", before)) / (over("w", everything) - over("w", before))
    ranked = weighted.withColumns({"k": F.row_number().over(by_bound), "level": level})
    first = F.min(F.when(F.col("level") * F.col("w") <= most * F.col("source_size"), F.col("k"))).over(everything)
    settled = ranked.withColumn("first", first).withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("k") < F.col("first"), most * F.col("source_size").cast("double")).otherwise(F.col("level") * F.col("w"))
    return settled.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone (the first 52 bits of an md5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def mix_documents(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document)."""
    kept = [c for c in docs.columns if c.lower() not in _ADDED]
    sized = docs.select(*kept, text_size(F.col("text")).alias("size"))
    targets = source_targets(docs.select("source", text_size(F.col("text")).alias("size")), weights, most)
    rated = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")
    return rated.select(*[F.col(f"d.{c}") for c in kept], "size", "source_size", "target", "rate").withColumn("copies", (whole + extra).cast("int"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of docs."""
    own, now = shielded(docs, (*_ADDED, "copy"))
    mixed = mix_documents(own, **options).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[F.col(n).alias(c) for n, c in zip(now, docs.columns, strict=True)])
