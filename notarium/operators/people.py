"""Rewriting people arrays to canonical names, and what that changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.people import Aliases, canonical_people


def rewrite(rows: DataFrame, aliases: Aliases) -> DataFrame:
    """Rows with names, with people canonical and changed telling where they differ."""
    new = canonical_people(F.col("people"), aliases)
    return rows.where(F.size("people") > 0).withColumn("after", new).withColumn("changed", ~F.col("people").eqNullSafe(F.col("after")))


def change_counts(rewritten: DataFrame) -> DataFrame:
    return rewritten.groupBy("changed").agg(F.count(F.lit(1)).alias("count"))


def collapse_counts(rewritten: DataFrame, aliases: Aliases) -> DataFrame:
    """How many written names that aren't canonical lead to each canonical name."""
    names = rewritten.select(F.explode("people").alias("before"))
    mapped = names.withColumn("canonical", F.get(canonical_people(F.array("before"), aliases), F.lit(0)))
    return mapped.where("canonical IS NOT NULL AND before <> canonical").groupBy("canonical").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "canonical")
