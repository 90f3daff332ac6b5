"""Temporal facts: the log of saves resolved into intervals, and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FACT_KEY = ("domain", "category", "key", "as_of")


def resolve(saves: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Facts from the log of saves (seq orders them, the columns of ties those of one seq; they are dropped).

    A save that is not older than all before it with its key closes the current one at its own date; an older one is
    closed at the date of the current one.  So with m the latest date before: if as_of >= m, the interval ends where the
    next such save begins, else it ends at m.  Of the saves of one fact (FACT_KEY) the last gives the values, the first
    the id.  Saves are numbered once, so that all windows see saves of one seq in the same order.  A save without seq is
    after all others of its key, and gives a fact's values only where no other save of the fact does.
    """
    order = W.partitionBy("key").orderBy(F.asc_nulls_last("seq"), *ties)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = saves.withColumns({"turn": F.row_number().over(order), "latest": F.max("as_of").over(before)})
    marked = ranked.withColumn("leads", F.col("latest").isNull() | (F.col("as_of") >= F.col("latest")))
    following = F.lead("as_of").over(W.partitionBy("key", "leads").orderBy("turn"))
    closed = marked.withColumn("valid_until", F.when(F.col("leads"), following).otherwise(F.col("latest")))
    same = W.partitionBy(*FACT_KEY)
    last = closed.withColumns({"id": F.min("seq").over(same), "r": F.row_number().over(same.orderBy(F.desc_nulls_last("seq"), F.desc("turn")))})
    return last.where("r = 1").drop("r", "turn", "latest", "leads", "seq", *ties)


def valid_at(date: Column) -> Column:
    return (F.col("as_of") <= date) & (F.col("valid_until").isNull() | (F.col("valid_until") > date))


def lookup(facts: DataFrame, key: str, *, as_of: str, domain: str | None = None) -> DataFrame:
    """The fact of a key at a date: the latest that is valid then."""
    rows = facts.where((F.col("key") == key) & valid_at(F.lit(as_of).cast("date")))
    rows = rows.where(F.col("domain") == domain) if domain is not None else rows
    return rows.orderBy(F.col("as_of").desc(), "id").limit(1)


def lookup_many(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (probe_id, key, at): the fact of its key at its date, where there is one.

    One join on the key and one aggregation by probe, which keeps the latest fact of each map-side.
    """
    met = probes.join(facts, "key").where(valid_at(F.col("at")))
    rest = [c for c in facts.columns if c not in ("as_of", "id", "key")]
    best = F.max_by(F.struct("as_of", "id", *rest), F.struct("as_of", (-F.col("id")).alias("i")))
    return met.groupBy("probe_id", "key", "at").agg(best.alias("f")).select("probe_id", "key", "at", "f.*")


def overlapping_history(facts: DataFrame) -> DataFrame:
    """Pairs of neighbouring intervals of a key that overlap (what a backdated save leaves); those without a date or id come last."""
    order = W.partitionBy("key").orderBy(F.asc_nulls_last("as_of"), F.asc_nulls_last("id"), "domain", "category")
    real = facts.where("valid_until IS NULL OR valid_until > as_of")
    nxt = real.withColumns({"next_id": F.lead("id").over(order), "next_as_of": F.lead("as_of").over(order)})
    return nxt.where("next_id IS NOT NULL AND (valid_until IS NULL OR valid_until > next_as_of)").select("key", "id", "as_of", "valid_until", "next_id", "next_as_of")
