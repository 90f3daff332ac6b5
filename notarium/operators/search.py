"""Semantic top-k, weighted text ranking, recency listing and statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import like_pattern, search_terms
from ..functions.vectors import cosine_similarity, vector_literal

FACT_LIMIT = 5


def clamp(limit: int | None, default: int, most: int) -> int:
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, not {limit}")
    return min(limit if limit is not None else default, most)


def similar(owner: str, vectors: DataFrame, query: list[float], least: float, provider_url: str, model: str) -> DataFrame:
    """(owner, similarity) of the vectors of one model at or above a similarity, computed once per vector."""
    own = vectors.where((F.col("provider_url") == provider_url) & (F.col("model") == model) & (F.col("dimensions") == len(query)))
    scored = own.select(owner, cosine_similarity(F.col("embedding"), vector_literal(query)).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def top_captures(captures: DataFrame, vectors: DataFrame, query: list[float], *, provider_url: str, model: str, domain: str | None = None, limit: int | None = None, min_similarity: float = 0.3) -> DataFrame:
    """The captures nearest to the query.  Only ids and scores take part in the sort; contents join the k that remain."""
    hits = similar("capture_id", vectors, query, min_similarity, provider_url, model).withColumnRenamed("capture_id", "id")
    owners = captures.select("id") if domain is None else captures.where(F.col("domain") == domain).select("id")
    best = hits.join(owners, "id").orderBy(F.col("similarity").desc(), "id").limit(clamp(limit, 5, 20))
    return captures.join(F.broadcast(best), "id")


def top_facts(facts: DataFrame, vectors: DataFrame, query: list[float], *, provider_url: str, model: str, domain: str | None = None, min_similarity: float = 0.3) -> DataFrame:
    """The current facts nearest to the query, FACT_LIMIT of them."""
    current = facts.where(F.col("valid_until").isNull())
    current = current if domain is None else current.where(F.col("domain") == domain)
    hits = similar("fact_id", vectors, query, min_similarity, provider_url, model).withColumnRenamed("fact_id", "id")
    best = hits.join(current.select("id"), "id").orderBy(F.col("similarity").desc(), "id").limit(FACT_LIMIT)
    return current.join(F.broadcast(best), "id")


def term_score(term: str, key: Column, value: Column, context: Column) -> Column:
    """3 for a match in the key, else 2 in the value, else 1 in the context, else 0."""
    p = F.lit(like_pattern(term))
    return F.when(F.ilike(key, p), 3).when(F.ilike(value, p), 2).when(F.ilike(context, p), 1).otherwise(0)


def search_facts(facts: DataFrame, *, domain: str | None = None, category: str | None = None, search: str | None = None, current_only: bool = True, limit: int | None = None) -> DataFrame:
    """Facts that match any term, best score first; without terms, in order of domain, category and key."""
    conditions = [F.col(c) == v for c, v in (("domain", domain), ("category", category)) if v]
    if current_only:
        conditions.append(F.col("valid_until").isNull())
    terms = search_terms(search)
    scores = [term_score(t, F.col("key"), F.col("value"), F.col("context")) for t in terms]
    if scores:
        conditions.append(reduce(or_, [s > 0 for s in scores]))
    rows = facts.where(reduce(and_, conditions)) if conditions else facts
    most = clamp(limit, 20, 100)
    if scores:
        return rows.withColumn("score", reduce(lambda a, b: a + b, scores)).orderBy(F.col("score").desc(), F.col("as_of").desc(), "domain", "category", "key", "id").limit(most)
    return rows.orderBy("domain", "category", "key", F.col("as_of").desc(), "id").limit(most)


def list_recent(captures: DataFrame, *, domain: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """The latest captures; a null captured_at counts as latest."""
    rows = captures.where(F.col("domain") == domain) if domain else captures
    rows = rows.where(F.col("captured_at") >= F.lit(since).cast("timestamp")) if since else rows
    return rows.orderBy(F.col("captured_at").desc_nulls_first(), "id").limit(clamp(limit, 10, 50))


def totals(captures: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: captures, current_facts, latest (capture)."""
    a = captures.agg(F.count(F.lit(1)).alias("captures"), F.max("captured_at").alias("latest"))
    b = facts.agg(F.count_if(F.col("valid_until").isNull()).alias("current_facts"))
    return a.join(F.broadcast(b)).select("captures", "current_facts", "latest")


def count_by_domain(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col("domain").asc_nulls_last())


def missing_embeddings(rows: DataFrame, vectors: DataFrame, owner: str, *, provider_url: str, model: str, limit: int = 0) -> DataFrame:
    """Rows without a vector of this model, in order of id."""
    have = vectors.where((F.col("provider_url") == provider_url) & (F.col("model") == model)).select(F.col(owner).alias("id"))
    left = rows.join(have, "id", "left_anti").orderBy("id")
    return left.limit(limit) if limit else left
