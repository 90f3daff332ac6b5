"""Writes as pure functions: (state, batch) -> new state, each made of joins and windows.

Tables are replaced as a whole (see sources.tables), since plain files know no UPDATE, DELETE or MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .chunking import issue_chunks, issue_hash

CAPTURE_DEFAULTS = {"domain": "general", "type": "thought"}


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def next_ids(state: DataFrame, rows: DataFrame, order: list[Column | str], id_: str = "id") -> DataFrame:
    """rows with ids that go on from the state's largest.

    Numbers come from counts per range partition, so no single task sees all rows.
    """
    first = state.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_first"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    within = W.partitionBy("_p").orderBy(*order)
    numbered = placed.withColumn("_n", F.row_number().over(within))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_before"))
    joined = numbered.join(F.broadcast(starts), "_p").join(F.broadcast(first))
    return joined.withColumn(id_, F.col("_first") + F.col("_before") + F.col("_n")).drop("_p", "_n", "_before", "_first")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_of_each(rows, keys, [F.col(order).desc()])


def new_captures(state: DataFrame, batch: DataFrame, order: list[Column | str]) -> DataFrame:
    """The batch's captures that are to be inserted: the first of each content hash that the state does not have."""
    return first_of_each(batch, ["content_hash"], order).join(state.select("content_hash"), "content_hash", "left_anti")


def interactive_capture(content: Column, meta: Column, domain: Column, type_: Column) -> dict[str, Column]:
    """Columns of a capture typed in by hand; arrays are never null."""
    empty = F.array().cast("array<string>")
    return {
        "content": content, "content_hash": content_hash(content), "source_type": F.lit("claude_capture"),
        "domain": F.coalesce(domain, meta["domain"], F.lit(CAPTURE_DEFAULTS["domain"])), "type": F.coalesce(type_, meta["type"], F.lit(CAPTURE_DEFAULTS["type"])),
        "topics": F.coalesce(meta["topics"], empty), "people": F.coalesce(meta["people"], empty), "action_items": F.coalesce(meta["action_items"], empty),
        "dates": F.coalesce(meta["dates"], F.create_map().cast("map<string,string>")),
    }


def document_capture(content: Column, meta: Column, domain: Column, type_: Column, source_type: Column) -> dict[str, Column]:
    """Columns of a capture from a document; what is missing stays null."""
    people = meta["people"]
    return {
        "content": content, "content_hash": content_hash(content), "source_type": source_type, "domain": F.coalesce(domain, meta["domain"]), "type": F.coalesce(type_, meta["type"]),
        "topics": meta["topics"], "people": F.when(F.size(people) > 0, people), "action_items": meta["action_items"], "dates": meta["dates"],
    }


def insert_embeddings(state: DataFrame, batch: DataFrame, owner: str) -> DataFrame:
    """The state and those vectors of the batch whose key it lacks."""
    keys = [owner, "provider_url", "model"]
    return state.unionByName(batch.dropDuplicates(keys).join(state.select(*keys), keys, "left_anti"))


def upsert_embeddings(state: DataFrame, batch: DataFrame, owner: str, order: str) -> DataFrame:
    """The state with vectors and dimensions replaced by the batch's last of each key; created_at stays."""
    keys = [owner, "provider_url", "model"]
    last = last_of_each(batch, keys, order).drop(order)
    old, new = state.alias("o"), last.alias("n")
    joined = old.join(new, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in ("dimensions", "embedding")], F.coalesce("o.created_at", "n.created_at").alias("created_at"))


def upsert_sources(state: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Sources by path: the batch's last hash, count and time; other columns stay."""
    last = last_of_each(batch, ["file_path"], order).drop(order)
    joined = state.alias("o").join(last.alias("n"), "file_path", "full_outer")
    return joined.select("file_path", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in state.columns if c in last.columns and c != "file_path"], *[F.col(f"o.{c}") for c in state.columns if c not in last.columns])


def delete_by_source(captures: DataFrame, sources: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures and sources without those of the paths (file_path), and how many captures of each path went."""
    gone = captures.join(paths, captures["source_file"] == paths["file_path"], "left_semi").groupBy("source_file").agg(F.count(F.lit(1)).alias("captures_deleted"))
    return captures.join(paths, captures["source_file"] == paths["file_path"], "left_anti"), sources.join(paths, "file_path", "left_anti"), gone


def surviving_embeddings(vectors: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """Vectors whose owner is still there."""
    return vectors.join(owners.select(F.col("id").alias(owner)), owner, "left_semi")


def changed_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files (file_path, file_hash) with status new, changed or unchanged against the known hashes."""
    known = sources.select("file_path", F.col("file_hash").alias("known_hash"))
    status = F.when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") == F.col("file_hash"), "unchanged").otherwise("changed")
    return files.join(known, "file_path", "left").select(*files.columns, status.alias("status"))


def replace_changed(captures: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Captures after ingesting chunks: old ones of paths that are known go, new contents come in."""
    replaced = chunks.select("source_file").distinct().join(sources.select(F.col("file_path").alias("source_file")), "source_file", "left_semi")
    kept = captures.join(replaced, "source_file", "left_anti")
    return kept.unionByName(new_captures(kept, chunks, ["source_file", "chunk_index"]), allowMissingColumns=True)


def batch_counters(results: DataFrame) -> DataFrame:
    """One row of totals over per-file results (status, chunks, failed, duplicates)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        count("ingested").alias("ingested"), count("skipped").alias("skipped"), count("failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "ingested", F.col("chunks") - F.col("failed") - F.col("duplicates"))), F.lit(0)).alias("total_chunks"),
    )


def issue_path(repo: str, number: Column) -> Column:
    """The source path of an issue."""
    return F.concat(F.lit(f"github://{repo}/issues/"), number.cast("string"))


def checked_issues(issues: DataFrame, repo: str, sources: DataFrame) -> DataFrame:
    """issues (number, title, body, comments) with file_path, file_hash, chunks and status: new, changed or skipped.

    All hashes are looked up by one join.  An issue is skipped when its hash is known, and also when it has no chunk.
    """
    body, comments = F.coalesce("body", F.lit("")), F.coalesce("comments", F.array())
    rows = issues.select(
        "*", issue_path(repo, F.col("number")).alias("file_path"), issue_hash(body, comments).alias("file_hash"),
        issue_chunks(F.col("number"), F.coalesce("title", F.lit("")), body, comments).alias("chunks"),
    )
    status = F.when((F.col("status") == "unchanged") | (F.size("chunks") == 0), "skipped").otherwise(F.col("status"))
    return changed_sources(rows, sources).withColumn("status", status)


def issue_results(checked: DataFrame, prepared: DataFrame) -> DataFrame:
    """(file_path, status, chunk_count) of checked issues; prepared (file_path, failed) tells how many chunks failed.

    failed when all chunks failed; the chunk count has failures and duplicates in it.
    """
    counted = checked.join(prepared, "file_path", "left")
    made = F.when(F.col("status") == "skipped", "skipped").when(F.col("failed") == F.size("chunks"), "failed").otherwise("ingested")
    return counted.select("file_path", made.alias("status"), F.when(made == "skipped", 0).otherwise(F.size("chunks")).alias("chunk_count"))


def issue_counters(results: DataFrame) -> DataFrame:
    """One row of totals over issues: chunks of ingested issues count whole."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count(F.lit(1)).alias("total_issues"), count("ingested").alias("ingested"), count("skipped").alias("skipped"), count("failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "ingested", F.col("chunk_count"))), F.lit(0)).cast("long").alias("total_chunks"),
    )


def file_status(chunks: Column, failed: Column) -> Column:
    """failed when every chunk failed (so also without chunks), else ingested."""
    return F.when(failed == chunks, "failed").otherwise("ingested")


def legacy_embeddings(captures: DataFrame, vectors: DataFrame, provider_url: str, model: str) -> DataFrame:
    """Vectors copied from an embedding column of captures into the vector table."""
    old = captures.where(F.col("embedding").isNotNull()).select(
        F.col("id").alias("capture_id"), F.lit(provider_url).alias("provider_url"), F.lit(model).alias("model"), F.size("embedding").alias("dimensions"), "embedding",
    )
    return insert_embeddings(vectors, old, "capture_id")


def verify_copy(captures: DataFrame, vectors: DataFrame, provider_url: str, model: str) -> tuple[int, int]:
    """Expected and actual number of copied vectors; an error when they differ."""
    expected = captures.where(F.col("embedding").isNotNull()).count()
    actual = vectors.where((F.col("provider_url") == provider_url) & (F.col("model") == model)).count()
    if expected != actual:
        raise ValueError(f"expected {expected} vectors, found {actual}")
    return expected, actual
