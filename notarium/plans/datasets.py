"""The knowledge-base model over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

URL, MODEL = "local", "bench-64"
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("domain"), F.col("source").alias("source_file"), F.sha2("text", 256).alias("content_hash"),
    )


def capture_embeddings(spark: SparkSession, sf_dir: str, owner: str = "capture_id") -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(owner), F.lit(URL).alias("provider_url"), F.lit(MODEL).alias("model"), F.size("embedding").alias("dimensions"), "embedding",
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def fact_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saves in an order that isn't that of their dates; events that are a multiple of 1000003 apart share a seq."""
    return table(spark, sf_dir, "events").select(
        "event_id", ((F.col("event_id") * 7919) % 1000003).alias("seq"), F.col("event_type").alias("domain"), F.lit("metric").alias("category"), F.col("user_id").cast("string").alias("key"),
        F.to_date("ts").alias("as_of"), F.col("value").alias("value_numeric"), F.col("props").alias("value"),
    )


def parts_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"), F.col("p_size").cast("string").alias("category"), F.col("p_name").alias("key"), F.col("p_type").alias("value"),
        F.col("p_brand").alias("context"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("as_of"), F.lit(None).cast("date").alias("valid_until"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as issues: the first turn is the body, the others comments, in order."""
    turns = table(spark, sf_dir, "conversations")
    comment = F.struct(F.struct(F.col("role").alias("login")).alias("author"), F.col("text").alias("body"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", comment.alias("c"))))
    every = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return every.select(
        F.col("conv_id").alias("number"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.get("t", F.lit(0))["c"]["body"].alias("body"),
        F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["c"]).alias("comments"),
    )


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: x["text"]).alias("pages"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings put before some lines by position."""

    def mark(line: Column, i: Column) -> Column:
        k = (i + 1) % 7
        return F.concat(F.when(k == 1, "# ").when(k == 4, "## ").when(k == 6, "### ").otherwise(""), line)

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("content"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current files, manifest) with new, deleted, changed and unchanged paths."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    mtime = F.lit(1.7e12) + F.col("doc_id")
    current = ids.where("doc_id % 10 <> 0").select(path, F.when(F.col("doc_id") % 10 == 2, mtime + 1).otherwise(mtime).alias("mtime_ms"))
    return current, ids.where("doc_id % 10 <> 1").select(path, mtime.alias("mtime_ms"))


def event_issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Events as open issues, and the present time (the latest event)."""
    events = table(spark, sf_dir, "events")
    now = F.lit(str(events.agg(F.max("ts")).first()[0])).cast("timestamp_ntz")
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 20).cast("int"))
    rows = events.select(F.col("event_type").alias("repo"), F.col("event_id").alias("number"), F.col("ts").alias("created_at"), (F.col("ts") + hours).alias("updated_at"))
    return rows, now
