"""Explicit schemas of the knowledge base, as DDL; nothing is inferred."""

from pyspark.sql import types as T


def parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


CAPTURES = (
    "id BIGINT NOT NULL, content STRING NOT NULL, type STRING, domain STRING, topics ARRAY<STRING>, people ARRAY<STRING>, action_items ARRAY<STRING>, "
    "dates MAP<STRING, STRING>, source_file STRING, source_section STRING, source_type STRING, chunk_index INT, captured_at TIMESTAMP, content_date DATE, content_hash STRING"
)
FACTS = (
    "id BIGINT NOT NULL, domain STRING NOT NULL, category STRING NOT NULL, key STRING NOT NULL, value STRING NOT NULL, value_numeric DOUBLE, currency STRING, unit STRING, "
    "context STRING, source_file STRING, people ARRAY<STRING>, as_of DATE NOT NULL, valid_until DATE, captured_at TIMESTAMP, source_type STRING"
)
FACT_SAVES = (
    "seq BIGINT NOT NULL, domain STRING NOT NULL, category STRING NOT NULL, key STRING NOT NULL, value STRING NOT NULL, value_numeric DOUBLE, currency STRING, unit STRING, "
    "context STRING, people ARRAY<STRING>, as_of DATE NOT NULL, captured_at TIMESTAMP"
)


def embeddings(owner: str) -> str:
    """Vectors of captures or facts; owner is capture_id or fact_id."""
    return (f"{owner} BIGINT NOT NULL, provider_url STRING NOT NULL, model STRING NOT NULL, dimensions INT, embedding ARRAY<FLOAT>, created_at TIMESTAMP")


SOURCES = ("id BIGINT, file_path STRING NOT NULL, file_hash STRING, last_imported TIMESTAMP, capture_count INT, fact_count INT, notes STRING")
_COMMENT = "STRUCT<author: STRUCT<login: STRING>, body: STRING, createdAt: STRING>"
ISSUE = (f"number INT, title STRING, body STRING, updatedAt STRING, author STRUCT<login: STRING>, comments ARRAY<{_COMMENT}>")
_PR = "STRUCT<number: INT, title: STRING, url: STRING, author: STRING, at: STRING, updated_at: STRING, merged_at: STRING, created_at: STRING>"
_STATUS_ISSUE = "STRUCT<number: INT, title: STRING, state: STRING, assignee: STRING, created_at: STRING, updated_at: STRING, labels: ARRAY<STRING>>"
STATUS = (
    f"repo STRING, slug STRING, updated_at STRING, error STRING, worked_on_recently BOOLEAN, stale_filtered INT, awaiting_your_review ARRAY<{_PR}>, "
    f"recent_activity_on_your_prs ARRAY<{_PR}>, your_prs_pending_review ARRAY<{_PR}>, recently_merged ARRAY<{_PR}>, demoted_reviews ARRAY<{_PR}>, recent_issues ARRAY<{_STATUS_ISSUE}>"
)
MANIFEST = ("path STRING NOT NULL, mtime_ms DOUBLE NOT NULL")
