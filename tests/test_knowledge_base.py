import datetime as dt
import json
import os

import pytest

from notarium.functions.people import Aliases
from notarium.plans.tools import open_knowledge_base


@pytest.fixture
def kb(spark, tmp_path):
    return open_knowledge_base(spark, f"file://{tmp_path}/kb", aliases=Aliases.of({"adam": {"aliases": ["Adam-H"]}, "_drop": ["claude"]}), now=lambda: dt.datetime(2024, 6, 1, 12))


def test_thoughts_and_facts(kb):
    assert kb.context_stats().count("(none)") == 2 and "Last capture: never" in kb.context_stats()
    said = kb.capture_thought("a first thought")
    assert said.startswith("Saved capture #1") and "Domain: general | Type: thought" in said
    assert kb.capture_thought("a first thought") == "This thought already exists (capture #1). Skipped."
    assert kb.capture_thought("another", domain="project").startswith("Saved capture #2")
    assert "#2** [project/thought] — 6/1/2024" in kb.list_recent()
    found = kb.search_context("another", min_similarity=0.99)
    assert "(100.0% match)" in found and "another" in found and "first" not in found
    assert kb.search_context("nothing like it", min_similarity=0.99) == "No matching captures or facts found."
    said = kb.save_fact("d", "c", "price", "10", currency="EUR", people=["Adam-H", "Claude"], as_of="2024-01-01")
    assert said == "Saved fact #1: d/c/price = 10 EUR (as of 2024-01-01)\nPeople: adam"
    kb.save_fact("d", "c", "price", "12", as_of="2024-03-01")
    kb.save_fact("d", "c", "price", "11", as_of="2024-02-01", context="late news")
    assert "**price**: 12" in kb.lookup_fact("price") and "**price**: 11" in kb.lookup_fact("price", as_of="2024-02-10")
    assert kb.lookup_fact("none") == 'No fact found for key "none".'
    assert kb.search_facts(search_text="PRICE").startswith("Found 1 fact(s)") and kb.search_facts(current_only=False).startswith("Found 3")
    assert "**Facts** (current)\n1. [d/c] price = 12" in kb.search_context("d/c - price: 12", min_similarity=0.99)
    assert "Total captures: 2\nTotal active facts: 1" in kb.context_stats()


def test_documents(kb, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("---\ntype: note\n---\n# Title\n" + "Some text that is long enough. " * 20)
    (docs / "b.txt").write_text("Plain paragraphs of some length. " * 20)
    (docs / "tiny.txt").write_text("no")
    assert kb.ingest_document(str(tmp_path / "nope")) == f"File not found: {tmp_path}/nope"
    assert kb.ingest_document(str(docs), dry_run=True).startswith("[DRY RUN] Ingested directory") and "Total captures: 0" in kb.context_stats()
    assert "2 ingested, 0 skipped, 1 failed\nTotal chunks: 2" in kb.ingest_document(str(docs), domain="project")
    assert "0 ingested, 3 skipped, 0 failed" in kb.ingest_document(str(docs))
    rows = {r.source_file.rsplit("/", 1)[1]: r for r in kb.table("captures").collect()}
    assert rows["a.md"].type == "note" and rows["a.md"].source_section == "# Title" and rows["b.txt"].content.startswith("[Source: b.txt]") and rows["b.txt"].topics is None
    (docs / "b.txt").write_text("Other paragraphs of some length. " * 20)
    assert kb.ingest_document(str(docs / "b.txt")).startswith("ingested: ")
    assert "Total captures: 2" in kb.context_stats() and kb.table("capture_embeddings").count() == 2


def test_pulse(kb, tmp_path):
    def put(name, **status):
        os.makedirs(tmp_path / "projects" / name / "github")
        (tmp_path / "projects" / name / "github" / "status.json").write_text(status.pop("raw", None) or json.dumps(status))

    with pytest.raises(FileNotFoundError):
        kb.project_pulse(str(tmp_path))
    os.makedirs(tmp_path / "projects")
    assert json.loads(kb.project_pulse(str(tmp_path)))["data_age_minutes"] == -1
    issue = lambda n, created, updated: {"number": n, "title": f"i{n}", "created_at": created, "updated_at": updated, "labels": ["x"]}
    put(
        "one", repo="one", updated_at="2024-06-01T11:30:00Z", worked_on_recently=True, stale_filtered=2, awaiting_your_review=[{"number": 1, "updated_at": "2024-05-30T00:00:00Z"}],
        recent_activity_on_your_prs=[{"number": 2, "at": "2024-05-31T00:00:00Z"}], recently_merged=[{"number": 3, "merged_at": "2024-05-29T00:00:00Z"}], demoted_reviews=[{"number": 4, "updated_at": "2024-05-30T00:00:00Z"}],
        recent_issues=[issue(5, "2024-05-31T12:00:00Z", "2024-06-01T00:00:00Z"), issue(6, "2024-01-01T00:00:00Z", "2024-05-20T00:00:00Z"), issue(7, "2024-01-01T00:00:00Z", "2024-05-01T00:00:00Z"), issue(8, "bad", "bad")],
    )
    put("two", repo="two", error="no access", updated_at="2020-01-01T00:00:00Z")
    put("broken", raw="{not json")
    put("_hidden", repo="hidden", updated_at="2024-06-01T00:00:00Z")
    p = json.loads(kb.project_pulse(str(tmp_path)))
    assert [x["number"] for x in p["needs_your_action"]] == [2, 1] and [x["activity_type"] for x in p["team_activity"]] == ["review_covered", "merged"]
    assert {x["number"]: (x["is_new"], x["gold"]) for x in p["recent_issues"]} == {5: (True, True), 6: (False, True), 8: (False, True)}
    assert p["stale_filtered"] == 2 and p["data_age_minutes"] == 30 and p["warnings"] == ["two: no access"]
    assert json.loads(kb.project_pulse(str(tmp_path), "absent"))["data_age_minutes"] == 0


def test_bounds(spark, tmp_path):
    kb = open_knowledge_base(spark, f"file://{tmp_path}/kb", domains=["project"], types=["note"], currencies=["EUR"], units=["monthly"])
    for call in (
        lambda: kb.search_context("q", limit=21), lambda: kb.search_context("q", limit=0), lambda: kb.search_context("q", min_similarity=1.1), lambda: kb.search_facts(limit=101),
        lambda: kb.list_recent(limit=51), lambda: kb.list_recent(limit=-1), lambda: kb.lookup_fact("k", domain="other"), lambda: kb.capture_thought("x", type_="poem"),
        lambda: kb.save_fact("project", "c", "k", "v", currency="USD"), lambda: kb.save_fact("project", "c", "k", "v", unit="daily"), lambda: kb.ingest_document("/", domain="other"),
    ):
        with pytest.raises(ValueError):
            call()
    assert kb.capture_thought("x", domain="project", type_="note").startswith("Saved")


def test_issues(kb, spark):
    from notarium import schemas

    long = "This is what the issue is about, in words that are many enough to stand alone as a chunk. " * 4
    issue = lambda n, body, *comments: (n, f"Title {n}", body, None, None, [(("a",), c, "2024-01-01T00:00:00Z") for c in comments])
    rows = [issue(1, long, long + "more"), issue(2, "short"), issue(3, long + "other")]
    first = kb.ingest_issues(spark.createDataFrame(rows, schemas.ISSUE), "o/r")
    assert first == {"total_issues": 3, "ingested": 2, "skipped": 1, "failed": 0, "total_chunks": 3}
    assert kb.ingest_issues(spark.createDataFrame(rows, schemas.ISSUE), "o/r")["skipped"] == 3
    rows[0] = issue(1, long + "changed")
    changed = spark.createDataFrame(rows, schemas.ISSUE)
    assert kb.ingest_issues(changed, "o/r", dry_run=True)["ingested"] == 1 and kb.table("captures").count() == 3
    assert kb.ingest_issues(changed, "o/r")["total_chunks"] == 1
    held = kb.table("captures").collect()
    assert sorted(r.source_file for r in held) == ["github://o/r/issues/1", "github://o/r/issues/3"] and {r.source_type for r in held} == {"github_issue_import"}
    assert any("changed" in r.content for r in held) and kb.table("capture_embeddings").count() == 2


def test_issues_whose_chunks_fail_change_nothing(spark, tmp_path):
    from notarium import schemas

    kb = open_knowledge_base(spark, f"file://{tmp_path}/kb", embedder=lambda texts: [None if "bad" in t else [1.0] * 16 for t in texts])
    words = "These are words of an issue that are enough for one chunk of its own, and then some. " * 4
    rows = [(1, "t", words + "bad", None, None, []), (2, "t", words, None, None, None)]
    got = kb.ingest_issues(spark.createDataFrame(rows, schemas.ISSUE), "o/r")
    assert (got["ingested"], got["failed"], got["total_chunks"]) == (1, 1, 1)
    assert [r.file_path for r in kb.table("sources").collect()] == ["github://o/r/issues/2"]


def test_people_and_vectors(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    old = open_knowledge_base(spark, root, model="old")
    old.save_fact("d", "c", "k", "v", people=["Adam-H", "x"], as_of="2024-01-01")
    old.capture_thought("a thought")
    kb = open_knowledge_base(spark, root, aliases=Aliases.of({"adam": {"aliases": ["Adam-H"]}}))
    assert kb.canonicalise_people(dry_run=True)["facts"] == {"changed": 1, "unchanged": 0} and old.table("fact_saves").first().people == ["adam-h", "x"]
    assert kb.canonicalise_people()["collapsed"] == {"adam": 1} and kb.table("fact_saves").first().people == ["adam", "x"]
    assert kb.fill_vectors() == {"capture_embeddings": (1, 0), "fact_embeddings": (1, 0)} and kb.fill_vectors() == {"capture_embeddings": (0, 0), "fact_embeddings": (0, 0)}
    assert kb.table("capture_embeddings").count() == 2 and "k = v" in kb.search_context("d/c - k: v", min_similarity=0.99)
