"""The knowledge base as tools: arguments in, text out, tables in a Store."""

from __future__ import annotations

import datetime as dt
import json
import os
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.models import Embedder, Extractor, embed_column, hashed_embedder, metadata_column, no_metadata
from ..functions.people import Aliases, canonical_people
from ..functions.text import base_name, embed_text, file_format
from ..operators import chunking, facts, ingest, people, pulse, search
from ..sources.files import front_matter_type, ingest_files, read_statuses, read_texts
from ..sources.tables import Store

#: The most results that each search may be asked for.
MOST = {"search_context": 20, "search_facts": 100, "list_recent": 50}
_NAMES = {"captures": schemas.CAPTURES, "fact_saves": schemas.FACT_SAVES, "capture_embeddings": schemas.embeddings("capture_id"), "fact_embeddings": schemas.embeddings("fact_id"), "sources": schemas.SOURCES}


@F.pandas_udf(T.StringType())
def _own_type(contents: pd.Series) -> pd.Series:
    """The type that front matter names."""
    return contents.map(front_matter_type)


def _writes(method):
    """A tool that reads one version of the store and commits on it."""

    @wraps(method)
    def run(self, *args, **options):
        if self.store.base is not None:
            return method(self, *args, **options)
        with self.store.transaction():
            return method(self, *args, **options)

    return run


class KnowledgeBase:
    """The nine tools over one store.  now() gives the present time in UTC.

    domains, types, currencies and units, where given, are the only ones that the tools take.
    """

    def __init__(
        self, store: Store, *, embedder: Embedder | None = None, extractor: Extractor = no_metadata, aliases: Aliases | None = None, provider_url: str = "local", model: str = "hashed",
        domains: list[str] | None = None, types: list[str] | None = None, currencies: list[str] | None = None, units: list[str] | None = None,
        dimensions: int = 16, now=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
    ):
        self.store, self.spark = store, store.spark
        self.embedder, self.extractor, self.aliases = embedder or hashed_embedder(dimensions), extractor, aliases or Aliases({})
        self.model = {"provider_url": provider_url, "model": model}
        self.dimensions, self.now = dimensions, now
        self.allowed = {"domain": domains, "type": types, "currency": currencies, "unit": units}

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, _NAMES[name])

    def facts(self) -> DataFrame:
        return facts.resolve(self.table("fact_saves"))

    def _today(self) -> str:
        return self.now().date().isoformat()

    def _add_vectors(self, rows: DataFrame, owner: str, id_: str, text) -> DataFrame:
        return rows.select(
            F.col(id_).alias(owner), F.lit(self.model["provider_url"]).alias("provider_url"), F.lit(self.model["model"]).alias("model"), F.lit(self.dimensions).alias("dimensions"),
            embed_column(self.embedder, text).alias("embedding"), F.lit(self.now()).alias("created_at"),
        ).where("embedding IS NOT NULL")

    def _check(self, tool: str = "", limit: int | None = None, **values: str | None) -> None:
        """An error for what is out of bounds."""
        if limit is not None and not 1 <= limit <= MOST[tool]:
            raise ValueError(f"limit must be from 1 to {MOST[tool]}, not {limit}")
        for name, value in values.items():
            if value is not None and self.allowed[name] and value not in self.allowed[name]:
                raise ValueError(f"{name} must be one of {', '.join(self.allowed[name])}, not {value!r}")

    # -- reading

    def search_context(self, query: str, domain: str | None = None, limit: int | None = None, min_similarity: float | None = None) -> str:
        self._check("search_context", limit, domain=domain)
        q, least = self.embedder([query])[0], 0.3 if min_similarity is None else min_similarity
        if not 0 <= least <= 1:
            raise ValueError(f"min_similarity must be from 0 to 1, not {least}")
        options = {"domain": domain, "min_similarity": least, **self.model}
        found = search.top_facts(self.facts(), self.table("fact_embeddings"), q, **options).orderBy(F.col("similarity").desc(), "id").collect()
        held = search.top_captures(self.table("captures"), self.table("capture_embeddings"), q, limit=limit, **options).orderBy(F.col("similarity").desc(), "id").collect()
        parts = []
        if found:
            lines = [f"{i}. [{r.domain}/{r.category}] {r.key} = {r.value}  (as of {r.as_of} · {r.similarity * 100:.1f}% match)" + (f"\n   {r.context}" if r.context else "") for i, r in enumerate(found, 1)]
            parts.append("**Facts** (current)\n" + "\n".join(lines))
        if held:
            names = lambda x: ", ".join(x or []) or "none"
            lines = [
                f"**{i}. [{r.domain}/{r.type}] ({r.similarity * 100:.1f}% match)**\n{r.content}\n_Topics: {names(r.topics)} | People: {names(r.people)} | Source: {r.source_file or 'capture'}_"
                for i, r in enumerate(held, 1)
            ]
            parts.append("**Captures**\n" + "\n\n---\n\n".join(lines))
        return "\n\n---\n\n".join(parts) or "No matching captures or facts found."

    def lookup_fact(self, key: str, domain: str | None = None, as_of: str | None = None) -> str:
        self._check(domain=domain)
        f = facts.lookup(self.facts(), key, as_of=as_of or self._today(), domain=domain).first()
        if f is None:
            return f'No fact found for key "{key}".'
        more = [f"{label}: {v}" for label, v in (("Currency", f.currency), ("Unit", f.unit), ("Context", f.context)) if v]
        return "\n".join([f"**{f.key}**: {f.value}", *more, f"As of: {f.as_of}", f"Domain: {f.domain} / {f.category}"])

    def search_facts(self, domain: str | None = None, category: str | None = None, search_text: str | None = None, current_only: bool = True, limit: int | None = None) -> str:
        self._check("search_facts", limit, domain=domain)
        rows = search.search_facts(self.facts(), domain=domain, category=category, search=search_text, current_only=current_only, limit=limit).collect()
        if not rows:
            return "No facts found matching criteria."
        line = lambda f: f"**{f.domain}/{f.category}** — {f.key}: {f.value}" + (f" {f.currency}" if f.currency else "") + (f" ({f.unit})" if f.unit else "") + f" [as of {f.as_of}]" + (f"\n  _{f.context}_" if f.context else "")
        return f"Found {len(rows)} fact(s):\n\n" + "\n".join(map(line, rows))

    def list_recent(self, limit: int | None = None, domain: str | None = None, since: str | None = None) -> str:
        self._check("list_recent", limit, domain=domain)
        rows = search.list_recent(self.table("captures"), domain=domain, since=since, limit=limit).collect()
        day = lambda t: f"{t.month}/{t.day}/{t.year}" if t else ""
        lines = [f"**{i}. #{r.id}** [{r.domain}/{r.type}] — {day(r.captured_at)}\n{r.content[:200]}{'...' if len(r.content) > 200 else ''}" for i, r in enumerate(rows, 1)]
        return "\n\n".join(lines) or "No recent captures found."

    def context_stats(self) -> str:
        captures, current = self.table("captures"), self.facts().where("valid_until IS NULL")
        t = search.totals(captures, self.facts()).first()
        lines = lambda df: "\n".join(f"  {'null' if r.domain is None else r.domain}: {r['count']}" for r in search.count_by_domain(df).collect()) or "  (none)"
        return "\n".join([
            "**Knowledge Base Stats**", f"Total captures: {t.captures}", f"Total active facts: {t.current_facts}", f"Last capture: {t.latest or 'never'}",
            "", "**Captures by domain:**", lines(captures), "", "**Facts by domain:**", lines(current),
        ])

    def project_pulse(self, root: str, repo: str | None = None) -> str:
        return json.dumps(pulse.project_pulse(read_statuses(self.spark, root), self.now().isoformat(), repo), indent=2, default=str)

    # -- writing

    @_writes
    def capture_thought(self, content: str, domain: str | None = None, type_: str | None = None) -> str:
        self._check(domain=domain, type=type_)
        captures = self.table("captures")
        one = self.spark.createDataFrame([(content,)], "content string")
        if found := captures.join(one.select(F.sha2("content", 256).alias("content_hash")), "content_hash", "left_semi").select("id").first():
            return f"This thought already exists (capture #{found.id}). Skipped."
        columns = ingest.interactive_capture(F.col("content"), F.col("_m"), F.lit(domain).cast("string"), F.lit(type_).cast("string"))
        row = one.withColumn("_m", metadata_column(self.extractor, F.col("content"))).select(*[c.alias(n) for n, c in columns.items()], F.lit(self.now()).cast("timestamp").alias("captured_at"))
        row = ingest.next_ids(captures, row.withColumn("people", canonical_people(F.col("people"), self.aliases)), ["content_hash"])
        new = self._conform(row, schemas.CAPTURES)
        saved = new.first()
        fixed = self.spark.createDataFrame([saved], schemas.CAPTURES)
        vectors = self._add_vectors(fixed, "capture_id", "id", F.col("content"))
        self.store.commit(captures=captures.unionByName(fixed), capture_embeddings=ingest.insert_embeddings(self.table("capture_embeddings"), vectors, "capture_id"))
        names = lambda x: ", ".join(x or []) or "none"
        todo = f"\nAction items: {'; '.join(saved.action_items)}" if saved.action_items else ""
        return f"Saved capture #{saved.id} at {saved.captured_at}\nDomain: {saved.domain} | Type: {saved.type}\nTopics: {names(saved.topics)}\nPeople: {names(saved.people)}{todo}"

    @_writes
    def save_fact(self, domain: str, category: str, key: str, value: str, *, value_numeric: float | None = None, currency: str | None = None, unit: str | None = None, context: str | None = None, people: list[str] | None = None, as_of: str | None = None) -> str:
        self._check(domain=domain, currency=currency, unit=unit)
        log = self.table("fact_saves")
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
        when = dt.date.fromisoformat(as_of or self._today())
        names = self.spark.createDataFrame([(people or [],)], "p array<string>").select(canonical_people(F.col("p"), self.aliases)).first()[0]
        row = self.spark.createDataFrame([(seq, domain, category, key, value, value_numeric, currency, unit, context, names or None, when, self.now())], schemas.FACT_SAVES)
        after = log.unionByName(row)
        same = after.where((F.col("domain") == domain) & (F.col("category") == category) & (F.col("key") == key) & (F.col("as_of") == F.lit(when)))
        id_ = same.agg(F.min("seq")).first()[0]
        text = f"{domain}/{category} - {key}: {value}" + (f"\n{context}" if context else "")
        vector = self._add_vectors(self.spark.createDataFrame([(id_, text)], "id long, t string"), "fact_id", "id", F.col("t")).withColumn("_s", F.lit(seq))
        self.store.commit(fact_saves=after, fact_embeddings=ingest.upsert_embeddings(self.table("fact_embeddings"), vector, "fact_id", "_s"))
        tail = f"\nPeople: {', '.join(names)}" if names else ""
        return f"Saved fact #{id_}: {domain}/{category}/{key} = {value}{f' {currency}' if currency else ''} (as of {when}){tail}"

    def ingest_document(self, path: str, domain: str | None = None, recursive: bool = False, dry_run: bool = False) -> str:
        self._check(domain=domain)
        if not os.path.exists(path):
            return f"File not found: {path}"
        mark = "[DRY RUN] " if dry_run else ""
        if os.path.isfile(path):
            (r,) = self.ingest_paths([path], domain, dry_run)
            failed = f" ({r['failed']} failed)" if r["failed"] else ""
            again = f" ({r['duplicates']} duplicate)" if r["duplicates"] else ""
            return f"{mark}{r['status']}: {r['path']}\nChunks: {r['chunks']}{failed}{again}" + (f"\nError: {r['error']}" if r.get("error") else "")
        rows = self.ingest_paths(ingest_files(path, recursive), domain, dry_run)
        count = lambda s: sum(r["status"] == s for r in rows)
        total = sum(r["chunks"] - r["failed"] - r["duplicates"] for r in rows if r["status"] == "ingested")
        partial = [f"  {r['path']}: {r['failed']}/{r['chunks']} chunks failed" for r in rows if r["failed"]]
        return f"{mark}Ingested directory: {path}\nFiles: {count('ingested')} ingested, {count('skipped')} skipped, {count('failed')} failed\nTotal chunks: {total}" + ("\n\nPartial failures:\n" + "\n".join(partial) if partial else "")

    def chunk_files(self, files: DataFrame) -> DataFrame:
        """(file_path, file_hash, format, own_type, chunk_index, content, section) of files (file_path, content, file_hash)."""
        rows = files.withColumns({"format": file_format(F.col("file_path")), "own_type": _own_type(F.col("content"))})
        md = chunking.markdown_chunks(rows.where("format = 'markdown'"))
        plain = rows.where("format = 'text'").withColumn("chunks", F.transform(chunking.text_chunks(F.col("content"), base_name(F.col("file_path"))), lambda c: F.struct(c.alias("content"), F.lit(None).cast("string").alias("heading"))))
        both = md.unionByName(plain.withColumn("own_type", F.lit(None).cast("string"))).select("file_path", "file_hash", "format", "own_type", "chunks")
        return chunking.numbered(both).select("file_path", "file_hash", "format", "own_type", "chunk_index", F.col("chunk.content").alias("content"), F.col("chunk.heading").alias("section"))

    @_writes
    def ingest_paths(self, paths: list[str], domain: str | None = None, dry_run: bool = False) -> list[dict]:
        """Ingest files whose hash changed; one result for each path.  Only paths and counts reach the driver."""
        unknown = [p for p in paths if p.rpartition(".")[2].lower() not in ("md", "markdown", "txt")]
        known = [p for p in paths if p not in unknown]
        out = [{"path": p, "status": "failed", "chunks": 0, "failed": 0, "duplicates": 0, "error": "no reader for this format"} for p in unknown]
        if not known:
            return out
        checked = ingest.changed_sources(read_texts(self.spark, known), self.table("sources").select("file_path", "file_hash"))
        status = {r.file_path: r for r in checked.select("file_path", "file_hash", "status").collect()}
        out += [{"path": p, "status": "skipped", "chunks": 0, "failed": 0, "duplicates": 0} for p, r in status.items() if r.status == "unchanged"]
        work = [p for p, r in status.items() if r.status != "unchanged"]
        if not work:
            return out
        chunks = self.chunk_files(checked.where("status <> 'unchanged'"))
        # the models run once; what they said is written down before it is used several times
        rows = self.store.stage(chunks.withColumns({"_v": embed_column(self.embedder, F.col("content")), "_m": metadata_column(self.extractor, F.col("content"))}))
        made = {r.file_path: r for r in rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v").isNull()).alias("bad")).collect()}
        counts = {p: (made[p].n, made[p].bad) if p in made else (0, 0) for p in work}
        if dry_run:
            return out + [{"path": p, "status": "ingested", "chunks": n, "failed": 0, "duplicates": 0} for p, (n, _) in counts.items()]
        captures = self.table("captures")
        columns = ingest.document_capture(F.col("content"), F.col("_m"), F.lit(domain).cast("string"), F.col("own_type"), F.concat("format", F.lit("_import")))
        good = rows.where("_v IS NOT NULL").withColumn("_m", F.col("_m").withField("people", canonical_people(F.col("_m.people"), self.aliases)))
        batch = good.select(*[c.alias(n) for n, c in columns.items()], F.col("file_path").alias("source_file"), F.col("section").alias("source_section"), "chunk_index", F.lit(self.now()).cast("timestamp").alias("captured_at"), "_v")
        replaced = self.table("sources").select(F.col("file_path").alias("source_file")).where(F.col("source_file").isin(work))
        kept = captures.join(replaced, "source_file", "left_anti").select(*captures.columns)
        new = ingest.next_ids(captures, ingest.new_captures(kept, batch, ["source_file", "chunk_index"]), ["source_file", "chunk_index"]).persist()
        stored = {r.source_file: r["count"] for r in new.groupBy("source_file").count().collect()}
        results = []
        for p, (n, bad) in counts.items():
            results.append({"path": p, "status": "failed" if n == bad else "ingested", "chunks": n, "failed": bad, "duplicates": n - bad - stored.get(p, 0)})
        # a file all of whose chunks failed changes nothing; one without any chunk is remembered
        done = [r for r in results if r["chunks"] == 0 or r["failed"] < r["chunks"]]
        sources = self.spark.createDataFrame([(r["path"], status[r["path"]].file_hash, self.now(), stored.get(r["path"], 0), 1) for r in done], "file_path string, file_hash string, last_imported timestamp, capture_count int, _s int")
        vectors = new.select(F.col("id").alias("capture_id"), F.lit(self.model["provider_url"]).alias("provider_url"), F.lit(self.model["model"]).alias("model"), F.lit(self.dimensions).alias("dimensions"), F.col("_v").alias("embedding"), F.lit(self.now()).cast("timestamp").alias("created_at"))
        after = kept.unionByName(self._conform(new, schemas.CAPTURES))
        self.store.commit(
            captures=after, sources=self._conform(ingest.upsert_sources(self.table("sources"), sources, "_s"), schemas.SOURCES),
            capture_embeddings=ingest.insert_embeddings(ingest.surviving_embeddings(self.table("capture_embeddings"), after, "capture_id"), vectors, "capture_id"),
        )
        new.unpersist()
        return out + results

    @_writes
    def ingest_issues(self, issues: DataFrame, repo: str, domain: str | None = None, dry_run: bool = False) -> dict:
        """Ingest issues (number, title, body, comments) whose body or comments changed: counters of the run.

        Old captures of a changed issue go, in the same commit as its new ones come in; an issue all of whose chunks failed
        changes nothing.
        """
        self._check(domain=domain)
        checked = ingest.checked_issues(issues, repo, self.table("sources").select("file_path", "file_hash"))
        work = self.store.stage(checked.select("file_path", "file_hash", "status", "chunks"))
        if dry_run:
            none = work.select("file_path", F.lit(0).alias("failed")).where("false")
            return ingest.issue_counters(ingest.issue_results(work, none)).first().asDict()
        chunks = work.where("status <> 'skipped'").select("file_path", F.posexplode("chunks").alias("chunk_index", "content"))
        rows = self.store.stage(chunks.withColumns({"_v": embed_column(self.embedder, F.col("content")), "_m": metadata_column(self.extractor, F.col("content"))}))
        prepared = rows.groupBy("file_path").agg(F.count_if(F.col("_v").isNull()).cast("int").alias("failed"))
        results = self.store.stage(ingest.issue_results(work, prepared))
        done = results.where("status = 'ingested'").select("file_path")
        captures = self.table("captures")
        good = rows.where("_v IS NOT NULL").join(done, "file_path", "left_semi").withColumn("_m", F.col("_m").withField("people", canonical_people(F.col("_m.people"), self.aliases)))
        columns = ingest.document_capture(F.col("content"), F.col("_m"), F.lit(domain).cast("string"), F.lit(None).cast("string"), F.lit("github_issue_import"))
        batch = good.select(*[c.alias(n) for n, c in columns.items()], F.col("file_path").alias("source_file"), "chunk_index", F.lit(self.now()).cast("timestamp").alias("captured_at"), "_v")
        known = self.table("sources").join(done, "file_path", "left_semi").select(F.col("file_path").alias("source_file"))
        kept = captures.join(known, "source_file", "left_anti").select(*captures.columns)
        new = self.store.stage(ingest.next_ids(captures, ingest.new_captures(kept, batch, ["source_file", "chunk_index"]), ["source_file", "chunk_index"]))
        after = kept.unionByName(self._conform(new, schemas.CAPTURES))
        count = (F.size("chunks") - F.coalesce("failed", F.lit(0))).cast("int").alias("capture_count")
        sources = work.join(done, "file_path", "left_semi").join(prepared, "file_path", "left").select("file_path", "file_hash", F.lit(self.now()).cast("timestamp").alias("last_imported"), count, F.lit(1).alias("_s"))
        vectors = new.select(F.col("id").alias("capture_id"), F.lit(self.model["provider_url"]).alias("provider_url"), F.lit(self.model["model"]).alias("model"), F.lit(self.dimensions).alias("dimensions"), F.col("_v").alias("embedding"), F.lit(self.now()).cast("timestamp").alias("created_at"))
        self.store.commit(
            captures=after, sources=self._conform(ingest.upsert_sources(self.table("sources"), sources, "_s"), schemas.SOURCES),
            capture_embeddings=ingest.insert_embeddings(ingest.surviving_embeddings(self.table("capture_embeddings"), after, "capture_id"), vectors, "capture_id"),
        )
        return ingest.issue_counters(results).first().asDict()

    @_writes
    def canonicalise_people(self, dry_run: bool = False) -> dict:
        """Rewrite the people of captures and facts to canonical names: how many rows change, and what collapses into what."""
        out, tables, collapsed = {}, {}, {}
        for name, label in (("captures", "captures"), ("fact_saves", "facts")):
            rows = self.table(name)
            changed = people.rewrite(rows, self.aliases)
            counts = {r.changed: r["count"] for r in people.change_counts(changed).collect()}
            out[label] = {"changed": counts.get(True, 0), "unchanged": counts.get(False, 0)}
            for r in people.collapse_counts(changed.where("changed"), self.aliases).collect():
                collapsed[r.canonical] = collapsed.get(r.canonical, 0) + r["count"]
            new = F.when(F.size("people") > 0, canonical_people(F.col("people"), self.aliases)).otherwise(F.col("people"))
            tables[name] = self._conform(rows.withColumn("people", new), _NAMES[name])
        if not dry_run and any(x["changed"] for x in out.values()):
            self.store.commit(**tables)
        return {**out, "collapsed": dict(sorted(collapsed.items(), key=lambda x: (-x[1], x[0])))}

    @_writes
    def fill_vectors(self, limit: int | None = None) -> dict:
        """Make the vectors that captures and current facts lack for the model in use: (done, failed) of each."""
        out, tables = {}, {}
        current = self.facts().where("valid_until IS NULL")
        text = embed_text(*(F.col(c) for c in ("domain", "category", "key", "value", "context")), backfill=True)
        for table, owner, rows, what in (("capture_embeddings", "capture_id", self.table("captures"), F.col("content")), ("fact_embeddings", "fact_id", current, text)):
            missing = search.missing_embeddings(rows, self.table(table), owner, limit=limit or 0, **self.model)
            made = self.store.stage(missing.select("id", embed_column(self.embedder, what).alias("embedding")))
            counts = made.agg(F.count("embedding").alias("done"), F.count_if(F.col("embedding").isNull()).alias("failed")).first()
            out[table] = (counts.done, counts.failed)
            vectors = made.where("embedding IS NOT NULL").select(F.col("id").alias(owner), F.lit(self.model["provider_url"]).alias("provider_url"), F.lit(self.model["model"]).alias("model"), F.lit(self.dimensions).alias("dimensions"), "embedding", F.lit(self.now()).cast("timestamp").alias("created_at"))
            tables[table] = ingest.insert_embeddings(self.table(table), vectors, owner)
        if any(d for d, _ in out.values()):
            self.store.commit(**tables)
        return out

    @staticmethod
    def _conform(df: DataFrame, schema) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.parsed(schema).fields])


def open_knowledge_base(spark: SparkSession, root: str, **options) -> KnowledgeBase:
    return KnowledgeBase(Store(spark, root), **options)
