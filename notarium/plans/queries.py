"""One registered query for each operator over the benchmark tables, and the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as tx
from ..functions.people import Aliases
from ..functions.vectors import checked_dimensions, cosine_similarity, parse_vector
from ..operators import chunking, facts, ingest, people, pulse, search, sync
from . import datasets as ds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SCORED = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) AS sim FROM embeddings, q)
"""
_MODEL = {"provider_url": ds.URL, "model": ds.MODEL}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("similarity", 6).alias("similarity"))


@query(_SCORED + """SELECT d.doc_id AS id, d.lang AS domain, d.source AS source_file, round(s.sim, 6) AS similarity
FROM s JOIN documents d ON d.doc_id = s.vec_id WHERE s.sim >= 0.3 ORDER BY s.sim DESC, d.doc_id LIMIT 5""")
def semantic_topk(spark, sf_dir):
    out = search.top_captures(ds.captures(spark, sf_dir), ds.capture_embeddings(spark, sf_dir), ds.query_vector(spark, sf_dir), **_MODEL)
    return _rounded(out, "id", "domain", "source_file")


@query(_SCORED + """SELECT d.doc_id AS id, d.lang AS domain, d.source AS source_file, round(s.sim, 6) AS similarity
FROM s JOIN documents d ON d.doc_id = s.vec_id WHERE s.sim >= 0.1 AND d.lang = 'en' ORDER BY s.sim DESC, d.doc_id LIMIT 20""")
def semantic_topk_domain(spark, sf_dir):
    out = search.top_captures(ds.captures(spark, sf_dir), ds.capture_embeddings(spark, sf_dir), ds.query_vector(spark, sf_dir), domain="en", limit=99, min_similarity=0.1, **_MODEL)
    return _rounded(out, "id", "domain", "source_file")


@query(_SCORED + """SELECT * FROM (SELECT 'fact' AS store, p.p_partkey AS id, round(s.sim, 6) AS similarity FROM s JOIN part p ON p.p_partkey = s.vec_id
  WHERE s.sim >= 0.1 ORDER BY s.sim DESC, p.p_partkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'capture' AS store, d.doc_id AS id, round(s.sim, 6) AS similarity FROM s JOIN documents d ON d.doc_id = s.vec_id
  WHERE s.sim >= 0.1 ORDER BY s.sim DESC, d.doc_id LIMIT 5)""")
def semantic_two_store(spark, sf_dir):
    q = ds.query_vector(spark, sf_dir)
    a = search.top_facts(ds.parts_as_facts(spark, sf_dir), ds.capture_embeddings(spark, sf_dir, "fact_id"), q, min_similarity=0.1, **_MODEL)
    b = search.top_captures(ds.captures(spark, sf_dir), ds.capture_embeddings(spark, sf_dir), q, min_similarity=0.1, **_MODEL)
    both = [df.select(F.lit(n).alias("store"), "id", F.round("similarity", 6).alias("similarity")) for n, df in (("fact", a), ("capture", b))]
    return both[0].unionByName(both[1])


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS similarity, len(embedding) AS dimensions FROM embeddings")
def vector_functions(spark, sf_dir):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    v = checked_dimensions(parse_vector(text), ds.DIMENSIONS)
    rows = ds.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(cosine_similarity(F.col("v"), F.reverse("v")), 6).alias("similarity"), F.size("v").cast("long").alias("dimensions"))


@query("SELECT doc_id AS id, lang AS domain FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def missing_embeddings(spark, sf_dir):
    return search.missing_embeddings(ds.captures(spark, sf_dir), ds.capture_embeddings(spark, sf_dir), "capture_id", **_MODEL).select("id", "domain")


@query("SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) ORDER BY doc_id LIMIT 25")
def missing_embeddings_limit(spark, sf_dir):
    return search.missing_embeddings(ds.captures(spark, sf_dir), ds.capture_embeddings(spark, sf_dir), "capture_id", limit=25, **_MODEL).select("id")


_FACTS = """
WITH saves AS (
  SELECT (event_id * 7919) % 1000003 AS seq, event_type AS domain, 'metric' AS category, CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS as_of, value AS value_numeric, props AS value FROM events),
a AS (SELECT *, max(as_of) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM saves),
b AS (SELECT *, pm IS NULL OR as_of >= pm AS leads FROM a),
c AS (SELECT *, CASE WHEN leads THEN lead(as_of) OVER (PARTITION BY key, leads ORDER BY seq) ELSE pm END AS valid_until FROM b),
d AS (SELECT *, min(seq) OVER (PARTITION BY domain, category, key, as_of) AS id, row_number() OVER (PARTITION BY domain, category, key, as_of ORDER BY seq DESC) AS r FROM c),
facts AS (SELECT id, domain, category, key, value, value_numeric, as_of, valid_until FROM d WHERE r = 1)
"""


def _facts(spark, sf_dir):
    return facts.resolve(ds.fact_saves(spark, sf_dir), ties=("event_id",))


@query(_FACTS + "SELECT id, domain, category, key, value, value_numeric, as_of, valid_until FROM facts")
def facts_resolved(spark, sf_dir):
    return _facts(spark, sf_dir).select("id", "domain", "category", "key", "value", "value_numeric", "as_of", "valid_until")


@query(_FACTS + "SELECT id, domain, key, as_of FROM facts WHERE valid_until IS NULL")
def facts_current(spark, sf_dir):
    return _facts(spark, sf_dir).where("valid_until IS NULL").select("id", "domain", "key", "as_of")


@query(_FACTS + """, n AS (SELECT *, lead(id) OVER w AS next_id, lead(as_of) OVER w AS next_as_of FROM facts WHERE valid_until IS NULL OR valid_until > as_of WINDOW w AS (PARTITION BY key ORDER BY as_of, id))
SELECT key, id, as_of, valid_until, next_id, next_as_of FROM n WHERE next_id IS NOT NULL AND (valid_until IS NULL OR valid_until > next_as_of)""")
def facts_history_overlap(spark, sf_dir):
    return facts.overlapping_history(_facts(spark, sf_dir))


@query(_FACTS + "SELECT id, domain, key, as_of, valid_until FROM facts WHERE key = '7' AND as_of <= DATE '2024-01-15' AND (valid_until IS NULL OR valid_until > DATE '2024-01-15') ORDER BY as_of DESC, id LIMIT 1")
def fact_lookup_asof(spark, sf_dir):
    return facts.lookup(_facts(spark, sf_dir), "7", as_of="2024-01-15").select("id", "domain", "key", "as_of", "valid_until")


@query(_FACTS + """SELECT probe_id, key, probe_date, id, domain, as_of FROM (
  SELECT p.c_custkey AS probe_id, f.key, p.probe_date, f.id, f.domain, f.as_of, row_number() OVER (PARTITION BY p.c_custkey ORDER BY f.as_of DESC, f.id) AS r
  FROM (SELECT c_custkey, CAST(c_custkey % 150 AS VARCHAR) AS key, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS probe_date FROM customer) p
  JOIN facts f ON f.key = p.key AND f.as_of <= p.probe_date AND (f.valid_until IS NULL OR f.valid_until > p.probe_date)) WHERE r = 1""")
def fact_lookup_batch(spark, sf_dir):
    probes = ds.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("probe_id"), (F.col("c_custkey") % 150).cast("string").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("at"),
    )
    return facts.lookup_many(_facts(spark, sf_dir), probes).select("probe_id", "key", F.col("at").alias("probe_date"), "id", "domain", "as_of")


@query(_FACTS + "SELECT f.id, f.key FROM facts f WHERE valid_until IS NULL AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = f.id)")
def fact_missing_embeddings(spark, sf_dir):
    current = _facts(spark, sf_dir).where("valid_until IS NULL")
    return search.missing_embeddings(current, ds.capture_embeddings(spark, sf_dir, "fact_id"), "fact_id", **_MODEL).select("id", "key")


@query(r"""
WITH s AS (SELECT p_partkey AS id, p_brand AS domain, p_name AS key, DATE '2024-01-01' + CAST(p_partkey % 365 AS INTEGER) AS as_of, CAST(p_size AS VARCHAR) AS category,
  CASE WHEN p_name ILIKE '%e_%' ESCAPE '\' THEN 3 WHEN p_type ILIKE '%e_%' ESCAPE '\' THEN 2 WHEN p_brand ILIKE '%e_%' ESCAPE '\' THEN 1 ELSE 0 END
  + CASE WHEN p_name ILIKE '%steel%' THEN 3 WHEN p_type ILIKE '%steel%' THEN 2 WHEN p_brand ILIKE '%steel%' THEN 1 ELSE 0 END AS score FROM part)
SELECT id, domain, key, score FROM s WHERE score > 0 ORDER BY score DESC, as_of DESC, domain, category, key, id LIMIT 100""")
def fact_search_scored(spark, sf_dir):
    return search.search_facts(ds.parts_as_facts(spark, sf_dir), search=" e_  STEEL ", limit=500).select("id", "domain", "key", "score")


@query("SELECT p_partkey AS id, p_brand AS domain, p_name AS key FROM part ORDER BY p_brand, CAST(p_size AS VARCHAR), p_name, DATE '2024-01-01' + CAST(p_partkey % 365 AS INTEGER) DESC, p_partkey LIMIT 20")
def fact_search_unscored(spark, sf_dir):
    return search.search_facts(ds.parts_as_facts(spark, sf_dir), domain="").select("id", "domain", "key")


@query("SELECT o_orderkey AS id, o_orderstatus AS domain, o_orderdate AS captured_at FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50")
def recent_captures(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("domain"), F.col("o_orderdate").alias("captured_at"))
    return search.list_recent(rows, domain="O", since="1995-01-01", limit=80)


@query("SELECT lang AS domain, count(*) AS count FROM documents GROUP BY lang")
def stats_by_domain(spark, sf_dir):
    return search.count_by_domain(ds.captures(spark, sf_dir))


@query(_FACTS + "SELECT domain, count(*) AS count FROM facts WHERE valid_until IS NULL GROUP BY domain")
def stats_facts_by_domain(spark, sf_dir):
    return search.count_by_domain(_facts(spark, sf_dir).where("valid_until IS NULL"))


@query(_FACTS + "SELECT (SELECT count(*) FROM orders) AS captures, (SELECT count(*) FROM facts WHERE valid_until IS NULL) AS current_facts, (SELECT max(o_orderdate) FROM orders) AS latest")
def stats_totals(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("captured_at"))
    return search.totals(rows, _facts(spark, sf_dir))


@query("SELECT min(doc_id) AS id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def hash_dedup(spark, sf_dir):
    return ds.captures(spark, sf_dir).groupBy("content_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 1
  AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY sha256(text)""")
def insert_if_absent(spark, sf_dir):
    """Odd documents as a batch against a table of the even ones."""
    rows = ds.captures(spark, sf_dir)
    return ingest.new_captures(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["id"]).select("id", "content_hash")


@query("SELECT source AS source_file, count(*) AS captures_deleted FROM documents WHERE source IN ('src1', 'src2') GROUP BY source")
def delete_by_source(spark, sf_dir):
    sources = ds.captures(spark, sf_dir).select(F.col("source_file").alias("file_path")).distinct()
    return ingest.delete_by_source(ds.captures(spark, sf_dir), sources, sources.where("file_path IN ('src1', 'src2')"))[2]


@query("SELECT doc_id AS id, source AS source_file FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_by_source_survivors(spark, sf_dir):
    sources = ds.captures(spark, sf_dir).select(F.col("source_file").alias("file_path")).distinct()
    return ingest.delete_by_source(ds.captures(spark, sf_dir), sources, sources.where("file_path IN ('src1', 'src2')"))[0].select("id", "source_file")


@query("SELECT vec_id AS capture_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2'))")
def cascade_survivors(spark, sf_dir):
    left = ds.captures(spark, sf_dir).where("source_file NOT IN ('src1', 'src2')")
    return ingest.surviving_embeddings(ds.capture_embeddings(spark, sf_dir), left, "capture_id").select("capture_id")


@query("""WITH old AS (SELECT doc_id AS id, text, source FROM documents),
new AS (SELECT doc_id + 1000000 AS id, text || CASE WHEN source IN ('src1', 'src4') THEN '!' ELSE '' END AS text, source FROM documents),
kept AS (SELECT * FROM old WHERE source = 'src4' OR source IS NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, id) AS r FROM new)
SELECT id, source AS source_file, sha256(text) AS content_hash FROM kept
UNION ALL SELECT id, source, sha256(text) FROM firsts WHERE r = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM kept)""")
def replace_on_change(spark, sf_dir):
    """Every document again, some changed, against a table of all; one source is not known yet, so its rows stay."""
    rows = ds.captures(spark, sf_dir)
    old = rows.select("id", "source_file", "content_hash")
    text = F.concat("content", F.when(F.col("source_file").isin("src1", "src4"), "!").otherwise(""))
    new = rows.select((F.col("id") + 1000000).alias("id"), "source_file", F.sha2(text, 256).alias("content_hash"), F.col("id").alias("chunk_index"))
    known = old.select(F.col("source_file").alias("file_path")).where("file_path <> 'src4'").distinct()
    return ingest.replace_changed(old, new, known).select("id", "source_file", "content_hash")


@query("""WITH f AS (SELECT source AS file_path, sha256(string_agg(lang, ',' ORDER BY doc_id)) AS file_hash FROM documents GROUP BY source)
SELECT file_path, CASE WHEN file_path IN ('src1', 'src2') THEN 'new' WHEN file_path IN ('src3', 'src4') THEN 'changed' ELSE 'unchanged' END AS status FROM f""")
def source_hash_status(spark, sf_dir):
    langs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))), lambda x: x["lang"]), ",")
    files = ds.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file_path")).agg(F.sha2(langs, 256).alias("file_hash"))
    known = files.where("file_path NOT IN ('src1', 'src2')").withColumn("file_hash", F.when(F.col("file_path").isin("src3", "src4"), "old").otherwise(F.col("file_hash")))
    return ingest.changed_sources(files, known).select("file_path", "status")


@query("""SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.file_hash, o.file_hash) AS file_hash, coalesce(n.capture_count, o.capture_count) AS capture_count FROM
(SELECT source AS file_path, 'old' AS file_hash, count(*) AS capture_count FROM documents GROUP BY source) o
FULL JOIN (SELECT CASE WHEN source < 'src2' THEN source || '-new' ELSE source END AS file_path, CAST(max(doc_id) AS VARCHAR) AS file_hash, max_by(n_chars, doc_id) AS capture_count
  FROM documents GROUP BY 1) n ON o.file_path = n.file_path""")
def source_upsert(spark, sf_dir):
    """All documents' sources as a table, and all documents as a batch in which some sources are new."""
    docs = ds.table(spark, sf_dir, "documents")
    old = docs.groupBy(F.col("source").alias("file_path")).agg(F.lit("old").alias("file_hash"), F.count(F.lit(1)).alias("capture_count"))
    path = F.when(F.col("source") < "src2", F.concat("source", F.lit("-new"))).otherwise(F.col("source"))
    batch = docs.select(path.alias("file_path"), F.col("doc_id").cast("string").alias("file_hash"), F.col("n_chars").alias("capture_count"), F.col("doc_id").alias("seq"))
    return ingest.upsert_sources(old, batch, "seq").select("file_path", "file_hash", "capture_count")


@query("""SELECT vec_id AS capture_id, CASE WHEN vec_id % 3 = 0 THEN 32 ELSE 64 END AS dimensions FROM embeddings
UNION ALL SELECT vec_id + 1000000, 32 FROM embeddings WHERE vec_id % 3 <> 0""")
def embedding_upsert(spark, sf_dir):
    """Every vector as state and, halved, as batch; a third of the batch has the state's keys."""
    rows = ds.capture_embeddings(spark, sf_dir).withColumn("created_at", F.current_timestamp())
    key = F.when(F.col("capture_id") % 3 == 0, F.col("capture_id")).otherwise(F.col("capture_id") + 1000000)
    batch = rows.withColumns({"embedding": F.slice("embedding", 1, 32), "dimensions": F.lit(32), "seq": F.col("capture_id")}).withColumn("capture_id", key)
    return ingest.upsert_embeddings(rows, batch, "capture_id", "seq").select("capture_id", F.col("dimensions").cast("int").alias("dimensions"))


@query("""SELECT CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + 1000000 END AS capture_id, len(embedding) AS dimensions FROM embeddings
UNION ALL SELECT vec_id, len(embedding) FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 5 <> 4""")
def legacy_embedding_copy(spark, sf_dir):
    """Every vector in an old column, a fifth of them null, against a table that has half of their keys."""
    rows = ds.table(spark, sf_dir, "embeddings")
    old = rows.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 != 4, F.col("embedding")).alias("embedding"))
    key = F.when(F.col("capture_id") % 2 == 0, F.col("capture_id")).otherwise(F.col("capture_id") + 1000000)
    return ingest.legacy_embeddings(old, ds.capture_embeddings(spark, sf_dir).withColumn("capture_id", key), ds.URL, ds.MODEL).select("capture_id", F.col("dimensions").cast("long").alias("dimensions"))


@query("SELECT doc_id + 5000 - (SELECT min(doc_id) FROM documents) + 1 AS new_id, doc_id FROM documents")
def next_ids(spark, sf_dir):
    state = spark.range(5000, 5001).select("id")
    return ingest.next_ids(state, ds.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).select(F.col("id").alias("new_id"), "doc_id")


_PIECES = """range(0, CASE WHEN length({t}) <= 6000 THEN 1 ELSE 1 + CAST(ceil((length({t}) - 6000) / 5200.0) AS BIGINT) END)"""


@query("SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 5200 + 1 AS BIGINT), 6000) AS chunk FROM (SELECT doc_id, text, unnest(" + _PIECES.format(t="text") + ") AS i FROM documents)")
def hard_split_docs(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "documents").select("doc_id", chunking.hard_split(F.col("text")).alias("chunks"))
    return chunking.numbered(rows).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def _emit_sql(full: str, least: int) -> str:
    whole = f"CASE WHEN length(trim({full}, chr(32) || chr(10) || chr(9))) >= {least} THEN [{full}] ELSE [] END" if least else f"[{full}]"
    return f"CASE WHEN length({full}) > 6000 THEN list_transform({_PIECES.format(t=full)}, lambda k: substr({full}, CAST(k * 5200 + 1 AS BIGINT), 6000)) ELSE {whole} END"


@query(f"""
WITH p AS (SELECT doc_id, '[Source: ' || source || ']' || chr(10) || chr(10) AS pre,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, pre, list_reduce(list_transform(ps, lambda x: {{'o': CAST([] AS VARCHAR[]), 'b': x}}), lambda acc, x:
  CASE WHEN length(CASE WHEN len(acc.o) = 0 THEN pre ELSE '' END) + length(CASE WHEN acc.b = '' THEN x.b ELSE acc.b || chr(10) || chr(10) || x.b END) > 6000 AND acc.b <> ''
  THEN {{'o': list_concat(acc.o, {_emit_sql("((CASE WHEN len(acc.o) = 0 THEN pre ELSE '' END) || acc.b)", 200)}), 'b': x.b}}
  ELSE {{'o': acc.o, 'b': CASE WHEN acc.b = '' THEN x.b ELSE acc.b || chr(10) || chr(10) || x.b END}} END,
  {{'o': CAST([] AS VARCHAR[]), 'b': ''}}) AS s FROM p),
c AS (SELECT doc_id, CASE WHEN s.b = '' THEN s.o ELSE list_concat(s.o, {_emit_sql("((CASE WHEN len(s.o) = 0 THEN pre ELSE '' END) || s.b)", 200)}) END AS chunks FROM f)
SELECT doc_id, i - 1 AS chunk_index, chunks[i] AS chunk FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM c)""")
def text_chunks(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "documents").select("doc_id", chunking.text_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.col("source")).alias("chunks"))
    return chunking.numbered(rows).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def _pack_sql(paragraphs: str, pre: str) -> str:
    """Greedy packing with the prefix before each chunk, as a fold."""
    joined = "CASE WHEN acc.b = '' THEN x.b ELSE acc.b || chr(10) || chr(10) || x.b END"
    fold = f"""list_reduce(list_transform({paragraphs}, lambda x: {{'o': CAST([] AS VARCHAR[]), 'b': x}}), lambda acc, x:
      CASE WHEN length({pre}) + length({joined}) > 6000 AND acc.b <> '' THEN {{'o': list_concat(acc.o, {_emit_sql(f"({pre} || acc.b)", 0)}), 'b': x.b}} ELSE {{'o': acc.o, 'b': {joined}}} END,
      {{'o': CAST([] AS VARCHAR[]), 'b': ''}})"""
    return f"list_transform([{fold}], lambda s: CASE WHEN s.b = '' THEN s.o ELSE list_concat(s.o, {_emit_sql(f'({pre} || s.b)', 0)}) END)[1]"


_CRUMBS = """
WITH l AS (SELECT doc_id, i, CASE i % 7 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 3 ELSE 0 END AS lv, x FROM (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
h AS (SELECT doc_id, i, CASE WHEN trim(x) = '' THEN 0 ELSE lv END AS level, trim(x) AS t, CASE WHEN lv > 0 THEN repeat('#', lv) || ' ' ELSE '' END || x AS line FROM l),
m AS (SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS p1, max(CASE WHEN level = 2 THEN i END) OVER w AS p2, max(CASE WHEN level = 3 THEN i END) OVER w AS p3,
  max_by(t, i) FILTER (level = 1) OVER w AS t1, max_by(t, i) FILTER (level = 2) OVER w AS t2, max_by(t, i) FILTER (level = 3) OVER w AS t3, count(*) FILTER (level > 0) OVER w AS sec
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
crumbs AS (SELECT doc_id, i, level, line, sec, concat_ws(' > ', CASE WHEN p1 IS NOT NULL THEN '# ' || t1 END, CASE WHEN p2 > coalesce(p1, 0) THEN '## ' || t2 END,
  CASE WHEN p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) THEN '### ' || t3 END) AS crumb FROM m)
"""
_WS = "chr(32) || chr(10) || chr(9)"


@query(_CRUMBS + f""", s AS (
  SELECT doc_id, sec, any_value(crumb) AS crumb, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), {_WS}) AS text FROM crumbs GROUP BY doc_id, sec),
k AS (SELECT *, CASE WHEN crumb <> '' THEN crumb || chr(10) || chr(10) ELSE '' END AS pre FROM s WHERE length(text) >= 200),
c AS (SELECT doc_id, sec, crumb, CASE WHEN length(pre || text) <= 6000 THEN [pre || text] ELSE {_pack_sql(f"list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {_WS}) <> '')", "pre")} END AS cs FROM k),
u AS (SELECT doc_id, sec, crumb, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS chunk_index, cs[i] AS content, nullif(crumb, '') AS heading FROM u""")
def markdown_chunks(spark, sf_dir):
    rows = chunking.markdown_chunks(ds.markdown(spark, sf_dir)).select("doc_id", "chunks")
    return chunking.numbered(rows).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk.content", "chunk.heading")


@query(_CRUMBS + "SELECT doc_id, i AS line, crumb AS heading FROM crumbs WHERE level > 0")
def markdown_breadcrumbs(spark, sf_dir):
    """The breadcrumb at every heading line."""
    lines = ds.markdown(spark, sf_dir).withColumn("l", F.split("content", "\n"))
    sections = chunking.markdown_sections(lines).select("doc_id", "l", F.posexplode("sections").alias("k", "s"))
    heads = lines.select("doc_id", F.posexplode("l").alias("line", "x")).where(F.rlike("x", F.lit(chunking._HEADING)))
    order = W.partitionBy("doc_id").orderBy("line")
    numbered = heads.select("doc_id", F.col("line"), F.row_number().over(order).alias("k"))
    return sections.where("k > 0").select("doc_id", "k", "s.heading").join(numbered, ["doc_id", "k"]).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "heading")


_PAGES = f"""
WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS pages FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, len(pages) AS n, list_reduce(list_transform(pages[2:], lambda p, i: {{'o': CAST([] AS STRUCT(text VARCHAR, a BIGINT, z BIGINT)[]), 'now': p, 'a': i}}), lambda acc, x:
  CASE WHEN (trim(acc.now, chr(32) || chr(10) || chr(9)) <> '' AND NOT regexp_matches(trim(acc.now, chr(32) || chr(10) || chr(9)), '[.!?:;)\\]"'']\\s*$')) OR length(trim(acc.now, chr(32) || chr(10) || chr(9))) < 200
  THEN {{'o': acc.o, 'now': trim(acc.now, chr(32) || chr(10) || chr(9)) || chr(10) || chr(10) || trim(x.now, chr(32) || chr(10) || chr(9)), 'a': acc.a}}
  ELSE {{'o': list_append(acc.o, {{'text': trim(acc.now, chr(32) || chr(10) || chr(9)), 'a': acc.a, 'z': x.a}}), 'now': trim(x.now, chr(32) || chr(10) || chr(9)), 'a': x.a + 1}} END,
  {{'o': CAST([] AS STRUCT(text VARCHAR, a BIGINT, z BIGINT)[]), 'now': pages[1], 'a': CAST(1 AS BIGINT)}}) AS s FROM t),
m AS (SELECT conv_id, unnest(list_append(s.o, {{'text': trim(s.now, chr(32) || chr(10) || chr(9)), 'a': s.a, 'z': n}})) AS x FROM f)
"""


@query(_PAGES + "SELECT conv_id, x.a AS first, x.z AS last, x.text AS text FROM m")
def pdf_merge(spark, sf_dir):
    rows = ds.paged(spark, sf_dir).select("conv_id", F.explode(chunking.merged_pages(F.col("pages"))).alias("m"))
    return rows.select("conv_id", F.col("m.first").cast("long").alias("first"), F.col("m.last").cast("long").alias("last"), "m.text")


@query(_PAGES + f""", k AS (
  SELECT conv_id, x.a AS a, x.z AS z, x.text AS text, CASE WHEN x.a = x.z THEN '[Page ' || x.a || ']' ELSE '[Pages ' || x.a || '-' || x.z || ']' END || chr(10) || chr(10) AS pre FROM m WHERE length(x.text) >= 200),
c AS (SELECT conv_id, a, z, CASE WHEN length(pre || text) <= 6000 THEN [pre || text] ELSE {_pack_sql(f"list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {_WS}) <> '')", "pre")} END AS cs FROM k),
u AS (SELECT conv_id, a, z, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY a, i) - 1 AS chunk_index, cs[i] AS content, a - 1 AS page, z - 1 AS page_end FROM u""")
def pdf_chunks(spark, sf_dir):
    rows = ds.paged(spark, sf_dir).select("conv_id", chunking.page_chunks(F.col("pages")).alias("chunks"))
    out = chunking.numbered(rows).select("conv_id", "chunk_index", "chunk.*")
    return out.select("conv_id", "content", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "page", "page_end")])


_COMMENTS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
c AS (SELECT conv_id, turn, trim(text, chr(32) || chr(10) || chr(9)) AS body, '[Issue #' || conv_id || ': Conversation ' || conv_id || ']' AS pre, '@' || role || ' (2024-01-01):' AS who
  FROM n WHERE k > 1 AND length(trim(text, chr(32) || chr(10) || chr(9))) >= 50),
s AS (SELECT *, pre || ' Comment by ' || who || chr(10) || chr(10) || body AS whole, length(pre || ' Comment by ' || who || chr(10) || chr(10) || body) < 200 AS short FROM c),
g AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
"""


_ISSUE_CHUNKS = _COMMENTS + f""", parts AS (
  SELECT conv_id, 0 AS pos, trim('[Issue #' || conv_id || ': Conversation ' || conv_id || ']' || chr(10) || chr(10) || text, chr(32) || chr(10) || chr(9)) AS t FROM n WHERE k = 1
  UNION ALL SELECT conv_id, turn + 1, whole FROM g WHERE NOT short
  UNION ALL SELECT conv_id, min(turn) + 1, any_value(pre) || ' Conversation:' || chr(10) || chr(10) || string_agg(who || chr(10) || body, chr(10) || chr(10) ORDER BY turn) FROM g WHERE short GROUP BY conv_id, island),
e AS (SELECT conv_id, pos, {_emit_sql("t", 200)} AS cs FROM parts),
u AS (SELECT conv_id, pos, unnest(range(1, len(cs) + 1)) AS i, cs FROM e)
"""


@query(_ISSUE_CHUNKS + """SELECT conv_id AS number, row_number() OVER (PARTITION BY conv_id ORDER BY pos, i) - 1 AS chunk_index, cs[i] AS chunk FROM u""")
def issue_chunks(spark, sf_dir):
    i = ds.issues(spark, sf_dir)
    rows = i.select("number", chunking.issue_chunks(F.col("number"), F.col("title"), F.col("body"), F.col("comments")).alias("chunks"))
    return chunking.numbered(rows).select("number", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


_ISSUE_RESULTS = _ISSUE_CHUNKS + """, made AS (SELECT conv_id, count(*) AS chunks FROM u GROUP BY conv_id),
results AS (SELECT 'github://o/r/issues/' || i.conv_id AS file_path, CASE WHEN i.conv_id % 3 = 0 OR chunks IS NULL THEN 'skipped' WHEN i.conv_id % 7 = 0 THEN 'failed' ELSE 'ingested' END AS status,
  CASE WHEN i.conv_id % 3 = 0 OR chunks IS NULL THEN 0 ELSE chunks END AS chunk_count
  FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN made ON made.conv_id = i.conv_id)
"""


def _issue_results(spark, sf_dir):
    """All conversations as issues: a third are known unchanged, a third with another hash; all chunks of every seventh fail."""
    issues = ds.issues(spark, sf_dir)
    number, path = F.col("number"), ingest.issue_path("o/r", F.col("number"))
    own = chunking.issue_hash(F.col("body"), F.col("comments"))
    known = issues.select(F.when(number % 3 == 2, F.concat(path, F.lit("/other"))).otherwise(path).alias("file_path"), F.when(number % 3 == 0, own).otherwise("old").alias("file_hash"))
    checked = ingest.checked_issues(issues, "o/r", known)
    prepared = checked.select("file_path", F.when(number % 7 == 0, F.size("chunks")).otherwise(0).alias("failed"))
    return ingest.issue_results(checked, prepared)


@query(_ISSUE_RESULTS + "SELECT file_path, status, CAST(chunk_count AS BIGINT) AS chunk_count FROM results")
def issue_ingest(spark, sf_dir):
    return _issue_results(spark, sf_dir).select("file_path", "status", F.col("chunk_count").cast("long").alias("chunk_count"))


@query(_ISSUE_RESULTS + """SELECT count(*) AS total_issues, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
  CAST(coalesce(sum(chunk_count) FILTER (status = 'ingested'), 0) AS BIGINT) AS total_chunks FROM results""")
def issue_ingest_counters(spark, sf_dir):
    return ingest.issue_counters(_issue_results(spark, sf_dir))


@query("SELECT conv_id, turn FROM conversations WHERE length(trim(text, chr(32) || chr(10) || chr(9))) < 50")
def noise_comments(spark, sf_dir):
    return ds.table(spark, sf_dir, "conversations").where(tx.is_noise(F.col("text"))).select("conv_id", "turn")


@query(_COMMENTS + "SELECT conv_id, min(turn) AS first_turn, count(*) AS comments FROM g WHERE short GROUP BY conv_id, island")
def comment_islands(spark, sf_dir):
    """Runs of short comments, by gaps and islands."""
    order = W.partitionBy("conv_id").orderBy("turn")
    n = ds.table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(order))
    pre = chunking.issue_prefix(F.col("conv_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    whole = F.concat(pre, F.lit(" Comment by @"), F.col("role"), F.lit(" (2024-01-01):\n\n"), tx.trim_all(F.col("text")))
    real = n.where((F.col("k") > 1) & ~tx.is_noise(F.col("text"))).withColumn("short", F.char_length(whole) < chunking.MIN_CHUNK)
    placed = real.withColumn("island", F.sum(F.when(F.col("short"), 0).otherwise(1)).over(order))
    return placed.where("short").groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("comments")).drop("island")


@query("""SELECT conv_id AS number, sha256(max(CASE WHEN k = 1 THEN text END) || chr(0) || coalesce(string_agg(role || ':' || text, chr(0) ORDER BY turn) FILTER (k > 1), '')) AS hash
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id""")
def issue_hash(spark, sf_dir):
    return ds.issues(spark, sf_dir).select("number", chunking.issue_hash(F.col("body"), F.col("comments")).alias("hash"))


@query("""SELECT 'docs/' || doc_id || '.md' AS path, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'new' WHEN 2 THEN 'changed' ELSE 'unchanged' END AS status FROM documents""")
def sync_plan(spark, sf_dir):
    return sync.sync_plan(*ds.snapshots(spark, sf_dir))


@query("SELECT 'docs/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 10 = 0")
def sync_deleted(spark, sf_dir):
    return sync.deleted_paths(*ds.snapshots(spark, sf_dir))


_PEOPLE = Aliases.of({"user": {"aliases": ["Human-User", "customer"]}, "assistant": {"aliases": ["Bot"]}, "_drop": ["system"]})


def _people(spark, sf_dir):
    name = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, "Human-User").otherwise("Customer")).when(F.col("role") == "assistant", F.when(F.col("turn") % 3 == 0, "BOT").otherwise("assistant")).otherwise("System")
    rows = ds.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("n")))).alias("t"))
    return people.rewrite(rows.select("conv_id", F.transform("t", lambda x: x["n"]).alias("people")), _PEOPLE)


_PEOPLE_SQL = """
WITH n AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN turn % 4 = 0 THEN 'Human-User' ELSE 'Customer' END WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'BOT' ELSE 'assistant' END ELSE 'System' END AS name,
  CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS canonical FROM conversations),
firsts AS (SELECT conv_id, canonical, min(turn) AS t FROM n WHERE canonical IS NOT NULL GROUP BY conv_id, canonical),
r AS (SELECT b.conv_id, b.people, coalesce(a.after, '') AS after FROM (SELECT conv_id, string_agg(name, ',' ORDER BY turn) AS people FROM n GROUP BY conv_id) b
  LEFT JOIN (SELECT conv_id, string_agg(canonical, ',' ORDER BY t) AS after FROM firsts GROUP BY conv_id) a USING (conv_id))
"""


@query(_PEOPLE_SQL + "SELECT conv_id, after, people <> after AS changed FROM r")
def people_canonical(spark, sf_dir):
    return _people(spark, sf_dir).select("conv_id", F.array_join("after", ",").alias("after"), "changed")


@query(_PEOPLE_SQL + "SELECT people <> after AS changed, count(*) AS count FROM r GROUP BY 1")
def people_change_counts(spark, sf_dir):
    return people.change_counts(_people(spark, sf_dir))


@query(_PEOPLE_SQL + "SELECT canonical, count(*) AS count FROM n WHERE canonical IS NOT NULL AND name <> canonical GROUP BY canonical")
def people_collapse_counts(spark, sf_dir):
    return people.collapse_counts(_people(spark, sf_dir), _PEOPLE)


_NOW = "(SELECT max(ts) FROM events)"
_EVENT_ISSUES = "(SELECT event_type AS repo, event_id AS number, ts AS created_at, ts + to_hours(CAST(event_id % 20 AS INTEGER)) AS updated_at FROM events)"


@query(f"""SELECT repo, number, created_at, updated_at, epoch_us({_NOW}) - epoch_us(created_at) <= 2 * 86400000000 AS is_new, NOT epoch_us({_NOW}) - epoch_us(created_at) <= 2 * 86400000000 AS is_active
FROM {_EVENT_ISSUES} WHERE NOT epoch_us({_NOW}) - epoch_us(updated_at) > 14 * 86400000000 ORDER BY updated_at DESC, repo, number LIMIT 50""")
def pulse_issues(spark, sf_dir):
    rows, now = ds.event_issues(spark, sf_dir)
    return pulse.recent_issues(rows, now).select("repo", "number", "created_at", "updated_at", "is_new", "is_active")


def _event_items(spark, sf_dir):
    """Every event as one pull request of its repo."""
    none = F.lit(None).cast("string")
    item = F.struct(F.col("event_id").alias("number"), none.alias("at"), none.alias("updated_at"), none.alias("merged_at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), F.col("ts"))
    return ds.table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), none.alias("error"), F.array(item).alias("items"))


@query("""SELECT event_type AS repo, event_id AS number, CASE WHEN event_type = 'purchase' THEN 'merged' ELSE 'review_covered' END AS activity_type, ts FROM events
ORDER BY ts DESC, repo, number LIMIT 30""")
def pulse_team_union(spark, sf_dir):
    rows = _event_items(spark, sf_dir)
    statuses = rows.select("repo", F.when(F.col("repo") == "purchase", F.col("items")).alias("recently_merged"), F.when(F.col("repo") != "purchase", F.col("items")).alias("demoted_reviews"))
    return pulse.team_activity(statuses).select("repo", "number", "activity_type", "ts")


@query("SELECT event_type AS repo, event_id AS number, ts FROM events")
def pulse_needs_action(spark, sf_dir):
    """Two lists of every status in one, latest first."""
    rows = pulse.usable(_event_items(spark, sf_dir))
    statuses = rows.select("repo", F.when(F.col("repo") == "click", F.col("items")).alias("awaiting_your_review"), F.when(F.col("repo") != "click", F.col("items")).alias("recent_activity_on_your_prs"))
    return pulse.needs_action(statuses).select("repo", "number", "ts")


@query("SELECT event_type AS repo, event_id AS number, ts FROM events WHERE event_type = 'click'")
def pulse_repo_filter(spark, sf_dir):
    """One repo's view, the tool's own filter."""
    return pulse.waiting(pulse.usable(_event_items(spark, sf_dir), "click").withColumnRenamed("items", "your_prs_pending_review")).select("repo", "number", "ts")


@query(f"SELECT CAST(sum(user_id % 7) AS BIGINT) AS stale_filtered, CAST(floor((epoch_us({_NOW}) - epoch_us(min(ts))) / 60000000.0 + 0.5) AS BIGINT) AS data_age_minutes FROM events WHERE event_type <> 'error'")
def pulse_age(spark, sf_dir):
    _, now = ds.event_issues(spark, sf_dir)
    rows = ds.table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.when(F.col("event_type") == "error", "broken").alias("error"), F.col("ts").alias("updated_at"), (F.col("user_id") % 7).alias("stale_filtered"))
    return pulse.freshness(pulse.usable(rows), now)


_RESULTS = "SELECT o_orderstatus AS s, o_orderkey % 9 AS chunks, o_orderkey % 3 AS failed, o_orderkey % 2 AS duplicates FROM orders"


@query(f"""SELECT count(*) FILTER (s = 'F') AS ingested, count(*) FILTER (s = 'O') AS skipped, count(*) FILTER (s = 'P') AS failed,
CAST(coalesce(sum(chunks - failed - duplicates) FILTER (s = 'F'), 0) AS BIGINT) AS total_chunks FROM ({_RESULTS})""")
def batch_counters(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ingested").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    rows = ds.table(spark, sf_dir, "orders").select(status.alias("status"), (F.col("o_orderkey") % 9).alias("chunks"), (F.col("o_orderkey") % 3).alias("failed"), (F.col("o_orderkey") % 2).alias("duplicates"))
    return ingest.batch_counters(rows)


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, lang || '/doc - ' || source || ': ' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || text ELSE '' END AS embedded,
lang || '/doc - ' || source || ': ' || lang || chr(10) || CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS backfilled,
regexp_replace(lower(source || '/Model.V1'), '[^a-z0-9]', '_', 'g') AS name, CAST(floor(doc_id / 4.0 + 0.5) AS BIGINT) AS rounded, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source || ', ' || lang END AS joined FROM documents""")
def text_functions(spark, sf_dir):
    d = ds.table(spark, sf_dir, "documents")
    context = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    parts = (F.col("lang"), F.lit("doc"), F.col("source"), F.col("lang"), context)
    return d.select(
        "doc_id", tx.preview(F.col("text")).alias("preview"), tx.embed_text(*parts).alias("embedded"), tx.embed_text(*parts, backfill=True).alias("backfilled"), tx.identifier(F.concat("source", F.lit("/Model.V1"))).alias("name"),
        tx.round_half_up(F.col("doc_id") / 4).alias("rounded"), tx.joined_or(F.when(F.col("doc_id") % 3 != 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>")), ", ", "none").alias("joined"),
    )


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' WHEN 3 THEN 'markdown' END AS format, 'f' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'PDF' WHEN 2 THEN 'txt' WHEN 3 THEN 'Markdown' ELSE 'exe' END AS name FROM documents""")
def format_detection(spark, sf_dir):
    d = ds.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    path = F.concat(F.lit("a/b.c/f"), F.col("doc_id").cast("string"), F.lit("."), F.when(k == 0, "md").when(k == 1, "PDF").when(k == 2, "txt").when(k == 3, "Markdown").otherwise("exe"))
    return d.select("doc_id", tx.file_format(path).alias("format"), tx.base_name(path).alias("name"))


@query("""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> '')) AS INTEGER) AS n FROM documents""")
def list_functions(spark, sf_dir):
    return ds.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.split_list(F.col("text"))).alias("n"))


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (starts_with(b.n_name, a.n_name) OR starts_with(a.n_name, b.n_name))""")
def root_overlap(spark, sf_dir):
    """Prefix containment among a small list of roots."""
    n = ds.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a, b = n.alias("a"), F.broadcast(n).alias("b")
    either = F.startswith(F.col("b.n_name"), F.col("a.n_name")) | F.startswith(F.col("a.n_name"), F.col("b.n_name"))
    return a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & either).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))
