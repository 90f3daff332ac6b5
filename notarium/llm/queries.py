"""The registered queries of the operators in this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, langid, linededup, mixing, neardup, quality, rules, spans, tokens, warc
from .common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op6_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sums),
ranked AS (
  SELECT *, row_number() OVER b AS k,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted WINDOW b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w ASC, source ASC NULLS LAST)),
placed AS (SELECT *, min(CASE WHEN level * w <= 3 * source_size THEN k END) OVER () AS first FROM ranked),
settled AS (SELECT *, max(CASE WHEN k = first THEN level END) OVER () AS settled_level FROM placed),
targets AS (
  SELECT source, source_size, CASE WHEN k < first THEN CAST(3 * source_size AS DOUBLE) ELSE settled_level * w END AS target FROM settled),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0
    < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "kept_words",
    )


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated", F.array_join("near_items", ",").alias("near_items"))


ORACLES["op10_benchmark_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS win
  FROM (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bwin) s WHERE len(w) >= s.n) s),
hits AS (SELECT d.doc_id, d.n, d.i, b.item_id FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
dt AS (SELECT doc_id, p, w[p] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw)),
bt AS (SELECT item_id, q, w[q] AS term FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS q FROM bw WHERE len(w) >= 10)),
there AS (SELECT DISTINCT doc_id, item_id, q, p - q - j AS s FROM dt JOIN bt ON dt.term = bt.term, (SELECT unnest(range(0, 3)) AS j) js),
nearby AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, s ORDER BY q RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM there),
near AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM nearby WHERE n >= 9) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated,
  coalesce(x.near_items, '') AS near_items
FROM dw d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id LEFT JOIN near x ON x.doc_id = d.doc_id
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op5_line_dedup"] = r"""
WITH rows AS (
  SELECT DISTINCT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
wins AS (
  SELECT doc_id, text, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM rows WHERE len(l) >= 3)),
ranked AS (SELECT *, rank() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, i) AS r FROM wins),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(i, i + 3)) AS p FROM ranked WHERE r > 1),
removed AS (SELECT doc_id, text, list(p) AS ps FROM gone GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(r.l) AS BIGINT) AS n_lines, CAST(coalesce(len(g.ps), 0) AS BIGINT) AS n_removed,
  CASE WHEN g.ps IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(r.l, lambda x, i: NOT list_contains(g.ps, i)), chr(10)), '') END AS text
FROM documents d
JOIN rows r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text IS NOT DISTINCT FROM r.text
LEFT JOIN removed g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text IS NOT DISTINCT FROM g.text
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives_of_pages(table(spark, sf_dir, "pages"))


ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least l ON l.a = d.doc_id
"""

_PHRASE = "|".join(rules.BOILERPLATE).replace("'", "''")
ORACLES["op7_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
line AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(l) AS x FROM d)),
judged AS (SELECT doc_id, n,
  10 * (length(x) - length(translate(x, '#*$%&|<>', ''))) > 3 * n OR (n >= 4 AND upper(x) = x AND lower(x) <> x)
  OR (n >= 8 AND length(x) = length(translate(x, '.!?:;', ''))) OR (n >= 3 AND 5 * (length(x) - length(translate(x, '|>•»', ''))) >= n)
  OR (n <= {rules.PHRASE_LINE} AND regexp_matches(lower(x), '{_PHRASE}')) AS bad FROM line),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(n) FILTER (NOT bad), 0) AS kept_words FROM judged GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w) AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(kept_words, 0) AS kept_words
  FROM d LEFT JOIN rep r ON r.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_words >= 0.5 * n_words AS kept,
  CAST(n_lines AS INTEGER) AS n_lines, CAST(n_bad_lines AS INTEGER) AS n_bad_lines, CAST(kept_words AS BIGINT) AS kept_words FROM f
"""
