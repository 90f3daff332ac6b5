"""Columns of docs whose names clash with those that an operator makes change nothing in its results."""

import pytest

from notarium.llm import decontam, tokens, warc

from .brute import DOC_SCHEMA, ODD

PASSAGE = "one two three four five six seven eight nine ten eleven"
ROWS = ODD + [(70, f"before {PASSAGE} after", "en", "a", 1), (71, "nothing of it is here", "en", "a", 1)]


def plain_and_clashing(spark, rows, schema, names):
    df = spark.createDataFrame(rows, schema)
    return df, df.selectExpr("*", *[f"'mine' AS {n}" for n in names])


def same(one, other, columns):
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(one) == rows(other)


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs, more = plain_and_clashing(spark, ROWS, DOC_SCHEMA, ["n_words", "n_hit", "items", "row", "term", "pos", "item_id", "contaminated"])
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", "near_items"]
    same(decontam.decontaminate(docs, bench), decontam.decontaminate(more, bench), columns)
    left = decontam.remove_contaminated(more, bench)
    assert left.columns == more.columns and {r.doc_id for r in left.collect()} == {r[0] for r in ROWS} - {70}


def test_token_sequences(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs, more = plain_and_clashing(spark, ROWS, DOC_SCHEMA, ["start", "n_tokens", "ids", "block", "part", "mask", "file"])
    same(tokens.encode_and_read(docs, path), tokens.encode_and_read(more, path), ["doc_id", "start", "n_tokens", "ids_crc32"])


def test_warc_derivatives(spark):
    rows = [(1, "http://a.example/x", "<title>T</title><p>text <a href='/y'>y</a>"), (2, None, None), (3, "", "")]
    pages, more = plain_and_clashing(spark, rows, "page_id long, url string, html string", ["file", "n", "block", "record_id", "payload"])
    same(warc.derivatives_of_pages(pages), warc.derivatives_of_pages(more), ["page_id", "record_type", "record_id", "refers_to", "block", "block_digest"])
