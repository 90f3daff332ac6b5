from notarium.llm import rules

from .brute import DOC_SCHEMA, ODD, base, counts


def judged(spark, rows, schema=DOC_SCHEMA):
    return rules.judge(spark.createDataFrame(rows, schema))


def test_base_figures_match_brute_force(spark):
    extra = [(20, "x y z w v " * 3 + "q", "en", "a", 1), (21, "l1 a\nl1 a\nl2\n\nl1 a", "en", "a", 1), (22, "p q r s t u p q r s t 1 2 3 4 5 6 7 8 9 10 11 12", "en", "a", 1)]
    rows = ODD + extra
    got = judged(spark, rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert counts(got) == counts((r[0], *base(r[1])) for r in rows)


def test_lines_are_removed_and_documents_rejected(spark):
    prose = "This is a plain sentence that says something, and it ends well."
    rows = [(1, prose + "\nHome | About | Contact | Search", "en", "a", 1), (2, "WIN!! BIG!! MONEY!! NOW!! CALL!! THIS!! NUMBER!! AND!! WAIT!! LONG!!", "en", "a", 1), (3, prose + "\n" + prose[::-1] + ".", "en", "a", 1)]
    got = {r.doc_id: r for r in judged(spark, rows).collect()}
    assert got[1].kept and got[1].clean_text == prose and got[1].n_bad_lines == 1
    assert not got[2].kept and not got[2].base_failed
    assert got[3].kept and got[3].clean_text == rows[2][1]
    kept = {r.doc_id: r for r in rules.clean(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert set(kept) == {1, 3} and kept[1].text == prose and kept[1].n_chars == len(prose)


def test_empty_table_and_clashing_columns(spark):
    assert judged(spark, []).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, kept int, n_words string")
    (row,) = rules.judge(docs).collect()
    assert row.kept is False and row.n_words == 2
    prose = "This is a plain sentence that says something, and it ends well."
    docs = spark.createDataFrame([(1, prose, 5, "x", 9)], "doc_id long, text string, Kept int, n_words string, _l int")
    assert rules.clean(docs).collect() == docs.collect()


def test_verdicts_match_brute_force(spark):
    import random

    from .brute import cleaned

    rng = random.Random(12)
    parts = ["Plain words that make a line.", "HOME | ABOUT | NEWS", "a b c d e f g h i j", "ALL CAPS LINE HERE", "x### y$$$ z.", "All Rights Reserved.", "", "short", "one > two > three > four", "Click here to read: more;", "Mentions légales et CONDITIONS D'UTILISATION.", "This long line of plain prose says that you may click here to read on, and it goes on for some more words."]
    rows = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), "en", "a", 1) for i in range(300)]
    got = {r.doc_id: (r.kept, r.text if not r.n_bad_lines else r.clean_text) for r in judged(spark, rows).collect()}
    assert got == {r[0]: cleaned(r[1]) for r in rows}
    kept = {r.doc_id: r.text for r in rules.clean(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert kept == {k: t for k, (ok, t) in got.items() if ok}
