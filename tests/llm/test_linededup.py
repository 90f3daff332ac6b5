import random

from notarium.llm import linededup

from .brute import DOC_SCHEMA, ODD


def brute(rows):
    seen, out = {}, []
    lines = lambda t: [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for i in range(len(lines(text)) - 2):
            seen.setdefault(tuple(lines(text)[i : i + 3]), (doc, i))
    for doc, text in rows:
        own, gone = lines(text), set()
        for i in range(len(own) - 2):
            if seen[tuple(own[i : i + 3])] != (doc, i):
                gone |= {i, i + 1, i + 2}
        out.append((doc, len(own), len(gone), "\n".join(x for i, x in enumerate(own) if i not in gone) if gone else text))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c", " ", "", "d."]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows = list({r[0]: r for r in rows + [(r[0], r[1]) for r in ODD]}.values()) + [rows[0]]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_columns_stay(spark):
    docs = spark.createDataFrame(ODD, DOC_SCHEMA).selectExpr("*", "'mine' AS n_removed", "7 AS row", "8 AS h")
    out = linededup.dedup_lines(docs)
    assert {"row", "h", "lang", "source"} <= set(out.columns) and out.count() == len(ODD)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
