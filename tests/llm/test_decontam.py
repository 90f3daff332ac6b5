import hashlib
import random

from notarium.llm import decontam

from .brute import DOC_SCHEMA, ODD, contaminated, counts, terms


def result(spark, rows, bench):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    sha = lambda items: hashlib.sha256(",".join(items).encode()).hexdigest()
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, sha(r["items"]), r.contaminated) for r in out]


def test_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "a", "B", "é1", *[f"w{i}" for i in range(30)]])
    bench = [(i, " ".join(word() for _ in range(rng.choice((1, 3, 9, 10, 11, 25))))) for i in range(1, 30)] + [(99, None), (98, "..."), (97, "the the the the the the the the the the the the")]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(bench)[1] or "").split()
            cut = rng.randint(0, max(0, len(part) - 10))
            w[rng.randint(0, len(w)) : 0] = part[cut : cut + rng.choice((5, 10, 15, 99))]
        rows.append((i, rng.choice((" ", "-", " ,")).join(w).upper()))
    rows += [(500, "the " * 50), (None, bench[3][1])] + [(r[0], r[1]) for r in ODD if r[0] is not None]
    assert counts(result(spark, rows, bench)) == counts(contaminated(rows, bench))


def test_empty_tables_and_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"x {passage} y"), (2, "clean text"), (3, None)]
    assert result(spark, [], [(1, passage)]) == []
    assert {r[2] for r in result(spark, rows, [])} == {0}
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOC_SCHEMA)
    left = decontam.remove_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def near(docs, bench):
    """(doc, sorted item ids) by trying every window at every place."""
    out = []
    for doc, text in docs:
        w, items = terms(text), set()
        for item, passage in bench:
            b = terms(passage)
            for i in range(len(b) - 9):
                for s in range(-i - 12, len(w)):
                    if sum(any(0 <= s + q + j < len(w) and w[s + q + j] == b[q] for j in range(3)) for q in range(i, i + 10)) >= 9:
                        items.add(str(item))
        out.append((doc, tuple(sorted(items))))
    return out


def edited(rng, words, word):
    """A passage with words put in, exchanged or left out."""
    out = []
    for k, x in enumerate(words):
        r = rng.random()
        if r < 0.06:
            out.append(word())
        if r > 0.06 + rng.choice((0, 0.08)):
            out.append(x)
        elif r > 0.06:
            out.append(word())
    return out


def test_proximity_matches_brute_force(spark):
    rng = random.Random(17)
    word = lambda: rng.choice(["the", "of", "a", *[f"w{i}" for i in range(60)]])
    bench = [(i, " ".join(word() for _ in range(rng.choice((5, 10, 12, 25))))) for i in range(12)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.8:
            w[rng.randint(0, len(w)) : 0] = edited(rng, bench[rng.randrange(len(bench))][1].split(), word)
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, bench[3][1]), (102, " ".join(x for k, y in enumerate(bench[3][1].split()) for x in ([y, "new"] if k % 9 == 8 else [y])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = near(rows, bench)
    assert counts((r.doc_id, tuple(r.near_items)) for r in out) == counts(want)
    assert sum(bool(x) for _, x in want) > 15 and any(r.near_items and not r.contaminated for r in out)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3)], "doc_id long, text string, row int, near int, w int")
    (row,) = decontam.decontaminate(docs, spark.createDataFrame([(1, "b", 5)], "item_id long, text string, item int")).collect()
    assert row.n_hit == 1 and row["items"] == ["1"]
