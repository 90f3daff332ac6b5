import random

import pytest

from notarium.llm import components as components_module
from notarium.llm import neardup

from .brute import DOC_SCHEMA, ODD, components, counts, shingle_set


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(40):
        base = [word() for _ in range(rng.randint(3, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((" " if rng.random() < 0.3 else "\n").join(copy).upper() if rng.random() < 0.5 else " ".join(copy))
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(1000 - i, t) for i, t in enumerate(texts(rng))]
    rows += [(r[0], r[1]) for r in ODD if r[0] is not None] + [(2000, "same words as before here"), (2001, "SAME words\tas before here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert counts(got) == counts(components(rows))


def test_one_large_group_of_near_copies(spark):
    """More copies than a dense region pairs directly; some of them near few others only."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        copy = list(base)
        for k in rng.sample(range(80), rng.choice((0, 1, 1, 2, 3))):
            copy[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert counts(got) == counts(components(rows))


def test_odd_rows_empty_table_and_deduplicate(spark):
    docs = spark.createDataFrame(ODD, DOC_SCHEMA).selectExpr("*", "1 AS key", "'x' AS kept")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6, 7, 8], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("local", [5, 10**6])
@pytest.mark.parametrize("shuffled", [True, False])
def test_components_of_a_long_chain(spark, monkeypatch, local, shuffled):
    monkeypatch.setattr(components_module, "LOCAL", local)
    order = list(range(60))
    if shuffled:
        random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components_module.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(60)}) == 1 and got[100] == got[101] != got[0] and got[200] == 200 and len(got) == 63


def template_pages(rng, n, own):
    """Pages that share a template; some are close to another page's own part as well, some on the border of 75 %."""
    template, rows = [f"t{i}" for i in range(60)], []
    for i in range(n):
        part = [f"u{i}x{k}" for k in range(own + rng.randint(-3, 3))]
        if rows and rng.random() < 0.3:
            part = list(rows[rng.randrange(len(rows))][1])
            for k in rng.sample(range(len(part)), rng.randint(0, len(part) // 2)):
                part[k] = f"v{i}x{k}"
        rows.append((i, part))
    return [(i, " ".join(template + part)) for i, part in rows]


@pytest.mark.parametrize("own", [20, 8])
def test_pages_of_one_template(spark, own):
    """Crowded regions with hundreds of components: every link is found, whatever its neighbours in the orders."""
    rows = template_pages(random.Random(own), 700, own)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert counts(got) == counts(components(rows))


def test_the_prefix_join_alone_finds_every_link(spark):
    """Without any link from the orders, the join over a crowded region gives all of them."""
    from pyspark.sql import functions as F

    rows = template_pages(random.Random(4), 250, 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = docs.mapInArrow(neardup._sign, neardup.SIGNED)
    classes = signed.groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least_id"))
    ids = {bytes(r.key): r.least_id for r in classes.collect()}
    sets = neardup._full_sets(docs, classes, classes.select("key"))
    crowded = classes.select(F.lit(1).alias("region"), "key")
    pairs = neardup._crowded_pairs(crowded, classes, sets, spark.createDataFrame([], "node binary, root binary"))
    found = {frozenset((ids[bytes(r.a)], ids[bytes(r.b)])) for r in neardup._confirmed(pairs, sets).collect()}
    text, want = dict(rows), set()
    kept = sorted(ids.values())
    whole = {i: shingle_set(text[i]) for i in kept}
    for k, a in enumerate(kept):
        for b in kept[k + 1 :]:
            n = len(whole[a] & whole[b])
            if 100 * n >= 75 * (len(whole[a]) + len(whole[b]) - n):
                want.add(frozenset((a, b)))
    assert len(want) > 20 and found == want


def test_hot_copies_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)
    long = [f"w{i}" for i in range(60_000)]
    rows = [(i, "one text that very many rows have") for i in range(5, 80)] + [(k, None) for k in range(100, 130)]
    rows += [(200 + k, " ".join(long[:1000 * k] + [f"y{k}z{j}" for j in range(900)] + long[1000 * k + 900 :])) for k in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 100} == {5} and {r.component_id for r in got if r.doc_id >= 200} == {200}
    assert all(r.kept and r.n_shingles == 0 for r in got if 100 <= r.doc_id < 130) and len(got) == len(rows)
