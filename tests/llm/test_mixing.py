from notarium.llm import mixing

from .brute import DOC_SCHEMA, ODD


def targets_by_steps(sizes):
    """Reshare the excess by weight until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_targets_match_stepwise_resharing(spark):
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 3), ("b", 100), ("c", 40), ("d", 0), ("e", 7), ("f", 500), (None, 20), ("z", 1)])]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("source", "size(filter(split(text, ' '), x -> x != '')) AS size")).collect()}
    want = targets_by_steps({r[3]: len(r[1].split()) for r in rows})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_comes_near_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 7}" if i % 3 else "s0", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    a = mixing.mix_documents(docs).collect()
    assert sorted(a) == sorted(mixing.mix_documents(docs.repartition(3)).collect())
    taken, target = {}, {}
    for r in a:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - target[s]) < 0.2 * target[s] for s in target)
    assert mixing.repeat_documents(docs).count() == sum(r.copies for r in a)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC_SCHEMA)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(ODD) and all(r.copies is not None for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_columns_of_the_same_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, "x", 3.0)], "doc_id long, text string, source string, size int, Rate string, copies double")
    assert mixing.repeat_documents(docs).collect() == docs.collect()
    assert mixing.mix_documents(docs).first().size == 2
