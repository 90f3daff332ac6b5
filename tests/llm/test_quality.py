import numpy as np

from notarium.llm import quality

from .brute import DOC_SCHEMA, ODD


def test_isotonic_is_the_nearest_monotone_sequence():
    rng = np.random.default_rng(0)
    v, w = rng.random(40), rng.integers(1, 5, 40).astype(float)
    got = quality.isotonic(v, w)
    # min-max formula of isotonic regression
    mean = lambda a, b: np.average(v[a : b + 1], weights=w[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, want)


def test_features_approximate_the_kernel():
    model = quality.Model(np.zeros(6), np.ones(6), 20000, 3.0)
    x = np.random.default_rng(1).normal(size=(5, 6))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 3.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    words = ["this", "is", "plain", "prose", "with", "Some", "words,", "and", "ends."]
    junk = lambda k: ["BUY!!"] * 20 if k % 2 else [rng.choice(words)] * 15
    rows = [(100 + i, " ".join(junk(i) if i % 4 < 2 else rng.choice(words, rng.integers(8, 60))), "en", "s", 1) for i in range(800)]
    docs = spark.createDataFrame(rows + ODD, DOC_SCHEMA)
    labels = spark.createDataFrame([(r[0], int((r[0] - 100) % 4 >= 2), 0) for r in rows] + [(10**6, 1, 0), (None, 0, 0), (100, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [(r.predicted, int((r.doc_id - 100) % 4 >= 2)) for r in out if r.held_out and r.doc_id and r.doc_id >= 100]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame(ODD, DOC_SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0
