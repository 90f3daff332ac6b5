import numpy as np

from notarium.llm import langid

from .brute import DOC_SCHEMA, ODD


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask, y = rng.integers(0, 256, (7, 5)), np.ones((7, 5)), rng.integers(0, 3, 5)
    mask[5:, 2] = 0
    _, grad = net.gradient(x, mask, y)
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
        old, e = w[at], 1e-3
        w[at] = old + e
        up, _ = net.gradient(x, mask, y)
        w[at] = old - e
        down, _ = net.gradient(x, mask, y)
        w[at] = old
        assert abs((up - down) / (2 * e) - grad[k][at]) < 2e-3 * max(1, abs(grad[k][at])), k


def test_inference_equals_training_pass():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (20, 6))
    for d in "fb":
        assert np.allclose(net.states(d, x), net._direction(d, x)[0], atol=1e-5)


def test_learns_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    stems = {"en": ["the", "and", "ing", "wh"], "de": ["sch", "ung", "der", "ü"], "fr": ["eau", "é", "les", "è"]}
    rows = [(1000 + i, " ".join("".join(rng.choice(stems[l], 2)) for _ in range(rng.integers(3, 80))), l, "s", 1) for i in range(600) for l in [list(stems)[i % 3]]]
    docs = spark.createDataFrame(rows + ODD + [(900, "123 456 !!", "en", "s", 1)], DOC_SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[900].lang_pred == "und" and got[900].score == 0
    held = [(r[2], got[r[0]].lang_pred) for r in rows if got[r[0]].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).collect()[0].lang_pred == "und"
    assert langid.identify(docs.limit(0)).count() == 0
