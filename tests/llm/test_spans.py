import random
import re

from notarium.llm import spans

from .brute import DOC_SCHEMA, ODD, WORD


def split(text):
    out, here = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+|\n", text or ""):
        if m[0] == "\n":
            out, here = (out + [here], []) if here else (out, here)
            continue
        here.append(m[0])
        if re.search(r"[.!?][\"')\]}]?$", m[0]):
            out, here = out + [here], []
    return out + [here] if here else out


def runs(text):
    s = split(text)
    for i in range(len(s)):
        n = 2
        while i + n <= len(s) and sum(map(len, s[i : i + n])) < 20:
            n += 1
        if i + n <= len(s):
            yield i, n, tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for x in s[i : i + n] for w in x)


def brute(rows):
    first, out = {}, []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for i, _, key in runs(text):
            first.setdefault(key, (doc, i))
    for doc, text in rows:
        gone = {j for i, n, key in runs(text) if first[key] != (doc, i) for j in range(i, i + n)}
        s = split(text)
        left = [w for j, x in enumerate(s) if j not in gone for w in x]
        out.append((doc, len(s), len(gone), sum(len(s[j]) for j in gone), left))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", ".", ",", ".\"", "\n"])
    passages = [" ".join(word() for _ in range(70)) for _ in range(3)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.5:
            w.insert(rng.randint(0, len(w)), rng.choice(passages).upper())
        rows.append((i, "  ".join(w)))
    rows += [(r[0], r[1]) for r in ODD if r[0] != 5] + [rows[0]]
    rows += [(5, "one two")]
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.removed_words, WORD.findall(r.text or "")) for r in got]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_planted_passage_and_clean_documents(spark):
    passage = " ".join(f"Word{i} and more text{i}, of this{i}." for i in range(10))
    rows = [(1, f"begin of one {passage} End."), (2, f"Other start. {passage} tail here"), (3, "Nothing of that. At all.")]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].changed and got[1].text == rows[0][1] and not got[3].changed
    assert got[2].changed and got[2].removed_words >= 50 and "Word5" not in got[2].text and got[2].text.startswith("Other start.")


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame(ODD, DOC_SCHEMA).selectExpr("*", "1 AS row", "2 AS h", "3 AS pos")
    assert spans.dedup_spans(docs).count() == len(ODD)
    assert spans.dedup_spans(docs.limit(0)).count() == 0


def windows(text, n=50):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_no_passage_of_fifty_words_stays_twice(spark):
    """One-sentence texts, and passages planted within sentences of any length, against all windows of 50 words."""
    rng = random.Random(8)

    def prose(n, mean):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + ("." if mean and rng.random() * mean < 1 else "") for _ in range(n))

    lone = [prose(n, 0) for n in (51, 60, 200)]
    rows = [(1 + i, lone[i % 3]) for i in range(6)] + [(7, prose(90, 0) + " et.&&&"), (8, "a " * 400), (9, prose(300, 0)), (10, prose(300, 8))]
    planted = []
    for i in range(60):
        passage = prose(rng.randint(51, 70), (0, 60, 30, 15, 6)[i % 5])
        for k in range(2):
            head, tail = prose(rng.randint(0, 60), (0, 40, 10)[(i + k) % 3]), prose(rng.randint(0, 60), (40, 0, 10)[(i + k) % 3])
            rows.append((100 + 2 * i + k, f"{head} {passage} {tail}"))
        planted.append(101 + 2 * i)
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [w for d, text in rows if d != 8 for w in windows(got[d].text)]
    assert len(left) == len(set(left))
    later = {4, 5, 6, *planted}
    for doc, text in rows:
        assert got[doc].changed == (doc in later) and (got[doc].n_removed > 0) == (doc in later), doc
        assert doc in later or got[doc].text == text
        assert len((got[doc].text or "").split()) == len(text.split()) - got[doc].removed_words
    assert all(got[d].removed_words >= 20 for d in later)


def test_short_last_sentences_of_a_passage(spark):
    passage = " ".join(" ".join(f"w{n}x{i}" for i in range(n - 1)) + f" end{k}." for k, n in enumerate((25, 18, 5, 5)))
    rows = [(1, f"A first start. {passage} More of the first text here."), (2, f"Some other start. {passage} Another text goes on.")]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].changed
    assert got[2].text.split() == "Some other start. Another text goes on.".split()
    assert (got[2].n_removed, got[2].removed_words) == (4, 53)


def test_runs_from_both_ends_match_brute_force():
    import numpy as np

    rng = random.Random(5)
    texts = [" ".join("w" + rng.choice(["", "", "", "."]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    doc, pos, size, _ = spans.spans(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = set(zip(doc.tolist(), pos.tolist(), size.tolist()))
    want = set()
    for d, text in enumerate(texts):
        n = [len(x) for x in split(text)]
        ok = {(i, j) for i in range(len(n)) for j in range(i + 2, len(n) + 1) if sum(n[i:j]) >= 20}
        for i, j in ok:
            if (i, j - 1) not in ok or (i + 1, j) not in ok:
                want.add((d, sum(n[:i]), sum(n[i:j])))
    # a window may happen to be a run, or to be as long as one
    assert want == {x for x in got if x[2] != spans.WINDOW or x in want}
