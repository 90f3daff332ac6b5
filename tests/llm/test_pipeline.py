import hashlib
import random
import zlib

import numpy as np
import pytest

from notarium.llm import neardup

from .brute import WORD, cleaned, components, contaminated
from .test_mixing import targets_by_steps

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeg") for _ in range(rng.randint(2, 7)))
    line = lambda: " ".join(word() for _ in range(rng.randint(5, 30))) + "."
    passage = " ".join(word() for _ in range(14))
    bench, texts = [(1, passage), (2, "not there at all")], []
    for _ in range(120):
        text = "\n".join(line() for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.1:
            text = text.replace(" ", f" {passage} ", 1)
        if rng.random() < 0.15:
            text += "\nHome | News | About | More"
        if rng.random() < 0.1:
            text = "\n".join(x.upper() + "!!" for x in text.split("\n"))
        texts.append(text)
        if rng.random() < 0.25:
            w = text.split(" ")
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w) if rng.random() < 0.6 else text)
    rng.shuffle(texts)
    docs = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
    return docs + [(900, None, None, "a", None), (901, "", "en", "b", 0), (902, "x", "en", None, 1)], bench


def expected(docs, bench):
    from tokenizers import Tokenizer

    rows = [(d, cleaned(t)[1], s) for d, t, _, s, _ in docs if cleaned(t)[0]]
    keep = {d for d, _, _, k in components([(d, t) for d, t, _ in rows]) if k}
    rows = [r for r in rows if r[0] in keep]
    bad = {d for d, *_, hit in contaminated([(d, t) for d, t, _ in rows], bench) if hit}
    rows = [r for r in rows if r[0] not in bad]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    targets = targets_by_steps(sizes)
    out, start, t = [], 0, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, text, s in sorted(rows):
        rate = targets[s] / sizes[s]
        copies = int(rate) + (int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) / 2**52 < rate - int(rate))
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for _ in range(copies):
            out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return out


def test_run_matches_brute_force(spark, tmp_path):
    docs, bench = corpus(random.Random(21))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = expected(docs, bench)
    assert 40 < len({w[0] for w in want}) < len(docs) and sorted(got) == sorted(want)


def test_stages_are_the_named_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mixing", "token_output"]
    assert neardup.PERCENT == 75 and neardup.SHINGLE == 5
