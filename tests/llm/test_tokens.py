import zlib

import numpy as np
import pyarrow as pa
import pytest

from notarium.llm import tokens

from .brute import DOC_SCHEMA, ODD

public_tokenizers = pytest.importorskip("public_tokenizers")


def expected(rows, path):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_files_hold_what_the_tokenizer_says(spark, name):
    path = public_tokenizers.path(name)
    rows = [(r[0], r[1]) for r in ODD] + [
        (50, "it's  a\n\n test\t of 'll  spaces \n "), (51, "a  b \n c"), (52, "x" * 5000), (53, "日本語 テキスト 1,234.5"), (54, " lead"),
        (55, "<|endoftext|> literal<|endoftext|>"), (56, "a\x1cb \x1d\n c"), (57, "trail \n\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, tokens.encode_and_read(docs, path, sequence=64).collect()), key=lambda r: r[1])
    assert got == expected(rows, path)


def test_sequences_are_equal_in_length_and_masked(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(300)], "doc_id long, text string")
    shards = tokens.write_sequences(docs, path, f"file://{tmp_path}", sequence=32).collect()
    assert sum(s.n_docs for s in shards) == 300
    for s in shards:
        shard = tokens.Shard(s.base)
        n = sum(shard.ids.get_batch(i).num_rows for i in range(shard.ids.num_record_batches))
        masks = np.concatenate([shard.sequences(k, "attention_mask").to_numpy(zero_copy_only=False) for k in range(n)])
        assert masks.sum() == s.n_tokens and n == -(-s.n_tokens // 32)
        before = pa.total_allocated_bytes()
        assert len(shard.sequences(n - 1)) == 32 and pa.total_allocated_bytes() == before


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert tokens.encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_ids_do_not_depend_on_neighbours():
    """Random strings with the special token, odd white space and cut places: alone, in blocks, in other blocks."""
    import random

    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", "a", "B", "t|", "|>", "<|", " ", "  ", "\n", "'ll", "7", ".", "é", " ", " ", "\x1c", "語", "word", "#"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(10_000)] + ["<|endoftext|> literal<|endoftext|>", "a<|endoftext|>b"]
    code = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert code.by_piece
    want = [e.ids for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encoded(some):
        out = []
        for ids, counts in code.batch(pa.array(some, pa.string())):
            out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        return out

    assert encoded(texts) == want
    order = list(range(len(texts)))
    rng.shuffle(order)
    assert encoded([texts[i] for i in order]) == [want[i] for i in order]
    for i in [*range(0, 10_000, 25), 10_000, 10_001]:
        assert encoded([texts[i]]) == [want[i]]


def test_partitions_do_not_matter(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, ("<|endoftext|> literal<|endoftext|>", "plain text", "no break space <|endoftext", None, "|> end")[i % 5]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 7, 50):
        got = sorted(map(tuple, tokens.encode_and_read(docs.repartition(n), path, sequence=64).collect()), key=lambda r: r[1])
        assert got == expected(rows, path)
