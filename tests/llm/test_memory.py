"""What a Python worker keeps between its tasks."""

import io
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from notarium.llm import tokens

SIGN = """
import re
import pyarrow as pa
from notarium.llm import neardup

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", f.read()))) / 1024

def batches():
    for k in range(3):
        texts = [" ".join(f"w{k}x{i * j % 9973}" for j in range(300)) for i in range(3000)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": texts})

before = held()
assert sum(len(x) for x in neardup._sign(batches())) == 9000
print(held() - before)
"""

PREDICT = """
import re
import pyarrow as pa
from notarium.llm import langid, textvec

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", f.read()))) / 1024

def batches():
    for k in range(3):
        texts = [" ".join(f"w{k}x{i * j % 9973}" for j in range(100 + i % 500)) for i in range(500)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": texts})

class Docs:
    def select(self, *names):
        return self

    def mapInArrow(self, run, ddl):
        return run(batches())

before = held()
assert sum(len(x) for x in langid.predict(Docs(), langid.Network(["a", "b", "c", "d"]))) == 1500
print(held() - before)
"""


def test_a_worker_gives_back_what_a_task_took():
    grown = float(subprocess.run([sys.executable, "-c", SIGN], capture_output=True, text=True, check=True).stdout)
    assert grown < 50


def test_language_id_gives_back_what_a_task_took():
    grown = float(subprocess.run([sys.executable, "-c", PREDICT], capture_output=True, text=True, check=True).stdout)
    assert grown < 29


def test_remembered_pieces_are_small():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    code = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = pa.array([" ".join(f"{i:x}" for i in range(k, k + 1000)) for k in range(0, 100_000, 1000)])
    tracemalloc.start()
    total = sum(len(ids) for ids, _ in code.batch(text))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    powers = 24 << 20  # a table of the scanner's, made once
    assert kept < powers + 50 * 100_000
    assert total == len([i for e in code.whole(text.to_pylist()) for i in e])


def test_an_open_shard_does_not_hold_the_texts(tmp_path):
    writer = tokens.ShardWriter(f"{tmp_path}/shard", np.uint16, 32)
    table = pa.table({"doc_id": pa.array(range(100), pa.int64()), "text": ["x" * 100_000] * 100})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    stream = io.BytesIO(sink.getvalue().to_pybytes())
    tracemalloc.start()
    batch = pa.ipc.open_stream(stream).read_next_batch()  # as Spark's workers read
    whole = tracemalloc.get_traced_memory()[0]
    writer.add(batch.column("doc_id"), np.zeros(100, np.uint16), np.ones(100, np.int64))
    del batch
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert whole > 9_000_000 and kept < 1_000_000
    writer.close()
    assert tokens.Shard(f"{tmp_path}/shard").index.get_batch(0).column("doc_id").to_pylist() == list(range(100))
