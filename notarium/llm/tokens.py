"""Token ids in Arrow files of equal-length sequences (operator 2).

Documents are put in ascending doc_id order by a range partitioning; each range becomes one shard, written by the task
that holds it.  A shard is three Arrow IPC files beside each other:

* NAME.ids.arrow   record batches with the columns input_ids (fixed_size_list of SEQUENCE unsigned ids, 16 bits where
  the vocabulary allows) and attention_mask (fixed_size_list of SEQUENCE bools, one bit each).  All ids of the shard's
  documents follow each other through the sequences; the last sequence is filled up with id 0 under a false mask.  The
  batches are uncompressed and all but the last have BATCH sequences, so that sequence k of a memory-mapped file is a
  zero-copy slice at a known place.
* NAME.docs.arrow  doc_id, first (position of its first id in the shard), n_tokens.

A file is written under a name of the attempt and then renamed, so a lost executor or a second attempt leaves no half
files; contents depend on the input alone.

Encoding: a text is cut before each run of white space, and between an ASCII letter and a mark; no token crosses such a
cut, since the tokenizer's own pattern starts a piece there.  So each distinct piece of a batch is encoded once by the
tokenizers library, and texts are put together from the pieces' ids with numpy.  A text with white space outside ASCII,
or with the content of any added token, is encoded whole, whatever stands beside it; so are all texts where the tokenizer
isn't byte-level with that pattern, puts a space before texts, normalises, truncates or pads.

Defined cases: a null text is an empty one and has only the end id; rows with a null doc_id come first; repeated rows
are written each; an empty table gives no shards; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import fresh_dir, giving_back, open_path, publish

SEQUENCE = 1024
BATCH = 256
END_ID = 0
#: Most pieces, and most ids of them, that a worker remembers; then it begins anew.
REMEMBERED, REMEMBERED_IDS = 800_000, 6_400_000
#: Bytes of text that are cut at once.
SCANNED = 1 << 20

#: White space outside ASCII, in UTF-8: a text that has it is encoded whole.
_OTHER_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]"

_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))
_MARK = np.isin(np.arange(256), list(b".,;:!?|#$%&*"))

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole batches of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = t = Tokenizer.from_file(path)
        level, added = t.pre_tokenizer, t.get_added_tokens_decoder()
        bare = t.normalizer is None and t.truncation is None and t.padding is None
        self.by_piece = isinstance(level, pre_tokenizers.ByteLevel) and not level.add_prefix_space and level.use_regex and bare
        self.type = np.uint16 if t.get_vocab_size() <= 65536 else np.uint32
        plain = [x for _, x in sorted(added.items()) if x.special and not (x.lstrip or x.rstrip or x.single_word)]
        self.between = plain[0].content if self.by_piece and plain else ""
        self.between_id = t.token_to_id(self.between) if self.between else -1
        contents = sorted((re.escape(x.content.encode()) for x in added.values() if x.content), key=len, reverse=True)
        self.added = re.compile(b"|".join(contents)) if contents else None
        self.odd = re.compile(b"|".join([*contents, _OTHER_SPACE]))
        self.forget()

    def forget(self) -> None:
        # arrays, as a dict takes several times their memory: hashes of pieces, ascending, and where and how many their ids are
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.type), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def separately(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of ids of each.

        Many pieces go through the library as one text, with a special token between them: it splits the text before
        anything else happens.
        """
        joined = [self.between.join(pieces[k : k + 1000]) for k in range(0, len(pieces), 1000)] if self.between else []
        if not joined or sum(len(self.added.findall(x.encode())) for x in joined) != len(pieces) - len(joined):
            lists = self.whole(pieces)
            return np.fromiter((i for x in lists for i in x), self.type), np.fromiter(map(len, lists), np.int64, len(lists))
        parts = [np.array([*x, self.between_id], self.type) for x in self.whole(joined)]
        flat = np.concatenate(parts)
        ends = np.flatnonzero(flat == self.between_id)
        return flat[flat != self.between_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Remember the ids of new pieces; their hashes are ascending."""
        flat, counts = self.separately(pieces)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, self.ids * 0])
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, at, counts)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.used += len(flat)

    def odd_texts(self, data: bytes, offs: np.ndarray) -> np.ndarray:
        """Which of a block's texts the cuts do not hold for.  A find that runs over a border marks the texts on both sides."""
        odd = np.zeros(len(offs) - 1, bool)
        for m in self.odd.finditer(data):
            odd[np.searchsorted(offs, m.start(), "right") - 1 : np.searchsorted(offs, m.end() - 1, "right")] = True
        return odd

    def _by_pieces(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from . import textvec as tv

        space = tv.SPACE[raw]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[1:] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
        cut[offs[:-1][offs[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        if len(self.hashes) > REMEMBERED or self.used > REMEMBERED_IDS:
            self.forget()
        hashes, where, back = np.unique(tv.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        new = place == len(self.hashes)
        new[~new] = self.hashes[place[~new]] != hashes[~new]
        if new.any():
            data = raw.tobytes()
            at = where[new]
            self._learn(hashes[new], [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, hashes)
        index = place[back]
        counts = self.count[index]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        gather = np.repeat(self.begin[index] - (stops - counts), counts) + np.arange(total)
        before = np.concatenate([[0], stops])
        return self.ids[gather], np.diff(before[np.searchsorted(starts, offs)])

    def batch(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block by block: ids of its texts one after the other, without end ids, and the number of ids of each."""
        from . import textvec as tv

        for _, raw, offs in tv.blocks(column, SCANNED):
            data = raw.tobytes()
            odd = self.odd_texts(data, offs) if self.by_piece else np.ones(len(offs) - 1, bool)
            lists = self.whole([data[offs[k] : offs[k + 1]].decode() for k in np.flatnonzero(odd)]) if odd.any() else []
            counts = np.zeros(len(odd), np.int64)
            counts[odd] = list(map(len, lists))
            if odd.all():
                yield np.fromiter((i for x in lists for i in x), self.type, counts.sum()), counts
                continue
            length = np.diff(offs)
            plain = raw[np.repeat(~odd, length)] if odd.any() else raw
            ids, counts[~odd] = self._by_pieces(plain, np.concatenate([[0], np.cumsum(length[~odd])]))
            if odd.any():
                both = np.zeros(counts.sum(), self.type)
                mine = np.repeat(odd, counts)
                both[mine], both[~mine] = np.fromiter((i for x in lists for i in x), self.type, counts[odd].sum()), ids
                ids = both
            yield ids, counts


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, base: str, type_: np.dtype, sequence: int = SEQUENCE):
        self.base, self.sequence, self.attempt = base, sequence, f"{base}.tmp-{os.getpid()}-{np.random.SeedSequence().entropy % 10**12}"
        self.fs, self.tmp = open_path(self.attempt)
        self.fs.create_dir(os.path.dirname(self.tmp), recursive=True)
        self.type = pa.from_numpy_dtype(type_)
        self.schema = pa.schema([("input_ids", pa.list_(self.type, sequence)), ("attention_mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(f"{self.tmp}.ids.arrow")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.written = 0
        self.docs: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        first = self.written + self.waiting + np.cumsum(counts) - counts
        # a copy of the ids alone: a slice would hold the whole batch, texts and all, until the shard is closed
        self.docs.append((first, counts, doc_ids.take(pa.array(np.arange(len(doc_ids))))))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.sequence * BATCH:
            self._write(self.waiting // (self.sequence * BATCH) * BATCH)

    def _write(self, sequences: int) -> None:
        flat = np.concatenate(self.held)
        size = sequences * self.sequence
        mask = np.ones(size, bool)
        if len(flat) < size:
            mask[len(flat) :] = False
            flat = np.concatenate([flat, np.zeros(size - len(flat), flat.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat[:size], mask)]
        whole = pa.RecordBatch.from_arrays(columns, schema=self.schema)
        for k in range(0, sequences, BATCH):
            part = whole.slice(k, BATCH)
            self.writer.write_batch(part)
        self.held, taken = [flat[size:]], min(size, self.waiting)
        self.written += taken
        self.waiting -= taken

    def close(self) -> None:
        if self.waiting:
            self._write(-(-self.waiting // self.sequence))
        self.writer.close()
        self.sink.close()
        with self.fs.open_output_stream(f"{self.tmp}.docs.arrow") as sink:
            ids = pa.chunked_array([d for _, _, d in self.docs], pa.int64())
            first, counts = (pa.array(np.concatenate([x[k] for x in self.docs]), pa.int64()) for k in (0, 1))
            t = pa.table({"doc_id": ids, "first": first, "n_tokens": counts})
            with pa.ipc.new_file(sink, t.schema) as w:
                w.write_table(t, max_chunksize=65536)
        _, final = open_path(self.base)
        for part in ("docs", "ids"):
            publish(self.fs, f"{self.tmp}.{part}.arrow", f"{final}.{part}.arrow")


def write_sequences(docs: DataFrame, tokenizer: str, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write docs as token files under path; (shard, base, n_docs, n_tokens) of each shard, in order of doc_id."""

    @giving_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(tokenizer), TaskContext.get().partitionId()
        writer, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            done = 0
            for ids, counts in code.batch(batch.column("text")):
                writer = writer or ShardWriter(f"{path}/shard-{shard:06d}", code.type, sequence)
                stops = np.cumsum(counts)
                writer.add(batch.column("doc_id").slice(done, len(counts)), np.insert(ids, stops, end_id).astype(code.type, copy=False), counts + 1)
                done, n_docs, n_tokens = done + len(counts), n_docs + len(counts), n_tokens + len(ids) + len(counts)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "base": [f"{path}/shard-{shard:06d}"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    in_order = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return in_order.mapInArrow(write, "shard int, base string, n_docs long, n_tokens long")


class Shard:
    """A written shard, memory-mapped where the file system is local."""

    def __init__(self, base: str):
        fs, path = open_path(base)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._files = [pa.memory_map(f"{path}.{x}.arrow") if local else fs.open_input_file(f"{path}.{x}.arrow") for x in ("ids", "docs")]
        self.ids, self.index = map(pa.ipc.open_file, self._files)
        self.sequence = self.ids.schema.field("input_ids").type.list_size

    def sequences(self, k: int, column: str = "input_ids") -> pa.Array:
        """Sequence k, without copying."""
        batch = self.ids.get_batch(k // BATCH).column(column)
        return batch.slice(k % BATCH, 1).flatten()

    def documents(self) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Batches of the document index with each document's ids."""
        width = self.sequence * BATCH
        loaded: dict[int, np.ndarray] = {}

        def block(k: int) -> np.ndarray:
            if k not in loaded:
                if len(loaded) > 2:
                    loaded.pop(min(loaded))
                loaded[k] = self.ids.get_batch(k).column("input_ids").flatten().to_numpy()
            return loaded[k]

        for i in range(self.index.num_record_batches):
            batch = self.index.get_batch(i)
            for part in range(0, len(batch), 1000):
                rows, out = batch.slice(part, 1000), []
                for first, n in zip(rows.column("first").to_numpy(), rows.column("n_tokens").to_numpy(), strict=True):
                    pieces, end = [], first + n
                    while first < end:
                        k = int(first // width)
                        stop = min(end, (k + 1) * width)
                        pieces.append(block(k)[first - k * width : stop - k * width])
                        first = stop
                    out.append(pieces[0] if len(pieces) == 1 else np.concatenate(pieces))
                yield rows, out


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that shards (shard, base, n_tokens) names."""

    @giving_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before in zip(batch.column("base").to_pylist(), batch.column("before").to_pylist(), strict=True):
                for rows, ids in Shard(base).documents():
                    crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(rows.column("first").to_numpy() + before, pa.int64()), rows.column("n_tokens"), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    earlier = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = shards.select("shard", "base", F.coalesce(earlier, F.lit(0)).alias("before"))
    # as many tasks as shards: the rows are few, what they name is not
    return placed.repartition(max(1, shards.count()), F.col("shard")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write docs into the shared folder and return what the files say of each document."""
    from .common import materialise

    shards = materialise(write_sequences(docs, tokenizer, fresh_dir(docs.sparkSession, "tokens"), sequence), "shards")
    return read_documents(shards)
