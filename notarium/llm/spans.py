r"""Substring dedup by sliding sentence spans (operator 9).

A sentence ends with a word that ends in . ! or ? (closing quotes and brackets aside), at a line break, or with the
text.  From every sentence begins one span, the shortest run of at least LEAST_SENTENCES sentences that has LEAST_WORDS
words, and with every sentence ends one, the shortest such run backwards; so the last whole sentences of a repeated
passage go as its first do.  Spans are hashed over their words, A-Z lower-cased, so that white space does not matter.  Spans that occur more
than once anywhere keep their first occurrence, in order of doc_id and position; what a later occurrence covers is
removed.

Where sentences are long there are windows as well: every run of WINDOW words within which no two whole sentences of
LEAST_WORDS words begin and end by their marks.  Of each CHOICE windows in a row the one with the least hash is a span
(winnowing), whatever stands around them.  A repeated passage of WINDOW + CHOICE - 1 = 50 words thus holds a sentence
span or a window that is chosen in all its copies, wherever it begins and ends, and after removal no piece of it of that
length stays.  Windows may end within a sentence, of which the rest stays; n_removed counts sentences that lost words.

Counting is one aggregation by hash with partial results, the later occurrences come from a join by hash against one
row for each repeated span (a span that very many documents have is split by the join), and what is gathered per
document is its own positions.  Spans are found in numpy over blocks of a few megabytes.

Defined cases: a null or blank text has no sentences and stays as it is; a text of fewer than LEAST_WORDS words,
or of fewer than LEAST_SENTENCES sentences and 50 words, has no span; a window of one word over and over is none; line
breaks are sentence ends, so that copies with other line breaks may keep sentences; rows that share doc_id and text are one occurrence; a null doc_id comes last in order;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .common import materialise

LEAST_SENTENCES = 2
LEAST_WORDS = 20
WINDOW = 40
CHOICE = 11
_LAST = 2**63 - 1


def sentences(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, first word of each sentence (and the number of words), first sentence and first word of
    each text, words that end in a sentence mark."""
    from . import textvec as tv

    starts, ends, first = tv.word_spans(~tv.SPACE[raw], offs)
    n = len(starts)
    stop = np.zeros(256, bool)
    stop[list(b".!?")] = True
    closing = np.zeros(256, bool)
    closing[list(b"\"')]}")] = True
    tail = raw[np.maximum(ends - 1, 0)] if n else np.zeros(0, np.uint8)
    before = raw[np.maximum(ends - 2, 0)] if n else tail
    last = stop[tail] | (closing[tail] & stop[before])
    marked = np.flatnonzero(last)
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=breaks[1:])
    if n:
        last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    begin = np.concatenate([[0], np.flatnonzero(last) + 1])
    return starts, ends, begin, np.searchsorted(begin[:-1], first), first, marked


def _windows(total: np.ndarray, inverse: np.ndarray, words: np.ndarray, first: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the chosen windows; total has the running sums of the words' hashes times powers."""
    from . import textvec as tv

    n = len(words) - WINDOW + 1
    if n < CHOICE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    with np.errstate(over="ignore"):
        hashes = tv.mix((total[WINDOW:] - total[:n]) * inverse[:n], 10)
    # where the first two sentences of LEAST_WORDS words after each word end, by marks alone: what stands outside does not count
    run = np.maximum(np.searchsorted(marked, marked + LEAST_WORDS), np.arange(len(marked)) + LEAST_SENTENCES)
    stop = np.append(marked, np.iinfo(np.int64).max)[np.minimum(run, len(marked))]
    stop = np.append(stop, np.iinfo(np.int64).max)[np.searchsorted(marked, at)]
    turns = np.zeros(len(words), np.int64)
    np.cumsum(words[1:] != words[:-1], out=turns[1:])
    most = np.iinfo(np.uint64).max
    value = np.where((stop >= at + WINDOW) & (turns[WINDOW - 1 :] > turns[:n]), hashes, most)
    rows = np.lib.stride_tricks.sliding_window_view(value, CHOICE)
    end = np.repeat(first[1:], np.diff(first))
    whole = np.flatnonzero(at[: len(rows)] + (CHOICE + WINDOW - 1) <= end[: len(rows)])
    least, where = np.full(len(rows), most), np.zeros(len(rows), np.int64)
    for j in range(CHOICE):
        new = rows[:, j] <= least
        least[new], where[new] = rows[new, j], j
    whole = whole[least[whole] < most]
    chosen = np.unique(whole + where[whole])
    return chosen, hashes[chosen]


def spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word within it, number of words and hash of each span."""
    from . import textvec as tv

    starts, ends, begin, own, first, marked = sentences(raw, offs)
    n = len(begin) - 1
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    words = tv.span_hashes(tv.LOWER[raw], starts, ends)
    doc = np.repeat(np.arange(len(own) - 1), np.diff(own))
    stop = np.maximum(np.searchsorted(begin, begin[:-1] + LEAST_WORDS), np.arange(n) + LEAST_SENTENCES)
    start = np.minimum(np.searchsorted(begin, begin[1:] - LEAST_WORDS, "right"), np.arange(1, n + 1) - LEAST_SENTENCES + 1) - 1
    at, back = np.flatnonzero(stop <= own[doc + 1]), np.flatnonzero(start >= own[doc])
    back = back[stop[start[back]] != back + 1]
    at, stop = np.concatenate([at, start[back]]), np.concatenate([stop[at], back + 1])
    doc, at, size = doc[at], begin[at], begin[stop] - begin[at]
    power, inverse = tv._power(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * power[: len(words)], out=total[1:])
        hashes = tv.mix((total[at + size] - total[at]) * inverse[at] + size.astype(np.uint64), 9)
    more, others = _windows(total, inverse, words, first, marked)
    doc = np.concatenate([doc, np.searchsorted(first, more, "right") - 1])
    at, size = np.concatenate([at, more]), np.concatenate([size, np.full(len(more), WINDOW)])
    return doc, at - first[doc], size, np.concatenate([hashes, others])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import textvec as tv

    for batch in batches:
        row, order = batch.column("row"), batch.column("ord")
        for start, raw, offs in tv.blocks(batch.column("text")):
            doc, pos, size, hashes = spans(raw, offs)
            at = pa.array(doc + start)
            yield pa.RecordBatch.from_arrays(
                [row.take(at), order.take(at), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(hashes.view(np.int64))],
                names=["row", "ord", "pos", "size", "h"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words that found covers: (position, number) pairs of each text."""
    from . import textvec as tv

    for batch in batches:
        found, texts = batch.column("found").to_pylist(), batch.column("text")
        for start, raw, offs in tv.blocks(texts):
            starts, ends, begin, own, first, _ = sentences(raw, offs)
            count = np.diff(own)
            gone, words, out = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64), [None] * len(count)
            for k in range(len(count)):
                here = found[start + k]
                if not here:
                    continue
                depth = np.zeros(first[k + 1] - first[k] + 1, np.int64)
                for x in here:
                    depth[x["pos"]] += 1
                    depth[x["pos"] + x["size"]] -= 1
                covered = np.cumsum(depth[:-1]) > 0
                words[k] = covered.sum()
                gone[k] = np.logical_or.reduceat(covered, begin[own[k] : own[k + 1]] - first[k]).sum()
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
                keep = np.ones(offs[k + 1] - offs[k], bool)
                for i, j in edges.reshape(-1, 2) + first[k]:
                    stop = starts[j] if j < first[k + 1] else ends[j - 1]
                    keep[starts[i] - offs[k] : stop - offs[k]] = False
                out[k] = raw[offs[k] : offs[k + 1]][keep].tobytes().decode()
            own_texts = texts.slice(start, len(count))
            text = pa.compute.if_else(pa.array(gone > 0), pa.array(out, pa.string()), own_texts.cast(pa.string())) if (gone > 0).any() else own_texts.cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(count)), text, pa.array(count, pa.int64()), pa.array(gone), pa.array(words), pa.array(gone > 0)],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed_words", "changed"],
            )


def dedup_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed_words, changed) for each row of docs; text is what stays."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("ord"))
    found = rows.select("row", "ord", "text").mapInArrow(_span_rows, "row long, ord long, pos int, size int, h long")
    counted = found.select("h", "ord", "pos").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"), F.min(F.struct("ord", "pos"))["pos"].alias("p"))
    # written down: the join then reads two plain exchanges, of which Spark splits the parts with hot spans
    repeated = materialise(counted.where("n > 1").select("h", "o", "p"), "repeated")
    later = found.join(repeated, "h").where("ord > o OR (ord = o AND pos > p)")
    marked = later.groupBy("row").agg(F.collect_set(F.struct("pos", "size")).alias("found"))
    joined = rows.join(marked, "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_cut, "doc_id long, text string, n_sentences long, n_removed long, removed_words long, changed boolean")
