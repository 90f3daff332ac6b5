"""A quality classifier on random Fourier features (operator 4).

Statistics of the text (lengths, character classes, repetition) are standardised and mapped to FEATURES random cosines,
whose inner products approximate a Gaussian kernel of width WIDTH.  Normal equations are summed within each partition,
then over groups of partitions, and solved once for ridge weights; the raw scores are calibrated by isotonic regression
on labelled rows that the weights have not seen.  What reaches the driver is a fixed number of matrices and of score
bins, whatever the number of rows.

The statistics are computed once, written to the shared folder (a hundred bytes a row) and used by all later passes.

Defined cases: null and blank texts are empty texts, scored like others; labels that are null, or belong to no row, are
ignored; without labels of both classes every score is the share of label 1, or 0.5 without labels; a doc_id that is
labelled twice counts twice; a null doc_id is held in, and has no label; an empty table gives no rows; columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, materialise

FEATURES, WIDTH, RIDGE = 192, 4.0, 1.0
BINS, LOW, HIGH = 2048, -1.0, 2.0
PARTS = 16
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "bars", "shouts", "digits", "lines", "marks", "non_ascii", "same_as_last",
    "same_as_before_last", "one_letter", "long_words", "space", "sentence_ends", "capitalised",
)


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a block."""
    from . import textvec as tv

    n = len(offs) - 1
    starts, ends, first = tv.word_spans(~tv.SPACE[raw], offs)
    size, words = np.diff(offs), np.diff(first)

    def per_byte(*members: int | range) -> np.ndarray:
        table = np.zeros(256, np.int64)
        for m in members:
            table[m if isinstance(m, int) else list(m)] = 1
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return total[offs[1:]] - total[offs[:-1]]

    def per_word(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[first[1:]] - total[first[:-1]]

    upper, letters = per_byte(range(65, 91)), per_byte(range(65, 91), range(97, 123), range(128, 256))
    length = ends - starts
    h = tv.span_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(n), words)
    same = [np.zeros(len(h), bool) for _ in range(2)]
    for k in (1, 2):
        same[k - 1][k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
    head = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    tail = raw[ends - 1] if len(starts) else head
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    return np.stack([
        np.log1p(size), np.log1p(words), per_word(length) / w, upper / np.maximum(letters, 1), per_byte(*b"#*$%&<>") / w, per_byte(ord("|")) / w,
        per_byte(ord("!")) / w, per_byte(range(48, 58)) / b, per_byte(10) / w, per_byte(*b".,;:?") / w, per_byte(range(192, 256)) / b,
        per_word(same[0]) / w, per_word(same[1]) / w, per_word(length == 1) / w, per_word(length > 12) / w, per_byte(9, 10, 11, 12, 13, 32) / b,
        per_word(np.isin(tail, list(b".!?"))) / w, per_word((head >= 65) & (head <= 90)) / w,
    ], axis=1).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import textvec as tv

    for batch in batches:
        for start, raw, offs in tv.blocks(batch.column("text")):
            x = statistics(raw, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(x)), lists], names=["doc_id", "x"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(len(batch), -1).astype(np.float64)


class Model:
    """Standardisation, random cosines, ridge weights and a calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(41)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(0, 1 / width, (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve = (np.array([LOW, HIGH]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.turn
        z += self.phase
        np.cos(z, out=z)
        z *= np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares, by pooling neighbours."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _summed(df: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all rows of f(batch), a vector of `size` numbers: within partitions, in PARTS groups, then here."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += f(batch)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(partition, "v binary").repartition(PARTS).mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r.v) for r in rows), np.zeros(size))


def train(measured: DataFrame, labels: DataFrame, features: int = FEATURES) -> Model:
    """A model from the labels of rows that are not held out: three remainders for the weights, one for the curve."""
    d = len(STATISTICS)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").cast("double").alias("y"), crc_mod(F.col("doc_id"), 5).alias("part"))
    rows = materialise(measured.join(known, "doc_id").select("x", "y", "part"), "labelled")
    moments = _summed(rows, lambda b: np.concatenate([[len(b), b.column("y").to_numpy().sum()], _rows(b).sum(axis=0), (_rows(b) ** 2).sum(axis=0)]), 2 + 2 * d)
    n, positive = moments[:2]
    if not 0 < positive < n:
        model = Model(np.zeros(d), np.ones(d), features)
        model.curve = (np.array([LOW, HIGH]), np.full(2, positive / n if n else 0.5))
        return model
    mean = moments[2 : 2 + d] / n
    model = Model(mean, np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 1e-12)) + 1e-6, features)
    m = features + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_rows(batch)), batch.column("y").to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows.where("part <> 4"), equations, m * m + m)
    penalty = RIDGE * np.eye(m)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(sums[: m * m].reshape(m, m) + penalty, sums[m * m :])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_rows(batch)) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, batch.column("y").to_numpy(), BINS)])

    held = _summed(rows.where("part = 4"), bins, 2 * BINS)
    count, ones = held[:BINS], held[BINS:]
    used = np.flatnonzero(count)
    if len(used):
        middle = LOW + (used + 0.5) * (HIGH - LOW) / BINS
        model.curve = (middle, isotonic(ones[used] / count[used], count[used]))
    else:
        model.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    measured = materialise(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<float>"), "statistics")
    model = train(measured, labels, features)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_rows(batch)))], names=["doc_id", "score"])

    scored = measured.mapInArrow(apply, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
