r"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

Two gated recurrent layers of HIDDEN units, one in each direction, read the UTF-8 bytes of a text in segments of
SEGMENT bytes (each starts from a zero state); from both states at a position a softmax gives the language of that
position; a text's probabilities are the mean over all its positions, whatever its length.  Gates and candidates use
x / (1 + |x|), scaled to (0, 1) for gates, in place of sigmoid and tanh: no exponentials in the recurrence.

Training is backpropagation through time with Adam, in numpy, on the driver, over at most TRAIN_PER_LANG texts of each
language and one segment of each, drawn by hash; that bound is the operator's parameter.  Inference is one map over the
texts without a shuffle; thousands of segments advance together, so that Python works per step, not per byte.

Defined cases: null texts, and texts without a letter, are `und` with score 0; without labelled rows every text is;
repeated rows each get a row; an empty table gives no rows; columns other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, giving_back

HIDDEN = 8
SEGMENT = 128
TRAIN_PER_LANG = 1500
STEPS, BATCH, RATE = 260, 192, 0.02
#: Bytes of texts that are looked at together, and segments that advance together; they bound a worker's memory.
BLOCK, TOGETHER = 1 << 19, 1024
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _soft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x / (1 + |x|) and its derivative."""
    d = 1 / (1 + np.abs(x))
    return x * d, d * d


class Network:
    """Weights of both directions and of the output.  Gate order: reset, update."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN):
        self.langs, self.hidden = langs, hidden
        if weights is None:
            rng, h = np.random.default_rng(17), hidden
            weights = {"out": rng.normal(0, 0.3, (2 * h, len(langs))), "bias": np.zeros(len(langs))}
            for d in "fb":
                weights |= {f"xg{d}": rng.normal(0, 0.3, (256, 2 * h)), f"xc{d}": rng.normal(0, 0.5, (256, h)), f"hg{d}": rng.normal(0, 0.3, (h, 2 * h)), f"hc{d}": rng.normal(0, 0.3, (h, h))}
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def _direction(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, batch, hidden) over bytes x (steps, batch), and what the way back needs."""
        h, kept = np.zeros((x.shape[1], self.hidden), np.float32), []
        states = np.zeros((*x.shape, self.hidden), np.float32)
        for t in range(len(x)):
            s, ds = _soft(self.w[f"xg{d}"][x[t]] + h @ self.w[f"hg{d}"])
            g = 0.5 + 0.5 * s
            r, z = g[:, : self.hidden], g[:, self.hidden :]
            c, dc = _soft(self.w[f"xc{d}"][x[t]] + (r * h) @ self.w[f"hc{d}"])
            new = h + z * (c - h)
            kept.append((h, r, z, c, 0.5 * ds, dc))
            h = states[t] = new
        return states, kept

    def _back(self, d: str, x: np.ndarray, kept: list, into: np.ndarray, grad: dict) -> None:
        """Backpropagation through time; into: gradient with respect to the states."""
        n = self.hidden
        dh = np.zeros_like(into[0])
        for t in range(len(x) - 1, -1, -1):
            h, r, z, c, dg, dc = kept[t]
            total = dh + into[t]
            da = total * z * dc
            drh = da @ self.w[f"hc{d}"].T
            dgate = np.concatenate([drh * h * dg[:, :n], total * (c - h) * dg[:, n:]], axis=1)
            grad[f"hc{d}"] += (r * h).T @ da
            grad[f"hg{d}"] += h.T @ dgate
            np.add.at(grad[f"xc{d}"], x[t], da)
            np.add.at(grad[f"xg{d}"], x[t], dgate)
            dh = total * (1 - z) + drh * r + dgate @ self.w[f"hg{d}"].T

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the true positions of x (steps, batch), and its gradient."""
        forth, kept_f = self._direction("f", x)
        back, kept_b = self._direction("b", x[::-1])
        both = np.concatenate([forth, back[::-1]], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        at = np.broadcast_to(np.arange(x.shape[1]), x.shape), np.broadcast_to(y, x.shape)
        rows = np.arange(len(x))[:, None]
        loss = float(-(np.log(p[rows, at[0], at[1]] + 1e-9) * mask).sum() / mask.sum())
        p[rows, at[0], at[1]] -= 1
        p *= (mask / mask.sum())[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["out"] = np.einsum("tbh,tbk->hk", both, p)
        grad["bias"] = p.sum(axis=(0, 1))
        into = p @ self.w["out"].T
        self._back("f", x, kept_f, into[:, :, : self.hidden], grad)
        self._back("b", x[::-1], kept_b, into[::-1, :, self.hidden :], grad)
        return loss, grad

    def states(self, d: str, x: np.ndarray) -> np.ndarray:
        """As _direction, for inference: no copies, no derivatives."""
        n, steps, b = self.hidden, *x.shape
        out = np.empty((steps, b, n), np.float32)
        h = np.zeros((b, n), np.float32)
        g, tg, c, tc = np.empty((b, 2 * n), np.float32), np.empty((b, 2 * n), np.float32), np.empty((b, n), np.float32), np.empty((b, n), np.float32)
        xg, xc, hg, hc = (self.w[k + d] for k in ("xg", "xc", "hg", "hc"))
        for t in range(steps):
            np.matmul(h, hg, out=g)
            g += xg.take(x[t], axis=0)
            np.abs(g, out=tg)
            tg += 1
            tg += tg  # halves the quotient
            g /= tg
            g += 0.5
            np.multiply(g[:, :n], h, out=tc)
            np.matmul(tc, hc, out=c)
            c += xc.take(x[t], axis=0)
            np.abs(c, out=tc)
            tc += 1
            c /= tc
            c -= h
            c *= g[:, n:]
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, batch, languages) for bytes x (steps, batch)."""
        logits = self.states("f", x) @ self.w["out"][: self.hidden]
        logits += self.states("b", x[::-1])[::-1] @ self.w["out"][self.hidden :]
        logits += self.w["bias"]
        np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits


def segments(raw: np.ndarray, offs: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the segments of the texts begin, their lengths, and the first segment of each text."""
    size = np.diff(offs)
    count = -(-size // length)
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(offs[:-1] - first[:-1] * length, count) + np.arange(first[-1]) * length
    return begin, np.minimum(length, np.repeat(offs[1:], count) - begin), first


def matrix(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, steps: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, segments), 0 beyond a segment's end, and which are true."""
    at = begin[None, :] + np.arange(steps)[:, None]
    mask = np.arange(steps)[:, None] < length[None, :]
    return np.where(mask, raw[np.minimum(at, max(0, len(raw) - 1))], 0), mask


def fit(x: np.ndarray, mask: np.ndarray, y: np.ndarray, langs: list[str], steps: int = STEPS) -> Network:
    net, rng = Network(langs), np.random.default_rng(23)
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.choice(len(y), min(BATCH, len(y)), replace=False)
        _, grad = net.gradient(x[:, pick], mask[:, pick].astype(np.float32), y[pick])
        rate = RATE * min(1, 2 - 2 * step / (steps + 1))
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Network | None:
    """A network from at most per_lang labelled texts of each language (one segment each); rows that are held out don't count."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(docs))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # by hash, so many that per_lang are hardly ever missed, and then per_lang at most
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.2 * per_lang / n + 50 / n)).otherwise(share)
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share * float(1 << 30))
    piece = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.char_length("text") - SEGMENT + 1, F.lit(1)))
    rows = some.select("doc_id", "lang", F.substring("text", (piece + 1).cast("int"), F.lit(SEGMENT)).alias("t")).orderBy(F.xxhash64("doc_id", F.lit(1)), "t").limit(len(counts) * (2 * per_lang + 100)).collect()
    langs, taken, texts, y = sorted(counts), dict.fromkeys(counts, 0), [], []
    for r in rows:
        if taken[r.lang] < per_lang and r.t:
            taken[r.lang] += 1
            texts.append(r.t.encode()[:SEGMENT])
            y.append(langs.index(r.lang))
    if not texts:
        return None
    size = np.array(list(map(len, texts)))
    x, mask = matrix(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)
    return fit(x, mask, np.array(y), langs)


def held_out(docs: DataFrame):
    """Rows whose language training never sees."""
    return F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_positions, probabilities) for each row."""
    langs, weights = (net.langs, net.w) if net else ([], {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import textvec as tv

        own = Network(langs, weights) if langs else None
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch in batches:
            for start, raw, offs in tv.blocks(batch.column("text"), BLOCK):
                n = len(offs) - 1
                total = np.zeros((n, max(1, len(langs))))
                if own and len(raw):
                    begin, length, first = segments(raw, offs)
                    sums = np.zeros((len(begin), len(langs)))
                    for k in range(0, len(begin), TOGETHER):
                        x, mask = matrix(raw, begin[k : k + TOGETHER], length[k : k + TOGETHER])
                        p = own.position_probabilities(x)
                        if not mask.all():
                            p *= mask[:, :, None]
                        sums[k : k + TOGETHER] = p.sum(axis=0)
                    full = np.flatnonzero(first[1:] > first[:-1])
                    total[full] = np.add.reduceat(sums, first[:-1][full])
                    total[full] /= np.diff(offs)[full][:, None]
                letters = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
                has = letters[offs[1:]] > letters[offs[:-1]]
                for k in np.flatnonzero(~has):
                    has[k] = bool(_LETTER.search(raw[offs[k] : offs[k + 1]].tobytes().decode()))
                best = total.argmax(axis=1)
                names = [langs[b] if h and langs else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score = np.where(has & bool(langs), np.clip(total[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, n), pa.array(names, pa.string()), pa.array(score), pa.array(np.diff(offs))],
                    names=["doc_id", "lang_pred", "score", "n_positions"],
                )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, lang_pred string, score double, n_positions long")


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_positions): train on the rows that aren't held out, predict all."""
    out = predict(docs, train(docs, per_lang))
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "n_positions")
