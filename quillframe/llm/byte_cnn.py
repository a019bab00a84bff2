"""Document quality by a byte-level convolutional network in numpy.

A filter is a table of one weight per offset and byte value, so a convolution
is a sum of ``WIDTH`` table rows and needs no embedding. The text's UTF-8 bytes
are covered by chunks of ``CHUNK`` window starts; neighbouring chunks overlap
by ``WIDTH - 1`` bytes, so every window of the document lies in one chunk. Each
filter is max-pooled inside a chunk; the document's features are the largest
and the mean of its chunks' pooled values, and one logistic unit combines them
into the probability that the quality label is 1.

Training (driver, numpy, Adam) is bounded: ``per_class`` documents of each
class, of a longer document one crop of ``max_chars`` characters. Scoring
reads whole texts of any length in blocks of bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from quillframe.llm.common import extend, held_out, label_share, labelled_sample, table

WIDTH, FILTERS, CHUNK = 10, 24, 256
BLOCK = 16 * CHUNK
PAD = 0  # never inside valid text that matters: NUL


@dataclass
class ByteCnn:
    """Weights: ``tables`` (WIDTH, 256, FILTERS), ``out`` (2 * FILTERS), ``bias``."""

    tables: np.ndarray
    out: np.ndarray
    bias: float

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS) maxima of a document's bytes."""
        n = max(1, len(data) - WIDTH + 1)
        if len(data) < WIDTH:
            data = np.concatenate([data, np.full(WIDTH - len(data), PAD, np.uint8)])
        parts = []
        for at in range(0, n, BLOCK):
            m = min(BLOCK, n - at)
            conv = self._conv(data[at : at + m + WIDTH - 1], m)
            full = m // CHUNK * CHUNK
            if full:
                parts.append(conv[:full].reshape(-1, CHUNK, FILTERS).max(axis=1))
            if full < m:
                parts.append(conv[full:].max(axis=0)[None])
        return np.concatenate(parts)

    def _conv(self, data: np.ndarray, m: int) -> np.ndarray:
        conv = self.tables[0].take(data[:m], axis=0)
        row = np.empty_like(conv)
        for k in range(1, WIDTH):
            self.tables[k].take(data[k : k + m], axis=0, out=row, mode="clip")
            conv += row
        return conv

    def logit(self, text: str) -> float:
        top = self.pooled(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))
        return float(top.max(axis=0) @ self.out[:FILTERS] + top.mean(axis=0) @ self.out[FILTERS:] + self.bias)

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(text), -30, 30)))


def train(sample: list[tuple[str, int]], prior: float, epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 11) -> ByteCnn:
    """Fit the network to (text, label) pairs; ``prior`` is the share of label 1 to calibrate to."""
    rng = np.random.default_rng(seed)
    net = ByteCnn((rng.standard_normal((WIDTH, 256, FILTERS)) * 0.15).astype(np.float32), (rng.standard_normal(2 * FILTERS) * 0.3).astype(np.float32), 0.0)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not sample or len({y for _, y in sample}) < 2:
        net.out[:] = 0
        net.bias = float(np.log(prior / (1 - prior)))
        return net
    docs = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, _ in sample]
    docs = [d if len(d) >= WIDTH else np.concatenate([d, np.full(WIDTH - len(d), PAD, np.uint8)]) for d in docs]
    label = np.array([y for _, y in sample], np.float32)
    share = float(label.mean())
    params = [net.tables, net.out, np.zeros(1, np.float32)]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            step += 1
            grads = [np.zeros_like(p) for p in params]
            code, slot, pull = [], [], []
            for i in part:
                d = docs[i]
                n = len(d) - WIDTH + 1
                conv = net._conv(d, n)
                starts = np.arange(0, n, CHUNK)
                arg = np.stack([conv[s : s + CHUNK].argmax(axis=0) + s for s in starts])
                top = conv[arg, np.arange(FILTERS)]
                best = top.argmax(axis=0)
                high, mean = top[best, np.arange(FILTERS)], top.mean(axis=0)
                z = high @ net.out[:FILTERS] + mean @ net.out[FILTERS:] + params[2][0]
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[i]
                grads[1][:FILTERS] += g * high
                grads[1][FILTERS:] += g * mean
                grads[2] += g
                d_top = np.broadcast_to(g * net.out[FILTERS:] / len(starts), top.shape).copy()
                d_top[best, np.arange(FILTERS)] += g * net.out[:FILTERS]
                code.append(d[arg[:, :, None] + np.arange(WIDTH)].reshape(-1, WIDTH))
                slot.append(np.tile(np.arange(FILTERS), len(starts)))
                pull.append(d_top.ravel())
            code, slot, pull = np.concatenate(code), np.concatenate(slot), np.concatenate(pull)
            for k in range(WIDTH):
                at = code[:, k].astype(np.int64) * FILTERS + slot
                grads[0][k] = np.bincount(at, pull, 256 * FILTERS).reshape(256, FILTERS)
            lr = rate * (1 - 0.8 * epoch / epochs)
            for j, p in enumerate(params):
                gj = grads[j] / len(part) + 1e-4 * p
                m1[j] += 0.1 * (gj - m1[j])
                m2[j] += 0.01 * (gj * gj - m2[j])
                p -= lr * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.99**step)) + 1e-8)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    net.bias = float(params[2][0] + shift)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 800, max_chars: int = 4000) -> ByteCnn:
    """Learn from at most ``per_class`` training documents of each class.

    The prior comes from all training labels. Without labels of both classes
    every text scores the prior (0.5 without any label).
    """
    return train(labelled_sample(docs, labels, "quality", per_class, max_chars), label_share(labels, "quality"))


def score_quality(docs: DataFrame, net: ByteCnn, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a ``score`` column (replaced if it exists).

    Null text scores as empty. Repeated rows score alike, an empty table gives
    an empty result, a text of any length is read whole in blocks, and all
    other columns pass unchanged.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def make():
        model = shipped.value
        return lambda texts: ([float(model.score(t or "")) for t in texts],)

    return extend(docs.drop(score_col), [text_col], [StructField(score_col, DoubleType())], make)


def op7_quality(spark, sf_dir):
    """Per row of ``documents``: doc_id, held_out, score, predicted (score >= 0.3).

    A null doc_id is never held out; nulls, repeats, long and empty texts are
    treated as ``score_quality`` says.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, net).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
