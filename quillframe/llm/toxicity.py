"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries are built by zstandard's dictionary trainer from a bounded
labelled sample, in which near copies count once. The trainer first sees the
texts of both classes without their telling words; what it picks is the larger
and nearer part of both dictionaries, so that ordinary passages cost the same in
both. Then, for each class, it sees what the first pass left out of that class's
texts: words whose beginnings stand in significantly more texts of the class
than of the other. That is the class's own part, filled up with common text to
equal length, so that match distances cost the same too.

A text is cut into overlapping windows that cover all of it. A window's
distance is its compressed length under the ordinary dictionary less that under
the toxic one. The shares of windows at or above each of a few byte thresholds
are weighed by a logistic unit. Its weights and its cut are calibrated on texts
kept aside: the sample is split into ``FOLDS`` parts, and each part is measured
with dictionaries trained on the others. The cut makes 0.5 the score of best F1
at the labels' own class shares.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from dataclasses import dataclass, field

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from quillframe.llm.common import extend, held_out, label_share, labelled_sample, table

WINDOW, STEP, LEVEL = 32, 20, 9
CUTS = (1, 2, 3, 4, 5, 6, 8)
LOW, HIGH = -8, 24  # distances beyond are counted as these
SHARED, OWN = 14_000, 1_400  # bytes of a dictionary
FOLDS = 5
LETTERS = re.compile(r"[^\W\d_]+")


def beginnings(text: str) -> set[str]:
    """Prefixes of 3 to 11 letters and whole words, each with its leading blank."""
    found = set()
    for w in set(LETTERS.findall(text)):
        found.update(" " + w[:n] for n in range(3, min(11, len(w)) + 1))
        found.add(f" {w} ")
    return found


def distinct_texts(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies: a text that shares one of four minima of its word 4-grams goes."""
    seen, out = set(), []
    for text, y in sample:
        words = text.lower().split()
        grams = np.array([xxhash.xxh32_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))], np.uint64)
        keys = {(j, int(((grams * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for j, m in enumerate((1, 2654435761, 2246822519, 3266489917))}
        if not keys & seen:
            out.append((text, y))
        seen |= keys
    return out


def telling(df: list[Counter], n: list[int], y: int, least_z: float = 4.5, least_ratio: float = 2.5, most: int = 400) -> list[str]:
    """Word beginnings of class y by significance; one that extends or shortens a chosen one is left out."""
    found = []
    for f, v in df[y].items():
        o = df[1 - y].get(f, 0)
        p, q, pooled = (v + 0.5) / (n[y] + 1), (o + 0.5) / (n[1 - y] + 1), (v + o + 1) / (n[0] + n[1] + 2)
        z = (p - q) / math.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
        if v >= 3 and z >= least_z and p >= least_ratio * q:
            found.append((-z, -len(f), f))
    out = []
    for _, _, f in sorted(found):
        if not any(f.startswith(g.rstrip()) or g.startswith(f.rstrip()) for g in out):
            out.append(f)
        if len(out) == most:
            break
    return out


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """What zstandard's trainer picks from the samples, best last, cut to ``size`` bytes."""
    try:
        return zstandard.train_dictionary(size + 1024, samples, k=segment, d=6, steps=1).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(samples)[-size:]


def dictionaries(sample: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents of equal length from (text, label) pairs."""
    df, n = [Counter(), Counter()], [0, 0]
    plain = []
    for text, y in sample:
        n[y] += 1
        df[y].update(beginnings(text.lower()))
        plain.append(" " + " ".join(LETTERS.findall(text.lower())) + " ")
    left, own = plain, []
    for y in (0, 1):
        chosen = [f.rstrip() for f in telling(df, n, y)] if min(n) else []
        if not chosen:
            own.append(b"")
            continue
        pattern = re.compile("(?:" + "|".join(sorted(map(re.escape, chosen), key=len, reverse=True)) + r")\w*")
        seen = ["".join(pattern.findall(t)) for t, (_, label) in zip(plain, sample) if label == y]
        own.append(trained([(t + " ").encode("utf-8", "replace") for t in seen if t], OWN, 24))
        left = [pattern.sub("", t) for t in left]
    shared = trained([t[i : i + 400].encode("utf-8", "replace") for t in left for i in range(0, len(t), 400)], SHARED + OWN, 48)
    longest = max(map(len, own))
    rest = shared[longest:]
    return tuple(shared[: longest - len(x)] + x + rest for x in own)


@dataclass
class ToxicityModel:
    """Dictionary contents and the logistic unit over window shares."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float
    _coders: tuple = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights, self.bias

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights, self.bias = state
        self._coders = None

    def coders(self):
        if self._coders is None:
            made = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False
                )
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self._coders = tuple(made)
        return self._coders

    def distances(self, text: str) -> np.ndarray:
        """How many windows of the text have each distance from ``LOW`` to ``HIGH``."""
        data = text.lower().encode("utf-8", "replace")
        plain, toxic = self.coders()
        out = [0] * (HIGH - LOW + 1)
        known: dict[bytes, int] = {}
        for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP):
            w = data[i : i + WINDOW]
            at = known.get(w)
            if at is None:
                if len(known) > 50_000:
                    known.clear()
                at = known[w] = min(HIGH, max(LOW, len(plain(w)) - len(toxic(w)))) - LOW
            out[at] += 1
        return np.array(out)

    def features(self, text: str) -> np.ndarray:
        count = self.distances(text)
        n, value = count.sum(), np.arange(LOW, HIGH + 1)
        share = np.array([count[k - LOW :].sum() / n for k in CUTS])
        return np.concatenate([np.sqrt(share), [value[count > 0].max() / 4, (np.clip(value, -2, 8) * count).sum() / n, math.log(n) / 4]])

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, float(self.features(text) @ self.weights) + self.bias))))


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Weights and bias of a ridge logistic regression with row weights, by Newton steps."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    ridge = np.diag([0.3] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        h = (xb * (each * p * (1 - p) + 1e-9)[:, None]).T @ xb + ridge
        step = np.linalg.solve(h, xb.T @ (each * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray, each: np.ndarray) -> float:
    """The value of z, between two rows, that gives the largest weighted F1."""
    order = np.argsort(-z, kind="stable")
    caught, false = np.cumsum((each * y)[order]), np.cumsum((each * (1 - y))[order])
    k = int((2 * caught / (caught + false + (each * y).sum())).argmax())
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def train(sample: list[tuple[str, int]], prior: float) -> ToxicityModel:
    """Fit dictionaries and cut to (text, label) pairs; ``prior`` is the share of label 1.

    Without both labels, or with fewer than ``FOLDS`` texts of one, every text scores the prior.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    width = len(CUTS) + 3
    sample = distinct_texts(sample)
    y = np.array([label for _, label in sample], float)
    if min((y == 0).sum(), (y == 1).sum()) < FOLDS:
        return ToxicityModel(b" the and of to in", b" the and of to in", np.zeros(width), math.log(prior / (1 - prior)))
    fold = np.empty(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.random.default_rng(5).permutation(int((y == label).sum())) % FOLDS
    x = np.zeros((len(y), width))
    for k in range(FOLDS):
        measure = ToxicityModel(*dictionaries([s for s, f in zip(sample, fold) if f != k]), np.zeros(width), 0.0)
        for i in np.nonzero(fold == k)[0]:
            x[i] = measure.features(sample[i][0])
    each = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))  # weigh to the labels' class shares
    w = logistic(x, y, each)
    cut = best_cut(x @ w[:-1] + w[-1], y, each)
    return ToxicityModel(*dictionaries(sample), w[:-1], float(w[-1] - cut))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 4000) -> ToxicityModel:
    """Learn from at most ``per_class`` training documents of each class (crops of ``max_chars``).

    Without labels of both classes every text scores the prior (0.5 without
    any label).
    """
    return train(labelled_sample(docs, labels, "toxic", per_class, max_chars), label_share(labels, "toxic"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a ``score`` column (replaced if it exists).

    Null text scores as empty. Repeated rows score alike, an empty table gives
    an empty result, a text of any length is read whole in windows, and all
    other columns pass unchanged.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded length

    def make():
        found = shipped.value
        return lambda texts: ([found.score(t or "") for t in texts],)

    return extend(docs.drop(score_col), [text_col], [StructField(score_col, DoubleType())], make)


def op1_toxicity(spark, sf_dir):
    """Per row of ``documents``: doc_id, held_out, score, predicted (score >= 0.5).

    A null doc_id is never held out; nulls, repeats, long and empty texts are
    treated as ``score_toxicity`` says.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
