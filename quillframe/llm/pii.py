"""Personal data: fixed patterns, and a skip-chain conditional random field.

Tokens that hold a digit or an at sign are the nodes of a document's graph;
their labels are the four kinds or none. A token that a base pattern covers is
observed with that kind. Neighbouring tokens share chain potentials, and each
token shares a skip potential with hubs of its value, the tokens of the same
digits or the same letters, wherever they are: the first observed mention of
each kind, or else the first mention (at most four links a token and value).
Observed evidence reaches every repeat in one hop. Sum-product loopy message
passing, until the messages rest, then labels the rest; tokens whose kind is
the likeliest and above ``least`` become added spans. Base spans always stay.

Potentials are learned by pseudo-likelihood from a bounded sample of crops, at
hashed offsets, with the base patterns as the labels.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from quillframe.llm.common import extend, sampled_crops, table
from quillframe.llm.spans import digest, joined, ordered

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is none
# The base patterns. A look-behind only saves restarts inside a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
CUE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
TRIM = "\"'()[]{}<>,;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def email_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the email pattern, found from their at signs: a local part runs up to one."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = email_spans(text) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return ordered(out, KINDS)


@dataclass
class Graph:
    """Tokens of one or more texts: features, observed labels (-1: open), chain and skip links."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _features(token: str, digits: str, gap: int) -> list[float]:
    n, k = len(token), len(digits)
    return [
        1.0, "@" in token, token.count("@") > 1, "." in token.partition("@")[2], token.count(".") == 3, token.startswith("+"), "(" in token or ")" in token,
        "-" in token, "/" in token or ":" in token, k == 0, 1 <= k <= 2, 3 <= k <= 4, 5 <= k <= 8, 9 <= k <= 11, 12 <= k <= 15, 16 <= k <= 19, k > 19,
        k == n, 2 * k >= n, token.isalnum() and 0 < k < n, 12 <= k <= 19 and luhn(digits), gap <= 1, all(c in "0123456789." for c in token),
    ]


def graph_of(text: str, base: list[tuple[str, int, int]]) -> Graph | None:
    if not CUE.search(text):
        return None
    spans, rows, observed, chain, values = [], [], [], [], {}
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    at = 0  # base spans before this one end before the token
    for m in TOKEN.finditer(text):
        if not CUE.search(m[0]):
            continue
        a, b = m.span()
        while a < b and text[a] in TRIM:
            a += 1
        while b > a and text[b - 1] in TRIM:
            b -= 1
        if a == b:
            continue
        token = text[a:b]
        digits = _digits(token)
        i = len(spans)
        gap = a - spans[-1][1] if spans else 99
        if gap <= 2:
            chain.append((i - 1, i))
        for key in {digits if len(digits) >= 4 else "", token.lower()}:
            if len(key) >= 4:
                values.setdefault(key, []).append(i)
        while at < len(base) and reach[at] <= a:
            at += 1
        label, k = -1, at
        while label < 0 and k < len(base) and base[k][1] < b:
            if a < base[k][2]:
                label = KINDS.index(base[k][0]) + 1
            k += 1
        spans.append((a, b))
        rows.append(_features(token, digits, gap))
        observed.append(label)
    if not spans:
        return None
    skip = set()
    for same in values.values():
        hubs = {}
        for i in same:
            if observed[i] >= 0:
                hubs.setdefault(observed[i], i)
        hubs = list(hubs.values()) or same[:1]
        skip |= {(min(h, i), max(h, i)) for h in hubs for i in same if i != h}
    skip = sorted(skip)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(spans, np.array(rows, np.float64), np.array(observed), pairs(chain), pairs(skip))


def union(graphs: list[Graph]) -> Graph:
    shift = np.cumsum([0] + [len(g.spans) for g in graphs[:-1]])
    return Graph(
        [s for g in graphs for s in g.spans], np.concatenate([g.features for g in graphs]), np.concatenate([g.observed for g in graphs]),
        np.concatenate([g.chain + k for g, k in zip(graphs, shift)]), np.concatenate([g.skip + k for g, k in zip(graphs, shift)]),
    )


@dataclass
class SkipChain:
    """Log potentials: unary by feature, chain (left label, right label), skip (symmetric)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    least: float = 0.6
    rest: float = 1e-4

    def marginals(self, g: Graph) -> np.ndarray:
        """(tokens, labels) beliefs after damped sum-product message passing over all links."""
        score = g.features @ self.unary
        local = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -30, 0))
        seen = g.observed >= 0
        known = np.eye(LABELS)[g.observed[seen]]
        local[seen] = 1e-9
        local[np.nonzero(seen)[0], g.observed[seen]] = 1.0
        local /= local.sum(axis=1, keepdims=True)
        links = np.concatenate([g.chain, g.skip])
        if not len(links):
            return local
        size = len(local)
        kernel = np.exp(np.stack([self.chain, self.skip]))
        kind = np.concatenate([np.zeros(len(g.chain), int), np.ones(len(g.skip), int)])
        a, b = links[:, 0], links[:, 1]
        right = np.full((len(links), LABELS), 1.0 / LABELS)  # a to b
        left = right.copy()  # b to a
        for _ in range(2 * size + 20):  # no path is longer than the tokens; a damped message goes half its way a round
            belief = np.log(local)
            for l in range(LABELS):
                belief[:, l] += np.bincount(b, np.log(right[:, l]), size) + np.bincount(a, np.log(left[:, l]), size)
            belief = np.exp(np.clip(belief - belief.max(axis=1, keepdims=True), -60, 0))
            belief[seen] = known  # however many repeats speak against it
            out_a, out_b = belief[a] / left, belief[b] / right
            new_right = np.einsum("el,elm->em", out_a, kernel[kind])
            new_left = np.einsum("em,elm->el", out_b, kernel[kind])
            old_right, old_left = right, left
            right = 0.5 * right + 0.5 * np.maximum(new_right / new_right.sum(axis=1, keepdims=True), 1e-9)
            left = 0.5 * left + 0.5 * np.maximum(new_left / new_left.sum(axis=1, keepdims=True), 1e-9)
            if max(np.abs(right - old_right).max(), np.abs(left - old_left).max()) < self.rest:
                break
        belief = np.log(local)
        for l in range(LABELS):
            belief[:, l] += np.bincount(b, np.log(right[:, l]), size) + np.bincount(a, np.log(left[:, l]), size)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        belief[seen] = known
        return belief / belief.sum(axis=1, keepdims=True)

    def added(self, graphs: list[Graph]) -> list[list[tuple[str, int, int]]]:
        """New spans of each graph: open tokens whose likeliest label is a kind, above ``least``."""
        if not graphs:
            return []
        g = union(graphs)
        m = self.marginals(g)
        best = m.argmax(axis=1)
        out, at = [], 0
        for each in graphs:
            n = len(each.spans)
            out.append([(KINDS[best[at + i] - 1], *each.spans[i]) for i in range(n) if each.observed[i] < 0 and best[at + i] > 0 and m[at + i, best[at + i]] >= self.least])
            at += n
        return out


def train(texts: list[str], steps: int = 150, rate: float = 0.5) -> SkipChain:
    """Pseudo-likelihood fit: each token's label given its features and its neighbours' labels."""
    graphs = [g for t in texts if (g := graph_of(t, base_spans(t)))]
    width = len(_features("1", "1", 0))
    prior = np.zeros((width, LABELS))
    prior[0, 0] = 3.0
    agree = np.eye(LABELS) * 1.0
    if not graphs:
        return SkipChain(prior, agree, agree)
    g = union(graphs)
    y = np.maximum(g.observed, 0)
    hot = np.eye(LABELS)[y]
    around = np.zeros((3, len(y), LABELS))  # labels to the left, to the right, and by skip links
    np.add.at(around[0], g.chain[:, 1], hot[g.chain[:, 0]])
    np.add.at(around[1], g.chain[:, 0], hot[g.chain[:, 1]])
    np.add.at(around[2], g.skip[:, 0], hot[g.skip[:, 1]])
    np.add.at(around[2], g.skip[:, 1], hot[g.skip[:, 0]])
    x = np.concatenate([g.features, *np.minimum(around, 2)], axis=1)
    w = np.zeros((x.shape[1], LABELS))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x.T @ (p - hot) / len(y) + 1e-3 * w)
    u, before, after, skip = np.split(w, [width, width + LABELS, width + 2 * LABELS])
    return SkipChain(u, (before + after.T) / 2, (skip + skip.T) / 2)


def fit_pii(docs: DataFrame, sample_rows: int = 1200, crop: int = 6000) -> SkipChain:
    """Learn from crops of at most ``sample_rows`` documents that hold a digit or an at sign.

    The documents are those with the smallest hashed ids; of a longer text one
    crop of ``crop`` characters at a hashed offset is learned from. Rows without
    an id are not learned from.
    """
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = sampled_crops(docs, ids, crop).collect()
    return train([r.text for r in sorted(rows, key=lambda r: r.doc_id)])


def scan_pii(docs: DataFrame, model: SkipChain) -> DataFrame:
    """One row per input row: doc_id, counts of base spans, the base digest and all spans.

    Null text counts as empty; texts without findings have counts 0 and empty
    ``spans``. Repeated rows repeat; an empty table gives an empty result; a
    text of any length is read whole; other columns are ignored, whatever their
    names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def make():
        field = shipped.value

        def run(texts):
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            graphs = [graph_of(t, b) for t, b in zip(texts, base)]
            added = iter(field.added([g for g in graphs if g]))
            rows = []
            for b, g in zip(base, graphs):
                every = ordered(b + (next(added) if g else []), KINDS)
                rows.append((*(sum(s[0] == k for s in b) for k in KINDS), len(every) - len(b), digest(b), joined(every)))
            return list(zip(*rows))

        return run

    added = [*(StructField(f"n_{k}", LongType()) for k in (*KINDS, "added")), StructField("base_sha256", StringType()), StructField("spans", StringType())]
    return extend(docs.select("doc_id", "text"), ["text"], added, make).drop("text")


def op3_pii(spark, sf_dir):
    """Per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans; see ``scan_pii``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_pii(docs, fit_pii(docs))
