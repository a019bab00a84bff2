"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

The vocabulary of a SentencePiece model spans a lattice over the text: every
piece is an edge, and a character that no piece covers is one edge of its UTF-8
byte pieces. Edge weights are a unigram model by rank, ``-log(rank + OFFSET)``,
scaled by ``alpha`` (larger: closer to the best segmentation). Forward
filtering sums the weights of all paths into every node; backward sampling
walks from the end and draws each edge with its exact share. The draws are
hashes of (row key, place in the text, step), so a row's segmentation does not
depend on partitioning, batches or reruns.

Pieces hold blanks only at their front, so the lattice is cut, without losing
a path, into units of blanks and the word after them. The distinct units of a
bounded batch are filtered together, and the draws of all their occurrences
run together, both in numpy. A unit of more than ``LONG_UNIT`` characters is
filtered alone, in blocks: only the sums at the ends of the blocks are kept, and
sampling computes one block after the other again, from the last to the first.
Decoding joins the pieces' bytes and gives the text back exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from quillframe.llm.common import extend, splitmix, table

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET = 20.0
LONG_UNIT = 20_000
UNITS = re.compile(r" *[^ \n]+| +|\n")


@dataclass
class Vocabulary:
    """The pieces as a trie in an open-addressed table, their weights, and the bytes of each id.

    ``keys`` holds ``state << 21 | code point``, ``states`` the state that
    follows; ``piece`` is the id that ends in a state, or -1. Blanks are spaces.
    """

    keys: np.ndarray
    states: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    fallback: float
    byte_id: list[int]
    bytes_of: list[bytes]

    BITS = 19
    LONGEST = 16

    @staticmethod
    def load(model_path: str = DEFAULT_MODEL) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        bytes_of, byte_id, pieces = [], [0] * 256, []
        for i in range(len(model)):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(text[3:-1], 16)] = i
                bytes_of.append(bytes([int(text[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bytes_of.append(b"")
            else:
                text = text.replace("\u2581", " ")
                bytes_of.append(text.encode())
                pieces.append((-model.get_score(i), i, text))
        weight = np.zeros(len(model))
        follow, ends = {}, {}
        for rank, (_, i, text) in enumerate(sorted(pieces)):
            weight[i] = -math.log(rank + OFFSET)
            state = 0
            for c in text:
                state = follow.setdefault(state << 21 | ord(c), len(follow) + 1)
            ends[state] = i
        if max(len(t) for _, _, t in pieces) > Vocabulary.LONGEST or len(follow) > 1 << (Vocabulary.BITS - 1):
            raise ValueError("the vocabulary has longer or more pieces than the tables allow for")
        keys, states = np.full(1 << Vocabulary.BITS, -1, np.int64), np.zeros(1 << Vocabulary.BITS, np.int32)
        for key, slot in zip(follow, Vocabulary.slots(np.array(list(follow), np.int64)).tolist()):
            while keys[slot] >= 0:
                slot = (slot + 1) % len(keys)
            keys[slot], states[slot] = key, follow[key]
        piece = np.full(len(follow) + 1, -1, np.int32)
        piece[list(ends)] = list(ends.values())
        return Vocabulary(keys, states, piece, weight, -math.log(len(model) + OFFSET), byte_id, bytes_of)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - Vocabulary.BITS)).astype(np.int64)

    def advance(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character; 0 where no piece goes on."""
        key = (state.astype(np.int64) << 21) | char
        slot = self.slots(key)
        found = self.keys[slot]
        todo = np.nonzero((found != key) & (found >= 0))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            found[todo] = self.keys[slot[todo]]
            todo = todo[(found[todo] != key[todo]) & (found[todo] >= 0)]
        return np.where(found == key, self.states[slot], 0)


def edges(chars: np.ndarray, node_of: np.ndarray, left: np.ndarray, nodes: int, width: int, v: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and codes of all edges, by end node and length.

    ``node_of`` is the node before each character and ``left`` the characters
    from there to the unit's end. Weights get a factor per character, which
    changes no share. The code of a piece is its id; of a character that no
    piece covers, its byte's id or minus its code point.
    """
    share = np.zeros((nodes, width))
    code = np.zeros((nodes, width), np.int32)
    lift = 3.0 * alpha
    gain = np.exp(alpha * v.weight)
    at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
    for l in range(width):
        state = v.advance(state, chars[at + l])
        ids = v.piece[state]
        hit = (state > 0) & (ids >= 0)
        to = node_of[at[hit]] + l + 1
        share[to, l] = gain[ids[hit]] * math.exp(lift * (l + 1))
        code[to, l] = ids[hit]
        if l == 0:
            lone = chars[~hit]
            raw = np.array(v.byte_id, np.int64)[np.minimum(lone, 127)]
            size = 1 + (lone > 0x7F) + (lone > 0x7FF) + (lone > 0xFFFF)
            share[node_of[~hit] + 1, 0] = np.exp(alpha * v.fallback * size + lift)
            code[node_of[~hit] + 1, 0] = np.where(lone < 128, raw, -lone)
        go = (state > 0) & (left[at] > l + 1)
        at, state = at[go], state[go]
    return share, code


def sample_long(unit: str, stream: np.uint64, v: Vocabulary, alpha: float, block: int = 4096) -> np.ndarray:
    """The sampled codes of one long unit, in memory of one block and a few numbers a block."""
    chars = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
    n, w = len(chars), v.LONGEST

    def part(start):
        """Shares and codes of the edges that end at nodes start + 1 .. stop."""
        stop, first = min(n, start + block), max(0, start - w)
        piece = chars[first:stop].astype(np.int64)
        at = np.arange(len(piece))
        share, code = edges(piece, at, len(piece) - at, len(piece) + 1, w, v, alpha)
        return share[start - first + 1 :], code[start - first + 1 :]

    def forward(share, sums):
        """Cumulative shares of the block's nodes from the sums at the nodes before it, and the last sums."""
        total = np.concatenate([sums, np.zeros(len(share))])  # nodes start - w + 1 .. start, then the block's
        for p in range(len(share)):
            row = np.cumsum(share[p] * total[p + w - 1 :: -1][:w] if p + w - 1 < w else share[p] * total[p + w - 1 : p - 1 : -1])
            total[p + w] = row[-1]
            share[p] = row / row[-1]
            share[p, int(np.searchsorted(row, row[-1])) :] = 2.0
            if p % 8 == 7:
                total[p : p + w + 1] /= total[p + w]
        return share, total[-w:] / total[-1]

    before = [np.array([0.0] * (w - 1) + [1.0])]
    for start in range(0, n, block):
        before.append(forward(part(start)[0], before[-1])[1])
    taken, node, step = [], n, 0
    for k in reversed(range(len(before) - 1)):
        start = k * block
        share, code = part(start)
        share, _ = forward(share, before[k])
        while node > start:
            draw = int(splitmix(np.array([stream + np.uint64((step * 0x2545F4914F6CDD1D) & (2**64 - 1))]))[0] >> np.uint64(11)) * (1.0 / (1 << 53))
            row = share[node - start - 1]
            edge = int((row <= draw).sum())
            taken.append(code[node - start - 1, edge])
            node, step = node - edge - 1, step + 1
    return np.array(taken[::-1], np.int32)


def filtered(units: list[str], v: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering of units: (end node of each, cumulative shares, codes), by node and edge length.

    A unit of n characters has nodes 0 to n; row ``end - n + p`` of the tables
    belongs to its node p, and column l to the edge of l + 1 characters that
    ends there. Weights get a factor per character and sums are scaled back
    every few steps, which changes no share and keeps any length in range.
    """
    lens = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    chars = np.frombuffer("".join([units[i] for i in order]).encode("utf-32-le"), np.uint32).astype(np.int64)
    base = np.cumsum(lens + 1) - (lens + 1)
    n = len(chars)
    unit_of = np.repeat(np.arange(len(lens)), lens)
    node_of = np.arange(n) + unit_of  # the node before each character
    left = base[unit_of] + lens[unit_of] - node_of  # characters from here to the unit's end
    width = min(v.LONGEST, int(lens[0]))
    share, code = edges(chars, node_of, left, n + len(lens), width, v, alpha)
    total = np.zeros(n + len(lens))
    total[base] = 1.0
    longest = int(lens[0])
    live = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right")  # units of at least that many characters
    for p in range(1, longest + 1):
        rows = base[: live[p - 1]] + p
        w = min(width, p)
        part = share[rows, :w]
        part *= total[rows[:, None] - np.arange(1, w + 1)]
        part = np.cumsum(part, axis=1)
        total[rows] = part[:, -1]
        part /= part[:, -1:]
        share[rows, :w] = part
        share[rows, w - 1 :] = 2.0
        if p % 8 == 0:
            scale = total[rows].copy()
            for back in range(min(p, width) + 1):
                total[rows - back] /= scale
    end = np.empty(len(units), np.int64)
    end[order] = base + lens
    return end, share, code


def sample_batch(texts: list[str], seeds: np.ndarray, v: Vocabulary, alpha: float = 1.0) -> list[np.ndarray]:
    """The sampled ids of every text."""
    parts = [UNITS.findall(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    index = {}
    which = np.array([index.setdefault(u, len(index)) for p in parts for u in p], np.int64)
    if not index:
        return [np.empty(0, np.int32)] * len(texts)
    size = np.array([len(u) for u in index], np.int64)
    short = [u for u in index if len(u) <= LONG_UNIT]
    end = np.zeros(len(index), np.int64)
    end[size <= LONG_UNIT], share, code = filtered(short, v, alpha) if short else (0, None, None)
    node, left = end[which], size[which]
    place = np.arange(len(node), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
    with np.errstate(over="ignore"):
        stream = splitmix(np.repeat(seeds.astype(np.uint64), counts) + place * np.uint64(0xD1342543DE82EF95))
    length = np.zeros(len(node), np.int64)
    units = list(index)
    alone = {}
    with np.errstate(over="ignore"):
        for i in np.nonzero(left > LONG_UNIT)[0].tolist():
            alone[i] = sample_long(units[which[i]], stream[i], v, alpha)
            length[i] = len(alone[i])
    who, taken = np.nonzero(left <= LONG_UNIT)[0], []
    step = 0
    while len(who):
        with np.errstate(over="ignore"):
            draw = (splitmix(stream[who] + np.uint64((step * 0x2545F4914F6CDD1D) & (2**64 - 1))) >> np.uint64(11)) * (1.0 / (1 << 53))
        here = node[who]
        edge = (share[here] <= draw[:, None]).sum(axis=1)
        taken.append((who, code[here, edge]))
        length[who] += 1
        node[who] = here - edge - 1
        left[who] -= edge + 1
        who = who[left[who] > 0]
        step += 1
    stop = np.cumsum(length)
    out = np.empty(int(stop[-1]), np.int32)
    for k, (w, c) in enumerate(taken):
        out[stop[w] - 1 - k] = c
    for i, c in alone.items():
        out[stop[i] - len(c) : stop[i]] = c
    ends = np.concatenate([[0], stop])[np.cumsum(counts)]
    result, at = [], 0
    for e in ends:
        ids = out[at:e]
        if len(ids) and ids.min() < 0:
            ids = np.array([x for c in ids.tolist() for x in ([c] if c >= 0 else [v.byte_id[b] for b in chr(-c).encode()])], np.int32)
        result.append(ids)
        at = e
    return result


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _groups(texts: list[str], most_chars: int = 250_000) -> Iterator[tuple[int, int]]:
    """Slices of bounded size; one long text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most_chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode(
    docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", alpha: float = 1.0, seed: int = 5, model_path: str = DEFAULT_MODEL, lossless_col: str | None = None
) -> DataFrame:
    """``docs`` with an ``ids`` column (replaced if it exists): one sampled segmentation a row.

    Null and empty texts have no ids; lone surrogates cannot stand in a column.
    Rows with the same key and text get the same ids; a null key is a key of its
    own. An empty table gives an empty result, a text of any length is encoded
    whole, and all other columns pass unchanged. ``lossless_col`` adds a column
    that says whether decoding the ids gave the text back; it is checked in the
    same pass, so that a task holds one Python worker.
    """
    docs = docs.drop(ids_col, *([lossless_col] if lossless_col else []))
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # as large as the model's vocabulary

    def make():
        v = shipped.value

        def run(texts, keys):
            texts = [t or "" for t in texts]
            seeds = np.array([xxhash.xxh3_64_intdigest("" if k is None else str(k), seed) for k in keys], np.uint64)
            found = []
            for a, b in _groups(texts):
                found += sample_batch(texts[a:b], seeds[a:b], v, alpha)
            same = [decode_ids(i.tolist(), v) == t for i, t in zip(found, texts)] if lossless_col else None
            return (found, same) if lossless_col else (found,)

        return run

    added = [StructField(ids_col, ArrayType(IntegerType()))] + ([StructField(lossless_col, BooleanType())] if lossless_col else [])
    return extend(docs, [text_col, key_col], added, make)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with the text its ids stand for (null ids: empty text)."""
    encoded = encoded.drop(out_col)
    shipped = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = ["" if i is None else decode_ids(i, v) for i in part.column(part.schema.names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out_col, StringType())]))


def encode_checked(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, n_pieces, ids, and whether decoding gives the text back."""
    done = encode(docs.select("doc_id", "text"), lossless_col="lossless", **how)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


def op6_sample_pieces(spark, sf_dir):
    """Per row of ``documents``: doc_id, n_pieces, ids, lossless; see ``encode``."""
    return encode_checked(table(spark, sf_dir, "documents"))
