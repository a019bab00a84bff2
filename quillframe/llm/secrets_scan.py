"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a run of token characters close after a word that announces
secrets. Its novelty is the marginal compressed length: the bytes that
zstandard needs for (text before + candidate + tail + text after) less those
for (text before + tail + text after), with a dictionary of the corpus' most
frequent words, counted over all documents, and of code identifiers. Other
mentions of the candidate are cut from the text around it. The fixed tail
stands in the dictionary: without it the text around would be dearer alone
than beside a candidate.
Identifiers, words and repeats cost a fraction of a byte a character; keys
cost about as many bytes as they have characters. Candidates at or above
``least`` bytes a character are reported as ``novel`` spans, beside the spans
of the fixed patterns, which always stay. ``least`` is ``threshold`` scaled by
the alphabet, and higher for candidates that are built like words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from quillframe.llm.common import extend, table
from quillframe.llm.spans import digest, joined, merged, ordered

KINDS = ("assign", "access", "hex", "novel")
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CONTEXT = re.compile(r"(?ai:secret|token|passw|passphrase|pwd|api.?key|access.?key|private.?key|credential|bearer|authorization|signature)")
HINTS = ("secret", "token", "passw", "passphrase", "pwd", "key", "credential", "bearer", "authorization", "signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LEAST = 12
REACH = 48
BEFORE, AFTER = 200, 100  # characters around a candidate
TAIL = b" implementation configuration"  # of IDENTIFIERS
RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BITS = ((re.compile(r"[0-9A-F]+|[0-9a-f]+"), 4), (re.compile(r"[A-Z2-7=]+|[a-z2-7=]+"), 5))  # any other alphabet: 6
WORD_RUN = 4
WORD, WORDS = 1.05, 1.15
IDENTIFIERS = (
    "import from return function class public private static final const let var def self this null None true false "
    "string integer boolean config settings environment variable username user password secret token api_key access_key "
    "client_id client_secret authorization bearer https://www. http://localhost example.com localhost default value name "
    "index length buffer request response header content-type application/json encoding utf-8 abstract interface "
    "implementation configuration initialize controller repository service manager factory builder handler listener "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 xxxxxxxxxxxx"
)


@dataclass
class NoveltyModel:
    """The dictionary and the least marginal bytes a character that count as novel."""

    dictionary: bytes
    threshold: float = 0.8
    _coder: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.dictionary, self.threshold

    def __setstate__(self, state):
        self.dictionary, self.threshold = state
        self._coder = None

    def cost(self, data: bytes) -> int:
        if self._coder is None:
            d = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._coder = zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(self._coder.compress(data))

    def novelty(self, before: str, candidate: str, after: str = "") -> float:
        """Marginal bytes a character of ``candidate`` between the texts around it."""
        head, rest = (t.replace(candidate, "").encode("utf-8", "replace") for t in (before, after))
        return (self.cost(head + candidate.encode() + TAIL + rest) - self.cost(head + TAIL + rest)) / len(candidate)

    def least(self, candidate: str) -> float:
        """The novelty that ``candidate`` needs: unknown words of one or several parts cost about a byte a letter too."""
        runs = RUN.findall(candidate)
        if len(candidate) >= WORD_RUN * len(runs) and sum(r.isdigit() for r in runs) <= 1 and not candidate.isdigit():
            return WORD if len(runs) == 1 else WORDS
        return self.threshold * next((bits for p, bits in BITS if p.fullmatch(candidate)), 6) / 6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns; a span is the whole match."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(out, KINDS)


def novel_spans(text: str, model: NoveltyModel, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Incompressible candidates within ``REACH`` characters of a sensitive word, outside the base spans."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found, done = [], 0
    starts, ends = merged(base)
    for hint in CONTEXT.finditer(text):
        limit = hint.end() + REACH
        at = max(hint.end(), done)
        while at < limit and (near := CANDIDATE.search(text, at, limit + LEAST - 1)):
            m = CANDIDATE.match(text, near.start())  # begins in reach, runs on as far as it does
            at = done = m.end()
            k = bisect_left(starts, m.end())
            if k and m.start() < ends[k - 1]:  # overlaps a base span
                continue
            if model.novelty(text[max(0, m.start() - BEFORE) : m.start()], m[0], text[m.end() : m.end() + AFTER]) >= model.least(m[0]):
                found.append(("novel", m.start(), m.end()))
    return found


def fit_novelty(docs: DataFrame, size: int = 16384, least_letters: int = 5) -> NoveltyModel:
    """A dictionary of the corpus' most frequent words and of code identifiers.

    Words are runs of at least ``least_letters`` ASCII letters, counted once a
    row over all rows and whole texts. The dictionary takes the most frequent
    ones (ties in code point order), ``size`` bytes of them, best last; so at
    most ``size`` rows come to the driver. Words hold no digits and a word has
    to be frequent, so that the secrets that are to be found stay out.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(rf"[A-Za-z]{{{least_letters},64}}"), F.lit(0)))).alias("w"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size // (least_letters + 1)).collect()
    return NoveltyModel(" ".join(reversed([r.w for r in top])).encode()[-size:] + b" " + IDENTIFIERS.encode())


def scan_secrets(docs: DataFrame, model: NoveltyModel) -> DataFrame:
    """One row per input row: doc_id, counts of base spans, the base digest and all spans.

    Null text counts as empty; texts without findings have counts 0 and empty
    ``spans``. Repeated rows repeat; an empty table gives an empty result; a
    text of any length is read whole; other columns are ignored, whatever their
    names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some thousand bytes

    def make():
        novelty = shipped.value

        def run(texts):
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                every = ordered(base + novel_spans(text, novelty, base), KINDS)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), len(every) - len(base), digest(base), joined(every)))
            return list(zip(*rows))

        return run

    added = [*(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType())]
    return extend(docs.select("doc_id", "text"), ["text"], added, make).drop("text")


def op8_secrets(spark, sf_dir):
    """Per row of ``documents``: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans; see ``scan_secrets``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs, fit_novelty(docs))
