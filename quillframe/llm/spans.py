"""Span bookkeeping shared by the scanners of personal data and secrets."""

from __future__ import annotations

import hashlib


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Distinct spans by start, then kind in the order of ``kinds``, then end."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order and disjoint."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends
