"""Plain-text tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

ANSI = re.compile(r"\x1b\[[0-9;]*m")
BREAKS = str.maketrans("\n\r\t", "   ")


def display_width(text: str) -> int:
    """Columns that a text takes on a terminal; colour codes take none."""
    plain = ANSI.sub("", text.translate(BREAKS))
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in plain)


def _line(cells: Sequence[str], widths: Sequence[int]) -> str:
    clean = [c.translate(BREAKS) for c in cells[: len(widths)]]
    return "  ".join(c + " " * max(0, w - display_width(c)) for c, w in zip(clean, widths)).rstrip() + "\n"


def render_table(headers: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """Two blanks between columns, a rule of at least three dashes, no trailing blanks."""
    widths = [max([1, display_width(h), *(display_width(r[i]) for r in rows if i < len(r))]) for i, h in enumerate(headers)]
    rule = ["-" * max(3, w) for w in widths]
    return _line(headers, widths) + _line(rule, [max(3, w) for w in widths]) + "".join(_line(r, widths) for r in rows)
