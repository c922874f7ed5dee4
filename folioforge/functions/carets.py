"""What a caret selects: the nearest word or sentence of a text, or all of it."""

from __future__ import annotations

import re

from folioforge.functions.sentences import atoms

_WORD = re.compile(r"[^\W_]+(?:['’.][^\W_]+)*")


def units(text: str, what: str) -> list[tuple[int, int]]:
    """Half-open ranges of the words, sentences without blanks at their ends, or paragraph of a text."""
    if what == "paragraph":
        return [(0, len(text))] if text else []
    if what == "word":
        return [m.span() for m in _WORD.finditer(text)]
    out = []
    for a, b in atoms(text):
        body = text[a:b]
        if body.strip():
            out.append((a + len(body) - len(body.lstrip()), b - len(body) + len(body.rstrip())))
    return out


def nearest(ranges: list[tuple[int, int]], caret: int, cluster: tuple[int, int] | None = None) -> tuple[int, int] | None:
    """The range that the caret's cluster touches, else the one with the least distance, the first of equals."""
    a, b = cluster or (caret, caret + 1)
    distance = lambda r: 0 if r[0] < b and r[1] > a else r[0] - caret if caret < r[0] else max(0, caret - r[1])
    return min(ranges, key=distance, default=None)


def selected(text: str, caret: int, what: str) -> tuple[int, int] | None:
    """The range that a caret selects, None in an empty text or one without such units."""
    return nearest(units(text, what), min(max(caret, 0), len(text)))
