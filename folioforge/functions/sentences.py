"""Sentences as atoms that lose nothing: joined, they are the text again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import TERMINALS

#: Pairs inside which a text is not cut (fixed values).
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "（": "）", "【": "】", "«": "»"}
_CLOSERS = "".join(PAIRS.values()) + "\"'"
_NARROW = "".join(re.escape(c) for c in TERMINALS if ord(c) < 0x2000)
_WIDE = "".join(re.escape(c) for c in TERMINALS if ord(c) >= 0x2000)
#: After a sentence: its terminals, what closes, and white space; wide terminals need no space.
_END = re.compile(rf"(?:[{_NARROW}]+[{re.escape(_CLOSERS)}]*(?:\s+|$)|[{_WIDE}]+[{re.escape(_CLOSERS)}]*\s*|\n+)")


def paired_ranges(text: str) -> list[tuple[int, int]]:
    """The outermost ranges from an opening sign to its closing one; openers without a partner do not count."""
    stack, out = [], []
    for i, c in enumerate(text):
        if c in PAIRS:
            stack.append((i, PAIRS[c]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == c:
                    out.append((stack[k][0], i + 1))
                    del stack[k:]
                    break
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def atoms(text: str, protected: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int]]:
    """Half-open ranges of sentences; a cut inside a pair or a protected range moves to that range's end.

    An atom that is one parenthesis as a whole belongs to the atom before it.
    """
    if not text:
        return []
    ranges, cuts = sorted([*paired_ranges(text), *protected]), []
    for m in _END.finditer(text):
        at = m.end()
        for a, b in ranges:
            if a < at < b:
                at = b
                while at < len(text) and text[at].isspace():
                    at += 1
        if at < len(text) and text[at].islower() and m.group()[0] == ".":
            continue  # a full stop before a small letter ends nothing
        if at < len(text) and (not cuts or at > cuts[-1]):
            cuts.append(at)
    parts = list(zip([0, *cuts], [*cuts, len(text)], strict=True))
    out: list[tuple[int, int]] = []
    for a, b in parts:
        whole = text[a:b].strip()
        if out and whole and whole[0] in "(（[【" and paired_ranges(whole) == [(0, len(whole))]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def sentence_atoms(column: str) -> Column:
    """The atoms of each text, with their ranges in code points."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in atoms(t)] if t else [])

    return run(column)
