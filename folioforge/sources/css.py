"""Style sheets: rules with compound selectors, their cascade, and values in pixels."""

from __future__ import annotations

import re
from dataclasses import dataclass

_COMMENT = re.compile(r"/\*.*?\*/", re.DOTALL)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
#: A tag, an id and classes, in any number but the tag; anything else is a selector that is not known.
_SELECTOR = re.compile(r"^([A-Za-z][\w-]*)?((?:[#.][\w-]+)*)$")


@dataclass(frozen=True)
class Rule:
    """One selector with its declarations; ``order`` is its place in the sheet."""

    tag: str | None
    ids: frozenset[str]
    classes: frozenset[str]
    declarations: tuple[tuple[str, str], ...]
    order: int

    @property
    def weight(self) -> tuple[int, int]:
        """Specificity, then place."""
        return 100 * len(self.ids) + 10 * len(self.classes) + (self.tag is not None), self.order

    def matches(self, tag: str, ids: set[str], classes: set[str]) -> bool:
        return (self.tag is None or self.tag == tag) and self.ids <= ids and self.classes <= classes


def declarations(text: str) -> tuple[tuple[str, str], ...]:
    """``name: value`` pairs of a block; ``!important`` is dropped and means nothing."""
    out = []
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        value = re.sub(r"\s*!\s*important\s*$", "", value.strip(), flags=re.IGNORECASE)
        if colon and name.strip() and value:
            out.append((name.strip().lower(), value))
    return tuple(out)


def parse(sheet: str) -> list[Rule]:
    """The rules of a sheet; selectors with combinators, pseudo-classes, attributes or ``*`` are skipped, not their siblings."""
    out: list[Rule] = []
    for selectors, block in _RULE.findall(re.sub(r"@[^{;]*;", "", _COMMENT.sub("", sheet))):
        found = declarations(block)
        for selector in selectors.split(","):
            m = _SELECTOR.match(selector.strip())
            if m and selector.strip():
                marks = re.findall(r"([#.])([\w-]+)", m.group(2))
                out.append(Rule(m.group(1) and m.group(1).lower(), frozenset(x for s, x in marks if s == "#"), frozenset(x for s, x in marks if s == "."), found, len(out)))
    return out


def cascaded(rules: list[Rule], tag: str, attributes: dict[str, str | None]) -> dict[str, str]:
    """The properties of an element: rules from the least weight to the greatest, its own style last."""
    ids, classes = {attributes.get("id") or ""} - {""}, set((attributes.get("class") or "").split())
    out: dict[str, str] = {}
    for rule in sorted((r for r in rules if r.matches(tag, ids, classes)), key=lambda r: r.weight):
        out.update(rule.declarations)
    out.update(declarations(attributes.get("style") or ""))
    return out


def is_end_aligned(style: dict[str, str]) -> bool:
    """Whether text is set to the end of its line."""
    return style.get("text-align", "").lower() in ("right", "end")


#: Properties that an element has from its parent where it sets none (fixed values).
INHERITED = ("text-align", "color", "font-weight", "font-style", "line-height")


def inherited(chain: list[dict[str, str]]) -> dict[str, str]:
    """The properties of the last of nested elements, the outermost first: its own, and those that are handed down."""
    out: dict[str, str] = {}
    for own in chain:
        out = {k: v for k, v in out.items() if k in INHERITED} | own
    return {k: v for k, v in out.items() if v != "inherit"}
