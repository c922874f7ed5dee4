"""Markdown and inline markup: layout blocks, headings, tables, delimiters, citations, style tags."""

from __future__ import annotations

import json
import re
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Style tags of translated text and what they stand for (fixed values).
STYLE_TAGS = ("inlinefootnote", "noteref", "noteback", "strong", "em", "u", "sup", "sub")
_STYLE = re.compile(rf"<(/?)({'|'.join(STYLE_TAGS)})>")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_ATX = re.compile(r"^\s*(#{1,6})\s+(.*?)\s*$")


def fence_of(line: str) -> tuple[str, int] | None:
    """The sign and length of a line's code fence."""
    found = _FENCE.match(line)
    return (found.group(1)[0], len(found.group(1))) if found else None


def table_cells(line: str) -> list[str]:
    """The cells of a pipe table's row: pipes part them but for escaped ones and those in code ticks."""
    text = line.strip()
    if "|" not in text:
        return []
    text = text.removeprefix("|")
    cells, cell, ticked, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            cell += text[i : i + 2]
            i += 2
            continue
        if c == "`":
            ticked = not ticked
        if c == "|" and not ticked:
            cells.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    return [*cells, cell.strip()] if cell.strip() or not text.endswith("|") else cells


def _is_rule(cell: str) -> bool:
    inner = cell.strip().lstrip(":").rstrip(":")
    return len(inner) >= 3 and set(inner) == {"-"}


def layout_blocks(source: str) -> list[dict]:
    """Headings and pipe tables of a Markdown text, and the pieces between them, in order.

    Inside fences, which a fence of the same sign and at least the same length ends, nothing is a heading or a table.
    """
    lines = source.splitlines(keepends=True) if "\r" not in source else re.findall(r"[^\n]*\n|[^\n]+", source)
    out: list[dict] = []
    rest: list[str] = []

    def end_rest() -> None:
        if "".join(rest).strip():
            out.append({"kind": "markdown", "level": None, "text": "".join(rest)})
        rest.clear()

    fence, k = None, 0
    while k < len(lines):
        line = lines[k].rstrip("\r\n")
        mark = fence_of(line)
        if mark or fence:
            if mark and fence is None:
                fence = mark
            elif mark and mark[0] == fence[0] and mark[1] >= fence[1]:
                fence = None
            rest.append(lines[k])
            k += 1
            continue
        if found := _ATX.match(line + " "):
            end_rest()
            title = found.group(2)
            out.append({"kind": "heading", "level": len(found.group(1)), "text": title.rstrip("#").rstrip() if title.endswith("#") else title})
            k += 1
            continue
        head = table_cells(line)
        under = table_cells(lines[k + 1].rstrip("\r\n")) if k + 1 < len(lines) else []
        if len(head) >= 2 and len(head) == len(under) and all(map(_is_rule, under)):
            end_rest()
            rows = [head]
            k += 2
            while k < len(lines) and len(row := table_cells(lines[k].rstrip("\r\n"))) >= 2:
                rows.append(row)
                k += 1
            out.append({"kind": "table", "level": None, "text": "\n".join("\t".join(r) for r in rows)})
            continue
        rest.append(lines[k])
        k += 1
    end_rest()
    return out or [{"kind": "markdown", "level": None, "text": source}]


def trimmed_math(source: str) -> str:
    """Formulas between dollars, single or double, without blanks at their ends; escaped dollars are text."""
    out, i = [], 0
    escaped_at = lambda k: sum(1 for _ in takewhile(lambda c: c == "\\", reversed(source[:k]))) % 2 == 1

    def close(at: int, width: int) -> int:
        while (at := source.find("$", at)) >= 0:
            double = source[at + 1 : at + 2] == "$"
            if not escaped_at(at) and (double if width == 2 else not double and source[at - 1 : at] != "$"):
                return at
            at += 1
        return -1

    while i < len(source):
        at = source.find("$", i)
        if at < 0:
            break
        out.append(source[i:at])
        if escaped_at(at):
            out.append("$")
            i = at + 1
            continue
        width = 2 if source[at + 1 : at + 2] == "$" else 1
        end = close(at + width, width)
        if end < 0:
            out.append("$" * width)
            i = at + width
            continue
        inner = source[at + width : end]
        out.append("$" * width + (inner.strip() or inner) + "$" * width)
        i = end + width
    out.append(source[i:])
    return "".join(out)


def tight_strong(source: str) -> str:
    """``**`` pairs whose inner side is blank get the blanks outside; fences and code ticks stay as they are."""
    out, fence = [], None
    for line in re.findall(r"[^\n]*\n|[^\n]+", source):
        mark = fence_of(line.rstrip("\r\n"))
        if fence:
            fence = None if mark and mark[0] == fence else fence
            out.append(line)
        elif mark:
            fence = mark[0]
            out.append(line)
        else:
            parts = re.split(r"(`[^`\n]*`)", line)
            out.append("".join(p if k % 2 else re.sub(r"\*\*([ \t]*)([^*\n]*?[^*\s])([ \t]*)\*\*", r"\1**\2**\3", p) for k, p in enumerate(parts)))
    return "".join(out)


def table_markdown(rows: list[list[dict]]) -> str:
    """A pipe table of cells ``text, colspan, rowspan``; a cell stands at the left and top of what it spans."""
    grid: dict[tuple[int, int], str] = {}
    taken: set[tuple[int, int]] = set()
    for r, row in enumerate(rows):
        column = 0
        for cell in row:
            wide, tall = max(1, cell["colspan"]), max(1, cell["rowspan"])
            while any((r, c) in taken for c in range(column, column + wide)):
                column += 1
            taken.update((y, x) for y in range(r, r + tall) for x in range(column, column + wide))
            grid[r, column] = _table_text(cell["text"])
            column += wide
    width = max((x for y, x in taken if y < len(rows)), default=-1) + 1
    if not width:
        return ""
    lines = ["| " + " | ".join(grid.get((r, c), "") for c in range(width)) + " |" for r in range(len(rows))]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _table_text(text: str) -> str:
    plain = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    return re.sub(r"(\\*)\|", lambda m: m.group(1) * 2 + r"\|", plain).replace("\n", "<br>")


def styled_runs(text: str) -> list[dict] | None:
    """``text, styles`` of a text with style tags; None if it has none or they are not balanced."""
    out, stack, at, found = [], [], 0, False
    for m in _STYLE.finditer(text):
        if m.start() > at:
            out.append({"text": text[at : m.start()], "styles": list(stack)})
        at, found = m.end(), True
        if not m.group(1):
            stack.append(m.group(2))
        elif not stack or stack.pop() != m.group(2):
            return None
    if at < len(text):
        out.append({"text": text[at:], "styles": list(stack)})
    return out if found and not stack else None


def with_style_tags(text: Column, styles: Column) -> Column:
    """A run's text inside its style tags, outermost first."""
    return F.concat(
        F.array_join(F.transform(styles, lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""), text,
        F.array_join(F.transform(F.reverse(styles), lambda s: F.concat(F.lit("</"), s, F.lit(">"))), ""),
    )


def with_citations(value, marker):
    """JSON data whose valid ``href`` became ``citation`` and whose ``hrefs`` became the valid ``citations``.

    ``marker`` gives the marker of a link, or None for one that is no citation.
    """
    if isinstance(value, list):
        return [with_citations(x, marker) for x in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, x in value.items():
        if key == "href" and isinstance(x, str) and (made := marker(x)) is not None:
            out["citation"] = made
        elif key == "hrefs" and isinstance(x, list):
            out["citations"] = [m for m in (marker(y) for y in x if isinstance(y, str)) if m is not None]
        else:
            out[key] = with_citations(x, marker)
    return out


def citation_marker(link: str) -> str | None:
    """``[[section:node]]`` of a link ``book://section/<section>#<node>``."""
    found = re.fullmatch(r"book://section/(\d+)#([A-Za-z0-9_-]+)", link)
    return f"[[{found.group(1)}:{found.group(2)}]]" if found else None


def mapped(function, kind: str):
    """A column function that applies a Python function to each text of an Arrow batch; null stays null."""

    def column(text: Column) -> Column:
        # A struct travels as an array of one, which keeps a null apart from a struct of nulls.
        @F.pandas_udf(f"array<{kind}>" if kind.startswith("struct") else kind)
        def run(texts: pd.Series) -> pd.Series:
            made = texts.map(lambda t: None if t is None else function(t))
            return made.map(lambda x: None if x is None else [x]) if kind.startswith("struct") else made

        return F.get(run(text), F.lit(0)) if kind.startswith("struct") else run(text)

    return column


blocks_of = mapped(layout_blocks, "array<struct<kind:string,level:int,text:string>>")
math_trimmed = mapped(trimmed_math, "string")
strong_tightened = mapped(tight_strong, "string")
runs_of = mapped(styled_runs, "array<struct<text:string,styles:array<string>>>")
cited = mapped(lambda t: json.dumps(with_citations(json.loads(t), citation_marker), ensure_ascii=False), "string")


def heading_keys(markdown: str) -> list[str]:
    """The keys of a page's headings: letters and digits in lower case, leading digits gone where more is left."""
    out = []
    for block in layout_blocks(trimmed_math(markdown)):
        if block["kind"] == "heading":
            plain = "".join(c for c in re.sub(r"\$[^$]*\$|[*_`~]", "", block["text"]).lower() if c.isalnum())
            key = re.sub(r"^[0-9０-９]+", "", plain) or plain
            if key:
                out.append(key)
    return out


heading_keys_of = mapped(heading_keys, "array<string>")


def tables_as_markdown(cells: Column) -> Column:
    """Pipe tables of arrays of ``row, col, colspan, rowspan, text``."""

    @F.pandas_udf("string")
    def run(arrays: pd.Series) -> pd.Series:
        def one(a) -> str:
            rows: dict[int, list[dict]] = {}
            for c in sorted(a, key=lambda c: (c["row"], c["col"])):
                rows.setdefault(c["row"], []).append(c)
            return table_markdown([rows.get(r, []) for r in range(max(rows, default=-1) + 1)])

        return arrays.map(one)

    return run(cells)
