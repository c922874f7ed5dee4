"""Pages of recognised text: paragraphs over page breaks, lines into paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import TERMINALS

#: Signs that split a word at a line's end, and signs that may close a sentence after its terminal (fixed values).
HYPHENS = "-‐‑­"
CLOSING = "”’\"')）]】"
#: What a Markdown paragraph does not begin with: headings, items, quotes, fences, rules, markup, tables.
NOT_PARAGRAPH = r"^(?:#{1,6}(?:\s|$)|[-*+]\s|\d{1,9}[.)]\s|>|```|~~~|<(?:[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$)|[/!?])|(?:[-*_][ \t]*){3,}$)|\n *(?:=+|-+) *(?:\n|$)|\|[^\n]*\n[ \t]*[|:-][-|: \t]*-[-|: \t]*(?:\n|$)"
#: What a plain one does not have inside: images, markup that is no address, display formulas.
NOT_PLAIN = r"!\[[^\]\n]*\]\(|<(?:[A-Za-z][A-Za-z0-9-]*(?:[\s/>])|/|!--)|\$\$[^$]+\$\$"
CODE_TICKS = r"`[^`\n]*`"


def page_blocks(markdown: Column) -> Column:
    """The trimmed, non-blank blocks of a page, which blank lines part."""
    parts = F.split(F.replace(markdown, F.lit("\r\n"), F.lit("\n")), "\n\n")
    return F.filter(F.transform(parts, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def is_plain(block: Column) -> Column:
    """Whether a block is a paragraph of text only."""
    return ~F.regexp_like(block, F.lit(NOT_PARAGRAPH)) & ~F.regexp_like(F.regexp_replace(block, CODE_TICKS, ""), F.lit(NOT_PLAIN))


def goes_on(tail: Column, head: Column) -> Column:
    """Whether a page's last paragraph goes on as the next page's first.

    A hyphen always does; a full stop does before a small letter; other terminals do not; all else does.
    """
    end = F.right(F.regexp_replace(tail, f"[{''.join(chr(92) + c if c in ')]' else c for c in CLOSING)}]+$", ""), F.lit(1))
    by_end = F.when(end == "", False).when(end == ".", F.regexp_like(head, F.lit(r"^\p{Ll}"))).otherwise(~end.isin(*TERMINALS))
    return is_plain(tail) & is_plain(head) & (F.right(tail, F.lit(1)).isin(*HYPHENS) | by_end)


def joined_text(tail: Column, head: Column) -> Column:
    """One paragraph of two: a hyphen goes, a space comes between ASCII letters and digits."""
    hyphen = F.right(tail, F.lit(1)).isin(*HYPHENS)
    spaced = F.regexp_like(tail, F.lit("[A-Za-z0-9]$")) & F.regexp_like(head, F.lit("^[A-Za-z0-9]"))
    return F.when(hyphen, F.concat(F.left(tail, F.length(tail) - 1), head)).otherwise(F.concat(tail, F.when(spaced, " ").otherwise(""), head))


def joined_pages(pages: DataFrame) -> DataFrame:
    """``book_id, page, markdown`` with cut paragraphs on the page where they begin; pages with a ``role``, if there is such a column, stay apart.

    Whether two pages meet depends on their own blocks alone, but for a page of one block: once that went
    to the page before, there is nothing left to go on. So in a run of such pages every second seam
    holds, counted from the last page that settles it, and two windows say which.
    """
    w = Window.partitionBy("book_id").orderBy("page")
    pages = pages if "role" in pages.columns else pages.withColumn("role", F.lit(None).cast("string"))
    b = pages.select("book_id", "page", "role", page_blocks(F.coalesce("markdown", F.lit(""))).alias("b")).withColumn("n", F.row_number().over(w))
    head = F.get(F.lead("b").over(w), F.lit(0))
    tail = F.when(F.size("b") > 0, F.get("b", F.size("b") - 1))
    fits = F.coalesce(F.col("role").isNull() & F.lead("role").over(w).isNull() & head.isNotNull() & goes_on(tail, head), F.lit(False))
    b = b.withColumn("head", head).withColumn("fits", fits).withColumn("settled", ~(F.col("fits") & (F.size("b") == 1)))
    last = lambda c: F.last(F.when(F.col("settled"), F.col(c)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    odd = (F.col("n") - F.coalesce(last("n"), F.lit(0))) % 2 == 1
    b = b.withColumn("joins", F.coalesce(last("fits"), F.lit(False)) != odd)
    b = b.withColumn("gave", F.coalesce(F.lag("joins").over(w), F.lit(False)))
    own = F.when(F.col("gave"), F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0)))).otherwise(F.col("b"))
    longer = F.concat(F.slice("own", 1, F.greatest(F.size("own") - 1, F.lit(0))), F.array(joined_text(F.get("own", F.size("own") - 1), F.col("head"))))
    return b.withColumn("own", own).select("book_id", "page", F.array_join(F.when(F.col("joins"), longer).otherwise(F.col("own")), "\n\n").alias("markdown"))


#: Runs of lines below which a loop takes less time than a step over all of them.
FEW_RUNS = 8


def line_groups(lines: DataFrame) -> DataFrame:
    """``page, line, group`` of lines ``page, line, x, y, w, h, text`` in paragraphs.

    Lines of a paragraph follow each other closely, are of like height, and overlap or begin near each
    other; none begins far inside its first line, or is much wider than a narrow start, and a numbered heading is
    alone. What a line and the one before it say is found by a window; the rest depends on where the
    paragraph began, so lines are scanned in order. The window leaves each page's lines together and sorted, so a scan
    goes over whole batches of many pages and takes its state from one to the next.
    """
    w = Window.partitionBy("page").orderBy("line")
    heading = (F.length("text") < 80) & F.regexp_like("text", F.lit(r"^\s*[0-9.]*\.[0-9.]*(?!\S)"))
    lines = lines.select(F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), F.length("text").alias("n"), F.coalesce(heading, F.lit(False)).alias("heading"))
    before = {c: F.lag(c).over(w) for c in ("x", "y", "w", "h", "n")}
    tall = F.greatest(before["h"], F.col("h"), F.lit(1.0))
    step, gap = F.col("y") - before["y"], F.col("y") - (before["y"] + before["h"])
    even = F.least(before["h"], F.col("h")) / tall >= 0.68
    stub = (F.col("n") < 20) & (F.col("w") < before["w"] * 0.35) & (before["n"] > 40)
    overlap = F.least(before["x"] + before["w"], F.col("x") + F.col("w")) - F.greatest(before["x"], F.col("x"))
    beside = (overlap / F.greatest(F.least(before["w"], F.col("w")), F.lit(1.0)) >= 0.35) | (F.abs(F.col("x") - before["x"]) <= tall * 2.5)
    near = (step > tall * 0.25) & (gap <= tall * 0.45) & even & ~stub & beside
    opens = F.row_number().over(w) == 1
    rows = lines.select("page", "line", "x", "w", tall.alias("tall"), before["w"].alias("w_before"), opens.alias("opens"), F.coalesce(near, F.lit(False)).alias("near"), "heading")
    return rows.sortWithinPartitions("page", "line").mapInArrow(_scan_lines, "page long, line long, group long")


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, group = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        x, w, tall, w_before, opens, near, heading = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "w", "tall", "w_before", "opens", "near", "heading"))
        starts, state = _line_starts(x.astype(float), w.astype(float), tall.astype(float), w_before.astype(float), opens | ~near, heading, state)
        at = np.arange(len(starts))
        count = np.cumsum(starts)
        page = np.maximum.accumulate(np.where(opens, at, -1))  # where the row's page begins, -1 in a batch before
        groups = np.where(page < 0, group + count, count - count[page])
        group = int(groups[-1])
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("line"), pa.array(groups, pa.int64())], ["page", "line", "group"])


def _line_starts(x, w, tall, w_before, breaks, heading, state):
    """Which rows begin a paragraph, and the state after the last: its first line's ``x, w, heading`` and its size.

    A row in ``breaks`` begins one whatever came before, so the runs between these rows are independent:
    the next row of all runs is taken at once, and where few runs are left, each by itself.
    """
    starts, n = breaks.copy(), len(x)
    run = np.flatnonzero(breaks)
    first_x, first_w, first_heading, size = x[run], w[run], heading[run], np.ones(len(run), np.int64)
    at = run + 1
    if not breaks[0]:  # the run goes on from the batch before
        first_x, first_w, first_heading, size, at = np.append(state[0], first_x), np.append(state[1], first_w), np.append(state[2], first_heading), np.append(state[3], size), np.append(0, at)
    end = np.append(at[1:] - 1, n)
    live = np.flatnonzero(at < end)
    while len(live) >= FEW_RUNS:
        i = at[live]
        fx, fw = first_x[live], first_w[live]
        inside = x[i] > fx + 2.5 * tall[i]
        outside = (x[i] + 4.0 * tall[i] < fx) & (w[i] > 1.25 * fw)
        wider = (size[live] > 1) & (w[i] > 1.35 * fw) & (w_before[i] < 0.8 * w[i])
        new = first_heading[live] | inside | outside | wider
        starts[i] = new
        first_x[live], first_w[live], first_heading[live] = np.where(new, x[i], fx), np.where(new, w[i], fw), np.where(new, heading[i], first_heading[live])
        size[live] = np.where(new, 1, size[live] + 1)
        at[live] += 1
        live = live[at[live] < end[live]]
    for r in live.tolist():
        a, b = int(at[r]), int(end[r])
        fx, fw, fh, k = float(first_x[r]), float(first_w[r]), bool(first_heading[r]), int(size[r])
        for i, (xi, wi, ti, bi, hi) in enumerate(zip(x[a:b].tolist(), w[a:b].tolist(), tall[a:b].tolist(), w_before[a:b].tolist(), heading[a:b].tolist(), strict=True), a):
            if fh or xi > fx + 2.5 * ti or (xi + 4.0 * ti < fx and wi > 1.25 * fw) or (k > 1 and wi > 1.35 * fw and bi < 0.8 * wi):
                starts[i], fx, fw, fh, k = True, xi, wi, hi, 0
            k += 1
        first_x[r], first_w[r], first_heading[r], size[r] = fx, fw, fh, k
    return starts, (first_x[-1], first_w[-1], first_heading[-1], size[-1])
