"""JSON and text of services: candidates in answers, recognised pages, resource names, page metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import collapsed, entities_decoded


def json_candidate(answer: Column) -> Column:
    """What of an answer should be JSON: a code fence, else from the first brace to the last, else brackets, else all."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    blank = lambda c: F.nullif(bare(c), F.lit(""))
    fence = F.regexp_extract(answer, r"(?s)```(?:[A-Za-z]*)[ \t]*\n(.*?)```", 1)
    return F.coalesce(blank(fence), blank(F.regexp_extract(answer, r"(?s)\{.*\}", 0)), blank(F.regexp_extract(answer, r"(?s)\[.*\]", 0)), bare(answer))


def recognised_pages(line: Column) -> Column:
    """The Markdown of each page in one line of a recognition service: layout results, else plain lines joined; nothing found is an empty page."""
    layout = F.from_json(F.get_json_object(line, "$.result.layoutParsingResults"), "array<struct<markdown:struct<text:string>>>")
    plain = F.from_json(F.get_json_object(line, "$.result.ocrResults"), "array<struct<prunedResult:struct<rec_texts:array<string>>>>")
    by_layout = F.transform(layout, lambda x: F.coalesce(F.trim(x["markdown"]["text"]), F.lit("")))
    by_line = F.transform(plain, lambda x: F.coalesce(F.array_join(x["prunedResult"]["rec_texts"], "\n"), F.lit("")))
    found = F.coalesce(by_layout, by_line)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit("")))


def resource_name(content: Column, name: Column) -> Column:
    """A resource's name by its content, with the extension that it had."""
    ext = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})$", 1))
    return F.concat(F.lit("OcrResources/"), F.left(F.sha2(content, 256), F.lit(24)), ext)


def html_authors(html: Column) -> Column:
    """Authors of a page: its ``author`` metas, else a paragraph that begins with "By" and is short; sorted, each once."""
    metas = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<meta\s+name=["']author["']\s+content=["']([^"']*)["']"""), F.lit(1)), lambda a: collapsed(entities_decoded(a)))
    lines = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>\s*By\s+([^<]{1,117})</p>"), F.lit(1)), lambda a: collapsed(entities_decoded(a)))
    named = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x != "")))
    return F.when(F.size(named(metas)) > 0, named(metas)).otherwise(named(lines))
