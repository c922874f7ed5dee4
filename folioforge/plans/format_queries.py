"""Queries of answers, recognised pages, resources, metadata, handed-down styles and contents that resolve."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from folioforge.functions import answers as A
from folioforge.operators import tree as N
from folioforge.plans.markup_queries import _LINES, _filled, lines
from folioforge.sources import css
from folioforge.sources.tables import TOC_SQL, table, toc

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _by_kind(column, texts):
    out = F.lit(texts[-1]) if isinstance(texts[-1], str) else texts[-1]
    for k, t in reversed(list(enumerate(texts[:-1]))):
        out = F.when(F.pmod(column, F.lit(len(texts))) == k, t).otherwise(out)
    return out


@_query("s27_recognised_pages", f"WITH {_LINES} SELECT book_id, block_index, p.i AS page, p.t AS markdown FROM (SELECT book_id, block_index, unnest(CASE block_index % 3 WHEN 0 THEN [{{'i': 0, 't': '# ' || t}}, {{'i': 1, 't': ''}}] WHEN 1 THEN [{{'i': 0, 't': t || chr(10) || 'b'}}] ELSE [{{'i': 0, 't': ''}}] END) AS p FROM x)")
def s27(spark, sf_dir):
    """Pages of recognised text: layout results, plain lines, and a line without either."""
    line = _by_kind(F.col("block_index"), [_filled('{"result": {"layoutParsingResults": [{"markdown": {"text": "# |T| "}}, {"markdown": {}}]}}'), _filled('{"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["|T|", "b"]}}]}}'), _filled('{"error": "|T|"}')])
    return lines(spark, sf_dir).select("book_id", "block_index", F.posexplode(A.recognised_pages(line)).alias("page", "markdown"))


@_query("s33_json_in_text", "SELECT event_id, CASE event_id % 4 WHEN 2 THEN '[' || event_id || ']' ELSE '{\"k\": ' || event_id || '}' END AS json FROM events")
def s33(spark, sf_dir):
    """JSON taken out of answers: fenced, between braces, between brackets, or all of it."""
    n = F.col("event_id").cast("string")
    braces = F.concat(F.lit('{"k": '), n, F.lit("}"))
    answer = _by_kind(F.col("event_id"), [F.concat(F.lit("Sure {not this}:\n```json\n"), braces, F.lit("\n```\nDone")), F.concat(F.lit("It is "), braces, F.lit(" I think")), F.concat(F.lit("List: ["), n, F.lit("] ok")), F.concat(F.lit("  "), braces, F.lit("\n"))])
    return table(spark, sf_dir, "events").select("event_id", A.json_candidate(answer).alias("json"))


@_query("s35_resolved_contents", f"WITH {TOC_SQL} SELECT id, parent IS NOT NULL AS resolved FROM toc t WHERE (parent IS NOT NULL AND ord % 6 = 0) OR EXISTS (SELECT 1 FROM toc c WHERE c.parent = t.id AND c.ord % 6 = 0)")
def s35(spark, sf_dir):
    """Contents entries that lead somewhere, and those above them."""
    leads = F.regexp_extract("id", r"^n(\d+)$", 1)
    return N.surviving(N.flattened(toc(spark, sf_dir)), (leads != "") & (F.pmod(leads.try_cast("long"), F.lit(6)) == 0)).select("id", "resolved")


@_query("s40_resource_names", f"WITH {_LINES} SELECT book_id, block_index, 'See ![](OcrResources/' || left(sha256(t), 24) || '.png) and ![](other.png)' AS markdown FROM x")
def s40(spark, sf_dir):
    """References of recognised pages to resources named by their content."""
    l = lines(spark, sf_dir)  # noqa: E741
    named = l.select("book_id", "block_index", F.lit("images/a.PNG").alias("name"), A.resource_name(F.col("t").cast("binary"), F.lit("images/a.PNG")).alias("new"))
    pages = l.select("book_id", "block_index", F.lit("See ![](images/a.PNG) and ![](other.png)").alias("markdown"))
    return pages.join(named, ["book_id", "block_index"]).select("book_id", "block_index", F.replace("markdown", F.concat(F.lit("("), "name", F.lit(")")), F.concat(F.lit("("), "new", F.lit(")"))).alias("markdown"))


@_query("t07_page_authors", f"WITH {_LINES} SELECT book_id, block_index, CASE block_index % 3 WHEN 0 THEN CASE WHEN t < 'zz' THEN [t, 'zz'] WHEN t = 'zz' THEN ['zz'] ELSE ['zz', t] END WHEN 1 THEN CASE WHEN length(t) <= 117 THEN [t] ELSE [] END ELSE [] END AS authors FROM x")
def t07b(spark, sf_dir):
    """Authors of pages: metas, sorted and each once, else a short line that begins with "By"."""
    html = _by_kind(F.col("block_index"), [_filled("<meta name='author' content='zz'><META name=\"author\" content=\" |T| \"><meta name='author' content='zz'><p>By nobody</p>"), _filled("<title>x</title><p class=a> By |T|</p>"), _filled("<p>Not by |T|</p>")])
    return lines(spark, sf_dir).select("book_id", "block_index", A.html_authors(html).alias("authors"))


@_query("t29_handed_down", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'right' END, CASE WHEN p_size % 3 = 0 THEN 'center' END, 'left') AS align, CASE WHEN p_size % 5 = 0 THEN '4px' END AS margin FROM part")
def t29(spark, sf_dir):
    """Alignment handed down from the nearest element that sets it; margins are an element's own."""

    @F.pandas_udf("array<string>")
    def run(sizes: pd.Series) -> pd.Series:
        def one(n: int) -> list:
            chain = [{"text-align": "left", "margin": "9px"}, {"text-align": "center"} if n % 3 == 0 else {"margin": "8px"}, ({"text-align": "right"} if n % 2 == 0 else {}) | ({"margin": "4px"} if n % 5 == 0 else {})]
            style = css.inherited(chain)
            return [style.get("text-align"), style.get("margin")]

        return sizes.map(one)

    return table(spark, sf_dir, "part").select("p_partkey", run("p_size").alias("s")).select("p_partkey", F.get("s", F.lit(0)).alias("align"), F.get("s", F.lit(1)).alias("margin"))
