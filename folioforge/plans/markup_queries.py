"""Markdown, style, inline and sanitising queries: inputs made of clean document lines, SQL that says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import markdown as K
from folioforge.sources import css
from folioforge.sources import inlines as I
from folioforge.sources.books import markdown_to_html
from folioforge.sources.html import html_blocks
from folioforge.sources.tables import BLOCKS_SQL, blocks, table

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def lines(spark, sf_dir):
    """``book_id, block_index, t``: letters, digits and single blanks of each line that has a letter."""
    t = F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))
    return blocks(spark, sf_dir).select("book_id", "block_index", t.alias("t")).where(F.regexp_like("t", F.lit(r"\p{L}")))


_LINES = rf"{BLOCKS_SQL}, x AS (SELECT * FROM (SELECT book_id, block_index, trim(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM blocks) WHERE regexp_matches(t, '\p{{L}}'))"


def _filled(template: str):
    """A column: the template with ``T`` between bars replaced by the line."""
    parts = template.split("|T|")
    return F.concat(*[y for k, p in enumerate(parts) for y in ([F.col("t")] if k else []) + [F.lit(p)]])


@_query("c04_heading_keys", rf"WITH {_LINES}, k AS (SELECT book_id, block_index, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]', '', 'g') AS k FROM x) SELECT book_id, block_index, [CASE WHEN regexp_replace(k, '^[0-9０-９]+', '') <> '' THEN regexp_replace(k, '^[0-9０-９]+', '') ELSE k END] AS keys FROM k")
def c04(spark, sf_dir):
    """Keys of a page's headings, not of what is in its fences."""
    return lines(spark, sf_dir).select("book_id", "block_index", K.heading_keys_of(_filled("# **|T|** ##\n|T|\n```\n# not |T|\n```\n#|T|")).alias("keys"))


@_query("c09_style_tags", f"WITH {_LINES} SELECT book_id, block_index, block_index % 3 = 0 AS broken, CASE WHEN block_index % 3 > 0 THEN 't:' || t || '|em,strong:' || t || '|em:' || ' x' END AS runs FROM x")
def c09(spark, sf_dir):
    """Runs written with style tags and read again; tags that do not nest give nothing."""
    none, both, one = F.array().cast("array<string>"), F.array(F.lit("em"), F.lit("strong")), F.array(F.lit("em"))
    good = F.concat("t", F.replace(F.concat(K.with_style_tags(F.col("t"), both), K.with_style_tags(F.lit(" x"), one)), F.lit("</em><em>"), F.lit("")))
    runs = K.runs_of(F.when(F.pmod("block_index", F.lit(3)) == 0, F.concat(F.lit("<em>"), "t", F.lit("</strong></em>"))).otherwise(good))
    named = lambda r: F.concat(F.when(F.size(r["styles"]) == 0, "t").otherwise(F.array_join(r["styles"], ",")), F.lit(":"), r["text"])
    return lines(spark, sf_dir).withColumn("r", runs).select("book_id", "block_index", F.col("r").isNull().alias("broken"), F.array_join(F.transform("r", named), "|").alias("runs"))


@_query("c11_citations", """SELECT event_id, '{"title": "' || event_type || '", "citation": "[[' || user_id || ':n' || event_id || ']]", "items": [{"href": "https://x/' || event_id || '", "citations": ["[[1:n2]]"]}]}' AS json FROM events""")
def c11(spark, sf_dir):
    """Links of JSON data as citations; a link that is none stays, in a list it goes."""
    json = F.concat(F.lit('{"title": "'), "event_type", F.lit('", "href": "book://section/'), "user_id", F.lit("#n"), "event_id", F.lit('", "items": [{"href": "https://x/'), "event_id", F.lit('", "hrefs": ["book://section/1#n2", "book://section/x#n2", 7]}]}'))
    return table(spark, sf_dir, "events").select("event_id", K.cited(json).alias("json"))


@_query("c12_layout_blocks", f"""WITH {_LINES} SELECT book_id, block_index, unnest(['heading', 'markdown', 'table', 'markdown']) AS kind, unnest([2, NULL, NULL, NULL]) AS level,
    unnest([t, t || chr(10) || '~~~' || chr(10) || '# ' || t || chr(10) || '~~~~' || chr(10), t || chr(9) || 'x \\| y' || chr(10) || '`a|b`' || chr(9) || t, t]) AS text, unnest([0, 1, 2, 3]) AS seq FROM x""")
def c12(spark, sf_dir):
    """Headings, tables and what is between them; fences are one piece, escaped and ticked pipes part nothing."""
    made = K.blocks_of(_filled("## |T| ##\n|T|\n~~~\n# |T|\n~~~~\n| |T| | x \\| y |\n|:---|---:|\n| `a|b` | |T|\n|T|"))
    return lines(spark, sf_dir).select("book_id", "block_index", F.posexplode(made).alias("seq", "b")).select("book_id", "block_index", "seq", "b.*")


@_query("c13_tight_strong", f"WITH {_LINES} SELECT book_id, block_index, 'a  **' || t || '**  b `** ' || t || ' **`' || chr(10) || '```' || chr(10) || '** ' || t || ' **' AS text FROM x")
def c13(spark, sf_dir):
    """Blanks inside strong marks go outside; code stays as it is."""
    return lines(spark, sf_dir).select("book_id", "block_index", K.strong_tightened(_filled("a ** |T| ** b `** |T| **`\n```\n** |T| **")).alias("text"))


@_query("t25_math_delimiters", f"WITH {_LINES} SELECT book_id, block_index, '$' || t || '$ and \\$5 $$' || t || '$$ $ $ open $' || t AS text FROM x")
def t25(spark, sf_dir):
    """Formulas without blanks at their ends."""
    return lines(spark, sf_dir).select("book_id", "block_index", K.math_trimmed(_filled("$ |T| $ and \\$5 $$|T|\n$$ $ $ open $|T|")).alias("text"))


@_query("k15_table_markdown", f"WITH {_LINES} SELECT book_id, block_index, '| ' || t || ' | a |' || chr(10) || '| --- | --- |' || chr(10) || '|  | ' || t || ' \\| b |' || chr(10) || '| w |  |' AS text FROM x")
def k15(spark, sf_dir):
    """Tables as pipe tables: cells stand at the left and top of what they span."""
    html = _filled("<table><tr><td rowspan=2>|T|</td><th>a</th></tr><tr><td>|T| | b</td></tr><tr><td colspan=2>w</td></tr></table>")
    pages = lines(spark, sf_dir).select(F.concat_ws("/", "book_id", "block_index").alias("key"), html.alias("html"))
    part = lambda k: F.split_part("key", F.lit("/"), F.lit(k)).cast("long")
    return html_blocks(pages, "key").select(part(1).alias("book_id"), part(2).alias("block_index"), K.tables_as_markdown(F.col("cells")).alias("text"))


@_query("q06_block_text", f"WITH {_LINES} SELECT book_id, block_index, t || ' ' || t || 'x^2' || chr(10) || 'end ' || t AS text FROM x")
def q06(spark, sf_dir):
    """A block's plain text: runs joined, formulas as their source, breaks as new lines."""
    text = K.mapped(lambda h: I.runs_text(I.inline_runs(h)), "string")
    return lines(spark, sf_dir).select("book_id", "block_index", text(_filled("  |T|\n <b>|T|</b><span class='math math-inline'> x^2 </span>  <br/> end <script>no</script> |T| ")).alias("text"))


@_query("t05_as_xhtml", f"WITH {_LINES} SELECT book_id, block_index, '<p>' || t || '&#160;<br/><IMG src=\"a\"/><hr/></p>' AS xhtml FROM x")
def t05(spark, sf_dir):
    """Empty elements closed, no-break spaces as numbers."""
    return lines(spark, sf_dir).select("book_id", "block_index", K.mapped(I.as_xhtml, "string")(_filled('<p>|T|&nbsp;<br><IMG src="a"><hr /></p>')).alias("xhtml"))


@_query("t11_figures", f"WITH {_LINES} SELECT book_id, block_index, CASE WHEN block_index % 3 < 2 THEN t END AS alt, CASE WHEN block_index % 3 < 2 THEN 'See ' || t END AS caption, CASE WHEN block_index % 3 < 2 THEN block_index % 3 = 1 END AS caption_first FROM x")
def t11(spark, sf_dir):
    """Figures with their caption before or after; one whose caption holds an image is just a container."""
    image, caption = '<img src="a.png" alt="|T|">', "<figcaption>See <i>|T|</i></figcaption>"
    kind = F.pmod("block_index", F.lit(3))
    html = F.when(kind == 0, _filled(f"<figure>{image}{caption}</figure>")).when(kind == 1, _filled(f"<figure>{caption}{image}</figure>")).otherwise(_filled(f"<figure>{image}<figcaption>x {image}</figcaption></figure>"))
    made = K.mapped(I.figure, "struct<images:array<struct<src:string,alt:string>>,caption:string,caption_first:boolean>")(html)
    return lines(spark, sf_dir).withColumn("f", made).select("book_id", "block_index", F.get("f.images", F.lit(0))["alt"].alias("alt"), "f.caption", "f.caption_first")


@_query("t13_quotes", f"WITH {_LINES} SELECT book_id, block_index, t || '|' || t || ' b' || CASE WHEN block_index % 4 = 3 THEN '|who' ELSE '' END AS body, CASE WHEN block_index % 4 < 3 THEN 'who' END AS attribution FROM x")
def t13(spark, sf_dir):
    """Quotes: the last child is the attribution if it is a cite or a footer, or is set to the end of the line."""
    last = F.get(F.array(*[F.lit(x) for x in ("<cite>who</cite>", "<footer>who</footer>", '<p class="sig">who</p>', '<p class="other">who</p>')]), F.pmod("block_index", F.lit(4)))
    html = F.concat(_filled("<blockquote><p>|T|</p><p>|T| <i>b</i></p>"), last, F.lit("</blockquote>"))
    made = K.mapped(lambda h: I.quote(h, ".sig { text-align: right !important }"), "struct<body:array<string>,attribution:string>")(html)
    return lines(spark, sf_dir).withColumn("q", made).select("book_id", "block_index", F.array_join("q.body", "|").alias("body"), "q.attribution")


@_query("t15_paragraph_items", f"WITH {_LINES} SELECT book_id, block_index, unnest([0, 1, 1, 0]) AS depth, unnest([t, t || ' two', t || ' three', t || ' four']) AS text, unnest([0, 1, 2, 3]) AS seq FROM x")
def t15(spark, sf_dir):
    """Paragraphs that are list items by their mark, with depths by their indents."""
    item = lambda at, tail: f'<p style="margin-left: {at}px"><span class="enumerator">•</span> |T|{tail}</p>'
    html = _filled("<div>" + item(10, "") + item(30, " two") + item(28, " three") + item(12, " four") + "</div>")
    made = K.mapped(I.paragraph_items, "array<struct<text:string,depth:int>>")(html)
    return lines(spark, sf_dir).select("book_id", "block_index", F.posexplode(made).alias("seq", "i")).select("book_id", "block_index", "seq", "i.depth", "i.text")


_SHEET = "p{color:red} .c0{color:green} p.c1{color:blue} /* #k0{color:never} */ #k2{color:black !important} p.d.c2 {color:gray} h1, .zz {color:white} div p{color:never} p:hover{color:never} *{color:never} .c0{margin:1px}"


@_query("t16_cascade", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'pink' WHEN p_size % 5 = 2 THEN 'black' WHEN p_size % 3 = 0 THEN 'green' WHEN p_size % 2 = 1 THEN 'white' WHEN p_size % 3 = 1 THEN 'blue' ELSE 'gray' END AS color FROM part")
def t16(spark, sf_dir):
    """Colours by the cascade: specificity, then place, the element's own style last."""
    rules = css.parse(_SHEET)

    @F.pandas_udf("string")
    def color(sizes):
        element = lambda n: ("h1" if n % 2 else "p", {"id": f"k{n % 5}", "class": f"c{n % 3} d", "style": "color: pink" if n % 7 == 0 else None})
        return sizes.map(lambda n: css.cascaded(rules, *element(n))["color"])

    return table(spark, sf_dir, "part").select("p_partkey", color("p_size").alias("color"))


@_query("t21_inline_roles", f"""WITH {_LINES} SELECT book_id, block_index, unnest([0, 1, 2, 3, 4, 5]) AS seq, unnest(['text', 'text', 'text', 'math', 'text', 'text']) AS kind,
    unnest([t || ' ', t, t, 'x^2', '1', t]) AS text, unnest(['', 'bold', 'bold,italic', '', 'superscript', 'footnote']) AS styles, unnest([NULL, NULL, NULL, NULL, '#n1', NULL]) AS href FROM x""")
def t21(spark, sf_dir):
    """Runs of a paragraph with their style, link, formula and footnote role."""
    html = _filled("|T| <b>|T|<em>|T|</em></b><span class=\"math math-display\">x^2</span><a href='#n1'><sup>1</sup></a><span class=footnote1>|T|</span>")
    made = K.mapped(I.inline_runs, I.RUNS)(html)
    r = lines(spark, sf_dir).select("book_id", "block_index", F.posexplode(made).alias("seq", "r"))
    return r.select("book_id", "block_index", "seq", "r.kind", "r.text", F.array_join("r.styles", ",").alias("styles"), "r.href")


@_query("t23_markdown_pages", f"""WITH {_LINES} SELECT book_id, block_index, '<h2>' || t || '</h2>' || chr(10) || '<p>' || t || ' more</p>' || chr(10) || '<ul><li>' || t || '</li></ul>' || chr(10) || '<pre># ' || t || '</pre>' || chr(10) || '<blockquote>' || t || '</blockquote>' AS html FROM x""")
def t23(spark, sf_dir):
    """Markdown of a page as markup."""
    return lines(spark, sf_dir).select("book_id", "block_index", K.mapped(markdown_to_html, "string")(_filled("## |T| ##\n|T|\nmore\n- |T|\n```\n# |T|\n```\n> |T|")).alias("html"))


@_query("t24_sanitised", f"""WITH {_LINES} SELECT book_id, block_index, '<table><tr><td colspan="2" style="text-align:center">' || t || ' &amp; <span class="math math-inline">x</span></td><td> ' || t || ' </td></tr></table><br /><img src="../OcrResources/a.png" alt="' || t || '" width="10" />' AS html FROM x""")
def t24(spark, sf_dir):
    """Recognised markup by its allow list: other tags are blanks, unsafe attributes and images go."""
    html = _filled('<table onclick="x"><tr><td colspan="2" rowspan="99" align="CENTER">|T| &amp; $ x $</td><td style="color:red"><b>|T|</b></td></tr></table><br><img src="./OcrResources/a.png" alt="|T|" width="10" height="x"><img src="http://x/a.png">')
    return lines(spark, sf_dir).select("book_id", "block_index", K.mapped(I.sanitised, "string")(html).alias("html"))


@_query("t27_anonymous_paragraphs", f"WITH {_LINES} SELECT book_id, block_index, unnest([0, 1, 2, 3]) AS seq, unnest(['paragraph', 'paragraph', 'heading', 'paragraph']) AS kind, unnest([t || ' b', t, t || ' h', 'tail ' || t]) AS text FROM x")
def t27(spark, sf_dir):
    """Inline children between blocks are paragraphs of their own."""
    html = _filled("<div> |T| <b>b</b><p>|T|</p><section><h3>|T| h</h3>tail <i>|T|</i></section></div>")
    pages = lines(spark, sf_dir).select(F.concat_ws("/", "book_id", "block_index").alias("key"), html.alias("html"))
    part = lambda k: F.split_part("key", F.lit("/"), F.lit(k)).cast("long")
    return html_blocks(pages, "key").select(part(1).alias("book_id"), part(2).alias("block_index"), "seq", "kind", "text")
