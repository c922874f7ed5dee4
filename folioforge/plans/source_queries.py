"""Source, parse and sink queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.sources.books import format_of
from folioforge.sources.html import footnote_pairs, html_blocks
from folioforge.sources.tables import BLOCKS_SQL, blocks, table

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_DECODE = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@_query("s01_format_dispatch", "SELECT p_partkey, ['epub', 'fbz', 'fbz', 'mobi', NULL][p_size % 5 + 1] AS format FROM part")
def s01(spark, sf_dir):
    """The format of a book by its file name."""
    ends = F.array(*[F.lit(x) for x in (".EPUB", ".fb2.zip", ".fbz", ".azw", ".docx")])
    p = table(spark, sf_dir, "part").withColumn("path", F.concat("p_name", F.get(ends, F.pmod("p_size", F.lit(5)))))
    return p.select("p_partkey", format_of(F.col("path")).alias("format"))


@_query("s05_inspect", f"WITH {BLOCKS_SQL} SELECT book_id, count(*) AS blocks, count(*) FILTER (WHERE kind = 'heading') AS headings, sum(char_length)::BIGINT AS chars FROM blocks GROUP BY book_id")
def s05(spark, sf_dir):
    """How much each section holds."""
    return blocks(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").alias("headings"), F.sum("char_length").alias("chars"))


@_query("s10_reading_order", "SELECT l_orderkey, l_linenumber, p_name, CASE WHEN l_returnflag = p_brand THEN p_brand ELSE l_returnflag || ',' || p_brand END AS properties FROM lineitem JOIN part ON l_partkey = p_partkey")
def s10(spark, sf_dir):
    """Spine items with what the manifest says of them."""
    spine, manifest = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = spine.join(manifest, spine["l_partkey"] == manifest["p_partkey"])
    return j.select("l_orderkey", "l_linenumber", "p_name", F.array_join(F.array_union(F.array("l_returnflag"), F.array("p_brand")), ",").alias("properties"))


@_query("s15_image_pages", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY lower(o_orderpriority), o_orderkey) - 1 AS page FROM orders WHERE o_orderstatus <> 'P'")
def s15(spark, sf_dir):
    """Pages of an archive by name, whatever its case."""
    w = Window.partitionBy("o_custkey").orderBy(F.lower("o_orderpriority"), "o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("page"))


_GLYPHS = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus"


@_query("s22_text_layer", f"WITH g AS (SELECT l_orderkey, l_linestatus, row_number() OVER w AS n, lag(l_quantity) OVER w AS lq, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_GLYPHS})) SELECT l_orderkey, string_agg((CASE WHEN lq IS NULL THEN '' WHEN abs(l_quantity - lq) > 20 THEN chr(10) WHEN abs(l_quantity - lq) > 5 THEN ' ' ELSE '' END) || l_linestatus, '' ORDER BY n) AS text FROM g GROUP BY l_orderkey")
def s22(spark, sf_dir):
    """Glyphs as text: a new line or a space where the gap to the glyph before is wide."""
    w = Window.partitionBy("l_orderkey").orderBy(*_GLYPHS.split(", "))
    gap = F.abs(F.col("l_quantity") - F.lag("l_quantity").over(w))
    sep = F.when(gap.isNull(), "").when(gap > 20, "\n").when(gap > 5, " ").otherwise("")
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("n"), F.concat(sep, "l_linestatus").alias("t"))
    out = g.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("l"))
    return out.select("l_orderkey", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))


@_query("s24_fallback_toc", f"WITH {BLOCKS_SQL}, h AS (SELECT DISTINCT book_id FROM blocks WHERE kind = 'heading') SELECT book_id, block_index, 'Section ' || (block_index + 1) AS label FROM blocks WHERE book_id NOT IN (SELECT book_id FROM h)")
def s24(spark, sf_dir):
    """Contents made of sections, for books that have none."""
    b = blocks(spark, sf_dir)
    return b.join(b.where("kind = 'heading'").select("book_id").distinct(), "book_id", "left_anti").select("book_id", "block_index", F.concat(F.lit("Section "), F.col("block_index") + 1).alias("label"))


@_query("s26_resource_lookup", "SELECT page_id, length(html) AS bytes FROM pages WHERE page_id = 7")
def s26(spark, sf_dir, page_id: int = 7):
    """One resource by its key."""
    return table(spark, sf_dir, "pages").where(F.col("page_id") == page_id).select("page_id", F.length("html").cast("long").alias("bytes"))


@_query("s28_pages_from_items", "WITH i AS (SELECT user_id AS book, event_id % 15 AS page, event_id, CASE event_type WHEN 'view' THEN '# ' || event_id WHEN 'click' THEN '- ' || event_id ELSE event_id::VARCHAR END AS md FROM events WHERE event_type <> 'error'), a AS (SELECT book, page, string_agg(md, chr(10) || chr(10) ORDER BY event_id) AS markdown FROM i GROUP BY ALL) SELECT b.book, g.page, coalesce(a.markdown, '') AS markdown FROM (SELECT DISTINCT book FROM i) b CROSS JOIN range(0, 15) g(page) LEFT JOIN a ON a.book = b.book AND a.page = g.page")
def s28(spark, sf_dir):
    """Markdown of each page from typed items, empty pages too."""
    md = F.when(F.col("event_type") == "view", F.concat(F.lit("# "), "event_id")).when(F.col("event_type") == "click", F.concat(F.lit("- "), "event_id")).otherwise(F.col("event_id").cast("string"))
    i = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("book"), F.pmod("event_id", F.lit(15)).alias("page"), "event_id", md.alias("md"))
    a = i.groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("event_id", "md"))).alias("l")).select("book", "page", F.array_join(F.transform("l", lambda x: x["md"]), "\n\n").alias("markdown"))
    dense = i.select("book").distinct().select("book", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("page"))
    return dense.join(a, ["book", "page"], "left").select("book", "page", F.coalesce("markdown", F.lit("")).alias("markdown"))


@_query("s37_navigation_documents", "SELECT page_id, regexp_matches(lower(html), '(?s)<body[^>]*>\\s*<nav.*</nav>\\s*</body>') AND contains(lower(html), 'toc') AS navigation FROM pages")
def s37(spark, sf_dir):
    """Whether a document is nothing but navigation."""
    h = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", (F.regexp_like(h, F.lit(r"(?s)<body[^>]*>\s*<nav.*</nav>\s*</body>")) & F.contains(h, F.lit("toc"))).alias("navigation"))


@_query("t01_html_blocks")
def t01(spark, sf_dir):
    """The blocks of all pages; the parser has no SQL."""
    return html_blocks(table(spark, sf_dir, "pages")).select("page_id", "seq", "node", "kind", "level", "depth", "ordered", "ordinal", "text", "src")


@_query("t02_headings", "SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n FROM pages")
def t02(spark, sf_dir):
    """How many headings each page has."""
    p = table(spark, sf_dir, "pages")
    found = html_blocks(p).where("kind = 'heading'").groupBy("page_id").agg(F.count("*").alias("n"))
    return p.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))


@_query("t07_page_metadata", f"SELECT page_id, trim(regexp_replace({_DECODE.format(_TITLE)}, '\\s+', ' ', 'g')) AS title FROM pages")
def t07(spark, sf_dir):
    """The title of each page."""
    t = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.collapsed(X.entities_decoded(F.replace(t, F.lit("&#x27;"), F.lit("'")))).alias("title"))


@_query("t08_list_items", "SELECT page_id, count(*) FILTER (WHERE trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> '') AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS x FROM pages) GROUP BY page_id")
def t08(spark, sf_dir):
    """How many list items each page has."""
    return html_blocks(table(spark, sf_dir, "pages")).where("kind = 'list-item'").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("t10_table_cells", f"WITH {BLOCKS_SQL}, c AS (SELECT book_id, block_index, string_split(text, ' | ') AS l FROM blocks WHERE kind = 'table') SELECT book_id, block_index, i - 1 AS col, trim(regexp_replace(l[i], '\\s+', ' ', 'g')) AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)")
def t10(spark, sf_dir):
    """The cells of tables made of blocks."""
    b = blocks(spark, sf_dir).where("kind = 'table'").withColumn("id", F.concat_ws("/", "book_id", "block_index"))
    page = F.concat(F.lit("<table><tr><td>"), F.replace(X.xml_escaped(F.col("text")), F.lit(" | "), F.lit("</td><td>")), F.lit("</td></tr></table>"))
    cells = html_blocks(b.select("id", page.alias("html")), "id").select("id", F.explode("cells").alias("c"))
    part = lambda k: F.split_part("id", F.lit("/"), F.lit(k)).cast("long")
    return cells.select(part(1).alias("book_id"), part(2).alias("block_index"), F.col("c.col").cast("long").alias("col"), F.col("c.text").alias("text"))


@_query("t18_footnotes")
def t18(spark, sf_dir):
    """References and notes that link to each other, in a page made of each block; the parser has no SQL."""
    b = blocks(spark, sf_dir).withColumn("id", F.concat_ws("/", "book_id", "block_index"))
    page = F.concat(F.lit("<p id=a>see <a href='#b'>1</a></p><p id=b><a href='#a'>1</a> "), X.xml_escaped(F.col("text")), F.lit("</p>"))
    part = lambda k: F.split_part("id", F.lit("/"), F.lit(k)).cast("long")
    pairs = footnote_pairs(html_blocks(b.select("id", page.alias("html")), "id"), "id")
    return pairs.select(part(1).alias("book_id"), part(2).alias("block_index"), "seq", "to_seq", "marker")


@_query("t20_source_ranges", f"WITH {BLOCKS_SQL} SELECT book_id, node, 0::BIGINT AS start, char_length AS past FROM blocks")
def t20(spark, sf_dir):
    """Nodes and their half-open ranges in code points."""
    return blocks(spark, sf_dir).select("book_id", "node", F.lit(0).cast("long").alias("start"), F.col("char_length").alias("past"))


@_query("t31_text_for_models", f"WITH {BLOCKS_SQL} SELECT book_id, string_agg(CASE kind WHEN 'table' THEN replace(text, ' | ', chr(9)) ELSE text END, chr(10) ORDER BY block_index) AS text FROM blocks GROUP BY book_id")
def t31(spark, sf_dir):
    """Blocks as plain text, cells parted by tabs."""
    t = F.when(F.col("kind") == "table", F.replace("text", F.lit(" | "), F.lit("\t"))).otherwise(F.col("text"))
    l = F.sort_array(F.collect_list(F.struct("block_index", t.alias("t"))))  # noqa: E741
    return blocks(spark, sf_dir).groupBy("book_id").agg(F.array_join(F.transform(l, lambda x: x["t"]), "\n").alias("text"))


@_query("t33_segments", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, unnest(range(len(s))) AS segment_index, unnest(s) AS text FROM (SELECT book_id, block_index, CASE kind WHEN 'table' THEN string_split(text, ' | ') ELSE [text] END AS s FROM blocks)")
def t33(spark, sf_dir):
    """What is translated apart: cells of tables, else whole blocks."""
    s = F.when(F.col("kind") == "table", F.split("text", r" \| ")).otherwise(F.array("text"))
    return blocks(spark, sf_dir).select("book_id", "block_index", F.posexplode(s).alias("segment_index", "text")).withColumn("segment_index", F.col("segment_index").cast("long"))
