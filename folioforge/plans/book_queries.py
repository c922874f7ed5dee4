"""Books made from the documents, read back by the readers, with SQL over the documents themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources import books as R
from folioforge.sources import writers as W
from folioforge.sources.html import html_blocks
from folioforge.sources.tables import BLOCKS_SQL, blocks, table

QUERIES, ORACLE_SQL = {}, {}

#: Lines of a document in one section of its book.
LINES = 20


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each document with text: ``id, title, author, sections``."""
    part = F.expr(f"block_index div {LINES}")
    ps = F.sort_array(F.collect_list(F.struct("block_index", "text")))
    sections = blocks(spark, sf_dir).groupBy(F.col("book_id").alias("id"), part.alias("k")).agg(F.transform(ps, lambda x: x["text"]).alias("paragraphs"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("k", "paragraphs"))), lambda s: F.struct(F.concat(F.lit("Part "), s["k"]).alias("title"), s["paragraphs"].alias("paragraphs")))
    authors = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("By "), "source").alias("author"))
    whole = sections.groupBy("id").agg(named.alias("sections")).join(authors, "id")
    return whole.select("id", F.concat(F.lit("Book & "), "id").alias("title"), "author", "sections")


def _id():
    """The number in a file's name."""
    return F.regexp_extract("path", r"book(\d+)\.", 1).cast("long")

_SHELF_SQL = f"""{BLOCKS_SQL}, sec AS (
    SELECT book_id, block_index // {LINES} AS s, block_index % {LINES} + 1 AS seq, 'paragraph' AS kind, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM blocks
    UNION ALL SELECT DISTINCT book_id, block_index // {LINES}, 0, 'heading', 'Part ' || (block_index // {LINES}) FROM blocks),
    shelf AS (SELECT book_id AS id, 'Book & ' || book_id AS title, 'By ' || any_value(d.source) AS author, max(s) + 1 AS n FROM sec JOIN documents d ON d.doc_id = book_id GROUP BY book_id)"""


def _blocks_of(sections: DataFrame) -> DataFrame:
    own = sections.where("error IS NULL").select(F.concat_ws("/", _id().cast("string"), F.col("section_index").cast("string")).alias("key"), F.col("content").alias("html"))
    part = lambda k: F.split_part("key", F.lit("/"), F.lit(k)).cast("long")
    return html_blocks(own, "key").select(part(1).alias("id"), part(2).alias("section_index"), F.col("seq").cast("long").alias("seq"), "kind", "text")


_BLOCKS_QUERY = f"WITH {_SHELF_SQL} SELECT book_id AS id, s AS section_index, seq, kind, text FROM sec"


@_query("s02_open_files", f"WITH {_SHELF_SQL} SELECT id, title, author, 'epub' AS format, n AS sections FROM shelf")
def s02(spark, sf_dir):
    """EPUB files of all books, opened by path: description and number of sections."""
    s = R.read_sections(W.book_files(shelf(spark, sf_dir), "epub"))
    return s.groupBy(_id().alias("id"), "title", F.get("authors", F.lit(0)).alias("author"), "format").agg(F.count("*").alias("sections"))


@_query("s03_open_for_reading", f"WITH {_SHELF_SQL} SELECT id, title, author FROM shelf")
def s03(spark, sf_dir):
    """Descriptions only: what is not asked for is not kept."""
    return R.catalog_of(W.book_files(shelf(spark, sf_dir), "fb2")).select(_id().alias("id"), "title", F.get("authors", F.lit(0)).alias("author"))


@_query("s04_open_bytes", f"WITH {_SHELF_SQL} SELECT id, CASE id % 3 WHEN 0 THEN 'epub' WHEN 1 THEN 'fb2' ELSE 'mobi' END AS format, n AS sections FROM shelf")
def s04(spark, sf_dir):
    """Books of several formats in one table of bytes."""
    all_ = shelf(spark, sf_dir)
    files = None
    for k, kind in enumerate(("epub", "fb2", "mobi")):
        own = W.book_files(all_.where(F.pmod("id", F.lit(3)) == k), kind)
        files = own if files is None else files.unionByName(own)
    return R.read_sections(files).groupBy(_id().alias("id"), "format").agg(F.count("*").alias("sections"))


@_query("s06_epub_sections", f"WITH {_SHELF_SQL} SELECT DISTINCT book_id AS id, s AS section_index, 'OPS/text/s' || s || '.xhtml' AS href FROM sec")
def s06(spark, sf_dir):
    """The reading order of each EPUB."""
    return R.read_sections(W.book_files(shelf(spark, sf_dir), "epub")).select(_id().alias("id"), F.col("section_index").cast("long").alias("section_index"), "href")


@_query("s07_recovered_epub", _BLOCKS_QUERY)
def s07(spark, sf_dir):
    """EPUBs that lost their directory, read by the entries' own headers; every second one is whole."""
    cut = lambda i, data: data[: data.find(b"PK\x01\x02")] if i % 2 else data
    return _blocks_of(R.read_sections(W.book_files(shelf(spark, sf_dir), "epub", damage=cut)))


@_query("s08_damaged_entries", f"WITH {_SHELF_SQL} SELECT id, id % 3 = 1 AS damaged FROM shelf")
def s08(spark, sf_dir):
    """Archives with a changed byte in a stored entry, found by its checksum."""

    def flip(i: int, data: bytes) -> bytes:
        at = data.find(b"<h1 ") + 1
        return data[:at] + b"H" + data[at + 1 :] if i % 3 == 1 else data

    s = R.read_sections(W.book_files(shelf(spark, sf_dir), "epub", stored=True, damage=flip))
    return s.groupBy(_id().alias("id")).agg(F.bool_or(F.col("error").isNotNull()).alias("damaged"))


@_query("s09_package", f"WITH {_SHELF_SQL} SELECT id, title, [author] AS authors FROM shelf")
def s09(spark, sf_dir):
    """Title and authors of each package."""
    return R.catalog_of(W.book_files(shelf(spark, sf_dir), "epub")).select(_id().alias("id"), "title", "authors")


@_query("s11_navigation", f"WITH {_SHELF_SQL} SELECT DISTINCT book_id AS id, s AS ord, 'Part ' || s AS label, 'OPS/text/s' || s || '.xhtml#top' AS href, 0::BIGINT AS depth FROM sec")
def s11(spark, sf_dir):
    """The contents that the navigation document gives."""
    c = R.contents_of(R.read_sections(W.book_files(shelf(spark, sf_dir), "epub")))
    return c.select(_id().alias("id"), F.col("ord").cast("long").alias("ord"), "label", "href", F.col("depth").cast("long").alias("depth"))


@_query("s12_xml_hygiene", r"""SELECT doc_id, regexp_replace(replace(x, '&', '&amp;'), '&amp;(#[0-9]+;|#[xX][0-9A-Fa-f]+;|(?:amp|lt|gt|quot|apos);)', '&\1', 'g') AS xml
    FROM (SELECT doc_id, 'a & b &amp; &#38; &#x26; &bad; &lt' || coalesce(text, '') AS x FROM documents)""")
def s12(spark, sf_dir):
    """Stray ampersands escaped, document types dropped."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(R.clean_xml)

    text = F.concat(F.lit('<!DOCTYPE html [<!ENTITY x "y">]>a & b &amp; &#38; &#x26; &bad; &lt'), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", clean(text).alias("xml"))


@_query("s14_fiction_book", _BLOCKS_QUERY)
def s14(spark, sf_dir):
    """The blocks of FictionBooks, every second one in an archive."""
    all_ = shelf(spark, sf_dir)
    files = W.book_files(all_.where("id % 2 = 0"), "fb2").unionByName(W.book_files(all_.where("id % 2 = 1"), "fbz"))
    return _blocks_of(R.read_sections(files))


@_query("s15_comic_pages", f"WITH {_SHELF_SQL}, p AS (SELECT DISTINCT book_id AS id, s FROM sec) SELECT p.id, s AS section_index, (CASE WHEN s % 2 = 1 THEN 'Page' ELSE 'pAGE' END) || lpad(s::VARCHAR, 5, '0') || '.PNG' AS href, title, [author, author || ' II'] AS authors FROM p JOIN shelf USING (id)")
def s15b(spark, sf_dir):
    """Image pages of real archives in the order of their names, whatever their case."""
    s = R.read_sections(W.book_files(shelf(spark, sf_dir), "cbz"))
    return s.select(_id().alias("id"), F.col("section_index").cast("long").alias("section_index"), "href", "title", "authors")


@_query("s17_mobi_blocks", _BLOCKS_QUERY)
def s17(spark, sf_dir):
    """The blocks of Mobipocket books, split at their page breaks."""
    return _blocks_of(R.read_sections(W.book_files(shelf(spark, sf_dir), "mobi")))


@_query("s19_palmdoc", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def s19(spark, sf_dir):
    """Texts packed and unpacked as PalmDOC records."""

    @F.pandas_udf("binary")
    def unpacked(texts):
        whole = lambda data: b"".join(R.palmdoc(W.packed(data[k : k + 4096])) for k in range(0, len(data), 4096))
        return texts.map(lambda t: whole(t.encode()))

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(unpacked(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@_query("s20_exth", f"WITH {_SHELF_SQL} SELECT id, title, [author] AS authors FROM shelf")
def s20(spark, sf_dir):
    """Title and authors of the metadata block of Mobipocket books."""
    return R.catalog_of(W.book_files(shelf(spark, sf_dir), "mobi", stored=True)).select(_id().alias("id"), "title", "authors")


@_query("s25_lazy_section", f"WITH {_SHELF_SQL} SELECT book_id AS id, seq, kind, text FROM sec WHERE s = 1")
def s25(spark, sf_dir):
    """The second section of each book: sections are filtered before any is parsed."""
    s = R.read_sections(W.book_files(shelf(spark, sf_dir), "epub")).where("section_index = 1")
    return _blocks_of(s).select("id", "seq", "kind", "text")


@_query("s34_epub_blocks", _BLOCKS_QUERY)
def s34(spark, sf_dir):
    """The blocks of every section of every EPUB."""
    return _blocks_of(R.read_sections(W.book_files(shelf(spark, sf_dir), "epub")))


@_query("t03_hidden_parts", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, [text1] AS shown FROM (SELECT book_id, block_index, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text1 FROM blocks)")
def t03(spark, sf_dir):
    """What is hidden, or is a list of pages or landmarks, is left out; contents are not."""
    x = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    gone = ("<p hidden>{}</p>", '<div aria-hidden="TRUE"><p>{}</p></div>', '<p style="display : none">{}</p>', '<nav epub:type="page-list"><p>{}</p></nav>', '<nav epub:type="landmarks"><p>{}</p></nav>', "<script>x</script><style>y</style>")
    parts = [F.lit(piece) for g in gone for piece in g.split("{}")]
    page = [parts[0]]
    for i, g in enumerate(gone):
        first, *rest = g.split("{}")
        page += ([] if i == 0 else [F.lit(first)]) + [z for r in rest for z in (x, F.lit(r))]
    page += [F.lit('<nav epub:type="toc"><p>'), x, F.lit("</p></nav>")]
    b = blocks(spark, sf_dir).select(F.concat_ws("/", "book_id", "block_index").alias("key"), F.concat(*page).alias("html"))
    part = lambda k: F.split_part("key", F.lit("/"), F.lit(k)).cast("long")
    l = F.sort_array(F.collect_list(F.struct("seq", "text")))  # noqa: E741
    return html_blocks(b, "key").groupBy("key").agg(F.transform(l, lambda z: z["text"]).alias("shown")).select(part(1).alias("book_id"), part(2).alias("block_index"), "shown")


@_query("t09_definitions", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, 0::BIGINT AS seq, 'definition-term' AS kind, node AS text FROM blocks UNION ALL SELECT book_id, block_index, 1, 'definition-description', trim(regexp_replace(text, '\\s+', ' ', 'g')) FROM blocks")
def t09(spark, sf_dir):
    """Terms and descriptions of definition lists."""
    x = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    b = blocks(spark, sf_dir).select(F.concat_ws("/", "book_id", "block_index").alias("key"), F.concat(F.lit("<dl><dt> "), "node", F.lit("</dt>\n<dd>"), x, F.lit("</dd></dl>")).alias("html"))
    part = lambda k: F.split_part("key", F.lit("/"), F.lit(k)).cast("long")
    return html_blocks(b, "key").select(part(1).alias("book_id"), part(2).alias("block_index"), F.col("seq").cast("long").alias("seq"), "kind", "text")


@_query("t12_images", "SELECT page_id, url AS src, 'Page ' || page_id AS alt, 'n1' AS node FROM pages")
def t12(spark, sf_dir):
    """Images with their source and description, each a node of its own."""
    esc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<p>before</p><p><img src=\""), esc, F.lit('" alt="Page '), "page_id", F.lit('"/></p>after')).alias("html"))
    return html_blocks(p).where("kind = 'image'").select("page_id", "src", F.col("text").alias("alt"), "node")
