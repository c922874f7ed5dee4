"""Overlay, tool, anchor, caret and layout queries with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from folioforge.functions import binary as B
from folioforge.functions import carets as C
from folioforge.functions import sentences as S
from folioforge.operators import anchors as A
from folioforge.operators import overlays as V
from folioforge.operators import tools as T
from folioforge.operators import windows as W
from folioforge.plans.markup_queries import _LINES, lines
from folioforge.sources.tables import BLOCKS_SQL, blocks, table

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_REWRITES = "rw AS (SELECT user_id AS book_id, 'n' || (event_id % 9) AS node, event_id AS ord, CASE WHEN event_type = 'error' THEN ' ' ELSE props END AS replacement, event_id // 100 AS transaction FROM events)"


def _rewrites(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("book_id"), F.concat(F.lit("n"), F.pmod("event_id", F.lit(9))).alias("node"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("props")).alias("replacement"), F.expr("event_id div 100").alias("transaction"))


class TableSource:
    """The source whose books are the documents of a folder of tables."""

    def __init__(self, spark, sf_dir: str) -> None:
        self._spark, self._sf_dir = spark, sf_dir

    def blocks(self):
        return blocks(self._spark, self._sf_dir)

    def contents(self):
        return self.blocks().where("kind = 'heading'").select("book_id", F.col("block_index").alias("ord"), F.col("text").alias("label"), F.lit(0).cast("long").alias("depth"), "block_index")

    def resources(self):
        return table(self._spark, self._sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))


@_query("e01_source", f"WITH {BLOCKS_SQL} SELECT 'blocks' AS part, count(*) AS n FROM blocks UNION ALL SELECT 'contents', count(*) FROM blocks WHERE kind = 'heading' UNION ALL SELECT 'resources', count(*) FROM pages")
def e01(spark, sf_dir):
    """What a source of books offers, through its one interface."""
    source: V.BlockSource = TableSource(spark, sf_dir)
    out = None
    for name, df in (("blocks", source.blocks()), ("contents", source.contents()), ("resources", source.resources())):
        own = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = own if out is None else out.union(own)
    return out


@_query("e02_rewrite_view", f"WITH {BLOCKS_SQL}, {_REWRITES}, l AS (SELECT book_id, node, max_by(replacement, ord) AS new FROM rw WHERE trim(replacement) <> '' GROUP BY ALL) SELECT book_id, block_index, node, kind, coalesce(new, text) AS text FROM blocks LEFT JOIN l USING (book_id, node)")
def e02(spark, sf_dir):
    """Blocks with their last rewrite."""
    return V.rewritten(blocks(spark, sf_dir), _rewrites(spark, sf_dir))


@_query("e03_translation_view", f"WITH {BLOCKS_SQL}, {_REWRITES}, l AS (SELECT book_id, node, max_by(replacement, ord) AS new FROM rw WHERE trim(replacement) <> '' GROUP BY ALL) SELECT book_id, block_index, node, kind, coalesce(new, text) || chr(10) || upper(node) AS text FROM blocks LEFT JOIN l USING (book_id, node) WHERE block_index % 2 = 0 UNION ALL SELECT book_id, block_index, node, kind, coalesce(new, text) FROM blocks LEFT JOIN l USING (book_id, node) WHERE block_index % 2 = 1")
def e03(spark, sf_dir):
    """Rewritten blocks with their translation below, where there is one: two views, one on the other."""
    b = blocks(spark, sf_dir)
    translations = b.select("book_id", "node", F.when(F.pmod("block_index", F.lit(2)) == 0, F.concat(F.lit(" "), F.upper("node"))).otherwise(" ").alias("translation"))
    return V.translated(V.rewritten(b, _rewrites(spark, sf_dir)), translations, bilingual=True)


@_query("e04_sentence_view", f"WITH {_LINES} SELECT book_id, block_index, unnest(['n0@0', 'n0@' || (length(t) + 3), 'n0@' || (length(t) + 15), 'n1']) AS node, unnest(['paragraph', 'paragraph', 'paragraph', 'heading']) AS kind, unnest([t || '1. ', 'Next (a. B) ', 'X' || t || '!', t]) AS text FROM x")
def e04(spark, sf_dir):
    """Paragraphs as sentences with nodes of their own, an end inside brackets at their end; headings stay."""
    l = lines(spark, sf_dir)  # noqa: E741
    b = l.select("book_id", "block_index", F.lit("n0").alias("node"), F.lit("paragraph").alias("kind"), F.concat("t", F.lit("1. Next (a. B) X"), "t", F.lit("!")).alias("text"))
    return V.by_sentence(b.unionByName(l.select("book_id", "block_index", F.lit("n1").alias("node"), F.lit("heading").alias("kind"), F.col("t").alias("text"))))


@_query("e05_contents_view", f"WITH {BLOCKS_SQL} SELECT book_id, block_index AS ord, text AS label, 0::BIGINT AS depth FROM blocks WHERE kind = 'heading' AND book_id NOT IN (SELECT user_id FROM events) UNION ALL SELECT user_id, event_id, event_type, event_id % 2 FROM events")
def e05(spark, sf_dir):
    """Generated contents in place of a book's own."""
    own = TableSource(spark, sf_dir).contents().drop("block_index")
    generated = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"), F.pmod("event_id", F.lit(2)).alias("depth"))
    return V.with_contents(own, generated)


@_query("e06_view_switch", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, node, kind, CASE WHEN book_id IN (SELECT user_id FROM events WHERE event_type = 'click') THEN reverse(text) ELSE text END AS text FROM blocks")
def e06(spark, sf_dir):
    """The reflowed blocks of the books that show them, the original ones of all others."""
    b = blocks(spark, sf_dir)
    modes = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.when(F.col("event_type") == "click", "reflow").otherwise("original").alias("mode"))
    return V.shown(b, b.withColumn("text", F.reverse("text")), modes)


@_query("e09_rollback", f"WITH {_REWRITES} SELECT book_id, node, max_by(replacement, ord) AS replacement FROM rw WHERE transaction < 4 GROUP BY ALL")
def e09(spark, sf_dir):
    """The rewrites that are left once a transaction and all after it are undone."""
    return V.undone(_rewrites(spark, sf_dir), 4).groupBy("book_id", "node").agg(F.max_by("replacement", "ord").alias("replacement"))


@_query("e08_tools", f"""WITH {BLOCKS_SQL} SELECT 'read_units' AS tool, book_id, block_index, text FROM blocks WHERE block_index BETWEEN 2 AND 21
    UNION ALL SELECT 'contents', book_id, block_index, text FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY block_index) AS n FROM blocks WHERE kind = 'heading') WHERE n <= 1
    UNION ALL SELECT 'context', book_id, block_index, text FROM blocks WHERE block_index BETWEEN 4 AND 7""")
def e08(spark, sf_dir):
    """Tools called with arguments that are too large, too small, missing or of another type."""
    b, calls = blocks(spark, sf_dir), [("read_units", {"start": 2, "count": 500}), ("contents", {"limit": 0}), ("context", {"at": 5, "before": "x", "after": 2})]
    out = None
    for name, arguments in calls:
        own = T.called(b, name, arguments).select(F.lit(name).alias("tool"), "book_id", "block_index", "text")
        out = own if out is None else out.unionByName(own)
    return out


@_query("j08_unique_anchors", """WITH RECURSIVE e AS (SELECT user_id AS book_id, event_id AS ord, 'part' || (event_id % 17) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'view'),
    h AS (SELECT user_id AS book_id, event_id % 40 AS page, 'part' || (event_id % 23) AS key FROM events WHERE event_type = 'click' GROUP BY ALL),
    f AS (SELECT book_id, 0::BIGINT AS rn, -1::BIGINT AS ord, NULL::BIGINT AS page, []::BIGINT[] AS used FROM (SELECT DISTINCT book_id FROM e)
    UNION ALL
    SELECT book_id, rn, ord, CASE WHEN len(pages) = 1 THEN pages[1] END, CASE WHEN len(pages) = 1 THEN list_append(used, pages[1]) ELSE used END
    FROM (SELECT e.book_id, e.rn, e.ord, f.used, list(h.page) FILTER (WHERE h.page IS NOT NULL AND NOT list_contains(f.used, h.page) AND (h.key = e.key OR (least(length(h.key), length(e.key)) >= 4 AND (contains(h.key, e.key) OR contains(e.key, h.key))))) AS pages
          FROM f JOIN e ON e.book_id = f.book_id AND e.rn = f.rn + 1 LEFT JOIN h ON h.book_id = e.book_id GROUP BY e.book_id, e.rn, e.ord, f.used))
    SELECT book_id, ord, page FROM f WHERE rn > 0""")
def j08(spark, sf_dir):
    """Entries that match the heading of just one page that none before them took."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "book_id")
    key = lambda n: F.concat(F.lit("part"), F.pmod("event_id", F.lit(n)))
    headings = e.where("event_type = 'click'").select("book_id", F.pmod("event_id", F.lit(40)).alias("page"), key(23).alias("key")).distinct()
    return A.unique_anchors(e.where("event_type = 'view'").select("book_id", F.col("event_id").alias("ord"), key(17).alias("key")), headings)


@_query("g09_corrected_pages", """WITH e AS (SELECT user_id AS book_id, event_id AS ord, event_id // 30 + 1 AS page, CASE WHEN event_id % 3 = 0 THEN event_id // 30 + 1 + (user_id + event_id // 9) % 3 END AS found, 320 AS pages FROM events),
    s AS (SELECT book_id, found - page AS d, count(*) AS n FROM e WHERE found IS NOT NULL GROUP BY ALL), b AS (SELECT book_id, arg_max(d, (n, -abs(d), -d)) AS d, max(n) AS n, sum(n) AS total FROM s GROUP BY book_id),
    w AS (SELECT e.book_id, ord, pages, coalesce(found, CASE WHEN b.n >= 2 AND 2 * b.n >= b.total AND page + b.d BETWEEN 1 AND pages THEN page + b.d END, page) AS wanted FROM e LEFT JOIN b USING (book_id))
    SELECT book_id, ord, greatest(1, max(least(wanted, pages)) OVER (PARTITION BY book_id ORDER BY ord)) AS page FROM w""")
def g09(spark, sf_dir):
    """Pages of contents entries corrected by what was found, else by the common shift, never falling."""
    e = table(spark, sf_dir, "events")
    page = F.expr("event_id div 30 + 1")
    found = F.when(F.pmod("event_id", F.lit(3)) == 0, page + F.pmod(F.col("user_id") + F.expr("event_id div 9"), F.lit(3)))
    return A.corrected_pages(e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), page.alias("page"), found.alias("found"), F.lit(320).cast("long").alias("pages")))


@_query("w10_caret_words", rf"""WITH {_LINES}, c AS (SELECT *, block_index * 7 % (length(t) + 1) AS caret FROM x), p AS (SELECT *, left(t, caret) AS before FROM c)
    SELECT book_id, block_index, caret, CASE WHEN substr(t, caret + 1, 1) = ' ' THEN caret - length(regexp_extract(before, '[^ ]*$')) WHEN caret = length(t) THEN length(t) - length(regexp_extract(t, '[^ ]*$')) ELSE caret - length(regexp_extract(before, '[^ ]*$')) END AS start,
    CASE WHEN substr(t, caret + 1, 1) = ' ' OR caret = length(t) THEN caret ELSE caret + length(regexp_extract(substr(t, caret + 1), '^[^ ]*')) END AS past FROM p""")
def w10(spark, sf_dir):
    """The word at or nearest to a caret."""

    @F.pandas_udf("struct<start:long,past:long>")
    def word(texts: pd.Series, carets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([C.selected(t, c, "word") or (None, None) for t, c in zip(texts, carets, strict=True)], columns=["start", "past"])

    at = lines(spark, sf_dir).withColumn("caret", F.pmod(F.col("block_index") * 7, F.length("t") + 1))
    return at.select("book_id", "block_index", "caret", word("t", "caret").alias("w")).select("book_id", "block_index", "caret", "w.*")


@_query("w23_pagination", f"""WITH RECURSIVE {BLOCKS_SQL}, b AS (SELECT book_id, block_index, char_length // 40 + 1 AS x, row_number() OVER (PARTITION BY book_id ORDER BY block_index) AS rn FROM blocks),
    f AS (SELECT book_id, block_index, rn, 0 AS g, x AS total FROM b WHERE rn = 1
    UNION ALL SELECT b.book_id, b.block_index, b.rn, f.g + (f.total + b.x > 12)::INT, CASE WHEN f.total + b.x > 12 THEN b.x ELSE f.total + b.x END FROM f JOIN b ON b.book_id = f.book_id AND b.rn = f.rn + 1)
    SELECT book_id, block_index, (g // 2)::BIGINT AS page, (g % 2)::BIGINT AS "column" FROM f""")
def w23(spark, sf_dir):
    """Measured blocks in columns of 12 lines, two a page; a block is not cut."""
    measured = blocks(spark, sf_dir).select("book_id", "block_index", F.expr("char_length div 40 + 1").alias("height"))
    placed = W.grouped(measured, "book_id", "block_index", "height", 12)
    return placed.select("book_id", "block_index", F.expr("group div 2").alias("page"), F.pmod("group", F.lit(2)).alias("column"))


@_query("w25_protected_atoms", f"WITH {_LINES} SELECT book_id, block_index, unnest([0, 1]) AS atom, unnest([t || 'x. One $a. B$ two. ', 'Three.']) AS text FROM x")
def w25(spark, sf_dir):
    """Sentences that do not end inside a protected range, here from a word to a formula and what follows."""

    def cut(text: str) -> list[str]:
        first = text.index("x. One")
        return [text[a:b] for a, b in S.atoms(text, ((first, text.index("two.") + 4),))]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    made = run(F.concat("t", F.lit("x. One $a. B$ two. Three.")))
    return lines(spark, sf_dir).select("book_id", "block_index", F.posexplode(made).alias("atom", "text"))


@_query("c20_binary_numbers", "SELECT event_id, event_id * 12345 AS number, (event_id * 12345) % 4294967296 AS bits, ['ar', 'bg', 'ca', 'zh', 'cs', 'da', 'de', 'el', 'en', 'es'][event_id % 10 + 1] AS locale FROM events")
def c20(spark, sf_dir):
    """Numbers of variable length and bit fields written and read, languages by their code."""

    @F.pandas_udf("struct<number:long,bits:long,locale:string>")
    def run(ids: pd.Series) -> pd.DataFrame:
        def one(k: int) -> tuple:
            value = k * 12345
            shift = k % 8
            bits = (value % (1 << 32) << (8 - shift)).to_bytes(5, "big")
            return B.read_varint(b"\x01" + B.varint(value), 1)[0], B.bits32(b"\0" * (k % 3) + bits, 8 * (k % 3) + shift), B.locale_of(k % 10 + 1 | 3 << 10)

        return pd.DataFrame([one(k) for k in ids.tolist()], columns=["number", "bits", "locale"])

    return table(spark, sf_dir, "events").select("event_id", run("event_id").alias("x")).select("event_id", "x.*")


@_query("c25_epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS millis, true AS now_is_later FROM events")
def c25(spark, sf_dir):
    """Times as milliseconds, and that now is later."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), (F.unix_millis(F.current_timestamp()) > F.unix_millis(F.col("ts").cast("timestamp"))).alias("now_is_later"))


@_query("s23_pdf_text", "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN '• „x” €' ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def s23(spark, sf_dir):
    """PDF text strings: UTF-16 with a language escape, UTF-8, and the document encoding."""

    @F.pandas_udf("string")
    def read(data: pd.Series) -> pd.Series:
        return data.map(lambda d: B.pdf_text(bytes(d)))

    kind, mark = F.pmod("doc_id", F.lit(3)), F.unhex(F.lit("FEFF001B0065006E001B"))
    raw = F.when(kind == 0, F.concat(mark, F.encode("text", "UTF-16BE"))).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.unhex(F.lit("80208C788E20A0")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", read(raw).alias("text"))


@_query("t32_focus_text", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, CASE kind WHEN 'table' THEN '| ' || replace(text, ' | ', ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(string_split(text, ' | '))::INT) ELSE text END AS text FROM blocks WHERE NOT contains(text, '||') AND NOT regexp_matches(text, '(^|[^ ])[|]|[|]($|[^ ])|\\\\|  ') AND trim(text) = text")
def t32(spark, sf_dir):
    """The text that a focused block stands for: tables as pipe tables, all else as it is."""
    from folioforge.functions.markdown import tables_as_markdown

    cells = F.transform(F.split("text", r" \| "), lambda t, i: F.struct(F.lit(0).alias("row"), i.alias("col"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), t.alias("text")))
    b = blocks(spark, sf_dir).where(~F.contains("text", F.lit("||")) & ~F.regexp_like("text", F.lit(r"(^|[^ ])[|]|[|]($|[^ ])|\\|  ")) & (F.trim("text") == F.col("text")))
    return b.select("book_id", "block_index", F.when(F.col("kind") == "table", tables_as_markdown(cells)).otherwise(F.col("text")).alias("text"))
