"""Further join, fold, state and text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import sentences as S
from folioforge.functions import text as X
from folioforge.operators import merges as M
from folioforge.operators import pages as P
from folioforge.operators import tree as N
from folioforge.sources.tables import BLOCKS_SQL, TOC_SQL, blocks, table, toc

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@_query("q15_visible_toc", f"WITH {TOC_SQL} SELECT id FROM toc WHERE parent IS NULL OR parent IN ('r0', 'r2')")
def q15(spark, sf_dir):
    """Contents rows whose ancestors are all open."""
    f = N.flattened(toc(spark, sf_dir))
    opened = F.array(F.lit("0"), F.lit("2"))
    return f.where(F.forall("ancestors", lambda a: F.array_contains(opened, a))).select("id")


@_query("j15_footnote_text", f"WITH {BLOCKS_SQL} SELECT e.event_id, trim(regexp_replace(b.text, '^[A-Z][a-z]+[ .]*', '')) AS note FROM events e JOIN blocks b ON b.book_id = e.user_id AND b.node = 'n' || (e.event_id % 3)")
def j15(spark, sf_dir):
    """The text of the block a note leads to, without its marker."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("book_id"), F.concat(F.lit("n"), F.pmod("event_id", F.lit(3))).alias("node"))
    return e.join(blocks(spark, sf_dir), ["book_id", "node"]).select("event_id", F.trim(F.regexp_replace("text", "^[A-Z][a-z]+[ .]*", "")).alias("note"))


@_query("j16_highlight_repair", f"WITH {BLOCKS_SQL} SELECT e.event_id, b.text IS NOT NULL AND left(b.text, 4) <> left(e.event_type, 4) AS stale FROM events e LEFT JOIN blocks b ON b.book_id = e.user_id AND b.node = 'n' || (e.event_id % 9)")
def j16(spark, sf_dir):
    """Highlights whose block no longer begins with what was quoted."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("book_id"), F.concat(F.lit("n"), F.pmod("event_id", F.lit(9))).alias("node"))
    stale = F.col("text").isNotNull() & (F.left("text", F.lit(4)) != F.left("event_type", F.lit(4)))
    return e.join(blocks(spark, sf_dir).select("book_id", "node", "text"), ["book_id", "node"], "left").select("event_id", stale.alias("stale"))


@_query("j17_respliced_toc", f"WITH {TOC_SQL} SELECT c.id, CASE WHEN c.parent IN ('r1', 'r3') THEN NULL ELSE c.parent END AS parent FROM toc c WHERE c.id NOT IN ('r1', 'r3')")
def j17(spark, sf_dir):
    """Contents without dropped entries, whose children go to the nearest entry that is kept."""
    t = toc(spark, sf_dir)
    gone = t.where(F.col("id").isin("r1", "r3")).select(F.col("id").alias("parent"), F.col("parent").alias("up"), F.lit(True).alias("gone"))
    kept = t.join(gone.select(F.col("parent").alias("id")), "id", "left_anti")
    return kept.join(gone, "parent", "left").select("id", F.when(F.col("gone"), F.col("up")).otherwise(F.col("parent")).alias("parent"))


@_query("j20_annotation_links", "SELECT e.event_id, 'book://section/' || d.doc_id AS link FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 9")
def j20(spark, sf_dir):
    """The section that an annotation stands in."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 9).alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("book://section/"), "doc_id").alias("link"))
    return e.join(d, "doc_id", "left").select("event_id", "link")


@_query("j23_href_position", f"WITH {BLOCKS_SQL} SELECT e.event_id, coalesce(b.block_index, 0) AS position FROM events e LEFT JOIN blocks b ON b.book_id = e.user_id AND b.node = 'n' || (e.event_id % 40)")
def j23(spark, sf_dir):
    """The position of a link's fragment, the start if it is unknown."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("book_id"), F.concat(F.lit("n"), F.pmod("event_id", F.lit(40))).alias("node"))
    return e.join(blocks(spark, sf_dir).select("book_id", "node", "block_index"), ["book_id", "node"], "left").select("event_id", F.coalesce("block_index", F.lit(0)).alias("position"))


@_query("j25_segment_overlay", f"WITH {BLOCKS_SQL}, s AS (SELECT book_id, block_index, unnest(range(len(l))) AS seg, unnest(l) AS t FROM (SELECT book_id, block_index, string_split(text, ' | ') AS l FROM blocks WHERE kind = 'table')), n AS (SELECT *, CASE WHEN seg % 3 = 0 THEN '[' || t || ']' ELSE t END AS new FROM s) SELECT book_id, block_index, seg, new, coalesce(sum(length(new) + 1) OVER (PARTITION BY book_id, block_index ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM n")
def j25(spark, sf_dir):
    """Translated cells and where each begins in its block."""
    s = blocks(spark, sf_dir).where("kind = 'table'").select("book_id", "block_index", F.posexplode(F.split("text", r" \| ")).alias("seg", "t"))
    n = s.withColumn("new", F.when(F.pmod("seg", F.lit(3)) == 0, F.concat(F.lit("["), "t", F.lit("]"))).otherwise(F.col("t")))
    w = Window.partitionBy("book_id", "block_index").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("book_id", "block_index", F.col("seg").cast("long").alias("seg"), "new", F.coalesce(F.sum(F.length("new") + 1).over(w), F.lit(0)).alias("at"))


@_query("g08_majority_shift", "WITH e AS (SELECT user_id AS book_id, event_id, event_id % 50 + 10 AS page, CASE WHEN event_id % 4 = 0 THEN event_id % 50 + 12 WHEN event_id % 4 = 1 THEN event_id % 50 + 10 + event_id % 3 END AS verified FROM events), c AS (SELECT book_id, verified - page AS d, count(*) AS n FROM e WHERE verified IS NOT NULL GROUP BY ALL), b AS (SELECT book_id, arg_max(d, (n, -abs(d), -d)) AS d, max(n) AS n, sum(n) AS total FROM c GROUP BY book_id) SELECT e.book_id, e.event_id, e.page + CASE WHEN e.verified IS NULL AND b.n >= 2 AND 2 * b.n > b.total THEN b.d ELSE 0 END AS page FROM e LEFT JOIN b ON b.book_id = e.book_id")
def g08(spark, sf_dir):
    """Pages that were not verified, moved by the offset that most verified ones have."""
    p, m = F.pmod("event_id", F.lit(50)) + 10, F.pmod("event_id", F.lit(4))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), "event_id", p.alias("page"), F.when(m == 0, p + 2).when(m == 1, p + F.pmod("event_id", F.lit(3))).alias("verified"))
    known = e.where("verified IS NOT NULL")
    best = M.modal_offset(known, "book_id", F.col("verified") - F.col("page")).join(known.groupBy("book_id").agg(F.count("*").alias("total")), "book_id")
    moves = F.col("verified").isNull() & (F.col("support") >= 2) & (2 * F.col("support") > F.col("total"))
    return e.join(best, "book_id", "left").select("book_id", "event_id", (F.col("page") + F.when(moves, F.col("offset")).otherwise(0)).alias("page"))


@_query("g25_locator_progression", "SELECT event_id, (event_id % 6 + (event_id % 8)::DOUBLE / 7) / 6 AS progression FROM events")
def g25(spark, sf_dir):
    """How far into a section a page is."""
    return table(spark, sf_dir, "events").select("event_id", ((F.pmod("event_id", F.lit(6)) + F.pmod("event_id", F.lit(8)).cast("double") / 7) / 6).alias("progression"))


@_query("g27_selection", """WITH p AS (SELECT *, row_number() OVER w AS n, last_value(CASE WHEN text <> '' THEN right(text, 1) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))
    SELECT conv_id, CASE WHEN count(text) = count(*) THEN string_agg((CASE WHEN regexp_matches(coalesce(prior, ''), '[\\p{L}\\p{N}]') AND regexp_matches(text, '^[\\p{L}\\p{N}]') THEN ' ' ELSE '' END) || text, '' ORDER BY n) END AS quote FROM p GROUP BY conv_id""")
def g27(spark, sf_dir):
    """Pieces of a selection as one, spaced only between letters and digits."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    ends = lambda s, p: F.coalesce(F.regexp_like(s, F.lit(p)), F.lit(False))
    before = F.last(F.when(F.col("text") != "", F.right("text", F.lit(1))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = F.concat(F.when(ends(before, r"[\p{L}\p{N}]") & ends(F.col("text"), r"^[\p{L}\p{N}]"), " ").otherwise(""), "text")
    pieces = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("n"), t.alias("t"))
    l = F.sort_array(F.collect_list(F.struct("n", "t")))  # noqa: E741
    return pieces.groupBy("conv_id").agg(F.when(F.count("t") == F.count("*"), F.array_join(F.transform(l, lambda x: x["t"]), "")).alias("quote"))


@_query("c01_normal_path", "SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '^/+|/+$', '', 'g') AS path FROM pages")
def c01(spark, sf_dir):
    """Paths resolved; ones that go down and up again are the same."""
    p = X.resource_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.normal_path(F.concat(F.lit("./x/../"), p)).alias("path"))


@_query("c26_prompt", "SELECT conv_id, string_agg((turn + 1) || '. ' || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def c26(spark, sf_dir):
    """Numbered references put together."""
    l = F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("t"))))  # noqa: E741
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(l, lambda x: F.concat(x["turn"] + 1, F.lit(". "), x["t"])), "\n\n").alias("prompt"))


@_query("c29_keyed_output", "SELECT event_id, event_id % 3 > 0 AS whole FROM events")
def c29(spark, sf_dir):
    """Whether a keyed answer has text for every key."""
    answer = F.to_json(F.create_map(F.lit("1"), F.col("event_type"), F.lit("2"), F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("props")).otherwise(" ")))
    got = F.from_json(answer, "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.forall(F.array(F.lit("1"), F.lit("2")), lambda k: F.coalesce(F.trim(F.element_at(got, k)) != "", F.lit(False))).alias("whole"))


@_query("c08_translation_spacing", "SELECT doc_id, trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS text FROM documents")
def c08(spark, sf_dir):
    """Spacing of a translation: runs collapse, and go between CJK letters."""
    t = F.trim(F.regexp_replace("text", r"[ \t]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(t, rf"(?<=[{X.CJK}]) (?=[{X.CJK}])", "").alias("text"))


@_query("x02_full_sync", "WITH r AS (SELECT p_partkey AS id FROM part WHERE p_size > 15), l AS (SELECT p_partkey AS id FROM part WHERE p_size < 30), g AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error') SELECT coalesce(r.id, l.id) AS id, CASE WHEN l.id IS NULL AND g.id IS NOT NULL THEN 'removed' WHEN l.id IS NULL THEN 'download' WHEN r.id IS NULL THEN 'upload' ELSE 'merge' END AS action FROM r FULL JOIN l ON r.id = l.id LEFT JOIN g ON g.id = coalesce(r.id, l.id)")
def x02(spark, sf_dir):
    """What a sync does with each book, here, there, or removed here."""
    p = table(spark, sf_dir, "part")
    r, l = p.where("p_size > 15").select(F.col("p_partkey").alias("id"), F.lit(True).alias("there")), p.where("p_size < 30").select(F.col("p_partkey").alias("id"), F.lit(True).alias("here"))  # noqa: E741
    g = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.lit(True).alias("gone")).distinct()
    action = F.when(F.col("here").isNull() & F.col("gone"), "removed").when(F.col("here").isNull(), "download").when(F.col("there").isNull(), "upload").otherwise("merge")
    return r.join(l, "id", "full").join(g, "id", "left").select("id", action.alias("action"))


@_query("x09_restored_order", f"WITH {BLOCKS_SQL} SELECT book_id, string_agg(text, '|' ORDER BY block_index) AS t FROM blocks GROUP BY book_id")
def x09(spark, sf_dir):
    """Results of parallel work, in the order of what was asked."""
    b = blocks(spark, sf_dir).repartition("node")
    l = F.sort_array(F.collect_list(F.struct("block_index", F.col("text").alias("t"))))  # noqa: E741
    return b.groupBy("book_id").agg(F.array_join(F.transform(l, lambda x: x["t"]), "|").alias("t"))


@_query("s13_byte_order_marks", "SELECT p_partkey, p_name AS text FROM part")
def s13(spark, sf_dir):
    """Text by its byte order mark."""
    raw = F.when(F.pmod("p_size", F.lit(2)) == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("p_name", "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("p_name", "UTF-8")))
    h = F.hex(raw)
    text = F.when(F.startswith(h, F.lit("FFFE")), F.decode(F.unhex(F.substring(h, 5, 1 << 30)), "UTF-16LE")).when(F.startswith(h, F.lit("EFBBBF")), F.decode(F.unhex(F.substring(h, 7, 1 << 30)), "UTF-8")).otherwise(F.decode(raw, "UTF-8"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@_query("t17_css_lengths", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 16.0 ELSE p_size * 16.0 / 100 END AS px FROM part")
def t17(spark, sf_dir):
    """Lengths of style sheets in pixels, of em and per cent relative to 16."""
    unit = F.get(F.array(F.lit("px"), F.lit("em"), F.lit("%")), F.pmod("p_size", F.lit(3)))
    value = F.concat("p_size", unit)
    n, u = F.regexp_extract(value, r"^([0-9.]+)", 1).cast("double"), F.regexp_extract(value, r"([a-z%]+)$", 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(u == "px", n).when(u == "em", n * 16).otherwise(n * 16 / 100).alias("px"))


@_query("t19_anchor_targets", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, first_value(CASE WHEN kind <> 'table' THEN node END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY block_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM blocks")
def t19(spark, sf_dir):
    """The next node that an anchor binds to."""
    w = Window.partitionBy("book_id").orderBy("block_index").rowsBetween(0, Window.unboundedFollowing)
    return blocks(spark, sf_dir).select("book_id", "block_index", F.first(F.when(F.col("kind") != "table", F.col("node")), True).over(w).alias("target"))


@_query("w07_sentence_atoms")
def w07(spark, sf_dir):
    """Sentences of each block, brackets and quotes kept whole; the scan has no SQL."""
    return blocks(spark, sf_dir).select("book_id", "block_index", F.posexplode(S.sentence_atoms("text")).alias("atom", "a")).select("book_id", "block_index", "atom", "a.*")


@_query("w08_lossless_sentences", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, text FROM blocks")
def w08(spark, sf_dir):
    """Sentences put together again: nothing is lost."""
    return blocks(spark, sf_dir).select("book_id", "block_index", F.array_join(F.transform(S.sentence_atoms("text"), lambda a: a["text"]), "").alias("text"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _plain_sql(block: str) -> str:
    return f"(NOT regexp_matches({block}, '{_re2(P.NOT_PARAGRAPH)}') AND NOT regexp_matches(regexp_replace({block}, '{_re2(P.CODE_TICKS)}', '', 'g'), '{_re2(P.NOT_PLAIN)}'))"


_CLOSED_SQL = "right(rtrim(tail, '" + P.CLOSING.replace("'", "''") + "'), 1)"
_HYPHEN_SQL = "(" + ", ".join(f"'{c}'" for c in P.HYPHENS) + ")"
_TERMINAL_SQL = "(" + ", ".join(f"'{c}'" for c in X.TERMINALS) + ")"


@_query("w11_joined_pages", f"""WITH RECURSIVE {BLOCKS_SQL}, m AS (
    SELECT book_id, block_index // 3 AS page, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS md FROM blocks GROUP BY ALL),
    p AS (SELECT book_id, page, (book_id + page) % 7 = 0 AS role, row_number() OVER (PARTITION BY book_id ORDER BY page) AS n,
          list_filter(list_transform(string_split(md, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x <> '') AS b FROM m),
    s AS (SELECT *, b[-1] AS tail, lead(b[1]) OVER w AS head, role OR coalesce(lead(role) OVER w, true) AS apart FROM p WINDOW w AS (PARTITION BY book_id ORDER BY page)),
    j AS (SELECT *, coalesce(NOT apart AND head IS NOT NULL AND tail IS NOT NULL AND {_plain_sql('tail')} AND {_plain_sql('head')} AND (right(tail, 1) IN {_HYPHEN_SQL}
          OR CASE {_CLOSED_SQL} WHEN '' THEN false WHEN '.' THEN regexp_matches(head, '^\\p{{Ll}}') ELSE {_CLOSED_SQL} NOT IN {_TERMINAL_SQL} END), false) AS fits FROM s),
    r AS (SELECT book_id, page, n, b, tail, head, fits AS joins, false AS gave FROM j WHERE n = 1
    UNION ALL SELECT j.book_id, j.page, j.n, j.b, j.tail, j.head, j.fits AND NOT (r.joins AND len(j.b) = 1), r.joins FROM r JOIN j ON j.book_id = r.book_id AND j.n = r.n + 1),
    o AS (SELECT *, CASE WHEN gave THEN b[2:] ELSE b END AS own FROM r)
    SELECT book_id, page, array_to_string(CASE WHEN joins THEN list_append(own[:-2], CASE WHEN right(tail, 1) IN {_HYPHEN_SQL} THEN left(tail, length(tail) - 1) || head
        ELSE tail || (CASE WHEN regexp_matches(tail, '[A-Za-z0-9]$') AND regexp_matches(head, '^[A-Za-z0-9]') THEN ' ' ELSE '' END) || head END) ELSE own END, chr(10) || chr(10)) AS markdown FROM o""")
def w11(spark, sf_dir):
    """Paragraphs that a page break cut, joined."""
    l = F.sort_array(F.collect_list(F.struct("block_index", "text")))  # noqa: E741
    pages = blocks(spark, sf_dir).groupBy("book_id", F.expr("block_index div 3").alias("page")).agg(F.array_join(F.transform(l, lambda x: x["text"]), "\n\n").alias("markdown"))
    return P.joined_pages(pages.withColumn("role", F.when(F.pmod(F.col("book_id") + F.col("page"), F.lit(7)) == 0, "cover")))


_LINES_SQL = """l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line,
    l_quantity AS q, l_partkey AS p FROM lineitem),
    k AS (SELECT page, line, 50.0 + q % 7 * 9 AS x, line * 13.0 + q % 5 * 2 AS y, 60.0 + q * 5 AS w, 9.0 + p % 6 AS h,
    CASE WHEN p % 11 = 0 THEN '1.' || line || ' Part' ELSE repeat('word ', (q / 2)::INT) || 'end' END AS text FROM l)"""


@_query("w13_line_groups", f"""WITH RECURSIVE {_LINES_SQL},
    c AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(w) OVER v AS pw, lag(h) OVER v AS ph, lag(text) OVER v AS pt,
          length(text) < 80 AND regexp_matches(text, '^[0-9.]*[.][0-9.]*[ ]') AS heading FROM k WINDOW v AS (PARTITION BY page ORDER BY line)),
    n AS (SELECT *, greatest(ph, h, 1.0) AS tall, NOT (y - py <= greatest(ph, h, 1.0) * 0.25 OR y - (py + ph) > greatest(ph, h, 1.0) * 0.45) AND least(ph, h) / greatest(ph, h, 1.0) >= 0.68
          AND NOT (length(text) < 20 AND w < pw * 0.35 AND length(pt) > 40)
          AND ((least(px + pw, x + w) - greatest(px, x)) / greatest(least(pw, w), 1.0) >= 0.35 OR abs(x - px) <= greatest(ph, h, 1.0) * 2.5) AS near FROM c),
    r AS (SELECT page, line, 0 AS g, x AS fx, w AS fw, heading AS fh, 1 AS size FROM n WHERE line = 1
    UNION ALL
    SELECT page, line, g + new::INT, CASE WHEN new THEN x ELSE fx END, CASE WHEN new THEN w ELSE fw END, CASE WHEN new THEN heading ELSE fh END, CASE WHEN new THEN 1 ELSE size + 1 END
    FROM (SELECT n.*, r.g, r.fx, r.fw, r.fh, r.size, NOT n.near OR r.fh OR n.x > r.fx + n.tall * 2.5 OR (n.x + n.tall * 4.0 < r.fx AND n.w > r.fw * 1.25) OR (r.size > 1 AND n.w > r.fw * 1.35 AND n.pw < n.w * 0.8) AS new
          FROM r JOIN n ON n.page = r.page AND n.line = r.line + 1))
    SELECT page, line, g::BIGINT AS "group" FROM r""")
def w13(spark, sf_dir):
    """Lines of a page in paragraphs by their boxes."""
    w = Window.partitionBy("page").orderBy("l_linenumber", "p", "l_suppkey", "q", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.col("l_partkey").alias("p"), "l_suppkey", F.col("l_quantity").alias("q"), "l_extendedprice")  # noqa: E741
    l = l.withColumn("line", F.row_number().over(w).cast("long"))  # noqa: E741
    text = F.when(F.pmod("p", F.lit(11)) == 0, F.concat(F.lit("1."), "line", F.lit(" Part"))).otherwise(F.concat(F.expr("repeat('word ', int(round(q / 2)))"), F.lit("end")))
    return P.line_groups(l.select("page", "line", (50.0 + F.col("q") % 7 * 9).alias("x"), (F.col("line") * 13.0 + F.col("q") % 5 * 2).alias("y"), (60.0 + F.col("q") * 5).alias("w"), (9.0 + F.col("p") % 6).alias("h"), text.alias("text")))
