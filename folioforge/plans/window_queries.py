"""Segmentation, ordering, set and tree queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import tree as N
from folioforge.operators import windows as W
from folioforge.sources.tables import BLOCKS_SQL, TOC_SQL, blocks, table, toc

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@_query("w01_split_blocks", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, piece, substr(text, piece * 100 + 1, 100) AS text FROM (SELECT *, unnest(range(0, (char_length + 99) // 100)) AS piece FROM blocks)")
def w01(spark, sf_dir, most: int = 100):
    """Long blocks in pieces of stable ranges."""
    b = blocks(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(char_length - 1) div {most}"))).alias("piece"))
    return b.select("book_id", "block_index", "piece", F.substring("text", (F.col("piece") * most + 1).cast("int"), F.lit(most)).alias("text"))


_NUMBERED = f"{BLOCKS_SQL}, b AS (SELECT book_id, block_index, char_length AS x, row_number() OVER (PARTITION BY book_id ORDER BY block_index) AS rn FROM blocks)"


def _greedy_sql(most: int, most_rows: int) -> str:
    """The fold as a recursion: a group's sum and rows go along, and whether it is closed."""
    return f"""WITH RECURSIVE {_NUMBERED}, f AS (
        SELECT book_id, block_index, rn, 0 AS "group", x AS total, 1 AS n, x >= {most} OR 1 >= {most_rows} AS closed FROM b WHERE rn = 1
        UNION ALL
        SELECT book_id, block_index, rn, "group" + new::INT, CASE WHEN new THEN x ELSE total + x END, CASE WHEN new THEN 1 ELSE n + 1 END,
               (CASE WHEN new THEN x ELSE total + x END) >= {most} OR (CASE WHEN new THEN 1 ELSE n + 1 END) >= {most_rows}
        FROM (SELECT b.*, f."group", f.total, f.n, f.total + b.x > {most} OR f.n >= {most_rows} OR f.closed AS new FROM f JOIN b ON b.book_id = f.book_id AND b.rn = f.rn + 1))
        SELECT book_id, block_index, "group"::BIGINT AS "group" FROM f"""


@_query("w02_fragments", _greedy_sql(4096, 64))
def w02(spark, sf_dir):
    """Blocks in fragments of at most 64 blocks and 4096 signs."""
    return W.grouped(blocks(spark, sf_dir), "book_id", "block_index", "char_length", 4096, 64, after=True)


@_query("w03_reading_units", f"WITH {BLOCKS_SQL}, u AS (SELECT *, sum(CASE WHEN kind = 'heading' OR block_index = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY block_index) AS unit FROM blocks) SELECT book_id, unit, min(block_index) AS first, max(block_index) + 1 AS past FROM u GROUP BY book_id, unit")
def w03(spark, sf_dir):
    """Ranges of blocks that begin with a heading."""
    w = Window.partitionBy("book_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    u = blocks(spark, sf_dir).withColumn("unit", F.sum(((F.col("kind") == "heading") | (F.col("block_index") == 0)).cast("long")).over(w))
    return u.groupBy("book_id", "unit").agg(F.min("block_index").alias("first"), (F.max("block_index") + 1).alias("past"))


@_query("w04_layout_segments", f"WITH {BLOCKS_SQL}, t AS (SELECT *, sum(char_length) OVER (PARTITION BY book_id) AS total FROM blocks) SELECT book_id, block_index, sum(CASE WHEN block_index = 0 OR (total >= 2000 AND kind = 'heading') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY block_index)::BIGINT AS segment FROM t")
def w04(spark, sf_dir):
    """Segments that headings begin in long sections only."""
    w = Window.partitionBy("book_id")
    t = blocks(spark, sf_dir).withColumn("total", F.sum("char_length").over(w))
    start = (F.col("block_index") == 0) | ((F.col("total") >= 2000) & (F.col("kind") == "heading"))
    return t.select("book_id", "block_index", F.sum(start.cast("long")).over(w.orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


@_query("w05_fixed_units", "WITH s AS (SELECT DISTINCT user_id, event_id % 200 AS start FROM events) SELECT user_id, start, lead(start, 1, 200) OVER (PARTITION BY user_id ORDER BY start) AS past FROM s")
def w05(spark, sf_dir):
    """Units between the distinct starts of a book."""
    s = table(spark, sf_dir, "events").select("user_id", F.pmod("event_id", F.lit(200)).alias("start")).distinct()
    return s.withColumn("past", F.lead("start", 1, 200).over(Window.partitionBy("user_id").orderBy("start")))


@_query("w06_focus_roots", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, max(CASE WHEN kind <> 'table' THEN block_index END) OVER (PARTITION BY book_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS root FROM blocks")
def w06(spark, sf_dir):
    """The block that each dependent block belongs to."""
    w = Window.partitionBy("book_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return blocks(spark, sf_dir).select("book_id", "block_index", F.max(F.when(F.col("kind") != "table", F.col("block_index"))).over(w).alias("root"))


@_query("w12_reflow_sections", f"WITH {BLOCKS_SQL}, s AS (SELECT book_id, block_index AS start, lead(block_index, 1, 1000000) OVER (PARTITION BY book_id ORDER BY block_index) AS past FROM blocks WHERE kind = 'heading' OR block_index = 0) SELECT s.book_id, s.start, count(*) AS n, sum(char_length)::BIGINT AS chars FROM s JOIN blocks b ON b.book_id = s.book_id AND b.block_index >= s.start AND b.block_index < s.past GROUP BY ALL")
def w12(spark, sf_dir):
    """What each section between two starts holds."""
    w = Window.partitionBy("book_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks(spark, sf_dir).withColumn("start", F.max(F.when((F.col("kind") == "heading") | (F.col("block_index") == 0), F.col("block_index"))).over(w))
    return b.groupBy("book_id", "start").agg(F.count("*").alias("n"), F.sum("char_length").alias("chars"))


@_query("w14_greedy_batches", f"""WITH RECURSIVE {_NUMBERED}, f AS (
    SELECT book_id, block_index, rn, 0 AS g, x AS total FROM b WHERE rn = 1
    UNION ALL
    SELECT b.book_id, b.block_index, b.rn, f.g + (f.total + b.x > 2000)::INT, CASE WHEN f.total + b.x > 2000 THEN b.x ELSE f.total + b.x END FROM f JOIN b ON b.book_id = f.book_id AND b.rn = f.rn + 1)
    SELECT book_id, block_index, g::BIGINT AS "group" FROM f""")
def w14(spark, sf_dir):
    """Blocks in batches of at most 2000 signs."""
    return W.grouped(blocks(spark, sf_dir), "book_id", "block_index", "char_length", 2000)


@_query("w15_chunks", "SELECT l_orderkey // 100 AS chunk, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY l_orderkey // 100")
def w15(spark, sf_dir):
    """Pages in chunks of 100."""
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 100").alias("chunk")).agg(F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@_query("w16_candidate_pages", "SELECT event_id, unnest(range(greatest(1, event_id % 50 - 2), least(48, event_id % 50 + 2) + 1)) AS page FROM events WHERE event_id % 50 > 0")
def w16(spark, sf_dir):
    """The pages near a predicted one."""
    e = table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(50)).alias("p")).where("p > 0")
    return e.select("event_id", F.explode(F.filter(F.sequence(F.greatest(F.lit(1), F.col("p") - 2), F.col("p") + 2), lambda x: x <= 48)).alias("page"))


@_query("w17_last_turns", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w17(spark, sf_dir, most: int = 3):
    """The last turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("conv_id", "turn")


@_query("w18_context_window", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, sum(char_length) OVER (PARTITION BY book_id ORDER BY block_index ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)::BIGINT AS chars FROM blocks")
def w18(spark, sf_dir):
    """How much text stands around each block."""
    w = Window.partitionBy("book_id").orderBy("block_index").rowsBetween(-2, 3)
    return blocks(spark, sf_dir).select("book_id", "block_index", F.sum("char_length").over(w).alias("chars"))


def _entries(spark, sf_dir):
    """Contents entries made from events: book, order, depth, page, title."""
    e = table(spark, sf_dir, "events")
    title = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.col("event_id"), F.lit(" "), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), F.pmod("event_id", F.lit(4)).alias("depth"), F.expr("event_id div 300 + 1").alias("page"), title.alias("title"))


@_query("w19_toc_depths", """WITH RECURSIVE e AS (SELECT user_id AS book_id, event_id AS ord, event_id % 4 AS depth, event_id // 300 + 1 AS page, event_id % 3 = 0 AS numbered FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, depth, numbered, ord) AS rn FROM e),
    f AS (SELECT book_id, ord, rn, 0::BIGINT AS depth, page, numbered FROM r WHERE rn = 1
    UNION ALL
    SELECT r.book_id, r.ord, r.rn, CASE WHEN r.depth = 0 AND f.depth = 0 AND r.page = f.page AND r.numbered AND NOT f.numbered THEN 1 ELSE least(r.depth, f.depth + 1) END, r.page, r.numbered
    FROM f JOIN r ON r.book_id = f.book_id AND r.rn = f.rn + 1)
    SELECT book_id, ord, depth FROM f""")
def w19(spark, sf_dir):
    """Contents entries sorted, their depths made to nest."""
    e = _entries(spark, sf_dir).withColumn("numbered", F.regexp_like("title", F.lit("^[0-9０-９]")))
    lists = e.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page", "depth", "numbered", "ord"))).alias("l"))
    return lists.select("book_id", F.explode(F.arrays_zip("l", W.toc_depths(F.col("l")).alias("d"))).alias("z")).select("book_id", F.col("z.l.ord").alias("ord"), F.col("z.d").cast("long").alias("depth"))


@_query("w20_citation_islands", "WITH r AS (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT user_id, min(event_id) AS first, count(*) AS n FROM r GROUP BY user_id, g")
def w20(spark, sf_dir):
    """Runs of citations whose numbers follow each other."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = table(spark, sf_dir, "events").withColumn("g", F.col("event_id") - F.row_number().over(w))
    return r.groupBy("user_id", "g").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("g")


@_query("w21_keyset_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 20")
def w21(spark, sf_dir):
    """The next page after a cursor."""
    return table(spark, sf_dir, "part").where("p_partkey > 100").orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@_query("w22_adjacent_units", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, lag(node) OVER w AS previous, lead(node) OVER w AS next FROM blocks WINDOW w AS (PARTITION BY book_id ORDER BY block_index)")
def w22(spark, sf_dir):
    """The units before and after each."""
    w = Window.partitionBy("book_id").orderBy("block_index")
    return blocks(spark, sf_dir).select("book_id", "block_index", F.lag("node").over(w).alias("previous"), F.lead("node").over(w).alias("next"))


@_query("w24_unit_ranges", f"WITH {BLOCKS_SQL} SELECT book_id, string_agg(node || ':' || char_length, ',' ORDER BY block_index) AS ranges FROM blocks GROUP BY book_id")
def w24(spark, sf_dir):
    """All ranges of a unit in order."""
    l = F.sort_array(F.collect_list(F.struct("block_index", "node", "char_length")))  # noqa: E741
    return blocks(spark, sf_dir).groupBy("book_id").agg(F.array_join(F.transform(l, lambda x: F.concat(x["node"], F.lit(":"), x["char_length"])), ",").alias("ranges"))


@_query("o01_shelf_order", "SELECT p_partkey, row_number() OVER (ORDER BY greatest(coalesce(a.n, 0), p_size) DESC, p_size DESC, p_partkey) AS place FROM part LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a ON a.user_id = p_partkey")
def o01(spark, sf_dir):
    """The shelf by what was read or added last, and each book's place on it."""
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("p_partkey")).agg(F.count("*").alias("n"))
    books = table(spark, sf_dir, "part").join(a, "p_partkey", "left").select("p_partkey", "p_size", F.greatest(F.coalesce("n", F.lit(0)), F.col("p_size").cast("long")).alias("activity"))
    return W.ranked(books, [F.desc("activity"), F.desc("p_size"), F.asc("p_partkey")], "shelf").select("p_partkey", "place")


@_query("o02_library_order", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def o02(spark, sf_dir):
    """The library, added last first, and each book's place in it."""
    return W.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], "library").select("o_orderkey", "o_orderdate", "place")


@_query("o03_live_annotations", "SELECT event_id FROM events WHERE event_type <> 'error'")
def o03(spark, sf_dir):
    """Annotations that are not deleted, newest first."""
    return table(spark, sf_dir, "events").where("event_type <> 'error'").orderBy(F.desc("ts"), "event_id").select("event_id")


@_query("o04_clamped_listing", f"WITH {TOC_SQL} SELECT id, label FROM toc ORDER BY id LIMIT least(greatest(80, 1), 200)")
def o04(spark, sf_dir, asked: int = 80):
    """Contents up to a clamped number."""
    return toc(spark, sf_dir).orderBy("id").limit(min(max(asked, 1), 200)).select("id", "label")


@_query("o05_toc_order", "SELECT user_id AS book_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 300, event_id % 4, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, event_id) AS place FROM events")
def o05(spark, sf_dir):
    """Contents by page, depth, numbering, in a stable order."""
    w = Window.partitionBy("book_id").orderBy("page", "depth", F.regexp_like("title", F.lit("^[0-9０-９]")).cast("int"), "ord")
    return _entries(spark, sf_dir).select("book_id", "ord", F.row_number().over(w).cast("long").alias("place"))


@_query("o06_rewrite_order", f"WITH {BLOCKS_SQL} SELECT book_id, node, row_number() OVER (PARTITION BY book_id ORDER BY node) AS place FROM blocks")
def o06(spark, sf_dir):
    """Rewrites by the name of their block, as strings."""
    return blocks(spark, sf_dir).select("book_id", "node", F.row_number().over(Window.partitionBy("book_id").orderBy("node")).cast("long").alias("place"))


@_query("u01_union_ids", "SELECT p_partkey AS id FROM part WHERE p_size < 20 UNION SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def u01(spark, sf_dir):
    """Ids that are here or there."""
    return table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "lineitem").where("l_quantity < 3").select("l_partkey")).distinct()


@_query("u02_first_role", "SELECT user_id, event_id % 30 AS page, min_by(event_type, event_id) AS role FROM events GROUP BY ALL")
def u02(spark, sf_dir):
    """The first role given to each page."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.pmod("event_id", F.lit(30)).alias("page")).agg(F.min_by("event_type", "event_id").alias("role"))


@_query("u03_content_duplicates", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS fresh FROM documents")
def u03(spark, sf_dir):
    """Whether a document's content is new when it is imported."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first"))
    return h.join(first, "h").select("doc_id", (F.col("doc_id") == F.col("first")).alias("fresh"))


@_query("u04_array_union", "SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || ',' || p_brand END AS properties FROM part")
def u04(spark, sf_dir):
    """Properties of both lists, each once, in order."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_union(F.array("p_type"), F.array("p_type", "p_brand")), ",").alias("properties"))


@_query("u05_models", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE event_type || ',view' END AS models FROM events")
def u05(spark, sf_dir):
    """Names trimmed, blanks and repeats gone."""
    names = F.array_distinct(F.filter(F.transform(F.array(F.concat(F.lit(" "), "event_type"), F.lit("view "), F.lit(" ")), lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(names, ",").alias("models"))


@_query("u06_difference", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def u06(spark, sf_dir):
    """Ids that are there and not here."""
    there = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    return there.join(table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id")), "id", "left_anti")


_FLAT = f"""{TOC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, id) - 1 AS n FROM toc),
    flat AS (SELECT a.id, a.label, a.n::VARCHAR AS path, 0::BIGINT AS depth, true AS has_children FROM r a WHERE parent IS NULL
    UNION ALL SELECT c.id, c.label, p.n || '/' || c.n, 1, false FROM r c JOIN r p ON c.parent = p.id)"""


@_query("n01_flattened_toc", f"WITH {_FLAT} SELECT id, label, path, depth, has_children FROM flat")
def n01(spark, sf_dir):
    """The contents as a list with paths and depths."""
    return N.flattened(toc(spark, sf_dir)).select("id", "label", "path", "depth", "has_children")


@_query("n02_nested_toc", "WITH e AS (SELECT user_id AS book_id, event_id AS ord, event_id % 4 AS depth FROM events) SELECT a.book_id, a.ord, max(b.ord) AS parent FROM e a LEFT JOIN e b ON b.book_id = a.book_id AND b.ord < a.ord AND b.depth = a.depth - 1 GROUP BY ALL")
def n02(spark, sf_dir):
    """The parent of each entry of a list of depths."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), F.pmod("event_id", F.lit(4)).alias("depth"))
    return N.parents_from_depths(e, "book_id", "ord", "depth").select("book_id", "ord", "parent")


@_query("n03_promote_root", f"WITH {_FLAT} SELECT id, depth - CASE WHEN (SELECT count(*) FROM flat WHERE depth = 0) = 1 THEN 1 ELSE 0 END AS depth FROM flat")
def n03(spark, sf_dir):
    """Depths, one less if there is a single root."""
    f = N.flattened(toc(spark, sf_dir))
    roots = f.where("depth = 0").agg((F.count("*") == 1).cast("long").alias("one"))
    return f.join(F.broadcast(roots), F.lit(True)).select("id", (F.col("depth") - F.col("one")).alias("depth"))


@_query("n04_first_page", f"WITH {TOC_SQL} SELECT p.id, coalesce(min(c.ord), p.ord) AS page FROM toc p LEFT JOIN toc c ON c.parent = p.id GROUP BY p.id, p.ord")
def n04(spark, sf_dir):
    """The first page of each subtree."""
    t = toc(spark, sf_dir)
    c = t.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.min("ord").alias("page"))
    return t.join(c, "id", "left").select("id", F.coalesce("page", "ord").alias("page"))


@_query("n05_descendants", f"WITH {TOC_SQL} SELECT p.id, count(c.id) AS n FROM toc p LEFT JOIN toc c ON c.parent = p.id GROUP BY p.id")
def n05(spark, sf_dir):
    """How many entries each one has below it."""
    f = N.flattened(toc(spark, sf_dir))
    below = f.select(F.explode("ancestors").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return f.join(below, "path", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@_query("n06_top_groups", "SELECT user_id AS book_id, event_id AS ord, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS \"group\" FROM events")
def n06(spark, sf_dir):
    """The top entry that each entry is under, by number."""
    return N.top_groups(_entries(spark, sf_dir), "book_id", "ord", "depth").select("book_id", "ord", "group")


@_query("x10_latest_task", "SELECT user_id, max_by(event_type, event_id) AS update FROM events GROUP BY user_id")
def x10(spark, sf_dir):
    """Updates of the latest task only."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("update"))


@_query("x11_change_feed", "SELECT user_id, max_by(event_type, event_id) AS action FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def x11(spark, sf_dir):
    """What is left of each annotation after its changes in order."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("action")).where("action <> 'error'")


@_query("e07_rewrite_log", "SELECT user_id, max_by(props, event_id) AS text FROM events WHERE event_id <= 5000 GROUP BY user_id")
def e07(spark, sf_dir, version: int = 5000):
    """Rewrites as they stood at a version."""
    return table(spark, sf_dir, "events").where(F.col("event_id") <= version).groupBy("user_id").agg(F.max_by("props", "event_id").alias("text"))
