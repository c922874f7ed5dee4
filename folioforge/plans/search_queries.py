"""Search and predicate queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators.search import matches, search, section_titles, suggestions
from folioforge.sources.tables import BLOCKS_SQL, blocks, table


def _matches_sql(query: str) -> str:
    return f"""c AS (SELECT book_id, block_index, node, kind, unnest(CASE kind WHEN 'table' THEN range(len(l)) ELSE [NULL] END) AS cell, unnest(l) AS text
        FROM (SELECT *, CASE kind WHEN 'table' THEN string_split(text, ' | ') ELSE [text] END AS l FROM blocks)),
    titles AS (SELECT book_id, coalesce(min_by(text, block_index) FILTER (WHERE kind = 'heading'), 'Section ' || (book_id + 1)) AS title FROM blocks GROUP BY book_id),
    m AS (SELECT *, regexp_extract_all(text, '(?i){query}') AS ms, string_split_regex(text, '(?i){query}') AS ps FROM c),
    e AS (SELECT * EXCLUDE (ms, ps), unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM m),
    found AS (SELECT book_id, block_index, cell, node, kind, text, ms[i] AS matched,
        (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS start FROM e),
    hits AS (SELECT book_id, block_index, cell, node, kind, matched, start, start + length(matched) AS "end",
        (CASE WHEN start > 72 THEN '…' ELSE '' END) || trim(substr(text, greatest(start - 72, 0) + 1, least(start + length(matched) + 72, length(text)) - greatest(start - 72, 0)))
        || (CASE WHEN start + length(matched) + 72 < length(text) THEN '…' ELSE '' END) AS excerpt FROM found)"""


def q08_shelf_filter(spark, sf_dir):
    """Titles or authors that contain a query."""
    p = table(spark, sf_dir, "part")
    return p.where(F.contains(F.lower("p_name"), F.lit("bolt")) | F.exists(F.array("p_brand"), lambda a: F.contains(F.lower(a), F.lit("brand#2")))).select("p_partkey")


def q09_annotation_search(spark, sf_dir):
    """Notes that contain a query, newest first, at most a clamped number."""
    c = table(spark, sf_dir, "conversations")
    return c.where(F.contains(F.lower("text"), F.lit("the"))).orderBy(F.desc("conv_id"), "turn").limit(max(1, min(100, 20))).select("conv_id", "turn")


def q10_suggestions(spark, sf_dir):
    """The best references for a typed query."""
    p = table(spark, sf_dir, "part")
    options = p.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("label"), F.col("p_type").alias("description"), F.col("p_brand").alias("excerpt"), (F.pmod("p_size", F.lit(3)) * 12).alias("kind_score"))
    return suggestions(options, "ring", 8).select("idx", F.col("score").cast("long").alias("score"))


def q11_reference_token(spark, sf_dir):
    """The unfinished reference at the end of an input."""
    p = table(spark, sf_dir, "part").withColumn("input", F.concat("p_type", F.when(F.pmod("p_size", F.lit(2)) == 0, " @").otherwise("@"), "p_name"))
    return p.select("p_partkey", F.nullif(F.regexp_extract("input", r"(?:^|[^\p{L}\p{N}_.@-])@([^\s@][^\n@]*)$", 1), F.lit("")).alias("token"))


def q12_commands(spark, sf_dir):
    """Commands that begin with a typed token."""
    names = F.array(*[F.lit(x) for x in ("/summary", "/search", "/rewrite", "/extract")])
    e = table(spark, sf_dir, "events").withColumn("token", F.concat(F.lit("/"), F.left("event_type", F.lit(1))))
    return e.select("event_id", F.size(F.filter(names, lambda n: F.startswith(n, F.col("token")))).cast("long").alias("n"))


def q16_needs_vision(spark, sf_dir):
    """Pages with images and no text to speak of."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", (F.contains("html", F.lit("<img")) & (F.length(F.trim(F.regexp_replace("html", "(?s)<[^>]*>", ""))) < 400)).alias("needs_vision"))


def q17_page_index_toc(spark, sf_dir):
    """Contents whose labels are mostly page numbers."""
    b = blocks(spark, sf_dir)
    label = F.element_at(F.split("text", " "), 1)
    g = b.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.regexp_like(label, F.lit("^[0-9０-９ivxlcdmIVXLCDM]+$"))).alias("k"))
    return g.select("book_id", ((F.col("n") >= 4) & (3 * F.col("k") >= 2 * F.col("n"))).alias("page_index"))


def q22_mapping_plausible(spark, sf_dir):
    """Contents whose pages never go back, and differ, unless they are short."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), F.pmod(F.col("event_id"), F.lit(977)).alias("page"))
    w = Window.partitionBy("book_id").orderBy("ord")
    g = e.withColumn("step", F.col("page") - F.lag("page").over(w)).groupBy("book_id").agg(F.count("*").alias("n"), F.count_distinct("page").alias("d"), F.min("step").alias("s"))
    return g.select("book_id", ((F.col("n") < 4) | ((F.col("d") >= 3) & (F.col("s") >= 0))).alias("plausible"))


#: What a page without text says (fixed values).
NO_TEXT = ("本页未识别到正文", "本页尚未生成OCR正文")


def q23_placeholders(spark, sf_dir):
    """Pages that only say that they have no text, emptied: a heading with the page's number, then the phrase."""
    e = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    stub = lambda phrase: F.concat(F.lit("## 第 "), number, F.lit(f" 页\n\n{phrase}\n"))
    md = F.when(F.pmod("event_id", F.lit(4)) == 0, stub("本页未识别到正文。")).when(F.pmod("event_id", F.lit(4)) == 1, stub("本页尚未生成 OCR 正文")).when(F.pmod("event_id", F.lit(4)) == 2, stub("本页未识别到正文。 but more")).otherwise(F.col("props"))
    heading = F.regexp_extract(md, r"^\s*(#{1,6}\s*第\s*[0-9]+\s*页)", 1)
    rest = F.regexp_replace(F.substring(F.ltrim(md), F.length(heading) + 1, F.length(md)), r"\s+", "")
    phrase = F.regexp_replace(rest, r"[。.]$", "")
    return e.select("event_id", F.when((heading != "") & phrase.isin(*NO_TEXT), "").otherwise(md).alias("markdown"))


def _ranges(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return b.select("book_id", "block_index", F.lit(0).cast("long").alias("s"), F.col("char_length").alias("e"))


def q13_range_contains(spark, sf_dir):
    """Half-open ranges that contain an anchor; an empty range contains its own place."""
    at = F.pmod(F.col("book_id") * 31, F.lit(60))
    return _ranges(spark, sf_dir).select("book_id", "block_index", F.when(F.col("s") == F.col("e"), at == F.col("s")).otherwise((F.col("s") <= at) & (at < F.col("e"))).alias("inside"))


def q14_range_overlap(spark, sf_dir):
    """Ranges of a node that overlap a selection."""
    a = F.pmod(F.col("book_id") * 17, F.lit(90))
    return _ranges(spark, sf_dir).where((F.col("s") < a + 10) & (a < F.col("e"))).select("book_id", "block_index")


QUERIES = {
    "q01_search": lambda s, d: search(blocks(s, d), "thing", 200),
    "q02_search_section": lambda s, d: search(blocks(s, d), "the", 200, book_id=7),
    "q03_match_ranges": lambda s, d: matches(blocks(s, d), "tion").select("book_id", "node", "cell", "start", "end"),
    "q04_excerpts": lambda s, d: matches(blocks(s, d), "shthe").select("book_id", "block_index", "cell", "start", "excerpt"),
    "q07_section_title": lambda s, d: section_titles(blocks(s, d)), "q08_shelf_filter": q08_shelf_filter, "q09_annotation_search": q09_annotation_search, "q10_suggestions": q10_suggestions,
    "q11_reference_token": q11_reference_token, "q12_commands": q12_commands, "q13_range_contains": q13_range_contains, "q14_range_overlap": q14_range_overlap,
    "q16_needs_vision": q16_needs_vision, "q17_page_index_toc": q17_page_index_toc, "q22_mapping_plausible": q22_mapping_plausible, "q23_placeholders": q23_placeholders,
}
ORACLE_SQL = {
    "q01_search": f'WITH {BLOCKS_SQL}, {_matches_sql("thing")} SELECT hits.*, title FROM hits JOIN titles USING (book_id) ORDER BY book_id, block_index, coalesce(cell, 0), start LIMIT 200',
    "q02_search_section": f'WITH {BLOCKS_SQL}, {_matches_sql("the")} SELECT hits.*, title FROM hits JOIN titles USING (book_id) WHERE book_id = 7 ORDER BY book_id, block_index, coalesce(cell, 0), start LIMIT 200',
    "q03_match_ranges": f'WITH {BLOCKS_SQL}, {_matches_sql("tion")} SELECT book_id, node, cell, start, "end" FROM hits',
    "q04_excerpts": f"WITH {BLOCKS_SQL}, {_matches_sql('shthe')} SELECT book_id, block_index, cell, start, excerpt FROM hits",
    "q07_section_title": f"WITH {BLOCKS_SQL} SELECT book_id, coalesce(min_by(text, block_index) FILTER (WHERE kind = 'heading'), 'Section ' || (book_id + 1)) AS title FROM blocks GROUP BY book_id",
    "q08_shelf_filter": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'brand#2')",
    "q09_annotation_search": "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id DESC, turn LIMIT 20",
    "q10_suggestions": "WITH s AS (SELECT p_partkey AS idx, (p_size % 3) * 12 + least(CASE WHEN instr(lower(p_name), 'ring') > 0 THEN strlen(left(lower(p_name), instr(lower(p_name), 'ring') - 1)) ELSE 80 END, 80) + least(instr(lower(p_name || ' ' || p_type || ' ' || p_brand), 'ring') - 1, 80) AS score FROM part WHERE instr(lower(p_name || ' ' || p_type || ' ' || p_brand), 'ring') > 0) SELECT idx, score FROM s ORDER BY score, idx LIMIT 8",
    "q11_reference_token": r"SELECT p_partkey, nullif(regexp_extract(p_type || (CASE WHEN p_size % 2 = 0 THEN ' @' ELSE '@' END) || p_name, '(?:^|[^\p{L}\p{N}_.@-])@([^\s@][^\n@]*)$', 1), '') AS token FROM part",
    "q12_commands": "SELECT event_id, len(list_filter(['/summary', '/search', '/rewrite', '/extract'], lambda n: starts_with(n, '/' || left(event_type, 1)))) AS n FROM events",
    "q13_range_contains": f"WITH {BLOCKS_SQL} SELECT book_id, block_index, CASE WHEN char_length = 0 THEN book_id * 31 % 60 = 0 ELSE book_id * 31 % 60 < char_length END AS inside FROM blocks",
    "q14_range_overlap": f"WITH {BLOCKS_SQL} SELECT book_id, block_index FROM blocks WHERE book_id * 17 % 90 < char_length",
    "q16_needs_vision": "SELECT page_id, contains(html, '<img') AND length(trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g'))) < 400 AS needs_vision FROM pages",
    "q17_page_index_toc": f"WITH {BLOCKS_SQL} SELECT book_id, count(*) >= 4 AND 3 * count(*) FILTER (WHERE regexp_full_match(split_part(text, ' ', 1), '[0-9０-９ivxlcdmIVXLCDM]+')) >= 2 * count(*) AS page_index FROM blocks GROUP BY book_id",
    "q22_mapping_plausible": "WITH e AS (SELECT user_id AS book_id, event_id AS ord, event_id % 977 AS page FROM events), l AS (SELECT *, page - lag(page) OVER (PARTITION BY book_id ORDER BY ord) AS step FROM e) SELECT book_id, count(*) < 4 OR (count(DISTINCT page) >= 3 AND min(step) >= 0) AS plausible FROM l GROUP BY book_id",
    "q23_placeholders": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '' WHEN event_id % 4 = 2 THEN '## 第 ' || event_id || ' 页' || chr(10) || chr(10) || '本页未识别到正文。 but more' || chr(10) ELSE props END AS markdown FROM events",
}
