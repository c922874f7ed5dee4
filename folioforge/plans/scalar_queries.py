"""Queries of the scalar functions, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.sources.tables import BLOCKS_SQL, blocks, table

QUERIES, ORACLE_SQL = {}, {}


def _put(name: str, source: str, key: str, column, sql: str) -> None:
    """Register ``SELECT key, column AS out`` over ``source`` (a table or ``blocks``)."""

    def query(spark, sf_dir):
        df = blocks(spark, sf_dir) if source == "blocks" else table(spark, sf_dir, source)
        return df.select(*key.split(","), column().alias("out"))

    QUERIES[name] = query
    ORACLE_SQL[name] = (f"WITH {BLOCKS_SQL} " if source == "blocks" else "") + f"SELECT {key}, {sql} AS out FROM {source}"


_PLAIN = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')"
_REST = f"regexp_replace({_PLAIN}, '^[0-9０-９]+', '')"
_BLOCK = "book_id,block_index"
_put("c02_fragment", "pages", "page_id", lambda: X.url_fragment(F.col("url")), "CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END")
_put("c02_resource_path", "pages", "page_id", lambda: X.resource_path(F.col("url")), "regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '^/+', '')")
_put("c03_heading_key", "blocks", _BLOCK, lambda: X.heading_key(F.col("text")), f"CASE WHEN {_REST} <> '' THEN {_REST} ELSE {_PLAIN} END")
_put("c05_whitespace", "documents", "doc_id", lambda: X.collapsed(F.col("text")), "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
_put("c06_clip", "documents", "doc_id", lambda: X.clipped(F.col("text"), 220), "CASE WHEN length(text) <= 220 THEN text ELSE left(text, 220) || '...' END")
_put("c07_list_marker", "blocks", _BLOCK, lambda: X.list_marker(F.col("text")), "nullif(regexp_extract(text || ' ', '^\\s*([•·●○▪‣◦∙]|[-*+]\\s|[0-9A-Za-z]{1,6}[.、)）]\\s)', 1).trim(), '')")
_put("c14_entity_decode", "pages", "page_id", lambda: X.entities_decoded(F.col("html")), "replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')")
_put("c14_xml_escape", "pages", "page_id", lambda: X.xml_escaped(F.col("html")), "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
_put("c15_strip_markup", "pages", "page_id", lambda: X.without_markup(F.col("html")), "replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')")
_put("c15_document_title", "pages", "page_id", lambda: F.trim(X.entities_decoded(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))), "trim(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'))")
_put("c16_title_of_file", "part", "p_partkey", lambda: X.title_of_file(F.concat("p_type", F.lit("/"), "p_name", F.lit(".v1.epub"))), "p_name || '.v1'")
_put("c17_media_type", "part", "p_partkey", lambda: F.expr("CASE element_at(split(concat(p_name, CASE p_size % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.svg' ELSE '.xyz' END), '[.]'), -1) WHEN 'png' THEN 'image/png' WHEN 'JPG' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END"), "CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/svg+xml' ELSE 'application/octet-stream' END")
_put("c18_newer_version", "part", "p_partkey", lambda: X.version(F.concat_ws(".", F.col("p_size").cast("string"), F.pmod("p_partkey", F.lit(10)).cast("string"), F.lit("7"))) > X.version(F.lit("25.5.7")), "p_size > 25 OR (p_size = 25 AND p_partkey % 10 > 5)")
_put("c19_sha256", "documents", "doc_id", lambda: F.sha2("text", 256), "sha256(text)")
_put("c21_language_choice", "documents", "doc_id", lambda: F.when(F.startswith(F.lower("lang"), F.lit("zh")), "chinese").otherwise("english"), "CASE WHEN starts_with(lower(lang), 'zh') THEN 'chinese' ELSE 'english' END")
_put("c22_replacement_lines", "documents", "doc_id", lambda: F.size(F.split("text", "\n")).cast("long"), "len(string_split(text, chr(10)))")
_put("c23_byte_offset", "documents", "doc_id", lambda: X.byte_offset(F.col("text"), F.lit(40)), "strlen(left(text, 40))")
_put("c24_scale_up", "blocks", _BLOCK, lambda: X.scaled_offset(F.col("block_index"), F.col("char_length"), F.col("char_length") * 2 + 1, True), "(block_index * (char_length * 2 + 1) + char_length - 1) // char_length")
_put("c24_scale_down", "blocks", _BLOCK, lambda: X.scaled_offset(F.col("block_index"), F.col("char_length"), F.col("char_length") * 2 + 1, False), "(block_index * (char_length * 2 + 1)) // char_length")
_put("c27_reference_label", "blocks", _BLOCK, lambda: X.clipped(X.collapsed(F.col("text")), 32), "CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 32 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 32) || '...' END")
_put("c28_read_argument", "events", "event_id", lambda: F.coalesce(F.when(F.get_json_object("props", "$.k").cast("long") >= 0, F.get_json_object("props", "$.k").cast("long")), F.lit(20)), "coalesce(CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END, 20)")
_put("c30_safe_name", "pages", "page_id", lambda: X.safe_name(X.resource_path(F.col("url"))), "(SELECT p <> '' AND NOT starts_with(p, '/') AND NOT contains(p, ':') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 FROM (SELECT replace(regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '^/+', ''), '\\', '/') AS p))")
_put("c10_citation_link", "blocks", _BLOCK, lambda: F.concat(F.lit("book://section/"), F.col("book_id"), F.lit("#"), F.col("node")), "'book://section/' || book_id || '#' || node")
_put("w09_terminal", "blocks", _BLOCK, lambda: F.regexp_like(F.rtrim("text"), F.lit("[.!?。！？…‥]$")), "regexp_matches(rtrim(text), '[.!?。！？…‥]$')")
_put("q05_kind_label", "blocks", _BLOCK, lambda: F.expr("CASE kind WHEN 'table' THEN 'table-cell' ELSE kind END"), "CASE kind WHEN 'table' THEN 'table-cell' ELSE kind END")
_put("q19_translatable", "blocks", _BLOCK, lambda: F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 2, "length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 2")
_put("g14_writing_system", "documents", "doc_id", lambda: X.writing_system(F.col("lang"), F.col("text")), "CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN 'latin' END")
_put("q18_role_plausible", "pages", "page_id", lambda: F.expr("CASE page_id % 3 WHEN 0 THEN page_id + 1 = 1 WHEN 1 THEN page_id + 1 <= 20 ELSE page_id + 1 > 250 - 8 END"), "CASE page_id % 3 WHEN 0 THEN page_id + 1 = 1 WHEN 1 THEN page_id + 1 <= 20 ELSE page_id + 1 > 250 - 8 END")
_put("q20_locator_valid", "events", "event_id", lambda: ~F.isnan("value") & (F.col("value") / 40 >= 0) & (F.col("value") / 40 <= 1), "NOT isnan(value) AND value / 40 >= 0 AND value / 40 <= 1")
_put("q21_hash_id_valid", "documents", "doc_id", lambda: F.regexp_like(F.when(F.pmod("doc_id", F.lit(3)) == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)), F.lit("^[0-9a-f]{64}$")), "regexp_full_match(CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)) ELSE sha256(text) END, '[0-9a-f]{64}')")
