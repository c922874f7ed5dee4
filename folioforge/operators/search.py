"""Literal full-text search over blocks, with positions and excerpts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import excerpt, match_spans


def literal_pattern(query: str) -> str:
    """A case-insensitive pattern for a literal query."""
    return "(?iu)" + re.sub(r"([^0-9A-Za-z\s])", r"\\\1", query.strip())


def searchable(blocks: DataFrame) -> DataFrame:
    """``book_id, block_index, cell, node, kind, text``: what is searched, each cell of a table apart; ``cell`` is null elsewhere."""
    cells = F.when(F.col("kind") == "table", F.split("text", r" \| ")).otherwise(F.array("text"))
    parts = blocks.select("book_id", "block_index", "node", "kind", F.posexplode(cells).alias("_at", "text"))
    return parts.select("book_id", "block_index", F.when(F.col("kind") == "table", F.col("_at").cast("long")).alias("cell"), "node", "kind", "text")


def section_titles(blocks: DataFrame) -> DataFrame:
    """``book_id, title``: the first heading of a section, else its number."""
    first = blocks.groupBy("book_id").agg(F.min_by("text", F.when(F.col("kind") == "heading", F.col("block_index"))).alias("_h"))
    return first.select("book_id", F.coalesce("_h", F.concat(F.lit("Section "), F.col("book_id") + 1)).alias("title"))


def matches(blocks: DataFrame, query: str, context: int = 72) -> DataFrame:
    """``book_id, block_index, cell, node, kind, start, end, matched, excerpt`` of every match; a blank query has none.

    The pattern is tested before positions are made, so blocks without matches cost one scan.
    """
    if not query.strip():
        blocks = blocks.where(F.lit(False))
    found = searchable(blocks).select("*", F.explode(match_spans(F.col("text"), literal_pattern(query or " "))).alias("m"))
    return found.select("book_id", "block_index", "cell", "node", "kind", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), F.col("m.matched").alias("matched"), excerpt(F.col("text"), F.col("m.start"), F.col("m.end"), context).alias("excerpt"))


def search(blocks: DataFrame, query: str, most: int = 200, book_id: int | None = None) -> DataFrame:
    """The first ``most`` matches in document order with their section's title, of one book or all.

    Titles are looked up for the matches that are left, so no more than ``most`` rows meet them.
    """
    if book_id is not None:
        blocks = blocks.where(F.col("book_id") == book_id)
    top = matches(blocks, query).orderBy("book_id", "block_index", F.coalesce("cell", F.lit(0)), "start").limit(max(0, most))
    return top.join(section_titles(blocks), "book_id", "left")


def suggestions(options: DataFrame, query: str, most: int = 8) -> DataFrame:
    """References that contain a query, by kind and by the byte at which it is found in label and text."""
    q = " ".join(query.split()).lower()
    byte_at = lambda text: F.when(F.instr(text, q) > 0, F.octet_length(F.left(text, F.instr(text, q) - 1)))
    label, whole = F.lower("label"), F.lower(F.concat_ws(" ", "label", "description", "excerpt"))
    scored = options.withColumn("score", F.col("kind_score") + F.least(F.coalesce(byte_at(label), F.lit(80)), F.lit(80)) + F.least(byte_at(whole), F.lit(80)))
    return scored.where("score IS NOT NULL").orderBy("score", "idx").limit(most)
