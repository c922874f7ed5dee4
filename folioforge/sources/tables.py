"""The engine's input tables, and the block, annotation and contents tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; timestamps without zone stay as they are."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(text: Column) -> Column:
    """The kind of a plain-text block: cells, short headings, else paragraphs."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.length(text) <= 24, "heading").otherwise("paragraph")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, block_index, node, kind, text, char_length`` of the documents' non-blank lines.

    Lines are numbered inside their row by a generator, so no shuffle is needed.
    """
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    out = docs.select(F.col("doc_id").alias("book_id"), F.posexplode(lines).alias("block_index", "text"))
    return out.select("book_id", F.col("block_index").cast("long").alias("block_index"), F.concat(F.lit("n"), "block_index").alias("node"), kind_of(F.col("text")).alias("kind"), "text", F.length("text").cast("long").alias("char_length"))


#: DuckDB's equivalent, as a common table expression.
BLOCKS_SQL = """blocks AS (
    SELECT book_id, block_index, 'n' || block_index AS node,
           CASE WHEN contains(text, ' | ') THEN 'table' WHEN length(text) <= 24 THEN 'heading' ELSE 'paragraph' END AS kind,
           text, length(text) AS char_length
    FROM (SELECT doc_id AS book_id, unnest(l) AS text, unnest(range(len(l))) AS block_index
          FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL)))"""


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, book_id, device, wall, counter, progression`` of the events, as reading positions."""
    e = table(spark, sf_dir, "events")
    wall = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.col("user_id").alias("book_id"), F.col("event_type").alias("device"), wall.alias("wall"),
        F.pmod("event_id", F.lit(8)).cast("long").alias("counter"), (F.col("value") / (1 + F.col("value"))).alias("progression"),
    )


PROGRESS_SQL = """progress AS (
    SELECT event_id, user_id AS book_id, event_type AS device, epoch_us(ts) // 1000 AS wall,
           event_id % 8 AS counter, value / (1 + value) AS progression FROM events)"""


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level table of contents, as an adjacency table: regions above nations."""
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("label"))
    low = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("label"))
    return top.union(low)


TOC_SQL = """toc AS (
    SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_regionkey::BIGINT AS ord, r_name AS label FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::BIGINT, n_name FROM nation)"""
