"""From raw documents to token ids: filter, dedup twice, mix, encode.

``STAGES`` lists the stages in order. Each function takes ``(spark, docs, sf_dir)``; its
result is written as Parquet and read again as the ``docs`` of the next one. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe_codec import bpe_rows
from folioforge.llm.common import column, cut, dropping, free_name, read_table
from folioforge.llm.exact_dedup import exact_dedup
from folioforge.llm.mixing import mixed_documents
from folioforge.llm.quality_rules import quality_rules
from folioforge.llm.simhash import simhash_components


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a stable row number, which tells apart rows that repeat, and the name of its column."""
    row = free_name(docs, "_row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def _only(numbered: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``numbered`` whose number is in the column ``row`` of ``rows``."""
    return numbered.join(rows.select(F.col("row").alias(row)).hint("merge"), row, "left_semi").drop(row)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the base rules and go; a very long text is judged as a whole; repeated
    rows are judged alike; null ids are judged and may stay; extra columns of any name stay; an
    empty table stays empty.
    """
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    judged = quality_rules(docs, trusted)
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*[column(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id.

    Null counts as empty; of rows that repeat one stays; a null id never wins over a real one;
    very long texts are compared in full; extra columns stay; an empty table stays empty.
    """
    numbered, row = _numbered(docs)
    return _only(numbered, row, exact_dedup(numbered, keep="largest", row_col=row).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the row with the least id.

    Texts without words have one fingerprint and so are one component; a null id stays only where
    all ids of a component are null, and then one row does; of ties (one id, several rows) the first
    row of the table stays; extra columns stay; an empty table stays empty.
    """
    numbered, row = _numbered(docs)
    found = simhash_components(numbered, row_col=row)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return _only(numbered, row, first.select("first.row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where it takes a part, that part, and its ``n_chars``.

    Texts without words are never taken; a null source is a source of its own; null ids and repeated
    rows are documents like any other; a very long text may come whole, in part, or both; extra
    columns go along unchanged; an empty table stays empty.
    """
    mixed = mixed_documents(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*[column(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: all columns of the row, ``token_ids`` and ``decodes`` (underscores before a name that is taken).

    Null and empty texts have no ids; a very long unsplit text is encoded by tree concatenation;
    null ids, ties and repeated rows are encoded like any other; an empty table stays empty.
    """
    return bpe_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: Hashing, sampling without replacement and tokenising have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with dropping() as own:  # what a stage wrote for itself goes once its result is written
            docs = cut(stage(spark, before, sf_dir), f"pipeline-{name}")
            own.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
