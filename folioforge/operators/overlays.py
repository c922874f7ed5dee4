"""Views over a book's blocks that stack: rewrites, translations, sentences, contents, and the switch of what is shown.

A view takes blocks ``book_id, block_index, node, kind, text`` and gives blocks of the same columns, so views compose
in any order and Catalyst sees one plan.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.sentences import sentence_atoms

COLUMNS = ("book_id", "block_index", "node", "kind", "text")


class BlockSource(Protocol):
    """What a source of books offers: its sections' blocks, its contents, and its resources."""

    def blocks(self) -> DataFrame:
        """``book_id, block_index, node, kind, text``."""

    def contents(self) -> DataFrame:
        """``book_id, ord, label, depth, block_index``."""

    def resources(self) -> DataFrame:
        """``book_id, path, content``."""


def rewritten(blocks: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Blocks with the last rewrite ``book_id, node, ord, replacement`` of their node; a blank one changes nothing."""
    last = rewrites.where(F.trim("replacement") != "").groupBy("book_id", "node").agg(F.max_by("replacement", "ord").alias("_new"))
    return blocks.join(last, ["book_id", "node"], "left").select(*[F.coalesce("_new", "text").alias(c) if c == "text" else F.col(c) for c in COLUMNS])


def translated(blocks: DataFrame, translations: DataFrame, bilingual: bool = False) -> DataFrame:
    """Blocks with their translation ``book_id, node, translation`` in place, or below them with ``bilingual``."""
    own = translations.select("book_id", "node", F.trim("translation").alias("_new")).where("_new <> ''").dropDuplicates(["book_id", "node"])
    both = F.concat("text", F.lit("\n"), "_new") if bilingual else F.col("_new")
    return blocks.join(own, ["book_id", "node"], "left").select(*[F.coalesce(both, "text").alias(c) if c == "text" else F.col(c) for c in COLUMNS])


def by_sentence(blocks: DataFrame) -> DataFrame:
    """A block for each sentence of a paragraph, its node the paragraph's with the sentence's start; other blocks stay."""
    paragraphs = blocks.where("kind = 'paragraph'").select(*COLUMNS, F.explode(sentence_atoms("text")).alias("_a"))
    parts = paragraphs.select("book_id", "block_index", F.concat("node", F.lit("@"), F.col("_a.start").cast("string")).alias("node"), "kind", F.col("_a.text").alias("text"))
    return blocks.where("kind <> 'paragraph'").select(*COLUMNS).unionByName(parts)


def with_contents(own: DataFrame, generated: DataFrame) -> DataFrame:
    """The contents ``book_id, ord, label, depth`` of books; generated ones take the place of a book's own."""
    return generated.unionByName(own.join(generated.select("book_id").distinct(), "book_id", "left_anti"))


def shown(original: DataFrame, reflowed: DataFrame, modes: DataFrame) -> DataFrame:
    """The original or reflowed blocks of each book by its ``mode``; books without one show the original."""
    reflow = modes.where("mode = 'reflow'").select("book_id").distinct()
    return original.join(reflow, "book_id", "left_anti").select(*COLUMNS).unionByName(reflowed.join(reflow, "book_id", "left_semi").select(*COLUMNS))


def undone(log: DataFrame, transaction: int) -> DataFrame:
    """Rewrites ``book_id, node, ord, replacement, transaction`` as they were before a transaction: it and later ones undone."""
    return log.where(F.col("transaction") < transaction)
