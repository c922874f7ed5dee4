"""The query interface for programs: named tools with typed arguments, each a view of blocks or contents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.search import matches


@dataclass(frozen=True)
class Tool:
    """A tool: what it does, its arguments as ``name: (default, least, most)``, and its function of blocks and arguments."""

    about: str
    arguments: dict[str, tuple]
    run: Callable[..., DataFrame]


def _units(blocks: DataFrame, start: int, count: int) -> DataFrame:
    return blocks.where(F.col("block_index").between(start, start + count - 1)).select("book_id", "block_index", "text")


def _contents(blocks: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("block_index")
    return blocks.where("kind = 'heading'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("book_id", "block_index", "text")


def _search(blocks: DataFrame, query: str, limit: int) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("block_index", "start")
    return matches(blocks, query).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("book_id", "block_index", F.col("excerpt").alias("text"))


def _around(blocks: DataFrame, at: int, before: int, after: int) -> DataFrame:
    return blocks.where(F.col("block_index").between(at - before, at + after)).select("book_id", "block_index", "text")


TOOLS: dict[str, Tool] = {
    "read_units": Tool("Blocks of a range", {"start": (0, 0, None), "count": (1, 1, 20)}, _units),
    "contents": Tool("Headings, at most so many", {"limit": (80, 1, 200)}, _contents),
    "search": Tool("Matches of a literal query with their surroundings", {"query": ("", None, None), "limit": (10, 1, 20)}, _search),
    "context": Tool("Blocks around a place", {"at": (0, 0, None), "before": (1, 0, 20), "after": (1, 0, 20)}, _around),
}


def called(blocks: DataFrame, name: str, arguments: dict) -> DataFrame:
    """The result of a tool; arguments that are absent or of another type take their default, numbers are clamped."""
    tool, given = TOOLS[name], {}
    for key, (default, least, most) in tool.arguments.items():
        value = arguments.get(key, default)
        if type(value) is not type(default) or (isinstance(value, int) and value < 0):
            value = default
        if isinstance(value, int):
            value = max(value, least) if least is not None else value
            value = min(value, most) if most is not None else value
        given[key] = value
    return tool.run(blocks, **given)
