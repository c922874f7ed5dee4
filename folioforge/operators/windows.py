"""Sequence operators: as-of look-ups, budgets, islands, and scans that reset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.storage import kept


def last_entry_at(points: DataFrame, entries: DataFrame, key: str, point: str, start: str, order: str) -> DataFrame:
    """For each point of a key, the greatest ``order`` of the entries that start at or before it, as ``entry``.

    Points and entries are sorted together once by key and place; a running maximum replaces the
    range join, so work follows the rows and not their product.
    """
    both = points.select(key, F.col(point).alias("_at"), F.lit(1).alias("_is"), F.struct("*").alias("_p"), F.lit(None).cast("long").alias("_o"))
    both = both.unionByName(entries.select(key, F.col(start).alias("_at"), F.lit(0).alias("_is"), F.col(order).cast("long").alias("_o")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("entry", F.max("_o").over(w)).where("_is = 1").select("_p.*", "entry")


def budgeted(rows: DataFrame, key: list[str], order: list[str], length: str, budget: int) -> DataFrame:
    """Rows with ``keep``: how many signs of each are still in the key's budget."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length).over(w), F.lit(0))
    return rows.withColumn("keep", F.greatest(F.lit(0), F.least(F.col(length), budget - before)))


def merged_ranges(ranges: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching ranges of a key as one; a range without a start makes none of its own beside others.

    Equal ranges are peers in the sum's frame, so the order in which these come does not matter.
    """
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def greedy_groups(lengths: Column, most: int, most_rows: int | None = None, after: bool = False) -> Column:
    """Group numbers of a scan that opens a group before a member which would exceed ``most``.

    An over-long member is a group of its own. With ``most_rows`` a group has no more members; with
    ``after`` a group also closes once it has reached a budget. The sum starts anew with each group, which no
    window frame can say, so this is one pass over the ordered array of a document's lengths.
    """

    @F.pandas_udf("array<int>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: _greedy(a, most, most_rows, after))

    return run(lengths)


def _greedy(lengths, most: int, most_rows: int | None, after: bool) -> list[int]:
    out, group, total, rows, opens = [], -1, 0, 0, True
    for x in lengths.tolist():
        if opens or (rows and total + x > most) or (most_rows and rows >= most_rows):
            group, total, rows = group + 1, 0, 0
        total, rows = total + x, rows + 1
        opens = after and (total >= most or bool(most_rows) and rows >= most_rows)
        out.append(group)
    return out


def grouped(rows: DataFrame, key: str, order: str, length: str, most: int, most_rows: int | None = None, after: bool = False) -> DataFrame:
    """``key, order, group`` by ``greedy_groups`` over each key's rows; a key's rows are one document's."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, length))).alias("l"))
    numbers = lists.withColumn("g", greedy_groups(F.transform("l", lambda x: x[length].cast("long")), most, most_rows, after))
    return numbers.select(key, F.explode(F.arrays_zip("l", "g")).alias("z")).select(key, F.col(f"z.l.{order}").alias(order), F.col("z.g").cast("long").alias("group"))


def toc_depths(entries: Column) -> Column:
    """Depths of an ordered array of ``depth, page, numbered``: at most one below the depth given before.

    A numbered top entry on the page of an unnumbered top entry right before it becomes its child.
    """

    @F.pandas_udf("array<int>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(_nested)

    return run(F.transform(entries, lambda x: F.struct(x["depth"].cast("long").alias("depth"), x["page"].cast("long").alias("page"), x["numbered"].alias("numbered"))))


def _nested(entries) -> list[int]:
    out, before = [], None
    for x in entries:
        if before is None:
            depth = 0
        elif x["depth"] == 0 and out[-1] == 0 and x["page"] == before["page"] and x["numbered"] and not before["numbered"]:
            depth = 1
        else:
            depth = min(x["depth"], out[-1] + 1)
        out.append(depth)
        before = x
    return out


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place``, their number in ``order`` from 1, which no row may share.

    Rows are sorted over range partitions and kept there; a place is the row's number in its partition and the
    rows of all partitions before it. One number a partition is sent round, and no task sees all rows.
    """
    numbered = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = kept(numbered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND((1 << 33) - 1)), name)
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = sizes.select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return sorted_.join(F.broadcast(bases), "_part").withColumn("place", F.col("base") + F.col("_n") + 1).drop("_at", "_part", "_n", "base")
