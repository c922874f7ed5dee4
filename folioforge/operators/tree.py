"""Trees kept as adjacency tables: flattening, nesting, subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.storage import kept

def flattened(toc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``id, label, path, depth, ancestors, has_children`` of an adjacency table ``id, parent, ord, label``.

    ``path`` numbers the siblings of each level, joined by slashes. Every entry knows its way to an ancestor,
    first its parent; each round joins the ancestor's own way to it, which doubles its length. So a tree of depth d
    takes log d rounds, each written before the next. A circle of parents is an error; entries whose
    parent is missing are no part of the tree.
    """
    keys = keys or []
    w = Window.partitionBy(*keys, "parent").orderBy("ord", "id")
    parents = toc.where("parent IS NOT NULL").select(*keys, F.col("parent").alias("id")).distinct().withColumn("has_children", F.lit(True))
    rows = toc.withColumn("_n", (F.row_number().over(w) - 1).cast("string")).join(parents, [*keys, "id"], "left")
    rows = rows.select(*keys, "id", "label", F.coalesce("has_children", F.lit(False)).alias("has_children"), F.array("_n").alias("_way"), F.col("parent").alias("_up"))
    while True:
        rows = kept(rows, "tree-ways")
        n, longest, open_ = rows.agg(F.count("*"), F.max(F.size("_way")), F.count_if(F.col("_up").isNotNull())).first()
        if not open_:
            break
        if longest > n:  # a way has no more steps than there are entries
            raise ValueError("the parents of a tree go in a circle")
        above = rows.select(*keys, F.col("id").alias("_up"), F.col("_way").alias("_above"), F.col("_up").alias("_next"))
        rows = rows.where("_up IS NULL").unionByName(
            rows.where("_up IS NOT NULL").join(above, [*keys, "_up"]).select(*keys, "id", "label", "has_children", F.concat("_above", "_way").alias("_way"), F.col("_next").alias("_up"))
        )
    ancestors = F.transform(F.filter(F.sequence(F.lit(1), F.size("_way")), lambda k: k < F.size("_way")), lambda k: F.array_join(F.slice("_way", F.lit(1), k), "/"))
    return rows.select(*keys, "id", "label", F.array_join("_way", "/").alias("path"), (F.size("_way") - 1).cast("long").alias("depth"), ancestors.alias("ancestors"), "has_children")


def parents_from_depths(rows: DataFrame, key: str, order: str, depth: str) -> DataFrame:
    """``parent``: the order of the last earlier row of a list whose depth is one less.

    Each row is offered to the depth below it: sorted together by that depth, the last offer before a row is its parent.
    """
    offers = rows.select(F.col(key), (F.col(depth) + 1).alias("_d"), F.col(order).alias("_o"), F.lit(0).alias("_is"), F.col(order).alias("_parent"))
    asks = rows.select(F.col(key), F.col(depth).alias("_d"), F.col(order).alias("_o"), F.lit(1).alias("_is"), F.struct("*").alias("_r"))
    w = Window.partitionBy(key, "_d").orderBy("_o", F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
    both = asks.unionByName(offers, allowMissingColumns=True).withColumn("parent", F.last("_parent", True).over(w))
    return both.where("_is = 1").select("_r.*", "parent")


def top_groups(rows: DataFrame, key: str, order: str, depth: str) -> DataFrame:
    """``group``: the number of top rows up to each row, so rows below a top row share its number."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group", F.sum((F.col(depth) == 0).cast("long")).over(w))


def surviving(flat: DataFrame, resolved: Column) -> DataFrame:
    """Rows of a flattened tree that can be resolved, and those above them, which stay for their children's sake."""
    marked = flat.withColumn("_ok", F.coalesce(resolved, F.lit(False)))
    above = marked.where("_ok").select(F.explode("ancestors").alias("path")).distinct()
    return marked.join(above.withColumn("_above", F.lit(True)), "path", "left").where("_ok OR _above").select(*flat.columns, F.col("_ok").alias("resolved"))
