"""Contents entries and the pages they are on: unique heading matches, corrections by a common shift."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keys_match(a: str, b: str) -> bool:
    """Equal keys, or one inside the other if both have four signs or more."""
    return a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a))


def unique_anchors(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """``page`` of top entries ``book_id, ord, key`` that match just one heading ``page, key`` of an unused page, else null.

    Entries are taken in order, and each takes its page from those after it, so a book is scanned as one group;
    its contents and headings are what a reader sees in a list.
    """
    h = headings.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page", "key"))).alias("h"))
    e = entries.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ord", "key"))).alias("e"))

    @F.pandas_udf("array<struct<ord:long,page:long>>")
    def run(entry_lists: pd.Series, heading_lists: pd.Series) -> pd.Series:
        def one(entries, headings) -> list[dict]:
            used, out = set(), []
            for x in entries:
                pages = [y["page"] for y in ([] if headings is None else headings) if x["key"] and y["page"] not in used and keys_match(x["key"], y["key"])]
                page = pages[0] if len(pages) == 1 else None
                used |= {page} - {None}
                out.append({"ord": x["ord"], "page": page})
            return out

        return pd.Series([one(a, b) for a, b in zip(entry_lists, heading_lists, strict=True)])

    return e.join(h, "book_id", "left").select("book_id", F.explode(run("e", "h")).alias("x")).select("book_id", "x.*")


def corrected_pages(entries: DataFrame) -> DataFrame:
    """``book_id, ord, page`` of entries ``book_id, ord, page, found, pages``: the page found, else the page moved by the common shift.

    The shift that most found pages have counts if it has two of them and half of all; of equally common ones the
    smallest, and of opposite ones the negative. A moved page must be in the book. Pages never fall: each is at
    least the one before it and at most the last.
    """
    shifts = entries.where("found IS NOT NULL").groupBy("book_id", (F.col("found") - F.col("page")).alias("d")).agg(F.count("*").alias("n"))
    best = shifts.groupBy("book_id").agg(F.max_by("d", F.struct("n", -F.abs("d"), -F.col("d"))).alias("d"), F.max("n").alias("n"), F.sum("n").alias("all"))
    joined = entries.join(best.where("n >= 2 AND 2 * n >= all").select("book_id", F.col("d").alias("_shift")), "book_id", "left")
    moved = F.col("page") + F.col("_shift")
    wanted = F.coalesce("found", F.when(moved.between(F.lit(1), F.col("pages")), moved), "page")
    w = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("book_id", "ord", F.greatest(F.lit(1), F.max(F.least(wanted, "pages")).over(w)).cast("long").alias("page"))
