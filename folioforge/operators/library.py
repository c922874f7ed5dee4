"""The library as tables that are written: imports, removals, upserts, conditional writes, archives, sidecars.

Every function takes a ``storage.Versions`` and writes its next version; doing the same again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.sources.books import MOST_ENTRIES, MOST_TOTAL, Archive
from folioforge.sources.writers import zipped
from folioforge.storage import Versions, kept

#: Roles that a page may have (fixed values).
ROLES = ("cover", "title", "copyright", "toc", "blank", "back_cover")


def upsert(table: Versions, rows: DataFrame, key: list[str], order: Column | None = None) -> int:
    """Rows in place of those with their key; of several new ones the greatest by ``order`` stays."""
    own = rows.columns
    fresh = rows if order is None else rows.groupBy(*key).agg(F.max_by(F.struct(*own), order).alias("_r")).select("_r.*")
    before = table.current()
    if before is not None:
        fresh = before.select(*own).join(fresh.select(*key), key, "left_anti").select(*own).unionByName(fresh)
    return table.write(fresh)


def remove(table: Versions, keys: DataFrame, key: list[str]) -> int:
    """The table without the rows of ``keys``; nothing is written where there is nothing to remove."""
    before = table.current()
    if before is None or before.join(keys, key, "left_semi").isEmpty():
        return table.number()
    return table.write(before.join(keys, key, "left_anti"))


def import_files(table: Versions, files: DataFrame) -> tuple[int, int]:
    """Books ``id, title, path, size`` of files ``path, content`` by content; returns how many were new and how many known."""
    hashed = kept(files.select(F.sha2("content", 256).alias("id"), X.title_of_file(F.col("path")).alias("title"), "path", F.octet_length("content").cast("long").alias("size")), "import")
    books = hashed.groupBy("id").agg(F.min_by(F.struct("title", "path", "size"), "path").alias("b")).select("id", "b.*")
    before = table.current()
    fresh = kept(books if before is None else books.join(before.select("id"), "id", "left_anti"), "import-new")
    imported = fresh.count()
    if imported or before is None:
        table.write(fresh if before is None else before.unionByName(fresh))
    return imported, hashed.count() - imported


def import_remote(table: Versions, remote: DataFrame) -> int:
    """Remote books ``id, title, authors, file_name, sha, content`` whose id is the digest of their content and of their manifest.

    A blank title is that of the file.
    """
    good = (F.length("id") == 64) & F.regexp_like("id", F.lit("^[0-9a-f]+$")) & (F.col("id") == F.col("sha")) & (F.sha2("content", 256) == F.col("id"))
    books = remote.where(good).select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), X.title_of_file(F.col("file_name"))).alias("title"), F.filter("authors", lambda a: F.trim(a) != "").alias("authors"))
    first = books.groupBy("id").agg(F.min(F.struct("title", "authors")).alias("b")).select("id", "b.*")
    before = table.current()
    return table.write(first if before is None else before.unionByName(first.join(before.select("id"), "id", "left_anti")))


def tidy_authors(authors: Column) -> Column:
    """Names trimmed, blanks gone, a name once where it follows itself."""
    names = F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != "")
    return X.let(names, lambda n: F.filter(n, lambda a, i: (i == 0) | (a != F.get(n, i - 1))))


def update_metadata(table: Versions, changes: DataFrame) -> int:
    """New ``title, authors`` of books by ``id``; a blank title changes nothing, and without any change nothing is written."""
    before = table.current()
    new = changes.select("id", F.trim("title").alias("_t"), tidy_authors(F.col("authors")).alias("_a"))
    joined = before.join(new, "id", "left").withColumn("_c", F.coalesce((F.col("_t") != "") & ((F.col("_t") != F.col("title")) | (F.col("_a") != F.col("authors"))), F.lit(False)))
    if joined.where("_c").isEmpty():
        return table.number()
    pick = lambda new, old: F.when(F.col("_c"), F.col(new)).otherwise(F.col(old)).alias(old)
    return table.write(joined.select(*[pick("_t", c) if c == "title" else pick("_a", c) if c == "authors" else F.col(c) for c in before.columns]))


def bumped(clock: Column, device: str) -> Column:
    """A vector clock one tick further on a device."""
    return F.map_concat(F.map_filter(clock, lambda k, v: k != device), F.create_map(F.lit(device), F.coalesce(F.element_at(clock, F.lit(device)), F.lit(0).cast("long")) + 1))


def change_annotations(table: Versions, ids: DataFrame, device: str, wall: int, note: Column | None = None) -> int:
    """Delete annotations by ``id``, or give them a ``note``: the clock ticks, a deleted row stays as a tombstone."""
    before = table.current().join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("deleted")
    new = {"clock": bumped(F.col("clock"), device), "wall": F.lit(wall).cast("long"), **({"deleted": F.lit(True)} if note is None else {"note": note})}
    columns = [c for c in before.columns if c != "_hit"]
    return table.write(before.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns]))


def put_if_absent(table: Versions, rows: DataFrame, key: list[str], order: Column) -> int:
    """Rows whose key is new; of several the first by ``order``. What is there is never written over."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
    before = table.current()
    return table.write(first if before is None else before.unionByName(first.join(before.select(*key), key, "left_anti")))


def swap_all(writes: DataFrame, key: str, order: str, seen: str) -> DataFrame:
    """``accepted``: whether a conditional write saw the version that was there, for writes in order.

    Each write names the version it ``seen``; an accepted one makes the next version. Versions only grow, so a
    write is accepted just when its version is that of its predecessors' count of accepted ones.
    """

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        version, out = 0, []
        for x in group[seen].tolist():
            out.append(x == version)
            version += x == version
        return group.assign(accepted=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in writes.schema.fields)
    return writes.groupBy(key).applyInPandas(scan, f"{schema}, accepted boolean")


def uploads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``id, action`` of local books ``id, size`` against remote ones: upload what is missing, skip what is equal, a conflict of sizes is an error."""
    r = remote.select("id", F.col("size").alias("_there"))
    return local.join(r, "id", "left").select("id", F.when(F.col("_there").isNull(), "upload").when(F.col("_there") == F.col("size"), "skip").otherwise("error").alias("action"))


def resumed(downloads: DataFrame) -> DataFrame:
    """Downloads ``id, expected, size, partial, whole`` gone on with: ``id, resumed_from, accepted``.

    What is there counts if it is not longer than the book; the whole must have the expected digest.
    """
    have = F.octet_length("partial")
    start = F.when(have <= F.col("size"), have).otherwise(0)
    made = F.concat(F.substring("partial", F.lit(1), start), F.substring("whole", start + 1, F.octet_length("whole")))
    return downloads.select("id", start.cast("long").alias("resumed_from"), (F.sha2(made, 256) == F.col("expected")).alias("accepted"))


def packed_pages(pages: DataFrame) -> DataFrame:
    """An archive of each book's pages ``book_id, page, markdown``, within the budgets."""

    def pack(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("page")
        data = [(f"pages/{p:06d}.md", m.encode()) for p, m in zip(book["page"], book["markdown"], strict=True)]
        if len(data) > MOST_ENTRIES or sum(len(d) for _, d in data) > MOST_TOTAL:
            raise ValueError("the pages are over the budget of an archive")
        return pd.DataFrame({"book_id": [book["book_id"].iloc[0]], "content": [zipped(data)]})

    return pages.groupBy("book_id").applyInPandas(pack, "book_id long, content binary")


def unpacked_pages(archives: DataFrame) -> DataFrame:
    """The pages of archives, none of an archive that is over its budgets or damaged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, data in zip(frame["book_id"], frame["content"], strict=True):
                archive = Archive(bytes(data))
                rows += [(book, int(n[6:-3]), archive.read(n).decode()) for n in archive.names if n.startswith("pages/") and n.endswith(".md")]
            yield pd.DataFrame(rows, columns=["book_id", "page", "markdown"])

    return archives.mapInPandas(run, "book_id long, page long, markdown string")


def valid_contents(entries: DataFrame) -> DataFrame:
    """The generated contents ``book_id, ord, title, page, depth`` of books all of whose entries have a title and a page, and nest."""
    w = Window.partitionBy("book_id").orderBy("ord")
    good = (F.trim("title") != "") & (F.col("page") >= 1) & (F.col("depth") >= 0) & (F.col("depth") <= F.coalesce(F.lag("depth").over(w) + 1, F.lit(0)))
    judged = entries.withColumn("_good", F.coalesce(good, F.lit(False)))
    bad = judged.where("NOT _good").select("book_id").distinct()
    return judged.join(bad, "book_id", "left_anti").drop("_good")


def valid_roles(roles: DataFrame) -> DataFrame:
    """The first known role of each page ``book_id, page, role``; pages count from 0."""
    known = roles.where(F.col("role").isin(*ROLES) & (F.col("page") >= 0))
    return known.groupBy("book_id", "page").agg(F.min_by("role", "ord").alias("role"))
