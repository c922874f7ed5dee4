"""Queries that write: each makes a folder of its own, does its writes, some of them twice, and reads what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import library as L
from folioforge.sources.tables import BLOCKS_SQL, blocks, table
from folioforge.storage import VersionConflict, Versions, new_folder

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _new(spark, name: str) -> Versions:
    return Versions(spark, new_folder(spark, name))


@_query("k01_atomic_write", "SELECT event_id, props FROM events")
def k01(spark, sf_dir):
    """A version that was never finished is not seen, and the next write takes its place."""
    t, e = _new(spark, "k01"), table(spark, sf_dir, "events").select("event_id", "props")
    t.write(e.where("event_id % 2 = 0"))
    e.withColumn("props", F.lit("half")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/v=2")
    seen = t.current()
    t.write(seen.unionByName(e.where("event_id % 2 <> 0")))
    return t.current()


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")


@_query("k02_import", "WITH h AS (SELECT doc_id, sha256(text) AS id FROM documents WHERE text IS NOT NULL), a AS (SELECT * FROM h WHERE doc_id % 2 = 0), n AS (SELECT count(DISTINCT id) AS first, (SELECT count(*) FROM a) AS all_a FROM a) SELECT 1 AS run, first AS imported, all_a - first AS duplicates FROM n UNION ALL SELECT 2, (SELECT count(DISTINCT id) FROM h) - first, (SELECT count(*) FROM h) - (SELECT count(DISTINCT id) FROM h) + first FROM n UNION ALL SELECT 3, 0, (SELECT count(*) FROM h) FROM n")
def k02(spark, sf_dir):
    """Three imports, of half the files, of all, and of all again: what is new, what is known."""
    t, f = _new(spark, "k02"), _files(spark, sf_dir)
    runs = [L.import_files(t, x) for x in (f.where("doc_id % 2 = 0"), f, f)]
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(runs)], "run int, imported long, duplicates long")


@_query("k03_remote_import", """SELECT sha256(text) AS id, min(CASE WHEN doc_id % 3 = 0 THEN 'book ' || doc_id ELSE 'Title ' || doc_id END) AS title FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 1 AND doc_id % 4 <> 2 GROUP BY 1""")
def k03(spark, sf_dir):
    """Remote books with a right digest; a blank title is that of the file; importing again adds none."""
    d, sha = table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.sha2("text", 256)
    kind, number = F.pmod("doc_id", F.lit(4)), F.col("doc_id").cast("string")
    remote = d.select(
        F.when(kind == 1, F.upper(sha)).otherwise(sha).alias("id"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "  ").otherwise(F.concat(F.lit(" Title "), number)).alias("title"), F.array(F.lit("a"), F.lit(" ")).alias("authors"),
        F.concat(F.lit("x/book "), number, F.lit(".epub")).alias("file_name"), sha.alias("sha"), F.when(kind == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"),
    )
    t = _new(spark, "k03")
    L.import_remote(t, remote)
    L.import_remote(t, remote)
    return t.current().select("id", "title")


@_query("k04_remove", "SELECT p_partkey AS id, 3 AS version FROM part WHERE p_size % 5 > 1")
def k04(spark, sf_dir):
    """Books removed twice over; the last removal finds nothing and writes nothing."""
    t, p = _new(spark, "k04"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    t.write(p)
    for k in (0, 1, 1):
        L.remove(t, p.where(F.pmod("p_size", F.lit(5)) == k).select("id"), ["id"])
    return t.current().select("id", F.lit(t.number()).alias("version"))


@_query("k05_metadata", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS title, CASE WHEN p_size % 3 = 0 THEN [p_brand] WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand, p_type] END AS authors, 2 AS version FROM part")
def k05(spark, sf_dir):
    """Titles and authors changed, blank titles left alone, authors tidied; the same change again writes nothing."""
    t, p = _new(spark, "k05"), table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    t.write(p.select("id", F.col("p_name").alias("title"), F.array("p_brand").alias("authors")))
    changes = p.select("id", F.when(F.pmod("p_size", F.lit(3)) == 0, " ").otherwise(F.concat(F.lit(" "), "p_type")).alias("title"), F.array(F.concat(F.lit(" "), "p_type"), F.col("p_type"), F.lit("  "), F.col("p_brand"), F.concat("p_brand", F.lit(" ")), F.col("p_type")).alias("authors"))
    L.update_metadata(t, changes)
    L.update_metadata(t, changes)
    return t.current().select("id", "title", "authors", F.lit(t.number()).alias("version"))


@_query("k06_upsert_progress", "SELECT user_id AS book_id, coalesce(arg_max(value, event_id) FILTER (WHERE event_id % 2 = 1), arg_max(value, event_id)) AS value FROM events GROUP BY user_id")
def k06(spark, sf_dir):
    """Two batches of positions, the second in place of the first; the second again changes nothing."""
    t, e = _new(spark, "k06"), table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), "value", "event_id")
    for half in (0, 1, 1):
        L.upsert(t, e.where(F.pmod("event_id", F.lit(2)) == half), ["book_id"], F.col("event_id"))
    return t.current().select("book_id", "value")


def _annotations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat("user_id", F.lit("/"), "event_type").alias("id"), F.col("event_type").alias("device"), F.create_map("event_type", F.lit(1).cast("long")).alias("clock"), F.lit(0).cast("long").alias("wall"), F.lit(False).alias("deleted"), F.col("props").alias("note"), "event_id")


@_query("k07_upsert_annotation", "SELECT user_id || '/' || event_type AS id, max_by(props, event_id) AS note, max(event_id) AS event_id FROM events GROUP BY ALL")
def k07(spark, sf_dir):
    """Annotations written batch by batch, each key's last version."""
    t, a = _new(spark, "k07"), _annotations(spark, sf_dir)
    bound = a.agg(F.max("event_id")).first()[0] or 0
    for k in range(3):
        L.upsert(t, a.where((F.col("event_id") * 3 >= k * bound) & (F.col("event_id") * 3 < (k + 1) * bound + 3 * (k == 2))), ["id"], F.col("event_id"))
    return t.current().select("id", "note", "event_id")


@_query("k08_soft_delete", "SELECT DISTINCT user_id || '/' || event_type AS id, event_type = 'error' AS deleted, CASE WHEN event_type = 'error' THEN 7 ELSE 0 END AS wall, coalesce(CASE WHEN event_type = 'error' THEN 1 END, 0) AS ticks FROM events")
def k08(spark, sf_dir):
    """Annotations deleted on one device: tombstones with a tick of its clock; deleting again does not tick."""
    t, a = _new(spark, "k08"), _annotations(spark, sf_dir)
    L.upsert(t, a, ["id"], F.col("event_id"))
    for _ in range(2):
        L.change_annotations(t, a.where("device = 'error'"), "phone", 7)
    return t.current().select("id", "deleted", "wall", F.coalesce(F.element_at("clock", F.lit("phone")), F.lit(0)).alias("ticks"))


@_query("k09_update_note", "SELECT DISTINCT user_id || '/' || event_type AS id, CASE WHEN event_type = 'view' THEN 'note ' || user_id || '/view' END AS new_note, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 2 ELSE 0 END AS ticks FROM events")
def k09(spark, sf_dir):
    """Notes changed twice on one device, deleted ones not at all."""
    t, a = _new(spark, "k09"), _annotations(spark, sf_dir)
    L.upsert(t, a, ["id"], F.col("event_id"))
    L.change_annotations(t, a.where("device = 'click'"), "phone", 7)
    for _ in range(2):
        L.change_annotations(t, a.where("device IN ('click', 'view')"), "phone", 8, F.concat(F.lit("note "), "id"))
    return t.current().select("id", F.when(F.startswith("note", F.lit("note ")), F.col("note")).alias("new_note"), F.coalesce(F.element_at("clock", F.lit("phone")), F.lit(0)).alias("ticks"))


@_query("k10_put_if_absent", "SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_id % 2 = 1), min(event_id)) AS event_id FROM events GROUP BY user_id")
def k10(spark, sf_dir):
    """Of writes to one place the first stays, in a batch and over batches."""
    t, e = _new(spark, "k10"), table(spark, sf_dir, "events").select("user_id", "event_id")
    for half in (1, 0):
        L.put_if_absent(t, e.where(F.pmod("event_id", F.lit(2)) == half), ["user_id"], F.col("event_id"))
    return t.current()


@_query("k11_compare_and_swap", """WITH RECURSIVE w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 AS seen FROM events),
    f AS (SELECT user_id, event_id, rn, seen = 0 AS accepted, (seen = 0)::INT AS v FROM w WHERE rn = 1
    UNION ALL SELECT w.user_id, w.event_id, w.rn, w.seen = f.v, f.v + (w.seen = f.v)::INT FROM f JOIN w ON w.user_id = f.user_id AND w.rn = f.rn + 1)
    SELECT user_id, event_id, accepted FROM f UNION ALL SELECT -1, -1, false""")
def k11(spark, sf_dir):
    """Conditional writes by the version they saw; and a table write that names an old version fails."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("seen", F.floor((F.row_number().over(w) - 1) / 2))
    t = _new(spark, "k11")
    t.write(L.swap_all(e, "user_id", "event_id", "seen").select("user_id", "event_id", "accepted"), expected=0)
    try:
        t.write(t.current(), expected=0)
        stale = True
    except VersionConflict:
        stale = False
    return t.current().union(spark.createDataFrame([(-1, -1, stale)], "user_id long, event_id long, accepted boolean"))


@_query("k12_sidecars", "WITH e AS (SELECT user_id AS book_id, event_id AS ord, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN ' ' ELSE event_type END AS title, event_id % 90 AS page, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 0 ELSE event_id % 2 END AS depth FROM events WHERE event_id % 90 > 0), b AS (SELECT DISTINCT book_id FROM e WHERE trim(title) = '') SELECT * FROM e WHERE book_id NOT IN (SELECT book_id FROM b)")
def k12(spark, sf_dir):
    """Generated contents of books all of whose entries are valid, saved and loaded."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_id % 90 > 0").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), F.when((F.col("event_type") == "error") & (F.pmod("user_id", F.lit(3)) == 0), " ").otherwise(F.col("event_type")).alias("title"), F.pmod("event_id", F.lit(90)).alias("page"))
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("ord")) == 1
    t = _new(spark, "k12")
    t.write(L.valid_contents(e.withColumn("depth", F.when(first, 0).otherwise(F.pmod("ord", F.lit(2))).cast("long"))))
    return t.current()


_PAGES = "SELECT book_id, block_index AS page, text AS markdown FROM blocks"


def _pages(spark, sf_dir):
    return blocks(spark, sf_dir).select("book_id", F.col("block_index").alias("page"), F.col("text").alias("markdown"))


@_query("k13_ocr_documents", f"WITH {BLOCKS_SQL} {_PAGES}")
def k13(spark, sf_dir):
    """Recognised documents saved, exported as JSON lines, and imported elsewhere."""
    here, there, out = _new(spark, "k13-here"), _new(spark, "k13-there"), new_folder(spark, "k13-export")
    here.write(_pages(spark, sf_dir))
    here.current().write.json(out)
    there.write(spark.read.schema("book_id long, page long, markdown string").json(out))
    return there.current()


@_query("k14_page_archives", f"WITH {BLOCKS_SQL} {_PAGES}")
def k14(spark, sf_dir):
    """Pages packed into an archive a book, saved, and unpacked."""
    t = _new(spark, "k14")
    t.write(L.packed_pages(_pages(spark, sf_dir)))
    return L.unpacked_pages(t.current())


@_query("k16_device_library", "SELECT DISTINCT event_type AS device, user_id AS book_id, first_value(value > 50) OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS present FROM events")
def k16(spark, sf_dir):
    """What each device publishes of its library: one folder of JSON a device, rows and not one long list."""
    out = new_folder(spark, "k16")
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("device"), F.col("user_id").alias("book_id")).agg(F.max_by(F.col("value") > 50, "event_id").alias("present"))
    e.write.partitionBy("device").json(out)
    return spark.read.schema("book_id long, present boolean, device string").json(out)


@_query("k17_upload_missing", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'upload' WHEN doc_id % 3 = 1 THEN 'skip' ELSE 'error' END AS action, 'skip' AS again FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2 UNION ALL SELECT doc_id, 'error', 'error' FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 2")
def k17(spark, sf_dir):
    """What an upload does with each book, and what the next one does once the missing ones are there."""
    local = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"))
    there = _new(spark, "k17")
    there.write(local.where("id % 3 > 0").select("id", (F.col("size") + (F.pmod("id", F.lit(3)) - 1)).alias("size")))
    actions = L.uploads(local, there.current())
    missing = local.join(actions.where("action = 'upload'").select("id"), "id", "left_semi")
    after = _new(spark, "k17-after")
    after.write(there.current().unionByName(missing))
    return actions.join(L.uploads(local, after.current()).withColumnRenamed("action", "again"), "id")


@_query("k18_resumed_download", """WITH d AS (SELECT doc_id, text, length(text) // 2 AS k FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*'))
    SELECT doc_id AS id, CASE doc_id % 3 WHEN 1 THEN 0 ELSE k END AS resumed_from, doc_id % 3 < 2 OR reverse(left(text, k)) = left(text, k) AS accepted FROM d""")
def k18(spark, sf_dir):
    """Downloads gone on with: from a good part, from one that is too long, and from one that is damaged."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.regexp_like("text", F.lit(r"^[\x00-\x7F]*\z"))).withColumn("k", F.floor(F.length("text") / 2).cast("int"))
    kind, half = F.pmod("doc_id", F.lit(3)), F.left("text", F.col("k"))
    partial = F.when(kind == 0, half).when(kind == 1, F.concat("text", F.lit("x"))).otherwise(F.reverse(half))
    return L.resumed(d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("expected"), F.octet_length("text").alias("size"), partial.cast("binary").alias("partial"), F.col("text").cast("binary").alias("whole")))


@_query("k19_dirty_markers", "SELECT DISTINCT user_id AS book_id, user_id % 2 = 1 AS dirty FROM events WHERE event_type = 'view'")
def k19(spark, sf_dir):
    """Books marked as changed; the mark goes only from those whose data could be written."""
    marks, derived = _new(spark, "k19-marks"), _new(spark, "k19-derived")
    viewed = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("book_id"), "event_id")
    L.upsert(marks, viewed.select("book_id").distinct(), ["book_id"])
    L.upsert(derived, viewed.where("book_id % 2 = 0"), ["book_id"], F.col("event_id"))
    L.remove(marks, derived.current().select("book_id"), ["book_id"])
    return derived.current().select("book_id", F.lit(False).alias("dirty")).union(marks.current().select("book_id", F.lit(True)))


@_query("k20_page_roles", "SELECT user_id AS book_id, event_id % 30 AS page, min_by(r, event_id) AS role FROM (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'cover' WHEN 'click' THEN 'toc' WHEN 'error' THEN 'nothing' ELSE 'blank' END AS r FROM events) WHERE r <> 'nothing' GROUP BY ALL")
def k20(spark, sf_dir):
    """The first known role of each page, saved and loaded."""
    role = F.when(F.col("event_type") == "view", "cover").when(F.col("event_type") == "click", "toc").when(F.col("event_type") == "error", "nothing").otherwise("blank")
    t = _new(spark, "k20")
    t.write(L.valid_roles(table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.pmod("event_id", F.lit(30)).alias("page"), role.alias("role"), F.col("event_id").alias("ord"))))
    return t.current()


@_query("s29_manifest", "SELECT p_partkey AS id, p_name AS title, [p_brand] AS authors, p_size AS added_at FROM part")
def s29(spark, sf_dir):
    """A library's manifest written as JSON and loaded with its schema."""
    out = new_folder(spark, "s29")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_size").alias("added_at"), F.lit(1).alias("unknown")).write.json(out)
    return spark.read.schema("id long, title string, authors array<string>, added_at int").json(out)


@_query("s30_store_tables", "SELECT 'progress' AS name, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'annotations', count(DISTINCT user_id || '/' || event_type) FROM events UNION ALL SELECT 'membership', count(DISTINCT user_id) FROM events WHERE event_type IN ('signup', 'error')")
def s30(spark, sf_dir):
    """The tables of a sync store, each written with its own schema, and their sizes as read."""
    e, store = table(spark, sf_dir, "events"), {n: _new(spark, f"s30-{n}") for n in ("progress", "annotations", "membership")}
    L.upsert(store["progress"], e.select("user_id", "value", "event_id"), ["user_id"], F.col("event_id"))
    L.upsert(store["annotations"], _annotations(spark, sf_dir), ["id"], F.col("event_id"))
    L.upsert(store["membership"], e.where(F.col("event_type").isin("signup", "error")).select("user_id", (F.col("event_type") == "signup").alias("present"), "event_id"), ["user_id"], F.col("event_id"))
    out = None
    for name, t in store.items():
        own = t.current().agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = own if out is None else out.union(own)
    return out
