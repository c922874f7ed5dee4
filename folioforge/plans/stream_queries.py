"""Queries that run streams to their end over files they write first; SQL says what the state must be then."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import windows as W
from folioforge.sources.tables import BLOCKS_SQL, PROGRESS_SQL, blocks, progress_log, table
from folioforge.storage import new_folder
from folioforge.streaming import jobs as J
from folioforge.streaming import state as S

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@_query("x01_state_exchange", f"WITH {PROGRESS_SQL} SELECT book_id, arg_max(progression, (wall, counter, device)) AS progression, max(wall) AS wall FROM progress GROUP BY book_id")
def x01(spark, sf_dir):
    """Device files merged into the register table by two runs of a stream; late files merge like others."""
    source, target, checkpoint = (new_folder(spark, f"x01-{k}") for k in ("in", "state", "checkpoint"))
    p = progress_log(spark, sf_dir)
    for half in (1, 0):  # the later half of each book's positions comes first
        own = p.where(F.pmod(F.expr("event_id div 7"), F.lit(2)) == half)
        own.select("book_id", "progression", "wall", "counter", "device").write.mode("append").json(source)
        S.sync_progress(spark, source, target, checkpoint).awaitTermination()
    return S.current_state(spark, target).select(F.col("book_id").cast("long").alias("book_id"), "progression", "wall")


@_query("x03_progress_events", "SELECT count(*) AS rows FROM events")
def x03(spark, sf_dir):
    """The rows that a job's progress events report, batch by batch."""
    source, target, checkpoint = (new_folder(spark, f"x03-{k}") for k in ("in", "out", "checkpoint"))
    table(spark, sf_dir, "events").select("event_id").repartition(3).write.json(source)
    query = J.file_job(spark, source, "event_id long", target, checkpoint)
    query.awaitTermination()
    return spark.createDataFrame(J.progress_rows(query), "batch long, rows long").agg(F.sum("rows").alias("rows"))


_SLOTS = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type IN ('view', 'signup') THEN 'submit' ELSE 'complete' END AS kind,
        CASE WHEN event_type IN ('view', 'signup') THEN event_id ELSE coalesce(max(CASE WHEN event_type IN ('view', 'signup') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id), 0) END AS task,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT key, seq, rn, kind = 'submit' AS accepted, CASE WHEN kind = 'submit' THEN task END AS fly, NULL::BIGINT AS pend FROM e WHERE rn = 1
    UNION ALL
    SELECT key, seq, rn, kind = 'submit' OR coalesce(task = fly, false), CASE WHEN kind = 'submit' THEN coalesce(fly, task) WHEN task = fly THEN pend ELSE fly END,
           CASE WHEN kind = 'submit' THEN CASE WHEN fly IS NULL THEN pend ELSE task END WHEN task = fly THEN NULL ELSE pend END
    FROM (SELECT e.*, f.fly, f.pend FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1))
    SELECT key, seq, accepted FROM f"""


@_query("x04_task_slot", _SLOTS)
def x04(spark, sf_dir):
    """Submissions and completions through a slot a key, kept as a stream's state."""
    source, target, checkpoint = (new_folder(spark, f"x04-{k}") for k in ("in", "out", "checkpoint"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    submits = F.col("event_type").isin("view", "signup")
    last = F.coalesce(F.max(F.when(submits, F.col("event_id"))).over(w), F.lit(0))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(submits, "submit").otherwise("complete").alias("kind"), F.when(submits, F.col("event_id")).otherwise(last).alias("task"))
    e.write.json(source)
    stream = spark.readStream.schema("key long, seq long, kind string, task long").json(source)
    J.slot_events(stream).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, seq long, accepted boolean").parquet(target)


@_query("x05_generations", "WITH e AS (SELECT user_id, event_id, event_type = 'error' AS reset, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS now, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS asked FROM events) SELECT user_id, event_id FROM e WHERE NOT reset AND now = coalesce(asked, 0)")
def x05(spark, sf_dir):
    """Prefetched results, each asked for three rows ago, without those that a reset made stale."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("reset"))
    asked = F.coalesce(F.sum(F.col("reset").cast("long")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -3)), F.lit(0))
    return J.current_results(e, "user_id", "event_id", F.col("reset"), asked).select("user_id", "event_id")


@_query("x06_section_cache", "WITH e AS (SELECT user_id, event_id, event_id * 7 % 13 AS item FROM events), p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, item ORDER BY event_id) AS prior FROM e) SELECT p.user_id, p.event_id, p.prior IS NOT NULL AND count(DISTINCT m.item) < 7 AS hit FROM p LEFT JOIN e m ON m.user_id = p.user_id AND m.event_id > p.prior AND m.event_id < p.event_id GROUP BY p.user_id, p.event_id, p.prior")
def x06(spark, sf_dir):
    """Which reads find their section in a cache of the seven last used."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.pmod(F.col("event_id") * 7, F.lit(13)).alias("item"))
    return J.cache_hits(e, "user_id", "event_id", "item", 7).select("user_id", "event_id", "hit")


@_query("x07_resumed_job", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type")
def x07(spark, sf_dir):
    """A job whose first run sees a part of its files, and whose second goes on: every row once."""
    source, target, checkpoint = (new_folder(spark, f"x07-{k}") for k in ("in", "out", "checkpoint"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for k in range(3):
        e.where(F.pmod("event_id", F.lit(3)) == k).write.mode("append").json(source)
        if k != 1:
            J.file_job(spark, source, "event_id long, event_type string", target, checkpoint).awaitTermination()
    rows = J.emitted(spark, target, "event_id long, event_type string")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@_query("x08_incremental_batches", f"WITH {BLOCKS_SQL} SELECT book_id, block_index, reverse(text) AS text FROM blocks")
def x08(spark, sf_dir):
    """Blocks rewritten batch by batch; each batch is seen as soon as it is whole, and each block once."""
    source, target, checkpoint = (new_folder(spark, f"x08-{k}") for k in ("in", "out", "checkpoint"))
    b = blocks(spark, sf_dir)
    groups = W.grouped(b, "book_id", "block_index", "char_length", 2000)
    b.join(groups, ["book_id", "block_index"]).select("book_id", "block_index", "group", "text").write.json(source)
    make = lambda rows: rows.select("book_id", "block_index", F.reverse("text").alias("text"))
    J.file_job(spark, source, "book_id long, block_index long, group long, text string", target, checkpoint, make, 2).awaitTermination()
    return J.emitted(spark, target, "book_id long, block_index long, text string").drop("batch")


@_query("s32_event_stream", "SELECT conv_id AS stream_id, 'data: ' || turn || ':' || role AS event FROM conversations")
def s32(spark, sf_dir):
    """Events of byte streams whose chunks cut them anywhere; what is cut off waits in the state."""
    source, target, checkpoint = (new_folder(spark, f"s32-{k}") for k in ("in", "out", "checkpoint"))
    c = table(spark, sf_dir, "conversations")
    end = F.when(F.pmod("turn", F.lit(2)) == 0, "\r\n\r\n").otherwise("\n\n")
    whole = F.concat(F.lit("data: "), F.col("turn").cast("string"), F.lit(":"), "role", end)
    cut = (F.pmod(F.col("turn") * 5, F.lit(11)) + 1).cast("int")
    chunks = c.select(F.col("conv_id").alias("stream_id"), F.explode(F.array(F.struct((F.col("turn") * 2).alias("seq"), F.left(whole, cut).alias("chunk")), F.struct((F.col("turn") * 2 + 1).alias("seq"), F.substring(whole, cut + 1, F.length(whole)).alias("chunk")))).alias("x"))
    chunks.select("stream_id", "x.*").write.json(source)
    stream = spark.readStream.schema("stream_id long, seq long, chunk string").json(source)
    S.events_of_chunks(stream).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream_id long, event string").parquet(target)


@_query("x12_windowed_activity", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x12(spark, sf_dir):
    """Counts by hour and kind, the same function on a table as on a stream."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return S.windowed_activity(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
