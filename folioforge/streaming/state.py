"""Reading state as streams: device files merged into a register table, byte chunks into events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.merges import last_writer

PROGRESS = "book_id string, progression double, wall long, counter long, device string"
_ROW = ("progression", "wall", "counter", "device")


def current_state(spark: SparkSession, target: str) -> DataFrame | None:
    """The last whole version of the register table at ``target``, null before the first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n.removeprefix("v=")) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return spark.read.schema(PROGRESS).parquet(f"{target}/v={max(done)}") if done else None


def merge_batch(target: str):
    """A ``foreachBatch`` function: the newest position of each book, of the state and the batch.

    A version is written for each batch id. A batch that is replayed starts from the version before it and
    overwrites its own, so a replay changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(f"{target}/v={batch_id}")
        fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(own):
            fs.delete(own, True)
        before = current_state(spark, target)
        rows = batch.select("book_id", *_ROW)
        rows = rows if before is None else rows.union(before.select("book_id", *_ROW))
        newest = last_writer(rows, "book_id", F.struct(*_ROW))
        newest.select("book_id", "value.*").write.parquet(f"{target}/v={batch_id}")

    return merge


def sync_progress(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream device files (JSON lines of ``PROGRESS``) into the register table; late ones merge like others."""
    stream = spark.readStream.schema(PROGRESS).json(source)
    writer = stream.writeStream.foreachBatch(merge_batch(target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def split_events(tail: str, chunks: list[str]) -> tuple[list[str], str]:
    """The whole events of a tail and the chunks after it, and the new tail; blank lines part events."""
    text = (tail + "".join(chunks)).replace("\r\n", "\n")
    *whole, rest = text.split("\n\n")
    return [x for x in whole if x.strip()], rest


def events_of_chunks(chunks: DataFrame) -> DataFrame:
    """``stream_id, event`` from a stream of ``stream_id, seq, chunk``; what is cut off waits in the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        events, tail = split_events(state.get[0] if state.exists else "", rows["chunk"].tolist())
        state.update((tail,))
        yield pd.DataFrame({"stream_id": [key[0]] * len(events), "event": events})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, event string", "tail string", "append", "NoTimeout")


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by hour and kind of a stream of ``ts, event_type``, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
