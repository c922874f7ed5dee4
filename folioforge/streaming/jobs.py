"""Long tasks as streams: resumable file jobs, exactly-once emission, task slots, generations, caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def emit_batches(target: str, make: Callable[[DataFrame], DataFrame] | None = None):
    """A ``foreachBatch`` function that writes each batch to a folder of its own; a replayed batch writes over itself."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        rows = make(batch) if make else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return emit


def file_job(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None, files_at_once: int = 1) -> StreamingQuery:
    """A job over the JSON files below ``source`` that goes on where it was stopped: its state is the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    return stream.writeStream.foreachBatch(emit_batches(target, make)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emitted(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What a job has emitted, with the ``batch`` of each row."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", target).parquet(target)


def progress_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """``(batch, rows)`` of the progress events that a query kept."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]


def slot_step(state: tuple, kind: str, task: int) -> tuple[tuple, bool]:
    """The slot ``(in flight, pending)`` after a submission or completion, and whether it was accepted.

    A submission waits while another task is in flight, in place of one that waits already. A completion counts
    only for the task in flight, and lets the waiting one go.
    """
    flying, pending = state
    if kind == "submit":
        return ((task, pending) if flying is None else (flying, task)), True
    if task != flying:
        return state, False
    return (pending, None), True


def slot_events(events: DataFrame) -> DataFrame:
    """``key, seq, accepted`` of a stream ``key, seq, kind, task``; the slot of a key is the stream's state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        slot = tuple(None if x < 0 else x for x in state.get) if state.exists else (None, None)
        accepted = []
        for row in rows.itertuples():
            slot, ok = slot_step(slot, row.kind, row.task)
            accepted.append(ok)
        state.update(tuple(-1 if x is None else x for x in slot))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "accepted": accepted})

    return events.groupBy("key").applyInPandasWithState(run, "key long, seq long, accepted boolean", "flying long, pending long", "append", "NoTimeout")


def current_results(results: DataFrame, key: str, order: str, resets: Column, generation: Column) -> DataFrame:
    """Results whose generation is still the one of their key when they come in; ``resets`` marks rows that begin a new one."""
    now = F.sum(resets.cast("long")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("_now", now).withColumn("_of", generation).where(~resets & (F.col("_now") == F.col("_of"))).drop("_now", "_of")


def cache_hits(reads: DataFrame, key: str, order: str, item: str, size: int) -> DataFrame:
    """``hit`` of reads through a cache that keeps the ``size`` items last used, for each key in order."""

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        cache: OrderedDict = OrderedDict()
        hits = []
        for x in group[item].tolist():
            hits.append(x in cache)
            cache[x] = True
            cache.move_to_end(x)
            if len(cache) > size:
                cache.popitem(last=False)
        return group.assign(hit=hits)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema.fields)
    return reads.groupBy(key).applyInPandas(scan, f"{schema}, hit boolean")
