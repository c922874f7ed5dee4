"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally
inside each partition, and compared in full with their neighbours. The keys that
are sampled for splitters have a bounded size: the first ``PREFIX`` signs, a hash
of the whole text, and an identifier, so splitters fall inside a very large group
of copies too and its rows spread over several partitions. What such groups need
across partitions travels as one small row for each run with the first or the last
prefix and hash of a partition.

Defined cases: null text counts as empty; rows that repeat (same id, same text)
are separate members of a group and just one of them stays; null ids never
win over real ones, and in a group with null ids only one row stays and
``keep_id`` is null; very long texts are hashed and compared in full, only the sampled keys
are short; extra columns play no part, whatever their names; an empty table gives an empty result.

A partition holds the text and the ids of one run of equal texts at a time (more where hashes
collide), so memory is bounded by the longest text and by the rows that the splitters leave in a partition;
they fall inside runs, so a run has no more of them than a partition has rows. Equality inside a
partition is by full comparison, across partitions by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, cut, text_or_empty

_RUNS = "doc_id long, row long, sha binary, size long, best long, stays boolean, part int, edge boolean"
_RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("best", pa.int64()), ("stays", pa.bool_()), ("part", pa.int32()), ("edge", pa.bool_())])
_LOCAL_ARROW = pa.schema([("norm", pa.string()), ("lead", pa.int64()), ("members", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
#: Signs of a text in the keys that are sampled on the driver.
PREFIX = 48
#: Rows of one output batch of the neighbour comparison.
_OUT_ROWS = 8192


def normalise_and_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-case A-Z and join the copies inside each batch, so copies are shuffled once a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = pc.ascii_lower(batch.column(1)).dictionary_encode()
        members: list[list] = [[] for _ in range(len(coded.dictionary))]
        rows: list[list] = [[] for _ in members]
        for group, doc_id, row in zip(coded.indices.to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            members[group].append(doc_id)
            rows[group].append(row)
        leads = [max((x for x in ids if x is not None), default=None) for ids in members]
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(leads, pa.int64()), pa.array(members, _LOCAL_ARROW.field(2).type), pa.array(rows, _LOCAL_ARROW.field(3).type)], schema=_LOCAL_ARROW)


def _equal_neighbours(texts: pa.Array, before: str | None) -> list[bool]:
    """For each sorted text, whether it equals the one before it, compared in full."""
    first = before is not None and texts[0].as_py() == before
    return [first, *pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()]


def neighbour_runs(largest: bool):
    """A function over sorted batches that gives each member its run's size, best id and digest."""
    choose = max if largest else min

    def rows_of(text: str, ids: list, rows: list, part: int, edge: bool) -> tuple:
        real = [x for x in ids if x is not None]
        best = choose(real) if real else None
        at = ids.index(best)
        sha = hashlib.sha256(text.encode()).digest()
        n = len(ids)
        return ids, rows, [sha] * n, [n] * n, [best] * n, [i == at for i in range(n)], [part] * n, [edge] * n

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text, ids, rows, key, edge = None, [], [], None, True
        held: list[tuple] = []  # runs with the current key: one, unless hashes of texts collide
        out: list[list] = [[] for _ in _RUNS_ARROW]

        def put(at_edge: bool) -> None:
            for run in held:
                for column, values in zip(out, rows_of(*run, part, at_edge), strict=True):
                    column.extend(values)
            held.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _RUNS_ARROW, strict=True)], schema=_RUNS_ARROW)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, members, row_lists, keys = batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))
            for i, same in enumerate(_equal_neighbours(texts, text)):
                if same:
                    ids.extend(members[i])
                    rows.extend(row_lists[i])
                    continue
                if text is not None and keys[i] != key:
                    put(edge)
                    edge = False
                text, ids, rows, key = texts[i].as_py(), list(members[i]), list(row_lists[i]), keys[i]
                held.append((text, ids, rows))
            if len(out[0]) >= _OUT_ROWS:
                yield made()
        if text is not None:
            put(True)
            yield made()

    return compare


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and, if ``row_col`` is given, ``row``.

    ``keep`` is ``smallest`` or ``largest``: the identifier of equal texts that stays.
    ``row_col`` names a column of longs that goes along, to tell rows with equal ids apart.
    """
    largest = {"largest": True, "smallest": False}[keep]
    local = docs.select(column(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("norm"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")).mapInArrow(
        normalise_and_group, "norm string, lead long, members array<long>, rows array<long>"
    )
    keyed = local.withColumn("key", F.concat(F.substring("norm", 1, PREFIX), F.lpad(F.hex(F.xxhash64("norm")), 16, "0")))
    ordered = keyed.repartitionByRange(F.col("key"), F.col("lead")).sortWithinPartitions("key", "norm", "lead").select("norm", "members", "rows", "key")
    runs = cut(ordered.mapInArrow(neighbour_runs(largest), _RUNS), "exact-dedup")

    best = F.max if largest else F.min
    # Two runs of a partition are at its edges (more if hashes collide), so this side has two rows a partition.
    edges = runs.where("edge").groupBy("part", "sha").agg(F.max("size").alias("size"), F.max("best").alias("best"))
    totals = edges.groupBy("sha").agg(F.sum("size").alias("all_size"), best("best").alias("all_best"), F.collect_list(F.struct("part", "best")).alias("parts"))
    totals = totals.select(
        F.explode("parts").alias("p"), "sha", "all_size", "all_best",
        F.array_min(F.transform(F.filter("parts", lambda p: p["best"].eqNullSafe(F.col("all_best"))), lambda p: p["part"])).alias("home"),
    ).select(F.col("p.part").alias("part"), "sha", "all_size", "all_best", "home")
    joined = runs.join(F.broadcast(totals), ["part", "sha"], "left")
    across = F.col("home").isNotNull()
    return joined.select(
        "doc_id",
        F.when(across, F.col("all_best")).otherwise(F.col("best")).alias("keep_id"),
        F.when(across, F.col("all_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("stays") & (~across | (F.col("home") == F.col("part")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(["row"] if row_col else []),
    )
