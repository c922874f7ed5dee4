"""Folds over replicated state: registers, clocks, memberships, annotations, modal offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer(rows: DataFrame, key: str, value: Column, wall: str = "wall", counter: str = "counter", device: str = "device") -> DataFrame:
    """The value with the greatest hybrid timestamp of each key; partial maxima go ahead of the shuffle."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(wall, counter, device)).alias("value"), F.max(wall).alias("wall"))


def clock_order(left: Column, right: Column) -> Column:
    """``equal``, ``before``, ``after`` or ``concurrent``; a missing device counts 0."""
    pairs = F.map_values(F.map_zip_with(left, right, lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
    less, more = F.exists(pairs, lambda d: d < 0), F.exists(pairs, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def hybrid_ticks(rows: DataFrame, key: str, order: str, wall: str = "wall") -> DataFrame:
    """``tick_wall, tick_counter`` of a clock that never runs back: counters number equal walls."""
    w = Window.partitionBy(key).orderBy(order)
    ticked = rows.withColumn("tick_wall", F.max(wall).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ticked.withColumn("tick_counter", F.row_number().over(Window.partitionBy(key, "tick_wall").orderBy(order)).cast("long") - 1)


def modal_offset(anchors: DataFrame, key: str, offset: Column) -> DataFrame:
    """The commonest offset of each key, the one nearest to 0 among equally common ones."""
    counts = anchors.withColumn("offset", offset).groupBy(key, "offset").agg(F.count("*").alias("n"))
    best = F.struct("n", -F.abs("offset"), -F.col("offset"))
    return counts.groupBy(key).agg(F.max_by("offset", best).alias("offset"), F.max("n").alias("support"))


def merge_annotations(versions: DataFrame) -> DataFrame:
    """Merge annotation versions ``id, seq, clock, wall, counter, device, deleted, conflict_of, note`` in order of ``seq``.

    A version that is behind the current one is ignored, one that is ahead replaces it. Of two
    concurrent ones the later timestamp wins; the other stays as a copy under an id of its own if it is live, not
    itself a copy, and the id is free: copies are synced too, so one may have come in before. The outcome
    depends on arrival order, so an annotation and its copies are folded together in sequence.
    """
    schema = "id string, clock map<string,long>, wall long, counter long, device string, deleted boolean, conflict_of string, note string"
    columns = ["id", "clock", "wall", "counter", "device", "deleted", "conflict_of", "note"]

    def clock(row: dict) -> dict:
        return dict(row["clock"] or {})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, dict] = {}
        for row in group.sort_values("seq").to_dict("records"):
            now = state.get(row["id"])
            if now is None:
                state[row["id"]] = row
                continue
            a, b = clock(now), clock(row)
            less = any(a.get(d, 0) < n for d, n in b.items())
            more = any(n > b.get(d, 0) for d, n in a.items())
            if less and not more:
                state[row["id"]] = row
            elif less and more:
                stamp = lambda r: (r["wall"], r["counter"], r["device"])
                winner, loser = (row, now) if stamp(row) > stamp(now) else (now, row)
                copy = f"{loser['id']}~conflict~{loser['device']}~{loser['wall']}-{loser['counter']}"  # form of copies' ids (fixed value)
                if not loser["deleted"] and loser["conflict_of"] is None and copy not in state:
                    state[copy] = {**loser, "id": copy, "conflict_of": row["id"]}
                state[row["id"]] = winner
        return pd.DataFrame([{c: r[c] for c in columns} for r in state.values()], columns=columns)

    return versions.groupBy(F.coalesce("conflict_of", "id").alias("origin")).applyInPandas(fold, schema)
