"""Mixing sources to target weights by packed blocks and multinomial shard counts.

The words of each source, in a pseudorandom order of its documents, are packed into
blocks of a fixed length. The output is laid out in groups of shards; a group has its even
part of each source's quota, and inside it each shard draws how many blocks of each source it
gets. The draws are multinomial, given that the shards' counts add up to the group's
part; they are made by halving the group's range of shards again and again, with a
multivariate hypergeometric draw at each node that is seeded by the node. So any
shard finds its counts, and where its blocks begin in each source's sequence, without
asking another, and no draw grows with the corpus. The sequence of a source is one pseudorandom
permutation of its block indexes after another. Slots and blocks meet in a join on the index.

All orders come from the rows themselves (id, text, source, other columns), never from file
splits or partitions, so reruns agree on any layout; rows that are equal in all columns
change places without effect.

One row a source comes to the driver and goes to all tasks: at most ``MOST_SOURCES`` sources
(about 100 bytes each), beyond which a ``ValueError`` asks for a coarser source column.

Defined cases: null text has size 0; null is a source of its own, the last; documents of
size 0 are never taken; rows that repeat are documents of their own; null ids are ids like
any other; a very long text is cut by offsets, once a document, and its parts leave in small
batches; extra columns play no part (``mixed_documents`` carries them along); an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE_CLASS, column, cut, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS, SHARD_SLOTS, SEED = 32, 4096, 17
#: Shards of a group, most tasks that deal slots, and most sources of a mix.
GROUP_SHARDS, MOST_TASKS, MOST_SOURCES = 128, 20_000, 1_000_000
#: Rows and bytes of text in one output batch of cut texts.
_OUT_ROWS, _OUT_BYTES = 1024, 8 << 20


def targets(sizes: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets by weight, none above ``most`` times its size; what is above is shared again."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        all_ = sum(own[i] for i in open_)
        for i in open_:
            out[i] = rest * own[i] / all_
        above = [i for i in open_ if out[i] > most * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = most * sizes[i]
            rest -= out[i]
        closed = set(above)
        open_ = [i for i in open_ if i not in closed]
    return out


def group_counts(quota: np.ndarray, group: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """``(counts, offsets)``: a group's even part of each source's quota, and what the groups before it have."""
    upto = lambda k: np.array([q * k // groups for q in quota.tolist()], np.int64)  # noqa: E731 - whole numbers of any size
    return upto(group + 1) - upto(group), upto(group)


def shard_counts(counts: np.ndarray, slots: int, seed: tuple[int, ...]):
    """``(shard, counts, offsets)`` of the shards of a group, each of ``slots`` slots, the last of the rest."""
    total = int(counts.sum())
    size = lambda a, b: min(b * slots, total) - a * slots

    def descend(a: int, b: int, own: np.ndarray, offsets: np.ndarray):
        if b - a == 1:
            yield a, own, offsets
            return
        mid = (a + b) // 2
        left = np.random.Generator(np.random.PCG64([*seed, a, b])).multivariate_hypergeometric(own, size(a, mid), method="marginals")
        yield from descend(a, mid, left, offsets)
        yield from descend(mid, b, own - left, offsets + left)

    if total:
        yield from descend(0, -(-total // slots), counts, np.zeros(len(counts), np.int64))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a Feistel network that walks its cycles into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.Generator(np.random.PCG64(key)).integers(1, 1 << 63, 4, np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * k
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return a << shift | b

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slots(quota: np.ndarray, blocks: np.ndarray, groups: int, slots: int, seed: int):
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_index", pa.int32()), ("block", pa.int64())])
    stride = GROUP_SHARDS + len(quota) // slots + 2  # parts are rounded by less than one block a source

    def of_group(group: int) -> Iterator[pa.RecordBatch]:
        part, before = group_counts(quota, group, groups)
        for shard, counts, offsets in shard_counts(part, slots, (seed, group)):
            there = np.flatnonzero(counts)
            sources = np.repeat(there, counts[there])
            place = np.concatenate([o + np.arange(c) for o, c in zip((before + offsets)[there].tolist(), counts[there].tolist(), strict=True)])
            block, turn = np.empty(len(place), np.int64), place // blocks[sources]
            begins = np.concatenate([[0], np.flatnonzero((sources[1:] != sources[:-1]) | (turn[1:] != turn[:-1])) + 1, [len(place)]])
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                s, t = int(sources[lo]), int(turn[lo])
                block[lo:hi] = permuted(place[lo:hi] - t * blocks[s], int(blocks[s]), (seed << 48) + (s << 8) + t)
            number = group * stride + shard
            order = np.random.Generator(np.random.PCG64([seed, group, shard])).permutation(len(place))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), number)), pa.array(order.astype(np.int32)), pa.array(sources.astype(np.int32)), pa.array(block)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                yield from of_group(group)

    return run


def _cut_texts(text_at: int, parts_at: int, size_at: int | None):
    """A function over rows with a text and its ``parts`` (``begin, words, n``) that gives the parts' texts.

    With ``size_at``, the place of the number of words: a row for each turn, of the parts with ``n`` of at least
    that turn together, and the text itself where they are all its words; else a row for each part. The
    parts are replaced by the number of the turn or part; all other columns go along by reference.
    """
    by_turn = size_at is not None

    def ranges(parts: list[dict]) -> Iterator[tuple[list[tuple[int, int]], int]]:
        if not by_turn:
            for k, p in enumerate(parts):
                yield [(p["begin"], p["begin"] + p["words"])], k
            return
        for turn in range(1, max((p["n"] for p in parts), default=0) + 1):
            own: list[tuple[int, int]] = []
            for p in parts:
                if p["n"] < turn:
                    continue
                if own and own[-1][1] == p["begin"]:
                    own[-1] = (own[-1][0], p["begin"] + p["words"])
                else:
                    own.append((p["begin"], p["begin"] + p["words"]))
            yield own, turn

    def texts(text: str, parts: list[dict], size: int | None) -> Iterator[tuple[str, int]]:
        words = None
        for own, k in ranges(parts):
            if own == [(0, size)]:
                yield text, k
                continue
            words = text.encode().split() if words is None else words  # on bytes: ASCII white space only
            yield b" ".join(b" ".join(words[lo:hi]) for lo, hi in own).decode(), k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            at: list[int] = []
            made: list[str] = []
            which: list[int] = []
            held = 0

            def out() -> pa.RecordBatch:
                take = pa.array(at, pa.int64())
                columns = [pa.array(made, pa.string()) if k == text_at else pa.array(which, pa.int32()) if k == parts_at else batch.column(k).take(take) for k in range(batch.num_columns)]  # noqa: B023
                for x in (at, made, which):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i in range(batch.num_rows):
                size = batch.column(size_at)[i].as_py() if by_turn else None
                for text, k in texts(batch.column(text_at)[i].as_py() or "", batch.column(parts_at)[i].as_py(), size):
                    at.append(i)
                    made.append(text)
                    which.append(k)
                    held += len(text)
                    if len(at) >= _OUT_ROWS or held >= _OUT_BYTES:
                        yield out()
                        held = 0
            if at:
                yield out()

    return run


class Mix:
    """The plan of a mix. ``docs`` must have ``rid`` (a row number), ``key`` and ``rest`` (hashes of the row), ``doc_id``, ``source`` and ``size``."""

    def __init__(self, docs: DataFrame, block_words: int, shard_slots: int, seed: int) -> None:
        self.spark: SparkSession = docs.sparkSession
        self._block_words, self._shard_slots, self._seed = block_words, shard_slots, seed
        found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"a mix has at most {MOST_SOURCES} sources; use a coarser source column")
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [r["size"] for r in found]
        wanted = targets(sizes)
        blocks = [math.ceil(s / block_words) for s in sizes]
        self.quota = np.array([self._quota(s, t, b) for s, t, b in zip(sizes, wanted, blocks, strict=True)], np.int64)
        self.blocks = np.array(blocks, np.int64)
        schema = "source string, source_index int, source_size long, target double, pieces long"
        plan = self.spark.createDataFrame([(r["source"], i, sizes[i], wanted[i], math.ceil(math.sqrt(r["n"]))) for i, r in enumerate(found)], schema)
        self.docs = docs.join(F.broadcast(plan.withColumnRenamed("source", "_source")), docs["source"].eqNullSafe(F.col("_source")), "left").drop("_source")

    @staticmethod
    def _quota(size: int, target: float, blocks: int) -> int:
        """Blocks to take, so that their words come to the target."""
        if not size:
            return 0
        whole = int(target // size)
        return whole * blocks + round((target - whole * size) * blocks / size)

    def slots(self) -> DataFrame:
        """``shard, slot, source_index, block``: which block of which source is where in the output."""
        groups = -(-int(self.quota.sum()) // (self._shard_slots * GROUP_SHARDS))
        return self.spark.range(0, groups, 1, max(1, min(groups, MOST_TASKS))).mapInArrow(_slots(self.quota, self.blocks, groups, self._shard_slots, self._seed), "shard long, slot int, source_index int, block long")

    def segments(self) -> DataFrame:
        """``rid, source_index, block, at, begin, words``: the part of a document that is in a block; ``begin`` counts
        from 0 in the document, ``at`` is where the document begins in its source."""
        # A source's documents are dealt to about as many pieces as there are documents in each, so no task has a whole source.
        docs = self.docs.where("size > 0").withColumn("piece", F.pmod(F.xxhash64("key", F.lit(self._seed)), F.col("pieces")))
        sums = docs.groupBy("source_index", "piece").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_index").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("source_index", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        # The other columns part rows of one id, text and source; the row number parts rows that are equal in all columns.
        within = Window.partitionBy("source_index", "piece").orderBy("key", "doc_id", "size", "rest", "rid").rowsBetween(Window.unboundedPreceding, -1)
        placed = docs.select("rid", "size", "source_index", "piece", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("inner")).join(bases, ["source_index", "piece"])
        b = self._block_words
        placed = placed.select("rid", "size", "source_index", (F.col("base") + F.col("inner")).alias("at"))
        parts = placed.select("*", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))).alias("block"))
        begin, end = F.greatest(F.col("block") * b, "at"), F.least((F.col("block") + 1) * b, F.col("at") + F.col("size"))
        return parts.select("rid", "source_index", "block", "at", (begin - F.col("at")).alias("begin"), (end - begin).alias("words"))

    def taken_segments(self) -> DataFrame:
        """The segments of blocks that the mix takes, and how often (``times``)."""
        # Sizes of Python stages are not known to the planner, which would broadcast this side at any size.
        times = self.slots().groupBy("source_index", "block").agg(F.count("*").alias("times"))
        return self.segments().join(times.hint("merge"), ["source_index", "block"])


def _word_count(text) -> object:
    parts = F.split(text, f"{SPACE_CLASS}+")
    blank = lambda x: (x == "").cast("int")
    return F.element_at(F.transform(F.array(parts), lambda p: F.size(p) - blank(p[0]) - F.when(F.size(p) > 1, blank(F.element_at(p, -1))).otherwise(0)), 1).cast("long")


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    own = {id_col, text_col, source_col}
    key = F.xxhash64(column(id_col).cast("long"), text_or_empty(text_col), column(source_col).cast("string"))
    others = [column(c) for c in keep if c not in own]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), column(source_col).cast("string").alias("source"), _word_count(text_or_empty(text_col)).alias("size"), key.alias("key"), rest.alias("rest"),
        F.struct(*[column(c) for c in keep]).alias("row") if keep else F.lit(None).cast("int").alias("row"),
    )
    return cut(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-rows")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, taken``."""
    mix = Mix(_numbered(docs, id_col, text_col, source_col, []), block_words, shard_slots, seed)
    taken = mix.taken_segments().groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return mix.docs.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _with_parts(mix: Mix, parts: DataFrame) -> DataFrame:
    """Documents with their ``parts``; the texts meet short rows in a join that sorts and may spill."""
    # A document has one part for each block that it reaches into, fewer bytes than its text.
    gathered = parts.groupBy("rid").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return mix.docs.select("rid", "source_index", "size", "row").join(gathered.hint("merge"), "rid")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: ``shard, slot, source, block, text`` with the block's words joined by one space."""
    mix = Mix(_numbered(docs, id_col, text_col, source_col, [text_col]), block_words, shard_slots, seed)
    segments = mix.segments().select("rid", "block", "at", F.struct("begin", "words", F.lit(1).cast("long").alias("n"), "block", "at").alias("part"))
    rows = _with_parts(mix, segments).select(F.col("row")[text_col].cast("string").alias("text"), "source_index", "parts", F.col("parts").alias("all"))
    pieces = rows.mapInArrow(_cut_texts(0, 2, None), "piece string, source_index int, k int, all array<struct<begin:long,words:long,n:long,block:long,at:long>>")
    pieces = pieces.select("source_index", F.get("all", "k").alias("p"), "piece")
    packed = pieces.groupBy("source_index", F.col("p.block").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("p.at").alias("at"), "piece"))).alias("x"))
    names = mix.docs.select("source_index", "source").distinct()
    text = F.array_join(F.transform("x", lambda x: x["piece"]), " ")
    placed = mix.slots().hint("merge").join(packed.select("source_index", "block", text.alias("text")), ["source_index", "block"])
    return placed.join(F.broadcast(names), "source_index").select("shard", "slot", "source", "block", "text")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each time that some of a document is taken.

    A row has the document's text where all its words are taken, else the words taken, joined by one space.
    """
    mix = Mix(_numbered(docs, id_col, text_col, source_col, docs.columns), block_words, shard_slots, seed)
    parts = mix.taken_segments().select("rid", F.struct("begin", "words", F.col("times").alias("n")).alias("part"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = _with_parts(mix, parts).select(*[F.col("row")[c].alias(n) for n, c in zip(names, docs.columns, strict=True)], "parts", F.col("size").alias("n_words"))
    at = docs.columns.index(text_col)
    schema = ", ".join([*[f"`{n}` {docs.schema[c].dataType.simpleString() if c != text_col else 'string'}" for n, c in zip(names, docs.columns, strict=True)], "turn int", "n_words long"])
    made = rows.withColumn(names[at], F.col(names[at]).cast("string")).mapInArrow(_cut_texts(at, len(names), len(names) + 1), schema)
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
