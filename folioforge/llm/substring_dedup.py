"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Every window of ``window`` words has one anchor: the least of its ``anchor``-word hashes,
the leftmost if equal. Equal windows have equal anchors, wherever they stand. The
consecutive windows with one anchor span a block. The blocks of all documents that occur more
than once are the index: (anchor, hash of the block) leads to a reference, the block's least
occurrence, as a document and a position.

A document is parsed from left to right. Where a block is in the index a factor begins: a position,
a length, and the reference's document and position. It is extended greedily, block after
block, as long as the next block's reference goes on at the same place of the same document, so a passage
copied from one document is one factor however long it is; else a new factor begins. Factors have
``window`` words or more and become duplicate spans. Boundaries are checked window by window: where
a block's anchor is known but its words differ, as they do where a factor ends inside a block, the
single windows are compared, by 128-bit hashes, among all blocks of the corpus with that anchor. Blocks are
compared by their anchor and a 64-bit hash of all their words, 128 bits in all.

Hot anchors, of a passage in a third of all rows, are counted with partial sums
before each shuffle and joined by sort-merge joins that split; no group is gathered but a document's
own blocks, which are fewer than its words.

Defined cases: null text has no words; texts shorter than a window lose nothing; a very long text
is parsed as a whole; rows that repeat are occurrences of their own; a window may overlap its other
occurrence in the same text; null ids and extra columns, whatever their names, play no part; of
occurrences that tie for a reference (one id, one position) either is it; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, cut, discard, text_or_empty

#: Words of an anchor.
ANCHOR = 5
#: Windows whose anchors are found at once.
_AT_ONCE = 1 << 16
#: An odd multiplier of the polynomial hashes, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE, _TWO = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> _S)) * _ONE
    x = (x ^ (x >> _S)) * _TWO
    return x ^ (x >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any run of a text's words in constant time, equal for equal runs."""

    def __init__(self, words: list[bytes]) -> None:
        digest = xxhash.xxh64_intdigest
        own = np.frombuffer(array("Q", [digest(w) for w in words]), np.uint64)
        n = len(words)
        self.n, self._own = n, own
        self._down, self._up = _powers(_INVERSE, n + 1), _powers(_BASE, n + 1)
        self._sums = self._summed(own)
        self._second: np.ndarray | None = None

    def _summed(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n + 1, np.uint64)
        np.cumsum(own * self._down[: self.n], out=out[1:])
        return out

    def runs(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the words from each begin to its end."""
        return mixed((self._sums[ends] - self._sums[begins]) * self._up[begins])

    def second(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash that does not depend on that of ``runs``."""
        if self._second is None:
            self._second = self._summed(mixed(self._own + np.uint64(0x632BE59BD9B4E019)))
        return mixed((self._second[ends] - self._second[begins]) * self._up[begins] + _ONE)


def blocks(hashes: Hashes, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``(anchor hash, block hash, first window, number of windows)`` of a text's blocks."""
    windows = hashes.n - window + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    at = np.arange(hashes.n - anchor + 1)
    grams = hashes.runs(at, at + anchor)
    span = window - anchor + 1
    where = np.empty(windows, np.int64)
    for lo in range(0, windows, _AT_ONCE):
        hi = min(windows, lo + _AT_ONCE)
        where[lo:hi] = np.lib.stride_tricks.sliding_window_view(grams[lo : hi + span - 1], span).argmin(axis=1) + np.arange(lo, hi)
    first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
    count = np.diff(np.concatenate([first, [windows]]))
    place = (where[first] - first).astype(np.uint64)
    own = hashes.runs(first, first + count - 1 + window)
    return grams[where[first]], mixed(own + place * _TWO + count.astype(np.uint64) * _ONE), first, count


def _words(text: str) -> list[bytes]:
    return text.encode().split()  # on bytes: ASCII white space only


_BLOCKS = pa.schema([("id", pa.int64()), ("sign", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])


def _index(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(4)]
            counts = []
            for text in batch.column(2):
                words = _words(text.as_py())
                made = blocks(Hashes(words), window, anchor) if len(words) >= window else ()
                for part, x in zip(parts, made, strict=False):
                    part.append(x)
                counts.append(len(made[0]) if made else 0)
            rows = np.repeat(np.arange(len(counts)), counts)
            if not len(rows):
                continue
            a, b, first, windows = (np.concatenate(p) for p in parts)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))], schema=_BLOCKS)

    return run


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:n]) > 0


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first`` and have ``count`` members."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def result_of(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, int, str]:
    """``(number of words, number removed, SHA-256 of the kept words)``."""
    if len(starts):
        gone = covered(starts, window, len(words))
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    else:
        kept = words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def factors(blocks_: list[dict], window: int) -> list[tuple[int, int, int | None, int]]:
    """The greedy parse ``(start, length, reference id, reference start)`` of a document's indexed blocks.

    ``blocks_`` have ``first, windows, ref_id, ref_first``. A factor that meets a block of another
    reference ends with its last whole block; the next one begins inside it, so no window is between them.
    """
    out: list[tuple[int, int, int | None, int]] = []
    end, ref = -1, (None, -1)  # where the factor's next block would begin, here and in the reference
    for x in sorted(blocks_, key=lambda x: x["first"]):
        if out and x["first"] == end and ref == (x["ref_id"], x["ref_first"]):
            start, length, *of = out[-1]
            out[-1] = (start, length + x["windows"], *of)
        else:
            out.append((x["first"], x["windows"] + window - 1, x["ref_id"], x["ref_first"]))
        end, ref = x["first"] + x["windows"], (x["ref_id"], x["ref_first"] + x["windows"])
    return out


_FACTORS = "array<struct<start:int,length:int,ref_id:long,ref_start:int>>"
_FACTORS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))
_PARSED = f"id long, sign long, n_words long, n_removed long, kept_sha256 string, text string, factors {_FACTORS}, tried array<struct<hi:long,lo:long,at:int,own:boolean>>"
_TRIED = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("at", pa.int32()), ("own", pa.bool_())]))
_PARSED_ARROW = pa.schema([("id", pa.int64()), ("sign", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("factors", _FACTORS_ARROW), ("tried", _TRIED)])


def _starts(found: list[tuple], window: int) -> np.ndarray:
    """The starts of all windows inside factors."""
    return _expand(np.array([f[0] for f in found], np.int64), np.array([f[1] - window + 1 for f in found], np.int64))


def _parse(window: int):
    """Parse documents against the index of reference blocks.

    A document without open boundaries is done. Else its text and its factors go on, with the hashes of
    the windows that must be compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _PARSED_ARROW]
            for doc_id, sign, text, found in zip(*(batch.column(k) for k in range(4)), strict=True):
                text, found = text.as_py(), found.as_py() or []
                words = _words(text)
                made = factors([x for x in found if x["again"]], window)
                open_ = [x for x in found if x["mixed"]]
                tried = None
                if open_:
                    first, count = np.array([x["first"] for x in open_], np.int64), np.array([x["windows"] for x in open_], np.int64)
                    at, hashes = _expand(first, count), Hashes(words)
                    own = np.repeat(np.array([not x["again"] for x in open_]), count)
                    hi, lo = hashes.runs(at, at + window).view(np.int64), hashes.second(at, at + window).view(np.int64)
                    tried = [{"hi": a, "lo": b, "at": c, "own": d} for a, b, c, d in zip(hi.tolist(), lo.tolist(), at.tolist(), own.tolist(), strict=True)]
                waits = any(not x["again"] for x in open_)
                done = (None, None, None) if waits else result_of(words, _starts(made, window), window)
                named = [dict(zip(("start", "length", "ref_id", "ref_start"), f, strict=True)) for f in made]
                for column, x in zip(out, (doc_id.as_py(), sign.as_py(), *done, text if waits else None, named, tried), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PARSED_ARROW, strict=True)], schema=_PARSED_ARROW)

    return run


_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found, more in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                known = _starts([(f["start"], f["length"]) for f in found.as_py() or []], window)
                starts = np.unique(np.concatenate([known, np.array(more.as_py() or [], np.int64)]))
                rows.append(result_of(_words(text.as_py()), starts, window))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _parsed(docs: DataFrame, window: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """All documents after their parse."""
    # The id and a hash of the text name a row's text; rows that repeat share a name and their results.
    named = docs.select(column(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).select("id", F.xxhash64("id", "text").alias("sign"), "text")
    index = cut(named.mapInArrow(_index(window, anchor), "id long, sign long, anchor long, block long, first int, windows int"), "substring-index")

    # Most anchors occur once and go here; of the others, most have equal blocks all over, so few need counts by block.
    least = F.min(F.struct("id", "first")).alias("ref")
    anchors = cut(index.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("mixed"), least).where("n > 1").select("anchor", "mixed", F.when(~F.col("mixed"), F.col("ref")).alias("ref")), "substring-anchors")
    shared = cut(index.join(anchors, "anchor"), "substring-shared")
    discard(index)
    mixed = shared.where("mixed").drop("ref")
    # Written first, so that the join has two plain exchanges and a hot block's rows can be split.
    kinds = cut(mixed.groupBy("anchor", "block").agg((F.count("*") > 1).alias("again"), least), "substring-kinds")
    plain = shared.where("NOT mixed").withColumn("again", F.lit(True))
    verdicts = plain.unionByName(mixed.join(kinds, ["anchor", "block"])).select("id", "sign", F.struct("first", "windows", "again", "mixed", F.col("ref.id").alias("ref_id"), F.col("ref.first").alias("ref_first")).alias("v"))
    of_doc = verdicts.groupBy("id", "sign").agg(F.collect_set("v").alias("found")).select(F.col("id").alias("_id"), F.col("sign").alias("_sign"), "found")

    same = named["id"].eqNullSafe(of_doc["_id"]) & (named["sign"] == of_doc["_sign"])
    parsed = cut(named.join(of_doc.hint("merge"), same, "left").select("id", "sign", "text", "found").mapInArrow(_parse(window), _PARSED), "substring-parsed")
    discard(shared)
    return parsed


def duplicate_factors(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per factor of the parse ``doc_id, start, length, ref_id, ref_start``, in words; a reference may be the factor itself."""
    return _parsed(docs, window, anchor, id_col, text_col).select(F.col("id").alias("doc_id"), F.inline("factors"))


def substring_dedup(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256`` after removing repeated windows everywhere."""
    parsed = _parsed(docs, window, anchor, id_col, text_col)
    tried = parsed.select("id", "sign", F.explode("tried").alias("t")).select("id", "sign", "t.*")
    again = tried.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo")
    more = tried.where("own").join(again, ["hi", "lo"]).groupBy("id", "sign").agg(F.collect_set("at").alias("more"))
    more = more.select(F.col("id").alias("_id"), F.col("sign").alias("_sign"), "more")
    waiting = parsed.where("text IS NOT NULL").select("id", "sign", "text", "factors")
    late = waiting.join(more, waiting["id"].eqNullSafe(more["_id"]) & (waiting["sign"] == more["_sign"]), "left").select("id", "text", "factors", "more")
    done = parsed.where("text IS NULL").select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    return done.union(late.mapInArrow(_finish(window), _DONE))
