"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 3 or less have a common variant within one
flip of one and two flips of the other. Flips change a fingerprint's parity, and a
pair at an odd distance has one fingerprint of each parity, so it is enough that
even ones emit their variants of one flip, and odd ones themselves, their variants
of one flip and those of two flips inside one half of the bits (of three bits two
lie in the same half). That finds every pair at distance 3 or less: 64 or 1057 variants
in place of 2081.

Variants are dealt to buckets by a linear hash over GF(2): the bucket of a variant is the
xor of the buckets of the fingerprint and of its flips. So a fingerprint travels to
a bucket once, and the receiver makes the variants that belong there. In a bucket, equal
variants are sorted together. All but the two-flip members of such a group lie
within distance 2 of each other and within 3 of the rest; linking every member to
the least of those keeps each connection with fewer links than members, never all pairs.

Defined cases: null text has no words and fingerprint zero, which links like any
other; null ids get a fingerprint and the component of their text, and are never a
component's id unless all its ids are null; rows that repeat are one more member; a bit
set in exactly half of the hashes is 0; a very long text is hashed as a whole, its bits counted in
parts; extra columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, cut, text_or_empty
from folioforge.llm.components import components

RADIUS = 3
#: Hashes whose bits are counted at once.
_COUNTED = 1 << 16
#: Variants that a bucket shall hold on average, and the bounds of the number of buckets (powers of two).
VARIANTS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 21, 64, 1 << 22
_FP_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of the ``width``-word shingles of a text in UTF-8, A-Z lower-cased first."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of ``sizes`` hashes: a bit is set if it is in over half of a run's."""
    out = np.zeros(len(sizes), np.uint64)
    has = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(has):
        first = ends[has[lo]] - sizes[has[lo]]
        hi = max(lo + 1, int(np.searchsorted(ends[has], first + _COUNTED, "right")))
        own = has[lo:hi]
        counts = np.zeros((len(own), 64), np.int64)
        begins = ends[own] - sizes[own] - first
        part = hashes[first : ends[own[-1]]]
        if len(own) == 1:
            for k in range(0, len(part), _COUNTED):
                counts[0] += np.unpackbits(part[k : k + _COUNTED].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        else:
            counts = np.add.reduceat(np.unpackbits(part.view(np.uint8)).reshape(-1, 64), begins, axis=0, dtype=np.int64)
        out[own] = np.packbits(2 * counts > sizes[own][:, None], axis=1).reshape(-1).view(np.uint64)
        lo = hi
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, sizes = [], []
        for text in batch.column(2):
            own = np.array(shingle_hashes(text.as_py()), np.uint64)
            hashes.append(own)
            sizes.append(len(own))
        made = majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(sizes, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], schema=_FP_ARROW)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, row, fp`` for each row; ``fp`` holds the 64 bits as a long, ``row`` what ``row_col`` has or null."""
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    return docs.select(column(id_col).cast("long").alias("doc_id"), row, text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(_fingerprint, "doc_id long, row long, fp long")


class Balls:
    """Flip masks by parity of the fingerprint, and their linear hash of ``bits`` bits."""

    def __init__(self, bits: int) -> None:
        one = [1 << i for i in range(64)]
        two = [one[i] | one[j] for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
        self.rows = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, bits, np.uint64)
        self.of_parity = []
        for masks, core in ((one, [True] * 64), ([0, *one, *two], [True] * 65 + [False] * len(two))):
            m, c = np.array(masks, np.uint64), np.array(core)
            at = self.bucket(m)
            self.of_parity.append({int(s): (m[at == s], c[at == s]) for s in np.unique(at)})

    def bucket(self, values: np.ndarray) -> np.ndarray:
        """The linear hash: bit j is the parity of the bits that row j selects."""
        out = np.zeros(len(values), np.int64)
        for j, row in enumerate(self.rows):
            out |= (np.bitwise_count(values & row).astype(np.int64) & 1) << j
        return out

    def parts(self, fps: np.ndarray):
        """``(fingerprints, their own buckets, masks by bucket)`` of either parity."""
        odd = (np.bitwise_count(fps) & 1).astype(bool)
        for parity in (0, 1):
            own = fps[odd == bool(parity)]
            yield own, self.bucket(own), self.of_parity[parity]


def send(bits: int):
    """A function over batches of fingerprints that packs them by the buckets of their variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(bits)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            to, what = [], []
            for own, at, masks in balls.parts(fps):
                for s in masks:
                    to.append(at ^ s)
                    what.append(own)
            to, what = np.concatenate(to), np.concatenate(what)
            order = np.argsort(to, kind="stable")
            to, what = to[order], what[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            begins = np.concatenate([[0], cuts]) if len(to) else cuts
            ends = np.concatenate([cuts, [len(to)]]) if len(to) else cuts
            blobs = [what[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[begins], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "fps"])

    return run


def bucket_links(fps: np.ndarray, bucket: int, balls: Balls) -> np.ndarray:
    """Links ``(fingerprint, fingerprint)`` that the variants of one bucket show, as a spanning forest."""
    variants, members, cores = [], [], []
    for own, at, masks in balls.parts(fps):
        for s, (flips, core) in masks.items():
            here = own[at ^ s == bucket]
            variants.append((here[:, None] ^ flips[None, :]).ravel())
            members.append(np.repeat(here, len(flips)))
            cores.append(np.tile(core, len(here)))
    if not variants:
        return np.zeros((0, 2), np.uint64)
    v, m, c = np.concatenate(variants), np.concatenate(members), np.concatenate(cores)
    order = np.argsort(v, kind="stable")
    v = v[order]
    same = v[1:] == v[:-1]
    keep = np.zeros(len(v), bool)
    keep[1:] |= same
    keep[:-1] |= same
    v, order = v[keep], order[keep]
    if not len(v):
        return np.zeros((0, 2), np.uint64)
    m, c = m[order], c[order]
    begins = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.minimum.reduceat(np.where(c, m, none), begins)
    has_core = np.maximum.reduceat(c.astype(np.int8), begins).astype(bool)
    sizes = np.diff(np.concatenate([begins, [len(v)]]))
    rep, ok = np.repeat(least, sizes), np.repeat(has_core, sizes)
    links = np.stack([m, rep], axis=1)[ok & (m != rep)]
    links = np.unique(links, axis=0)
    links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= RADIUS]
    return _forest(links)


def _forest(links: np.ndarray) -> np.ndarray:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    kept = []
    for k, (a, b) in enumerate(links.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            kept.append(k)
    return links[kept]


def links_of(bits: int):
    """A function over the rows of one bucket that gives the links found there."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        fps = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("fps")]))
        links = bucket_links(fps, bucket, Balls(bits)).view(np.int64)
        return pa.table({"a": pa.array(links[:, 0].copy()), "b": pa.array(links[:, 1].copy())})

    return run


def similar_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all values of the column ``fp`` (distinct) at distance 3 or less."""
    expected = distinct.count() * (64 + 1057) / 2
    buckets = LEAST_BUCKETS
    while buckets * VARIANTS < expected and buckets < MOST_BUCKETS:
        buckets *= 2
    bits = buckets.bit_length() - 1
    sent = distinct.select("fp").mapInArrow(send(bits), "bucket long, fps binary")
    return sent.groupBy("bucket").applyInArrow(links_of(bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row ``doc_id, fingerprint, component_id``; the component's id is its least doc_id.

    With ``row_col`` also that column as ``row``, and ``root``, a number that the component's rows share.
    """
    prints = cut(fingerprints(docs, id_col, text_col, row_col), "simhash-prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = components(similar_fingerprints(distinct), "simhash-links")
    linked = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(of_root, "root").select("fp", "component_id", "root")
    named = cut(distinct.join(moved, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root")), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(["row", "root"] if row_col else []))
