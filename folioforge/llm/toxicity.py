"""Toxicity by noisy-channel deobfuscation.

A character language model, counted over all documents, gives the chance of each letter
after the two before it. A written word is a lattice: a digit or sign may stand for
letters that look like it, signs inside a word may be padding, and a letter that repeats may
be meant once or twice. A run of short pieces spaced apart is one lattice, in which each
gap is dropped or parts two words. Viterbi decoding takes the path that is likeliest under model and channel. A word of letters without a
threefold letter has just one path, itself, so it is not decoded. Signs at the ends of such a
word may be punctuation or look-alikes: it is read without them and, where one may stand
for a letter, with them too. The restored
text is scored by a logistic model on the presence of words and of word
beginnings; features and weights are learned from a bounded sample of labelled rows.

Defined cases: null and empty texts are scored by the model's base rate; a very long text is scored
as a whole, and a very long unbroken run is decoded with back-pointers, in time and memory that grow
with its length; rows with null ids count as held out; rows that repeat are scored alike; of paths
of equal chance the first found stays; extra columns play no part, whatever their names; an empty
table gives an empty result; without labels of both kinds every score is the share of label 1 (0
if there are none).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, cut, free_name, held_out, text_or_empty
from folioforge.llm.quality_gam import training_rows

#: Most labelled documents, and most features, that the classifier learns from.
SAMPLE, MOST_FEATURES, LEAST_DOCS = 30_000, 1500, 3
#: What a sign may stand for (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
PADDING = set(".-_*'~^`,:;/\\=#%&")
#: Log chances in the channel: a letter as itself, a look-alike, dropped padding, a letter of a run left out.
ITSELF, ALIKE, DROPPED, RUN = 0.0, -1.5, -1.0, -0.5
#: Letters of the model: a-z and those of U+00DF to U+00FF; 0 stands between words.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 1
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
_OF = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": 0}
#: Log chances that a gap in a run parts words, from likely to never; each gives a reading.
PARTED = (3.0, 0.0, -2.0, -4.0, -1e9)
#: Signs of pieces; all others part them. A question mark stands for what is not in Latin-1.
_PIECE = np.isin(np.arange(256), list((LETTERS + "".join(LOOKS) + "?").encode("latin-1")))
#: Most signs of a piece that is not one sign repeated, and least pieces of a run.
SHORT, LEAST_PIECES = 2, 3
_EDGE = "".join(PADDING) + "\"!?()[]{}<>|@$+"
#: Signs that may stand for letters or be punctuation.
_SIGNS = "".join(x for x in LOOKS if x in _EDGE)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter trigrams of all texts of a partition, as ``(code, n)``."""
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            codes = _CODE[np.frombuffer(f"  {text.as_py().lower()} ".encode("latin-1", "replace"), np.uint8)]
            grams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
            if len(grams) < SIZE**2:
                np.add.at(total, grams, 1)
            else:
                total += np.bincount(grams, minlength=SIZE**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["code", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log chances ``[before, last, next]`` of letters, from all documents; of a fixed size."""
    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(trigram_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3)
    found = counted.toArrow()
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pairs = counts.sum(axis=0)
    back = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * SIZE)
    return np.log((counts + 20 * back[None]) / (counts.sum(axis=2, keepdims=True) + 20)).astype(np.float32)


class Restorer:
    """Viterbi decoding of written words under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self._model = model.tolist()
        self._memo: dict[str, str] = {}

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each run of equal signs, what it may stand for and at what log chance."""
        out = []
        for run in re.finditer(r"(.)\1*", word, re.DOTALL):
            sign, n = run.group(1), len(run.group())
            ways = []
            for letter, cost in [(sign, ITSELF)] * (sign in _OF) + [(x, ALIKE) for x in LOOKS.get(sign, "")]:
                ways += [(letter * k, cost + RUN * (n - k)) for k in ({1, 2} if n > 2 else {n})]
            if sign in PADDING or not ways:
                ways.append(("", DROPPED))
            out.append(ways)
        return out

    @classmethod
    def spaced_lattice(cls, run: str) -> list[list[tuple[str, float]] | None]:
        """The lattice of pieces with a blank between; None is a gap, which is dropped or parts words."""
        out: list[list[tuple[str, float]] | None] = []
        pieces = run.split(" ")
        for k, piece in enumerate(pieces):
            if k:
                out.append(None)
            one = piece == piece[0] * len(piece)
            if len(piece) <= SHORT and piece[0] in _OF and piece[-1] in _OF:
                found = [[(piece, ITSELF)]]
            else:
                found = cls.lattice(piece)
            if not one:  # signs beside a letter may be punctuation
                for ways, sign in zip(found, piece if len(found) > 1 else "", strict=False):
                    if sign in _SIGNS:
                        ways.append(("", DROPPED))
            elif k and pieces[k - 1][0] == piece[0] and cls._repeats(pieces, k):
                found[0].append(("", RUN * len(piece)))
            out += found
        return out

    @staticmethod
    def _repeats(pieces: list[str], k: int) -> bool:
        """Whether the piece goes on a row of three or more of one sign."""

        def same(j: int) -> bool:
            return 0 <= j < len(pieces) and pieces[j] == pieces[k][0] * len(pieces[j])

        return same(k - 1) and (same(k - 2) or same(k + 1))

    def _likeliest(self, lattice: list[list[tuple[str, float]] | None], parted: float = 0.0) -> str:
        model, gap = self._model, [(" ", parted), ("", ITSELF)]
        best: dict = {(0, 0): (0.0, None)}
        for ways in lattice:
            after: dict = {}
            for (a, b), (value, path) in best.items():
                for letters, cost in ways or gap:
                    x, y, v = a, b, value + cost
                    for c in letters:
                        z = _OF[c]
                        v += model[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < v:
                        after[x, y] = (v, (path, letters) if letters else path)
            best = after
        path = max(((v + model[a][b][0], path) for (a, b), (v, path) in best.items()), key=lambda x: x[0])[1]
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))

    def _keep(self, word: str, made: str) -> str:
        if len(word) <= 40:
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[word] = made
        return made

    def decode(self, word: str) -> str:
        """The likeliest letters behind a written word."""
        if (known := self._memo.get(word)) is not None:
            return known
        return self._keep(word, self._likeliest(self.lattice(word)))

    def decode_spaced(self, run: str) -> set[str]:
        """The words of all readings of pieces with a blank between."""
        if (made := self._memo.get(run)) is None:
            lattice = self.spaced_lattice(run)
            made = self._keep(run, " ".join([self._likeliest(lattice, x) for x in PARTED]))
        return set(made.split())

    @staticmethod
    def spaced(low: str, signs: np.ndarray) -> Iterator[str]:
        """The runs of short pieces of a text, and in each those of single letters, with a blank between pieces."""
        piece = _PIECE[signs]
        edge = np.flatnonzero(np.diff(piece, prepend=False, append=False))
        begins, ends = edge[::2], edge[1::2]
        if len(begins) < LEAST_PIECES:
            return
        equal = np.concatenate([[0, 0], np.cumsum(signs[1:] == signs[:-1])])
        one = equal[ends] - equal[begins + 1] == ends - begins - 1
        short = one | (ends - begins <= SHORT)
        other = np.concatenate([[0], np.cumsum(signs == ord("?"))])
        short &= other[ends] == other[begins]
        if not (short[:-2] & short[1:-1] & short[2:]).any():
            return
        change = np.flatnonzero(np.diff(short, prepend=False, append=False))
        for lo, hi in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            if hi - lo >= LEAST_PIECES:
                pieces = [low[a:b] for a, b in zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                yield " ".join(pieces)
                inner = [list(g) for single, g in groupby(pieces, key=lambda p: p == p[0] * len(p)) if single]
                yield from (" ".join(g) for g in inner if LEAST_PIECES <= len(g) < len(pieces))

    @staticmethod
    def readings(word: str, core: str) -> set[str]:
        """The word with the signs at each end taken to be letters: none, the innermost, or all."""
        lo = word.index(core)
        hi = lo + len(core)
        left = max((word.rfind(x, 0, lo) for x in _SIGNS), default=-1)
        right = min((k for x in _SIGNS if (k := word.find(x, hi)) >= 0), default=-1)
        begins = {lo, left, 0} if left >= 0 else {lo}
        ends = {hi, right + 1, len(word)} if right >= 0 else {hi}
        return {word[a:b] for a in begins for b in ends} - {core}

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        low = text.lower()
        signs = np.frombuffer(low.encode("latin-1", "replace"), np.uint8)
        triple = bool(((signs[:-2] == signs[1:-1]) & (signs[1:-1] == signs[2:]) & (_CODE[signs[2:]] > 0)).any())
        found = set()
        apart = low.replace("?", " ")
        codes = apart.encode("latin-1", "replace")
        if b"?" in codes:
            apart = re.sub(r"\s", " ", apart)
            codes = apart.encode("latin-1", "replace")
        for run in self.spaced(apart, np.frombuffer(codes, np.uint8)):
            found.update(self.decode_spaced(run))
        signed = any(x in low for x in _SIGNS)
        for word in set(low.split()):
            core = word if word.isalpha() else word.strip(_EDGE)
            if core.isalpha() and not (triple and _TRIPLE.search(core)):
                found.add(core)
            elif word:
                found.add(self.decode(word))
                if core != word and core:
                    found.add(self.decode(core))
            if signed and core and core != word:
                found.update(self.decode(x) for x in self.readings(word, core))
        found.discard("")
        return found


def features_of(words: set[str]) -> set[str]:
    """Presence features: each word, and its beginning with its length."""
    return words | {f"{w[:5]}~{min(len(w), 12)}" for w in words} | {f"{w[:4]}~" for w in words}


@dataclass
class Toxicity:
    """The letters' model and the weights of features."""

    letters: np.ndarray
    base: float
    weights: dict[str, float]

    def score(self, restorer: Restorer, text: str) -> float:
        """The chance that a text is toxic."""
        total = self.base + sum([self.weights.get(f, 0.0) for f in features_of(restorer.words(text))])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, total))))


def _count_features(letters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(letters), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                seen[label].update(features_of(restorer.words(text.as_py())))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], names=["feature", "pos", "neg"])

    return run


def _present(letters: np.ndarray, names: list[str]):
    at = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in batches:
            rows = [sorted(at[f] for f in features_of(restorer.words(t.as_py())) if f in at) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "at", "label"])

    return run


def fit_weights(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, size: int, damping: float = 1.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression on sparse presences, by Adam over all rows; the base rate is not damped."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, base, n = np.zeros(size), math.log(share / (1 - share)), len(y)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(base + np.bincount(rows, w[columns], n))))
        g = np.append(np.bincount(columns, (p - y)[rows], size) + damping * w, (p - y).sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, base = w - step[:-1], base - step[-1]
    return base, w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Count the letters over all documents, then learn from a bounded sample of labelled ones."""
    letters = language_model(docs, text_col)
    rows = cut(training_rows(docs, labels, label, sample, id_col, text_col), "toxicity-sample")  # read three times
    sums = rows.groupBy("label").count().collect()
    by = {r["label"]: r["count"] for r in sums}
    pos, neg = by.get(1, 0), by.get(0, 0)
    if not pos or not neg:
        return Toxicity(letters, 60.0 if pos else -60.0, {})
    counted = rows.mapInArrow(_count_features(letters), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos + neg >= {LEAST_DOCS}")
    share = pos / (pos + neg)
    spread = F.sqrt((F.col("pos") + F.col("neg") + 1) * (share * (1 - share)))
    names = [r["feature"] for r in counted.withColumn("z", F.abs(F.col("pos") - (F.col("pos") + F.col("neg")) * share) / spread).where("z > 2.5").orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()]
    # At most as many rows as the sample has; they are ordered here, as a distributed sort would make them twice.
    table = rows.mapInArrow(_present(letters, names), "doc_id long, at array<int>, label int").toArrow().to_pydict()
    at, y = zip(*[(a, label) for _, a, label in sorted(zip(table["doc_id"], table["at"], table["label"], strict=True))], strict=True)
    r = np.repeat(np.arange(len(at)), [len(x) for x in at])
    base, w = fit_weights(r, np.array([x for row in at for x in row], np.int64), np.array(y, np.float64), len(names))
    return Toxicity(letters, base, dict(zip(names, w.tolist(), strict=True)))


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.score(restorer, t.as_py()) for t in batch.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def restored(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_restored``, the distinct restored words, sorted."""

    @F.pandas_udf("array<string>")
    def run(texts):
        own = Restorer(model.letters)
        return texts.map(lambda t: sorted(own.words(t)))

    return docs.select("*", run(text_or_empty(text_col)).alias(free_name(docs, "_restored")))
