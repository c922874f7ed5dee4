"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit grows one shallow tree on the
binned feature against the current residuals and adds its leaves, shrunk, to the
feature's lookup table. Then the pairs of features that explain most of what is left
get tables of their own, boosted in the same way. A score is a sum of table entries,
found for a whole batch of documents by binning and indexing.

The model learns from at most ``SAMPLE`` labelled documents, the ones with the least hashes of
their ids; the forest of tables has a fixed size, so it is fitted on the driver.

Defined cases: null and empty texts have all features 0 and are scored like any other; a very
long text is scored as a whole; rows with null ids count as held out; labels without documents,
and rows that repeat, are taken as they are; of ties in the order of the sample, all rows are equal;
extra columns play no part, whatever their names; an empty table gives an empty result; without
any labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, held_out, text_or_empty

#: Most labelled documents that a model learns from.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAF_ROWS, DAMPING = 80, 40, 0.15, 8, 1.0
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "stops", "beyond_ascii",
    "distinct_words", "distinct_pairs", "repeated_lines", "log_line_words", "packed", "short_words",
)

_CLASS = np.zeros(256, np.int64)
for _signs, _code in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"#*$%&|<>", 4), (b"!?", 5), (b".,;:", 6), (range(128, 256), 7), (b" \t\n\r\x0b\x0c", 8)):
    for _sign in _signs:
        _CLASS[_sign] = _code


def features(text: str) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9)
    n, letters = len(words), kinds[1] + kinds[2] + kinds[7]
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), (len(raw) - kinds[8]) / n, kinds[1] / max(letters, 1), kinds[3] / len(raw), kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / len(raw),
        len(set(words)) / n, pairs / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))), len(zlib.compress(raw, 1)) / len(raw),
        sum([len(w) < 4 for w in words]) / n,
    ]


def feature_matrix(texts: pa.Array) -> np.ndarray:
    """One row of features for each text of a batch."""
    return np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + DAMPING))


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; gain 0 if there is none."""
    if len(g) < 2:
        return 0.0, 0
    a, b, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    ga, ha = a**2 / (b + DAMPING), (g.sum() - a) ** 2 / (h.sum() - b + DAMPING)
    gain = np.where((c >= LEAF_ROWS) & (n.sum() - c >= LEAF_ROWS), ga + ha - g.sum() ** 2 / (h.sum() + DAMPING), 0.0)
    at = int(np.argmax(gain))
    return max(0.0, float(gain[at])), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree of ``depth`` on one feature's sums of gradients, curvatures and rows."""
    gain, at = _cut(g, h, n)
    if depth == 0 or gain <= 1e-9:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([shallow_tree(g[:at], h[:at], n[:at], depth - 1), shallow_tree(g[at:], h[at:], n[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values by cell and the gain of a tree that cuts one feature, then the other on each side."""
    best, out = 0.0, np.full(g.shape, _leaf(g, h))
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        for at in range(1, len(a)):
            total, sides = 0.0, []
            for part in (slice(0, at), slice(at, None)):
                ga, hb, nc = a[part].sum(axis=0), b[part].sum(axis=0), c[part].sum(axis=0)
                gain, cut = _cut(ga, hb, nc)
                total += gain + ga.sum() ** 2 / (hb.sum() + DAMPING)
                sides.append((part, cut if gain else 0, ga, hb))
            total -= a.sum() ** 2 / (b.sum() + DAMPING)
            if total > best:
                best, out = total, np.empty(a.shape)
                for part, cut, ga, hb in sides:
                    out[part, :cut] = _leaf(ga[:cut], hb[:cut]) if cut else 0
                    out[part, cut:] = _leaf(ga[cut:], hb[cut:])
                out = out.T if flip else out
    return out, best


@dataclass
class Gam:
    """Edges of bins, a table for each feature, and a table for each chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit by cyclic boosting, main tables first, then the best pairs."""
    d = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Gam(float(np.log(share / (1 - share))), [_edges(x[:, k], BINS) for k in range(d)], [], [_edges(x[:, k], PAIR_BINS) for k in range(d)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)
    sums = lambda bins, size, p: (np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size), np.bincount(bins, minlength=size))
    chance = lambda: 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for k in range(d):
            step = RATE * shallow_tree(*sums(at[k], len(model.tables[k]), chance()))
            model.tables[k] += step
            total += step[at[k]]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    cells = lambda a, b: coarse[a] * sizes[b] + coarse[b]
    grid = lambda a, b: [s.reshape(sizes[a], sizes[b]) for s in sums(cells(a, b), sizes[a] * sizes[b], chance())]
    ranked = sorted(((pair_tree(*grid(a, b))[1], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * pair_tree(*grid(a, b))[0]
            table += step
            total += step.ravel()[cells(a, b)]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, label`` of at most ``sample`` labelled rows that may be learned from."""
    chosen = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    own = docs.select(column(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(feature_matrix(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fit the model on a bounded sample of labelled documents."""
    rows = training_rows(docs, labels, label, sample, id_col, text_col).select("text", "label")
    table = rows.mapInArrow(_features_of, "x array<double>, label int").toArrow()
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.array(table.column("label").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the same model whatever order rows arrive in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(feature_matrix(batch.column(2))))], names=["doc_id", "held_out", "score"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
