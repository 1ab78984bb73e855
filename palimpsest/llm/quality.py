"""Quality: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Shallow trees of three leaves, boosted cyclically over the features with a
small learning rate, add up to one look-up table a feature; then trees of one cut on each of two features do the same
for the pairs of largest gain. A text is scored by adding the entries of its bins, vectorised over a batch.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import LETTER, NUMBER, OTHER, SPACE, Words, bounded_sample, crc_mod, map_arrow, mix, texts_of

#: Labelled documents that the model is fitted on, at most (a sample by hash of doc_id).
MAX_TRAIN = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 32, 80, 6, 40, 0.2, 2.0
REJECT_BELOW = 0.7

FEATURES = ("log_chars", "log_words", "word_length", "upper_share", "symbol_share", "digit_share", "space_share", "symbol_run", "distinct_words", "adjacent_repeats", "distinct_trigrams", "distinct_lines", "words_per_stop", "lone_symbols", "attached_runs")


@functools.cache
def upper_table() -> np.ndarray:
    return np.array([chr(c).isupper() for c in range(0x110000)] + [False])


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES a text, computed over the whole of it; an empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    w = Words(texts)
    kinds, points = w.kinds, w.points
    begin = np.r_[0, w.marks[:-1] + 1]
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), begin).astype(float)  # noqa: E731  the end mark counts too
    real = np.ones(len(points), bool)
    real[w.marks] = False
    symbol = (kinds == OTHER) & real
    before, after = np.r_[False, symbol[:-1]], np.r_[symbol[1:], False]
    blank = (kinds >= SPACE) | ~real
    blank_before, blank_after = np.r_[True, blank[:-1]], np.r_[blank[1:], True]
    chars, words = np.maximum(w.marks - begin, 0).astype(float), w.counts.astype(float)
    letters, symbols = per_text(kinds == LETTER), per_text(symbol)
    some = lambda x: np.maximum(x, 1)
    h, doc = w.hashes, w.doc.astype(np.uint64)
    trigram = mix(h[2:] + np.uint64(3) * h[1:-1] + np.uint64(7) * h[:-2]) if len(h) > 2 else h[:0]
    inside = w.doc[2:] == w.doc[:-2]
    same = np.bincount(w.doc[1:][(h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    lines = [t.split("\n") for t in texts]
    out[:, 0], out[:, 1] = np.log1p(chars), np.log1p(words)
    out[:, 2] = per_text(kinds <= NUMBER) / some(words)
    out[:, 3] = per_text(upper_table()[points]) / some(letters)
    out[:, 4] = symbols / some(chars)
    out[:, 5] = per_text(kinds == NUMBER) / some(chars)
    out[:, 6] = per_text(kinds >= SPACE) / some(chars)
    out[:, 7] = symbols / some(per_text(symbol & ~before))
    out[:, 8] = distinct(h, doc, n) / some(words)
    out[:, 9] = same / some(words)
    out[:, 10] = distinct(trigram[inside], doc[2:][inside], n) / some(np.maximum(words - 2, 0)) if len(h) > 2 else 0
    out[:, 11] = [len(set(x)) / len(x) for x in lines]
    out[:, 12] = words / some(per_text((points == 0x2E) & real))
    out[:, 13] = per_text(symbol & ~before & ~after & blank_before & blank_after) / some(words)
    out[:, 14] = per_text(symbol & ~before & after & ~blank_before) / some(words)
    out[chars == 0] = 0
    return out


def distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each text."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    return np.bincount(doc[fresh].astype(np.int64), minlength=n)


@dataclass
class AdditiveModel:
    offset: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.offset)
        for f, t in enumerate(self.tables):
            z += t[bins[:, f]]
        for (a, b), t in self.pairs.items():
            z += t[bins[:, a], bins[:, b]]
        return z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(self.bins(x)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gain(g, h):
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of every bin of the best tree with two cuts, the second cut chosen after the first."""
    cuts = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            m = np.arange(a + 1, b)
            if len(m):
                value = gain(cg[m] - cg[a], ch[m] - ch[a]) + gain(cg[b] - cg[m], ch[b] - ch[m]) - gain(cg[b] - cg[a], ch[b] - ch[a])
                if (i := int(value.argmax())) >= 0 and value[i] > best[0]:
                    best = value[i], int(m[i])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def quadrant_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut along each of the two axes."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = pad(g), pad(h)
    parts = lambda c: [c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1]]
    pg, ph = parts(cg), parts(ch)
    value = sum(gain(a, b) for a, b in zip(pg, ph)) - gain(cg[-1, -1], ch[-1, -1])
    out = np.zeros(g.shape)
    if not value.size:
        return 0.0, out
    i, j = np.unravel_index(int(value.argmax()), value.shape)
    leaf = [float(a[i, j] / (b[i, j] + RIDGE)) for a, b in zip(pg, ph)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(value[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables; with one class or no rows, a constant."""
    n, rate = len(x), float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-6, 1 - 1e-6))
    model = AdditiveModel(offset=float(np.log(rate / (1 - rate))))
    if not n or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    z = np.full(n, model.offset)
    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            p, b = sigmoid(z), bins[:, f]
            step = RATE * shallow_tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            z += step[b]
    p = sigmoid(z)
    flat = lambda a, b: bins[:, a] * len(model.tables[b]) + bins[:, b]
    sums = lambda a, b, v: np.bincount(flat(a, b), v, len(model.tables[a]) * len(model.tables[b])).reshape(len(model.tables[a]), -1)
    gains = sorted(((-quadrant_tree(sums(a, b, y - p), sums(a, b, p * (1 - p)))[0], (a, b)) for a, b in combinations(range(x.shape[1]), 2)))
    chosen = [pair for value, pair in gains[:PAIRS] if value < 0]
    model.pairs = {(a, b): np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in chosen}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            p = sigmoid(z)
            step = RATE * quadrant_tree(sums(a, b, y - p), sums(a, b, p * (1 - p)))[1]
            table += step
            z += step[bins[:, a], bins[:, b]]
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> AdditiveModel:
    """Fit on documents with a label whose crc32(doc_id) mod 4 is not 2.

    Broadcast: at most ``max_train`` labels. Collected: their documents' feature rows.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("doc_id", (F.col("quality") > 0).alias("y"))
    known = bounded_sample(known, "doc_id", max_train)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = map_arrow(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("y", "text"), run, "y boolean, x array<double>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the fit does not depend on the order in which rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of each row. A null or an empty text scores as one with all features 0.

    Rows are scored one by one: repeated rows score alike, further columns are dropped, an empty table stays empty.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(features(texts_of(batch.column(1)))), pa.float64())], [key, "score"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document.

    Null and empty texts score as texts with all features 0. A null doc_id is scored, and never a label's. Repeated rows
    score alike. Without labels every score is 0.5, with labels of one class near that class. An empty table gives no
    rows; further columns are not read.
    """
    return score(docs, train(docs, labels)).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that score REJECT_BELOW or more.

    Null and empty texts are scored like others, repeated rows stay or go together, columns of any name and rows without
    doc_id pass through, an empty table stays empty.
    """
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.predict(features(texts_of(batch.column(at)))) >= REJECT_BELOW))

    return map_arrow(docs, run, docs.schema)
