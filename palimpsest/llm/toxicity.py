"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

1. *Log-odds with a Dirichlet prior.* Over a bounded sample of labelled documents (near copies count once), each
   token's log-odds between toxic and clean documents has the corpus frequency as an informative Dirichlet prior.
   A token scores the log-odds less Z standard deviations if that is positive; any other token scores ``-drift``.
2. *Segments.* All maximal scoring segments of the token sequence in linear time: one pass with a stack, in which
   runs of negative tokens are single steps.
3. *Extreme values.* With the background frequencies p of the scores, of clean text with all documents as prior, lambda
   solves ``sum p exp(lambda s) = 1``; K is approximated by the chance that a token opens a segment. A segment of score S in n tokens has ``E = K n exp(-lambda S)``. The r best segments together have the sum statistic
   ``lambda * (S1 + .. + Sr) - r ln(K n) + ln r!``; a document takes the largest, and a logistic curve fitted on the
   sample turns it into a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import Words, bounded_sample, crc_mod, map_arrow, shingle_hashes, texts_of

#: Labelled documents that the model is fitted on, at most (a sample by hash of doc_id).
MAX_TRAIN = 20_000
#: Weight of the Dirichlet prior in documents; standard deviations taken off; fewest toxic documents of a token.
PRIOR, Z, LEAST = 500.0, 2.0, 3
#: Costs of a neutral token that training chooses from.
DRIFTS = (0.02, 0.05, 0.1, 0.2, 0.5)
#: The statistic of a document without any positive token, and its bound above.
NOTHING, HIGHEST = -12.0, 60.0


@dataclass
class ToxicModel:
    """Token scores by hash of the lower-case token, and the calibration."""

    lexicon: dict[int, float] = field(default_factory=dict)
    drift: float = 0.1
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        items = sorted(self.lexicon.items())
        self.keys = np.array([a for a, _ in items], np.uint64)
        self.values = np.array([b for _, b in items], np.float64)

    def positives(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Indices of words with a positive score, and these scores."""
        h = words.hashes
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        return hit, self.values[at[hit]]

    def statistic(self, segments: list[tuple[int, int, float]], n: int) -> float:
        if not segments:
            return NOTHING
        cost, total, best = math.log(max(self.k * n, 1e-9)), 0.0, NOTHING
        for r, s in enumerate(sorted((s for *_, s in segments), reverse=True), 1):
            total += self.lam * s
            best = max(best, total - r * cost + math.lgamma(r + 1))
        return min(best, HIGHEST)

    def probability(self, x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(x, float) + self.offset, -50, 50)))

    def documents(self, texts: list[str]):
        """For each text its segments (first word, last word, score), its words' positions and the statistic."""
        words = Words(texts)
        hit, value = self.positives(words)
        bound = np.searchsorted(hit, words.first)
        out = []
        for i in range(len(texts)):
            a, b = bound[i], bound[i + 1]
            segments = maximal_segments((hit[a:b] - words.first[i]).tolist(), value[a:b].tolist(), self.drift) if b > a else []
            out.append((segments, self.statistic(segments, int(words.counts[i]))))
        return words, out


def maximal_segments(position: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), given the positive items; every other item costs ``drift``.

    Each candidate on the stack keeps the cumulative score before and after it. A new item joins with the nearest
    candidate that starts lower than it, as long as that one ends lower than the new one; each item enters and leaves
    the stack once, apart from the search, which follows links over candidates that start no lower.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link to the nearest lower start
    total, seen = 0.0, 0
    for p, s in zip(position, score):
        total -= drift * (p - seen)
        first, before, after = p, total, total + s
        total, seen = after, p + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, p, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y, _ in stack]


def token_counts(batch: pa.RecordBatch) -> pa.Table:
    """From (toxic, text): document counts of tokens of this slice, as hash, toxic documents, clean documents."""
    toxic = np.array(batch.column(0).to_pylist(), bool)
    words = Words(texts_of(batch.column(1)))
    pair = np.unique(np.stack([words.hashes, words.doc.astype(np.uint64)]), axis=1) if len(words.hashes) else np.zeros((2, 0), np.uint64)
    token, inverse = np.unique(pair[0], return_inverse=True)
    y = toxic[pair[1].astype(np.int64)]
    counts = [np.bincount(inverse, w, len(token)).astype(np.int64) for w in (y, ~y)]
    return pa.table([token.view(np.int64), *counts], ["token", "toxic", "clean"])


def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds the least of a text's 3-word shingle hashes; texts without words get 0."""
    words = Words(texts_of(batch.column(1)))
    values, bounds = shingle_hashes(words, 3)
    least = [int(values[a]) if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:])]  # each text's hashes are sorted
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(least, np.uint64).view(np.int64))], ["toxic", "text", "sketch"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicModel:
    """Fit on documents with a label whose crc32(doc_id) mod 5 is not 0; without both classes, a model that rejects nothing.

    Of labelled documents of one class that share a sketch, the text of least digest counts. Broadcast and collected: at
    most ``max_train`` labels, the tokens of these documents that occur in LEAST toxic ones, and one statistic a labelled document.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    known = bounded_sample(known, "doc_id", max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text")
    sample = map_arrow(sample, sketch, "toxic boolean, text string, sketch bigint").groupBy("sketch", "toxic").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("toxic", "text").persist()
    try:
        nt, nc = sample.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)), F.coalesce(F.sum((~F.col("toxic")).cast("int")), F.lit(0))).first()
        if not nt or not nc:
            return ToxicModel(offset=-50.0 if not nt else 50.0, slope=0.0)
        a0 = PRIOR
        counts = map_arrow(sample, token_counts, "token bigint, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        prior = (F.col("t") + F.col("c")) * a0 / (nt + nc)
        odds = F.log((F.col("t") + prior) / (nt + a0 - F.col("t") - prior + 1)) - F.log((F.col("c") + prior) / (nc + a0 - F.col("c") - prior + 1))
        score = odds - Z * F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
        rows = counts.where(F.col("t") >= LEAST).select("token", score.alias("score")).where("score > 0").orderBy("token").collect()
        lexicon = {r.token % (1 << 64): r.score for r in rows}
        p, s = background(docs, sample, ToxicModel(lexicon))
        best = None
        for drift in DRIFTS:
            lam, k = karlin_altschul(p, s, drift)
            model = ToxicModel(lexicon, drift, lam, k)
            x, y = statistics(sample, model)
            slope, offset = logistic(x, y)
            model.slope, model.offset = slope, offset
            q = np.clip(model.probability(x), 1e-9, 1 - 1e-9)
            loss = float(-np.mean(np.where(y, np.log(q), np.log(1 - q))))
            if best is None or loss < best[0] - 1e-6:
                best = loss, model
        return best[1]
    finally:
        sample.unpersist()


def occurrences(texts: DataFrame, model: ToxicModel) -> tuple[np.ndarray, int, int]:
    """How often each lexicon token occurs, and the numbers of tokens and of documents. Collected: one count for each of them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(texts_of(batch.column(0)))
        hit, _ = model.positives(words)
        token, n = np.unique(words.hashes[hit], return_counts=True)
        kind = np.r_[1, 2, np.zeros(len(token), np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.r_[np.zeros(2, np.int64), token.view(np.int64)]), pa.array(np.r_[len(words.starts), batch.num_rows, n].astype(np.int64))], ["kind", "token", "n"])

    rows = map_arrow(texts.select("text"), run, "kind int, token bigint, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n")).collect()
    found = {(r.kind, r.token): r.n for r in rows}
    return np.array([found.get((0, int(k)), 0) for k in model.keys.view(np.int64)], np.float64), found.get((1, 0), 0), found.get((2, 0), 0)


def background(docs: DataFrame, sample: DataFrame, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    """Frequency of each lexicon token in clean text, and its score.

    The clean documents of the sample are counted, with the frequencies among the tokens of all documents as a Dirichlet
    prior of PRIOR documents' weight.
    """
    every, tokens, n = occurrences(docs, model)
    clean, clean_tokens, _ = occurrences(sample.where("NOT toxic"), model)
    weight = PRIOR * tokens / max(n, 1)
    return (clean + weight * every / max(tokens, 1)) / max(clean_tokens + weight, 1), model.values


def statistics(sample: DataFrame, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, found = model.documents(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for _, x in found], pa.float64())], ["y", "x"])

    rows = map_arrow(sample, run, "y boolean, x double").groupBy("y", "x").count().collect()
    return np.repeat([r.x for r in rows], [r["count"] for r in rows]), np.repeat([r.y for r in rows], [r["count"] for r in rows])


def karlin_altschul(p: np.ndarray, s: np.ndarray, drift: float) -> tuple[float, float]:
    """lambda, the positive root of ``sum p exp(lambda s) + (1 - sum p) exp(-lambda drift) = 1``, and K, the expected
    number of segments a token that reach a score x, over ``exp(-lambda x)``."""
    if not len(p):
        return 1.0, 1.0
    rest = max(1 - p.sum(), 1e-9)
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(-x * drift) - 1)
    low, high = 1e-4, 1.0
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if f(mid) > 0 else (mid, high)
    return high, float((p * np.exp(np.minimum(high * s, 700))).sum())


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    a, b, y = 0.0, 0.0, y.astype(float)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * x).sum() + 1e-2 * a, (q - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def score(docs: DataFrame, model: ToxicModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``passages``: array of (start, stop, score, evalue), start and stop in characters.

    ``passages`` has every significant segment (E-value below 1). Null and empty texts have none and score as a text
    without toxic tokens. Rows are scored one by one: repeated rows score alike, further columns are dropped.
    """
    kind = df_type(docs, key)
    passage = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, found = model.documents(texts_of(batch.column(1)))
        base = np.r_[0, words.marks[:-1] + 1] if len(found) else []
        passages = []
        for i, (segments, _) in enumerate(found):
            n, first = max(int(words.counts[i]), 1), words.first[i]
            rows = [{"start": int(words.starts[first + a] - base[i]), "stop": int(words.ends[first + b] - base[i]), "score": s, "evalue": model.k * n * math.exp(-min(model.lam * s, 700))} for a, b, s in segments]
            passages.append([r for r in rows if r["evalue"] < 1])
        p = model.probability([x for _, x in found])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(passages, pa.list_(passage))], [key, "score", "passages"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, score double, passages array<struct<start: bigint, stop: bigint, score: double, evalue: double>>")


def df_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the number of significant passages of each document.

    Null and empty texts score as a text without toxic tokens. A null doc_id is scored, and never a label's. Repeated rows
    score alike, near copies among labelled documents count once. Without labels of both classes nothing, or everything if
    all are toxic, is toxic. An empty table gives no rows; further columns are not read.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that are not rejected as toxic. The text travels through the scorer; nothing is joined.

    Null and empty texts stay unless training says that all is toxic; repeated rows stay or go together; columns of any
    name and rows without doc_id pass through; an empty table stays empty.
    """
    model = train(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, found = model.documents(texts_of(batch.column(at)))
        return batch.filter(pa.array(model.probability([x for _, x in found]) < 0.5))

    return map_arrow(docs, run, docs.schema)
