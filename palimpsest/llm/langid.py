"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of 64-bit words holds a Bloom filter for each language: bit l of a row belongs to language l, and a row has as
many words as the languages need. The AND of the rows that an n-gram's hashes address is a mask of all languages that
contain it. A text's languages are counted bit by bit
over its n-grams, the expected false positives of each filter are taken off, and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import LETTER, bounded_sample, class_table, crc_mod, joined_codepoints, map_arrow, mix, texts_of

#: Documents that the filters are fitted on, at most (a sample by hash of doc_id).
MAX_TRAIN = 20_000
ORDERS = (1, 2, 3)
ROWS, HASHES = 1 << 18, 3
#: A language contains an n-gram that makes up this share of its n-grams of that order: 1 / LEAST_SHARE n-grams at most.
LEAST_SHARE = 2e-5
UNDETERMINED = "und"
BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def ngrams(texts: list[str]):
    """For each order the n-grams' hashes and the index of their text; and whether each text has a letter.

    Letters are taken in lower case; every run of other characters is one boundary, which an n-gram may begin or end with.
    """
    _, points, marks = joined_codepoints([t.lower() for t in texts])
    if not len(points):
        return [], np.zeros(0, bool)
    letter = class_table()[points] == LETTER
    symbol = np.where(letter, points, 0)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[-1, marks]))
    keep = letter | np.r_[True, letter[:-1]] | (np.r_[True, doc[1:] != doc[:-1]])
    symbol, doc = symbol[keep].astype(np.uint64), doc[keep]
    has = np.zeros(len(texts), bool)
    has[doc[symbol > 0]] = True
    out, acc = [], np.zeros(len(symbol), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        acc = symbol.copy() if n == 1 else acc[:-1] * np.uint64(0x100000001B3) + symbol[n - 1 :]
        if n in ORDERS and len(acc):
            size = len(acc)
            good = doc[:size] == doc[n - 1 :]
            good &= symbol[:size] > 0 if n == 1 else np.ones(size, bool)
            for j in range(1, n - 1):  # no boundary inside
                good &= symbol[j : j + size] > 0
            if n == 2:
                good &= (symbol[:size] > 0) | (symbol[1 : 1 + size] > 0)
            out.append((mix(acc[good] * np.uint64(8) + np.uint64(n)), doc[:size][good]))
    return out, has


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def rows_of(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(20 * i)) & np.uint64(ROWS - 1)).view(np.int64) for i in range(HASHES)]

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(members)
        table = np.zeros((ROWS, max(1, -(-len(languages) // 64))), np.uint64)
        for bit, lang in enumerate(languages):
            for rows in cls.rows_of(members[lang]):
                table[np.unique(rows), bit // 64] |= np.uint64(1 << bit % 64)
        return cls.of_table(languages, table)

    @classmethod
    def of_table(cls, languages: list[str], table: np.ndarray) -> LanguageFilters:
        fill = np.array([((table[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(languages))])
        return cls(languages, table, fill**HASHES)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits of one or more words."""
        a, *more = self.rows_of(h)
        out = self.table[a]
        for rows in more:
            out &= self.table[rows]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with the largest corrected count (of equals the first by name), and its share of all languages' counts."""
        found, has = ngrams(texts)
        n, k = len(texts), len(self.languages)
        if not k or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        counts, total = np.zeros((n, k)), np.zeros(n)
        for h, doc in found:
            masks = self.masks(h)
            total += np.bincount(doc, minlength=n)
            for low in range(0, k, 8):  # eight languages at a time: texts by byte of the mask, then by bit
                byte = ((masks[:, low // 64] >> np.uint64(low % 64)) & np.uint64(255)).astype(np.int64)
                by_byte = np.bincount(doc * 256 + byte, minlength=n * 256).reshape(n, 256)
                counts[:, low : low + 8] += (by_byte @ BITS)[:, : k - low]
        counts = np.maximum(counts - total[:, None] * self.false_positive, 0) / (1 - np.minimum(self.false_positive, 0.999))
        best, all_counts = counts.argmax(1), counts.sum(1)
        share = np.where(has & (all_counts > 0), counts.max(1) / np.maximum(all_counts, 1e-9), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has)], np.clip(share, 0, 1)


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> LanguageFilters:
    """Learn from text and lang of documents with a lang whose crc32(doc_id) mod 3 is not 1.

    Which n-grams a language contains is decided for each language alone, by their shares, and the filters' bits are
    set by an aggregation. Collected: the names of the languages, and ROWS rows of the table for each 64 of them.
    Without such documents there is no language, and all texts are ``und``.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1)).select("doc_id", "lang", "text")
    known = bounded_sample(known, "doc_id", max_train).select("lang", "text")

    def run(batch: pa.RecordBatch) -> pa.Table:
        langs, texts = np.array(batch.column(0).to_pylist(), object), texts_of(batch.column(1))
        names, index = np.unique(langs.astype(str), return_inverse=True)
        out = []
        for order, (h, doc) in zip(ORDERS, ngrams(texts)[0]):
            for i, name in enumerate(names):
                values, counts = np.unique(h[index[doc] == i], return_counts=True)
                out.append(pa.table([pa.array([name] * len(values), pa.string()), pa.array(np.full(len(values), order, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "ord", "ngram", "n"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["lang", "ord", "ngram", "n"])

    counts = map_arrow(known, run, "lang string, ord int, ngram bigint, n bigint").groupBy("lang", "ord", "ngram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = counts.groupBy("lang", "ord").agg(F.sum("n").alias("total")).collect()  # a row for each language and order
        languages = sorted({r.lang for r in totals})
        if not languages:
            return LanguageFilters([], np.zeros((ROWS, 1), np.uint64), np.zeros(0))
        known = docs.sparkSession.createDataFrame([(r.lang, r.ord, r.total, languages.index(r.lang)) for r in totals], "lang string, ord int, total bigint, bit int")
        own = counts.join(F.broadcast(known), ["lang", "ord"]).where(F.col("n") >= F.col("total") * LEAST_SHARE)
        places = F.array(*[F.shiftrightunsigned("ngram", 20 * i).bitwiseAND(ROWS - 1) for i in range(HASHES)])
        words = own.select(F.explode(places).alias("row"), F.expr("bit DIV 64").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("flag")).groupBy("row", "word").agg(F.bit_or("flag").alias("flags")).toArrow()
    finally:
        counts.unpersist()
    table = np.zeros((ROWS, -(-len(languages) // 64)), np.uint64)
    table[words["row"].to_numpy(), words["word"].to_numpy()] = words["flags"].to_numpy().view(np.uint64)
    return LanguageFilters.of_table(languages, table)


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of each row; ``und`` and 0 for a text that is null or has no letter.

    Rows are handled one by one: repeated rows are alike, further columns are dropped, an empty table stays empty.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, share = filters.predict(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(share, pa.float64())], [key, "lang_pred", "score"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each document.

    Texts that are null or have no letter are ``und`` with score 0. Repeated rows are alike, and count as often as they
    occur when the filters are learnt. A null doc_id is predicted and learnt like any other. Of languages with equal
    counts the first by name wins. An empty table gives no rows; further columns are not read.
    """
    return identify(docs, train(docs)).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
