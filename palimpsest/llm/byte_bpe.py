"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Pre-token boundaries come from a finite automaton over code-point classes. Each class acts on the
automaton's states as a function; these functions form a small monoid, so the state before every
character is an associative scan of monoid elements, done for a whole batch of texts with table
look-ups on arrays. No regular expression runs over the text.
"""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import LETTER, NUMBER, SPACE, WHITE, class_table, joined_codepoints, map_arrow, texts_of

# Input symbols: a code point's class, an apostrophe that can open a contraction of 2 or 3 characters, a text's end.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_QUOTE2, S_QUOTE3, S_END = range(8)
# States: what the character just read belongs to. REST1, REST2: a contraction lacks 1 or 2 characters; FRESH: nothing.
IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_SPACE, AT_WHITE, REST1, REST2, FRESH = range(8)

# The contractions of the public pre-tokenisation pattern, after the apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

#: Pre-tokens whose ids a Python worker keeps; the store is emptied when it is full.
CACHE_ENTRIES = 300_000
#: Pieces of at most this many bytes merge by scanning a list of pair ranks, longer ones by a heap.
SHORT_PIECE = 48


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, the table of compositions (first, second), and each element's image of FRESH."""
    states = range(8)
    generators = {
        S_LETTER: tuple(REST1 if s == REST2 else FRESH if s == REST1 else IN_LETTERS for s in states),
        S_NUMBER: (IN_NUMBERS,) * 8,
        S_OTHER: (IN_OTHER,) * 8,
        S_SPACE: (AT_SPACE,) * 8,
        S_WHITE: (AT_WHITE,) * 8,
        S_QUOTE2: tuple(IN_OTHER if s in (IN_OTHER, AT_SPACE) else REST1 for s in states),
        S_QUOTE3: tuple(IN_OTHER if s in (IN_OTHER, AT_SPACE) else REST2 for s in states),
        S_END: (FRESH,) * 8,
    }
    elements = {tuple(states): 0}
    todo = [tuple(states)]
    while todo:
        f = todo.pop()
        for g in generators.values():
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    table = np.zeros((len(elements), len(elements)), np.int32)
    for f, i in elements.items():
        for g, j in elements.items():
            table[i, j] = elements[tuple(g[x] for x in f)]
    of_symbol = np.array([elements[generators[s]] for s in range(8)], np.int32)
    return of_symbol, table, np.array([f[FRESH] for f in elements], np.uint8)


def scan(elements: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive scan under composition: rows of blocks in lockstep, block totals by the same scan, then both combined."""
    table = monoid()[1]
    n, size = len(elements), len(table)
    if n <= width:
        out, acc = np.empty(n, np.int32), 0
        for i, x in enumerate(elements):
            acc = out[i] = table[acc, x]
        return out
    flat = table.ravel()
    blocks = -(-n // width)
    lanes = np.zeros(blocks * width, np.int32)
    lanes[:n] = elements
    lanes = np.ascontiguousarray(lanes.reshape(blocks, width).T)
    for j in range(1, width):
        lanes[j] = flat[lanes[j - 1] * size + lanes[j]]
    before = np.r_[0, scan(lanes[-1])[:-1]]
    return flat[(before * size)[None, :] + lanes].T.ravel()[:n]


@functools.cache
def starting() -> np.ndarray:
    """Whether a symbol that is no white space starts a pre-token, by the state before it and the symbol."""
    out = np.ones((8, 8), bool)
    out[[IN_LETTERS, REST1, REST2, AT_SPACE], S_LETTER] = False
    out[[IN_NUMBERS, AT_SPACE], S_NUMBER] = False
    for s in (S_OTHER, S_QUOTE2, S_QUOTE3):
        out[[IN_OTHER, AT_SPACE], s] = False
    return out


def boundaries(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start in joined texts; each end mark counts as one of its own."""
    if not len(points):
        return np.zeros(0, np.int64)
    symbols = class_table()[points]
    symbols[marks] = S_END
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.r_[points, [0x110000] * 2]
        one, two = padded[quotes + 1], padded[quotes + 2]
        symbols[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = S_QUOTE2
        for a, b in LONG_ENDINGS:
            symbols[quotes[(one == ord(a)) & (two == ord(b))]] = S_QUOTE3
    of_symbol, _, image = monoid()
    before = np.r_[np.uint8(FRESH), image[scan(of_symbol[symbols])][:-1]]
    following = np.r_[symbols[1:], np.uint8(S_END)]
    white = (symbols == S_SPACE) | (symbols == S_WHITE)
    last = (following != S_SPACE) & (following != S_WHITE) & (following != S_END)
    start = np.where(white, ((before != AT_SPACE) & (before != AT_WHITE)) | last, starting()[before, symbols])
    start[marks] = True
    return np.flatnonzero(start)


class Vocabulary(dict):
    """Ranks of byte strings; as a dict, the ids of pre-tokens met so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int32, len(self.bytes_of))

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def __missing__(self, piece: str) -> tuple[int, ...]:
        self[piece] = out = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of least rank, the leftmost of equals, merges first.

        Candidates wait in a heap and parts in a linked list, so that a long piece takes n log n steps.
        """
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT_PIECE:
            return self.merge_short(piece)
        end, after, prior = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            end[i], after[i], gone[j] = stop, after[j], 1
            if after[i] < n:
                prior[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := prior[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """Rank, which is also the id, of the token that two ids make together, by both ids in one number."""
        rank = self.ranks.get
        return {left << 32 | right: i for token, i in self.ranks.items() for k in range(1, len(token)) if (left := rank(token[:k])) is not None and (right := rank(token[k:])) is not None}

    @functools.cached_property
    def byte_ids(self) -> list[int]:
        return [self.ranks[bytes([b])] for b in range(256)]

    def merge_short(self, piece: bytes) -> list[int]:
        rank, never = self.pairs.get, len(self.bytes_of)
        ids = [self.byte_ids[b] for b in piece]
        pairs = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while pairs and (least := min(pairs)) != never:
            i = pairs.index(least)
            ids[i] = least
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(least << 32 | ids[i + 1], never)
            if i:
                pairs[i - 1] = rank(ids[i - 1] << 32 | least, never)
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the bounds of each text in them, and each token's byte offset in its text."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        joined, points, marks = joined_codepoints(texts)
        starts = boundaries(points, marks)
        ends = np.r_[starts[1:], len(points)]
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, marks)] = False
        begin, stop = starts[real].tolist(), ends[real].tolist()
        found = [self[joined[a:b]] for a, b in zip(begin, stop)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        tokens_before = np.r_[0, np.cumsum(sizes)]
        bounds = tokens_before[np.r_[0, np.searchsorted(begin, marks)]]
        at = np.r_[0, np.cumsum(self.lengths[ids], dtype=np.int64)]
        return ids, bounds, (at[:-1] - np.repeat(at[bounds[:-1]], np.diff(bounds))).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.lru_cache(4)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary.parse(content)


def load(df: DataFrame, ranks_path: str):
    """The rank file, broadcast to the executors: its size is that of one vocabulary, whatever the table's."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` array<int>, ``offsets`` array<int> (byte at which each token starts) for each row.

    A null or empty text has no ids. Texts of any length are encoded whole. Rows are handled one by one, so
    repeated rows, ties and further columns (dropped) make no difference; an empty table gives an empty result.
    """
    content = load(df, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds, offsets = vocabulary(content.value).encode(texts_of(batch.column(1)))
        bounds = pa.array(bounds, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(ids)), pa.ListArray.from_arrays(bounds, pa.array(offsets))], [key, "ids", "offsets"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, ids array<int>, offsets array<int>")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """``df`` with ``decoded`` binary in place of ``offsets``: the bytes of the ids; null ids give null.

    The last token's offset and length give each row's place in the batch's decoded bytes.
    """
    content = load(df, ranks_path)
    keep = [c for c in df.columns if c != offsets]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(content.value)
        lists, starts = batch.column(batch.schema.get_field_index(ids)), batch.column(batch.schema.get_field_index(offsets))
        flat = lists.flatten().to_numpy()
        data = v.decode(flat)
        sizes = np.diff(lists.offsets.to_numpy())
        stop = np.cumsum(sizes)
        length = np.zeros(len(sizes), np.int64)
        some = sizes > 0
        length[some] = starts.flatten().to_numpy()[stop[some] - 1] + v.lengths[flat[stop[some] - 1]]
        bounds = np.r_[0, np.cumsum(length)]
        out = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        decoded = pa.array(out, pa.binary(), mask=np.asarray(lists.is_null()))
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), decoded], [*keep, "decoded"])

    def passes(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                yield run(batch.slice(start, 64))

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(passes, f"{fields}, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each document's round trip.

    A null or empty text has no tokens and the digests of nothing. Repeated rows are alike, a null doc_id is kept, an
    empty table gives no rows; further columns are not read.
    """
    both = decode(encode(docs, ranks_path), ranks_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
