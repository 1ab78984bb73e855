"""Shared building blocks: bounded Arrow batches, code-point classes, word hashes, sampling."""

from __future__ import annotations

import functools
import tempfile
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one vectorised pass handles; a longer single text is a pass of its own.
PASS_BYTES = 1 << 20

# Code-point classes.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)

# The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark not in LOCAL:
        LOCAL[spark] = tempfile.mkdtemp(prefix="shared-")
    return LOCAL[spark]


#: Temporary folders of local sessions.
LOCAL: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_checkpoints(spark: SparkSession) -> None:
    """Make sure that reliable checkpoints have a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark writes to; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table. Unlike a checkpoint it carries no constraints over to later plans, whose number multiplies in a loop."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int) -> F.Column:
    """Remainder of crc32 of an identifier's decimal text (null: empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """A deterministic sample by hash of ``key`` of about ``max_rows`` rows at most (all rows if there are fewer)."""
    n = df.count()
    if n <= max_rows:
        return df
    steps = 1 << 20
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(steps)) < int(steps * max_rows / n))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over slices whose binary and string columns hold at most PASS_BYTES (or one row).

    ``fn`` takes a RecordBatch and returns a RecordBatch or Table with the columns of ``schema``.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch):
    """Slices of a batch with at most PASS_BYTES in the strings and binaries of their rows, or a single row."""
    n = batch.num_rows
    sizes = np.zeros(n, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            sizes += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PASS_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(column: pa.Array) -> list[str]:
    """Texts as a list, nulls as empty texts."""
    return [x or "" for x in column.to_pylist()]


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point; one entry more, above Unicode's last, marks the end of a text.

    Letters and numbers are those of the Unicode version that tiktoken has built in (it drops what its pattern
    does not match), so that boundaries agree with it; without tiktoken, those of the regex module.
    """
    table = np.full(0x110001, OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        try:
            import tiktoken

            probe = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            members = bytes(probe.encode_ordinary(text)).decode()
        except ImportError:
            import regex

            members = "".join(regex.findall(pattern, text))
        table[np.frombuffer(members.encode("utf-32-le"), "<u4")] = kind
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def joined_codepoints(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one string, each followed by an end mark; its code points; positions of the marks."""
    joined = "\0".join(texts) + "\0" if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    marks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points[marks] = 0x110000
    return joined, points, marks


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising permutation (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache(2)
def powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.cache
def point_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110002, dtype=np.uint64))


class Words:
    """Words (runs of letters and numbers) of many texts, each with a 64-bit hash.

    ``starts``, ``ends``: positions in the joined code points; ``doc``: index of the text;
    ``first``: index of each text's first word, with the number of words at the end.
    """

    def __init__(self, texts: list[str]):
        self.joined, self.points, self.marks = joined_codepoints(texts)
        kinds = class_table()[self.points] if len(self.points) else np.zeros(0, np.uint8)
        self.kinds = kinds
        inside = np.zeros(len(kinds) + 2, np.int8)
        inside[1:-1] = kinds <= NUMBER
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.r_[0, np.searchsorted(self.starts, self.marks)]
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        total = int(lengths.sum())
        begin = np.cumsum(lengths) - lengths
        within = np.arange(total) - np.repeat(begin, lengths)
        where = within + np.repeat(self.starts, lengths)
        longest = 1 << int(lengths.max()).bit_length()
        code = point_codes()[self.points[where]] * powers(longest)[within]
        return mix(np.add.reduceat(code, begin) + lengths.astype(np.uint64))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct word shingles, and the bounds of each text in them.

    A text of fewer than ``size`` words, but some, has all its words as its one shingle; one without words has none.
    """
    h, counts = words.hashes, words.counts
    n = len(h)
    acc = np.zeros(n, np.uint64)
    for j in range(size):
        acc[: n - j] = acc[: n - j] * np.uint64(0x9FB21C651E98DF25) + h[j:] if j else h
    position = np.arange(n) - np.repeat(words.first[:-1], counts)
    full = position + size <= np.repeat(counts, counts)
    short = (counts > 0) & (counts < size)
    values, docs = mix(acc[full]), words.doc[full]
    if short.any():
        extra = [hash_of_sequence(h[a:b]) for a, b in zip(words.first[:-1][short], words.first[1:][short])]
        values, docs = np.r_[values, np.array(extra, np.uint64)], np.r_[docs, np.flatnonzero(short)]
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        fresh = np.r_[True, (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])]
        values, docs = values[fresh], docs[fresh]
    return values, np.searchsorted(docs, np.arange(len(counts) + 1))


def hash_of_sequence(h: np.ndarray) -> np.uint64:
    acc = np.zeros(1, np.uint64)
    for x in h:
        acc = acc * np.uint64(0x9FB21C651E98DF25) + x
    return mix(acc + np.uint64(len(h)))[0]
