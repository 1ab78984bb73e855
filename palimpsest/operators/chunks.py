"""Chunked streams: chunking, grouping into bevies, codecs, index construction and random-access reads."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.grouping import spread
from palimpsest.plans.range_join import chunk_filter
from palimpsest.vocabulary import CHUNK_SIZE, CHUNKS_IN_SEGMENT, CODEC_URNS, CODECS, COMPRESSION, DEFAULT_CHUNK_SIZE, DEFAULT_CHUNKS_PER_BEVY, IMAGE_STREAMS, LEGACY_NS, SIZE, SMALL_FILE, TYPE

SCHEMA = "urn string, chunk_id bigint, bevy_id bigint, chunk_in_bevy int, offset bigint, length int, payload binary"


def chunked(streams: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE, per_bevy: int = DEFAULT_CHUNKS_PER_BEVY, data: str = "data") -> DataFrame:
    """Chunks of (urn, data); the last of a stream may be short, and an empty stream has none. Data may be text, cut by characters."""
    count = lambda d: F.floor((F.length(d) - 1) / chunk_size).cast("int")
    # The stream is bound to a variable and cut inside one expression: no row but its own carries it whole.
    cut = F.get(F.transform(F.array(F.col(data)), lambda d: F.transform(F.sequence(F.lit(0), count(d)), lambda i: F.substring(d, i * chunk_size + 1, F.lit(chunk_size)))), F.lit(0))
    if streams.schema[data].dataType.simpleString() == "string":  # one pass over the characters, which have no fixed width
        cut = F.regexp_extract_all(F.col(data), F.lit(f"(?s).{{1,{chunk_size}}}"), F.lit(0))
    rows = streams.where(F.length(data) > 0).select("urn", F.posexplode(cut).alias("chunk", "payload"))
    out = rows.select("urn", F.col("chunk").cast("bigint").alias("chunk_id"), "payload")
    return out.select(
        "urn",
        "chunk_id",
        F.expr(f"chunk_id DIV {per_bevy}").alias("bevy_id"),
        F.expr(f"CAST(chunk_id % {per_bevy} AS INT)").alias("chunk_in_bevy"),
        (F.col("chunk_id") * chunk_size).alias("offset"),
        F.length("payload").alias("length"),
        "payload",
    )


def bevy_member(bevy_id="bevy_id", index: bool = False) -> Column:
    """Name of a bevy's member, or of its index."""
    name = F.lpad(F.col(bevy_id).cast("string"), 8, "0")
    return F.concat(name, F.lit(".index")) if index else name


def compress_bytes(data: bytes, codec: str) -> bytes:
    """zlib at level 1; ``deflate`` streams have zlib's wrapping and level too; snappy and lz4 as raw blocks."""
    if codec == "zlib":
        return zlib.compress(data, 1)
    if codec == "deflate":
        return zlib.compress(data)
    if codec in ("snappy", "lz4"):
        return pa.compress(data, codec="snappy" if codec == "snappy" else "lz4_raw", asbytes=True)
    if codec == "stored":
        return data
    raise NotImplementedError(f"codec {codec}")


def decompress_bytes(data: bytes, codec: str, size: int) -> bytes:
    """Inverse of ``compress_bytes``, for chunks of at most ``size`` bytes; deflate streams may also lack the wrapping."""
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "deflate":
        try:
            return zlib.decompress(data)
        except zlib.error:
            return zlib.decompress(data, -15)
    if codec in ("snappy", "lz4"):
        n = snappy_size(data) if codec == "snappy" else lz4_size(data)
        if n > size:
            raise ValueError(f"a chunk of {n} bytes in a stream of chunks of {size}")
        return pa.decompress(data, decompressed_size=n, codec="snappy" if codec == "snappy" else "lz4_raw", asbytes=True) if n else b""
    if codec == "stored":
        return data
    raise NotImplementedError(f"codec {codec}")


def snappy_size(data: bytes) -> int:
    """A snappy block starts with the plain length, seven bits a byte, the lowest first."""
    n = 0
    for i, b in enumerate(data):
        n |= (b & 0x7F) << (7 * i)
        if b < 0x80:
            break
    return n


def lz4_size(data: bytes) -> int:
    """Plain length of a raw lz4 block, which is not stored: the sum of its literal and match lengths."""
    n, at, end = 0, 0, len(data)

    def extended(length: int, at: int) -> tuple[int, int]:
        while length >= 15 and at < end:
            length, at, more = length + data[at], at + 1, data[at]
            if more < 255:
                break
        return length, at

    while at < end:
        token = data[at]
        literals, at = extended(token >> 4, at + 1)
        n, at = n + literals, at + literals
        if at >= end:
            break
        match, at = extended(token & 15, at + 2)
        n += match + 4
    return n


def compress(chunks: DataFrame, codec: str, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Adds ``stored`` (bytes as stored), ``stored_length`` and ``is_raw``: kept raw if compression saves 16 bytes of a chunk or less."""
    names = chunks.columns

    def run(batches):
        for batch in batches:
            stored, raw = [], []
            for p in batch.column(names.index("payload")):
                data = p.as_py() or b""
                packed = compress_bytes(data, codec)
                keep = codec == "stored" or len(packed) >= chunk_size - 16 or len(packed) >= len(data)
                stored.append(data if keep else packed)
                raw.append(keep)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary()), pa.array([len(x) for x in stored], pa.int32()), pa.array(raw)], [*names, "stored", "stored_length", "is_raw"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{own}, stored binary, stored_length int, is_raw boolean")


def decompress(stored: DataFrame, codec: str, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Replaces ``stored`` by ``payload`` and ``error`` (null if the chunk could be read). Raw chunks are flagged, or as long as a chunk."""
    names = stored.columns
    keep = [c for c in names if c not in ("stored", "payload", "error")]

    def run(batches):
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(names)}
            flags = at["is_raw"].to_pylist() if "is_raw" in at else [None] * batch.num_rows
            payload, errors = [], []
            for data, flag in zip(at["stored"].to_pylist(), flags):
                try:
                    raw = flag if flag is not None else len(data) == chunk_size
                    payload.append(data if raw else decompress_bytes(data, codec, chunk_size))
                    errors.append(None)
                except Exception as e:  # a damaged chunk is an error of its own, not of the stream
                    payload.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*(at[c] for c in keep), pa.array(payload, pa.binary()), pa.array(errors, pa.string())], [*keep, "payload", "error"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields if f.name in keep)
    return stored.mapInArrow(run, f"{own}, payload binary, error string")


def is_incompressible(stored_length, chunk_size: int) -> Column:
    """With a signed difference, so that chunks under 16 bytes are always stored raw."""
    return F.col(stored_length) >= chunk_size - 16


def bevy_index(chunks: DataFrame, length: str = "length") -> DataFrame:
    """(urn, bevy_id, chunk_in_bevy, offset, length): where each chunk starts in its bevy; the order is that of chunks."""
    w = Window.partitionBy("urn", "bevy_id").orderBy("chunk_in_bevy").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.select("urn", "bevy_id", "chunk_in_bevy", (F.sum(length).over(w) - F.col(length)).cast("bigint").alias("offset"), F.col(length).cast("bigint").alias("length"))


def from_legacy_index(ends: DataFrame) -> DataFrame:
    """Offsets and lengths from the cumulative ends of an older index: rows of (urn, bevy_id, chunk_in_bevy, end)."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("urn", "bevy_id").orderBy("chunk_in_bevy"))
    return ends.select("urn", "bevy_id", "chunk_in_bevy", before.cast("bigint").alias("offset"), (F.col("end") - before).cast("bigint").alias("length"))


def chunk_lookup(index: DataFrame, wanted: DataFrame, per_bevy: int) -> DataFrame:
    """Index entries of wanted (urn, chunk_id); a chunk that the index lacks has ``found`` false."""
    keys = wanted.select("urn", "chunk_id", F.expr(f"chunk_id DIV {per_bevy}").alias("bevy_id"), F.expr(f"CAST(chunk_id % {per_bevy} AS INT)").alias("chunk_in_bevy"))
    joined = keys.join(index.withColumn("found", F.lit(True)), ["urn", "bevy_id", "chunk_in_bevy"], "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def read_parts(chunks: DataFrame, urn: str, offset: int, length: int, chunk_size: int) -> DataFrame:
    """(position, payload): the trimmed chunks of a byte range of one stream, ordered by position. The chunk filter reaches the scan."""
    part = chunks.where((F.col("urn") == urn) & chunk_filter(offset, length, chunk_size))
    lo = F.greatest(F.lit(offset) - F.col("offset"), F.lit(0)).cast("int")
    hi = F.least(F.lit(offset + length) - F.col("offset"), F.col("length").cast("bigint")).cast("int")
    return part.select((F.col("offset") + lo - offset).alias("position"), F.substring(F.col("payload"), lo + 1, hi - lo).alias("payload")).where(F.length("payload") > 0).orderBy("position")


def read(chunks: DataFrame, urn: str, offset: int, length: int, chunk_size: int = DEFAULT_CHUNK_SIZE, limit: int | None = None) -> bytes:
    """Bytes of a range, clamped to the stream, brought to the driver; a request over ``limit`` reads nothing."""
    if length <= 0 or (limit is not None and length > limit):
        return b""
    return b"".join(bytes(r.payload) for r in read_parts(chunks, urn, offset, length, chunk_size).toLocalIterator())


def read_ranges(chunks: DataFrame, requests: DataFrame, chunk_size: int, separator: str = "") -> DataFrame:
    """(request_id, urn, data) for many requests (request_id, urn, offset, length) of text payloads: each explodes into
    the chunks that it needs, joined by (urn, chunk_id). A request beyond the stream has no row."""
    first, last = f"offset DIV {chunk_size}", f"(offset + length - 1) DIV {chunk_size}"
    wanted = requests.where("length > 0").select("request_id", "urn", F.col("offset").alias("r_offset"), F.col("length").alias("r_length"), F.explode(F.expr(f"sequence({first}, {last})")).alias("chunk_id"))
    joined = wanted.join(chunks, ["urn", "chunk_id"])
    lo = F.greatest(F.col("r_offset") - F.col("offset"), F.lit(0)).cast("int")
    hi = F.least(F.col("r_offset") + F.col("r_length") - F.col("offset"), F.col("length").cast("bigint")).cast("int")
    parts = joined.where(hi > lo).select("request_id", "urn", "chunk_id", F.substring(F.col("payload"), lo + 1, hi - lo).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "part")))
    return parts.groupBy("request_id", "urn").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), separator).alias("data"))


def metadata(urn: str, size: int, codec: str, chunk_size: int = DEFAULT_CHUNK_SIZE, per_bevy: int = DEFAULT_CHUNKS_PER_BEVY) -> list[tuple[str, str, str, str]]:
    """The five triples (s, p, o, dt) of a stream."""
    return [
        (urn, TYPE, IMAGE_STREAMS[0], "urn"),
        (urn, CHUNK_SIZE, str(chunk_size), "integer"),
        (urn, CHUNKS_IN_SEGMENT, str(per_bevy), "integer"),
        (urn, SIZE, str(size), "integer"),
        (urn, COMPRESSION, CODEC_URNS[codec], "urn"),
    ]


def parameters(triples: DataFrame, codec: str = "zlib") -> DataFrame:
    """(s, chunk_size, per_bevy, size, codec, status) of every stream: standard names before older ones, then defaults."""
    older = {CHUNK_SIZE: "chunk_size", CHUNKS_IN_SEGMENT: "chunks_in_segment", SIZE: "size", COMPRESSION: "CompressionMethod"}
    names = [TYPE, *older, *(f"{LEGACY_NS}{x}" for x in older.values())]
    given = triples.where(F.col("p").isin(names)).select("s", F.array_position(F.array(*[F.lit(x) for x in names]), F.col("p")).alias("p"), "o", "seq")
    of = lambda p: F.col("p") == names.index(p) + 1
    last = lambda *names: F.coalesce(*[F.max_by(F.when(of(p), F.col("o")), F.when(of(p), F.col("seq"))) for p in names])
    rows = spread(given, "s").groupBy("s").agg(
        F.bool_or(of(TYPE) & F.col("o").isin(IMAGE_STREAMS)).alias("stream"),
        last(CHUNK_SIZE, f"{LEGACY_NS}chunk_size").try_cast("bigint").alias("chunk_size"),
        last(CHUNKS_IN_SEGMENT, f"{LEGACY_NS}chunks_in_segment").try_cast("bigint").alias("per_bevy"),
        last(SIZE, f"{LEGACY_NS}size").try_cast("bigint").alias("size"),
        last(COMPRESSION, f"{LEGACY_NS}CompressionMethod").alias("method"),
    )
    known = F.create_map(*[F.lit(x) for kv in CODECS.items() for x in kv])[F.col("method")]
    return rows.where("stream").select(
        "s",
        F.coalesce("chunk_size", F.lit(DEFAULT_CHUNK_SIZE)).alias("chunk_size"),
        F.coalesce("per_bevy", F.lit(DEFAULT_CHUNKS_PER_BEVY)).alias("per_bevy"),
        "size",
        F.when(F.col("method").isNull(), codec).otherwise(known).alias("codec"),
        F.when(F.col("method").isNotNull() & known.isNull(), "NOT_IMPLEMENTED").otherwise("STATUS_OK").alias("status"),
    )


def storage_choice(size: str | Column, codec: str = "zlib", threshold: int = SMALL_FILE) -> Column:
    """``segment`` for one member, ``image`` for a chunked stream."""
    n = F.col(size) if isinstance(size, str) else size
    return F.when((F.lit(codec) == "none") | ((n > 0) & (n < threshold)), "segment").otherwise("image")


def symbolic(pattern: bytes | str, offset, length) -> Column:
    """``length`` units of an endless repetition of the pattern, from ``offset`` on."""
    n = len(pattern)
    start = F.pmod(offset, F.lit(n)).cast("int")
    times = F.ceil((start + length) / n).cast("int")
    whole = F.repeat(F.lit(pattern), times) if isinstance(pattern, str) else F.unhex(F.repeat(F.lit(pattern.hex()), times))
    return F.substring(whole, start + 1, length)
