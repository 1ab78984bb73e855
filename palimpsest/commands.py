"""Commands over volumes: load, list, view, export and ingest, and access to one image by offset."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.urns import domain, escape_component, glob_match, member_name, path
from palimpsest.operators import chunks, ranges, triples
from palimpsest.operators.volumes import resolve
from palimpsest.plans.lineage import cut
from palimpsest.sources import files as streams
from palimpsest.sources import turtle, zip_volume
from palimpsest.vocabulary import COMPRESSION, IMAGE, INFORMATION_TURTLE, MAP, ORIGINAL_FILENAME, SIZE, STORED, SYMBOLIC, SYMBOLIC_PREFIX, TYPE, ZIP_SEGMENT

#: Deepest nesting of maps in targets of maps.
DEPTH = 32
#: Parts of one target that lie so near to each other are read together.
NEAR = 64 << 10
#: Bytes of an export that are read at a time.
PIECE = 32 << 20


def symbol(urn: str) -> bytes | None:
    """The pattern that a symbolic stream repeats."""
    byte = re.fullmatch(re.escape(SYMBOLIC_PREFIX) + "([0-9A-F]{2})", urn)
    return bytes.fromhex(byte[1]) if byte else SYMBOLIC.get(urn)


@dataclass
class Volumes:
    """Segments (with payloads, read lazily) and merged metadata of a group of volumes."""

    segments: DataFrame
    triples: DataFrame
    #: A new scan of the segments. Filters that are pushed into a scan hold for all plans that share it, so each filtered read needs its own.
    scan: Callable[[], DataFrame] | None = field(default=None, repr=False, compare=False)
    maps: dict = field(default_factory=dict, repr=False, compare=False)

    def named(self, *urns: str) -> DataFrame:
        """The segments of these names, of which alone the reader opens the members."""
        return (self.scan or (lambda: self.segments))().where(F.col("urn").isin(list(urns)))

    def list_images(self) -> DataFrame:
        return triples.query(self.triples, TYPE, IMAGE)

    def view(self, verbose: bool = True) -> str:
        return turtle.header() + "".join(r.value for r in turtle.statements(self.triples, verbose).orderBy("value").toLocalIterator())

    def export_plan(self, pattern: str = "*") -> DataFrame:
        return export_candidates(self.triples, pattern)

    def first_image(self) -> str | None:
        return triples.first_image(self.triples).first()[0]

    def resolve(self) -> DataFrame:
        return self.resolved

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve(self.triples)

    def chunks(self) -> DataFrame:
        """Stored chunks of all image streams, decompressed: bevies are cut by their indexes."""
        return stored_chunks(self)

    def find(self, urn: str) -> tuple[str, str]:
        """Stream and kind (image, map, symbolic or segment) that a URN leads to."""
        found = self.resolved.where(F.col("s") == urn).select("stream", "kind").first()
        stream, kind = (found.stream, found.kind) if found else (urn, "not_found")
        return stream, ("symbolic" if symbol(stream) else "segment") if kind == "not_found" else kind

    def read(self, urn: str, offset: int, length: int, depth: int = DEPTH) -> bytes:
        """Bytes of an image, map or symbolic stream or of a stored segment; a short read at the end, which symbolic streams have not.

        Gaps of maps and what a target is too short for read as NUL bytes.
        """
        stream, kind = self.find(urn)
        if kind == "image":
            size = chunks.parameters(self.triples).where(F.col("s") == stream).first()
            length = min(length, max((size["size"] or 0) - offset, 0))
            bevy = size.chunk_size * size.per_bevy
            data = chunks.read(stored_chunks(self, stream, offset // bevy, (offset + max(length, 1) - 1) // bevy), stream, offset, length, size.chunk_size)
            if len(data) < length:
                raise OSError(f"{stream} lacks chunks: {len(data)} of {length} bytes at {offset}")
            return data
        if kind == "symbolic":
            pattern = symbol(stream)
            start, length = offset % len(pattern), max(length, 0)
            return (pattern * ((start + length) // len(pattern) + 1))[start : start + length]
        if kind == "map":
            return self.read_map(stream, offset, min(length, self.map_size(stream) - offset), depth)
        row = self.named(stream).select(F.substring("payload", offset + 1, length).alias("d")).first()
        if row is None:
            raise FileNotFoundError(urn)
        return bytes(row.d)

    def map_ranges(self, stream: str) -> DataFrame:
        """Ranges of a map from its streams ``map`` and ``idx``, the newest over the older ones."""
        if stream not in self.maps:
            spark = self.segments.sparkSession
            part = {}
            for name in ("map", "idx"):
                urn = f"{stream}/{name}"
                rows = self.named(urn).select(F.lit(stream).alias("map_urn"), F.col("payload").alias(name)).limit(1)
                if self.find(urn)[1] != "segment":
                    rows = spark.createDataFrame([(stream, self.read(urn, 0, self.object_size(urn)))], f"map_urn string, {name} binary")
                elif rows.isEmpty():
                    raise FileNotFoundError(urn)
                part[name] = rows
            self.maps[stream] = cut(ranges.overlay(streams.decode_map(part["map"].join(part["idx"], "map_urn"))))
        return self.maps[stream]

    def map_size(self, stream: str) -> int:
        row = self.triples.where((F.col("s") == stream) & (F.col("p") == SIZE)).agg(F.max_by("o", "seq").try_cast("bigint").alias("size")).first()
        if row["size"] is not None:
            return row["size"]
        row = ranges.size(self.map_ranges(stream)).first()
        return row["size"] if row else 0

    def read_map(self, stream: str, offset: int, length: int, depth: int) -> bytes:
        """Bytes of a map that lie within its size, read from its targets."""
        if length <= 0:
            return b""
        if not depth:
            raise RecursionError(f"maps nested too deep: {stream}")
        request = self.segments.sparkSession.createDataFrame([(0, stream, offset, length)], "request_id int, map_urn string, offset bigint, length bigint")
        parts = ranges.lookup(self.map_ranges(stream), request).select("target", "target_offset", "length", "out_offset").collect()
        out, near = bytearray(length), []
        for r in sorted(parts, key=lambda r: (r.target or "", r.target_offset)):
            if r.target is None:
                raise OSError(f"a range of {stream} has no target")
            end = r.target_offset + r.length
            if near and near[-1][0] == r.target and r.target_offset <= near[-1][2] + NEAR:
                near[-1][2] = max(near[-1][2], end)
                near[-1][3].append(r)
            else:
                near.append([r.target, r.target_offset, end, [r]])
        for target, first, end, rows in near:
            data = self.read(target, first, end - first, depth - 1)
            for r in rows:
                piece = data[r.target_offset - first :][: r.length]
                out[r.out_offset : r.out_offset + len(piece)] = piece
        return bytes(out)

    def object_size(self, urn: str) -> int:
        """Bytes of a stream or segment; symbolic streams have no end and give 0."""
        stream, kind = self.find(urn)
        if kind == "map":
            return self.map_size(stream)
        row = chunks.parameters(self.triples).where(F.col("s") == stream).first()
        if row is not None and row["size"] is not None:
            return row["size"]
        row = self.named(stream).select("size").first()
        return row[0] if row else 0

    def export(self, folder: str, pattern: str = "*", piece: int = PIECE) -> list[tuple[str, str, int, str | None]]:
        """Writes the planned streams below a folder; (s, target, bytes, error) of each. An error ends its own stream only, whose file is not kept."""
        fs, root = zip_volume.file_system(folder)
        out = []
        for s, target in self.export_plan(pattern).orderBy("s").toLocalIterator():
            path, temporary, n, error = f"{root}/{target}", f"{root}/{target}.tmp", 0, None
            try:
                if ".." in target.split("/"):
                    raise ValueError("the name leads out of the folder")
                size = self.object_size(s)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(temporary) as f:
                    n = streams.write_raw(({"position": at, "payload": self.read(s, at, min(piece, size - at))} for at in range(0, size, piece)), f)
                if n != size:
                    fs.delete_file(temporary)
                    raise OSError(f"{n} of {size} bytes could be read")
                fs.move(temporary, path)
            except Exception as e:  # the others are exported all the same
                error = str(e) or type(e).__name__
            out.append((s, target, n, error))
        return out

    def get_property(self, urn: str, attribute: str, dt: str) -> str | None:
        row = triples.get(self.triples, urn, attribute, dt).first()
        return row.o if row else None

    def get_string_property(self, urn: str, attribute: str) -> str | None:
        return self.get_property(urn, attribute, "string")

    def get_integer_property(self, urn: str, attribute: str) -> int | None:
        value = self.get_property(urn, attribute, "integer")
        return None if value is None else int(value)

    def get_boolean_property(self, urn: str, attribute: str) -> bool | None:
        value = self.get_property(urn, attribute, "boolean")
        return None if value is None else value == "true"

    def get_binary_property(self, urn: str, attribute: str) -> bytes | None:
        value = self.get_property(urn, attribute, "hexBinary")
        return None if value is None else bytes.fromhex(value)

    def dump(self, verbose: bool = True, form: str = "turtle") -> str:
        """The metadata as text: Turtle, or JSON of subject to attribute to values."""
        if form == "turtle":
            return self.view(verbose)
        rows = triples.attributes(triples.dump(self.triples, verbose)).orderBy("s").toLocalIterator()
        return json.dumps({r.s: r.attributes for r in rows}, ensure_ascii=False, indent=1)


def load_volumes(spark: SparkSession, path: str) -> Volumes:
    """All zip volumes that a path, folder or pattern names; where members are stored is known from the volumes themselves."""
    zip_volume.register(spark)
    scan = lambda: spark.read.format("zip_volume").option("path", path).load()
    catalog = spark.read.format("zip_volume").option("path", path).option("payload", "false").load()
    texts = scan().where(F.col("member") == INFORMATION_TURTLE).select("volume", F.col("payload").cast("string").alias("value"))
    meta = triples.standard_names(turtle.of_texts(texts)).where(F.col("p") != STORED)
    stored = catalog.select("volume", F.col("urn").alias("s"), F.lit(STORED).alias("p"), F.col("volume").alias("o"), F.lit("urn").alias("dt"), F.lit(0).cast("bigint").alias("seq"))
    kinds = stored.withColumn("p", F.lit(TYPE)).withColumn("o", F.lit(ZIP_SEGMENT)).withColumn("seq", F.lit(1 << 40))  # after the types that metadata give
    return Volumes(scan(), meta.unionByName(stored).unionByName(kinds), scan)


def open_image(spark: SparkSession, path: str) -> tuple[Volumes, str | None]:
    volumes = load_volumes(spark, path)
    return volumes, volumes.first_image()


def export_candidates(store: DataFrame, pattern: str = "*") -> DataFrame:
    """(s, target): images and maps that a glob matches, each once, and the file below the export folder."""
    found = store.where((F.col("p") == TYPE) & F.col("o").isin(IMAGE, MAP)).select("s").distinct().where(glob_match("s", pattern))
    return found.select("s", F.concat_ws("/", F.when(domain("s") != "", domain("s")), escape_component(path("s"))).alias("target"))


def legacy_entries(index: bytes) -> list[tuple[int, int]]:
    """Offset and length of each chunk from the cumulative ends of an older index."""
    ends = [e for (e,) in struct.iter_unpack("<I", index)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def stored_chunks(volumes: Volumes, stream: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """Chunks (urn, chunk_id, offset, length, payload) of image streams from their bevy and index members, or of one stream's bevies ``first`` to ``last``.

    A bevy and its index meet by name, ``.index`` or, in older containers, ``/index``, which holds 4-byte cumulative ends;
    the cut and the decompression are one pass over each bevy, a few chunks at a time. A chunk stored as long as a chunk is
    raw; what the last one holds beyond the stream's size is padding. A bevy without an index, or an index without a bevy,
    is an error; a damaged chunk has a null payload and its ``error``.
    """
    pattern = r"^(.*)/([0-9]{8})([./]index)?$"
    named_of = lambda s: s.where(F.col("urn").rlike(pattern)).select(F.regexp_extract("urn", pattern, 1).alias("stream"), F.regexp_extract("urn", pattern, 2).cast("bigint").alias("bevy_id"), F.regexp_extract("urn", pattern, 3).alias("suffix"), "payload")
    named = named_of(volumes.segments)
    if stream is not None:  # the reader opens the members of these names only
        names = [f"{stream}/{b:08d}" for b in range(first, (first if last is None else last) + 1)]
        named = named_of(volumes.named(*(n + suffix for n in names for suffix in ("", ".index", "/index"))))
    indexes = named.where("suffix <> ''").select("stream", "bevy_id", F.col("payload").alias("index"), (F.col("suffix") == "/index").alias("legacy"))
    bevies = named.where("suffix = ''").drop("suffix").join(indexes, ["stream", "bevy_id"], "full")
    bevies = bevies.join(chunks.parameters(volumes.triples).select(F.col("s").alias("stream"), "chunk_size", "per_bevy", "size", "codec"), "stream")

    def run(batches):
        from palimpsest.sources.files import INDEX

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["urn", "chunk_id", "offset", "length", "payload", "error"])
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if r["index"] is None or r["payload"] is None:
                    raise OSError(f"bevy {r['bevy_id']} of {r['stream']} has no {'index' if r['index'] is None else 'data'}")
                rows, held = [], 0
                for n, (offset, length) in enumerate(legacy_entries(r["index"]) if r["legacy"] else struct.iter_unpack(INDEX, r["index"])):
                    data, plain, error = r["payload"][offset : offset + length], None, None
                    try:
                        plain = data if length == r["chunk_size"] or r["codec"] == "stored" else chunks.decompress_bytes(data, r["codec"], r["chunk_size"])
                    except Exception as e:  # a damaged chunk is an error of its own, not of the stream
                        error = str(e) or type(e).__name__
                    chunk = r["bevy_id"] * r["per_bevy"] + n
                    at = chunk * r["chunk_size"]
                    if plain and r["size"] is not None and at < r["size"]:
                        plain = plain[: r["size"] - at]
                    rows.append((r["stream"], chunk, at, len(plain or b""), plain, error))
                    held += len(plain or b"")
                    if held >= 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return bevies.mapInArrow(run, "urn string, chunk_id bigint, offset bigint, length int, payload binary, error string")


def ingest(files: DataFrame, path: str, base: str, codec: str = "zlib", chunk_size: int = 32 * 1024, per_bevy: int = 1024, threshold: int = 10 << 20, volumes: int | None = None) -> DataFrame:
    """Writes (name, data) files into zip volumes of a folder, small ones as segments, others as chunked streams; returns the triples.

    Each task writes a volume of its own, so members have absolute names, which hold in any volume; the metadata of a
    stream go into the volume of its first member.
    """
    spark = files.sparkSession
    zip_volume.register(spark)
    urn = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("name", "^/+", ""))
    rows = files.select(urn.alias("urn"), "name", F.col("data").cast("binary").alias("data")).withColumn("kind", chunks.storage_choice(F.length("data"), codec, threshold))
    plain = rows.where("kind = 'segment'").select(member_name("urn", F.lit("-")).alias("member"), F.col("data").alias("payload"), F.lit("stored" if codec == "none" else "deflate").alias("method"), F.col("urn").alias("subject"))
    image_codec = "stored" if codec == "none" else codec
    cut = chunks.compress(chunks.chunked(rows.where("kind = 'image'"), chunk_size, per_bevy), image_codec, chunk_size)

    def bevies(key, table):
        from palimpsest.sources.files import INDEX

        parts = sorted(zip(table.column("chunk_in_bevy").to_pylist(), table.column("stored").to_pylist(), table.column("is_raw").to_pylist(), table.column("length").to_pylist()))
        data, index, at = [], [], 0
        for _, stored, raw, length in parts:
            if raw and image_codec != "stored" and length != chunk_size:  # a short raw chunk would be taken for a compressed one
                packed = chunks.compress_bytes(stored, image_codec)
                # One that compression brings to just a chunk's length would be taken for a raw one: it is, filled up with NUL bytes.
                stored = packed if len(packed) != chunk_size else stored.ljust(chunk_size, b"\0")
            data.append(stored)
            index.append(struct.pack(INDEX, at, len(stored)))
            at += len(stored)
        urn, bevy = key[0].as_py(), key[1].as_py()
        return pa.table([pa.array([f"{urn}/{bevy:08d}", f"{urn}/{bevy:08d}.index"]), pa.array([b"".join(data), b"".join(index)], pa.binary())], ["urn", "payload"])

    streams = cut.groupBy("urn", "bevy_id").applyInArrow(bevies, "urn string, payload binary").select(member_name("urn", F.lit("-")).alias("member"), "payload", F.lit("stored").alias("method"), F.regexp_extract("urn", "^(.*)/00000000$", 1).alias("subject"))
    kinds = F.when(F.col("kind") == "image", F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(dt).alias("dt")) for p, o, dt in (
        (TYPE, F.lit(chunks.IMAGE_STREAMS[0]), "urn"), (chunks.CHUNK_SIZE, F.lit(str(chunk_size)), "integer"), (chunks.CHUNKS_IN_SEGMENT, F.lit(str(per_bevy)), "integer"),
        (chunks.SIZE, F.length("data").cast("string"), "integer"), (COMPRESSION, F.lit(chunks.CODEC_URNS[image_codec]), "urn"))])).otherwise(F.array(F.struct(F.lit(TYPE).alias("p"), F.lit(triples.ZIP_SEGMENT).alias("o"), F.lit("urn").alias("dt"))))
    common = F.array(F.struct(F.lit(TYPE).alias("p"), F.lit(IMAGE).alias("o"), F.lit("urn").alias("dt")), F.struct(F.lit(ORIGINAL_FILENAME).alias("p"), F.col("name").alias("o"), F.lit("string").alias("dt")))
    meta = rows.select("urn", F.posexplode(F.concat(kinds, common)).alias("seq", "x")).select(F.lit(base).alias("volume"), F.col("urn").alias("s"), "x.p", "x.o", "x.dt", F.col("seq").cast("bigint").alias("seq"))
    texts = turtle.by_subject(meta).select(F.col("s").alias("subject"), F.col("value").alias("turtle"))
    segments = plain.union(streams).join(texts, "subject", "left").drop("subject")
    segments = segments.repartition(volumes) if volumes else segments
    segments.write.format("zip_volume").option("path", path).option("urn", base).option("turtle", turtle.header()).mode("append").save()
    return meta
