"""Directory volumes, map streams, core files and raw streams."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.urns import append, escape_component
from palimpsest.functions.values import little_endian
from palimpsest.sources.zip_volume import file_system

RANGE = "<QQQI"  # map_offset, length, target_offset, target_id
INDEX = "<QI"  # offset, length
ELF_HEADER, ELF_SEGMENT = "<16sHHIQQQIHHHHHH", "<IIQQQQQQ"


def read_directory(spark: SparkSession, path: str, volume: str | None = None) -> DataFrame:
    """Segments of a directory volume: every file below it is a member. Payloads are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/"))
    member = F.regexp_replace(F.expr(f"substring(path, locate('{path.rstrip('/')}', path) + {len(path.rstrip('/'))})"), "^/", "")
    name = F.lit(volume) if volume else root
    rows = files.select(name.alias("volume"), member.alias("member"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), F.col("content").alias("payload"))
    return rows.withColumn("urn", append("volume", F.try_url_decode(F.replace("member", F.lit("+"), F.lit("%2B")))))


def write_directory(segments: DataFrame, path: str) -> None:
    """One file for each (member, payload) below a folder; slashes stay, other reserved characters are escaped.

    Files are written whole under a temporary name and then moved, so that a task may run twice.
    """
    rows = segments.select(escape_component("member").alias("member"), "payload")

    def put(rows):
        from pyspark import TaskContext

        fs, folder = file_system(path)
        for row in rows:
            target = f"{folder}/{row['member'].lstrip('/')}"
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            temporary = f"{target}.{TaskContext.get().taskAttemptId()}.tmp"
            with fs.open_output_stream(temporary) as out:
                out.write(bytes(row["payload"] or b""))
            fs.move(temporary, target)

    rows.foreachPartition(put)


def delete_directory(path: str) -> None:
    fs, folder = file_system(path)
    fs.delete_dir(folder)


def records(data: str, size: int) -> F.Column:
    """Array of the packed records of a binary column, so that exploded rows carry one record each."""
    last = lambda d: F.floor(F.length(d) / size).cast("int") - 1
    cut = lambda d: F.transform(F.sequence(F.lit(0), F.greatest(last(d), F.lit(0))), lambda i: F.substring(d, i * size + 1, F.lit(size)))
    return F.filter(F.get(F.transform(F.array(F.col(data)), cut), F.lit(0)), lambda r: F.length(r) == size)


def decode_map(maps: DataFrame) -> DataFrame:
    """Ranges of (map_urn, map, idx): packed records of 28 bytes, and one target a line (CRLF allowed)."""
    targets = F.split(F.regexp_replace(F.col("idx").cast("string"), r"\r?\n$", ""), r"\r?\n")
    rows = maps.select("map_urn", targets.alias("targets"), F.posexplode(records("map", struct.calcsize(RANGE))).alias("i", "r"))
    read = lambda offset, size: little_endian("r", offset, size)
    out = rows.select("map_urn", read(0, 8).alias("map_offset"), read(8, 8).alias("length"), read(16, 8).alias("target_offset"), read(24, 4).cast("int").alias("target_id"), "targets", F.col("i").cast("bigint").alias("seq"))
    return out.withColumn("target", F.get("targets", F.col("target_id"))).drop("targets")


def encode_map(ranges: DataFrame) -> DataFrame:
    """(map_urn, map, idx) of ranges (map_urn, map_offset, length, target_offset, target, target_id); a map's records are one value."""

    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["map_offset"])
        names = {r["target_id"]: r["target"] for r in rows}
        idx = "\n".join(names.get(i, "") for i in range(max(names) + 1)).encode()
        packed = b"".join(struct.pack(RANGE, r["map_offset"], r["length"], r["target_offset"], r["target_id"]) for r in rows)
        return pa.table([pa.array([rows[0]["map_urn"]]), pa.array([packed], pa.binary()), pa.array([idx], pa.binary())], ["map_urn", "map", "idx"])

    return ranges.groupBy("map_urn").applyInArrow(run, "map_urn string, map binary, idx binary")


def decode_index(indexes: DataFrame) -> DataFrame:
    """(urn, bevy_id, chunk_in_bevy, offset, length) of (urn, bevy_id, index): packed records of 12 bytes."""
    rows = indexes.select("urn", "bevy_id", F.posexplode(records("index", struct.calcsize(INDEX))).alias("chunk_in_bevy", "r"))
    return rows.select("urn", "bevy_id", "chunk_in_bevy", little_endian("r", 0, 8).alias("offset"), little_endian("r", 8, 4).alias("length"))


def elf_core_header(layout: list[tuple[int, int, int]]) -> bytes:
    """Header and program headers of a core file of (vaddr, size, file_offset) segments."""
    ident = b"\x7fELF\x02\x01\x01".ljust(16, b"\0")
    head = struct.pack(ELF_HEADER, ident, 4, 62, 1, 0, struct.calcsize(ELF_HEADER), 0, 0, struct.calcsize(ELF_HEADER), struct.calcsize(ELF_SEGMENT), len(layout), 0, 0, 0)
    return head + b"".join(struct.pack(ELF_SEGMENT, 1, 4, offset, vaddr, vaddr, size, size, 0) for vaddr, size, offset in layout)


def parse_elf_core(data: bytes) -> list[dict[str, int]]:
    """Loadable segments of a 64-bit x86 core file whose sizes in memory and file agree, by address."""
    ident, kind, machine, version, _, phoff, _, _, _, entry, n, *_ = struct.unpack_from(ELF_HEADER, data)
    if ident[:7] != b"\x7fELF\x02\x01\x01" or kind != 4 or machine != 62 or version != 1 or entry != struct.calcsize(ELF_SEGMENT):
        raise ValueError("not a 64-bit x86 core file")
    out = []
    for i in range(n):
        p_type, _, off, vaddr, paddr, filesz, memsz, _ = struct.unpack_from(ELF_SEGMENT, data, phoff + i * entry)
        if p_type == 1 and memsz == filesz:
            out.append({"vaddr": vaddr, "paddr": paddr, "off": off, "memsz": memsz, "filesz": filesz})
    return sorted(out, key=lambda s: s["vaddr"])


def write_raw(chunks, out) -> int:
    """Writes (position, payload) rows, ordered and read one by one, to a binary file; gaps become NUL bytes."""
    at = 0
    for row in chunks:
        if row["position"] > at:
            out.write(b"\0" * (row["position"] - at))
            at = row["position"]
        out.write(bytes(row["payload"]))
        at += len(row["payload"])
    return at
