"""Zip container volumes as a Spark data source, ``spark.read.format("zip_volume")``.

Reading plans partitions from each archive's central directory, a run of members each, so that a large volume is read
by many tasks and none holds more than one member. Filters on member, urn and volume are pushed into the reader: members
that they exclude are neither planned nor inflated. Archives appended to other data and zip64 archives are read; the
comment names the volume. Writing makes one volume a task, committed under its final name when all tasks are done.
"""

from __future__ import annotations

import datetime
import io
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from palimpsest.vocabulary import CONTAINER_DESCRIPTION, INFORMATION_TURTLE, SCHEME, VERSION_TXT

SCHEMA = "volume string, member string, urn string, method string, size bigint, csize bigint, crc32 bigint, crc_ok boolean, mtime timestamp_ntz, header_offset bigint, payload binary"
#: Uncompressed bytes that a partition reads, beyond which the next member starts another.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path, or one after ``file:``, is the machine's own."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def expand(path: str) -> list[str]:
    """The files that a path, a folder of archives or a pattern in the last part names."""
    import fnmatch

    fs, local = file_system(path)
    head, _, last = local.rpartition("/")
    prefix = path[: len(path) - len(local)] if path.endswith(local) and "://" in path else ""
    if any(c in last for c in "*?["):
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(head or ".")) if i.is_file and fnmatch.fnmatch(i.base_name, last)]
    elif fs.get_file_info(local).type == pafs.FileType.Directory:
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(local)) if i.is_file and i.base_name.endswith(f".{SCHEME}")]
    else:
        found = [local]
    return sorted(prefix + f if prefix and not f.startswith(prefix) else f for f in found)


def open_archive(path: str) -> zipfile.ZipFile:
    fs, local = file_system(path)
    return zipfile.ZipFile(io.BufferedReader(_Raw(fs.open_input_file(local)), 1 << 20))


class _Raw(io.RawIOBase):
    """An Arrow file as a seekable raw stream."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        return self.f.seek(offset, whence)

    def tell(self):
        return self.f.tell()

    def readinto(self, b):
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def volume_urn(archive: zipfile.ZipFile, path: str) -> str:
    """The archive's comment, else its description member, else the path."""
    comment = archive.comment.rstrip(b"\0").decode("utf-8", "replace")
    if comment:
        return comment
    if CONTAINER_DESCRIPTION in archive.namelist():
        return archive.read(CONTAINER_DESCRIPTION).decode("utf-8", "replace").strip("\0\n ")
    return path


def urn_of(member: str, volume: str) -> str:
    """The URN of a member: decoded; absolute, or below the volume's."""
    from urllib.parse import unquote

    name = unquote(member).replace("\0", "")
    if name.startswith(f"{SCHEME}:"):
        return name
    parts: list[str] = []
    for x in name.split("/"):
        if x == "..":
            del parts[-1:]
        elif x not in ("", "."):
            parts.append(x)
    return volume.rstrip("/\\") + "".join(f"/{x}" for x in parts)


METHODS = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflate"}


@dataclass
class Members(InputPartition):
    """Members of one archive, by their places in its directory."""

    path: str
    places: list[int]


class ZipVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ZipWriter(self.options, schema, overwrite)


class ZipReader(DataSourceReader):
    """Options: ``path``; ``payload`` (false: the column stays null and nothing but the directory is read)."""

    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in ("member", "urn", "volume"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            else:
                yield f

    def wanted(self, member: str, volume: str) -> bool:
        value = {"member": member, "volume": volume}
        for name, kind, given in self.tests:
            v = urn_of(member, volume) if name == "urn" else value[name]
            if not (v in given if kind == "in" else v.startswith(given[0])):
                return False
        return True

    def partitions(self) -> list[Members]:
        out = []
        for path in expand(self.path):
            with open_archive(path) as archive:
                places, size = [], 0
                volume = volume_urn(archive, path)
                for i, info in enumerate(archive.infolist()):
                    if not self.wanted(info.filename, volume):
                        continue
                    places.append(i)
                    size += info.file_size
                    if size >= PARTITION_BYTES and self.with_payload:
                        out.append(Members(path, places))
                        places, size = [], 0
                if places:
                    out.append(Members(path, places))
        return out or [Members("", [])]

    def read(self, partition: Members):
        if not partition.places:
            return
        with open_archive(partition.path) as archive:
            volume, rows, held = volume_urn(archive, partition.path), [], 0
            infos = archive.infolist()
            for info in map(infos.__getitem__, partition.places):
                payload, ok = None, None
                if self.with_payload:
                    try:
                        payload, ok = archive.read(info), True
                    except zipfile.BadZipFile:  # reported, not verified away
                        payload, ok = raw_read(archive, info), False
                year, month, day, hour, minute, second = info.date_time
                try:
                    mtime = datetime.datetime(year, month, day, hour, minute, min(second, 59))
                except ValueError:
                    mtime = None
                rows.append((volume, info.filename, urn_of(info.filename, volume), METHODS.get(info.compress_type, str(info.compress_type)), info.file_size, info.compress_size, info.CRC, ok, mtime, info.header_offset, payload))
                held += len(payload or b"")
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.timestamp("us"), pa.int64(), pa.binary()]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names)


def raw_read(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | None:
    """A member's bytes without the check of its CRC-32; null if they can't be inflated."""
    try:
        with archive.open(info) as f:
            f._expected_crc = None
            return f.read()
    except (zipfile.BadZipFile, zlib.error, EOFError):
        return None


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    members: int


class ZipWriter(DataSourceWriter):
    """Rows need ``member`` and ``payload``; ``method`` may be given for each, and ``turtle``, text that goes into the metadata
    member of the row's own volume. Options: ``path`` (a folder), ``urn`` (of the volumes, with the part's number),
    ``turtle`` (text that each volume's metadata member begins with)."""

    def __init__(self, options, schema, overwrite):
        self.path, self.urn, self.turtle, self.overwrite = options["path"], options.get("urn", f"{SCHEME}://volume"), options.get("turtle"), overwrite
        self.columns = [f.name for f in schema.fields]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        final = f"{folder}/part-{part:05d}.{SCHEME}"
        temporary = f"{folder}/_part-{part:05d}-{context.taskAttemptId()}.tmp"
        urn, n = f"{self.urn}-{part:05d}", 0
        with fs.open_output_stream(temporary) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, allowZip64=True, compresslevel=9) as z:
            z.comment = urn.encode()
            stamp = (1980, 1, 1, 0, 0, 0)
            put = lambda name, data, method: z.writestr(zipfile.ZipInfo(name, stamp), data, zipfile.ZIP_STORED if method == "stored" else zipfile.ZIP_DEFLATED)
            put(CONTAINER_DESCRIPTION, urn.encode(), "stored")
            put(VERSION_TXT, b"major=1\nminor=0\n", "stored")
            metadata = [self.turtle or ""]
            for row in iterator:
                put(row["member"], bytes(row["payload"] or b""), row["method"] if "method" in self.columns else "deflate")
                if "turtle" in self.columns and row["turtle"]:
                    metadata.append(row["turtle"])
                n += 1
            if any(metadata):
                put(INFORMATION_TURTLE, "".join(metadata).encode(), "deflate")
        return Written(temporary, final, n)

    def commit(self, messages) -> None:
        fs, folder = file_system(self.path)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if info.base_name.endswith(f".{SCHEME}"):
                    fs.delete_file(info.path)
        for m in messages:
            fs.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.temporary).type != pafs.FileType.NotFound:
                fs.delete_file(m.temporary)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand filters to readers written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipVolume)
