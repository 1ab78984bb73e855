"""WARC archives with revisit resolution.

Only headers (identifier, payload digest, length) are shuffled by digest; of equal payloads one stays a response, the
others become revisits that refer to it. Archives are written by Spark's text writer, whose line separator is the end
of a WARC record, so that they can lie in any file system that Spark writes to; they are read back record by record,
framed by their Content-Length.
"""

from __future__ import annotations

import gzip
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.textops import PASS_BYTES, remove, shared_checkpoints, shared_folder

#: Payloads of fewer bytes are stored with every record.
LEAST_REVISIT = 1000
#: Classes of records by their bytes, each with files of its own: of so many records that a file holds FILE_BYTES at most,
#: but for records that are longer themselves.
FILE_BYTES, CLASSES = 32 << 20, (16 << 10, 256 << 10, 4 << 20, 1 << 62)
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id bigint, record_id string, record_type string, target_uri string, refers_to_id string, digest string, payload binary, error string"


def record_id(page_id: Column, digest: Column) -> Column:
    """A name that depends on page and payload only, so that a task that runs again writes the same record."""
    h = F.sha1(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolve(headers: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """From (page_id, digest, bytes): the rows that are revisits, as distinct (page_id, digest, original).

    The original of a digest is its largest page_id. The shuffle carries headers only. The join's key is the reversed
    digest, which no grouping has dealt yet: adaptive execution can then split a digest with very many rows.
    """
    shared = headers.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    wanted = headers.where(F.col("bytes") >= least).withColumn("k", F.reverse("digest"))
    joined = wanted.join(shared.select(F.reverse("digest").alias("k"), "original"), "k")
    return joined.where("NOT page_id <=> original").select("page_id", "digest", "original").distinct()


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Columns ``value``, with one whole WARC record (without its end) for each row of page_id, url and html, and ``bytes`` of its payload.

    A null html is an empty payload. Rows of the original's page_id and payload are responses, repeated ones too. A null
    page_id is never the original unless all page_ids of the payload are null, and then all its rows are responses.
    """
    p = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    found = resolve(p.select("page_id", "digest", "bytes"), least).select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "original")
    p = p.join(found, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.coalesce(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("original"), F.col("digest")))).substr(F.lit(1), F.when(revisit, 1 << 30).otherwise(0)), F.lit("")),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return p.select(F.concat(head, block).alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str) -> None:
    """Deduplicated archives, with fresh headers, as the gzipped files of a folder (one gzip stream a file).

    Records are written in classes of their payload's size, so that one long page makes no small files of the others.
    """
    def kind(size) -> Column:
        out = F.lit(len(CLASSES) - 1)
        for i, most in reversed(list(enumerate(CLASSES[:-1]))):
            out = F.when(size <= most, i).otherwise(out)
        return out

    found = records(pages)
    present = pages.select(kind(F.coalesce(F.octet_length("html"), F.lit(0))).alias("kind")).distinct().orderBy("kind").collect()
    for i in [r[0] for r in present] or [0]:
        per_file = max(1, FILE_BYTES // CLASSES[i])
        found.where(kind(F.col("bytes")) == i).select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def unpacked(content: bytes) -> tuple[bytes, str | None]:
    """An archive's bytes, and what is wrong with its gzip stream (then as far as it could be read)."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    try:
        return gzip.decompress(content), None
    except (OSError, EOFError, zlib.error) as e:
        try:
            return zlib.decompressobj(31).decompress(content), f"gzip: {e}"
        except zlib.error:
            return b"", f"gzip: {e}"


def parse(content: bytes):
    """The records of one archive, in order: (header fields with lower-case names, block, error).

    A record that can't be framed has its error in place of a block, and reading goes on at the next record's first line.
    """
    at = 0
    while at < len(content):
        fields, block, error, after = {}, b"", None, -1
        end = content.find(b"\r\n\r\n", at)
        first, *lines = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not first.startswith("WARC/"):
            error = f"no WARC record at byte {at}"
        else:
            fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
            length = fields.get("content-length", "")
            start = end + 4
            stop = start + int(length) if length.isdecimal() else -1
            if stop < 0 or content[stop : stop + 4] != b"\r\n\r\n":
                error = f"the record at byte {at} doesn't end where its length says"
            else:
                block, after = content[start:stop], stop + 4
        yield fields, block, error
        if error:
            following = content.find(b"\r\n\r\nWARC/", at + 1)
            after = following + 4 if following >= 0 else len(content)
        at = after


def record(fields: dict[str, str], block: bytes, error: str | None) -> tuple:
    """A row of READ. A record of another type than response and revisit has its block as payload."""
    kind, page = fields.get("warc-type"), fields.get("x-page-id", "")
    if not error and (kind is None or "warc-record-id" not in fields):
        error = "no type or no identifier"
    payload = None if error or kind == "revisit" else block.partition(b"\r\n\r\n")[2] if kind == "response" else block
    number = int(page) if page.lstrip("-").isdecimal() else None
    return number, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload, error


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of a folder's archives; ``payload`` is what follows the HTTP header, null for a revisit.

    What can't be read is a row with an ``error`` and no payload; the other records of its file are read all the same.
    """

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                data, broken = unpacked(content.as_py())
                held, size = [], 0
                for found in parse(data):
                    held.append(record(*found))
                    size += len(found[1])
                    if size >= PASS_BYTES:
                        yield table(held)
                        held, size = [], 0
                if broken:
                    held.append((*[None] * 7, broken))
                if held:
                    yield table(held)

    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    table = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, READ)


def resolved(archive: DataFrame) -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest (both from stored payloads), record_type and refers_to.

    A revisit is joined to the response that it refers to; one whose response is missing has nulls. Records with an
    error are left out. The archives are read once: headers and digests go to the checkpoint folder, payloads stay behind.
    """
    shared_checkpoints(archive.sparkSession)
    read = archive.where("error IS NULL").select("page_id", "record_id", "record_type", "refers_to_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")).checkpoint()
    own = read.where("record_type <> 'revisit'")
    wanted = read.where("record_type = 'revisit'").select("page_id", "record_type", F.reverse("refers_to_id").alias("k"))
    originals = own.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = wanted.join(originals.withColumn("k", F.reverse("record_id")), "k", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")).union(revisits)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder, reads them back, resolves their revisits and deletes the archives."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    out = resolved(read_archives(spark, path))
    remove(spark, path)
    return out
