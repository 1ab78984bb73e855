import io
import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest import commands
from palimpsest.operators import chunks
from palimpsest.sources import files, zip_volume
from palimpsest.vocabulary import CODEC_URNS, DATA_STREAM, IMAGE, MAP, NS, ORIGINAL_FILENAME, PREFIX, SCHEME, SIZE, STORED, TYPE, ZIP_SEGMENT

TEXT = "".join(f"Hello world {i:02d}!" for i in range(100)).encode()
BASE = f"{PREFIX}volume"


def test_chunks_of_the_sample_stream(spark):
    c = chunks.chunked(spark.createDataFrame([("s", TEXT), ("e", b"")], "urn string, data binary"), 10, 3).persist()
    assert c.count() == 150 and c.select("bevy_id").distinct().count() == 50
    assert chunks.read(c, "s", 0, 100, 10)[-10:] == b"Hello worl"[:10]
    for at in range(0, 1500, 375):
        assert chunks.read(c, "s", at, 13, 10) == TEXT[at : at + 13]
    assert chunks.read(c, "s", 1495, 100, 10) == TEXT[1495:] and chunks.read(c, "s", 0, 100, 10, limit=50) == b"" and chunks.read(c, "s", 9999, 5, 10) == b""
    entries = chunks.bevy_index(c).where("bevy_id = 1").orderBy("chunk_in_bevy").collect()
    assert [(r.offset, r.length) for r in entries] == [(0, 10), (10, 10), (20, 10)]
    wanted = spark.createDataFrame([("s", 4), ("s", 999)], "urn string, chunk_id bigint")
    assert {r.chunk_id: r.found for r in chunks.chunk_lookup(chunks.bevy_index(c), wanted, 3).collect()} == {4: True, 999: False}
    plan = c.where(chunks.chunk_filter(100, 20, 10))
    assert sorted(r.chunk_id for r in plan.collect()) == [10, 11]


@pytest.mark.parametrize("codec", list(CODEC_URNS))
def test_codecs(spark, codec):
    for data in (b"", b"a", TEXT, os.urandom(5000), b"ab" * 40000):
        packed = chunks.compress_bytes(data, codec)
        assert chunks.decompress_bytes(packed, codec, 1 << 20) == data
    rows = spark.createDataFrame([("s", TEXT + os.urandom(300))], "urn string, data binary")
    stored = chunks.compress(chunks.chunked(rows, 256, 4), codec, 256)
    back = chunks.decompress(stored.drop("payload"), codec, 256).orderBy("chunk_id").collect()
    assert b"".join(bytes(r.payload) for r in back) == bytes(rows.first().data) and not any(r.error for r in back)


def test_damaged_chunk_is_an_error_of_its_own(spark):
    df = spark.createDataFrame([(1, b"junk", False), (2, chunks.compress_bytes(b"ok", "zlib"), False)], "i int, stored binary, is_raw boolean")
    got = {r.i: (r.payload and bytes(r.payload), r.error is None) for r in chunks.decompress(df, "zlib").collect()}
    assert got == {1: (None, False), 2: (b"ok", True)}


def make_zip(prefix=b"", corrupt=False):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = BASE.encode()
        z.writestr("Foobar.txt", b"I am a segment!", zipfile.ZIP_STORED)
        z.writestr("a%21/b.txt", b"x" * 1000)
        with z.open(zipfile.ZipInfo("big64"), "w", force_zip64=True) as f:
            f.write(b"zip64")
    data = buffer.getvalue()
    if corrupt:
        data = data.replace(b"I am a segment!", b"I am a segmant!")
    return prefix + data


@pytest.mark.parametrize("prefix", [b"", b"pad pad pad pad pad pad pad"])
def test_zip_reader(spark, tmp_path, prefix):
    (tmp_path / f"v.{SCHEME}").write_bytes(make_zip(prefix))
    zip_volume.register(spark)
    got = {r.member: r for r in spark.read.format("zip_volume").option("path", str(tmp_path)).load().collect()}
    assert bytes(got["Foobar.txt"].payload) == b"I am a segment!" and got["Foobar.txt"].urn == f"{BASE}/Foobar.txt" and got["Foobar.txt"].method == "stored"
    assert got["a%21/b.txt"].urn == f"{BASE}/a!/b.txt" and got["a%21/b.txt"].csize < 1000 and bytes(got["big64"].payload) == b"zip64"
    assert all(r.crc_ok and r.volume == BASE for r in got.values())


def test_zip_crc_is_reported(spark, tmp_path):
    (tmp_path / f"v.{SCHEME}").write_bytes(make_zip(corrupt=True))
    zip_volume.register(spark)
    got = {r.member: r.crc_ok for r in spark.read.format("zip_volume").option("path", str(tmp_path / f"v.{SCHEME}")).load().collect()}
    assert got == {"Foobar.txt": False, "a%21/b.txt": True, "big64": True}


@pytest.mark.parametrize("codec", ["zlib", "snappy", "lz4", "deflate", "none"])
def test_ingest_and_read_back(spark, tmp_path, codec):
    big = TEXT * 20 + os.urandom(777)
    source = spark.createDataFrame([("/etc/small.txt", b"Hello world"), ("/dev/big", big)], "name string, data binary")
    commands.ingest(source, str(tmp_path / "out"), BASE, codec, chunk_size=512, per_bevy=4, threshold=1000, volumes=2)
    v = commands.load_volumes(spark, str(tmp_path / "out"))
    assert sorted(r.s for r in v.list_images().collect()) == [f"{BASE}/dev/big", f"{BASE}/etc/small.txt"]
    assert v.read(f"{BASE}/etc/small.txt", 6, 100) == b"world"
    assert v.read(f"{BASE}/dev/big", 1000, 5000) == big[1000:6000] and v.object_size(f"{BASE}/dev/big") == len(big)
    assert v.read(f"{BASE}/dev/big", len(big) - 5, 50) == big[-5:]
    assert v.get_property(f"{BASE}/dev/big", ORIGINAL_FILENAME, "string") == "/dev/big" and v.get_property(f"{BASE}/dev/big", ORIGINAL_FILENAME, "integer") is None
    assert commands.open_image(spark, str(tmp_path / "out"))[1] == f"{BASE}/dev/big"
    assert {r.target for r in v.export_plan("*BIG").collect()} == {"volume/dev/big"}
    assert IMAGE in v.view()


@pytest.mark.parametrize("codec, tail", [("zlib", 501), ("snappy", 507), ("lz4", 509), ("deflate", 501)])
def test_last_chunk_that_compresses_to_just_a_chunk(spark, tmp_path, codec, tail):
    data = {f"f{n}": TEXT * 20 + random.Random(n).randbytes(-len(TEXT * 20) % 512 + tail + n) for n in (-1, 0, 1)}
    assert len(chunks.compress_bytes(data["f0"][-tail:], codec)) == 512
    source = spark.createDataFrame([(k, bytearray(d)) for k, d in data.items()], "name string, data binary")
    commands.ingest(source, str(tmp_path / "out"), BASE, codec, chunk_size=512, per_bevy=4, threshold=1000)
    v = commands.load_volumes(spark, str(tmp_path / "out"))
    rows = sorted(v.chunks().collect(), key=lambda r: r.chunk_id)
    assert all(r.error is None and r.length == len(r.payload) for r in rows)
    assert {k: b"".join(bytes(r.payload) for r in rows if r.urn == f"{BASE}/{k}") for k in data} == data
    end = len(data["f0"])
    assert v.read(f"{BASE}/f0", end - 600, 700) == data["f0"][-600:]


def stored(spark, members, meta):
    segments = spark.createDataFrame([(n, d, len(d)) for n, d in members.items()], "urn string, payload binary, size bigint")
    rows = [("v", s, p, o, dt, i) for i, (s, p, o, dt) in enumerate(meta)]
    rows += [("v", n, STORED, "v", "urn", 0) for n in members] + [("v", n, TYPE, ZIP_SEGMENT, "urn", 1 << 40) for n in members]
    return commands.Volumes(segments, spark.createDataFrame(rows, "volume string, s string, p string, o string, dt string, seq bigint"))


def test_maps_and_symbolic_streams_are_read_and_exported(spark, tmp_path):
    packed = b"".join(struct.pack("<QQQI", *r) for r in [(0, 10, 4, 0), (20, 10, 0, 1), (30, 6, 4, 0), (40, 5, 17, 0), (47, 8, 2, 2)])
    m, inner = f"{BASE}/m", f"{BASE}/inner"
    members = {f"{BASE}/data": b"0123456789abcdefghij", f"{m}/map": packed, f"{m}/idx": f"{BASE}/data\r\n{NS}UnreadableData\r\n{inner}\r\n".encode(), f"{inner}/map": struct.pack("<QQQI", 0, 10, 0, 0), f"{inner}/idx": f"{BASE}/data".encode()}
    meta = [(m, TYPE, MAP, "urn"), (m, SIZE, "60", "integer"), (inner, TYPE, MAP, "urn"), (f"{BASE}/memory", TYPE, IMAGE, "urn"), (f"{BASE}/memory", DATA_STREAM, m, "urn")]
    v = stored(spark, members, meta)
    want = b"456789abcd" + b"\0" * 10 + b"UNREADABLE" + b"456789" + b"\0" * 4 + b"hij\0\0" + b"\0\0" + b"23456789" + b"\0" * 5
    assert len(want) == 60 and v.read(f"{BASE}/memory", 0, 100) == want and v.read(m, 25, 8) == want[25:33]
    assert (v.object_size(f"{BASE}/memory"), v.object_size(m), v.object_size(inner)) == (60, 60, 10)
    assert v.read(f"{NS}UnknownData", 5, 9) == b"WNUNKNOWN" and v.read(f"{NS}SymbolicStream0A", 3, 2) == b"\n\n"
    got = {s: (target, n, error) for s, target, n, error in v.export(str(tmp_path), piece=7)}
    assert set(got) == {m, inner, f"{BASE}/memory"} and all(error is None for _, _, error in got.values())
    assert all((tmp_path / got[s][0]).read_bytes() == want for s in (m, f"{BASE}/memory")) and (tmp_path / got[inner][0]).read_bytes() == b"0123456789"


def test_older_indexes_are_read_and_missing_ones_are_errors(spark):
    parts = [TEXT[i : i + 100] for i in range(0, 600, 100)]
    packed = [chunks.compress_bytes(p, "zlib") for p in parts]
    members, urn = {}, f"{BASE}/old"
    for b in range(2):
        own = packed[3 * b : 3 * b + 3]
        members[f"{urn}/{b:08d}"] = b"".join(own)
        members[f"{urn}/{b:08d}/index"] = struct.pack("<3I", *(sum(map(len, own[: i + 1])) for i in range(3)))
    meta = [(urn, TYPE, f"{NS}ImageStream", "urn"), *((s, p, o, dt) for s, p, o, dt in chunks.metadata(urn, 600, "zlib", 100, 3)[1:])]
    v = stored(spark, members, meta)
    assert v.read(urn, 0, 1000) == TEXT[:600] and v.read(urn, 250, 100) == TEXT[250:350]
    for lost in ("00000001/index", "00000001"):
        v = stored(spark, {k: d for k, d in members.items() if k != f"{urn}/{lost}"}, meta)
        assert v.read(urn, 0, 300) == TEXT[:300]
        with pytest.raises(Exception, match="bevy 1 of .* has no"):
            v.read(urn, 250, 100)
    v = stored(spark, {k: d for k, d in members.items() if "00000001" not in k}, meta)
    with pytest.raises(OSError, match="lacks chunks"):
        v.read(urn, 250, 100)


def test_directory_volume(spark, tmp_path):
    rows = spark.createDataFrame([("Foobar.txt", b"Hello world"), ("a:b/c", b"x")], "member string, payload binary")
    files.write_directory(rows, str(tmp_path / "d"))
    got = {r.member: (bytes(r.payload), r.urn) for r in files.read_directory(spark, str(tmp_path / "d"), BASE).collect()}
    assert got["Foobar.txt"] == (b"Hello world", f"{BASE}/Foobar.txt") and got["a%3Ab/c"] == (b"x", f"{BASE}/a:b/c")
    files.delete_directory(str(tmp_path / "d"))
    assert not (tmp_path / "d").exists()


def test_map_records(spark):
    packed = struct.pack("<QQQI", 0, 10, 1 << 40, 1) + struct.pack("<QQQI", 30, 5, 7, 0)
    got = files.decode_map(spark.createDataFrame([("m", packed, b"one\r\ntwo\r\n")], "map_urn string, map binary, idx binary"))
    assert sorted((r.map_offset, r.length, r.target_offset, r.target) for r in got.collect()) == [(0, 10, 1 << 40, "two"), (30, 5, 7, "one")]
    back = files.encode_map(got).first()
    assert bytes(back.map) == packed and bytes(back.idx) == b"one\ntwo"
    index = spark.createDataFrame([("s", 3, struct.pack("<QI", 0, 9) + struct.pack("<QI", 9, 4))], "urn string, bevy_id bigint, index binary")
    assert [(r.offset, r.length) for r in files.decode_index(index).orderBy("chunk_in_bevy").collect()] == [(0, 9), (9, 4)]


def test_core_files():
    layout = [(0x1000, 10, 176), (0x5000, 20, 186)]
    head = files.elf_core_header(layout)
    assert len(head) == 64 + 2 * 56
    assert [(s["vaddr"], s["memsz"], s["off"]) for s in files.parse_elf_core(head)] == layout
    with pytest.raises(ValueError):
        files.parse_elf_core(b"\0" * 200)
    out = io.BytesIO()
    assert files.write_raw([{"position": 0, "payload": b"ab"}, {"position": 4, "payload": b"c"}], out) == 5 and out.getvalue() == b"ab\0\0c"


def test_symbolic_and_choice(spark):
    r = spark.range(1).select(chunks.symbolic("UNKNOWN", F.lit(5), F.lit(9)).alias("a"), chunks.symbolic(b"\x00", F.lit(3), F.lit(2)).alias("b")).first()
    assert r.a == "WNUNKNOWN" and bytes(r.b) == b"\0\0"
    sizes = spark.createDataFrame([(0,), (5,), (10 << 20,)], "n bigint")
    assert [x[0] for x in sizes.select(chunks.storage_choice("n")).collect()] == ["image", "segment", "image"]
