import random

from palimpsest.operators import ranges
from palimpsest.vocabulary import UNREADABLE

SCHEMA = "map_urn string, map_offset bigint, target_offset bigint, length bigint, target string, seq bigint"
A, B = "a", "b"
INSERT = [(0, 0, 100, A), (50, 0, 10, B)]
SPARSE = [(0, 100, 10, A), (30, 130, 10, A)]
PROGRAMS = {
    "overlap": ([(0, 0, 100, A), (10, 10, 100, A)], [(0, 110, 0, A)]),
    "repeat": ([(0, 0, 100, A), (50, 0, 100, A)], [(0, 50, 0, A), (50, 100, 0, A)]),
    "insert": (INSERT, [(0, 50, 0, A), (50, 10, 0, B), (60, 40, 60, A)]),
    "replace all": ([*INSERT, (0, 0, 100, B)], [(0, 100, 0, B)]),
    "contiguous": ([(0, 100, 10, A), (10, 110, 10, A), (20, 120, 10, A), (30, 130, 10, A)], [(0, 40, 100, A)]),
    "sparse": (SPARSE, [(0, 10, 100, A), (30, 10, 130, A)]),
    "fill": ([*SPARSE, (10, 110, 20, A)], [(0, 40, 100, A)]),
    "nothing": ([(5, 0, 0, A)], []),
}


def frame(spark, programs):
    return spark.createDataFrame([(name, m, t, n, x, i) for name, p in programs.items() for i, (m, t, n, x) in enumerate(p)], SCHEMA)


def model(program):
    cells = {}
    for m, t, n, x in program:
        for k in range(n):
            cells[m + k] = (x, t + k)
    out = []
    for k in sorted(cells):
        x, t = cells[k]
        if out and out[-1][0] + out[-1][1] == k and out[-1][3] == x and out[-1][2] + out[-1][1] == t:
            out[-1][1] += 1
        else:
            out.append([k, 1, t, x])
    return [tuple(r) for r in out]


def collected(df):
    out = {}
    for r in df.select(ranges.OUT).collect():
        out.setdefault(r.map_urn, []).append((r.map_offset, r.length, r.target_offset, r.target))
    return {k: sorted(v) for k, v in out.items()}


def test_golden_programs(spark):
    got = collected(ranges.overlay(frame(spark, {k: p for k, (p, _) in PROGRAMS.items()})))
    assert got == {k: e for k, (_, e) in PROGRAMS.items() if e}


def test_random_programs_with_small_buckets(spark, monkeypatch):
    r = random.Random(5)
    programs = {f"m{i}": [(r.randrange(60), r.choice([0, 20, 40]) + r.randrange(20), r.randint(1, 30), r.choice("abc")) for _ in range(r.randint(1, 9))] for i in range(150)}
    programs["wide"] = [(i * 10, i * 10, 10, A) for i in range(200)]
    monkeypatch.setattr(ranges, "BUCKET_RANGES", 2)  # most maps have several buckets
    got = collected(ranges.overlay(frame(spark, programs)))
    assert got == {k: model(p) for k, p in programs.items()}
    assert len(got["wide"]) == 1


def test_gaps_lookup_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BUCKET_RANGES", 1)
    flat = spark.createDataFrame([("m", 4, 4, 0, A), ("m", 0, 4, 12, A), ("m", 12, 4, 16, A)], "map_urn string, map_offset bigint, length bigint, target_offset bigint, target string")
    gaps = ranges.with_gaps(flat, spark.createDataFrame([("m", 20)], "map_urn string, size bigint")).where("target IS NULL").collect()
    assert sorted((r.map_offset, r.length) for r in gaps) == [(8, 4), (16, 4)]
    data, out = b"AAAABBBBCCCCDDDDEEEEFFFFGGGGHHHH", bytearray(16)
    for r in ranges.compact(flat).collect():
        out[r.map_offset : r.map_offset + r.length] = data[r.target_offset : r.target_offset + r.length]
    assert bytes(out) == b"DDDDAAAA\0\0\0\0EEEE"
    assert b"".join(data[r.target_offset : r.target_offset + r.length] for r in sorted(ranges.compact(flat).collect(), key=lambda r: r.dense_offset)) == b"DDDDAAAAEEEE"
    asked = spark.createDataFrame([(1, "m", 2, 12), (2, "m", 30, 5), (3, "m", 0, 0), (4, "x", 0, 9)], "request_id int, map_urn string, offset bigint, length bigint")
    assert sorted(tuple(r) for r in ranges.lookup(flat, asked).select("request_id", "out_offset", "length", "target_offset").collect()) == [(1, 0, 2, 14), (1, 2, 4, 0), (1, 10, 2, 16)]


def test_written_map(spark):
    """Writes go to the end of the data stream; the map shows the newest."""
    w = spark.createDataFrame([("m", 1, 50, 26), ("m", 2, 0, 26), ("m", 3, 50, 2)], "map_urn string, seq bigint, map_offset bigint, length bigint")
    from pyspark.sql import functions as F

    got = collected(ranges.overlay(ranges.appended(w).withColumn("target", F.lit(A))))
    assert got["m"] == [(0, 26, 26, A), (50, 2, 52, A), (52, 24, 2, A)]


def test_unreadable_pages_merge(spark):
    f = frame(spark, {"m": [(i * 10, i * 10, 10, A) for i in range(6)]})
    got = collected(ranges.overlay(ranges.mark_unreadable(f, "map_offset IN (20, 30)")))
    assert got["m"] == [(0, 20, 0, A), (20, 20, 20, UNREADABLE), (40, 20, 40, A)]


def test_sizes_and_layout(spark):
    f = frame(spark, {"m": SPARSE, "n": INSERT})
    assert {r.map_urn: r["size"] for r in ranges.size(f).collect()} == {"m": 40, "n": 100}
    assert {r.map_urn: r["size"] for r in ranges.size(f, spark.createDataFrame([("m", 77)], "map_urn string, size bigint")).collect()} == {"m": 77, "n": 100}
    layout = ranges.elf_layout(f.where("map_urn = 'm'")).orderBy("vaddr").collect()
    assert [(r.vaddr, r.memsz, r.file_offset) for r in layout] == [(0, 10, 64 + 112), (30, 10, 64 + 112 + 10)]
