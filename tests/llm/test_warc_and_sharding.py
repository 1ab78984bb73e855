import gzip
import hashlib
import heapq
import random
import zlib

from helpers import docs, empty

from palimpsest.llm import sharding, warc

BIG, BIG2 = "<p>é" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "y" * 1000
PAGES = [
    (1, "http://a/\r\nX: y", BIG), (2, None, BIG), (9, "http://c", BIG), (9, "http://c", BIG),  # repeated row of the original
    (3, "http://d", "small"), (4, "http://e", "small"), (5, "http://f", None), (6, "http://g", ""),
    (7, "http://h", BIG2), (8, "http://i", BIG2), (10, "http://j", "z" * 999), (11, "http://k", "z" * 999), (None, "http://l", BIG2),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "1 AS bytes", "'y' AS original")


def brute_warc(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        original = max(same) if len(data) >= 1000 and same else page
        revisit = len(data) >= 1000 and original != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=repr)


def test_revisits(spark, tmp_path):
    p = pages(spark, PAGES)
    assert sorted(map(tuple, warc.round_trip(spark, p).collect()), key=repr) == brute_warc(PAGES)
    assert warc.round_trip(spark, pages(spark, [])).count() == 0
    path = str(tmp_path / "w")
    warc.write_archives(p, path)
    read = warc.read_archives(spark, path).collect()
    assert sorted(bytes(r.payload) for r in read if r.record_type == "response" and r.page_id in (9, 8)) == sorted([BIG.encode()] * 2 + [BIG2.encode()])
    assert all(r.payload is None and r.refers_to_id for r in read if r.record_type == "revisit")
    ids = {r.record_id for r in read if r.record_type == "response"}
    assert {r.refers_to_id for r in read if r.record_type == "revisit"} <= ids
    assert {r.target_uri for r in read if r.page_id == 1} == {"http://a/X: y"}


def test_damaged_records_are_errors_of_their_own(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(b, e) for _, b, e in warc.parse(good * 2)] == [(b"ab", None)] * 2
    for bad in (good.replace(b": 2", b": 1"), b"HTTP/1.1\r\n\r\n", good.replace(b": 2", b": two"), good.replace(b"Content-Length: 2", b"X: 1")):
        found = list(warc.parse(bad + good))
        assert found[0][2] and found[0][1] == b"" and (len(found) == 1 or found[1][1:] == (b"ab", None))
        assert warc.record(*found[0])[6:] == (None, found[0][2])
    whole = gzip.compress(good * 3)
    for name, data in (("a", good.replace(b": 2", b": 9") + good), ("b", whole[: len(whole) - 12]), ("c", b"\x1f\x8bnonsense"), ("d", b""), ("e", good.replace(b"WARC-Type: response", b"X-Page-Id: x"))):
        (tmp_path / name).write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in rows) >= 2 and sum(r.error is not None for r in rows) >= 3
    assert all((r.payload is None) == (r.error is not None) for r in rows)
    assert warc.resolved(warc.read_archives(spark, str(tmp_path))).count() == sum(r.error is None for r in rows)


def test_one_long_page_makes_no_small_files(spark, tmp_path):
    rows = [(i, "u", f"page {i}") for i in range(300)] + [(1000, "u", "z" * 3_000_000), (1001, "u", "y" * 3_000_000)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    assert len([f for f in (tmp_path / "w").iterdir() if f.name.endswith(".gz")]) <= 8
    assert sorted(map(tuple, warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect()), key=repr) == brute_warc(rows)


def test_a_hot_digest_is_split(spark):
    """Half of the rows share one digest: adaptive execution splits the join that resolves them."""
    old = {k: spark.conf.get(k, None) for k in HOT}
    try:
        for k, v in HOT.items():
            spark.conf.set(k, v)
        headers = spark.range(120_000).selectExpr("id AS page_id", "sha1(CAST(IF(id % 2 = 0, 'hot', CAST(id % 9000 AS STRING)) AS binary)) AS digest", "2000 AS bytes").repartition(8)
        found = warc.resolve(headers)
        assert found.where("original = 119998").count() == 59_999
        found.collect()
        assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Settings under which a small table shows what adaptive execution can split.
HOT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_plan_is_the_heap_schedule():
    r = random.Random(3)
    for _ in range(500):
        shards = r.randint(1, 6)
        sizes = [(s, s, r.randint(1, 30)) for s in sorted({r.choice([r.randint(1, 9), r.randint(1, 400)]) for _ in range(r.randint(1, 8))}, reverse=True)]
        got = [turn[i % len(turn)] for _, _, n, turn in sharding.plan(sizes, shards) for i in range(n)]
        heap, want = [(0, i) for i in range(shards)], []
        for _, s, count in sizes:
            for _ in range(count):
                load, i = heapq.heappop(heap)
                want.append(i)
                heapq.heappush(heap, (load + s, i))
        assert got == want


def check_shards(rows, source, shards=16):
    text_of = {}
    for r in source:
        text_of.setdefault(r.doc_id, r.text or "")
    slots, home, loads = {}, {}, [0] * shards
    for r in rows:
        data = text_of[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault(data, r.shard) == r.shard
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_shards(spark):
    d = docs(spark)
    got = sharding.shard(d).collect()
    assert len(got) == d.count()
    check_shards(got, d.collect())
    assert sharding.shard(empty(spark)).count() == 0
    r = random.Random(1)
    many = spark.createDataFrame([(i, "x" * r.choice([0, 5, 5, 40, 900]) + str(r.randrange(150))) for i in range(900)], "doc_id bigint, text string")
    loads = check_shards(sharding.shard(many).collect(), many.collect())
    assert max(loads) - min(loads) <= 2000 and sharding.shard(many, 3).select("shard").distinct().count() == 3


def test_groups_over_a_mebibyte_follow_the_exact_heap(spark):
    size = lambda i: (1 << 20) + i * 37 % 700
    rows = spark.range(40).selectExpr("id AS doc_id", "concat(repeat('y', CAST(1048576 + id * 37 % 700 AS INT)), '-', id) AS text")
    texts = [f"{'y' * size(i)}-{i}".encode() for i in range(40)]
    loads, want = [0] * 4, {}
    for n, _, i in sorted((-len(t) - 1, hashlib.sha256(t).hexdigest(), i) for i, t in enumerate(texts)):
        want[i] = loads.index(min(loads))
        loads[want[i]] -= n
    assert {r.doc_id: r.shard for r in sharding.shard(rows, 4).collect()} == want
