import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunks, triples, volumes
from palimpsest.sources import turtle
from palimpsest.vocabulary import DATA_STREAM, IMAGE, IMAGE_STREAMS, LEGACY_IMAGE, MAP, NS, PREFIX, STORED, SYMBOLIC_PREFIX, TYPE, VOLATILE_NS, XSD, ZIP_SEGMENT


def store(spark, rows):
    return spark.createDataFrame([("v", *r, i) for i, r in enumerate(rows, 1)], triples.SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_set_and_get(spark):
    w = spark.createDataFrame([("v", "hello", "World", "foo", "string", 1, True), ("v", "hello", "World", "bar", "string", 2, True), ("v", "hello", "World", "baz", "string", 3, False)], triples.SCHEMA + ", replace boolean")
    after = triples.set_values(w)
    assert rows(after.select("o")) == [("bar",), ("baz",)]
    assert triples.get(after, "hello", "World", "string").first().o == "baz"
    assert triples.get(after, "hello", "World", "hexBinary").first() is None
    assert triples.get_all(after).first()["values"] == ["bar", "baz"]
    assert rows(triples.types(after)) == [("hello", ZIP_SEGMENT)]
    assert triples.attributes(after).first().attributes == {"World": ["bar", "baz"]}
    assert triples.clear(spark).count() == 0


def test_queries(spark):
    t = store(spark, [("a", TYPE, IMAGE, "urn"), ("b", TYPE, IMAGE, "urn"), ("b", "p", "1", "integer"), ("a", TYPE, IMAGE, "urn"), ("c", "p", "01", "string"), ("0", TYPE, LEGACY_IMAGE, "urn")])
    assert rows(triples.query(t, TYPE, IMAGE)) == [("a",), ("b",)]
    assert rows(triples.query(t, "p", "1")) == [("b",)]
    assert triples.first_image(t).first().s == "a"
    assert triples.first_image(t.where(f"o <> '{IMAGE}'")).first().s == "0"
    keys = spark.createDataFrame([("b", "p", "1"), ("c", "p", "1"), ("z", "p", "1")], "s string, p string, o string")
    assert rows(triples.has_subject(t, keys.select("s"))) == [("b",), ("c",)]
    assert rows(triples.has_attribute(t, keys.select("s", "p"))) == [("b", "p"), ("c", "p")]
    assert rows(triples.has_value(t, keys)) == [("b", "p", "1")]
    assert rows(triples.subjects_by_prefix(t, "b")) == [("b",)]
    assert rows(triples.delete_subjects(t, spark.createDataFrame([("a",), ("b",)], "s string")).select("s")) == [("0",), ("c",)]
    assert rows(triples.query(triples.standard_names(t), TYPE, IMAGE)) == [("0",), ("a",), ("b",)]


def test_suppression(spark):
    t = store(spark, [("seg", TYPE, ZIP_SEGMENT, "urn"), ("seg", STORED, "v", "urn"), ("seg", "x", "1", "string"), ("free", "x", "2", "string"), ("img", TYPE, IMAGE, "urn"), ("img", STORED, "v", "urn"), ("img", f"{VOLATILE_NS}f", "3", "string")])
    assert rows(triples.dump(t).select("s", "o")) == [("img", IMAGE), ("img", "v"), ("seg", "1")]
    assert rows(triples.dump(t, verbose=True).select("s", "o")) == [("img", "3"), ("img", IMAGE), ("img", "v"), ("seg", "1")]


TEXT = f"""@prefix a: <{NS}> .
@prefix xsd: <{XSD}> .
# a comment
<{PREFIX}x> a a:Image , a:Map ;
    a:size "0x10"^^xsd:long ; a:name "tab\\t\\"q\\" \\u00e9"@en ;
    a:count 12 ; a:flag true ; a:odd "zz"^^xsd:integer ; a:new "1"^^<urn:unknown> .
_:b a:size 3 .
<{PREFIX}y> a:of _:b .
"""


def test_turtle(spark):
    t = turtle.of_texts(spark.createDataFrame([("v", TEXT)], "volume string, value string"))
    assert rows(t.select("p", "o", "dt")) == sorted([(TYPE, IMAGE, "urn"), (TYPE, MAP, "urn"), (f"{NS}size", "16", "integer"), (f"{NS}name", 'tab\t"q" é', "string"), (f"{NS}count", "12", "integer"), (f"{NS}flag", "true", "boolean")])
    back = turtle.of_texts(turtle.statements(t).selectExpr("'v' AS volume", "value"))
    assert rows(back.select("s", "p", "o", "dt")) == rows(t.select("s", "p", "o", "dt"))
    with pytest.raises(ValueError):
        turtle.parse("<a> ??? <b> .")


def test_turtle_files(spark, tmp_path):
    (tmp_path / "x.turtle").write_text(TEXT)
    assert turtle.read(spark, str(tmp_path / "x.turtle")).count() == 6
    turtle.write(turtle.read(spark, str(tmp_path / "x.turtle")), str(tmp_path / "out"))
    assert turtle.header().startswith("@prefix")


def test_resolution(spark):
    delegate = lambda a, b: [(a, TYPE, IMAGE, "urn"), (a, DATA_STREAM, b, "urn")]
    chain = [x for i in range(12) for x in delegate(f"c{i}", f"c{i + 1}")]
    t = store(spark, [*chain, ("c12", TYPE, MAP, "urn"), *delegate("loop1", "loop2"), *delegate("loop2", "loop1"), *delegate("lost", "nowhere"), *delegate("zero", f"{SYMBOLIC_PREFIX}0A"), ("seg", STORED, "v", "urn"), ("img", TYPE, IMAGE_STREAMS[1], "urn"), ("plain", "x", "y", "string")])
    got = {r.s: (r.stream, r.kind, r.hops) for r in volumes.resolve(t).collect()}
    assert got["c0"] == ("c12", "map", 12) and got["c11"] == ("c12", "map", 1) and got["c12"] == ("c12", "map", 0)
    assert got["loop1"][1] == got["loop2"][1] == "not_found" and got["lost"][1] == "not_found"
    assert got["zero"][:2] == (f"{SYMBOLIC_PREFIX}0A", "symbolic") and got["seg"][1] == "segment" and got["img"][1] == "image" and got["plain"][1] == "not_found"


def test_parts_and_volumes(spark):
    s = spark.createDataFrame([("v", i, 4) for i in range(7)], "volume string, k int, size int")
    assert [r.part for r in sorted(volumes.split_parts(s, ["k"], "size", 8).collect(), key=lambda r: r.k)] == [0, 0, 1, 1, 2, 2, 3]
    assert volumes.part_name("x", 0) == "x" and volumes.part_name("x", 3) == "x.A03"
    more = spark.createDataFrame([("v", 9, 1), ("w", 9, 1)], "volume string, k int, size int")
    assert volumes.add_volumes(s, more).count() == 8


def test_stream_parameters(spark):
    meta = [(*m,) for m in chunks.metadata("s", 1500, "snappy", 10, 3)]
    t = store(spark, [*meta, ("old", TYPE, IMAGE_STREAMS[1], "urn"), ("bad", TYPE, IMAGE_STREAMS[0], "urn"), ("bad", f"{NS}compressionMethod", "urn:no", "urn")])
    got = {r.s: (r.chunk_size, r.per_bevy, r["size"], r.codec, r.status) for r in chunks.parameters(t).collect()}
    assert got == {"s": (10, 3, 1500, "snappy", "STATUS_OK"), "old": (32768, 1024, None, "zlib", "STATUS_OK"), "bad": (32768, 1024, None, None, "NOT_IMPLEMENTED")}


def test_groupings_of_text_sort_no_more_than_a_partition(spark):
    t = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 100).alias("s"), F.lit(TYPE).alias("p"), F.lit(IMAGE_STREAMS[0]).alias("o"), F.lit("urn").alias("dt"), F.col("id").alias("seq"))
    for df, n in ((chunks.parameters(t), 100), (triples.get(t), 100), (triples.types(t), 100), (triples.get_all(t), 100), (volumes.classify(t), 100)):
        lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
        first = max(i for i, x in enumerate(lines) if "Exchange" in x)  # the deepest: what a task does with its input is below
        assert not any("Sort" in x or "Aggregate" in x for x in lines[first:]) and any("Aggregate" in x for x in lines[:first])
        assert df.count() == n
