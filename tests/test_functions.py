import pytest
from pyspark.sql import functions as F

from palimpsest.functions import urns, values
from palimpsest.vocabulary import PREFIX, SCHEME, XSD

BASE = f"{PREFIX}98a6dad6-4918-4728-ac59-e6b6b2a20d0a"


def one(spark, column, **names):
    row = spark.createDataFrame([tuple(names.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'bigint'}" for n, v in names.items())) if names else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("component", "expected"), [
    ("foobar", "/foobar"), ("/foobar", "/foobar"), ("..", ""), ("../../../..", ""), ("aa/bb/../..", ""), ("aa//../c", "/c"), ("aa///////////.///./c", "/aa/c"),
])
def test_append(spark, component, expected):
    assert one(spark, urns.append(F.lit("http://www.google.com"), "c"), c=component) == f"http://www.google.com{expected}"


@pytest.mark.parametrize(("urn", "member"), [
    (f"{BASE}/URN-with!special$chars/and/path", "URN-with%21special%24chars/and/path"),
    (f"{BASE}/C:/Windows/notepad.exe", "C%3A/Windows/notepad.exe"),
    (f"{PREFIX}123456/URN-with!special$chars/and/path", f"{SCHEME}%3A%2F%2F123456/URN-with%21special%24chars/and/path"),
])
def test_member_names(spark, urn, member):
    assert one(spark, urns.member_name("u", F.lit(BASE)), u=urn) == member
    assert one(spark, urns.urn_from_member("m", F.lit(BASE)), m=member) == urn


def test_parts(spark):
    assert one(spark, F.struct(urns.scheme("u"), urns.domain("u"), urns.path("u")), u=f"{PREFIX}dom/a/b") == (SCHEME, "dom", "a/b")
    assert one(spark, F.struct(urns.scheme("u"), urns.domain("u"), urns.path("u")), u="file:///etc/x") == ("file", "", "/etc/x")
    assert one(spark, F.struct(urns.scheme("u"), urns.domain("u"), urns.path("u")), u="http://x/y") == ("", "", "")
    assert one(spark, urns.relative_path(F.lit("ab"), "u"), u="abc") == "c"
    assert one(spark, urns.path_components("u"), u=f"{PREFIX}d/x\\y//z") == [f"{PREFIX}d", "x", "y", "z"]
    assert one(spark, urns.urn_from_member("m", F.lit(BASE)), m="%zz") is None
    assert urns.absolute_path("a", "/w") == "/w/a" and urns.absolute_path("C:x", "/w") == "C:x"
    assert urns.filename_from(urns.file_urn_of("/a b%c")) == "/a b%c"


@pytest.mark.parametrize(("pattern", "text", "match"), [("*.TXT", "a/b.txt", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[!a]*", "abc", False), ("@(x|y)z", "YZ", True), ("a.c", "abc", False), ("+(ab)", "abab", True)])
def test_glob(spark, pattern, text, match):
    assert one(spark, urns.glob_match("t", pattern), t=text) is match


@pytest.mark.parametrize(("text", "value"), [
    ("1152789563211503856", 1152789563211503856), ("0xfff880000000000", 1152789563211513856), ("sdffsdfsdsdf", None), ("010", 8), ("-0x10", -16), ("9223372036854775808", None),
    ("0xffffffffffffffff", None), ("0x7fffffffffffffff", 2**63 - 1), ("08", None), ("", None), ("12 ", None), ("0", 0), (None, None), ("0777777777777777777777", 2**63 - 1),
])
def test_integer(spark, text, value):
    assert one(spark, values.parse_integer("t"), t=text) == value


def test_other_values(spark):
    assert [one(spark, values.parse_boolean("t"), t=t) for t in ("true", "1", "false", "0", "yes", "T")] == [True, True, False, False, None, None]
    assert one(spark, values.parse_hex("t"), t="0AFF") == b"\x0a\xff"
    assert one(spark, values.parse_hex("t"), t="0aff") is None and one(spark, values.parse_hex("t"), t="0AF") is None
    assert one(spark, values.to_hex(F.lit(b"\x0a\xff"))) == "0AFF"
    assert [one(spark, values.parse_size("t"), t=t) for t in ("10", "2k", "3M", "1g", "5x", "k")] == [10, 2048, 3 << 20, 1 << 30, None, None]
    assert values.size_of("2K") == 2048
    with pytest.raises(ValueError):
        values.size_of("2T")
    assert one(spark, values.status_name("c"), c=-10) == "UNKNOWN" and one(spark, values.status_name("c"), c=-1) == "NOT_FOUND" and one(spark, values.status_name("c"), c=7) == "UNKNOWN"
    text = "00001000-0009fbff : System RAM\n  00000100-00000200 : Kernel code\n00100000-bffeffff : System RAM\n"
    assert one(spark, values.ram_ranges("t"), t=text) == [(0x1000, 0x9FBFF - 0x1000), (0x100000, 0xBFFEFFFF - 0x100000)]
    assert one(spark, values.little_endian(F.lit(bytes(range(1, 13))), 0, 8)) == int.from_bytes(bytes(range(1, 9)), "little")
    v, dt = values.parse_literal("t", "d")
    assert one(spark, F.struct(v, dt), t="0x10", d=f"{XSD}long") == ("16", "integer")
    assert one(spark, v, t="x", d="urn:unknown") is None
