"""Turtle metadata: a reader of the subset that containers use, and a writer.

Read: prefixes, ``a``, ``;`` and ``,`` lists, IRIs, prefixed names, quoted and long strings, datatypes, bare integers and
booleans, comments. Statements with a blank node, and literals that their datatype does not allow, are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.values import DATATYPE_URNS, parse_literal
from palimpsest.operators.triples import NAMESPACES, dump
from palimpsest.vocabulary import TYPE, XSD

TOKEN = re.compile(
    r'''\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^\\]|\\.)*?""")|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)'''
    r"""|(?P<number>[+-]?\d+(?:\.\d+)?)(?![\w:])|(?P<blank>_:[\w.-]+|\[\s*\])|(?P<name>[A-Za-z_][\w.-]*:[\w./%#-]*[\w/%#-]|[A-Za-z_][\w-]*:|:[\w./-]+|[A-Za-z]+)|(?P<mark>[.;,])""",
    re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


def parse(text: str) -> list[tuple[str, str, str, str]]:
    """(subject, attribute, lexical value, datatype or ``urn``) in order."""
    tokens = []
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Turtle: unexpected text at {at}: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes, out, i = {}, [], 0

    def iri(kind: str, value: str) -> str | None:
        if kind == "iri":
            return unescape(value[1:-1])
        if kind == "name":
            prefix, _, rest = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"Turtle: unknown prefix {prefix}")
            return prefixes[prefix] + rest
        return None

    def term(i: int) -> tuple[str | None, str, int]:
        kind, value = tokens[i]
        if kind in ("string", "long"):
            lexical = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if i + 1 < len(tokens) and tokens[i + 1][0] == "lang":
                return lexical, f"{XSD}string", i + 2
            if i + 1 < len(tokens) and tokens[i + 1][0] == "type":
                return lexical, iri(*tokens[i + 2]) or "", i + 3
            return lexical, f"{XSD}string", i + 1
        if kind == "number":
            return value, f"{XSD}integer", i + 1
        if kind == "name" and value in ("true", "false"):
            return value, f"{XSD}boolean", i + 1
        return iri(kind, value), "urn", i + 1

    while i < len(tokens):
        kind, value = tokens[i]
        if value in ("@prefix", "prefix", "PREFIX"):
            prefixes[tokens[i + 1][1][:-1]] = tokens[i + 2][1][1:-1]
            i += 3 + (i + 3 < len(tokens) and tokens[i + 3][1] == "." and value == "@prefix")
            continue
        subject = iri(kind, value)
        i += 1
        while i < len(tokens) and tokens[i][1] != ".":
            if tokens[i][1] == ";":
                i += 1
                continue
            p = TYPE if tokens[i] == ("name", "a") else iri(*tokens[i])
            i += 1
            while True:
                o, dt, i = term(i)
                if subject is not None and p is not None and o is not None:
                    out.append((subject, p, o, dt))
                if i < len(tokens) and tokens[i][1] == ",":
                    i += 1
                    continue
                break
        i += 1
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files; ``volume`` is the file, ``seq`` the place in it. Integers and booleans are normalised."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("volume"), "value")
    return of_texts(files)


def of_texts(files: DataFrame) -> DataFrame:
    """Triples of Turtle texts in rows of (volume, value)."""

    def run(batches):
        for batch in batches:
            for volume, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(volume, *t, i) for i, t in enumerate(parse(text or ""), 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["volume", "s", "p", "lexical", "datatype", "seq"])

    raw = files.select("volume", "value").mapInArrow(run, "volume string, s string, p string, lexical string, datatype string, seq bigint")
    value, dt = parse_literal("lexical", "datatype")
    is_urn = F.col("datatype") == "urn"
    out = raw.select("volume", "s", "p", F.when(is_urn, F.col("lexical")).otherwise(value).alias("o"), F.when(is_urn, "urn").otherwise(dt).alias("dt"), "seq")
    return out.where("o IS NOT NULL")


def quoted(c) -> F.Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def statements(triples: DataFrame, verbose: bool = False) -> DataFrame:
    """One row of text for each subject, of what ``dump`` leaves, values in order of seq."""
    return by_subject(triples, verbose).select("value")


def by_subject(triples: DataFrame, verbose: bool = False) -> DataFrame:
    """(s, value): the text of each subject."""
    types = F.create_map(*[F.lit(x) for kv in DATATYPE_URNS.items() for x in kv])
    value = F.when(F.col("dt") == "urn", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("dt") == "string", quoted(F.col("o"))).otherwise(F.concat(quoted(F.col("o")), F.lit("^^<"), types[F.col("dt")], F.lit(">")))
    lines = dump(triples, verbose).select("s", F.struct("p", "seq", F.concat(F.lit("    <"), "p", F.lit("> "), value).alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), " ;\n")
    return lines.groupBy("s").agg(F.concat(F.lit("<"), F.col("s"), F.lit(">\n"), body, F.lit(" .\n")).alias("value"))


def header(names: dict[str, str] | None = None) -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in (names or NAMESPACES).items())


def write(triples: DataFrame, path: str, verbose: bool = False) -> None:
    """Turtle files in a folder; IRIs are written in full, so that no file needs another's prefixes."""
    statements(triples, verbose).write.text(path)
