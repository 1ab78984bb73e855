"""Typed values: parsers and serialisers, status and codec names, sizes, DOS times, RAM maps, hexadecimal records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.urns import col
from palimpsest.vocabulary import CODEC_URNS, CODECS, NS, STATUS, XSD


def parse_integer(text) -> Column:
    """Decimal, ``0x`` hexadecimal or leading-zero octal, with a sign; null for anything else and beyond 64 bits."""
    t = col(text)
    sign = F.when(t.startswith("-"), F.lit("-")).otherwise("")
    digits = F.regexp_replace(t, r"^[+-]", "")
    hexa, octal = F.lower(F.regexp_replace(digits, "^0[xX]0*", "")), F.regexp_replace(digits, "^0+", "")
    fits_hex, fits_octal = (F.length(hexa) < 16) | ((F.length(hexa) == 16) & (hexa < "8")), F.length(octal) <= 21
    magnitude = (
        F.when(digits.rlike(r"^0[xX][0-9a-fA-F]+$") & fits_hex, F.conv(F.concat(F.lit("0"), hexa), 16, 10))
        .when(digits.rlike(r"^0[0-7]+$") & fits_octal, F.conv(F.concat(F.lit("0"), octal), 8, 10))
        .when(digits.rlike(r"^(0|[1-9][0-9]*)$"), digits)
    )
    return F.concat(sign, magnitude).try_cast("bigint")


def parse_boolean(text) -> Column:
    t = col(text)
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def parse_hex(text) -> Column:
    """Bytes of an even number of upper-case hexadecimal digits, else null."""
    t = col(text)
    return F.when(t.rlike("^([0-9A-F]{2})*$"), F.unhex(t))


def to_hex(data) -> Column:
    return F.hex(col(data))


#: Parsers of lexical forms: a literal's canonical form, or null. With DATATYPES, this is where new types are added.
PARSERS = {
    "text": lambda t: col(t),
    "hexadecimal": lambda t: F.when(col(t).rlike("^([0-9A-F]{2})*$"), col(t)),
    "integer": lambda t: parse_integer(t).cast("string"),
    "boolean": lambda t: parse_boolean(t).cast("string"),
}
#: Datatype to (name in ``dt``, parser).
DATATYPES = {
    f"{XSD}string": ("string", "text"),
    f"{XSD}hexBinary": ("hexBinary", "hexadecimal"),
    f"{XSD}integer": ("integer", "integer"),
    f"{XSD}int": ("integer", "integer"),
    f"{XSD}long": ("integer", "integer"),
    f"{XSD}boolean": ("boolean", "boolean"),
    f"{NS}MD5": ("md5", "text"),
    f"{NS}SHA1": ("sha1", "text"),
    f"{NS}SHA256": ("sha256", "text"),
    f"{NS}SHA512": ("sha512", "text"),
    f"{NS}blake2b": ("blake2b", "text"),
}
#: Name in ``dt`` to the datatype that is written.
DATATYPE_URNS = {name: urn for urn, (name, _) in reversed(DATATYPES.items())}


def parse_literal(lexical, datatype) -> tuple[Column, Column]:
    """(value, dt) of a literal by its datatype URI (null: a plain string); the value is null for unknown types and bad literals."""
    dt = F.coalesce(col(datatype), F.lit(f"{XSD}string"))
    value = F.lit(None).cast("string")
    for parser, parse in PARSERS.items():
        value = F.when(dt.isin([urn for urn, (_, p) in DATATYPES.items() if p == parser]), parse(lexical)).otherwise(value)
    return value, lookup(dt, {urn: name for urn, (name, _) in DATATYPES.items()})


def lookup(key, table: dict, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[col(key)], F.lit(default)) if default is not None else pairs[col(key)]


def status_name(code) -> Column:
    return lookup(col(code).cast("int"), STATUS, "UNKNOWN")


def codec_of_urn(urn) -> Column:
    return lookup(urn, CODECS, "unknown")


def urn_of_codec(codec) -> Column:
    return lookup(codec, CODEC_URNS, "")


def parse_size(text) -> Column:
    """Digits and an optional k, m or g (powers of 1024); null otherwise."""
    t = col(text)
    unit = F.lower(F.regexp_extract(t, r"^[0-9]+([kKmMgG]?)$", 1))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("bigint")
    return F.when(t.rlike(r"^[0-9]+[kKmMgG]?$"), F.regexp_extract(t, "^([0-9]+)", 1).cast("bigint") * factor)


def size_of(text: str) -> int:
    """parse_size for a parameter; a malformed one is an error."""
    if not (m := re.fullmatch(r"([0-9]+)([kKmMgG]?)", text)):
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


def ram_ranges(text) -> Column:
    """Array of (start, length) from the lines ``start-end : System RAM``; the length is end less start, as listed."""
    pattern = r"([0-9a-f]+)-([0-9a-f]+) : System RAM"
    starts, ends = F.regexp_extract_all(col(text), F.lit(pattern), 1), F.regexp_extract_all(col(text), F.lit(pattern), 2)
    number = lambda x: F.conv(x, 16, 10).cast("bigint")
    return F.zip_with(starts, ends, lambda a, b: F.struct(number(a).alias("start"), (number(b) - number(a)).alias("length")))


def dos_timestamp(date, time) -> Column:
    """The only temporal type: two 16-bit numbers, of 2 seconds' resolution; null for dates that don't exist."""
    d, t = col(date).cast("int"), col(time).cast("int")
    part = lambda x, low, bits: F.shiftright(x, low).bitwiseAND((1 << bits) - 1)
    return F.try_make_timestamp_ntz(part(d, 9, 7) + 1980, part(d, 5, 4), part(d, 0, 5), part(t, 11, 5), part(t, 5, 6), (part(t, 0, 5) * 2).cast("decimal(8,6)"))


def dos_date(ts) -> Column:
    return F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))


def dos_time(ts) -> Column:
    return F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.expr(f"second({ts}) DIV 2") if isinstance(ts, str) else F.floor(F.second(ts) / 2).cast("int"))


def little_endian(data, offset: int | Column, size: int) -> Column:
    """An unsigned number of ``size`` bytes at a byte offset (from 0) of a binary column."""
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    digits = F.hex(F.substring(col(data), start, size))
    swapped = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")
    return F.conv(swapped, 16, 10).cast("decimal(20,0)").cast("bigint")
