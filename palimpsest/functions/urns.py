"""URN, path, glob and member-name functions as plain column expressions."""

from __future__ import annotations

import os
import re
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.vocabulary import BUILTIN_PREFIX, ESCAPED, FILE_PREFIX, PREFIX, SCHEME


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(urn) -> Column:
    """The scheme, if it is one of the three known, else the empty string."""
    u = col(urn)
    return F.when(u.startswith(PREFIX), SCHEME).when(u.startswith(FILE_PREFIX), "file").when(u.startswith(BUILTIN_PREFIX), "builtin").when(u.isNotNull(), "")


def domain(urn) -> Column:
    return F.regexp_extract(col(urn), rf"^(?:{SCHEME}|builtin)://([^/]*)", 1)


def path(urn) -> Column:
    """What follows ``file://``, or the domain and one slash of a container URN."""
    u = col(urn)
    rest = F.regexp_extract(u, rf"(?s)^{SCHEME}://[^/]*/?(.*)$", 1)
    return F.when(u.startswith(FILE_PREFIX), u.substr(F.lit(len(FILE_PREFIX) + 1), F.length(u))).when(u.startswith(PREFIX), rest).when(u.isNotNull(), "")


def normalise_path(component) -> Column:
    """``/a/b`` without empty and ``.`` parts; ``..`` takes the part before it, but never more than there is."""
    parts = F.split(col(component), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.array_append(acc, x)),
    )
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("/"), x)), "")


def append(urn, component) -> Column:
    """The URN without trailing slashes of either kind, followed by the normalised component."""
    return F.concat(F.regexp_replace(col(urn), r"[/\\]+$", ""), normalise_path(component))


def relative_path(base, other) -> Column:
    """``other`` without the prefix ``base``, or unchanged; the prefix need not end at a slash."""
    b, o = col(base), col(other)
    return F.when(o.startswith(b), o.substr(F.length(b) + 1, F.length(o))).otherwise(o)


def escape_component(component) -> Column:
    """Percent-encodes the reserved characters and each pair of slashes."""
    out = F.replace(col(component), F.lit("%"), F.lit("%25"))
    for c in ESCAPED:
        if c != "%":
            out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.replace(out, F.lit("//"), F.lit("%2F%2F"))


def path_components(text) -> Column:
    """Parts between slashes of either kind, without empty ones; a leading scheme and domain stay together."""
    t = col(text)
    head = F.regexp_extract(t, rf"^({SCHEME}://[^/\\]*)", 1)
    tail = F.filter(F.split(t.substr(F.length(head) + 1, F.length(t)), r"[/\\]"), lambda x: x != "")
    return F.when(head != "", F.array_insert(tail, 1, head)).otherwise(tail)


def member_name(urn, base, slash_ok: bool = True) -> Column:
    """A segment's name in the volume ``base``: relative, with each component escaped."""
    rel = relative_path(base, urn)
    if not slash_ok:
        return escape_component(F.regexp_replace(rel, "^/", ""))
    return F.array_join(F.transform(path_components(rel), lambda x: F.replace(escape_component(x), F.lit("/"), F.lit("%2F"))), "/")


def urn_from_member(name, base) -> Column:
    """The URN of a member: decoded, and appended to ``base`` unless it is a URN of its own. Malformed escapes give null."""
    decoded = F.replace(F.try_url_decode(F.replace(col(name), F.lit("+"), F.lit("%2B"))), F.lit("\0"), F.lit(""))
    return F.when(decoded.startswith(f"{SCHEME}:"), decoded).otherwise(append(base, decoded))


def join(parts, separator: str) -> Column:
    return F.array_join(col(parts), separator)


def split(text, separator: str) -> Column:
    return F.split(col(text), re.escape(separator))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``*``, ``?``, ``[..]`` and the extended ``?(a|b) *(..) +(..) @(..)``; ``*`` also matches slashes."""
    out, i, closing = [], 0, []
    while i < len(pattern):
        c, nxt = pattern[i], pattern[i + 1 : i + 2]
        if c in "?*+@" and nxt == "(" and ")" in pattern[i:]:
            out.append("(?:")
            closing.append({"?": ")?", "*": ")*", "+": ")+", "@": ")"}[c])
            i += 2
            continue
        if c == ")" and closing:
            out.append(closing.pop())
        elif c == "|" and closing:
            out.append("|")
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end
        elif c == "\\" and nxt:
            out.append(re.escape(nxt))
            i += 1
        else:
            out.append(re.escape(c))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def glob_match(text, pattern: str) -> Column:
    """Whether a glob matches the whole text, letter case aside."""
    return col(text).rlike(glob_regex(pattern))


def has_ending(text, suffix: str) -> Column:
    return col(text).endswith(suffix)


def sprintf(template: str, *columns) -> Column:
    return F.format_string(template, *[col(c) for c in columns])


def file_urn(path_column) -> Column:
    """A ``file://`` URN of an absolute POSIX path, percent-encoded by component."""
    encoded = F.transform(F.split(col(path_column), "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    joined = F.array_join(encoded, "/")
    return F.concat(F.lit(FILE_PREFIX), F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined)))


def filename_of(urn) -> Column:
    """The path of a ``file://`` URN, else null."""
    u = col(urn)
    return F.when(u.startswith(FILE_PREFIX), F.try_url_decode(F.replace(path(u), F.lit("+"), F.lit("%2B"))))


def absolute(name, cwd: str) -> Column:
    """``absolute_path`` of a column."""
    return F.when(col(name).rlike(r"(?s)^(?:[/\\]|.:)"), col(name)).otherwise(F.concat(F.lit(f"{cwd}/"), col(name)))


def absolute_path(name: str, cwd: str | None = None) -> str:
    """Prepends the working directory unless the name is absolute or starts with a drive letter."""
    if name[:1] in ("/", "\\") or name[1:2] == ":":
        return name
    return f"{cwd or os.getcwd()}/{name}"


def file_urn_of(name: str, absolute: bool = True) -> str:
    return FILE_PREFIX + quote(absolute_path(name) if absolute else name, safe="/:")


def filename_from(urn: str) -> str:
    return unquote(urn.removeprefix(FILE_PREFIX))
