"""Path globs as regular expressions.

``*`` alone matches all paths. A last segment ``*`` matches any depth, none included. Else the whole path must match, and
``*`` and ``?`` don't cross ``/``; ``[..]``, ``[^..]`` and backslash escapes are allowed. A malformed glob matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = r"\b\B"


def is_wildcard(pattern: str) -> bool:
    return "*" in pattern


def _segment(glob: str) -> str | None:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif c == "[":
            body, i = _class(glob, i + 1)
            if body is None:
                return None
            out.append(body)
            continue
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _class(glob: str, i: int) -> tuple[str | None, int]:
    negated = glob[i : i + 1] == "^"
    i += negated
    parts: list[str] = []

    def one(i: int) -> tuple[str | None, int]:
        if i >= len(glob) or glob[i] in "]-":
            return None, i
        if glob[i] == "\\":
            i += 1
            if i >= len(glob):
                return None, i
        return glob[i], i + 1

    while i < len(glob) and not (glob[i] == "]" and parts):
        low, i = one(i)
        if low is None:
            return None, i
        high = low
        if i < len(glob) and glob[i] == "-":
            high, i = one(i + 1)
            if high is None:
                return None, i
        if low <= high:
            parts.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
        else:
            parts.append("")
    if i >= len(glob):
        return None, i
    body = "".join(parts)
    if not body:
        return (r"[\x{0}-\x{10ffff}]" if negated else NOTHING), i + 1
    return f"[{'^' if negated else ''}{body}]", i + 1


def to_regex(pattern: str) -> str:
    """A regular expression, for Java and RE2 alike, that matches the paths of the glob."""
    if pattern == "*":
        return "(?s)^.*$"
    *head, last = pattern.split("/")
    if last == "*":
        parts = [_segment(s) for s in head]
        return NOTHING if None in parts else "(?s)^" + "/".join(parts) + "(/.*)?$"
    body = _segment(pattern)
    return NOTHING if body is None else f"(?s)^{body}$"


def _tokens(text: Column, barred: str) -> tuple[Column, Column]:
    """(regular expression of globs without a special last segment, whether they are well-formed); characters ``barred``
    can't be escaped or stand in classes."""
    char = rf"(?:\\[^{barred}]|[^\]\-\\{barred}])" if barred else r"(?:\\.|[^\]\-\\])"
    item = f"{char}(?:-{char})?"
    escape = rf"\\[^{barred}]" if barred else r"\\."
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)({escape}|\[\^?+(?:{item})++\]|[^\\\[])"), F.lit(1))

    def code(c: Column) -> Column:
        return F.ascii(F.when(F.startswith(c, F.lit("\\")), F.substring(c, 2, 1)).otherwise(F.substring(c, 1, 1)))

    def literal(n: Column) -> Column:
        return F.concat(F.lit(r"\x{"), F.hex(n), F.lit("}"))

    def one(c: Column) -> Column:
        low = code(c)
        high = F.regexp_extract(c, rf"(?s)^{char}-({char})$", 1)
        high = F.when(high == "", low).otherwise(code(high))
        return F.when(low <= high, F.concat(literal(low), F.lit("-"), literal(high))).otherwise("")

    def klass(t: Column) -> Column:
        negated = F.startswith(t, F.lit("[^"))
        inner = F.regexp_extract(t, r"(?s)^\[\^?+(.*)\]$", 1)
        body = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(f"(?s)({item})"), F.lit(1)), one), "")
        empty = F.when(negated, F.lit(r"[\x{0}-\x{10ffff}]")).otherwise(F.lit(NOTHING))
        return F.when(body == "", empty).otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), body, F.lit("]")))

    def token(t: Column) -> Column:
        return F.when(t == "*", F.lit("[^/]*")).when(t == "?", F.lit("[^/]")).when(F.startswith(t, F.lit("[")), klass(t)).otherwise(literal(code(t)))

    return F.array_join(F.transform(tokens, token), ""), F.array_join(tokens, "") == text


def regex_of(pattern: Column) -> Column:
    """``to_regex`` of a column of globs, with SQL functions only."""
    deep = (pattern == "*") | F.endswith(pattern, F.lit("/*"))
    head = F.substring(pattern, F.lit(1), F.length(pattern) - 2)
    (inner, inner_good), (whole, whole_good) = _tokens(head, "/"), _tokens(pattern, "")
    return (
        F.when(pattern == "*", F.lit("(?s)^.*$"))
        .when(deep, F.when(inner_good, F.concat(F.lit("(?s)^"), inner, F.lit("(/.*)?$"))).otherwise(F.lit(NOTHING)))
        .otherwise(F.when(whole_good, F.concat(F.lit("(?s)^"), whole, F.lit("$"))).otherwise(F.lit(NOTHING)))
    )


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def literal_head(pattern: Column) -> Column:
    """The first segment that each path of the glob has, or null."""
    return F.when(F.contains(pattern, F.lit("/")) & ~F.rlike(first_segment(pattern), F.lit(r"[*?\[\\]")), first_segment(pattern))


def matches(path: Column, pattern: str) -> Column:
    """The catalog's test: the glob always applies; an empty pattern matches all."""
    return path.rlike(to_regex(pattern or "*"))


def selects(path: Column, pattern: str) -> Column:
    """The queries' test: a pattern without ``*`` is an exact path."""
    return matches(path, pattern) if is_wildcard(pattern) else path == pattern
