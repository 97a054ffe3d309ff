"""Named-group patterns (RE2 dialect) for Spark's regular expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates captures in the single-pass extraction; texts that hold it take another way.
CUT = "\x01"
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


@lru_cache(maxsize=256)
def translate(pattern: str) -> tuple[str, tuple[tuple[str, int], ...], int]:
    """(Java pattern, named groups with their numbers, count of groups).

    Names go (Java forbids ``_`` in them), ``.`` stops at ``\\n`` only, and ``$``
    outside multi-line mode means the end of the text.
    """
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    multi = bool(flags and "m" in flags[1])
    out, names, n, i = [], [], 0, 0
    in_class, opened = False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append(two)
            i += 2
            continue
        if in_class:
            first = i == opened + 1 or (i == opened + 2 and pattern[opened + 1] == "^")
            in_class = c != "]" or first  # a bracket that comes first stands for itself
        elif c == "[":
            in_class, opened = True, i
        elif c == "(":
            if m := _NAMED.match(pattern, i):
                n += 1
                names.append((m[1], n))
                out.append("(")
                i = m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                n += 1
        elif c == "$" and not multi:
            out.append(r"\z")
            i += 1
            continue
        out.append(c)
        i += 1
    return "(?d)" + "".join(out), tuple(names), n


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(translate(pattern)[0])


#: White space that field values lose at both ends.
SPACE = " \t\n\x0b\f\r\x85\xa0"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def captures(c: Column, pattern: str) -> Column:
    """Array of the captures of all groups from place 1 on, from one pass; null without a match.

    The match is replaced by a separator and its captures, which are then split,
    instead of one search for each group.  Without a match nothing is replaced, so
    nothing is split.  A text that itself holds the separator is searched by group.
    """
    java, _, n = translate(pattern)
    whole = f"\\A(?s:.*?)(?:{java})(?s:.*)\\z"
    joined = "".join(f"{CUT}${i}" for i in range(1, n + 1)) or CUT
    found = F.get(F.filter(F.array(F.split(F.regexp_replace(c, whole, joined), CUT, -1)), lambda x: F.size(x) > 1), F.lit(0))
    slow = F.when(c.rlike(java), F.array(F.lit(""), *[F.regexp_extract(c, java, i) for i in range(1, n + 1)]))
    return F.when(F.contains(c, F.lit(CUT)), slow).otherwise(found)


def named(parts: Column, pattern: str) -> dict[str, Column]:
    """Trimmed text of each named group; null if empty."""
    return {name: F.nullif(trim(F.get(parts, F.lit(i))), F.lit("")) for name, i in translate(pattern)[1]}


def extract(c: Column, pattern: str) -> tuple[Column, dict[str, Column]]:
    """(whether it matches, its named groups)."""
    parts = captures(c, pattern)
    return parts.isNotNull(), named(parts, pattern)
