"""Reference-time layouts (2006-01-02 15:04:05) as Spark datetime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the layout language, longest first where one begins another.
_PARTS = [
    ("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "EEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Z0700", "XX"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("_2", "d"),
]


def to_spark(layout: str) -> str:
    out, i = [], 0
    while i < len(layout):
        if m := re.match(r"\.([09])\1*", layout[i:]):
            out.append("." + "S" * (len(m[0]) - 1))
            i += len(m[0])
            continue
        for go, java in _PARTS:
            if layout.startswith(go, i):
                out.append(java)
                i += len(go)
                break
        else:
            c = layout[i]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
    return "".join(out)


def parse(c: Column, layout: str) -> Column:
    """TIMESTAMP, or null where the text does not fit the layout."""
    return F.try_to_timestamp(c, F.lit(to_spark(layout)))


def show(c: Column, layout: str) -> Column:
    """Text in UTC (the session's zone must be UTC)."""
    return F.date_format(c, to_spark(layout))
