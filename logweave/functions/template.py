"""Template languages, compiled to Column expressions when the plan is built.

``%{key}``, ``%{a.b}``, ``%{@tag}``, ``%{@id}``, ``%{@str}``, ``%{@now}``,
``%{@unix}``, ``%{@lower:key}``, ``%{@upper:key}``; and the simpler ``${key}``.
A missing value is an empty text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import maps

_PERCENT = re.compile(r"%\{(@?[\w\-.]+(?::[^\s}]+)?)\}")
_DOLLAR = re.compile(r"\$\{([^}]+)\}")


def _pieces(template: str, pattern: re.Pattern, value) -> Column:
    out, at = [], 0
    for m in pattern.finditer(template):
        if m.start() > at:
            out.append(F.lit(template[at : m.start()]))
        out.append(F.coalesce(value(m[1]), F.lit("")))
        at = m.end()
    if at < len(template) or not out:
        out.append(F.lit(template[at:]))
    return out[0] if len(out) == 1 else F.concat(*out)


def percent(template: str, msg: Column, tag: Column, id_: Column) -> Column:
    def value(key: str) -> Column:
        if not key.startswith("@"):
            return maps.shown(maps.nested(msg, key))
        name, _, arg = key[1:].partition(":")
        if name in ("lower", "upper") and arg:
            return getattr(F, name)(maps.shown(maps.nested(msg, arg)))
        known = {
            "tag": tag,
            "id": id_.cast("string"),
            "str": F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8),
            "now": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
            "unix": F.unix_timestamp().cast("string"),
        }
        return known.get(name, F.lit(""))

    return _pieces(template, _PERCENT, value)


def dollar(template: str, msg: Column) -> Column:
    return _pieces(template, _DOLLAR, lambda key: maps.shown(F.try_element_at(msg, F.lit(key))))
