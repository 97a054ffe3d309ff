"""Messages: MAP<STRING, VARIANT> columns and their accessors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "map<string,variant>"


def variant(c: Column) -> Column:
    """A scalar column as VARIANT."""
    return c.cast("variant")


def text(msg: Column, key: str) -> Column:
    """The value as text; null where the key is absent or not a scalar."""
    return F.try_variant_get(F.try_element_at(msg, F.lit(key)), "$", "string")


def is_text(msg: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_element_at(msg, F.lit(key))) == "STRING", F.lit(False))


def put(msg: Column, values: dict[str, Column]) -> Column:
    """Entries set, whether or not they were there; null values are left out."""
    if not values:
        return msg
    pairs = [x for k, v in values.items() for x in (F.lit(k), variant(v))]
    fresh = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.map_concat(msg, fresh)


def without(msg: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(msg, lambda k, _: ~k.isin(*keys)) if keys else msg


def only(msg: Column, keys: Iterable[str]) -> Column:
    return F.map_filter(msg, lambda k, _: k.isin(*list(keys)))


def from_json(c: Column) -> Column:
    """A JSON object as a message; null for anything else."""
    return F.from_json(c, MESSAGE)


def to_json(msg: Column) -> Column:
    return F.to_json(msg)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def flatten(msg: Column, delimiter: str = "__", depth: int | None = None) -> Column:
    """Nested objects become entries ``a__b``; arrays stay; empty objects vanish.

    Each of ``depth`` passes opens one level; deeper levels stay objects.  By
    default a message has as many passes as one of its values has objects, so
    none is left.  Messages without an object are left as they are.
    """
    if depth is not None and depth < 1:
        return msg

    def opened(e: Column) -> Column:
        inner = F.map_entries(F.from_json(F.to_json(e["value"]), MESSAGE))
        return F.transform(inner, lambda x: F.struct(F.concat(e["key"], F.lit(delimiter), x["key"]).alias("key"), x["value"].alias("value")))

    def level(acc: Column, _: Column) -> Column:
        return F.flatten(F.transform(acc, lambda e: F.when(_is_object(e["value"]), opened(e)).otherwise(F.array(e))))

    def level_if_any(acc: Column, i: Column) -> Column:
        return F.when(F.exists(acc, lambda e: _is_object(e["value"])), level(acc, i)).otherwise(acc)

    entries = F.map_entries(msg)
    if depth is None:
        objects = lambda v: F.coalesce(F.regexp_count(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(0))
        most = F.aggregate(F.map_values(msg), F.lit(0), lambda acc, v: F.greatest(acc, objects(v)))
        flat = F.aggregate(F.array_repeat(F.lit(1), most), entries, level_if_any)
    else:
        flat = level(entries, F.lit(1)) if depth == 1 else F.aggregate(F.array(*[F.lit(i) for i in range(depth)]), entries, level)
    return F.when(F.exists(F.map_values(msg), _is_object), F.map_from_entries(flat)).otherwise(msg)


def nested(msg: Column, path: str) -> Column:
    """VARIANT at a dotted path; the literal key wins; null for any miss or an empty step."""
    literal = F.try_element_at(msg, F.lit(path))
    steps = path.split(".")
    if len(steps) < 2 or not all(steps):
        return literal
    rest = "$" + "".join(f"['{s}']" for s in steps[1:])
    return F.coalesce(literal, F.try_variant_get(F.try_element_at(msg, F.lit(steps[0])), rest, "variant"))


def shown(v: Column) -> Column:
    """A VARIANT as text: scalars plainly, integral numbers without a fraction, objects as map[k:v ...]."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    plain = F.try_variant_get(v, "$", "string")
    as_map = F.from_json(F.to_json(v), "map<string,string>")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(as_map)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")
    integral = (number == F.floor(number)) & (F.abs(number) < F.lit(1e18)) & kind.isin("DOUBLE", "FLOAT")
    return F.when(kind.startswith("OBJECT"), F.concat(F.lit("map["), listed, F.lit("]"))).when(integral, number.cast("bigint").cast("string")).otherwise(plain)


def clip_bytes(c: Column, size: int) -> Column:
    """At most ``size`` bytes of UTF-8; a character cut in two is replaced."""
    return F.when(F.octet_length(c) > size, F.make_valid_utf8(F.substring(c.cast("binary"), 1, size).cast("string"))).otherwise(c)


def abs_int(c: Column) -> Column:
    """The magnitude of a whole number."""
    return F.abs(c.cast("bigint"))
