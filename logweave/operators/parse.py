"""The parser: named groups, embedded JSON, flattening, time and add rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gotime, maps, regex
from ..schema import once
from .filters import Filter, add_rules, register

DEFAULT_NEW_LAYOUT = "2006-01-02T15:04:05.000000Z"


@register("parser")
def parser(
    tags: Sequence[str], msg_key: str = "", pattern: str = "", is_remove_orig_log: bool = False, parse_json_key: str = "", must_include: str = "",
    time_key: str = "", time_format: str = "", append_time_zone: str = "", new_time_key: str = "@timestamp", new_time_format: str = DEFAULT_NEW_LAYOUT,
    reserved_time_key: bool = False, add: dict | None = None, flatten_depth: int | None = None, tz_sep: str | None = None,
) -> Filter:
    """Order of steps: groups, original removed, JSON merged, flattened, required
    key, time, add rules.  Records of other tags pass.

    ``tz_sep`` stands between a time and the appended zone; by default nothing
    if the time comes from a group of the pattern, else a blank.
    """
    if tz_sep is None:
        tz_sep = "" if any(n == time_key for n, _ in regex.translate(pattern)[1]) else " "

    def run(df: DataFrame) -> DataFrame:
        ours = F.col("tag").isin(*tags)
        msg, on = F.col("message"), F.col("__on")
        text = maps.text(msg, msg_key) if msg_key else F.lit(None).cast("string")
        # a record without the text is passed on unparsed
        df = once(df, __t=F.when(ours, text)).withColumn("__on", ours & (F.col("__t").isNotNull() if msg_key else F.lit(True)))
        new = msg
        if msg_key and pattern:
            df = once(df, __p=regex.captures(F.col("__t"), pattern)).where(~on | F.col("__p").isNotNull())
            new = maps.put(new, regex.named(F.col("__p"), pattern))
        if msg_key and is_remove_orig_log:
            new = maps.without(new, [msg_key])
        df = once(df, message=F.when(on, new).otherwise(msg)).drop("__t", "__p")
        if parse_json_key:
            df = once(df, __in=F.when(on, maps.from_json(maps.text(msg, parse_json_key))))
            merged = F.map_concat(maps.without(msg, [parse_json_key]), maps.without(F.col("__in"), [parse_json_key]))
            df = once(df, message=F.when(F.col("__in").isNotNull(), merged).otherwise(msg)).drop("__in")
        if flatten_depth != 0:
            df = once(df, message=F.when(on, maps.flatten(msg, "__", flatten_depth)).otherwise(msg))
        if must_include:
            df = df.where(~on | F.map_contains_key("message", must_include))
        if time_key:
            zone = tz_sep + append_time_zone if append_time_zone else ""
            raw = F.replace(F.concat(maps.text(msg, time_key), F.lit(zone)), F.lit(","), F.lit("."))
            df = once(df, __at=gotime.parse(raw, time_format)).where(~on | F.col("__at").isNotNull())
            rest = msg if reserved_time_key else maps.without(msg, [time_key])
            df = once(df, message=F.when(on, maps.put(rest, {new_time_key: gotime.show(F.col("__at"), new_time_format)})).otherwise(msg)).drop("__at")
        df = df.drop("__on")
        return add_rules({t: r for t, r in (add or {}).items() if t in tags})(df)

    return run


def parse_columns(
    df: DataFrame, text: Column, pattern: str, *, json_key: str = "", json_fields: dict[str, str] | None = None, must_include: str = "", time_key: str = "", time_format: str = "",
    append_time_zone: str = "", new_time_key: str = "timestamp", new_time_format: str = DEFAULT_NEW_LAYOUT, tz_sep: str = "",
) -> DataFrame:
    """The parser's steps for outputs that are known beforehand, as typed columns.

    Where the named groups and the wanted JSON fields are known, no message map
    is built: the pattern runs once, JSON is read with a schema, and Catalyst
    prunes what is not selected.  Rows that the parser would drop are dropped; a
    null text is dropped too, as it has no groups.
    """
    d = once(df, __p=regex.captures(text, pattern)).where("__p is not null")
    groups = regex.named(F.col("__p"), pattern)
    out = dict(groups)
    if json_key:
        inner = F.from_json(groups[json_key], ", ".join(f"`{k}` {t}" for k, t in (json_fields or {}).items()))
        d = once(d, __j=inner)
        out |= {k: F.col("__j").getField(k) for k in json_fields or {}}
        del out[json_key]
    if time_key:
        at = gotime.parse(F.replace(F.concat(groups[time_key], F.lit(tz_sep + append_time_zone if append_time_zone else "")), F.lit(","), F.lit(".")), time_format)
        d = once(d, __at=at).where("__at is not null")
        del out[time_key]
        out[new_time_key] = gotime.show(F.col("__at"), new_time_format)
    if must_include:
        d = d.where(out[must_include].isNotNull())
    return d.select(*df.columns, *[c.alias(n) for n, c in out.items() if n not in df.columns])
