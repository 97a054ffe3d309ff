"""Acceptor and post filters: routing, retagging, lookups and field reshaping.

Every filter is built by a factory from its settings and maps records to
records.  ``register`` adds further types by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gotime, maps, regex, template

Filter = Callable[[DataFrame], DataFrame]
FACTORIES: dict[str, Callable[..., Filter]] = {}
#: Fields that an include list never removes.
ALWAYS_KEPT = ("tag", "@timestamp", "msgid", "container_id", "container_name", "level", "datasource")
MS_LAYOUT = "2006-01-02T15:04:05.000Z"


def register(name: str) -> Callable:
    def take(factory: Callable[..., Filter]) -> Callable[..., Filter]:
        FACTORIES[name] = factory
        return factory

    return take


def chain(filters: Sequence[Filter]) -> Filter:
    return lambda df: reduce(lambda d, f: f(d), filters, df)


def add_rules(rules: dict[str, list[dict]]) -> Filter:
    """Per tag, in order: null deletes the key, a text is a template, other values are literals."""

    def run(df: DataFrame) -> DataFrame:
        for tag, steps in rules.items():
            for step in steps:
                for key, value in step.items():
                    if value is None:
                        new = maps.without(F.col("message"), [key])
                    else:
                        v = template.percent(value, F.col("message"), F.col("tag"), F.col("id")) if isinstance(value, str) else F.lit(value)
                        new = maps.put(F.col("message"), {key: v})
                    df = df.withColumn("message", F.when(F.col("tag") == tag, new).otherwise(F.col("message")))
        return df

    return run


@register("default")
def accept(remove_empty_tag: bool = False, remove_unknown_tag: bool = False, accept_tags: Sequence[str] = (), add: dict | None = None) -> Filter:
    if remove_unknown_tag and not accept_tags:
        raise ValueError("remove_unknown_tag needs accept_tags")

    def run(df: DataFrame) -> DataFrame:
        if remove_empty_tag:
            df = df.where("tag != ''")
        if remove_unknown_tag:
            df = df.where(F.col("tag").isin(*accept_tags))
        return add_rules(add)(df) if add else df

    return run


@register("spark")
def ignore_lines(tag: str, msg_key: str, identifier: str, ignore_regex: str) -> Filter:
    """Drops lines that match; marks the others of this tag with their origin."""

    def run(df: DataFrame) -> DataFrame:
        line = maps.text(F.col("message"), msg_key)
        ours = (F.col("tag") == tag) & line.isNotNull()
        df = df.where(~(ours & F.coalesce(regex.matches(line, ignore_regex), F.lit(False))))
        return df.withColumn("message", F.when(ours, maps.put(F.col("message"), {identifier: F.lit("spark")})).otherwise(F.col("message")))

    return run


@register("spring")
def retag(tag: str, rules: Sequence[tuple[str, str]], msg_key: str = "log", tag_key: str = "tag") -> Filter:
    """The first rule (new tag, pattern) that matches names the tag; texts only."""

    def run(df: DataFrame) -> DataFrame:
        line = maps.text(F.col("message"), msg_key)
        new = reduce(lambda w, r: w.when(regex.matches(line, r[1]), F.lit(r[0])), rules[1:], F.when(regex.matches(line, rules[0][1]), F.lit(rules[0][0])))
        df = df.where((F.col("tag") != tag) | maps.is_text(F.col("message"), msg_key))
        df = df.withColumn("__new", F.when(F.col("tag") == tag, new))
        msg = F.when(F.col("__new").isNotNull(), maps.put(F.col("message"), {tag_key: F.col("__new")})).otherwise(F.col("message"))
        return df.select(*[msg.alias(c) if c == "message" else F.coalesce("__new", "tag").alias(c) if c == "tag" else c for c in df.columns if c != "__new"])

    run.retags = {tag: [r[0] for r in rules]}
    return run


def acceptor_pipeline(filters: Sequence[Filter]) -> Filter:
    """All filters in order, again for records that were retagged.

    Tags that rules can give are known beforehand, so the count of passes is the
    longest chain of retags; a cycle is an error.
    """
    edges: dict[str, set[str]] = {}
    for f in filters:
        for a, to in getattr(f, "retags", {}).items():
            edges.setdefault(a, set()).update(to)

    def depth(tag: str, seen: tuple[str, ...] = ()) -> int:
        if tag in seen:
            raise ValueError(f"retag rules run in a cycle: {' -> '.join((*seen, tag))}")
        return 1 + max((depth(t, (*seen, tag)) for t in edges.get(tag, ())), default=0)

    passes = max([1, *(depth(t) for t in edges)])  # a record enters once more after each retag
    return lambda df: reduce(lambda d, _: chain(filters)(d), range(passes), df)


@register("post-default")
def clean(max_len: int = 0, add: dict | None = None) -> Filter:
    """Empty keys go, dots in keys become ``__``, texts are cut to ``max_len`` bytes."""

    def run(df: DataFrame) -> DataFrame:
        msg = F.map_filter("message", lambda k, _: k != "")
        msg = F.transform_keys(msg, lambda k, _: F.replace(k, F.lit("."), F.lit("__")))
        if max_len:
            plain = lambda v: F.try_variant_get(v, "$", "string")
            msg = F.transform_values(msg, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", maps.variant(maps.clip_bytes(plain(v), max_len))).otherwise(v))
        df = df.withColumn("message", msg)
        return add_rules(add)(df) if add else df

    return run


@register("es-dispatcher")
def lookup_retag(tags: Sequence[str], tag_key: str, rewrite_tag_map: dict[str, str]) -> Filter:
    """The tag becomes the map's entry for a field; records without one are dropped."""
    pairs = [F.lit(x) for kv in rewrite_tag_map.items() for x in kv]

    def run(df: DataFrame) -> DataFrame:
        new = F.try_element_at(F.create_map(*pairs), maps.text(F.col("message"), tag_key))
        ours = F.col("tag").isin(*tags)
        return df.withColumn("tag", F.when(ours, new).otherwise(F.col("tag"))).where("tag is not null")

    return run


@register("tag-rewriter")
def swap_env(tag: str, tag_key: str = "tag") -> Filter:
    """The environment of one tag is taken from a field."""
    name = tag.split(".")[0]

    def run(df: DataFrame) -> DataFrame:
        env = F.get(F.split(maps.text(F.col("message"), tag_key), r"\."), F.lit(1))
        new = F.concat(F.lit(name + "."), env)
        return df.withColumn("tag", F.when(F.col("tag") == tag, F.coalesce(new, F.col("tag"))).otherwise(F.col("tag")))

    return run


@register("fields")
def fields(tags: Sequence[str], include_fields: Sequence[str] = (), exclude_fields: Sequence[str] = (), new_fields: dict[str, str] | None = None) -> Filter:
    def run(df: DataFrame) -> DataFrame:
        msg = F.col("message")
        if new_fields:
            msg = maps.put(msg, {k: template.dollar(t, F.col("message")) for k, t in new_fields.items()})
        if include_fields:
            msg = maps.only(msg, [*include_fields, *ALWAYS_KEPT])
        elif exclude_fields:
            msg = maps.without(msg, exclude_fields)
        return df.withColumn("message", F.when(F.col("tag").isin(*tags), msg).otherwise(F.col("message")))

    return run


@register("custom-bigdata")
def rowkey(tags: Sequence[str], id_key: str = "vin", time_key: str = "@timestamp", out_key: str = "rowkey") -> Filter:
    def run(df: DataFrame) -> DataFrame:
        at = gotime.parse(maps.text(F.col("message"), time_key), MS_LAYOUT)
        key = F.concat(maps.text(F.col("message"), id_key), F.lit("_"), F.unix_timestamp(at).cast("string"))
        ours = F.col("tag").isin(*tags)
        df = df.where(~ours | key.isNotNull())
        return df.withColumn("message", F.when(ours, maps.put(F.col("message"), {out_key: key})).otherwise(F.col("message")))

    return run


def balance(df: DataFrame, key: str, forks: int | None = None) -> DataFrame:
    """Records dealt out by a field, so that all of one value are in one partition; a missing value counts as empty."""
    by = F.coalesce(maps.text(F.col("message"), key), F.lit(""))
    return df.repartition(forks, by) if forks else df.repartition(by)
