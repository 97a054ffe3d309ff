"""Registered queries and their SQL counterparts.

Each query turns a whole table into records, applies an operator, and ends in
flat columns.  Names match the SQL's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, regex
from ..operators import filters, journal, parse
from ..operators.concat import concat_lines
from ..schema import configure, envelope, to_columns
from ..sources import decoders, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan has far fewer partitions than there are cores.

    A small file with one row group is one task.  Larger inputs have partitions
    enough and are left alone, so this never shuffles much.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


# --------------------------------------------------------------------------- inputs

#: Lines read ``LEVEL time app=.. worker=.. at=place#line ctx={json} - message``.
PATTERN = r"(?s)^(?P<level>[A-Z]+) +(?P<time>[0-9-]+ [0-9:.]+) +app=(?P<app>[^ ]+) +worker=(?P<worker>[^ ]+) +at=(?P<place>[^#]+)#(?P<line>[0-9]+) +ctx=(?P<args>\{.*\}) +- +(?P<message>.*)$"


def log_line() -> Column:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return F.concat(
        level, F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" app=app"), F.col("user_id") % 7, F.lit(" worker=w"), F.col("user_id") % 4,
        F.lit(" at=shop."), F.col("event_type"), F.lit("#"), F.col("event_id") % 100, F.lit(" ctx="), F.col("props"), F.lit(" - value="), F.col("value").cast("string"),
    )


LINE = """case when event_type = 'error' then 'ERROR' else 'INFO' end || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' app=app' || (user_id % 7) || ' worker=w' || (user_id % 4)
  || ' at=shop.' || event_type || '#' || (event_id % 100) || ' ctx=' || props || ' - value=' || cast(value as varchar)"""


def service_log(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(table(spark, sf, "events"))
    return envelope(e, F.lit("app.sit"), {"log": log_line(), "container_id": F.concat(F.lit("c"), F.col("user_id") % 7)}, F.col("event_id"), F.col("ts"))


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(table(spark, sf, "events"))
    values = {"log": log_line(), "user": F.col("user_id"), "kind": F.col("event_type"), "props": F.col("props")}
    return envelope(e, F.concat("event_type", F.lit(".sit")), values, F.col("event_id"), F.col("ts"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(source, seq, text, head): documents split on newlines; the first line is a head."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text"))
    return d.select("source", (F.col("doc_id") * (1 << 32) + F.col("i")).alias("seq"), "text", (F.col("i") == 0).alias("head"))


DOC_LINES = """(select source, doc_id * 4294967296 + i - 1 as seq, parts[i] as text, i = 1 as head from (
  select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as parts from documents)))"""


def concat_sql(rows: str, key: str, max_len: int, wait: str | None = None) -> str:
    """The same records by a different route: explicit running group and flags."""
    gap = f"coalesce(ts - lag(ts) over (partition by {key} order by seq) > {wait}, false)" if wait else "false"
    return f"""
with a as (select *, sum(case when head then 1 else 0 end) over (partition by {key} order by seq) as g, {gap} as late from {rows}),
b as (select *, row_number() over (partition by {key}, g order by seq) - 1 as i, sum(strlen(text)) over (partition by {key}, g order by seq) as cum from a),
c as (select *, g = 0 or (i >= 1 and ((i >= 2 and lag(cum) over (partition by {key}, g order by seq) >= {max_len})
  or max(case when i >= 1 and late then 1 else 0 end) over (partition by {key}, g order by seq) = 1)) as alone from b)
select {key}, min(seq) as seq, md5(string_agg(text, '' order by seq)) as text_md5, count(*) as n_lines
from c group by {key}, case when alone then -seq - 1 else g end"""


# --------------------------------------------------------------------------- parser

_SERVICE = parse.parser(["app.sit"], "log", PATTERN, is_remove_orig_log=True, parse_json_key="args", must_include="app", time_key="time", time_format="2006-01-02 15:04:05.000-0700", append_time_zone="+0800", flatten_depth=1)
_PARSED = f"""(select event_id, regexp_extract(l, '{PATTERN}', ['level', 'time', 'app', 'worker', 'place', 'line', 'args', 'message']) as g, l
  from (select event_id, ts, {LINE} as l from events))"""


@query(f"""select event_id as id, trim(g.app) as app, trim(g.level) as level, trim(g.worker) as worker, trim(g.place) as place, trim(g.line) as line, trim(g.message) as message,
  cast(json_extract(g.args, '$.k') as bigint) as k,
  strftime(strptime(g.time, '%Y-%m-%d %H:%M:%S.%g') - interval 8 hour, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp from {_PARSED}""")
def parse_service_log(spark, sf):
    """Flagship: groups, JSON fields and time of every service log line, as columns."""
    e = spread(table(spark, sf, "events")).select(F.col("event_id").alias("id"), log_line().alias("log"))
    out = parse.parse_columns(e, F.col("log"), PATTERN, json_key="args", json_fields={"k": "bigint"}, must_include="app", time_key="time", time_format="2006-01-02 15:04:05.000-0700", append_time_zone="+0800")
    return out.drop("log")


@query(f"""select event_id as id, trim(g.app) as app, trim(g.level) as level, trim(g.worker) as worker, trim(g.place) as place, trim(g.line) as line, trim(g.message) as message,
  cast(json_extract(g.args, '$.k') as bigint) as k,
  strftime(strptime(g.time, '%Y-%m-%d %H:%M:%S.%g') - interval 8 hour, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp from {_PARSED}""")
def parse_service_records(spark, sf):
    """The same as records: groups and JSON go into the message map."""
    return to_columns(_SERVICE(service_log(spark, sf)), {"app": "string", "level": "string", "worker": "string", "place": "string", "line": "string", "message": "string", "k": "bigint", "@timestamp": "string"}, ("id",))


@query(f"""select trim(g.app) as app, trim(g.level) as level, count(*) as n from {_PARSED} group by 1, 2""")
def parse_count_by_app_level(spark, sf):
    ok, g = regex.extract(maps.text(F.col("message"), "log"), PATTERN)
    return service_log(spark, sf).where(ok).groupBy(g["app"].alias("app"), g["level"].alias("level")).agg(F.count(F.lit(1)).alias("n"))


_TOKEN = r"(?P<name>token|ERROR|password) *[=:] *\"?(?P<value>[A-Za-z0-9]+)"


@query(f"""select doc_id, count(*) as n_lines, max(g.value) as last_value from (
  select doc_id, regexp_extract(line, '{_TOKEN}', ['name', 'value']) as g from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
  where regexp_matches(line, '{_TOKEN}')) group by doc_id""")
def parse_discard_unmatched(spark, sf):
    """Lines without a match are dropped."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    rec = envelope(d, F.lit("doc.sit"), {"log": F.col("line"), "doc_id": F.col("doc_id")}, F.col("doc_id"))
    out = parse.parser(["doc.sit"], "log", _TOKEN, flatten_depth=0)(rec)
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.max(maps.text(F.col("message"), "value")).alias("last_value"))


@query("select event_id as id, event_type as kind, cast(json_extract(props, '$.k') as bigint) as k from events where event_type <> 'view'")
def must_include(spark, sf):
    """Records that lack the required key are dropped."""
    e = table(spark, sf, "events")
    body = F.when(F.col("event_type") == "view", F.lit("{}")).otherwise(F.col("props"))
    rec = envelope(e, F.lit("a.sit"), {"kind": F.col("event_type"), "args": body}, F.col("event_id"))
    out = parse.parser(["a.sit"], parse_json_key="args", must_include="k", flatten_depth=1)(rec)
    return to_columns(out, {"kind": "string", "k": "bigint"}, ("id",))


@query("""select o_orderkey, o_orderstatus as status, o_custkey as customer__key, c_name as customer__name, c_mktsegment as customer__segment__name, c_nationkey as customer__segment__nation
  from orders join customer on o_custkey = c_custkey""")
def json_merge_flatten(spark, sf):
    """A nested JSON body is merged into the record and its objects are opened."""
    o, c = spread(table(spark, sf, "orders")), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    segment = F.struct(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("nation"))
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), segment.alias("segment")).alias("customer")))
    rec = envelope(j, F.lit("o.sit"), {"log": body}, F.col("o_orderkey"))
    out = parse.parser(["o.sit"], parse_json_key="log", flatten_depth=2)(rec)
    return to_columns(out.withColumnRenamed("id", "o_orderkey"), {"status": "string", "customer__key": "bigint", "customer__name": "string", "customer__segment__name": "string", "customer__segment__nation": "int"}, ("o_orderkey",))


@query("""select o_orderkey as id, strftime(o_orderdate + to_milliseconds(o_orderkey % 1000) - interval 8 hour, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp from orders""")
def time_normalise(spark, sf):
    """Comma fractions and an appended zone, normalised to UTC."""
    o = table(spark, sf, "orders")
    t = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    rec = envelope(o, F.lit("o.sit"), {"time": t}, F.col("o_orderkey"))
    out = parse.parser(["o.sit"], time_key="time", time_format="2006-01-02 15:04:05.000-0700", append_time_zone="+0800", tz_sep="", flatten_depth=0)(rec)
    return to_columns(out, {"@timestamp": "string"}, ("id",))


# --------------------------------------------------------------------------- acceptor filters


@query("select event_type || '.sit' as tag, count(*) as n, sum(event_id) as ids from events where event_type in ('click', 'error') group by 1")
def accept_tags(spark, sf):
    rec = filters.accept(remove_empty_tag=True, remove_unknown_tag=True, accept_tags=["click.sit", "error.sit"])(event_records(spark, sf))
    return rec.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(f"select event_id as id, 'spark' as identifier from (select *, {LINE} as l from events) where not regexp_matches(l, 'value=[0-9]*[02468]\\.')")
def ignore_regex_mark(spark, sf):
    rec = service_log(spark, sf).withColumn("tag", F.lit("spark.sit"))
    out = filters.ignore_lines("spark.sit", "log", "identifier", r"value=[0-9]*[02468]\.")(rec)
    return to_columns(out, {"identifier": "string"}, ("id",))


@query("""select doc_id as id, case when regexp_matches(text, '@[a-z]+') then 'mail.sit' when regexp_matches(text, '(?i)copyright|license') then 'legal.sit' else 'spring.sit' end as tag,
  case when regexp_matches(text, '@[a-z]+') then 'mail.sit' when regexp_matches(text, '(?i)copyright|license') then 'legal.sit' end as tag_field from documents""")
def retag_first_match(spark, sf):
    d = spread(table(spark, sf, "documents"))
    rec = envelope(d, F.lit("spring.sit"), {"log": F.col("text")}, F.col("doc_id"))
    f = filters.retag("spring.sit", [("mail.sit", "@[a-z]+"), ("legal.sit", "(?i)copyright|license")])
    out = filters.acceptor_pipeline([f, filters.accept(remove_empty_tag=True)])(rec)
    return to_columns(out, {"tag": "string"}, ("id", F.col("tag").alias("t"))).select("id", F.col("t").alias("tag"), F.col("tag").alias("tag_field"))


@query(f"""select event_id as id, case when event_type = 'click' then 'spark.sit' else 'spring.sit' end as tag from (select *, {LINE} as l from events)
  where not (event_type = 'click' and regexp_matches(l, 'value=[0-9]*[02468]\\.'))""")
def retag_reenter(spark, sf):
    """Records with a new tag go through all filters again: one that stands before the retag drops some of them."""
    rec = service_log(spark, sf).withColumn("tag", F.lit("spring.sit"))
    first, then = filters.ignore_lines("spark.sit", "log", "identifier", r"value=[0-9]*[02468]\."), filters.retag("spring.sit", [("spark.sit", r"at=shop\.click#")])
    return filters.acceptor_pipeline([first, then])(rec).select("id", "tag")


@query("select event_id as id, 'kind.' || event_type as tag, 'kind.' || event_type as tag_field from events where user_id % 5 <> 0")
def tag_from_field(spark, sf):
    """The tag comes from a field; records without it are dropped."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("kind."), F.col("event_type")))
    rec = envelope(e, F.lit("x"), {"origin": kind}, F.col("event_id"))
    return to_columns(decoders.tag_from_field(rec, "origin"), {"tag": "string"}, ("id", F.col("tag").alias("t"))).select("id", F.col("t").alias("tag"), F.col("tag").alias("tag_field"))


@query("select event_id as id, event_type || chr(1) || user_id as a, cast(event_id as varchar) || chr(1) as b from events")
def parse_control_chars(spark, sf):
    """Captured texts may hold any control character."""
    e = table(spark, sf, "events")
    line = F.concat(F.lit("a="), F.col("event_type"), F.lit("\x01"), F.col("user_id"), F.lit(" b="), F.col("event_id"), F.lit("\x01"))
    rec = envelope(e, F.lit("a.sit"), {"log": line}, F.col("event_id"))
    return to_columns(parse.parser(["a.sit"], "log", r"(?s)^a=(?P<a>[^ ]*) b=(?P<b>.*)$", flatten_depth=0)(rec), {"a": "string", "b": "string"}, ("id",))


@query(f"""select event_id as id, trim(g.app) || '-' || lower(trim(g.level)) || '@app.sit' as who, cast(null as varchar) as worker from {_PARSED}""")
def parser_add_rules(spark, sf):
    """The parser's add rules, written with an environment, over what it parsed."""
    from . import config

    add = config.parse_add({"app.{env}": [{"who": "%{app}-%{@lower:level}@%{@tag}"}, {"worker": None}]}, "sit")
    out = parse.parser(["app.sit"], "log", PATTERN, flatten_depth=0, add=add)(service_log(spark, sf))
    return to_columns(out, {"who": "string", "worker": "string"}, ("id",))


@query("select event_id as id, abs(cast(event_id as bigint) - 5000) as distance from events")
def abs_int(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), maps.abs_int(F.col("event_id") - 5000).alias("distance"))


@query("""select '{"kind":"' || event_type || '","user":"u' || user_id || '"}' as value, count(*) as n from events group by 1""")
def kafka_sink_values(spark, sf):
    e = table(spark, sf, "events")
    rec = envelope(e, F.lit("a.sit"), {"kind": F.col("event_type"), "user": F.concat(F.lit("u"), F.col("user_id"))}, F.col("event_id"))
    return sinks.to_kafka(rec).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'a.sit' as tag, event_id as id, '{"kind":"' || event_type || '"}' as line from events""")
def line_sink_rows(spark, sf):
    rec = envelope(table(spark, sf, "events"), F.lit("a.sit"), {"kind": F.col("event_type")}, F.col("event_id"))
    return sinks.to_lines(rec)


@query("""select event_id as id from (select event_id, row_number() over (partition by date_trunc('minute', ts) order by event_id) as n from events) where n <= 2""")
def throttle_per_minute(spark, sf):
    """The throttle's window taken as a minute: timestamps are cut to whole minutes before it."""
    e = table(spark, sf, "events").select("event_id", F.date_trunc("minute", "ts").alias("m"))
    return journal.throttle(e, "m", "event_id", 2).select(F.col("event_id").alias("id"))


@query("""select event_id as id from (select event_id, row_number() over (partition by user_id, date_trunc('second', ts) order by event_id) as n from events) where n <= 1""")
def throttle_per_second(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return journal.throttle(e, "ts", "event_id", 1, ["user_id"]).select(F.col("event_id").alias("id"))


# --------------------------------------------------------------------------- concat


def _told(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "seq", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("n_lines").cast("bigint").alias("n_lines"))


@query(concat_sql(DOC_LINES, "source", 1 << 40))
def concat_lines_by_source(spark, sf):
    return _told(concat_lines(doc_lines(spark, sf), ["source"], "seq", "text", "head", max_len=1 << 40, wait_sec=None), "source")


@query(concat_sql(DOC_LINES, "source", 600))
def concat_max_len(spark, sf):
    return _told(concat_lines(doc_lines(spark, sf), ["source"], "seq", "text", "head", max_len=600, wait_sec=None), "source")


@query(concat_sql(f"(select user_id, event_id as seq, epoch(ts) as ts, {LINE} as text, event_id % 4 = 0 as head from events)", "user_id", 300000, "9000"))
def concat_idle_timeout(spark, sf):
    e = table(spark, sf, "events")
    d = e.select("user_id", F.col("event_id").alias("seq"), log_line().alias("text"), (F.col("event_id") % 4 == 0).alias("head"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return _told(concat_lines(d, ["user_id"], "seq", "text", "head", wait_sec=9000, ts="ts"), "user_id")


@query(concat_sql("(select conv_id, turn as seq, coalesce(text, '') as text, role = 'user' as head from conversations)", "conv_id", 300000))
def concat_conversation_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), (F.col("role") == "user").alias("head"))
    return _told(concat_lines(c, ["conv_id"], "seq", "text", "head", wait_sec=None), "conv_id")


@query("select conv_id * 4294967296 + turn as id from conversations")
def journal_ext_ids(spark, sf):
    """Every id is committed: a stitched record's own and those merged into it."""
    c = table(spark, sf, "conversations").select("conv_id", (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("seq"), F.coalesce("text", F.lit("")).alias("text"), (F.col("role") == "user").alias("head"))
    out = concat_lines(c, ["conv_id"], "seq", "text", "head", wait_sec=None)
    return journal.committed_ids(out.select(F.col("seq").alias("id"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(1))).alias("ext_ids")))


@query(f"""with r as (select user_id, event_id as seq, epoch(ts) as ts, {LINE} as text, event_id % 4 = 0 as head from events),
a as (select *, sum(case when head then 1 else 0 end) over (partition by user_id order by seq) as g, coalesce(ts - lag(ts) over (partition by user_id order by seq) > 9000, false) as late from r),
b as (select *, sum(case when late and not head and g > 0 then 1 else 0 end) over (partition by user_id, g order by seq) as s from a),
c as (select *, row_number() over (partition by user_id, g, s order by seq) > 1 and sum(strlen(text)) over (partition by user_id, g, s order by seq) >= 250 as full_now from b),
d as (select *, g = 0 or coalesce(bool_or(full_now) over (partition by user_id, g order by seq rows between unbounded preceding and 1 preceding), false) as alone from c)
select user_id, min(seq) as seq, md5(string_agg(text, '' order by seq)) as text_md5, count(*) as n_lines from d group by user_id, g, s, case when alone then seq else -1 end""")
def concat_adopt_late(spark, sf):
    """A line that comes after the wait begins the next record."""
    e = table(spark, sf, "events")
    d = e.select("user_id", F.col("event_id").alias("seq"), log_line().alias("text"), (F.col("event_id") % 4 == 0).alias("head"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return _told(concat_lines(d, ["user_id"], "seq", "text", "head", max_len=250, wait_sec=9000, ts="ts", adopt=True), "user_id")


# --------------------------------------------------------------------------- functions


@query("""select event_id as id, case when event_type = 'click' then upper(event_type) end as up, case when event_type = 'click' then 'u' || user_id || '/click.sit' end as who,
  case when event_type = 'click' then null else cast(user_id as varchar) end as user from events""")
def add_rules(spark, sf):
    rules = {"click.sit": [{"up": "%{@upper:kind}"}, {"who": "u%{user}/%{@tag}"}, {"user": None}]}
    return to_columns(filters.add_rules(rules)(event_records(spark, sf)), {"up": "string", "who": "string", "user": "string"}, ("id",))


@query("select event_id as id, json_extract_string(props, '$.k') as k, cast(null as varchar) as miss, event_type as deep from events")
def nested_get(spark, sf):
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"p":'), F.col("props"), F.lit(',"q":{"r":{"s":"'), F.col("event_type"), F.lit('"}}}'))
    m = e.select(F.col("event_id").alias("id"), maps.from_json(body).alias("m"))
    show = lambda p: maps.shown(maps.nested(F.col("m"), p))
    return m.select("id", show("p.k").alias("k"), show("p.k.z").alias("miss"), show("q.r.s").alias("deep"))


@query("select c_custkey as id, c_name || ' of ' || c_nationkey || ':' || c_mktsegment as label, c_mktsegment || c_name || c_mktsegment as twice from customer")
def template_fields(spark, sf):
    c = table(spark, sf, "customer")
    rec = envelope(c, F.lit("c.sit"), {"name": F.col("c_name"), "nation": F.col("c_nationkey"), "seg": F.col("c_mktsegment")}, F.col("c_custkey"))
    out = filters.fields(["c.sit"], new_fields={"label": "${name} of ${nation}:${seg}", "twice": "${seg}${name}${seg}${none}"})(rec)
    return to_columns(out, {"label": "string", "twice": "string"}, ("id",))


def _lineitems(spark, sf) -> DataFrame:
    li = spread(table(spark, sf, "lineitem"))
    values = {"part": F.col("l_partkey"), "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "level": F.lit("INFO")}
    return envelope(li, F.lit("l.sit"), values, F.col("l_orderkey") * 10 + F.col("l_linenumber"))


_FIELDS = {"part": "bigint", "flag": "string", "status": "string", "level": "string"}


@query("select l_orderkey * 10 + l_linenumber as id, l_partkey as part, l_returnflag as flag, cast(null as varchar) as status, 'INFO' as level from lineitem")
def fields_include(spark, sf):
    return to_columns(filters.fields(["l.sit"], include_fields=["part", "flag"])(_lineitems(spark, sf)), _FIELDS, ("id",))


@query("select l_orderkey * 10 + l_linenumber as id, cast(null as bigint) as part, l_returnflag as flag, cast(null as varchar) as status, 'INFO' as level from lineitem")
def fields_exclude(spark, sf):
    return to_columns(filters.fields(["l.sit"], exclude_fields=["part", "status"])(_lineitems(spark, sf)), _FIELDS, ("id",))


@query("select event_id as id, user_id || '_' || cast(floor(epoch(ts)) as bigint) as rowkey from events")
def rowkey(spark, sf):
    e = table(spark, sf, "events")
    rec = envelope(e, F.lit("v.sit"), {"vin": F.col("user_id").cast("string"), "@timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}, F.col("event_id"))
    return to_columns(filters.rowkey(["v.sit"])(rec), {"rowkey": "string"}, ("id",))


@query("select event_id as id, 'forward-x.' || case when user_id % 2 = 0 then 'prod' else 'uat' end as tag from events")
def tag_env_rewrite(spark, sf):
    e = table(spark, sf, "events")
    origin = F.concat(F.lit("x."), F.when(F.col("user_id") % 2 == 0, "prod").otherwise("uat"))
    rec = envelope(e, F.lit("forward-x.sit"), {"tag": origin}, F.col("event_id"))
    return filters.swap_env("forward-x.sit")(rec).select("id", "tag")


@query("select n_nationkey as id, r_name as tag from nation join region on n_regionkey = r_regionkey where r_regionkey <> 4")
def lookup_retag(spark, sf):
    n = table(spark, sf, "nation")
    names = {str(r.r_regionkey): r.r_name for r in table(spark, sf, "region").where("r_regionkey != 4").collect()}  # a fixed map of settings
    rec = envelope(n, F.lit("nation.sit"), {"key": F.col("n_regionkey").cast("string")}, F.col("n_nationkey"))
    return filters.lookup_retag(["nation.sit"], "key", names)(rec).select("id", "tag")


@query("select p_partkey as id, left(p_name, 8) as p__name, left(p_type, 8) as type, cast(null as varchar) as gone from part")
def rename_truncate_fields(spark, sf):
    p = table(spark, sf, "part")
    rec = envelope(p, F.lit("p.sit"), {"p.name": F.col("p_name"), "type": F.col("p_type"), "": F.lit("x")}, F.col("p_partkey"))
    return to_columns(filters.clean(8)(rec), {"p__name": "string", "type": "string", "": "string"}, ("id",)).withColumnRenamed("", "gone")


# --------------------------------------------------------------------------- producer, journal, sinks


@query("""select event_id as id, '{"index": {"_index": "idx-' || event_type || '", "_type": "logs"}}' || chr(10) || '{"kind":"' || event_type || '","user":"u' || user_id || '"}' || chr(10) as bulk_line
  from events where event_type in ('click', 'view')""")
def index_routing_bulk(spark, sf):
    e = table(spark, sf, "events")
    rec = envelope(e, F.concat("event_type", F.lit(".sit")), {"kind": F.col("event_type"), "user": F.concat(F.lit("u"), F.col("user_id"))}, F.col("event_id"))
    return sinks.to_bulk(rec, {"click.sit": "idx-click", "view.sit": "idx-view"}).select("id", "bulk_line")


@query("select event_id as id, 'host-sit-' || event_id as msgid from events")
def msgid_stamp(spark, sf):
    return to_columns(journal.stamp(event_records(spark, sf), "host-sit"), {"msgid": "string"}, ("id",))


_SINKS = "(values ('a', 0), ('b', 1), ('c', 2)) as s(sink, k)"


@query(f"""select event_id as id, count(*) as n_sinks, bool_and((event_id + k) % 10 <> 0) as committed from events, {_SINKS} where k < 2 or event_type = 'click' group by event_id""")
def fanout_commit_barrier(spark, sf):
    """Every record goes to each sink of its tag; it is committed if all took it."""
    rec = event_records(spark, sf).select("id", "tag")
    takes = {"a": None, "b": None, "c": ["click.sit"]}
    sent = None
    for k, tags in enumerate(takes.values()):
        one = (rec.where(F.col("tag").isin(*tags)) if tags else rec).select("id", ((F.col("id") + k) % 10 != 0).alias("ok"))
        sent = one if sent is None else sent.unionByName(one)
    return journal.commit_barrier(sent)


@query("select o_orderkey as id, o_orderstatus as status from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 25)")
def journal_replay(spark, sf):
    o = table(spark, sf, "orders")
    log = envelope(o, F.lit("o.sit"), {"status": F.col("o_orderstatus")}, F.col("o_orderkey"))
    done = table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    return to_columns(journal.replay(log, done), {"status": "string"}, ("id",))


@query("select max(event_id) as max_id from events")
def journal_max_id(spark, sf):
    return journal.max_id(event_records(spark, sf))


@query("select event_id as id, event_type || '.sit' as tag from events")
def journal_dedup(spark, sf):
    """A log with a part of its records twice."""
    rec = event_records(spark, sf).select("id", "tag", "_ingest_ts")
    return journal.drop_replayed(rec.unionByName(rec.where(F.col("tag") == "click.sit"))).select("id", "tag")


@query("select event_type || '.sit' as tag, count(*) as n from events group by 1")
def tag_counts(spark, sf):
    return journal.tag_counts(event_records(spark, sf).select("tag"))


@query("select event_type || '.sit' as tag, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events group by 1, 2")
def tag_rate_tumbling(spark, sf):
    out = journal.tag_rates(event_records(spark, sf).select("tag", "_ingest_ts"), "_ingest_ts", "1 hour")
    return out.select("tag", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select user_id, event_id, floor((row_number() over (partition by user_id order by event_id) - 1) / 5) as batch_no from events")
def batch_assign(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    return journal.assign_batches(e, ["user_id"], "event_id", 5)


# --------------------------------------------------------------------------- sources

_SALT = "s4lt"
_NOW = "2024-01-01 00:00:00"
_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(f"""with b as (select event_id, ts, {_TS} as t, (select max(ts) from events) as hi from events)
select event_id as id, case when event_id % 11 = 0 then 'env' when event_id % 7 = 0 then 'json' when event_id % 5 = 0 then 'signature'
  when epoch(date_trunc('second', timestamp '{_NOW}')) - floor(epoch(ts)) > 86400 then 'expired' when epoch(date_trunc('second', timestamp '{_NOW}')) - floor(epoch(ts)) < -86400 then 'from the future' end as reject_reason,
  case when event_id % 11 <> 0 and event_id % 7 <> 0 and event_id % 5 <> 0 and abs(epoch(date_trunc('second', timestamp '{_NOW}')) - floor(epoch(ts))) <= 86400 then 'origin.sit' end as tag_field from b""")
def http_signature_validate(spark, sf):
    """Signed bodies, some with a wrong signature, body or environment, at a fixed time."""
    e = table(spark, sf, "events")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    sig = F.md5(F.concat(t, F.when(F.col("event_id") % 5 == 0, "other").otherwise(_SALT)).cast("binary"))
    body = F.when(F.col("event_id") % 7 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct(t.alias("@timestamp"), sig.alias("sig"))))
    d = e.select(F.col("event_id").alias("id"), body.alias("body"), F.when(F.col("event_id") % 11 == 0, "dev").otherwise("sit").alias("env"))
    out = decoders.decode_http(d, tag="forward-origin", orig_tag="origin", env="sit", signature_salt=_SALT, max_allowed_delay_sec=86400, max_allowed_ahead_sec=86400, now=F.lit(_NOW).cast("timestamp"))
    return out.select("id", "reject_reason", maps.text(F.col("message"), "tag").alias("tag_field"))


@query("select event_id as id, 'bigdata.sit' as tag, event_type as tag_field, user_id as user from events")
def kafka_json_tagged(spark, sf):
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("user"), F.col("event_id").alias("id")))
    rows = e.select(body.cast("binary").alias("value")).unionByName(e.select(F.lit("no json").cast("binary").alias("value")))
    out = decoders.decode_kafka(rows, tag="x", json_tag_key="t", rewrite_tag="bigdata.sit")
    return to_columns(out, {"id": "bigint", "user": "bigint", "tag": "string"}, (F.col("tag").alias("r"),)).select("id", F.col("r").alias("tag"), F.col("tag").alias("tag_field"), "user")


@query("""select event_id as id, 13 as priority, 'host' || (user_id % 5) as hostname, event_type as origin_tag, 'value ' || props as message,
  strftime(date_trunc('second', ts) - interval 8 hour, '%m-%dT%H:%M:%S.%gZ') as at from events""")
def syslog_rfc3164(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat(F.lit("<13>"), F.date_format("ts", "MMM "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss"), F.lit(" host"), F.col("user_id") % 5, F.lit(" "), F.col("event_type"), F.lit("[12]: value "), F.col("props"))
    d = e.select(F.col("event_id").alias("id"), line.alias("line"))
    out = decoders.decode_syslog(d, tag="log.sit", rewrite_tags={"tag": "origin_tag"}, time_shift_sec=-28800, year=2024)
    c = to_columns(out, {"priority": "int", "hostname": "string", "origin_tag": "string", "message": "string", "@timestamp": "string"}, ("id",))
    return c.select("id", "priority", "hostname", "origin_tag", "message", F.substring("timestamp", 6, 30).alias("at"))


@query("""select 'event' as tag, count(*) as n from events union all select 'doc' as tag, count(*) as n from documents""")
def union_receivers(spark, sf):
    a = envelope(table(spark, sf, "events"), F.lit("event"), {"v": F.col("value")}, F.col("event_id"))
    b = envelope(table(spark, sf, "documents"), F.lit("doc"), {"v": F.col("n_chars")}, F.col("doc_id"))
    return journal.tag_counts(a.unionByName(b))


@query("select user_id % 3 as tag_no, count(*) as n, sum(event_id) as ids, count(distinct event_type) as kinds from events group by 1")
def forward_codec_roundtrip(spark, sf):
    """Records encoded as frames and decoded again."""
    e = table(spark, sf, "events")
    rec = envelope(spread(e), (F.col("user_id") % 3).cast("string"), {"id": F.col("event_id"), "kind": F.col("event_type"), "none": F.lit(None).cast("string")}, F.col("event_id"))
    back = decoders.decode_forward(decoders.encode_forward(rec).select("body"))
    out = back.select(F.col("tag").cast("bigint").alias("tag_no"), F.try_variant_get(F.col("message")["id"], "$", "bigint").alias("id"), maps.text(F.col("message"), "kind").alias("kind"))
    return out.groupBy("tag_no").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count_distinct("kind").alias("kinds"))


@query("select user_id, 1 as n_partitions from events group by user_id")
def partition_colocation(spark, sf):
    """All records of a field's value meet in one partition."""
    rec = envelope(table(spark, sf, "events"), F.lit("a.sit"), {"user": F.col("user_id")}, F.col("event_id"))
    p = filters.balance(rec, "user").select(F.try_variant_get(F.col("message")["user"], "$", "bigint").alias("user_id"), F.spark_partition_id().alias("p"))
    return p.groupBy("user_id").agg(F.count_distinct("p").cast("int").alias("n_partitions"))


@query(f"""with m as (select event_id, event_type, user_id, {LINE} as l, row_number() over (partition by date_trunc('second', ts) order by event_id) as n from events)
select event_type || '.sit' as tag, count(*) as n, sum(case when event_type = 'error' then 1 else 0 end) as errors, max('h-sit-' || event_id) as last_msgid
from m where event_type <> 'view' and n <= 1000 group by 1""")
def whole_pipeline(spark, sf):
    """A document compiled to a plan: accept, parse, reshape and stamp."""
    from . import config, pipeline

    doc = {"settings": {
        "acceptor_filters": {"is_throttle": True, "throttle_per_sec": 1000, "throttle_max": 1000, "plugins": {"default": {"remove_empty_tag": True, "remove_unknown_tag": True, "accept_tags": [f"{t}.{{env}}" for t in ("click", "error", "purchase", "signup", "login", "logout", "search", "scroll")]}}},
        "tag_filters": {"plugins": {"all": {"type": "parser", "tags": ["click.{env}", "error.{env}", "purchase.{env}"], "msg_key": "log", "pattern": PATTERN, "is_remove_orig_log": True, "parse_json_key": "args", "time_key": "time", "time_format": "2006-01-02 15:04:05.000", "flatten_depth": 1}}},
        "post_filters": {"plugins": {"default": {"max_len": 64}}},
    }}
    spec = config.load(doc, "sit", "h")
    out = journal.stamp(pipeline.compile_batch(spec)(event_records(spark, sf)), spec.host_key)
    level = maps.text(F.col("message"), "level")
    return out.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(level == "ERROR").alias("errors"), F.max(maps.text(F.col("message"), "msgid")).alias("last_msgid"))

