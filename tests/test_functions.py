"""Templates, maps, patterns and time layouts, by tables of cases."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import gotime, maps, regex, template
from logweave.operators import parse

#: A record of a shop, with text, numbers, and an object inside.
JSON = '{"item":"kettle","Shop":"North","count":7,"price":19.5,"whole":3.0,"ok":true,"address":{"City":"Graz","zip":"8010","geo":{"lat":47}}}'


def one(spark, column, json=JSON):
    df = spark.createDataFrame([(json, "shop.sit", 987)], "j string, tag string, id long").withColumn("m", maps.from_json(F.col("j")))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("what", "cases"),
    [
        ("plain text and what only looks like a template", {"no template": "no template", "50% {item}": "50% {item}", "%%{item}": "%kettle", "%{{item}": "%{{item}", "%{item}}": "kettle}", "%{}": "%{}"}),
        ("scalars", {"%{item}": "kettle", "<%{Shop}>": "<North>", "%{count} x %{price}": "7 x 19.5", "%{whole}": "3", "%{ok}": "true", "%{item}%{item}": "kettlekettle"}),
        ("misses", {"[%{none}]": "[]", "[%{shop}]": "[]", "[%{address.none}]": "[]", "[%{item.x}]": "[]"}),
        ("paths and objects", {"%{address.City}": "Graz", "%{address.geo.lat}": "47", "%{address.geo}": "map[lat:47]"}),
        ("functions", {"%{@tag}/%{@id}": "shop.sit/987", "%{@upper:item}": "KETTLE", "%{@lower:Shop}": "north", "%{@upper:address.City}": "GRAZ", "[%{@what}]": "[]"}),
    ],
)
def test_percent_templates(spark, what, cases):
    df = spark.createDataFrame([(JSON, "shop.sit", 987)], "j string, tag string, id long").withColumn("m", maps.from_json(F.col("j")))
    row = df.select(*[template.percent(t, F.col("m"), F.col("tag"), F.col("id")).alias(str(i)) for i, t in enumerate(cases)]).first()
    assert dict(zip(cases, row, strict=True)) == cases, what


def test_random_text_of_a_template(spark):
    x = one(spark, template.percent("%{@str}", F.col("m"), F.col("tag"), F.col("id")))
    assert len(x) == 8 and x.isalnum()


def test_dollar_template(spark):
    assert one(spark, template.dollar("${count} of ${item}, ${gone}${price} each: $item {count}", F.col("m"))) == "7 of kettle, 19.5 each: $item {count}"


def test_nested_lookup(spark):
    at = lambda path, json=JSON: one(spark, maps.shown(maps.nested(F.col("m"), path)), json)
    assert at("address.zip") == "8010" and at("address.geo.lat") == "47"
    assert [at(p) for p in ("", ".", "address.", ".zip", "address..zip", "item.x", "address.geo.lat.x")] == [None] * 7
    assert at("a.b", '{"a.b":"literal","a":{"b":"inner"}}') == "literal"  # a key with a dot comes before a path


@pytest.mark.parametrize("d", ["__", ".", "->"])
def test_flatten(spark, d):
    got = one(spark, F.transform_values(maps.flatten(F.col("m"), d), lambda _, v: maps.shown(v)), '{"order":5,"by":{"name":"Ada","where":{"room":"12b"}},"none":{}}')
    assert got == {"order": "5", f"by{d}name": "Ada", f"by{d}where{d}room": "12b"}


def test_flatten_any_depth(spark):
    shown = lambda *a: F.transform_values(maps.flatten(F.col("m"), *a), lambda _, v: maps.shown(v))
    for n in (1, 5, 6, 7, 40):
        deep = '{"k":' * n + '{"x":1,"y":{}}' + "}" * n
        assert one(spark, shown(), f'{{"a":{deep},"b":"c"}}') == {"a__" + "k__" * n + "x": "1", "b": "c"}
    assert one(spark, shown("__", 1), '{"a":{"b":{"c":1}}}') == {"a__b": "map[c:1]"}
    assert one(spark, shown(), '{"a":[{"b":{"c":1}}],"d":null}').keys() == {"a", "d"}
    df = spark.createDataFrame([("t", '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}')], "tag string, j string")
    assert parse.parser(["t"], must_include="a__b__c__d__e__f__g")(df.select("tag", maps.from_json(F.col("j")).alias("message"))).count() == 1


def test_flatten_keeps_arrays(spark):
    assert one(spark, F.to_json(maps.flatten(F.col("m"))), '{"a":[1,{"b":2}]}') == '{"a":[1,{"b":2}]}'


def test_named_groups(spark):
    pat = r"^(?P<door>[^;]+); *(?P<who_came>[^;]*);(?P<note>.*?)(?P<alarm>!+)?$"
    ok, g = regex.extract(F.col("l"), pat)
    lines = ["east gate ;  Bo ;late!!", "north;;", "no door", "", None]
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select(ok.alias("ok"), *[c.alias(n) for n, c in g.items()]).collect()
    assert [r.ok for r in rows] == [True, True, False, False, False]
    assert rows[0].asDict() == {"ok": True, "door": "east gate", "who_came": "Bo", "note": "late", "alarm": "!!"}
    assert rows[1].asDict() == {"ok": True, "door": "north", "who_came": None, "note": None, "alarm": None}


def test_captures_of_any_text(spark):
    """The separator of captures may occur in the text, in a capture or beside it, and a pattern may have no groups."""
    ok, g = regex.extract(F.col("l"), r"a=(?P<a>\S*) b=(?P<b>.*)")
    lines = ["a=x\x01y b=z", "\x01a= b=\x01", "a=1 b=2", "\x01 nothing", "a=\\1$1 b=$2"]
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select(ok.alias("ok"), g["a"].alias("a"), g["b"].alias("b")).collect()
    assert [tuple(r) for r in rows] == [(True, "x\x01y", "z"), (True, None, "\x01"), (True, "1", "2"), (False, None, None), (True, "\\1$1", "$2")]
    none, _ = regex.extract(F.col("l"), "b=")
    assert [r.x for r in spark.createDataFrame([("a b=",), ("a",)], "l string").select(none.alias("x")).collect()] == [True, False]


def test_pattern_translation(spark):
    assert regex.translate(r"(?P<a_b>x)(?:y)([^\[(]+)\($") == (r"(?d)(x)(?:y)([^\[(]+)\(\z", (("a_b", 1),), 2)
    assert regex.translate(r"(?m)^[]$]a$")[0] == r"(?d)(?m)^[]$]a$"
    df = spark.createDataFrame([("a\rb",), ("b\n",)], "s string")
    assert [r.x for r in df.select(regex.matches(F.col("s"), "a.b").alias("x")).collect()] == [True, False]
    assert [r.x for r in df.select(regex.matches(F.col("s"), "b$").alias("x")).collect()] == [True, False]


def test_time_layouts(spark):
    assert gotime.to_spark("2006-01-02 15:04:05.000-0700") == "yyyy-MM-dd HH:mm:ss.SSSxx"
    assert gotime.to_spark("2006-01-02T15:04:05.000000Z") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    df = spark.createDataFrame([("2018-03-06 16:56:22.514+0800",), ("bad",)], "s string")
    got = [r.x for r in df.select(gotime.show(gotime.parse(F.col("s"), "2006-01-02 15:04:05.000-0700"), "2006-01-02T15:04:05.000000Z").alias("x")).collect()]
    assert got == ["2018-03-06T08:56:22.514000Z", None]


def test_clip_bytes(spark):
    df = spark.createDataFrame([("abc",), ("aé",), (None,)], "s string")
    assert [r.x for r in df.select(maps.clip_bytes(F.col("s"), 2).alias("x")).collect()] == ["ab", "a�", None]
