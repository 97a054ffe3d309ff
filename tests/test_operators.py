"""Filters, parser, concat, journal, throttle and configuration."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave import cli
from logweave.functions import maps
from logweave.operators import filters, journal, parse
from logweave.operators.concat import ConcatRule, concat_lines, concat_records
from logweave.plans import catalog, config, pipeline
from logweave.schema import COLUMNS
from logweave.sources.sinks import Sink
from logweave.streaming.concat import Stitcher


def records(spark, rows):
    """rows: (tag, json[, seconds])."""
    data = [(r[0], r[1], i + 1, float(r[2]) if len(r) > 2 else float(i)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "tag string, j string, id long, t double")
    return df.select("tag", maps.from_json(F.col("j")).alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), F.col("id").alias("_seq"), F.timestamp_seconds("t").alias("_ingest_ts"))


def told(df):
    return {r.id: (r.tag, r.m) for r in df.select("id", "tag", F.transform_values("message", lambda _, v: maps.shown(v)).alias("m")).collect()}


def test_accept(spark):
    df = records(spark, [("a.sit", "{}"), ("", "{}"), ("b.sit", "{}")])
    assert set(told(filters.accept(True, True, ["a.sit"])(df))) == {1}
    assert set(told(filters.accept(True)(df))) == {1, 3}
    with pytest.raises(ValueError, match="accept_tags"):
        filters.accept(remove_unknown_tag=True)


def test_ignore_lines(spark):
    df = records(spark, [("spark.sit", '{"log":"DEBUG x"}'), ("spark.sit", '{"log":"INFO"}'), ("other", '{"log":"DEBUG"}'), ("spark.sit", '{"log":1}')])
    got = told(filters.ignore_lines("spark.sit", "log", "container_id", "DEBUG")(df))
    assert got[2] == ("spark.sit", {"log": "INFO", "container_id": "spark"}) and got[3] == ("other", {"log": "DEBUG"}) and 1 not in got


def test_retag_and_reentry(spark):
    f = filters.retag("spring.sit", [("x.sit", "^a"), ("y.sit", "b")])
    got = told(filters.acceptor_pipeline([f, filters.accept(remove_unknown_tag=True, accept_tags=["x.sit", "y.sit", "spring.sit"])])(records(spark, [("spring.sit", '{"log":"ab"}'), ("spring.sit", '{"log":"cb"}'), ("spring.sit", '{"log":"q"}'), ("spring.sit", '{"log":{"a":1}}')])))
    assert {k: v[0] for k, v in got.items()} == {1: "x.sit", 2: "y.sit", 3: "spring.sit"} and got[1][1]["tag"] == "x.sit"
    with pytest.raises(ValueError, match="cycle"):
        filters.acceptor_pipeline([filters.retag("a", [("b", "x")]), filters.retag("b", [("a", "x")])])


def test_parser_steps(spark):
    p = parse.parser(["t"], "log", r"^(?P<time>[\d :,-]+)\|(?P<app>\w*)\|(?P<args>.*)$", is_remove_orig_log=True, parse_json_key="args", must_include="k", time_key="time", time_format="2006-01-02 15:04:05.000-0700", append_time_zone="+0800", add={"t": [{"up": "%{@upper:app}"}, {"app": None}]})
    rows = [("t", '{"log":"2018-03-06 16:56:22,514|ab|{\\"k\\":{\\"z\\":1},\\"k__q\\":2,\\"k\\":{\\"z\\":3}}"}'), ("t", '{"log":"nothing"}'), ("t", '{"other":1}'), ("u", '{"log":"x"}'), ("t", '{"log":"2018-13-06 16:56:22,514|ab|{\\"k\\":1}"}'), ("t", '{"log":"2018-03-06 16:56:22,514||{\\"k\\":1}"}'), ("t", '{"log":"2018-03-06 16:56:22,514|ab|{bad"}')]
    got = told(parse.parser(["t"], "log", r"^(?P<a>\w)(?P<b>\w)?")(records(spark, [("t", '{"log":" x"}'), ("t", '{"log":"y "}')])))
    assert got == {2: ("t", {"log": "y ", "a": "y"})}
    got = told(p(records(spark, rows)))
    assert set(got) == {3, 4, 6}  # 1 has k only inside, 2 does not match, 3 has no text and passes, 5 has a bad month, 7 lacks k
    assert got[6][1] == {"k": "1", "up": "", "@timestamp": "2018-03-06T08:56:22.514000Z"}


def test_post_filters(spark):
    df = records(spark, [("a.sit", '{"x.y":"abcdef","":"q","n":5}'), ("b.sit", '{"k":"one"}'), ("b.sit", '{"k":"none"}'), ("f-x.sit", '{"tag":"x.prod"}'), ("v.sit", '{"vin":"V","@timestamp":"2018-03-06T16:56:22.514Z"}'), ("v.sit", '{"vin":"V","@timestamp":"bad"}')])
    got = told(filters.clean(3)(df))
    assert got[1][1] == {"x__y": "abc", "n": "5"}
    got = told(filters.chain([filters.lookup_retag(["b.sit"], "k", {"one": "c.sit"}), filters.swap_env("f-x.sit"), filters.rowkey(["v.sit"])])(df))
    assert got[2][0] == "c.sit" and 3 not in got and got[4][0] == "f-x.prod" and got[5][1]["rowkey"] == "V_1520355382" and 6 not in got
    got = told(filters.fields(["a.sit"], include_fields=["n"], new_fields={"z": "${n}!"})(df))
    assert got[1][1] == {"n": "5"} and "k" in got[2][1]
    assert told(filters.fields(["a.sit"], exclude_fields=["n"], new_fields={"z": "${n}!"})(df))[1][1] == {"x.y": "abcdef", "": "q", "z": "5!"}


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30), st.sampled_from([1.5, 3.0, 1000.0]), st.floats(0.1, 0.6))
def test_concat_matches_state_machine(spark, seed, max_len, wait, p_head):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for seq in range(120):
        t += rng.choice([0.1, 0.5, 2.0])
        rows.append((rng.choice("ab"), seq, "x" * rng.randint(0, 9), rng.random() < p_head, t))
    want = []
    for key in "ab":
        m = Stitcher(max_len, wait)
        for k, seq, text, head, ts in rows:
            if k == key:
                want += [(key, *x) for x in m.line(seq, text, head, ts)]
        want += [(key, *x) for x in m.flush()]
    df = spark.createDataFrame(rows, "k string, seq long, text string, head boolean, ts double")
    got = [(r.k, r.seq, r.text, list(r.ids)) for r in concat_lines(df, ["k"], "seq", "text", "head", max_len=max_len, wait_sec=wait, ts="ts").collect()]
    assert sorted(got) == sorted(want)


def test_adopt_mode():
    m = Stitcher(100, 3.0, adopt=True)
    out = m.line(0, "head", True, 0) + m.line(1, "late", False, 9) + m.line(2, "!", False, 10) + m.flush()
    assert out == [(0, "head", [0]), (1, "late!", [1, 2])]


def test_concat_records(spark):
    lines = ["2018 head", "\\tat a", "\\tat b", "2019 next", "tail"]
    df = records(spark, [("t.sit", f'{{"log":"{x}","container_id":"c","n":{i}}}', 0) for i, x in enumerate(lines)] + [("u.sit", '{"log":"\\tat z"}', 0), ("t.sit", '{"log":"no id"}', 0)])
    out = concat_records(df, {"t.sit": ConcatRule("log", "container_id", r"^\d{4}")})
    got = {r.id: (r.log, r.ext_ids) for r in out.select("id", maps.text(F.col("message"), "log").alias("log"), "ext_ids").collect()}
    assert got == {1: ("2018 head\tat a\tat b", [2, 3]), 4: ("2019 nexttail", [5]), 6: ("\tat z", None), 7: ("no id", None)}
    assert out.columns == COLUMNS


def test_journal(spark, tmp_path):
    df = records(spark, [("a", '{"x":1}'), ("b", '{"x":2}'), ("a", '{"x":3}')])
    path = f"{tmp_path}/wal"
    journal.write_ahead(df, path, 0)
    journal.write_ahead(df, path, 0)  # the same batch again
    log = journal.read_log(spark, path)
    assert {r.id for r in log.collect()} == {1, 2, 3} and log.count() == 3
    done = spark.createDataFrame([(1, [3])], "id long, ext_ids array<long>")
    assert {r.id for r in journal.committed_ids(done).collect()} == {1, 3}
    assert told(journal.replay(log, journal.committed_ids(done))) == {2: ("b", {"x": "2"})}
    assert journal.next_id(log) == 4 and journal.drop_replayed(log.unionByName(log)).count() == 3
    journal.drop_tag(spark, path, "a")
    assert journal.read_log(spark, path).count() == 1


def test_commit_barrier_and_throttle(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True)], "id long, ok boolean")
    assert {r.id: (r.n_sinks, r.committed) for r in journal.commit_barrier(df).collect()} == {1: (2, False), 2: (1, True)}
    t = spark.createDataFrame([(i, 0.1 * i) for i in range(25)], "id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    assert journal.throttle(t, "ts", "id", 3).count() == 9
    kept = journal.token_bucket(t.withColumn("k", F.lit(1)), "ts", "id", 2, 4, "k").count()
    assert 4 < kept < 12


def test_throttle_honours_burst(spark):
    doc = {"settings": {"acceptor_filters": {"is_throttle": True}}}
    spec = config.load(doc, "sit")
    rows = spark.range(5000).select(F.col("id"), F.timestamp_seconds(F.lit(100)).alias("_ingest_ts"), F.col("id").alias("_seq"), F.lit("a").alias("tag"))
    assert pipeline.before_concat(spec)(rows).count() == 5000  # the bucket holds 10,000
    rng = random.Random(1)
    seconds = sorted(rng.choices([*range(30), *range(60, 70)], k=400))
    t = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("k"))
    want = {r.id for r in journal.token_bucket(t, "ts", "id", 3, 25, "k").collect()}
    assert {r.id for r in journal.throttle_burst(t, "ts", "id", 3, 25).collect()} == want and 25 < len(want) < 400
    none = t.withColumn("ts", F.lit(None).cast("timestamp"))
    assert journal.throttle_burst(none.unionByName(t), "ts", "id", 3, 25).count() == 25 + len(want)


def test_whole_pipeline_throttle(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").limit(3000).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp").cast(spark.read.parquet("/root/testdata/sf0.01/events.parquet").schema["ts"].dataType))
    e.write.parquet(f"{tmp_path}/events.parquet")
    kept = sorted((r.event_id, r.event_type) for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect())[:1000]
    want = sum(t != "view" for _, t in kept)
    assert sum(r.n for r in catalog.QUERIES["whole_pipeline"](spark, str(tmp_path)).collect()) == want


DOC = {"settings": {
    "acceptor_filters": {"fork": 4, "plugins": {"default": {"remove_empty_tag": True}, "s": {"type": "spring", "rules": [{"new_tag": "cp.{env}", "regexp": "cp"}]}}},
    "acceptor": {"recvs": {"plugins": {"f": {"type": "fluentd", "active_env": ["sit"], "concat": {"app": {"msg_key": "log", "identifier": "container_id", "head_regexp": "^h"}}}, "k": {"type": "kafka", "active_env": ["prod"]}}}},
    "tag_filters": {"plugins": {"p": {"type": "parser", "tags": ["app.{env}"], "msg_key": "log", "pattern": "^h(?P<rest>.*)$", "append_time_zone": {"sit": "+0800"}, "add": {"app.{env}": {"env": "x"}}}}},
    "post_filters": {"plugins": {"f": {"type": "fields", "tags": ["app"], "exclude_fields": ["log"]}, "default": {"max_len": 100}}},
    "producer": {"plugins": {"m": {"type": "memory", "tags": ["app.{env}"]}, "x": {"type": "memory", "active_env": ["prod"]}}},
}}


def test_document_end_to_end(spark, tmp_path):
    with pytest.warns(UserWarning, match="ignored sizes"):
        spec = config.load(DOC, "sit", "h")
    assert set(spec.concat) == {"app.sit"} and [s.name for s in spec.sinks] == ["m"] and len(spec.receivers) == 1
    spec.journal_path = f"{tmp_path}/j"
    df = records(spark, [("app.sit", '{"log":"h1","container_id":"c"}', 0), ("app.sit", '{"log":" more","container_id":"c"}', 0), ("spring.sit", '{"log":"cp"}', 0), ("", "{}", 0)])
    assert pipeline.run_batch(df, spec).committed
    rows = spec.sinks[0].options["rows"]
    assert len(rows) == 1 and '"rest":"1 more"' in rows[0].message and '"env":"x"' in rows[0].message and '"msgid":"h-sit-1"' in rows[0].message and '"log"' not in rows[0].message
    assert pipeline.run_batch(df, spec, 1).committed and len(spec.sinks[0].options["rows"]) == 1  # committed ids are not sent again


def test_failed_sink_is_replayed(spark, tmp_path):
    spec = config.PipelineSpec("sit", sinks=[Sink("ok", "memory", ["a"]), Sink("bad", "stdout", ["a"], {"is_commit": False})], journal_path=f"{tmp_path}/j")
    df = records(spark, [("a", '{"x":1}')])
    assert not pipeline.run_batch(df, spec).committed
    spec.sinks.pop()
    assert pipeline.run_batch(df.limit(0), spec, 1).committed
    assert len(spec.sinks[0].options["rows"]) == 2  # sent to every sink again


def test_cli_repeated_lines_and_failed_runs(spark, tmp_path):
    """Lines equal to earlier ones are sent; what a failed run left is sent by the next."""
    line, out = '{"tag":"a.sit","log":"heartbeat"}\n', tmp_path / "out"
    (tmp_path / "in").mkdir()

    def ran(ok, *files):
        for f in files:
            (tmp_path / "in" / f).write_text(line * 2)
        sinks = {"m": {"type": "json", "tags": ["a.{env}"], "path": str(out)}} if ok else {"x": {"type": "stdout", "tags": ["a.{env}"], "is_commit": False}}
        (tmp_path / "c.yml").write_text(json.dumps({"settings": {"journal": {"buf_dir_path": f"{tmp_path}/j"}, "producer": {"plugins": sinks}}}))
        code = cli.main(["--config", f"{tmp_path}/c.yml", "--env", "sit", "--input", f"{tmp_path}/in"])
        return code, [json.loads(x)["id"] for p in out.glob("*.json") for x in p.read_text().splitlines()]

    assert len(ran(True, "1")[1]) == 2
    assert len(ran(True)[1]) == 2  # the same file again
    assert ran(False, "2")[0] == 1
    (tmp_path / "in" / "2").unlink()
    code, ids = ran(True, "3")
    assert code == 0 and len(ids) == len(set(ids)) == 6
    seqs = [r._seq for r in journal.read_log(spark, f"{tmp_path}/j/data").collect()]
    assert len(seqs) == len(set(seqs))


def test_unknown_types():
    for section, plugin in (("tag_filters", {"type": "no"}), ("post_filters", {"type": "no"}), ("producer", {"type": "no"}), ("acceptor_filters", {"type": "no"})):
        with pytest.raises(ValueError, match="unknown type"):
            config.load({section: {"plugins": {"p": plugin}}}, "sit")
    assert config.replace_env(["a.{env}", "b.{env}"], "sit") == ["a.sit", "b.sit"] and config.append_env(["a."], "sit") == ["a..sit"]
