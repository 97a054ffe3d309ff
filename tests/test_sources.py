"""Wire formats, receivers, sinks and the streaming run."""

import gzip
import hashlib
import http.server
import json
import threading
import time
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave import cli
from logweave.functions import maps
from logweave.operators import filters
from logweave.plans import config, pipeline
from logweave.sources import decoders, msgpack, readers, sinks
from logweave.streaming import metrics, run
from logweave.streaming.concat import stream_concat

VALUES = [None, True, False, 0, -1, 127, 128, -33, 1 << 40, -(1 << 40), (1 << 64) - 1, 1.5, "", "é" * 40, "x" * 70000, b"\x00\xff", [1, [2]], list(range(20)), {"a": {"b": [1, "x"]}}, {str(i): i for i in range(20)}]


@pytest.mark.parametrize("v", VALUES)
def test_msgpack_round_trip(v):
    raw = msgpack.pack(v)
    assert msgpack.unpack(raw) == (v, len(raw))
    for cut in range(min(len(raw), 20)):
        with pytest.raises(ValueError):
            msgpack.unpack(raw[:cut])


def test_forward_frames(spark):
    one, two = {"msg": "door open", "pod": "p7"}, {"msg": "door shut", "pod": "p7", "n": 3}
    single = msgpack.pack(["door.uat", [[1700000000, one]]])
    batch = msgpack.pack(["door.uat", [[1, one], [2, two], [3, two]]])
    packed = msgpack.pack(["door.uat", msgpack.pack([4, one]) + msgpack.pack([5, two])])
    plain = msgpack.pack([b"door.uat", 6, two, {"option": True}])
    bad = [msgpack.pack(["alone"]), msgpack.pack([7, [[0, one]]]), msgpack.pack(["t", [[0, [1]]]]), msgpack.pack({"no": "list"}), msgpack.pack(["t", [5]])]
    df = spark.createDataFrame([(single + b"".join(bad) + batch,), (packed + plain,), (b"\xc1",), (None,), (single[:-1],)], "body binary")
    out = decoders.stamp_tag(decoders.decode_forward(df), "from")
    rows = out.select("tag", F.transform_values("message", lambda _, v: maps.shown(v)).alias("m")).collect()
    assert len(rows) == 7 and {r.tag for r in rows} == {r.m.pop("from") for r in rows} == {"door.uat"}
    assert sorted(r.m["msg"] for r in rows) == ["door open"] * 3 + ["door shut"] * 4 and sum("n" in r.m for r in rows) == 4
    assert {r.tag for r in decoders.tag_from_field(out, "pod").collect()} == {"p7"} and decoders.tag_from_field(out, "n").count() == 0  # a number is no tag
    spark.dataSource.register(readers.FrameSource)
    assert spark.read.format("forward_frames").option("hex", ";".join(g.hex() for g in (single, batch, packed, plain))).load().count() == 7


def test_forward_memory(spark, monkeypatch):
    """Workers hand on a batch's records in parts, and in order."""
    df, steps = spark.createDataFrame([], "place long, note string, body binary"), []
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda d, run, *a: steps.append(run) or real(d, run, *a))
    decoders.decode_forward(df)
    decoders.encode_forward(spark.createDataFrame([], "tag string, message map<string,variant>"))
    decode, encode = steps
    bodies = [b"".join(msgpack.pack([f"t{a % 3}", [[0, {"id": i}] for i in range(a, a + 500)]]) for a in range(0, 5000, 500)), msgpack.pack(["u", [[0, {"id": i}] for i in range(500)]])]
    batch, seen = pa.record_batch([pa.array([7, 8]), pa.array(["short", "n" * 100_000]), pa.array(bodies, pa.binary())], ["place", "note", "body"]), []
    for out in decode([batch]):
        assert out.schema.names == ["place", "note", "tag", "json", "frame_no"] and 0 < out.num_rows <= 2000 and out.nbytes < 3 << 20
        assert all(len(n) == (5 if p == 7 else 100_000) for p, n in zip(out["place"].to_pylist(), out["note"].to_pylist(), strict=True))
        seen += zip(*(out[c].to_pylist() for c in ("place", "tag", "json", "frame_no")), strict=True)
    want = [(7, f"t{i // 500 * 500 % 3}", i) for i in range(5000)] + [(8, "u", i) for i in range(500)]
    assert [(p, t, json.loads(x)["id"], n) for p, t, x, n in seen] == [(p, t, i, i) for p, t, i in want]
    texts = [json.dumps({"id": i, "log": "x" * 50_000}) for i in range(600)]
    batch, seen = pa.record_batch([pa.array(["a", "b"] * 300), pa.array(texts)], ["tag", "m"]), []
    for out in encode([batch]):
        assert out.nbytes < 3 << 20
        seen += [(tag, record["id"], len(record["log"])) for raw in out["body"].to_pylist() for tag, record in decoders._frames(raw)]
    assert sorted(seen, key=lambda r: r[1]) == [("ab"[i % 2], i, 50_000) for i in range(600)]


def test_http_bodies(spark):
    salt, noon = "pepper&lime", "2031-07-09T12:00:00.000Z"
    signed = lambda at=noon, **more: json.dumps({"@timestamp": at, "sig": hashlib.md5((at + salt).encode()).hexdigest()} | more)
    cases = {
        "fine": (signed(car={"door": "left"}), "uat", None), "unknown environment": (signed(), "lab", "env"), "too long": (signed(fill="y" * 600), "uat", "size"), "a list": ("[2]", "uat", "json"), "no text": ("", "uat", "json"),
        "no time": ('{"sig":"x"}', "uat", "time key"), "time is a number": ('{"@timestamp":1}', "uat", "time key"), "other time": (signed("9 July"), "uat", "time format"), "unsigned": (json.dumps({"@timestamp": noon}), "uat", "no signature"),
        "signed by another": (json.dumps({"@timestamp": noon, "sig": hashlib.md5(noon.encode()).hexdigest()}), "uat", "signature"),
    }
    df = spark.createDataFrame([(b, e) for b, e, _ in cases.values()], "body string, env string")

    def at(now):
        return decoders.decode_http(df, tag="cars", orig_tag="app", env="prod", signature_salt=salt, max_body_byte=500, now=F.lit(now).cast("timestamp")).collect()

    got = at("2031-07-09 12:01:00")
    assert dict(zip(cases, [r.reject_reason for r in got], strict=True)) == {k: c[2] for k, c in cases.items()}
    assert got[0].tag == "cars.prod" and json.loads(str(got[0].message["tag"])) == "app.uat" and json.loads(str(got[0].message["car__door"])) == "left" and got[1].message is None
    for now, reason in (("2031-07-09 12:05:00", None), ("2031-07-09 12:05:01", "expired"), ("2031-07-09 11:59:00", None), ("2031-07-09 11:58:59", "from the future")):
        assert at(now)[0].reject_reason == reason


def test_receivers_of_a_document(spark, tmp_path):
    """All receivers of a document, from landed input, in one DataFrame; again in a stream."""
    recvs = {
        "f": {"type": "fluentd", "tag_key": "t"}, "r": {"type": "fluentd", "is_rewrite_tag_from_tag_key": True, "origin_rewrite_tag_key": "kind"},
        "h": {"type": "http", "tag": "web", "orig_tag": "app", "signature_salt": "s", "max_allowed_delay_sec": 1 << 40},
        "k": {"type": "kafka", "is_json_format": True, "tags": {"uat": "bus.uat"}, "add": {"bus.uat": {"seen": "%{@tag}"}}}, "s": {"type": "rsyslog", "tag": "box.{env}"},
    }
    spec = config.load({"settings": {"acceptor": {"recvs": {"plugins": recvs}}}}, "uat", "h")
    for d in ("f", "r", "h/uat", "k", "s"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "f/1").write_bytes(msgpack.pack(["a.uat", [[0, {"x": 1}], [0, {"x": 2}]]]))
    (tmp_path / "r/1").write_bytes(msgpack.pack(["a.uat", [[0, {"kind": "b.uat"}], [0, {}]]]))
    at = "2031-07-09T12:00:00.000Z"
    (tmp_path / "h/uat/1").write_text(json.dumps({"@timestamp": "2020-01-01T00:00:00.000Z", "sig": hashlib.md5(b"2020-01-01T00:00:00.000Zs").hexdigest()}) + "\n" + json.dumps({"@timestamp": at, "sig": "no"}) + "\n")
    (tmp_path / "k/1").write_text('{"y":1}\nno json\n')
    (tmp_path / "s/1").write_text("<13>Jul  9 12:00:00 host cron[1]: ran\n")
    paths = {n: str(tmp_path / n) for n in recvs} | {"h": f"{tmp_path}/h/*"}
    out = readers.landed_all(spark, spec, paths)
    told = lambda df: sorted((r.tag, json.loads(str(r.message.get("t") or r.message.get("tag"))), "seen" in r.message) for r in df.collect())
    want = [("a.uat", "a.uat", False)] * 2 + [("b.uat", "b.uat", False), ("box.uat", "box.uat", False), ("bus.uat", "bus.uat", True), ("web.uat", "app.uat", False)]
    assert told(out) == want and len({r.id for r in out.collect()}) == 6
    seqs = [r._seq for r in readers.landed(spark, spec.receivers[0], paths["f"], "uat", first=5).collect()]
    assert sorted(seqs) == [5, 6]
    with pytest.raises(ValueError, match="no receivers named"):
        readers.landed_all(spark, spec, {"other": "x"})
    q = readers.landed_all(spark, spec, paths, stream=True).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and told(spark.read.parquet(f"{tmp_path}/out")) == want


def test_kafka_and_syslog(spark):
    df = spark.createDataFrame([(b'{"t":"x.sit","a":1}',), (b"bad",), (b'{"t":5}',), (b'{"a":2}',)], "value binary")
    got = decoders.decode_kafka(df, tag="d", json_tag_key="t", rewrite_tag="r").select("tag", maps.text(F.col("message"), "tag").alias("t")).collect()
    assert [(r.tag, r.t) for r in got] == [("r", "x.sit"), ("r", "d")]
    raw = decoders.decode_kafka(df, tag="d", is_json_format=False).select(maps.text(F.col("message"), "log").alias("l")).collect()
    assert [r.l for r in raw][1] == "bad"
    lines = ["<34>Oct  1 22:14:15 host su[12]: it failed: x", "<165>1 2003-10-11T22:14:15.003Z host app 7 ID47 [a b=\"c\"] hello", "nothing"]
    out = decoders.decode_syslog(spark.createDataFrame([(x,) for x in lines], "line string"), tag="log.sit", year=2024, rewrite_tags={"tag": "origin_tag"})
    m = [r.m for r in out.select(F.transform_values("message", lambda _, v: maps.shown(v)).alias("m")).collect()]
    assert m[0]["message"] == "it failed: x" and m[0]["origin_tag"] == "su" and m[0]["@timestamp"] == "2024-10-01T22:14:15.000Z" and m[0]["severity"] == "2" and m[0]["tag"] == "log.sit"
    assert m[1]["message"] == "hello" and m[1]["app_name"] == "app" and m[1]["@timestamp"] == "2003-10-11T22:14:15.003Z" and len(m) == 2


def test_bulk_over_http(spark):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(gzip.decompress(self.rfile.read(int(self.headers["Content-Length"]))).decode())
            self.send_response(200 if len(got) > 1 else 503)  # the first try fails
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a", '{"x":1}', 1), ("a", '{"tag":"none"}', 2)], "tag string, j string, id long").withColumn("message", maps.from_json(F.col("j")))
    sinks.write(df.coalesce(1), sinks.Sink("es", "es", ["a"], {"addr": f"http://127.0.0.1:{server.server_port}/_bulk", "indices": {"a": "i"}}))
    server.shutdown()
    assert got[-1] == '{"index": {"_index": "i", "_type": "logs"}}\n{"x":1}\n' and len(got) == 2


def test_stream_concat_equals_batch(spark, tmp_path):
    rows = [("t", "c", 0, "h1", True, 0.0), ("t", "c", 1, "a", False, 0.5), ("t", "c", 2, "h2", True, 1.0), ("t", "c", 3, "late", False, 9.0), ("t", "c", 4, "h3", True, 9.5)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "tag string, identifier string, _seq long, text string, head boolean, ts double").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema("tag string, identifier string, _seq long, text string, head boolean, ts double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    q = stream_concat(src, wait_sec=3.0).writeStream.format("memory").queryName("stitched").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r._seq, r.text) for r in spark.table("stitched").collect()}
    assert {(0, "h1a"), (2, "h2"), (3, "late")} <= got  # the last head may still be pending


def test_streaming_fan_out(spark, tmp_path):
    doc = {"settings": {"acceptor_filters": {"plugins": {"default": {"remove_empty_tag": True}}}, "producer": {"plugins": {"m": {"type": "parquet", "tags": ["a.{env}"], "path": f"{tmp_path}/out"}}}}}
    spec = config.load(doc, "sit", "h")
    spec.journal_path = f"{tmp_path}/j"
    spark.createDataFrame([("a.sit", '{"x":1}', 1), ("", "{}", 2)], "tag string, j string, id long").write.json(f"{tmp_path}/in")
    src = spark.readStream.schema("tag string, j string, id long").json(f"{tmp_path}/in")
    src = src.select("tag", maps.from_json(F.col("j")).alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), F.col("id").alias("_seq"), F.current_timestamp().alias("_ingest_ts"))
    reg = metrics.Registry()
    reg.add("two", lambda: 2)
    q = run.start(metrics.observe(src, "acceptor", ("a.sit",)), spec, f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert q.exception() is None and [json.loads(r.message)["msgid"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["h-sit-1"]
    assert json.loads(reg.to_json()) == {"two": 2}


def test_streaming_concat_passes_other_records(spark, tmp_path):
    doc = {"settings": {"acceptor": {"recvs": {"plugins": {"f": {"type": "fluentd", "concat": {"a": {"msg_key": "log", "identifier": "c", "head_regexp": "^h"}}}}}}, "producer": {"plugins": {"m": {"type": "parquet", "tags": ["a.{env}", "b.{env}"], "path": f"{tmp_path}/out"}}}}}
    spec = config.load(doc, "sit", "h")
    lines = [("a.sit", '{"log":"h1","c":"x"}'), ("a.sit", '{"log":" more","c":"x"}'), ("a.sit", '{"log":"h2","c":"x"}'), ("a.sit", '{"log":"no identifier"}'), ("a.sit", '{"c":"no text"}'), ("b.sit", '{"log":"h of another tag","c":"x"}')]
    spark.createDataFrame([(t, j, i + 1) for i, (t, j) in enumerate(lines)], "tag string, j string, id long").coalesce(1).write.json(f"{tmp_path}/in")
    src = spark.readStream.schema("tag string, j string, id long").json(f"{tmp_path}/in")
    src = src.select("tag", maps.from_json(F.col("j")).alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), F.col("id").alias("_seq"), F.current_timestamp().alias("_ingest_ts"))
    spec.journal_path = f"{tmp_path}/j"
    want = {"h-sit-1": ("h1 more", "x"), "h-sit-3": ("h2", "x"), "h-sit-4": ("no identifier", None), "h-sit-5": (None, "no text"), "h-sit-6": ("h of another tag", "x")}
    q = run.start(src, spec, f"{tmp_path}/ck")
    assert q.awaitTermination(120) and q.exception() is None  # it ends by itself, once the last head has waited
    sent = lambda: {m["msgid"]: (m.get("log"), m.get("c")) for m in (json.loads(r.message) for r in spark.read.parquet(f"{tmp_path}/out").collect())}
    assert sent() == want
    batch = config.load(doc, "sit", "h")
    batch.sinks[0].options["path"] = f"{tmp_path}/batch"
    read = spark.read.schema("tag string, j string, id long").json(f"{tmp_path}/in")
    read = read.select("tag", maps.from_json(F.col("j")).alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), F.col("id").alias("_seq"), F.current_timestamp().alias("_ingest_ts"))
    assert pipeline.run_batch(read, batch).committed
    assert {m["msgid"]: (m.get("log"), m.get("c")) for m in (json.loads(r.message) for r in spark.read.parquet(f"{tmp_path}/batch").collect())} == want
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/j/ids").collect()} == {1, 2, 3, 4, 5, 6} and pipeline.uncommitted(spark, spec) is None


def test_stream_sends_what_was_left(spark, tmp_path):
    """A batch that a sink refuses stays in the log; a stream with a new checkpoint sends it first."""
    doc = {"settings": {"producer": {"plugins": {"m": {"type": "stdout", "tags": ["a.{env}"], "is_commit": False}}}, "tag_filters": {"plugins": {"p": {"type": "parser", "tags": ["a.{env}"], "msg_key": "log", "pattern": "^h(?P<rest>.*)$"}}}}}
    spec = config.load(doc, "sit", "h")
    spec.journal_path = f"{tmp_path}/j"

    def source(name, *lines):
        spark.createDataFrame([("a.sit", json.dumps({"log": t}), i) for i, t in lines], "tag string, j string, id long").write.json(f"{tmp_path}/{name}")
        src = spark.readStream.schema("tag string, j string, id long").json(f"{tmp_path}/{name}")
        return src.select("tag", maps.from_json(F.col("j")).alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), F.col("id").alias("_seq"), F.current_timestamp().alias("_ingest_ts"))

    q = run.start(source("one", (1, "h-one")), spec, f"{tmp_path}/ck1")
    with pytest.raises(Exception, match="not committed"):
        q.awaitTermination(60)
    assert pipeline.uncommitted(spark, spec).count() == 1  # as it was before parsing
    spec.sinks = [sinks.Sink("m", "parquet", ["a.sit"], {"path": f"{tmp_path}/out"})]
    q = run.start(source("two", (2, "h-two"), (3, "no match")), spec, f"{tmp_path}/ck2")
    assert q.awaitTermination(60) and sorted(json.loads(r.message)["rest"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["-one", "-two"]
    assert pipeline.uncommitted(spark, spec) is None


def test_registered_plugins(spark):
    seen = []

    @filters.register("only-odd")
    def only_odd(key):
        return lambda df: df.where(maps.text(F.col("message"), key).cast("long") % 2 == 1)

    @sinks.register("list")
    def to_list(df, sink):
        seen.extend(r.id for r in df.collect())

    doc = {"acceptor_filters": {"plugins": {"o": {"type": "only-odd", "key": "x"}}}, "producer": {"plugins": {"l": {"type": "list", "tags": ["a.{env}"]}}}}
    rows = spark.createDataFrame([("a.sit", f'{{"x":{i}}}', i) for i in range(6)], "tag string, j string, id long")
    rows = rows.select("tag", maps.from_json(F.col("j")).alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), F.col("id").alias("_seq"), F.current_timestamp().alias("_ingest_ts"))
    assert pipeline.run_batch(rows, config.load(doc, "sit")).committed and sorted(seen) == [1, 3, 5]


def test_stream_from_the_cli_and_its_metrics(spark, tmp_path, monkeypatch):
    """Landed lines go through a stream; a registry counts its stages and answers over HTTP."""
    recvs = {"k": {"type": "kafka", "is_json_format": True, "tags": {"sit": "a.sit"}}}
    doc = {"settings": {"acceptor": {"recvs": {"plugins": recvs}}, "producer": {"plugins": {"m": {"type": "parquet", "tags": ["a.{env}"], "path": f"{tmp_path}/out"}}}}}
    (tmp_path / "c.yml").write_text(json.dumps(doc))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text('{"x":1}\n{"x":2}\n')
    kept, made = [], metrics.Registry
    monkeypatch.setattr(metrics, "Registry", lambda: kept.append(made()) or kept[0])
    argv = ["--config", f"{tmp_path}/c.yml", "--env", "sit", "--landed", f"k={tmp_path}/in", "--checkpoint", f"{tmp_path}/ck", "--addr", "127.0.0.1:0"]
    assert cli.main(argv) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    reg = kept[0]
    reg.add("seven", lambda: 7)
    server = metrics.serve(reg, "127.0.0.1:0")
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=10).read().decode()
    try:
        assert get("/health") == "ok"
        for _ in range(100):  # the listener hears of a batch some time after it
            if "accepted" not in json.loads(get("/monitor")):
                time.sleep(0.1)
        assert json.loads(get("/monitor"))["accepted"] == {"n": 2, "n:a.sit": 2}
        lines = get("/metrics").splitlines()
        assert 'logweave_rows_total{stage="accepted"} 2' in lines and 'logweave_tag_rows_total{stage="accepted",tag="a.sit"} 2' in lines
        assert 'logweave_value{name="seven"} 7' in lines
        with pytest.raises(urllib.error.HTTPError):
            get("/other")
    finally:
        spark.streams.removeListener(reg)
        server.shutdown()
        server.server_close()


def test_heartbeat(caplog):
    with caplog.at_level("INFO", "logweave"):
        reg, seen = metrics.Registry(), threading.Event()
        reg.add("beat", lambda: seen.set() or 3)
        stop = metrics.heartbeat(reg, 0.01)
        assert seen.wait(10)
        stop()
