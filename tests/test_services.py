"""Programs, streams that go on, and the operators that the tables exercise little."""

import random
import time

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relayspark import service
from relayspark.client import Client
from relayspark.functions import codecs
from relayspark.operators import dispatch, meshes, queueing, registry
from relayspark.sources.tables import Settings
from relayspark.streaming import keyed
from tests.test_operators import SF_DIR, beats


def test_fields_that_are_not_sent_stay(spark):
    rows = beats(spark, [("a", 10, 0), ("a", 5, 1), ("b", 7, 0)])
    rows = rows.withColumn("port", F.when(F.col("arrival") != 1, F.col("port")))
    got = {r.worker: (r.sent_at, r.port) for r in registry.merged(rows).collect()}
    assert got == {"a": (5, "10"), "b": (7, "7")}
    late = beats(spark, [("a", 99, 5)]).withColumn("port", F.lit(None).cast("string"))
    after = {r.worker: (r.sent_at, r.port) for r in registry.upsert(registry.merged(rows), late).collect()}
    assert after == {"a": (99, "10"), "b": (7, "7")}
    assert registry.merged(rows.where("false")).count() == 0


def test_bytes_and_floats_as_text(spark):
    rng = random.Random(1)
    frames = [b"", b"plain", b"it's", b'say "x"', b"'\"", b"\\ \n\r\t\x00\x7f\xff", *(bytes(rng.randrange(256) for _ in range(20)) for _ in range(50))]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(frames)], "i int, x binary")
    assert [r.t for r in rows.orderBy("i").select(codecs.bytes_text(F.col("x")).alias("t")).collect()] == [repr(x) for x in frames]
    numbers = [0.0, -0.0, 1.0, 3.5, 1700000000.25, -12345678.9, 1e15, 123456789012345680.0, 1e16, 1.5e300, 0.0001, 0.00001234, 1e7, 0.1, 100.0, float("inf"), float("nan"), *(rng.uniform(-1e9, 1e9) for _ in range(100)), *(10 ** rng.uniform(-4, 15) for _ in range(100))]
    rows = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    assert [r.t for r in rows.orderBy("i").select(codecs.float_text(F.col("x")).alias("t")).collect()] == [str(x) for x in numbers]


def test_strict_forms_raise(spark):
    messages = spark.createDataFrame([([bytearray(b"s"), bytearray(b"_x")],), ([bytearray(b"s"), bytearray(b"ok")],)], "frames array<binary>")
    routed = dispatch.dispatch(messages, ["ok"], "dealer")
    assert sorted(r.handler for r in routed.collect()) == ["ok", "raise"]
    with pytest.raises(PySparkException, match='starts with an "_"'):
        dispatch.strict(routed).collect()
    assert dispatch.strict(routed.where("handler = 'ok'")).count() == 1
    fields = spark.sql("SELECT map('port', '1') AS m")
    assert fields.select(codecs.field(F.col("m"), "port", True).alias("v"), codecs.field(F.col("m"), "x").alias("n")).first() == ("1", None)
    with pytest.raises(PySparkException, match="no field x"):
        fields.select(codecs.field(F.col("m"), "x", True)).collect()


def test_replies_go_to_the_request_they_are_for(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "sender string, request_id long")
    answers = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("c", 9, "z")], "sender string, request_id long, reply string")
    assert sorted(map(tuple, dispatch.reply(asked, answers).collect())) == [("a", 1, "x"), ("a", 2, "y")]
    assert [r.reply for r in Client(spark, SF_DIR).ping(asked).collect()] == ["Pong"] * 3
    snapshot, replies = Client(spark, SF_DIR).reintroduce(asked)
    assert snapshot.columns == ["worker", "port"] and {r.reply for r in replies.collect()} == {"Done reintroducing..."}


def test_pops_take_the_oldest_task(spark):
    rng = random.Random(2)
    rows = [(w, float(rng.randint(0, 30)), i, rng.choice([1, -1])) for i, w in enumerate("aabbc" * 30)]
    held, want = {}, []
    for w, _, i, change in sorted(rows, key=lambda r: (r[1], r[2])):
        if change > 0:
            held.setdefault(w, []).append(i)
        elif held.get(w):
            want.append((w, i, held[w].pop(0)))
    got = queueing.pops(spark.createDataFrame(rows, "worker string, arrived double, id long, change int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tasks_that_share_workers_are_one_mesh(spark):
    rows = [(1, 0.0, ["a", "b"]), (2, 0.0, ["c", "b"]), (3, 0.0, ["d"]), (4, 0.0, []), (5, 0.0, ["e", "d"]), (6, 0.0, [f"w{i:02d}" for i in range(12)])]
    rows += [(10 + i, 0.0, [f"x{i:02d}", f"x{i + 1:02d}"]) for i in range(20)]
    tasks = spark.createDataFrame(rows, "task_id long, time double, pipeline array<string>")
    got = {r.task_id: r.mesh for r in meshes.connected(tasks).collect()}
    assert got == {1: "a", 2: "a", 3: "d", 4: None, 5: "d", 6: "w00"} | {10 + i: "x00" for i in range(20)}
    assert meshes.connected(tasks.where("false")).count() == 0
    # Tasks that start elsewhere wait for a worker that they share.
    done = {(r.task_id, r.worker): r.done for r in Client(spark, SF_DIR).run_pipeline(tasks.where("task_id < 3")).collect()}
    assert done[1, "b"] == 1.0 and done[2, "b"] == 1.5


def _events(path, first, n):
    start = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame({
        "event_id": range(first, first + n), "ts": [start + pd.Timedelta(seconds=i) for i in range(first, first + n)],
        "user_id": [i % 3 for i in range(n)], "event_type": ["click", "nope"] * (n // 2) + ["click"] * (n % 2), "value": [0.5] * n, "props": ["{}"] * n,
    })
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame.to_parquet(path)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(2):
        _events(folder / f"part-{k}.parquet", 10 * k, 10)
        stream = keyed.request_stream(spark, str(tmp_path)).select("event_id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(10 * k + 10))


def test_queue_batches_are_served_one_after_the_other(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(3):
        _events(folder / f"part-{k}.parquet", 10 * k, 10)
        time.sleep(0.05)
    arrivals = keyed.heartbeat_stream(spark, str(tmp_path)).select("worker", F.col("sent_at").cast("double").alias("arrived"), F.col("arrival").alias("id"))
    got = {r.id: r.done for r in keyed.run_to_end(keyed.queue_stream(arrivals, 5.0), "queue").collect()}
    rows = spark.createDataFrame([(f"Worker-{(i % 10) % 3:04d}", 1704067200.0 + i, i) for i in range(30)], "worker string, arrived double, id long")
    assert got == {r.id: r.done for r in queueing.completions(rows, 5.0).collect()}


def test_a_broker_keeps_the_registry_and_sweeps(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    _events(folder / "part-0.parquet", 0, 10)
    now = 1704067200 + 100
    broker = service.Broker(spark, str(tmp_path), Settings(timeout=0.5), str(tmp_path / "broker"), clock=lambda: now).start()
    end = time.monotonic() + 60
    try:
        while time.monotonic() < end and not (tmp_path / "broker" / "dead").exists():
            time.sleep(0.2)
        _events(folder / "part-1.parquet", 10, 10)
        while time.monotonic() < end and (not keyed.epochs(spark, f"{broker.folder}/registry") or broker.registry().agg(F.max("sent_at")).first()[0] < 1704067200 + 19):
            time.sleep(0.2)
        assert {r.worker for r in broker.registry().collect()} == {"Worker-0000", "Worker-0001", "Worker-0002"}
        assert broker.broadcast().columns == ["worker", "port"]
    finally:
        broker.stop()
    assert {r.worker for r in broker.table("dead").collect()} == {"Worker-0000", "Worker-0001", "Worker-0002"}
    assert broker.table("routed").where("handler = 'unhandled'").count() > 0
    assert len(keyed.epochs(spark, f"{broker.folder}/registry")) <= 2


def test_a_worker_runs_for_a_while(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    _events(folder / "part-0.parquet", 0, 10)
    worker = service.Worker(spark, str(tmp_path), Settings(timeout=0.5), str(tmp_path / "worker")).start()
    worker.run(10)
    assert worker.table("served").count() == 10 and not worker.running
    assert service.main([]) == 2


def test_settings_come_from_the_environment(monkeypatch):
    for name, value in {"TIMEOUT": "30", "FRONTEND_PORT": "1", "BACKEND_PORT": "2", "HEARTBEAT_PORT": "3", "SERVICE": "'DEMO'"}.items():
        monkeypatch.setenv(name, value)
    made = Settings()
    assert (made.tick, made.frontend_port, made.backend_port, made.heartbeat_port, made.service) == (15.0, 1, 2, 3, "DEMO")


def test_ignored_types_are_no_rejects(spark):
    frame = lambda kind: ([bytearray(b"s"), bytearray(kind)],)
    messages = spark.createDataFrame([frame(b"heartbeat"), frame(b"nope")], "frames array<binary>")
    handlers = dispatch.Handlers()
    handlers.ignore("heartbeat", "send_heartbeat")
    got = handlers.run(messages)
    assert got["heartbeat"].count() == 0 and [r.msg_type for r in got["rejects"].collect()] == ["nope"]


def test_messages_of_a_recipient_meet(spark):
    rows = spark.range(200).select(F.concat(F.lit("w"), F.col("id") % 7).alias("recipient"))
    seen = dispatch.exchange(rows).select("recipient", F.spark_partition_id().alias("p")).distinct().groupBy("recipient").count().collect()
    assert len(seen) == 7 and all(r["count"] == 1 for r in seen)


def test_a_hook_hears_of_each_batch(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    _events(folder / "part-0.parquet", 0, 10)
    heard = []
    hook = keyed.SendHook(heard.append)
    spark.streams.addListener(hook)
    try:
        keyed.run_to_end(keyed.request_stream(spark, str(tmp_path)).select("event_id"), "hooked")
        end = time.monotonic() + 20
        while not heard and time.monotonic() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(hook)
    assert [rows for _, _, rows in heard] == [10]
