"""Operators against brute force, and the edge rows that the tables do not hold."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relayspark.client import Client
from relayspark.functions import codecs
from relayspark.operators import dispatch, liveness, neighbours, pipeline, queueing, registry, sendlog
from relayspark.sources import tables, wire
from relayspark.streaming import keyed

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SF_DIR = "/root/testdata/sf0.001"


def beats(spark, rows):
    """(worker, sent_at, arrival second)"""
    start = datetime(2024, 1, 1)
    data = [(w, s, "S", str(s), "0", "0", start + timedelta(seconds=a), i) for i, (w, s, a) in enumerate(rows)]
    return spark.createDataFrame(data, "worker string, sent_at long, service string, port string, x string, y string, arrived_at timestamp_ntz, arrival long")


def test_upsert_is_by_arrival_unless_event_time_is_asked_for(spark):
    rows = beats(spark, [("a", 10, 0), ("a", 5, 1)])
    assert registry.latest(rows).first().sent_at == 5
    assert registry.latest(rows, "event_time").first().sent_at == 10


def test_expiry_is_strict(spark):
    rows = registry.latest(beats(spark, [("a", 0, 0), ("b", 1, 0)]))
    assert [r.worker for r in liveness.survivors(rows, 101, 100).collect()] == ["b"]
    assert liveness.live(rows, 100, 100).count() == 2


@QUICK
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 400)), min_size=1, max_size=30, unique=True))
def test_evictions_equal_a_sweep(spark, rows):
    timeout, start, until = 40, 0, 600
    rows = sorted((s, w) for w, s in rows)
    held, dead = {}, []
    for now in range(start, until + 1):
        if (now - start) % (timeout // 2) == 0:
            for w in [w for w, s in held.items() if now - s > timeout]:
                dead.append((w, held.pop(w), now))
        for s, w in rows:
            if s == now:
                held[w] = s
    got = liveness.evictions(beats(spark, [(w, s, s) for s, w in rows]), timeout, start, until).collect()
    assert sorted(map(tuple, got)) == sorted(dead)


@QUICK
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50)), min_size=1, max_size=30))
def test_completions_equal_a_server(spark, arrivals):
    rows = [(w, float(t), i) for i, (w, t) in enumerate(arrivals)]
    free, want = {}, {}
    for w, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        free[w] = want[i] = max(t, free.get(w, t)) + 3.0
    got = queueing.completions(spark.createDataFrame(rows, "worker string, arrived double, id long"), 3.0)
    assert {r.id: r.done for r in got.collect()} == want


def test_simulation_serves_cycles_in_order(spark):
    rows = [("m", 1, 0.0, ["a", "b", "a"]), ("m", 2, 0.0, ["a"]), ("m", 3, 0.1, []), ("n", 4, 0.0, ["a"])]
    got = queueing.simulate(spark.createDataFrame(rows, "mesh string, task_id long, time double, pipeline array<string>"), 0.5)
    done = {(r.mesh, r.task_id, r.hop): r.done for r in got.collect()}
    assert done == {("m", 1, 0): 0.5, ("m", 2, 0): 1.0, ("m", 1, 1): 1.0, ("m", 1, 2): 1.5, ("n", 4, 0): 0.5}


def test_simulation_of_one_worker_is_the_window_form(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.random() * 20, 3)) for i in range(60)]
    made = spark.createDataFrame([("m", i, t, ["w"]) for i, t in rows], "mesh string, task_id long, time double, pipeline array<string>")
    window = queueing.completions(spark.createDataFrame([("w", t, i) for i, t in rows], "worker string, arrived double, id long"), 0.5)
    a = {r.task_id: round(r.done, 6) for r in queueing.simulate(made, 0.5).collect()}
    assert a == {r.id: round(r.done, 6) for r in window.collect()}


def messages(spark, *rows):
    return spark.createDataFrame([([None if f is None else f.encode() for f in r],) for r in rows], "frames array<binary>")


@pytest.mark.parametrize(
    "channel, kind, handler",
    [
        ("router", "PING", "ping"), ("router", "", "error"), ("router", "_x", "error"), ("router", "zap", "unhandled"),
        ("dealer", "PING", "ping"), ("dealer", "_x", "raise"), ("pull", "ping", "ping"), ("pull", "PING", "error"),
        ("pull", "_x", "raise"), ("pub", "zap", "error"), ("logger", "ping", "ping"),
    ],
)
def test_dispatch_rules(spark, channel, kind, handler):
    row = dispatch.dispatch(messages(spark, ["me", kind, "data"]), ["ping"], channel, 1).first()
    assert row.handler == handler
    assert len(row.args) == (3 if channel == "dealer" else 2)
    assert (row.problem is None) == (handler == "ping")


def test_dispatch_by_envelope_and_from_the_end(spark):
    row = dispatch.dispatch(messages(spark, ["me", '["ping", "body"]']), ["ping"], "request", -1).first()
    assert row.handler == "ping" and [bytes(a) for a in row.args] == [b"me", b"body"]


def test_handlers_are_a_whitelist(spark):
    on = dispatch.Handlers()

    @on.on("ping")
    def ping(rows):
        return rows.select(F.lit("Pong").alias("reply"))

    results = on.run(messages(spark, ["a", "ping"], ["a", "stop"]))
    assert results["ping"].count() == 1 and results["rejects"].count() == 1
    with pytest.raises(ValueError):
        on.on("_hidden")


def test_tasks_for_others_and_empty_ones_are_rejects(spark):
    rows = spark.createDataFrame([(1, 0.0, ["a", "b"]), (2, 0.0, ["b"]), (3, 0.0, [])], "task_id long, time double, pipeline array<string>")
    assert [r.task_id for r in pipeline.accepted(rows, "a").collect()] == [1]
    assert sorted(r.task_id for r in pipeline.misrouted(rows, "a").collect()) == [2, 3]
    one = {r.task_id: r for r in pipeline.step(rows).collect()}
    assert one[1].next_worker == "b" and one[2].remaining == 0 and one[3].worker is None
    assert pipeline.replies(rows).count() == 2


def test_unknown_next_worker_is_a_reject(spark):
    rows = pipeline.hops(spark.createDataFrame([(1, 0.0, ["a", "b", "c"])], "task_id long, time double, pipeline array<string>"))
    ports = spark.createDataFrame([("b", "1")], "worker string, port string")
    assert [r.next_worker for r in pipeline.unroutable(rows, ports).collect()] == ["c"]
    assert [r.address for r in pipeline.next_addresses(rows, ports).orderBy("hop").collect()] == ["tcp://b:1", None, None]


def test_peers_leave_out_the_worker_itself(spark):
    reg = registry.latest(beats(spark, [("a", 1, 0)]))
    assert neighbours.peers_of(reg, "a").count() == 0


def test_codecs(spark):
    row = spark.range(1).select(
        codecs.zero_filled(F.lit("12345")).alias("z"), codecs.encode(F.lit("é")).alias("e"), codecs.encode(F.lit("ok")).alias("ok"),
        codecs.address(F.lit("h:1")).alias("a"), codecs.address(F.lit("h")).alias("b"),
        codecs.epoch_seconds(F.lit("1970-01-01 00:00:00.5").cast("timestamp_ntz")).alias("half"),
        codecs.epoch_seconds(F.lit("1970-01-01 00:00:01.5").cast("timestamp_ntz")).alias("more"),
    ).first()
    assert (row.z, row.e, bytes(row.ok), row.a.port, row.b.port, row.half, row.more) == ("12345", None, b"ok", 1, None, 0, 2)


def test_send_log_forms(spark):
    rows = messages(spark, ["r", "t", "i", "é", "x"], ["a", "b"]).withColumn("time_ms", F.lit(7))
    assert sorted(r.value for r in sendlog.lines(sendlog.entries(rows)).collect()) == ["[b'a', b'b'],7,2", "r,t,i,7,6"]


def test_missing_table_is_named(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.table(spark, "/nowhere", "events")


def test_stream_evictions_do_not_depend_on_batches(spark, tmp_path):
    events = tables.table(spark, SF_DIR, "events")
    for k in range(5):  # one after another: a file stream follows the time of writing
        events.where(F.floor(F.col("event_id") / 200) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = keyed.run_to_end(keyed.eviction_stream(keyed.heartbeat_stream(spark, SF_DIR), 86_400), "a")
    parts = keyed.run_to_end(keyed.eviction_stream(keyed.heartbeat_stream(spark, str(tmp_path)), 86_400, "3650 days"), "b")
    a, b = (sorted(map(tuple, x.collect())) for x in (whole, parts))
    tails = {w: max(s for k, s in a if k == w) for w, _ in a}
    # Without an advancing watermark no timer fires; every gap inside the stream is found all the same.
    assert set(b) <= set(a) and all(tails[w] == s for w, s in set(a) - set(b))


def test_client_answers(spark):
    client = Client(spark, SF_DIR)
    assert client.services().first().payload.startswith('{"Worker-0000"')
    assert client.neighbours("Worker-0000").count() == client.neighbours("Worker-0000", ever=True).count()
    assert client.run_pipeline().count() > 0 and client.graph_node_count().first().nodes > 0




def test_wire_trims_quotes_and_takes_numbers(spark):
    payload = '{"sentAt": 5, "service": "\'DEMO\'", "port": 6001, "x": 1, "y": 2, "more": 1}'
    rows = messages(spark, ["heartbeat", "Worker-0001", payload], ["heartbeat", "Worker-0002", "{"], ["other", "x", "{}"])
    got = {r.worker: r for r in wire.heartbeats_of(rows).collect()}
    assert set(got) == {"Worker-0001", "Worker-0002"} and got["Worker-0002"].port is None
    assert (got["Worker-0001"].service, got["Worker-0001"].port, got["Worker-0001"].x) == ("DEMO", "6001", "1")


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("a,1",)], "value string")
    for _ in range(2):
        wire.append_text(lines, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 2
    assert [r.value for r in sendlog.with_header(lines).collect()] == [sendlog.HEADER, "a,1"]
    wire.truncate(lines, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0
