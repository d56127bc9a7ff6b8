"""The registered queries over the service mesh's tables, each with SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.functions import codecs
from relayspark.operators import dispatch, graph, liveness, neighbours, pipeline, queueing, registry, sendlog
from relayspark.sources import tables, wire
from relayspark.streaming import keyed

#: Parameters of the queries: seconds, and names that the tables hold.
TIMEOUT = 86_400
LIVE_TIMEOUT = 7_200
LONG_GAP = 216_000
SERVICE = 3_600
WORKER = "Worker-0007"
HANDLERS = ["click", "view", "purchase"]
START, UNTIL = 1_704_067_200, 1_706_659_200  # 2024-01-01 and 2024-01-31

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Heartbeats in SQL: what the adapter gives.
_BEATS = """
    beats AS (
        SELECT 'Worker-' || (CASE WHEN len(user_id::VARCHAR) >= 4 THEN user_id::VARCHAR ELSE lpad(user_id::VARCHAR, 4, '0') END) AS worker,
            round_even(epoch_us(ts) / 1e6, 0)::BIGINT AS sent_at, event_type AS service,
            (6000 + user_id)::VARCHAR AS port, (user_id % 25)::VARCHAR AS x, (user_id // 25)::VARCHAR AS y, ts, event_id
        FROM events),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS rn FROM beats),
    registry AS (SELECT worker, sent_at, service, port, x, y FROM ranked WHERE rn = 1)
"""
_TASKS = """
    tasks AS (SELECT conv_id AS task_id, list(role ORDER BY turn, role) AS pipeline FROM conversations GROUP BY conv_id),
    hops AS (
        SELECT task_id, unnest(pipeline) AS worker, unnest(range(len(pipeline))) AS hop, len(pipeline) AS n, pipeline FROM tasks)
"""


def query(oracle: str | None = None):
    """Register a query under its name, with its SQL."""

    def put(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if oracle:
            ORACLES[build.__name__] = oracle
        return build

    return put


@query(f"WITH {_BEATS} SELECT worker, sent_at, service, port, x, y FROM registry")
def registry_latest(spark, sf_dir):
    return registry.latest(tables.heartbeats(spark, sf_dir))


@query("SELECT s_suppkey, s_name FROM supplier WHERE starts_with(s_name, 'Supplier#00000')")
def registry_prefix_scan(spark, sf_dir):
    return registry.prefix_scan(tables.table(spark, sf_dir, "supplier"), "s_name", "Supplier#00000").select("s_suppkey", "s_name")


@query(f"WITH {_BEATS} SELECT worker, sent_at, service, port, x, y FROM registry WHERE worker = '{WORKER}'")
def registry_lookup(spark, sf_dir):
    return registry.lookup(registry.latest(tables.heartbeats(spark, sf_dir)), WORKER)


@query(f"WITH {_BEATS} SELECT worker, sent_at FROM registry WHERE NOT ({UNTIL} - 86400 - sent_at > {LIVE_TIMEOUT})")
def registry_live(spark, sf_dir):
    now = UNTIL - 86_400
    return liveness.live(registry.latest(tables.heartbeats(spark, sf_dir)), now, LIVE_TIMEOUT).select("worker", "sent_at")


@query(f"""WITH {_BEATS} SELECT '{{' || string_agg('"' || worker || '":{{"sentAt":"' || sent_at || '","service":"' || service
    || '","port":"' || port || '","x":"' || x || '","y":"' || y || '"}}', ',' ORDER BY worker) || '}}' AS payload FROM registry""")
def registry_payload_json(spark, sf_dir):
    return registry.payload_json(registry.latest(tables.heartbeats(spark, sf_dir)))


@query(f"""WITH {_BEATS}, ahead AS (
    SELECT worker, sent_at, lead(sent_at) OVER (PARTITION BY worker ORDER BY sent_at, event_id) AS next_at,
        {START} + ((sent_at + {TIMEOUT} - {START}) // {TIMEOUT // 2} + 1) * {TIMEOUT // 2} AS evicted_at FROM beats)
    SELECT worker, sent_at, evicted_at FROM ahead WHERE (next_at IS NULL OR next_at > evicted_at) AND evicted_at <= {UNTIL}""")
def evictions_on_grid(spark, sf_dir):
    return liveness.evictions(tables.heartbeats(spark, sf_dir), TIMEOUT, START, UNTIL)


@query(f"""WITH {_BEATS}, ahead AS (
    SELECT worker, sent_at, lead(sent_at) OVER (PARTITION BY worker ORDER BY sent_at, event_id) AS next_at FROM beats)
    SELECT worker, sent_at, next_at, next_at - sent_at AS gap FROM ahead WHERE next_at - sent_at > {LONG_GAP}""")
def heartbeat_gaps(spark, sf_dir):
    return liveness.gaps(tables.heartbeats(spark, sf_dir), LONG_GAP)


@query(f"WITH {_BEATS} SELECT worker, sent_at, service FROM registry WHERE NOT ({UNTIL} - sent_at > {TIMEOUT * 2})")
def survivors_anti(spark, sf_dir):
    latest = registry.latest(tables.heartbeats(spark, sf_dir))
    return liveness.survivors(latest, UNTIL, TIMEOUT * 2).select("worker", "sent_at", "service")


@query(f"WITH {_BEATS} SELECT '{WORKER}' AS self, worker AS peer, port FROM registry WHERE worker <> '{WORKER}'")
def peers_of_worker(spark, sf_dir):
    return neighbours.peers_of(registry.latest(tables.heartbeats(spark, sf_dir)), WORKER)


@query(f"WITH {_BEATS} SELECT '{WORKER}' AS self, worker AS peer, port FROM registry WHERE worker <> '{WORKER}'")
def peers_ever(spark, sf_dir):
    return neighbours.peers_ever(tables.heartbeats(spark, sf_dir), WORKER)


@query("""SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'unhandled' END AS handler,
    count(*) AS messages FROM events GROUP BY 1""")
def dispatch_counts(spark, sf_dir):
    routed = dispatch.dispatch(tables.messages(spark, sf_dir), HANDLERS, "router", 1)
    return routed.groupBy("handler").agg(F.count(F.lit(1)).alias("messages"))


@query("""SELECT event_id, event_type AS msg_type, 'error' AS handler, 'no handler for ' || event_type AS problem
    FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')""")
def dispatch_rejects(spark, sf_dir):
    routed = dispatch.dispatch(tables.messages(spark, sf_dir), HANDLERS, "pull", 1)
    return dispatch.rejects(routed).select("event_id", "msg_type", "handler", "problem")


@query("SELECT event_type AS topic, event_id FROM events WHERE starts_with(event_type, 'p')")
def topic_filter(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "event_id")
    return tables.topic(events, "topic", "p")


@query(f"""WITH {_TASKS} SELECT task_id, pipeline[1] AS worker, array_to_string(list_slice(pipeline, 2, len(pipeline)), ',') AS rest,
    pipeline[2] AS next_worker, (len(pipeline) - 1)::BIGINT AS remaining FROM tasks""")
def pipeline_step(spark, sf_dir):
    stepped = pipeline.step(tables.tasks(spark, sf_dir))
    return stepped.select("task_id", "worker", F.array_join("pipeline", ",").alias("rest"), "next_worker", F.col("remaining").cast("bigint").alias("remaining"))


@query(f"""WITH {_TASKS} SELECT task_id, hop::BIGINT AS hop, worker, pipeline[hop + 2] AS next_worker, (n - hop - 1)::BIGINT AS remaining FROM hops""")
def pipeline_hops(spark, sf_dir):
    found = pipeline.hops(tables.tasks(spark, sf_dir))
    return found.select("task_id", F.col("hop").cast("bigint").alias("hop"), "worker", "next_worker", F.col("remaining").cast("bigint").alias("remaining"))


@query(f"""WITH {_TASKS} SELECT task_id, hop::BIGINT AS hop, worker, pipeline[hop + 2] AS next_worker,
    CASE pipeline[hop + 2] WHEN 'user' THEN '6000' WHEN 'assistant' THEN '6001' END AS port,
    CASE pipeline[hop + 2] WHEN 'user' THEN 'tcp://user:6000' WHEN 'assistant' THEN 'tcp://assistant:6001' END AS address FROM hops""")
def pipeline_next_address(spark, sf_dir):
    ports = spark.sql("SELECT * FROM VALUES ('user', '6000'), ('assistant', '6001') AS t(worker, port)")
    found = pipeline.next_addresses(pipeline.hops(tables.tasks(spark, sf_dir)), ports)
    return found.select("task_id", F.col("hop").cast("bigint").alias("hop"), "worker", "next_worker", "port", "address")


@query(f"WITH {_TASKS} SELECT task_id, hop::BIGINT AS hop, pipeline[hop + 2] AS next_worker FROM hops WHERE pipeline[hop + 2] IS NOT NULL AND pipeline[hop + 2] <> 'user'")
def pipeline_unroutable(spark, sf_dir):
    ports = spark.sql("SELECT 'user' AS worker, '6000' AS port")
    found = pipeline.unroutable(pipeline.hops(tables.tasks(spark, sf_dir)), ports)
    return found.select("task_id", F.col("hop").cast("bigint").alias("hop"), "next_worker")


@query(f"WITH {_TASKS} SELECT task_id, pipeline[1] AS worker FROM tasks WHERE pipeline[1] <> 'user'")
def pipeline_misrouted(spark, sf_dir):
    return pipeline.misrouted(tables.tasks(spark, sf_dir), "user").select("task_id", F.get("pipeline", F.lit(0)).alias("worker"))


@query(f"WITH {_TASKS} SELECT task_id, 'Client-0000' AS client, pipeline[len(pipeline)] AS worker, 'PONG' AS reply FROM tasks")
def pipeline_terminal(spark, sf_dir):
    return pipeline.replies(tables.tasks(spark, sf_dir)).select("task_id", "client", "worker", "reply")


@query(f"WITH {_TASKS} SELECT task_id, pipeline[1] AS send_to, pipeline[len(pipeline)] AS listen_to FROM tasks")
def pipeline_entry_points(spark, sf_dir):
    return pipeline.entry_points(tables.tasks(spark, sf_dir))


@query(f"WITH {_TASKS} SELECT task_id, len(pipeline)::BIGINT AS hops, (len(pipeline) * 0.5)::DOUBLE AS least_seconds FROM tasks")
def pipeline_min_latency(spark, sf_dir):
    found = pipeline.least_latency(tables.tasks(spark, sf_dir))
    return found.select("task_id", F.col("hops").cast("bigint").alias("hops"), F.col("least_seconds").cast("double").alias("least_seconds"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.heartbeats(spark, sf_dir).select("worker", F.col("sent_at").alias("arrived"), F.col("arrival").alias("id"))


@query(f"WITH {_BEATS} SELECT worker, sent_at AS arrived, event_id AS id, row_number() OVER (PARTITION BY worker ORDER BY sent_at, event_id) AS place FROM beats")
def queue_fifo(spark, sf_dir):
    return queueing.fifo(_arrivals(spark, sf_dir)).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {_BEATS} SELECT worker, sent_at AS arrived, event_id AS id,
    (sum(CASE WHEN service = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY worker ORDER BY sent_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS depth FROM beats""")
def queue_depth(spark, sf_dir):
    beats = tables.heartbeats(spark, sf_dir)
    change = F.when(F.col("service") == "purchase", -1).otherwise(1)
    return queueing.depth(beats.select("worker", F.col("sent_at").alias("arrived"), F.col("arrival").alias("id"), change.alias("change")))


_DONE = f"""WITH {_BEATS}, placed AS (
    SELECT worker, sent_at AS arrived, event_id AS id, row_number() OVER (PARTITION BY worker ORDER BY sent_at, event_id) AS place FROM beats),
    timed AS (SELECT *, {SERVICE} * place + max(arrived - {SERVICE} * (place - 1)) OVER (
        PARTITION BY worker ORDER BY arrived, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM placed)"""


@query(f"{_DONE} SELECT worker, id, place, done::BIGINT AS done, (done - {SERVICE} - arrived)::BIGINT AS waited FROM timed")
def queue_completion(spark, sf_dir):
    found = queueing.completions(_arrivals(spark, sf_dir), SERVICE)
    return found.select("worker", "id", *[F.col(c).cast("bigint").alias(c) for c in ("place", "done", "waited")])


@query("""SELECT count(*) AS nodes FROM (
    SELECT 'p' || l_partkey AS node FROM lineitem UNION SELECT 's' || l_suppkey FROM lineitem)""")
def graph_node_count(spark, sf_dir):
    return graph.node_count(tables.graph_edges(spark, sf_dir))


@query("SELECT role, count(*) AS messages, (sum(octet_length(encode(text)) + octet_length(encode(role))))::BIGINT AS total_bytes FROM conversations GROUP BY role")
def send_bytes(spark, sf_dir):
    frames = F.array(F.encode("role", "UTF-8"), F.encode("text", "UTF-8"))
    return sendlog.totals(tables.table(spark, sf_dir, "conversations").select("role", frames.alias("frames")), "role")


@query("""SELECT role || ',message,' || conv_id || ',' || turn || ',' || (octet_length(encode(text)) + octet_length(encode(role))
    + 7 + len(conv_id::VARCHAR) + 1)::VARCHAR AS value FROM conversations""")
def send_log_lines(spark, sf_dir):
    names = [F.col("role"), F.lit("message"), F.col("conv_id").cast("string"), F.col("text"), F.lit("-")]
    frames = F.array(*[F.encode(c, "UTF-8") for c in names])
    rows = tables.table(spark, sf_dir, "conversations").select(frames.alias("frames"), F.col("turn").alias("time_ms"))
    return sendlog.lines(sendlog.entries(rows))


@query("""SELECT unnest(['w,' || turn::VARCHAR || '.0,[' || role || ']', 'w,' || turn::VARCHAR || '.0,' || octet_length(encode(role))::VARCHAR]) AS value
    FROM conversations""")
def send_log_worker(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations")
    return sendlog.worker_lines(rows.select(F.lit("w").alias("recipient"), F.col("turn").cast("double").alias("time_s"), F.array(F.encode("role", "UTF-8")).alias("frames")))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT event_id, round_even(epoch_us(ts) / 1e6, 0)::BIGINT AS seconds, round_even(epoch_us(ts) / 1e3, 0)::BIGINT AS millis FROM events")
def epoch_rounding(spark, sf_dir):
    ts = F.col("ts")
    return tables.table(spark, sf_dir, "events").select("event_id", codecs.epoch_seconds(ts).alias("seconds"), codecs.epoch_millis(ts).alias("millis"))


@query("""SELECT DISTINCT c_custkey, 'Worker-' || (CASE WHEN len(c_custkey::VARCHAR) >= 4 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 4, '0') END) AS name,
    c_name AS host, c_nationkey::INTEGER AS port FROM customer""")
def identity_format(spark, sf_dir):
    place = codecs.address(F.concat_ws(":", "c_name", "c_nationkey"))
    rows = tables.table(spark, sf_dir, "customer").select("c_custkey", codecs.worker_name(F.col("c_custkey")).alias("name"), place.alias("a"))
    return rows.select("c_custkey", "name", F.col("a.host").alias("host"), F.col("a.port").alias("port"))


@query("""SELECT 'event' AS channel, event_id AS id, event_type AS msg_type FROM events
    UNION ALL SELECT 'conversation', conv_id, role FROM conversations""")
def union_inbox(spark, sf_dir):
    a = tables.table(spark, sf_dir, "events").select(F.lit("event").alias("channel"), F.col("event_id").alias("id"), F.col("event_type").alias("msg_type"))
    b = tables.table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("channel"), F.col("conv_id").alias("id"), F.col("role").alias("msg_type"))
    return a.unionByName(b)


@query(f"""WITH {_BEATS}, fresh AS (SELECT * FROM registry WHERE worker < 'Worker-0005')
    SELECT worker, sent_at FROM registry WHERE worker >= 'Worker-0005'
    UNION ALL SELECT worker, sent_at FROM fresh""")
def registry_upsert(spark, sf_dir):
    beats = tables.heartbeats(spark, sf_dir)
    old = registry.latest(beats, "event_time").withColumn("sent_at", F.when(F.col("worker") < "Worker-0005", F.lit(0)).otherwise(F.col("sent_at")))
    return registry.upsert(old, beats.where(F.col("worker") < "Worker-0005")).select("worker", "sent_at")


@query(f"""WITH {_BEATS} SELECT b.worker, b.event_id, r.sent_at - b.sent_at AS behind FROM beats b JOIN registry r ON b.worker = r.worker""")
def request_reply(spark, sf_dir):
    beats = tables.heartbeats(spark, sf_dir)
    answers = registry.latest(beats).select(F.col("worker").alias("sender"), F.col("sent_at").alias("latest"))
    asked = beats.select(F.col("worker").alias("sender"), F.col("arrival").alias("event_id"), "sent_at")
    return asked.join(answers, "sender").select(F.col("sender").alias("worker"), "event_id", (F.col("latest") - F.col("sent_at")).alias("behind"))


@query(f"WITH {_BEATS} SELECT event_id AS arrival, worker, sent_at, service, port, x, y FROM beats")
def heartbeat_wire(spark, sf_dir):
    beats = wire.heartbeats_of(wire.heartbeat_messages(tables.heartbeats(spark, sf_dir)))
    return beats.select("arrival", "worker", "sent_at", "service", "port", "x", "y")


@query(f"WITH {_TASKS} SELECT task_id, task_id::DOUBLE AS time, array_to_string(pipeline, ',') AS workers FROM tasks")
def task_wire(spark, sf_dir):
    tasks = wire.tasks_of(wire.task_json(tables.tasks(spark, sf_dir)))
    return tasks.select("task_id", "time", F.array_join("pipeline", ",").alias("workers"))


@query(f"WITH {_BEATS} SELECT worker, sent_at FROM registry WHERE worker >= 'Worker-0010'")
def registry_delete(spark, sf_dir):
    latest = registry.latest(tables.heartbeats(spark, sf_dir))
    return registry.delete(latest, latest.where(F.col("worker") < "Worker-0010")).select("worker", "sent_at")


@query(f"WITH {_BEATS} SELECT string_agg(worker, ',' ORDER BY worker) AS workers FROM registry")
def registry_workers(spark, sf_dir):
    return registry.worker_list(registry.latest(tables.heartbeats(spark, sf_dir))).select(F.array_join("workers", ",").alias("workers"))


@query("""SELECT conv_id AS task_id, (max(turn) + 1 - min(turn))::DOUBLE AS elapsed FROM conversations GROUP BY conv_id""")
def pipeline_elapsed(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(F.min("turn").alias("a"), (F.max("turn") + 1).alias("b"))
    return pipeline.elapsed(turns.select("task_id", F.col("a").cast("double").alias("time")), turns.select("task_id", F.col("b").cast("double").alias("time")))


@query()
def generated_heartbeats(spark, sf_dir):
    return tables.generated_heartbeats(spark, 1_000)


@query("SELECT doc_id, text, true AS same FROM documents")
def codec_roundtrip(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    back = docs.withColumn("back", codecs.decompress(codecs.compress("text")))
    return back.select("doc_id", F.col("back").alias("text"), F.col("back").eqNullSafe(F.col("text")).alias("same"))


#: Events of a mesh in order of time, task and hop: the first is served, and its next hop queues up.
_SIMULATION = f"""WITH RECURSIVE {_TASKS},
    placed AS (SELECT task_id, task_id // 25 AS mesh, pipeline, len(pipeline) AS n FROM tasks),
    sim AS (
        SELECT mesh, list_sort(list({{'at': task_id::DOUBLE, 'task': task_id, 'hop': 0::BIGINT}})) AS q,
            -1.0::DOUBLE AS u, -1.0::DOUBLE AS a, -1.0::DOUBLE AS s,
            NULL::BIGINT AS task_id, NULL::BIGINT AS hop, NULL::VARCHAR AS worker, NULL::DOUBLE AS arrived, NULL::DOUBLE AS done
        FROM placed GROUP BY mesh
        UNION ALL
        SELECT mesh, list_sort(list_concat(list_slice(q, 2, len(q)),
                CASE WHEN e.hop + 1 < n THEN [{{'at': t, 'task': e.task, 'hop': e.hop + 1}}] ELSE [] END)),
            CASE WHEN w = 'user' THEN t ELSE u END, CASE WHEN w = 'assistant' THEN t ELSE a END, CASE WHEN w = 'system' THEN t ELSE s END,
            e.task, e.hop, w, e.at, t
        FROM (
            SELECT x.*, greatest(e.at, CASE w WHEN 'user' THEN u WHEN 'assistant' THEN a ELSE s END) + 0.5 AS t
            FROM (
                SELECT sim.mesh, q, u, a, s, q[1] AS e, n, pipeline[q[1].hop + 1] AS w
                FROM sim JOIN placed ON placed.task_id = q[1].task WHERE len(q) > 0) x))
    SELECT mesh::VARCHAR AS mesh, task_id, hop, worker, arrived, done FROM sim WHERE task_id IS NOT NULL"""


@query(_SIMULATION)
def pipeline_simulation(spark, sf_dir):
    """Runs of 25 tasks share a mesh: their roles are the workers, so tasks wait for each other."""
    tasks = tables.tasks(spark, sf_dir).withColumn("mesh", F.floor(F.col("task_id") / 25).cast("string"))
    return queueing.simulate(tasks)


@query(f"""WITH {_BEATS}, sent AS (
    SELECT worker, ts, event_id, sent_at, service, CASE WHEN service = 'click' THEN port END AS port,
        CASE WHEN service = 'purchase' THEN (event_id % 7)::VARCHAR END AS x FROM beats)
    SELECT worker, list(sent_at ORDER BY ts, event_id)[-1] AS sent_at, list(service ORDER BY ts, event_id)[-1] AS service,
        (list(port ORDER BY ts, event_id) FILTER (WHERE port IS NOT NULL))[-1] AS port,
        (list(x ORDER BY ts, event_id) FILTER (WHERE x IS NOT NULL))[-1] AS x FROM sent GROUP BY worker""")
def registry_merge(spark, sf_dir):
    """Heartbeats that leave fields out change the others alone."""
    beats = tables.heartbeats(spark, sf_dir)
    beats = beats.withColumn("port", F.when(F.col("service") == "click", F.col("port"))).withColumn("x", F.when(F.col("service") == "purchase", (F.col("arrival") % 7).cast("string")))
    return registry.merged(beats).select("worker", "sent_at", "service", "port", "x")


@query(f"""WITH {_BEATS} SELECT '{WORKER}' AS self, worker AS peer, port FROM registry
    WHERE worker <> '{WORKER}' AND {UNTIL} - sent_at > {TIMEOUT}""")
def peers_lingering(spark, sf_dir):
    """Workers that the registry has evicted, and a peer still knows."""
    beats = tables.heartbeats(spark, sf_dir)
    return neighbours.lingering(beats, liveness.survivors(registry.latest(beats), UNTIL, TIMEOUT), WORKER)


@query(f"WITH {_BEATS} SELECT a.worker AS self, b.worker AS peer, b.port FROM registry a JOIN registry b ON a.worker <> b.worker")
def peers_all(spark, sf_dir):
    return neighbours.all_peers(registry.latest(tables.heartbeats(spark, sf_dir)))


@query(f"WITH {_BEATS} SELECT worker AS sender, event_id AS request_id, 'Pong' AS reply FROM beats WHERE service = 'click'")
def ping_replies(spark, sf_dir):
    return dispatch.pong(tables.requests(spark, sf_dir, "click"))


@query(f"WITH {_BEATS} SELECT worker AS sender, event_id AS request_id, 'Done reintroducing...' AS reply FROM beats WHERE service = 'view'")
def reintroduce_replies(spark, sf_dir):
    return dispatch.reintroduced(tables.requests(spark, sf_dir, "view"))


@query("""SELECT count(*)::VARCHAR AS reply FROM (
    SELECT 'p' || l_partkey AS node FROM lineitem UNION SELECT 's' || l_suppkey FROM lineitem)""")
def graph_ping(spark, sf_dir):
    return graph.node_count_reply(tables.graph_edges(spark, sf_dir))


@query(f"""WITH {_BEATS} SELECT b.worker AS sender, b.event_id AS request_id, e.event_type || ' ' || (octet_length(encode(e.props)))::VARCHAR AS reply
    FROM beats b JOIN events e ON b.event_id = e.event_id WHERE e.event_type IN ('click', 'purchase')""")
def replies_to_senders(spark, sf_dir):
    """Handlers answer some of the requests; each answer goes to the request it is for."""
    asked = tables.messages(spark, sf_dir).withColumnRenamed("event_id", "request_id")
    size = F.octet_length(F.get("frames", F.lit(2))).cast("string")
    handlers = dispatch.Handlers()
    for name in ("click", "purchase"):
        handlers.on(name)(lambda rows: rows.select("sender", "request_id", F.concat_ws(" ", "handler", size).alias("reply")))
    results = handlers.run(asked)
    return dispatch.reply(asked, results["click"].unionByName(results["purchase"]))


@query("""SELECT count(*) AS nodes FROM (
    SELECT 'p' || l_partkey AS node FROM lineitem UNION SELECT 's' || l_suppkey FROM lineitem
    UNION SELECT 'p' || p_partkey FROM part UNION SELECT 's' || s_suppkey FROM supplier)""")
def graph_vertex_count(spark, sf_dir):
    """Parts and suppliers that no line joins count, too."""
    parts = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    suppliers = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.node_count(tables.graph_edges(spark, sf_dir), parts.union(suppliers))


@query(f"""WITH {_BEATS} SELECT b.worker AS sender, 'Received message from ' || b.worker || ', with error: ' || e.props || '!' AS line
    FROM beats b JOIN events e ON b.event_id = e.event_id WHERE e.event_type = 'error'""")
def error_lines(spark, sf_dir):
    messages = tables.messages(spark, sf_dir)
    return dispatch.status(messages.where(F.decode(F.get("frames", F.lit(1)), "UTF-8") == "error"))


#: Per channel: whether types are lower-cased; the handler of empty, reserved and unknown types.
_CHANNELS = ", ".join(
    f"('{name}', {str(rule['lower']).upper()}, '{rule['empty']}', '{rule['reserved']}', '{rule['unknown']}')" for name, rule in dispatch.CHANNELS.items()
)


@query(f"""WITH rules(channel, lowers, empty, reserved, unknown) AS (VALUES {_CHANNELS}),
    said AS (
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '_' || event_type WHEN 2 THEN upper(event_type) WHEN 3 THEN 'nope' ELSE event_type END AS said FROM events),
    typed AS (SELECT channel, empty, reserved, unknown, CASE WHEN lowers THEN lower(said) ELSE said END AS t FROM said, rules)
    SELECT channel, CASE WHEN t = '' THEN empty WHEN starts_with(t, '_') THEN reserved WHEN t IN ('click', 'view', 'purchase') THEN t ELSE unknown END AS handler,
        count(*) AS messages FROM typed GROUP BY ALL""")
def dispatch_channels(spark, sf_dir):
    """Every kind of channel, with types that are empty, reserved, upper-case and unknown."""
    number, kind = F.col("event_id") % 5, F.col("event_type")
    said = F.when(number == 0, "").when(number == 1, F.concat(F.lit("_"), kind)).when(number == 2, F.upper(kind)).when(number == 3, "nope").otherwise(kind)
    events = tables.table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    found = None
    for name, rule in dispatch.CHANNELS.items():
        body = F.to_json(F.array("said", F.lit("data"))) if rule["envelope"] else F.col("said")
        frames = F.array(F.encode(F.lit("sender"), "UTF-8"), F.encode(body, "UTF-8"))
        routed = dispatch.dispatch(events.select(frames.alias("frames")), HANDLERS, name, 1).select(F.lit(name).alias("channel"), "handler")
        found = routed if found is None else found.unionByName(routed)
    return found.groupBy("channel", "handler").agg(F.count(F.lit(1)).alias("messages"))


@query(f"""WITH {_BEATS}, fields AS (
    SELECT worker, unnest(['sentAt', 'service', 'port', 'x', 'y']) AS field, unnest([sent_at::VARCHAR, service, port, x, y]) AS value FROM registry)
    SELECT f.worker, field, value, r.port AS port FROM fields f JOIN registry r ON f.worker = r.worker""")
def registry_fields(spark, sf_dir):
    """Entries as a store of strings gives them back, and one field looked up."""
    rows = registry.as_fields(registry.latest(tables.heartbeats(spark, sf_dir)))
    return rows.select("worker", codecs.field(F.col("fields"), "port", strict=True).alias("port"), F.explode("fields").alias("field", "value"))


@query("SELECT event_id, epoch_us(ts) / 1e6 AS seconds, (epoch_us(ts) / 1e6)::VARCHAR AS shown, (value * 10000)::VARCHAR AS amount FROM events")
def epoch_floats(spark, sf_dir):
    seconds = codecs.epoch_float(F.col("ts"))
    rows = tables.table(spark, sf_dir, "events")
    return rows.select("event_id", seconds.alias("seconds"), codecs.float_text(seconds).alias("shown"), codecs.float_text(F.col("value") * 10000).alias("amount"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) = len(text) THEN octet_length(encode(text)) ELSE -1 END AS n_bytes FROM documents")
def ascii_frames(spark, sf_dir):
    """Bytes of each text's frame; -1 for texts that ASCII cannot hold, which have none."""
    size = F.coalesce(F.octet_length(codecs.encode(F.col("text"))), F.lit(-1))
    return tables.table(spark, sf_dir, "documents").select("doc_id", size.cast("bigint").alias("n_bytes"))


@query("""SELECT concat('[b', chr(39), role, chr(39), ', b', chr(39), conv_id, chr(39), '],', turn, ',', len(role) + len(conv_id::VARCHAR)) AS value FROM conversations""")
def send_log_short(spark, sf_dir):
    """Messages of few frames are logged with the list of their frames."""
    frames = F.array(F.encode("role", "UTF-8"), F.encode(F.col("conv_id").cast("string"), "UTF-8"))
    rows = tables.table(spark, sf_dir, "conversations").select(frames.alias("frames"), F.col("turn").alias("time_ms"))
    return sendlog.lines(sendlog.entries(rows))


_POPS = f"""WITH {_BEATS}, changes AS (
    SELECT worker, sent_at AS arrived, event_id AS id, CASE WHEN service IN ('click', 'view') THEN 1 ELSE -1 END AS change FROM beats),
    counted AS (
        SELECT *, sum(-change) OVER w AS ahead, count(*) FILTER (WHERE change < 0) OVER w AS n FROM changes
        WINDOW w AS (PARTITION BY worker ORDER BY arrived, id ROWS UNBOUNDED PRECEDING)),
    idled AS (SELECT *, greatest(0, max(ahead) OVER (PARTITION BY worker ORDER BY arrived, id ROWS UNBOUNDED PRECEDING)) AS idle FROM counted),
    found AS (SELECT *, coalesce(lag(idle) OVER (PARTITION BY worker ORDER BY arrived, id), 0) AS before FROM idled),
    pushed AS (SELECT worker, id AS got, row_number() OVER (PARTITION BY worker ORDER BY arrived, id) AS nth FROM changes WHERE change > 0)
    SELECT f.worker, id, got FROM found f JOIN pushed p ON p.worker = f.worker AND p.nth = n - idle WHERE change < 0 AND idle = before"""


def _changes(beats: DataFrame) -> DataFrame:
    change = F.when(F.col("service").isin("click", "view"), 1).otherwise(-1)
    return beats.select("worker", F.col("sent_at").cast("double").alias("arrived"), F.col("arrival").alias("id"), change.alias("change"))


@query(_POPS)
def queue_pops(spark, sf_dir):
    return queueing.pops(_changes(tables.heartbeats(spark, sf_dir)))


@query(_POPS)
def stream_task_list(spark, sf_dir):
    return keyed.run_to_end(keyed.task_list_stream(_changes(keyed.heartbeat_stream(spark, sf_dir))), "stream-tasks")


@query("""SELECT event_id, event_type AS msg_type, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'unhandled' END AS handler FROM events""")
def stream_dispatch(spark, sf_dir):
    routed = dispatch.dispatch(keyed.request_stream(spark, sf_dir), HANDLERS, "router", 1)
    return keyed.run_to_end(routed.select("event_id", "msg_type", "handler"), "stream-dispatch")


@query(f"WITH {_BEATS} SELECT b.event_id AS arrival, b.worker, r.port AS known_port FROM beats b JOIN registry r ON b.worker = r.worker")
def stream_addresses(spark, sf_dir):
    """A stream that meets the registry's snapshot, as workers do after a broadcast."""
    ports = neighbours.ports(registry.latest(tables.heartbeats(spark, sf_dir)))
    found = keyed.addressed(keyed.heartbeat_stream(spark, sf_dir).select("worker", "arrival"), ports)
    return keyed.run_to_end(found.select("arrival", "worker", "known_port"), "stream-addresses")


@query(f"""WITH {_BEATS}, ahead AS (
    SELECT worker, sent_at, lead(sent_at) OVER (PARTITION BY worker ORDER BY sent_at, event_id) AS next_at FROM beats),
    seen AS (SELECT epoch_us(max(ts)) / 1e6 - 10 AS mark FROM events)
    SELECT worker, sent_at FROM ahead, seen WHERE next_at - sent_at > {TIMEOUT} OR (next_at IS NULL AND sent_at + {TIMEOUT} + 1 <= mark)""")
def stream_liveness(spark, sf_dir):
    return keyed.run_to_end(keyed.eviction_stream(keyed.heartbeat_stream(spark, sf_dir), TIMEOUT), "stream-liveness")


@query(f"WITH {_BEATS} SELECT worker, sent_at, service, port, x, y FROM registry")
def stream_registry(spark, sf_dir):
    return keyed.registry_stream(spark, sf_dir)


@query(f"{_DONE} SELECT worker, id, done::DOUBLE AS done FROM timed")
def stream_queue(spark, sf_dir):
    beats = keyed.heartbeat_stream(spark, sf_dir)
    arrivals = beats.select("worker", F.col("sent_at").cast("double").alias("arrived"), F.col("arrival").alias("id"))
    return keyed.run_to_end(keyed.queue_stream(arrivals, float(SERVICE)), "stream-queue")
