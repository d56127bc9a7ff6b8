"""Streaming versions of the stateful operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from relayspark.operators import liveness, registry
from relayspark.session import ROCKSDB, shared_path
from relayspark.sources.tables import heartbeat_columns, message_columns

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def heartbeat_stream(spark: SparkSession, sf_dir: str, per_batch: int = 1) -> DataFrame:
    """The events table as a stream of heartbeats, ``per_batch`` files at a time; ``ts`` is event time (UTC)."""
    # The glob makes a single file and a folder of part files both a valid stream source.
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(*heartbeat_columns(), F.col("ts").cast("timestamp").alias("ts"))


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Append a stream to a table in the shared folder until its source is exhausted, then read that."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _folder(spark: SparkSession, path: str):
    """A path of the JVM's, and the file system it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole snapshots below ``path``, rising."""
    target, store = _folder(spark, path)
    names = [x.getPath().getName() for x in store.listStatus(target)] if store.exists(target) else []
    done = [n for n in names if n.startswith("epoch=") and store.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n.split("=")[1]) for n in done)


def snapshots(state: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Write a streaming aggregate's state as a table of its own after each micro-batch; the last two stay."""
    spark = state.sparkSession

    def snapshot(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for old in epochs(spark, path)[:-2]:
            target, store = _folder(spark, f"{path}/epoch={old}")
            store.delete(target, True)

    writer = state.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(snapshot)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot."""
    return spark.read.parquet(f"{path}/epoch={epochs(spark, path)[-1]}")


def registry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after the whole stream, by arrival as in the batch form. Without a watermark: late heartbeats
    count."""
    path = shared_path(spark, "stream-registry")
    snapshots(registry.latest(heartbeat_stream(spark, sf_dir)), path).awaitTermination()
    return current(spark, path)


def sweep(spark: SparkSession, path: str, timeout: float, every: float, clock: Callable[[], float], dead: str) -> StreamingQuery:
    """Every ``every`` seconds of processing time, write to ``dead`` the workers (worker, sent_at, swept_at) of the last
    snapshot below ``path`` that ``clock`` finds expired. Runs until it is stopped; each sweep lists all that are
    dead then."""

    def once(_: DataFrame, epoch: int) -> None:
        if epochs(spark, path):
            now = int(clock())
            gone = current(spark, path).where(liveness.expired(F.lit(now), timeout))
            gone.select("worker", "sent_at", F.lit(now).cast("bigint").alias("swept_at")).write.mode("overwrite").parquet(f"{dead}/sweep={epoch}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(once).trigger(processingTime=f"{max(1, int(1000 * every))} milliseconds").start()


class SendHook(StreamingQueryListener):
    """Calls ``log`` with (name or id of the query, number of the micro-batch, rows in) after each one that had rows. Add
    it by ``spark.streams.addListener``."""

    def __init__(self, log: Callable[[tuple[str, int, int]], None]):
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        made = event.progress
        if made.numInputRows:
            self.log((made.name or str(made.id), made.batchId, made.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def request_stream(spark: SparkSession, sf_dir: str, per_batch: int = 1) -> DataFrame:
    """The events table as a stream of messages (event_id, user_id, sender, frames)."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(*message_columns())


def addressed(stream: DataFrame, ports: DataFrame) -> DataFrame:
    """A stream (worker, ...) with each worker's port from the registry's snapshot: a join with a static table, read
    anew by every micro-batch, that Spark broadcasts where it is small."""
    return stream.join(ports.select("worker", F.col("port").alias("known_port")), "worker", "left")


def _rows(worker: str, **columns: pd.Series) -> pd.DataFrame:
    # Plain objects: pandas' own string type may reach Arrow in chunks, which the state runner does not take.
    first = next(iter(columns.values()))
    return pd.DataFrame({"worker": pd.Series([worker] * len(first), dtype=object), **columns})


class Evictor(StatefulProcessor):
    """Emits (worker, sent_at) of heartbeats that no other follows in time.

    Rows of a batch are walked in event time, so a gap inside one micro-batch is seen although the timer for
    it never fires; the timer, set anew at each row, covers only the silence after the last one.
    """

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sent_at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beats = sorted(int(x) for rows_ in rows for x in rows_["sent_at"])
        last = self.last.get()[0] if self.last.exists() else None
        dead = []
        for at in beats:
            if last is not None and at - last > self.timeout:
                dead.append(last)
            last = at if last is None else max(last, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer((last + self.timeout + 1) * 1000)
        yield _rows(key[0], sent_at=pd.Series(dead, dtype="int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        dead = []
        if self.last.exists():
            last = self.last.get()[0]
            if expiredTimerInfo.getExpiryTimeInMs() >= (last + self.timeout + 1) * 1000:
                dead.append(last)
                self.last.clear()
        yield _rows(key[0], sent_at=pd.Series(dead, dtype="int64"))

    def close(self) -> None:
        pass


def eviction_stream(beats: DataFrame, timeout: int, delay: str = "10 seconds") -> DataFrame:
    """(worker, sent_at) for each eviction of a stream of heartbeats (worker, sent_at, ts)."""
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = beats.withWatermark("ts", delay).select("worker", "sent_at", "ts").groupBy("worker")
    return keyed.transformWithStateInPandas(
        statefulProcessor=Evictor(timeout), outputStructType="worker STRING, sent_at BIGINT", outputMode="Append", timeMode="EventTime"
    )


class Fifo(StatefulProcessor):
    """A worker's queue in state: emits each arrival with its completion, served in order for a constant time."""

    def __init__(self, service: float):
        self.service = service

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", "at DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrivals = sorted((float(a), int(i)) for rows_ in rows for a, i in zip(rows_["arrived"], rows_["id"], strict=True))
        free = self.free.get()[0] if self.free.exists() else None
        done = []
        for at, _ in arrivals:
            free = (at if free is None else max(at, free)) + self.service
            done.append(free)
        self.free.update((free,))
        yield _rows(key[0], id=pd.Series([i for _, i in arrivals], dtype="int64"), done=pd.Series(done, dtype="float64"))

    def close(self) -> None:
        pass


def queue_stream(arrivals: DataFrame, service: float) -> DataFrame:
    """(worker, id, done) for a stream of (worker, arrived, id). A micro-batch is served in order of arrival; what comes
    in a later one is served after it, as a queue does, even if its time is earlier."""
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return arrivals.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=Fifo(service), outputStructType="worker STRING, id BIGINT, done DOUBLE", outputMode="Append", timeMode="None"
    )



class TaskList(StatefulProcessor):
    """A worker's tasks as a list in state: +1 appends, -1 takes the first; emits what each -1 got."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getListState("tasks", "id BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes = sorted((float(a), int(i), int(c)) for x in rows for a, i, c in zip(x["arrived"], x["id"], x["change"], strict=True))
        held = deque(int(x[0]) for x in self.tasks.get()) if self.tasks.exists() else deque()
        got = []
        for _, number, change in changes:
            if change > 0:
                held.append(number)
            elif held:
                got.append((number, held.popleft()))
        self.tasks.clear()
        if held:
            self.tasks.put([(x,) for x in held])
        yield _rows(key[0], id=pd.Series([i for i, _ in got], dtype="int64"), got=pd.Series([g for _, g in got], dtype="int64"))

    def close(self) -> None:
        pass


def task_list_stream(changes: DataFrame) -> DataFrame:
    """(worker, id, got) for a stream of (worker, arrived, id, change); see ``queueing.pops``. A micro-batch's changes
    apply in order, those of a later one after them."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return changes.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=TaskList(), outputStructType="worker STRING, id BIGINT, got BIGINT", outputMode="Append", timeMode="None"
    )
