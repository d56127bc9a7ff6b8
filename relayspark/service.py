"""Long-running programs: a broker that keeps the registry, answers requests and sweeps the dead, and a worker that
serves its queue. Each is one driver program that starts streaming queries; see ``main``."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relayspark.model import SERVICE_SECONDS
from relayspark.operators import dispatch, neighbours, registry
from relayspark.session import session, shared_path
from relayspark.sources.tables import Settings
from relayspark.streaming import keyed

HANDLERS = ("click", "view", "purchase")


class Program:
    """Streaming queries that start and stop together. ``folder`` holds their results and checkpoints: a program that
    starts again on the same folder goes on where the last one ended."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings | None = None, folder: str | None = None):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings or Settings()
        self.folder = folder or shared_path(spark, type(self).__name__.lower())
        self.running: list[StreamingQuery] = []

    def queries(self) -> list[StreamingQuery]:
        raise NotImplementedError

    def start(self) -> Program:
        self.running = self.queries()
        return self

    def stop(self) -> None:
        for query in self.running:
            query.stop()
        self.running = []

    def run(self, seconds: float | None = None) -> None:
        """Until ``seconds`` are over, or a query ends. An error of a query is raised here."""
        began = time.monotonic()
        try:
            while all(q.isActive for q in self.running) and (seconds is None or time.monotonic() - began < seconds):
                time.sleep(0.2)
            for query in self.running:
                if query.exception():
                    raise query.exception()
        finally:
            self.stop()

    def _append(self, stream: DataFrame, name: str) -> StreamingQuery:
        writer = stream.writeStream.format("parquet").option("path", f"{self.folder}/{name}")
        return writer.option("checkpointLocation", f"{self.folder}/{name}-state").trigger(processingTime=self._tick()).start()

    def _tick(self) -> str:
        return f"{max(1, int(1000 * self.settings.tick))} milliseconds"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


class Broker(Program):
    """Keeps ``registry`` (snapshots), routes requests to ``routed`` and lists the dead in ``dead``."""

    def __init__(self, *args, clock: Callable[[], float] = time.time, **more):
        super().__init__(*args, **more)
        self.clock = clock

    def queries(self) -> list[StreamingQuery]:
        state = registry.latest(keyed.heartbeat_stream(self.spark, self.sf_dir))
        routed = dispatch.dispatch(keyed.request_stream(self.spark, self.sf_dir), list(HANDLERS))
        return [
            keyed.snapshots(state, f"{self.folder}/registry", processingTime=self._tick()),
            self._append(routed.select("event_id", "sender", "msg_type", "handler", "problem"), "routed"),
            keyed.sweep(self.spark, f"{self.folder}/registry", self.settings.timeout, self.settings.tick, self.clock, f"{self.folder}/dead"),
        ]

    def registry(self) -> DataFrame:
        return keyed.current(self.spark, f"{self.folder}/registry")

    def broadcast(self) -> DataFrame:
        """What every worker gets: one table for all."""
        return neighbours.ports(self.registry())


class Worker(Program):
    """Serves the queues of all workers of the stream, each on its own, to ``served``."""

    def queries(self) -> list[StreamingQuery]:
        beats = keyed.heartbeat_stream(self.spark, self.sf_dir)
        arrivals = beats.select("worker", F.col("sent_at").cast("double").alias("arrived"), F.col("arrival").alias("id"))
        return [self._append(keyed.queue_stream(arrivals, SERVICE_SECONDS), "served")]


def main(arguments: list[str]) -> int:
    """``broker`` or ``worker``, the folder of tables, and seconds to run (for ever if left out). Settings are read from
    the environment."""
    programs = {"broker": Broker, "worker": Worker}
    if len(arguments) not in (2, 3) or arguments[0] not in programs:
        print("usage: python -m relayspark.service broker|worker FOLDER [SECONDS]", file=sys.stderr)
        return 2
    programs[arguments[0]](session(), arguments[1]).start().run(float(arguments[2]) if len(arguments) == 3 else None)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
