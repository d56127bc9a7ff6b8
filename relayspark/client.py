"""What a client can ask, each answer a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relayspark.operators import dispatch, graph, liveness, meshes, neighbours, pipeline, queueing, registry, sendlog
from relayspark.sources import tables
from relayspark.streaming import keyed


class Client:
    """The engine over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: tables.Settings | None = None):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings or tables.Settings()

    def heartbeats(self) -> DataFrame:
        return tables.heartbeats(self.spark, self.sf_dir)

    def services(self) -> DataFrame:
        return registry.payload_json(registry.latest(self.heartbeats()))

    def ping(self, requests: DataFrame) -> DataFrame:
        return dispatch.pong(requests)

    def neighbours(self, worker: str, ever: bool = False) -> DataFrame:
        beats = self.heartbeats()
        return neighbours.peers_ever(beats, worker) if ever else neighbours.peers_of(registry.latest(beats), worker)

    def reintroduce(self, requests: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """The snapshot that goes to every worker (its rows once, not once for each receiver), and the replies to
        those that asked for it."""
        snapshot = neighbours.ports(registry.latest(self.heartbeats()))
        return snapshot, None if requests is None else dispatch.reintroduced(requests)

    def run_pipeline(self, tasks: DataFrame | None = None) -> DataFrame:
        """Arrival and completion of every hop; tasks that share workers, directly or over others, wait for each
        other. A column ``mesh`` that names such sets saves finding them."""
        tasks = tables.tasks(self.spark, self.sf_dir) if tasks is None else tasks
        return queueing.simulate(tasks if "mesh" in tasks.columns else meshes.connected(tasks))

    def replies(self) -> DataFrame:
        return pipeline.replies(tables.tasks(self.spark, self.sf_dir))

    def evictions(self, start: int, until: int) -> DataFrame:
        return liveness.evictions(self.heartbeats(), self.settings.timeout, start, until)

    def graph_node_count(self) -> DataFrame:
        return graph.node_count(tables.graph_edges(self.spark, self.sf_dir))

    def send_log(self, messages: DataFrame) -> DataFrame:
        return sendlog.entries(messages)

    def stream_registry(self) -> DataFrame:
        return keyed.registry_stream(self.spark, self.sf_dir)
