"""Tasks that visit workers in order: hops, next addresses, replies and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.functions.codecs import endpoint, head, tail
from relayspark.model import SERVICE_SECONDS


def step(tasks: DataFrame) -> DataFrame:
    """One step: the worker that takes the task, what is left, and whom it goes to. Other fields are dropped."""
    left = tail(F.col("pipeline"))
    return tasks.select("task_id", "time", head(F.col("pipeline")).alias("worker"), left.alias("pipeline"), head(left).alias("next_worker"), F.size(left).alias("remaining"))


def accepted(tasks: DataFrame, receiver: Column | str) -> DataFrame:
    """Tasks whose first worker is the receiver."""
    return tasks.where(head(F.col("pipeline")) == receiver)


def misrouted(tasks: DataFrame, receiver: Column | str) -> DataFrame:
    """The rest, with tasks of no worker at all: dropped in silence by a worker, kept as rejects here."""
    return tasks.where(~F.coalesce(head(F.col("pipeline")) == receiver, F.lit(False)))


def hops(tasks: DataFrame) -> DataFrame:
    """One row per worker visited. Next worker and what remains come from the array, without a window."""
    each = tasks.select("task_id", "pipeline", F.posexplode("pipeline").alias("hop", "worker"))
    return each.select("task_id", "hop", "worker", F.get("pipeline", F.col("hop") + 1).alias("next_worker"), (F.size("pipeline") - F.col("hop") - 1).alias("remaining"))


def next_addresses(hops: DataFrame, ports: DataFrame) -> DataFrame:
    """Hops with the address of the next worker: null for the last hop and for unknown workers. Spark picks
    the join by the size of the address table, which it knows."""
    table = ports.select(F.col("worker").alias("next_worker"), "port")
    joined = hops.join(table, "next_worker", "left")
    known = F.when(F.col("port").isNotNull(), endpoint(F.col("next_worker"), F.col("port")))
    return joined.select("task_id", "hop", "worker", "next_worker", "remaining", "port", known.alias("address"))


def unroutable(hops: DataFrame, ports: DataFrame) -> DataFrame:
    """Hops whose next worker nobody knows."""
    return hops.where("next_worker is not null").join(ports.select(F.col("worker").alias("next_worker")), "next_worker", "left_anti")


def replies(tasks: DataFrame, client: Column | str = "Client-0000") -> DataFrame:
    """The reply of each task's last hop."""
    to = F.lit(client) if isinstance(client, str) else client
    return tasks.where(F.size("pipeline") > 0).select("task_id", to.alias("client"), F.element_at("pipeline", -1).alias("worker"), F.col("time"), F.lit("PONG").alias("reply"))


def entry_points(tasks: DataFrame) -> DataFrame:
    """Where a client sends a task, and where it listens for the reply."""
    return tasks.select("task_id", head(F.col("pipeline")).alias("send_to"), F.try_element_at("pipeline", F.lit(-1)).alias("listen_to"))


def least_latency(tasks: DataFrame, service: float = SERVICE_SECONDS) -> DataFrame:
    """Seconds a task takes if no queue holds it up."""
    return tasks.select("task_id", F.size("pipeline").alias("hops"), (F.size("pipeline") * F.lit(service)).alias("least_seconds"))


def elapsed(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Seconds from sending to reply, by task."""
    a, b = sent.select("task_id", F.col("time").alias("sent")), received.select("task_id", F.col("time").alias("received"))
    return a.join(b, "task_id").select("task_id", (F.col("received") - F.col("sent")).alias("elapsed"))
