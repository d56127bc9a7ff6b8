"""Queues of workers that serve one task at a time, in order of arrival, for a constant time."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayspark.model import SERVICE_SECONDS


def _order() -> Window:
    return Window.partitionBy("worker").orderBy("arrived", "id")


def fifo(arrivals: DataFrame) -> DataFrame:
    """The place of each arrival (worker, arrived, id) in its worker's queue."""
    return arrivals.select("worker", "arrived", "id", F.row_number().over(_order()).alias("place"))


def depth(changes: DataFrame) -> DataFrame:
    """Length of each worker's queue after each change (worker, arrived, id, change of +1 or -1)."""
    running = F.sum("change").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return changes.select("worker", "arrived", "id", running.cast("bigint").alias("depth"))


def completions(arrivals: DataFrame, service: float = SERVICE_SECONDS) -> DataFrame:
    """When each arrival is done. With n the place in the queue and s the service time, the n-th is done at
    s * n plus the largest, over places j up to n, of arrival(j) - s * (j - 1)."""
    placed = fifo(arrivals)
    slack = F.col("arrived") - F.lit(service) * (F.col("place") - 1)
    latest = F.max(slack).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    done = latest + F.lit(service) * F.col("place")
    timed = placed.withColumn("done", done)
    return timed.select("worker", "arrived", "id", "place", "done", (F.col("done") - F.lit(service) - F.col("arrived")).alias("waited"))


def pops(changes: DataFrame) -> DataFrame:
    """(worker, id, got) for each change of -1 that finds a task: ``got`` is the id of the change of +1 it takes, first
    in, first out. A change of -1 that finds its worker's queue empty takes nothing.

    The n-th successful pop takes the n-th push; pops that found nothing so far number as many as the pops so far
    have been ahead of the pushes at most."""
    every = _order().rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.sum(-F.col("change")).over(every)
    counted = changes.select("worker", "arrived", "id", "change", ahead.alias("ahead"), F.sum(F.when(F.col("change") < 0, 1).otherwise(0)).over(every).alias("n"))
    idle = F.greatest(F.max("ahead").over(every), F.lit(0))
    found = counted.select("worker", "arrived", "id", "change", "n", idle.alias("idle"))
    before = F.coalesce(F.lag("idle").over(_order()), F.lit(0))
    found = found.withColumn("fresh", F.col("idle") == before)
    taken = found.where("change < 0 and fresh").select("worker", "id", (F.col("n") - F.col("idle")).alias("nth"))
    pushed = changes.where("change > 0").select("worker", F.col("id").alias("got"), F.row_number().over(_order()).alias("nth"))
    return taken.join(pushed, ["worker", "nth"]).select("worker", "id", "got")


MESH = "mesh string, task_id long, hop long, worker string, arrived double, done double"


def simulate(tasks: DataFrame, service: float = SERVICE_SECONDS) -> DataFrame:
    """Arrival and completion of every hop of every task (mesh, task_id, time, pipeline).

    A hop arrives when the one before is done, so workers that are visited more than once have no order that
    windows could follow; each mesh (a set of workers that share tasks, named by the caller) is simulated
    event by event. Meshes run in parallel; one mesh is one task's memory, so it must be of bounded size.
    """

    def run(mesh: pd.DataFrame) -> pd.DataFrame:
        # Events by (time, task, hop): equal times are served in order of task.
        events = [(float(r.time), int(r.task_id), 0) for r in mesh.itertuples() if r.pipeline is not None and len(r.pipeline)]
        heapq.heapify(events)
        paths = {int(r.task_id): list(r.pipeline) for r in mesh.itertuples() if r.pipeline is not None}
        free: dict[str, float] = {}
        rows = []
        while events:
            at, task, hop = heapq.heappop(events)
            worker = paths[task][hop]
            done = max(at, free.get(worker, at)) + service
            free[worker] = done
            rows.append((mesh["mesh"].iloc[0], task, hop, worker, at, done))
            if hop + 1 < len(paths[task]):
                heapq.heappush(events, (done, task, hop + 1))
        return pd.DataFrame(rows, columns=["mesh", "task_id", "hop", "worker", "arrived", "done"])

    return tasks.select("mesh", "task_id", "time", "pipeline").groupBy("mesh").applyInPandas(run, MESH)
