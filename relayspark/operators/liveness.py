"""Liveness: expiry, and evictions by a sweep that runs twice in a timeout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order() -> Window:
    return Window.partitionBy("worker").orderBy("sent_at", "arrival")


def expired(now: Column, timeout: float) -> Column:
    """Strictly more than ``timeout`` seconds since the last heartbeat."""
    return now - F.col("sent_at").cast("bigint") > timeout


def live(registry: DataFrame, now: int, timeout: float) -> DataFrame:
    return registry.where(~expired(F.lit(now), timeout))


def gaps(beats: DataFrame, timeout: float) -> DataFrame:
    """Heartbeats that the same worker's next one follows only after more than ``timeout`` seconds."""
    ahead = beats.select("worker", "sent_at", "arrival", F.lead("sent_at").over(_in_order()).alias("next_at"))
    return ahead.where(F.col("next_at") - F.col("sent_at") > timeout).select("worker", "sent_at", "next_at", (F.col("next_at") - F.col("sent_at")).alias("gap"))


def evictions(beats: DataFrame, timeout: float, start: int, until: int) -> DataFrame:
    """(worker, sent_at, evicted_at): a sweep at ``start`` and every half timeout up to ``until`` evicts a
    worker whose last heartbeat is older than ``timeout``. A later heartbeat registers it again."""
    tick = int(timeout // 2)
    due = F.lit(start) + (F.floor((F.col("sent_at") + int(timeout) - start) / tick) + 1) * tick
    ahead = beats.select("worker", "sent_at", F.lead("sent_at").over(_in_order()).alias("next_at"), due.cast("bigint").alias("evicted_at"))
    gone = (F.col("next_at").isNull() | (F.col("next_at") > F.col("evicted_at"))) & (F.col("evicted_at") <= until)
    return ahead.where(gone).select("worker", "sent_at", "evicted_at")


def survivors(registry: DataFrame, now: int, timeout: float) -> DataFrame:
    """The registry without the workers that a sweep at ``now`` finds dead."""
    dead = registry.where(expired(F.lit(now), timeout)).select("worker")
    return registry.join(dead, "worker", "left_anti")
