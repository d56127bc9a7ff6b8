"""The registry of workers: keyed upsert, scans, lookups and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.model import WORKER_PREFIX

FIELDS = ("sent_at", "service", "port", "x", "y")
#: What decides which of two heartbeats holds.
ORDERS = {"arrival": ("arrived_at", "arrival"), "event_time": ("sent_at", "arrived_at", "arrival")}


def latest(beats: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per worker. The last arrival wins, as an upsert does; with ``order='event_time'`` the
    heartbeat of the latest ``sent_at`` wins, so one that arrives late changes nothing. Heartbeats are whole; see
    ``merged`` for those that leave fields out."""
    row = F.max_by(F.struct(*FIELDS), F.struct(*ORDERS[order])).alias("r")
    return beats.groupBy("worker").agg(row).select("worker", "r.*")


def merged(beats: DataFrame, order: str = "arrival") -> DataFrame:
    """As ``latest``, but field by field: a null field was not sent, and what the field held before stays."""
    said = lambda name: F.when(F.col(name).isNotNull(), F.struct(*ORDERS[order]))
    return beats.groupBy("worker").agg(*[F.max_by(name, said(name)).alias(name) for name in FIELDS])


def prefix_scan(registry: DataFrame, key: str = "worker", prefix: str = WORKER_PREFIX) -> DataFrame:
    """Entries whose key starts with ``prefix``; the predicate reaches the scan."""
    return registry.where(F.col(key).startswith(prefix))


def lookup(registry: DataFrame, worker: str) -> DataFrame:
    """The entry of one worker; no row if there is none."""
    return registry.where(F.col("worker") == worker)


def as_fields(registry: DataFrame) -> DataFrame:
    """(worker, fields): every field as text, as a store of strings gives it back."""
    pairs = [x for name in FIELDS for x in (F.lit("sentAt" if name == "sent_at" else name), F.col(name).cast("string"))]
    return registry.select("worker", F.create_map(*pairs).alias("fields"))


def payload_json(registry: DataFrame) -> DataFrame:
    """The whole registry as one JSON object in key order: the answer of a service query, so one row by nature."""
    entry = F.to_json(F.struct(*[F.col(n).cast("string").alias("sentAt" if n == "sent_at" else n) for n in FIELDS]))
    entries = registry.select("worker", entry.alias("entry"))
    listed = F.sort_array(F.collect_list(F.struct("worker", "entry")))
    body = F.array_join(F.transform("e", lambda e: F.concat(F.lit('"'), e["worker"], F.lit('":'), e["entry"])), ",")
    return entries.agg(listed.alias("e")).select(F.concat(F.lit("{"), body, F.lit("}")).alias("payload"))


def worker_list(registry: DataFrame) -> DataFrame:
    return registry.agg(F.sort_array(F.collect_list("worker")).alias("workers"))


def upsert(registry: DataFrame, beats: DataFrame) -> DataFrame:
    """The registry after more heartbeats: field by field, what they sent last replaces what a worker's entry held."""
    old = registry.select("worker", *[F.col(name).alias(f"old_{name}") for name in FIELDS])
    kept = [F.coalesce(name, f"old_{name}").alias(name) for name in FIELDS]
    return old.join(merged(beats), "worker", "full_outer").select("worker", *kept)


def delete(registry: DataFrame, dead: DataFrame) -> DataFrame:
    """The registry without the workers of ``dead``."""
    return registry.join(dead.select("worker").distinct(), "worker", "left_anti")
