"""Sources: tables, and the adapters that read them as heartbeats, messages, tasks and graphs."""

from __future__ import annotations

from dataclasses import dataclass, field
from os import environ

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.functions import codecs


@dataclass(frozen=True)
class Settings:
    """Configuration by environment variable, with the engine's defaults."""

    timeout: float = field(default_factory=lambda: float(environ.get("TIMEOUT", "86400")))
    worker_id: str = field(default_factory=lambda: environ.get("WORKER_ID", "0000"))
    service: str = field(default_factory=lambda: environ.get("SERVICE", "DEMO").strip("'\""))
    port: int = field(default_factory=lambda: int(environ.get("PORT", "6000")))
    frontend_port: int = field(default_factory=lambda: int(environ.get("FRONTEND_PORT", "5559")))
    backend_port: int = field(default_factory=lambda: int(environ.get("BACKEND_PORT", "5560")))
    heartbeat_port: int = field(default_factory=lambda: int(environ.get("HEARTBEAT_PORT", "5561")))
    x: str = field(default_factory=lambda: environ.get("X", "0"))
    y: str = field(default_factory=lambda: environ.get("Y", "0"))

    @property
    def tick(self) -> float:
        """Heartbeats and sweeps come twice in a timeout."""
        return self.timeout / 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; a path that is not there raises an AnalysisException (PATH_NOT_FOUND)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heartbeat_columns() -> list[Column]:
    """An event row as a heartbeat of the worker that is numbered as its user."""
    user = F.col("user_id")
    return [
        codecs.worker_name(user).alias("worker"),
        codecs.epoch_seconds(F.col("ts")).alias("sent_at"),
        F.col("event_type").alias("service"),
        (F.lit(6000) + user).cast("string").alias("port"),
        (user % 25).cast("string").alias("x"),
        F.floor(user / 25).cast("string").alias("y"),
        F.col("ts").alias("arrived_at"),
        F.col("event_id").alias("arrival"),
    ]


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*heartbeat_columns())


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a task: its roles by turn are the workers to visit."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    grouped = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(turns.alias("t"))
    return grouped.select("task_id", F.col("task_id").cast("double").alias("time"), F.transform("t", lambda t: t["role"]).alias("pipeline"))


def message_columns() -> list[Column]:
    """An event row as a message of three frames: sender, type and JSON payload."""
    sender = codecs.worker_name(F.col("user_id"))
    frames = F.array(*[F.encode(c, "UTF-8") for c in (sender, F.col("event_type"), F.col("props"))])
    return [F.col("event_id"), F.col("user_id"), sender.alias("sender"), frames.alias("frames")]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*message_columns())


def requests(spark: SparkSession, sf_dir: str, msg_type: str) -> DataFrame:
    """(sender, request_id) of the messages of one type."""
    rows = messages(spark, sf_dir).where(F.decode(F.get("frames", F.lit(1)), "UTF-8") == msg_type)
    return rows.select("sender", F.col("event_id").alias("request_id"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts and suppliers."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")
    )


def generated_heartbeats(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Synthetic heartbeats of demo workers, the same for the same seed."""
    number = lambda k, low, n: (F.floor(F.rand(seed + k) * n) + low).cast("string")
    return spark.range(rows).select(
        F.concat(F.lit("Worker-"), number(0, 1000, 9000)).alias("worker"),
        (F.lit(1_700_000_000) + F.col("id")).alias("sent_at"),
        F.lit("DEMO").alias("service"),
        number(1, 1000, 9000).alias("port"),
        number(2, 0, 25).alias("x"),
        number(3, 0, 25).alias("y"),
    )


def topic(messages: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Messages whose topic starts with ``prefix``; the empty prefix takes all."""
    return messages.where(F.col(column).startswith(prefix)) if prefix else messages
