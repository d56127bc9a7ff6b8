"""The wire form of heartbeats and tasks, and plain sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relayspark.model import HEARTBEAT_JSON

#: Fixed value: the type frame of a heartbeat message.
HEARTBEAT_TYPE = "heartbeat"
TASK_JSON = "time DOUBLE, pipeline ARRAY<STRING>"


def heartbeat_messages(beats: DataFrame) -> DataFrame:
    """Heartbeats as messages of three frames: type, identity and a JSON payload. Other columns stay."""
    payload = F.to_json(F.struct(F.col("sent_at").alias("sentAt"), "service", "port", "x", "y"))
    frames = F.array(*[F.encode(c, "UTF-8") for c in (F.lit(HEARTBEAT_TYPE), F.col("worker"), payload)])
    return beats.select(frames.alias("frames"), *[c for c in beats.columns if c not in ("worker", "sent_at", "service", "port", "x", "y")])


def heartbeats_of(messages: DataFrame) -> DataFrame:
    """The reverse: typed heartbeats. Ports and coordinates sent as numbers become text, as the registry holds
    them; quotes around a service name are trimmed; a payload that is no JSON gives null fields."""
    text = lambda i: F.decode(F.get("frames", F.lit(i)), "UTF-8")
    rows = messages.where(text(0) == HEARTBEAT_TYPE).select(text(1).alias("worker"), F.from_json(text(2), HEARTBEAT_JSON).alias("p"), *[c for c in messages.columns if c != "frames"])
    rest = [c for c in messages.columns if c != "frames"]
    return rows.select("worker", F.col("p.sentAt").alias("sent_at"), F.trim(F.col("p.service"), F.lit("'\"")).alias("service"), "p.port", "p.x", "p.y", *rest)


def task_json(tasks: DataFrame) -> DataFrame:
    """A task's payload: the time and the workers to visit, nothing else."""
    return tasks.select("task_id", F.to_json(F.struct("time", "pipeline")).alias("payload"))


def tasks_of(payloads: DataFrame) -> DataFrame:
    return payloads.select("task_id", F.from_json("payload", TASK_JSON).alias("t")).select("task_id", "t.time", "t.pipeline")


def append_text(lines: DataFrame, path: str) -> None:
    """Append raw lines (one string column)."""
    lines.write.mode("append").text(path)


def truncate(table: DataFrame, path: str) -> None:
    """Leave an empty table of the same columns at ``path``."""
    table.where("false").write.mode("overwrite").parquet(path)


def emit(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table until its source is exhausted."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def show(stream: DataFrame) -> StreamingQuery:
    """Print each micro-batch."""
    return stream.writeStream.format("console").trigger(availableNow=True).start()
