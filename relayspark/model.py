"""Schemas of the engine's tables. Fields cross its borders as text and are typed inside."""

from __future__ import annotations

HEARTBEAT = "worker STRING, sent_at BIGINT, service STRING, port STRING, x STRING, y STRING, arrived_at TIMESTAMP_NTZ, arrival BIGINT"
MESSAGE = "sender STRING, frames ARRAY<BINARY>"
TASK = "task_id BIGINT, time DOUBLE, pipeline ARRAY<STRING>"
HOP = "task_id BIGINT, hop INT, worker STRING, next_worker STRING, remaining INT"
SEND_LOG = "recipient STRING, msg_type STRING, msg_id STRING, time_ms BIGINT, total_bytes BIGINT"
PEER = "self STRING, peer STRING, port STRING"

#: The wire form of a heartbeat's payload.
HEARTBEAT_JSON = "sentAt BIGINT, service STRING, port STRING, x STRING, y STRING"
#: The key prefix of workers, and the seconds a worker takes for one task.
WORKER_PREFIX = "Worker-"
SERVICE_SECONDS = 0.5
