"""The log of sent messages: rows, byte totals, and the text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.functions.codecs import bytes_text, total_bytes

#: Fixed value: the header of a log file.
HEADER = "recipient,id,time,size"
#: Messages of more frames than this are logged with recipient, type and id.
MANY_FRAMES = 4


def entries(messages: DataFrame) -> DataFrame:
    """A row for each message (frames, time_ms) with more than ``MANY_FRAMES`` frames: recipient, msg_type,
    msg_id, time_ms, total_bytes; for shorter ones only the last two and the list of frames as text are known."""
    text = lambda i: F.decode(F.get("frames", F.lit(i)), "UTF-8")
    long = F.size("frames") > MANY_FRAMES
    shown = F.concat(F.lit("["), F.array_join(F.transform("frames", bytes_text), ", "), F.lit("]"))
    return messages.select(
        F.when(long, text(0)).alias("recipient"),
        F.when(long, text(1)).alias("msg_type"),
        F.when(long, text(2)).alias("msg_id"),
        F.when(~long, shown).alias("frames_text"),
        "time_ms",
        total_bytes(F.col("frames")).alias("total_bytes"),
    )


def lines(entries: DataFrame) -> DataFrame:
    """The text line of each row."""
    start = F.coalesce(F.concat_ws(",", "recipient", "msg_type", "msg_id").try_cast("string"), F.lit(""))
    first = F.when(F.col("recipient").isNull(), F.col("frames_text")).otherwise(start)
    return entries.select(F.concat_ws(",", first, F.col("time_ms").cast("string"), F.col("total_bytes").cast("string")).alias("value"))


def with_header(lines: DataFrame) -> DataFrame:
    """The header line before the others, as an empty log file gets it."""
    return lines.sparkSession.range(1).select(F.lit(HEADER).alias("value")).unionAll(lines)


def worker_lines(messages: DataFrame) -> DataFrame:
    """The log of a worker (recipient, time_s, frames): the frames as a list, and for a message of one frame a
    second line with its length."""
    shown = F.concat(F.lit("["), F.array_join(F.transform("frames", lambda f: F.decode(f, "UTF-8")), ", "), F.lit("]"))
    made: Column = F.concat_ws(",", "recipient", F.col("time_s").cast("string"), shown)
    single = F.concat_ws(",", "recipient", F.col("time_s").cast("string"), F.octet_length(F.get("frames", F.lit(0))).cast("string"))
    both = F.when(F.size("frames") == 1, F.array(made, single)).otherwise(F.array(made))
    return messages.select(F.explode(both).alias("value"))


def totals(messages: DataFrame, by: str) -> DataFrame:
    """Messages and bytes sent, by a column."""
    return messages.groupBy(by).agg(F.count(F.lit(1)).alias("messages"), F.sum(total_bytes(F.col("frames"))).cast("bigint").alias("total_bytes"))


def write(log: DataFrame, path: str) -> None:
    """Append rows as CSV, each file with a header."""
    log.write.mode("append").option("header", True).csv(path)
