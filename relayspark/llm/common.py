"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters whose case the contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A broadcast side may hold this many bytes; beyond it, operators take a shuffled join.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of one Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_ROOT = str(Path(__file__).resolve().parents[2])


#: Folders that ``shared_dir`` has named, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared folder (``spark.checkpoint.dir``).

    Where that setting is absent, a folder of this machine is chosen and remembered if all runs on it (local
    tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="relayspark-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/relayspark/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(context.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables and files of this application; results that still read them are lost."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        discard(spark, path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``stored``, for a table that the result reads."""
    return stored(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def python_ready(spark: SparkSession) -> None:
    """Prepare a session for the Arrow operators: bounded batches, and workers that find this package."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    # Workers outlive their stage; with one arena and the system's pool they give back what they freed.
    env["MALLOC_ARENA_MAX"], env["ARROW_DEFAULT_MEMORY_POOL"] = "1", "system"
    # One thread for each task: tasks are the unit of parallelism.
    env["TOKENIZERS_PARALLELISM"] = "false"
    env["RAYON_NUM_THREADS"] = env["OMP_NUM_THREADS"] = env["OPENBLAS_NUM_THREADS"] = "1"
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is right for text that is all ASCII, and faster than ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once a row however often ``body`` and its lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Numbers of an array that ``running`` takes together.
RUN = 128


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b, start: int = 0) -> Column:
    """For each int of an array, ``merge`` of ``start`` and all ints before it. Appending to an array copies it, so
    blocks are merged first, then each block on its own: about n * RUN / 2 copies for n ints, and few for most."""
    first = F.lit(start).cast("int")

    def scan(items: Column, begin: Column) -> Column:
        states = F.aggregate(items, F.array(begin).cast("array<int>"), lambda a, x: F.array_append(a, merge(F.element_at(a, -1), x).cast("int")))
        return F.slice(states, F.lit(1), F.size(items))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda b: F.slice(v, b * RUN + 1, F.lit(RUN)))

    def by_block(parts: Column) -> Column:
        totals = F.transform(parts, lambda x: F.aggregate(x, first, lambda a, v: merge(a, v).cast("int")))
        return let(scan(totals, first), lambda bases: F.flatten(F.transform(parts, lambda x, k: scan(x, F.get(bases, k)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), by_block)).otherwise(F.array().cast("array<int>")))


#: Code points of the pieces that ``pieces_of`` cuts a text into.
PIECE = 1024


def pieces_of(text: Column) -> Column:
    """A text as pieces of ``PIECE`` code points: a place deep in a long text is found without counting from its
    start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` (from 0) to before ``end`` of a text that ``pieces_of`` has cut."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    rest = (start % PIECE + 1).cast("int")
    one = F.substring(F.get(pieces, a), rest, (end - start).cast("int"))
    many = F.concat(
        F.substring(F.get(pieces, a), rest, F.lit(PIECE)),
        F.array_join(F.slice(pieces, a + 2, b - a - 1), ""),
        F.substring(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), (end % PIECE).cast("int")),
    )
    return F.when(start >= end, F.lit("")).when(a == b, one).otherwise(many)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (cheap to count) has a proven size below ``limit``."""
    return df.count() * row_bytes <= limit


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows, else as it is (shuffled join)."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df
