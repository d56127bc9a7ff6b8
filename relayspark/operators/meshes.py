"""Sets of workers that tasks connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.session import shared_path


def connected(tasks: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``tasks`` (task_id, time, pipeline) with ``mesh``: the smallest name of a worker that its workers are connected
    to by tasks. A column named ``mesh`` is replaced. Tasks without workers get a null mesh.

    Rounds pass the smallest name known from tasks to their workers and back, until none changes; a worker then
    takes its name's own name, too, so paths halve. Workers, not tasks, are few; each round's names are written to
    the shared folder. Raises after ``most_rounds``."""
    spark = tasks.sparkSession
    seats = tasks.select("task_id", F.explode(F.array_distinct("pipeline")).alias("worker"))
    pairs = tasks.select(F.array_min("pipeline").alias("least"), F.explode(F.array_distinct("pipeline")).alias("worker")).where("least <> worker").distinct()
    path = shared_path(spark, "mesh-pairs")
    pairs.write.parquet(path)
    pairs = spark.read.parquet(path)
    both = pairs.unionByName(pairs.select(F.col("worker").alias("least"), F.col("least").alias("worker")))
    names = seats.select("worker").distinct().withColumn("mesh", F.col("worker"))
    for _ in range(most_rounds):
        path = shared_path(spark, "mesh")
        heard = both.join(names.withColumnRenamed("worker", "least"), "least").groupBy("worker").agg(F.min("mesh").alias("heard"))
        after = names.join(heard, "worker", "left").select("worker", "mesh", F.least("mesh", F.coalesce("heard", "mesh")).alias("now"))
        named = names.select(F.col("worker").alias("now"), F.col("mesh").alias("further"))
        after = after.join(named, "now", "left").select("worker", F.least("now", "further").alias("mesh"), (F.least("now", "further") < F.col("mesh")).alias("changed"))
        after.write.parquet(path)
        after = spark.read.parquet(path)
        names = after.select("worker", "mesh")
        if after.where("changed").isEmpty():
            first = F.get("pipeline", F.lit(0))
            return tasks.drop("mesh").withColumn("__first", first).join(names.withColumnRenamed("worker", "__first"), "__first", "left").drop("__first")
    raise RuntimeError("meshes have not settled")
