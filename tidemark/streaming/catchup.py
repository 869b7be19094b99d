"""Catching up: sessions kept right while events come in batches, late ones among them, by rebuilding only what a batch can change.

A batch can change an owner's sessions from the one on that its first event may join or follow: the start of that session is
how far history is read back, whatever its length. Everything is append-only, by batch: events (by day), what each batch takes
back (owner, and from when on), and the sessions that stand in their place. A batch that is tried again overwrites its own
folders, so results don't depend on failures, nor on how events are cut into batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sessions import gap_islands


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing is written yet
        return None


def current(spark: SparkSession, path: str, owner: str, before: int | None = None) -> DataFrame | None:
    """The sessions that stand after all batches (before a batch): those that no later batch has taken back."""
    found, cuts = _stored(spark, f"{path}/sessions"), _stored(spark, f"{path}/cuts")
    if found is None:
        return None
    if before is not None:
        found, cuts = found.where(F.col("batch") < before), cuts.where(F.col("batch") < before)
    later = Window.partitionBy(owner).orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    taken = cuts.withColumn("later", F.min("since").over(later)).select(owner, "batch", "later")
    return found.join(taken, [owner, "batch"]).where(F.col("later").isNull() | (F.col("later") > F.col("started_at"))).drop("batch", "later")


def keep_sessions(events: DataFrame, owner: str, tie: str, gap_seconds: float, path: str) -> DataFrame:
    """Runs a stream of events (owner, ts, tie) to its end and gives the sessions of all of them: owner, started_at, ended_at, n.

    Events of one owner, time and tie are one event.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        day = F.to_date("ts")
        batch.dropDuplicates([owner, "ts", tie]).select(owner, "ts", tie, day.alias("day")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/events/batch={n}")
        new = spark.read.parquet(f"{path}/events/batch={n}")
        cuts = new.groupBy(owner).agg(F.min("ts").alias("first")).withColumn("since", F.col("first"))
        stand = current(spark, path, owner, n) if n else None
        if stand is not None:
            reaches = F.unix_micros("ended_at") >= F.unix_micros("first") - int(gap_seconds * 1e6)
            touched = cuts.select(owner, "first").join(stand, owner).where(reaches).groupBy(owner).agg(F.min("started_at").alias("began"))
            cuts = cuts.join(touched, owner, "left").withColumn("since", F.least("first", F.coalesce("began", "first")))
        cuts.select(owner, "since").write.mode("overwrite").parquet(f"{path}/cuts/batch={n}")
        cuts = spark.read.parquet(f"{path}/cuts/batch={n}")
        first_day = cuts.agg(F.min(F.to_date("since"))).first()[0]
        if first_day is None:
            return
        # Days before the first one that any owner needs are not read.
        history = spark.read.parquet(f"{path}/events").where((F.col("batch") <= n) & (F.col("day") >= F.lit(first_day)))
        around = history.join(cuts, owner).where(F.col("ts") >= F.col("since")).dropDuplicates([owner, "ts", tie])
        islands = gap_islands(around, [owner], "ts", tie, gap_seconds)
        rebuilt = islands.groupBy(owner, "island").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n")).drop("island")
        rebuilt.write.mode("overwrite").parquet(f"{path}/sessions/batch={n}")

    events.select(owner, "ts", tie).writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    found = current(spark, path, owner)
    if found is None:
        kind = events.schema[owner].dataType.simpleString()
        return spark.createDataFrame([], f"{owner} {kind}, started_at timestamp, ended_at timestamp, n long")
    return found.select(owner, "started_at", "ended_at", "n")
