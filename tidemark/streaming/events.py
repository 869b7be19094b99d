"""Event streams: late duplicates, sessions, counters kept as state, rebuilding what a batch has touched.

Streams are read from files and end when all present files are read (availableNow); the same plans run continuously with
another trigger. Results are written to a folder by batch, so a batch that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_folder, write_groups


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the files of a table (a folder or one file), with the table's schema and event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    head, last = path[:-1], path[-1]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}[{last}]")  # a glob may name a file
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it has written."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(each or write).start()).awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{root}/out/*")
    except AnalysisException:  # no batch came
        return spark.createDataFrame([], stream.schema)


def dedup(events: DataFrame, key: list[str], late: str = "3 days") -> DataFrame:
    """Each key once, as long as its copies come no later than this."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, owner: str, gap: str, late: str) -> DataFrame:
    """A session is given out once the watermark has passed its end; corrections after that are the batch job's."""
    found = events.withWatermark("ts", late).groupBy(owner, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return found.select(owner, "started_at", "ended_at", "n")


def windows(events: DataFrame, key: str, length: str, slide: str, late: str) -> DataFrame:
    """Counts in sliding windows; an addition, the surveyed system has none."""
    counted = events.withWatermark("ts", late).groupBy(key, F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n")


def count_misses(events: DataFrame, key: str, hit: str, limit: int) -> DataFrame:
    """Per key and batch: how many events in a row were no hit, carried over batches; cancelled at the limit. `seen` counts the
    key's events so far, so that the row with the most is the last one."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed, seen_before = state.get if state.exists else (0, 0)
        rows = pd.concat(frames).sort_values("ts")["hit"].tolist()
        for seen in rows:
            missed = 0 if seen else missed + 1
        state.update((missed, seen_before + len(rows)))
        yield pd.DataFrame({key: [k[0]], "missed": [missed], "cancelled": [missed >= limit], "seen": [seen_before + len(rows)]})

    flagged = events.select(key, "ts", F.expr(hit).alias("hit"))
    return flagged.groupBy(key).applyInPandasWithState(step, f"{key} long, missed long, cancelled boolean, seen long", "missed long, seen long", "append", GroupStateTimeout.NoTimeout)


def rebuild_touched(events: DataFrame, history: DataFrame, owner: str, rebuild: Callable[[DataFrame], DataFrame], path: str, buckets: int = 64) -> None:
    """For every batch, results of the owners it touches are made anew from history and replace their buckets.

    A bucket is what one batch rewrites at least: as many are wanted as keep it small (a thousandth of all owners, say).
    """

    def each(batch: DataFrame, _: int) -> None:
        bucket = F.pmod(F.xxhash64(owner), F.lit(buckets))
        touched = batch.select(bucket.alias("_b")).distinct()  # `buckets` numbers at most
        write_groups(rebuild(history.withColumn("_b", bucket).join(F.broadcast(touched), "_b", "left_semi").drop("_b")), path, owner, buckets)

    run = events.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(each).start()
    run.awaitTermination()


def place_around(events: DataFrame, history: DataFrame, owner: str, place: Callable[[DataFrame], DataFrame], path: str, lookback: str = "1 day") -> DataFrame:
    """For every batch: only the history of its owners from so long before the batch's first event on is placed again.

    Each batch writes its own folder, so a batch that is tried again replaces what it wrote; later batches count.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        since = batch.groupBy(owner).agg((F.min("ts") - F.expr(f"interval {lookback}")).alias("_since"))
        around = history.join(since, owner).where(F.col("ts") >= F.col("_since")).drop("_since")
        place(around).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    events.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return spark.read.parquet(path)


def retracted(stored: DataFrame, upstream: DataFrame, key: list[str], since, until) -> DataFrame:
    """Stored events of a span that upstream no longer has. A batch job: append sinks can't take rows back."""
    span = (F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until))
    return stored.where(span).join(upstream.where(span).select(*key), key, "left_anti")


def may_start(runs: DataFrame, now, pause: str = "5 minutes", stale: str = "1 hour") -> DataFrame:
    """Per job: whether it may start (nothing started within the pause, nothing runs), and how many runs are stale, that is
    unfinished for too long and so no longer count as running. runs: job, started, finished."""
    at, open_ = F.lit(now), F.col("finished").isNull()
    fresh = F.col("started") > at - F.expr(f"interval {pause}")
    dead = open_ & (F.col("started") <= at - F.expr(f"interval {stale}"))
    found = runs.groupBy("job").agg(F.bool_or(fresh).alias("f"), F.bool_or(open_ & ~dead).alias("r"), F.count_if(dead).alias("stale"))
    return found.select("job", (~F.col("f") & ~F.col("r")).alias("may_start"), "stale")
