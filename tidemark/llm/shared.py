"""What the operators share: work tables in the cluster's shared folder, checked broadcasts, text checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Set while a work table is written: Spark then removes the shuffle files of that write as soon as it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a
    local one; a cluster is refused, as its machines would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints/tidemark"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class WorkTables:
    """Intermediate results written as Parquet in the shared folder, so that no lineage hangs on executors that may be lost."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        self._live: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df and returns a frame that reads it back. Its shuffle files go when the write has ended."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        before = self.spark.conf.get(_SHUFFLE_CLEANUP, None)
        self.spark.conf.set(_SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(_SHUFFLE_CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.work_path = path
        self._live.add(path)
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(kept.work_path)

    def only(self, *kept: DataFrame) -> None:
        """Deletes all tables but these, which a result still reads."""
        for path in self._live - {k.work_path for k in kept}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._live.discard(name)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks df for broadcast only if it has at most max_rows rows; beyond that Spark joins it by a shuffle.

    df must be cheap to count, such as a work table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def looked_up(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """rows with values' columns of their `key`, one row each, inner. values: v (the key), hub (boolean), other columns.

    Keys marked as hubs, of which there must be a bounded number, are broadcast, so that their many rows stay where they
    are; the rows of all other keys are joined by a shuffle.
    """
    hubs, others = (values.where(c).drop("hub").withColumnRenamed("v", key) for c in ("hub", "not hub"))
    return rows.join(F.broadcast(hubs), key).unionByName(rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key))


def least_hashed(rows: DataFrame, groups: list[str], key: str, k: int) -> DataFrame:
    """Of every group the k rows with the least hashes of `key` (ties by key), numbered by `rank` from 1: a bounded sample.
    Without groups the k rows of all with the least hashes.

    From the groups' counts follows a bound below which about 4 k rows of each lie (fewer than k with a probability under
    1e-9 if keys differ and k is 24 or more); only these are dealt out by group.
    """
    share = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    if not groups:
        return rows.where(share * rows.count() <= 4 * k).orderBy(share, key).limit(k)
    counts = rows.groupBy(*groups).agg(F.count("*").alias("_n"))
    few = rows.join(broadcast_if_small(counts, 100_000), groups).where(share * F.col("_n") <= 4 * k).drop("_n")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(share, key)))
    return ranked.where(F.col("rank") <= k)


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows whose crc32(key as text) is divisible by 5: no labels are learnt from them."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 5 == 0


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
