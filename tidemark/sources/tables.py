"""Readers and writers. Every reader declares its schema; every writer makes a new snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce
from threading import Timer

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a local one; a
    cluster is refused, as its machines would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or "file:///tmp/checkpoints/tidemark").rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows. df must be cheap to count, such as a kept table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read_csv(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """A CSV file with a header: all strings, trimmed, missing values empty. Columns beyond those named become the map `facets`."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    clean = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))
    known = [*required, *optional]
    other = [c for c in raw.columns if c not in known]
    facets = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, other)), F.array(*map(clean, other))), lambda _, v: v != "") if other else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return raw.select(*(clean(c).alias(c) if c in raw.columns else F.lit("").alias(c) for c in known), facets.alias("facets"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown pages with front matter between lines of three dashes: path, url, title, body."""
    whole = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    return whole.select("path", field("url").alias("url"), field("title").alias("title"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def zipped_arrays(spark: SparkSession, **columns: list) -> DataFrame:
    """Parallel arrays as rows, like unnest of several array parameters."""
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), names)


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """target and those rows of new whose key it lacks; of rows of one key in new, one."""
    fresh = new.dropDuplicates(key).join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, new: DataFrame, key: list[str], keep_existing: list[str] = (), merge_maps: list[str] = ()) -> DataFrame:
    """New values win, but for keep_existing (the old value if there is one) and merge_maps (both, new entries win)."""
    t, n = target.alias("t"), new.alias("n")
    joined = t.join(n, reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"n.{k}") for k in key)), "full_outer")

    def value(c: str) -> Column:
        old, fresh = F.col(f"t.{c}"), F.col(f"n.{c}")
        if c in merge_maps:
            empty = F.create_map().cast(target.schema[c].dataType)
            kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(fresh, empty)), k))
            return F.map_concat(kept, F.coalesce(fresh, empty))
        return F.coalesce(old, fresh) if c in keep_existing else F.coalesce(fresh, old)

    return joined.select(*(value(c).alias(c) for c in target.columns))


def replace_groups(target: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Every group that new has rows of is replaced as a whole."""
    return target.join(new.select(*group).distinct(), group, "left_anti").unionByName(new.select(*target.columns))


def write_groups(df: DataFrame, path: str, group: str, buckets: int = 64) -> None:
    """Writes by bucket of a group key; only buckets that df has are overwritten."""
    df.withColumn("bucket", F.pmod(F.xxhash64(group), F.lit(buckets))).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Writes a table anew; nothing of the one before is left."""
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_pages(df: DataFrame, path: str, page: str, text: str) -> None:
    """One folder for each page, with its text as lines. page: a name that may be a folder's."""
    df.select(F.col(page).alias("page"), F.col(text).alias("value")).repartition("page").write.mode("overwrite").partitionBy("page").text(path)


LEDGER = "job string, trigger string, status string, rows long, notes string, error string, started timestamp, finished timestamp"


def record_run(spark: SparkSession, ledger: str, job: str, run: Callable[[], DataFrame], trigger: str = "manual", notes: str | None = None) -> str:
    """Runs a job and appends one row on it to the ledger, whether it succeeds or not; gives its status.

    The rows that run returns are written beside the ledger, and counted while they are.
    """
    started, status, rows, error = datetime.now(timezone.utc), "ok", None, None
    try:
        seen = Observation()
        run().observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{ledger}-{job}")
        rows = seen.get["rows"]
    except Exception as e:  # any failure of a job is a row of the ledger
        status, error = "failed", f"{type(e).__name__}: {e}"
    row = (job, trigger, status, rows, notes, error, started, datetime.now(timezone.utc))
    spark.createDataFrame([row], LEDGER).write.mode("append").parquet(ledger)
    return status


def read_registry(spark: SparkSession, registry: str, root: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """The lists that a registry file (columns slug and file, one row for each list) names, as one table with the slug; places follow the lines of each file."""
    entries = read_csv(spark, registry, ["slug", "file"]).select("slug", "file").collect()  # one row for each list file
    lists = [read_csv(spark, f"{root.rstrip('/')}/{e.file}", required, optional).withColumn("slug", F.lit(e.slug)) for e in entries]
    return reduce(DataFrame.unionByName, lists)


def delete_orphans(target: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    return target.join(parents, key, "left_semi")


def remap_ids(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replaces ids by a map (old_id, new_id); ids without an entry, and all but the first row of each new id, become null."""
    joined = rows.join(mapping, rows[column] == mapping["old_id"], "left").drop("old_id")
    first = F.row_number().over(Window.partitionBy("new_id").orderBy(F.col(column).asc_nulls_last())) == 1
    return joined.withColumn(column, F.when(first, F.col("new_id"))).drop("new_id")


def general_number(c: Column) -> Column:
    """A number with six significant digits at most, no zeros at the end, and an exponent where it is very large or small."""
    shown = F.format_string("%.6g", c.cast("double"))
    bare = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(e[+-]\d+)?$", "$1$2"), r"\.(?=e|$)", "")
    return F.when(c == 0, "0").otherwise(bare)


def as_tsv(df: DataFrame) -> DataFrame:
    """Rows as one line each: tabs and line ends in values become blanks, nulls are empty, timestamps end at seconds, fractions have
    six digits."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind in ("double", "float"):
            c = general_number(c)
        return F.coalesce(F.translate(c.cast("string"), "\t\r\n", "   "), F.lit(""))

    return df.select(F.concat_ws("\t", *(shown(n, k) for n, k in df.dtypes)).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as one object each, with every column, null or not."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


#: Functions that call methods of the driver or the executors by name.
_REFLECTION = {"reflect", "java_method", "try_reflect"}


def _parsed(spark: SparkSession, statement: str) -> Iterator:
    """All nodes of a statement's parsed plan, with what stands in its subqueries. The parser refuses several statements."""
    plans = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    listed = lambda held: [held.apply(i) for i in range(held.size())]
    while plans:
        plan = plans.pop()
        yield plan
        plans += [*listed(plan.children()), *listed(plan.innerChildren())]


def _refusal(spark: SparkSession, statement: str) -> str | None:
    """Why a statement is not read only: a command, a function that calls into the machine, or a relation that is no view or
    table of the session (such as a path)."""
    jvm = spark._jvm
    class_of = lambda k: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{k}")
    commands = [class_of(f"plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    relation, function, with_ = class_of("analysis.UnresolvedRelation"), class_of("analysis.UnresolvedFunction"), class_of("plans.logical.UnresolvedWith")
    names, own = [], set()
    for plan in _parsed(spark, statement):
        if any(kind.isInstance(plan) for kind in commands):
            return "one SELECT statement only"
        if with_.isInstance(plan):
            own |= {plan.cteRelations().apply(i)._1().lower() for i in range(plan.cteRelations().size())}
        if relation.isInstance(plan):
            names.append([plan.multipartIdentifier().apply(i) for i in range(plan.multipartIdentifier().size())])
        held = [plan.expressions().apply(i) for i in range(plan.expressions().size())]
        while held:
            e = held.pop()
            held += [e.children().apply(i) for i in range(e.children().size())]
            if function.isInstance(e) and e.nameParts().last().lower() in _REFLECTION:
                return "functions that call methods by name are refused"
    for parts in names:
        if not (len(parts) == 1 and parts[0].lower() in own) and not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts)):
            return f"{'.'.join(parts)} is no view or table of this session"
    return None


def read_only(spark: SparkSession, sql: str, limit: int = 1000, seconds: float = 10.0) -> tuple[DataFrame, bool]:
    """One read-only statement, at most limit rows, and whether there were more; it is stopped after so many seconds."""
    if refused := _refusal(spark, sql):
        raise ValueError(refused)
    group, context = f"read-only-{uuid.uuid4().hex}", spark.sparkContext
    timer = Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        context.setJobGroup(group, "read-only statement", interruptOnCancel=True)
        found = spark.sql(sql).limit(limit + 1)
        rows = found.collect()  # limit + 1 rows at most
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return spark.createDataFrame(rows[:limit], found.schema), len(rows) > limit
