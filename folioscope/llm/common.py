"""What the operators of this package share: stored tables, files in the shared folder, worker state, connected components."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.common import checkpoint_dir, durable

#: Words are runs of anything but the six ASCII white-space characters.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Rows of two or three numbers that make a task worth its start.
TASK_ROWS = 1 << 14


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir` (set only where it is unset) that driver and executors both reach."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or checkpoint_dir(spark)
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()  # tasks may have another default
    full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    return f"{full.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder once and read it from there: later steps don't run it again, and lost executors lose nothing."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def file_system(uri: str):
    """Arrow's file system and the path in it, for tasks that write or read files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Write one file so that a task that runs twice leaves one whole file: under a name of this attempt, then renamed."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    system.move(attempt, path)


def read_file(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def per_worker(kind: str, key: str, make):
    """State that a Python worker makes once and keeps for its later tasks (functions travel by value, so module globals don't stay).

    A worker keeps one state of each kind: another key replaces it.
    """
    kept = sys.__dict__.setdefault("_folioscope_llm", {})
    if kind not in kept or kept[kind][0] != key:
        kept.pop(kind, None)
        kept[kind] = (key, make())
    return kept[kind][1]


def forget_workers() -> None:
    """Drop what earlier stages left in this worker: their models would take memory from the stage at hand."""
    sys.__dict__.pop("_folioscope_llm", None)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s"), F.sum(F.xxhash64("b", "a") % 998_244_353).alias("t")).first()
    return tuple(row)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df` of about `rows` rows in no more partitions than these fill, at least eight: a round over few rows then has few tasks and files.

    Nothing is shuffled, and a table that fills its partitions stays as it is.
    """
    return df.coalesce(max(8, rows // TASK_ROWS + 1))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph of `edges` (a, b: long): one row (node, root) per node, root the least node it reaches.

    Alternating stars: every node hands its larger neighbours to its least one, then its smaller ones. Each round is two aggregates
    that combine before the shuffle and two joins against one row per node, so a node with very many neighbours is never gathered;
    rounds grow with the logarithm of the longest path. Null ends are left out. A round has as many tasks as its rows fill.
    """

    def large(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")

    def small(e):
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return rest.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    now = durable(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while (seen := _signature(now)) != before:
        before, n = seen, seen[0]
        now = durable(few_tasks(small(few_tasks(large(few_tasks(now, n)), n)), n))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
