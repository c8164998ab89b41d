"""Shared building blocks: durable checkpoints, global order, top-k."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if folder is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: later jobs read it, and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read that from now on."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with costly columns worked out once per row.

    A plain column is copied into every later filter and projection that reads it; the output of a
    generator is not, and a filter on it stays above.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*[c for c in df.columns if c not in columns], F.inline(one))


def ordered_scan(
    df: DataFrame, order: list[str], groups: list[str] | None = None, sums: dict[str, str] | None = None
) -> DataFrame:
    """Add `rn` (1-based place in `order` within each group) and running sums of earlier rows.

    A window over one huge group would run in one task. Here the rows are range-partitioned by
    (groups, order), numbered inside each partition, and shifted by the totals of the partitions
    before; only those totals (one row per partition and group) pass through a window. `order`
    must be a total order. `sums` maps a new column to the column summed over the rows before.
    """
    groups, sums = groups or [], sums or {}
    keys = [F.col(c) for c in groups + order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    placed = durable(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    )
    inside = W.partitionBy(*groups, "_part").orderBy("_place")
    before_here = inside.rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_rn", F.row_number().over(inside).cast("long"))
    for name, column in sums.items():
        local = local.withColumn(name, F.coalesce(F.sum(column).over(before_here), F.lit(0).cast(df.schema[column].dataType)))
    totals = placed.groupBy(*groups, "_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(column).alias("_t_" + name) for name, column in sums.items()]
    )
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(
        *[F.col(g).alias("_g_" + g) for g in groups], F.col("_part").alias("_of_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum("_t_" + name).over(earlier), F.lit(0)).alias("_s_" + name) for name in sums],
    )
    same = F.col("_part") == F.col("_of_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col("_g_" + g))
    joined = local.join(shift, same)
    out = joined.withColumn("rn", F.col("_rn") + F.col("_shift"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col("_s_" + name))
    extra = ["rn"] + list(sums)
    return out.select(*[c for c in df.columns if c not in extra], *extra)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark keeps only k per group before it shuffles."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def first_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in `order`, as a partial aggregate (no group is collected)."""
    rest = [c for c in df.columns if c not in by and c not in order]
    best = F.min_by(F.struct(*[F.col(c) for c in order + rest]), F.struct(*[F.col(c) for c in order]))
    picked = df.groupBy(*by).agg(best.alias("_best"))
    return picked.select(*by, *[F.col("_best")[c].alias(c) for c in order + rest]).select(*df.columns)
