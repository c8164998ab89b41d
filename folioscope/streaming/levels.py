"""Batches of a stream kept as runs of a few levels, so that a reader opens a bounded number of folders.

Batch b writes run b of level 0. When the last of `fanout` neighbouring runs of a level is there, they are folded into one run of the next
level. The runs that hold the batches before n are the digits of n in base `fanout`: at most fanout - 1 a level. Which runs are read and
which folds are due follows from the batch number alone, so a batch that is tried again reads and overwrites the same folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = tuple[int, int]  # level, number


def runs_before(n: int, fanout: int) -> list[Run]:
    """The runs that together hold batches 0 to n - 1, oldest first."""
    out, level = [], 0
    while n:
        out += [(level, number) for number in range(n - 1, n - n % fanout - 1, -1)]
        n, level = n // fanout, level + 1
    return out[::-1]


def folds_after(batch_id: int, fanout: int) -> list[tuple[Run, list[Run]]]:
    """The folds that batch `batch_id` makes due, lowest level first: (new run, the runs it takes the place of)."""
    out, n, level = [], batch_id + 1, 0
    while n and n % fanout == 0:
        out.append(((level + 1, n // fanout - 1), [(level, number) for number in range(n - fanout, n)]))
        n, level = n // fanout, level + 1
    return out


def folder(path: str, table: str, run: Run) -> str:
    return f"{path}/{table}/level={run[0]}/run={run[1]}"


def read_runs(spark: SparkSession, path: str, table: str, runs: list[Run], schema: str) -> DataFrame:
    """The rows of the given runs; none are an empty table."""
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[folder(path, table, run) for run in runs])


def write_run(df: DataFrame, path: str, table: str, run: Run) -> None:
    df.write.mode("overwrite").parquet(folder(path, table, run))


def fold(spark: SparkSession, path: str, batch_id: int, fanout: int, write: Callable[[Run, list[Run]], None]) -> None:
    """Write the runs that `batch_id` completes. Folded runs stay until retention removes them; nothing reads them any more."""
    for new, old in folds_after(batch_id, fanout):
        write(new, old)


def write_head(spark: SparkSession, path: str, batch_id: int, schema: str, values: tuple) -> None:
    """What readers start from: numbers, all of type long. Two heads are written in turn, so the one before stays whole while this one is written."""
    names = ["batch", *[c.strip().split(" ")[0] for c in schema.split(",")]]
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in zip(names, (batch_id, *values), strict=True)])
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/head/slot={batch_id % 2}")


def read_head(spark: SparkSession, path: str, schema: str, before: int | None = None) -> dict | None:
    """The newest head, or that of the batch before `before`. At most two rows are read."""
    if before == 0:
        return None
    slots = "*" if before is None else str((before - 1) % 2)
    rows = spark.read.schema(f"batch long, {schema}").parquet(f"{path}/head/slot={slots}").collect()
    heads = [r.asDict() for r in rows if before is None or r["batch"] == before - 1]
    if before is not None and not heads:
        raise ValueError(f"no head of batch {before - 1} under {path}")
    return max(heads, key=lambda r: r["batch"], default=None)
