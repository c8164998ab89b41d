"""Dropped files as a stream: the contents seen so far are state, so the same bytes under another name in a later batch are a duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.common import durable, first_by
from folioscope.sources.files import classify_drops
from folioscope.streaming import levels as L

FANOUT = 8
SALT = 8
KEPT = "length long, digest string, path string"
VERDICTS = "path string, length long, digest string, verdict string, first_path string"
FILES = "path string, modificationTime timestamp, length long, content binary"


def drop_stream(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """The files that arrive under `folder`, whatever their suffix. Spark's file source lists no file of zero bytes, so such files are not
    seen; `judge_files` itself takes empty contents like others."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def judge_files(files: DataFrame, kept: DataFrame, images: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row per file with its verdict, the contents that are new).

    `files(path, length, content)`, `kept(length, digest, path)`. Verdicts: `unsupported` (a suffix that is not read, or a list without links),
    `duplicate` (the bytes are kept already, or a file with a lesser path brings them in this batch) and `new`. `first_path` is where the
    bytes were kept from. A path that comes twice with the same bytes is one row of each arrival; a file without content has no digest and
    is unsupported. The bytes are digested once, and leave the plan before the first shuffle.
    """
    seen = durable(
        classify_drops(files, images)
        .withColumn("verdict", F.when(F.col("digest").isNull(), "unsupported").otherwise(F.col("verdict")))
        .select("path", F.col("length").cast("long").alias("length"), "digest", "verdict", F.monotonically_increasing_id().alias("_n"))
    )
    usable = seen.filter("verdict <> 'unsupported'")
    known = kept.groupBy("length", "digest").agg(F.min("path").alias("_known"))
    candidates = first_by(usable.select("length", "digest", "path", "_n"), ["length", "digest"], ["path", "_n"]).join(known, ["length", "digest"], "left")
    candidates = durable(candidates.withColumnRenamed("_n", "_first"))
    # one content may be a third of all files: its files are dealt over SALT parts, each with the one row of that content
    first = candidates.select(
        "length", "digest", F.coalesce("_known", "path").alias("first_path"), F.when(F.col("_known").isNull(), F.col("_first")).alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("_salt"),
    )
    judged = usable.withColumn("_salt", F.col("_n") % SALT).join(first, ["length", "digest", "_salt"])
    verdict = F.when(F.col("_n") == F.col("_first"), "new").otherwise("duplicate")
    fresh = candidates.filter("_known is null")
    names = ["path", "length", "digest", "verdict", "first_path"]
    bad = seen.filter("verdict = 'unsupported'").withColumn("first_path", F.lit(None).cast("string"))
    return judged.withColumn("verdict", verdict).select(*names).unionByName(bad.select(*names)), fresh.select("length", "digest", "path")


def take_drops(files: DataFrame, path: str, checkpoint: str, images: bool = False, fanout: int = FANOUT):
    """A stream of files judged batch by batch: verdicts under `verdicts`, contents kept under `kept` in runs that are folded by level.

    A batch reads the contents of the batches before it, under their numbers; run again, it judges alike and overwrites its own folders.
    """
    spark = files.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = L.read_runs(spark, path, "kept", L.runs_before(batch_id, fanout), KEPT)
        judged, fresh = judge_files(batch, kept, images)
        fresh = durable(fresh)
        judged.write.mode("overwrite").parquet(f"{path}/verdicts/batch={batch_id}")
        L.write_run(fresh, path, "kept", (0, batch_id))

        def merge(run: L.Run, old: list[L.Run]) -> None:
            rows = L.read_runs(spark, path, "kept", old, KEPT)
            L.write_run(rows.repartitionByRange("digest").sortWithinPartitions("digest"), path, "kept", run)

        L.fold(spark, path, batch_id, fanout, merge)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Every file judged so far, with the batch it came in."""
    return spark.read.schema(VERDICTS + ", batch int").option("basePath", f"{path}/verdicts").parquet(f"{path}/verdicts/*")
