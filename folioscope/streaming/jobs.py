"""Structured Streaming versions of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.urls import normalize_url
from folioscope.operators import mail as M
from folioscope.operators.captures import MAX_ATTEMPTS
from folioscope.operators.common import durable
from folioscope.operators.pages import due_pages
from folioscope.operators.search import embed_pending, postings


def dedup_stream(captures: DataFrame, ttl: str | None = None, time: str = "added_at") -> DataFrame:
    """Each target once, for ever. With `ttl` the state is bounded: a repeat later than that may pass."""
    normed = captures.withColumn("target_norm", normalize_url("target"))
    if ttl is None:
        return normed.dropDuplicates(["target_norm"])
    return normed.withWatermark(time, ttl).dropDuplicatesWithinWatermark(["target_norm"])


def mail_intake(mail: DataFrame, today: date, last_uid: int | None = None, generation: str | None = None) -> DataFrame:
    """Mails inside the window or past the mark, each id once. The checkpoint is the state file."""
    wanted = M.intake(mail, today, last_uid, generation)
    return wanted.withColumn("source", M.mail_id("message_id", "raw")).dropDuplicates(["source"])


LEDGER = "target_norm string, status string, attempts long"


def retry_ledger(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The status and attempts of each target after the events so far (update mode).

    `events(target_norm, ts, seq, event)`; its batch twin is `captures.queue_state`.
    """

    def follow(status: str, attempts: int, event: str) -> tuple[str, int]:
        if event == "drop" or status == "absent":
            return "absent", 0
        if event == "fail" or (event == "recover" and status == "processing"):
            parked = attempts + 1 >= max_attempts
            return ("failed" if parked else "queued"), min(attempts + 1, max_attempts)
        if event == "claim" and status == "queued":
            return "processing", attempts
        if event == "done":
            return "done", attempts
        if event == "release" and status == "processing":
            return "queued", attempts
        if event == "reset" and status == "failed":
            return "queued", 0
        return status, attempts

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for event in rows["event"]:
            status, attempts = follow(status, int(attempts), event)
        state.update((status, attempts))
        yield pd.DataFrame({"target_norm": [key[0]], "status": [status], "attempts": [attempts]})

    return events.groupBy("target_norm").applyInPandasWithState(
        run, LEDGER, "status string, attempts long", "update", "NoTimeout"
    )


def ops_day_stats(runs: DataFrame, watermark: str = "1 day", at: str = "03:00") -> DataFrame:
    """Runs, tokens and failures per operational day (append mode after the watermark)."""
    hours, minutes = (int(p) for p in at.split(":"))
    offset = f"{hours} hours {minutes} minutes"
    return (
        runs.withWatermark("started", watermark)
        .groupBy(F.window("started", "1 day", "1 day", offset).alias("w"))
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens_used").alias("tokens_used"), F.sum("failed").alias("failed"))
        .select(F.col("w.start").alias("day_start"), "runs", "tokens_used", "failed")
    )


def maintain_index(
    pages: DataFrame, path: str, checkpoint: str, embed_fn: Callable | None = None, identity: str = ""
):
    """A stream of changed pages kept as postings (and vectors): each micro-batch writes its pages'
    rows under its own batch folder, and `current_index` reads the newest rows of every page.

    A batch that is tried again overwrites its own folder, so the sink is idempotent.
    """
    spark = pages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("page_id").agg(
            F.max_by(F.struct(*batch.columns), "changed_at").alias("p")
        ).select("p.*")
        newest.select("page_id", F.lit(batch_id).alias("version"), "deleted").write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")
        live = newest.filter(~F.col("deleted"))
        postings(live).write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
        if embed_fn is not None:
            none = spark.createDataFrame([], "page_id long, embedder string, content_hash string")
            embed_pending(live, none, embed_fn, identity).write.mode("overwrite").parquet(f"{path}/vectors/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def current_index(spark, path: str, table: str = "postings") -> DataFrame:
    """The rows of the newest version of every live page."""
    versions = spark.read.parquet(f"{path}/versions")
    newest = versions.groupBy("page_id").agg(F.max_by(F.struct("version", "deleted"), "version").alias("v"))
    live = newest.filter(~F.col("v.deleted")).select("page_id", F.col("v.version").cast("int").alias("batch"))
    return spark.read.parquet(f"{path}/{table}").join(live, ["page_id", "batch"]).drop("batch")


def due_stream(touched: DataFrame, pages: Callable[[], DataFrame], sources: Callable[[], DataFrame], path: str, checkpoint: str, limit: int):
    """Per micro-batch, the first `limit` pages due among those it touched and those an earlier batch left over (a pacing limit).

    What a batch leaves is written beside its result and offered again by the next one, so every due page comes up.
    """
    spark = touched.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("page_id")
        if batch_id:
            ids = ids.union(spark.read.schema(ids.schema).parquet(f"{path}/left/batch={batch_id - 1}"))
        ids = ids.distinct()
        mine = pages().join(ids, "page_id", "left_semi")
        rows = sources().join(ids, "page_id", "left_semi")
        due = durable(due_pages(mine, rows))
        first = due.orderBy("page_id").limit(limit)
        first.write.mode("overwrite").parquet(f"{path}/due/batch={batch_id}")
        due.select("page_id").join(first.select("page_id"), "page_id", "left_anti").write.mode("overwrite").parquet(f"{path}/left/batch={batch_id}")

    return touched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
