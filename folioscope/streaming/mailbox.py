"""Mail intake as a stream whose high-water mark is state: the largest uid taken from each mailbox, valid for its generation only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import mail as M
from folioscope.operators.common import durable

MARKS = "mailbox string, generation string, last_uid long, fetch long"


def take(batch: DataFrame, marks: DataFrame, days: int = 14) -> tuple[DataFrame, DataFrame]:
    """One fetch: (mails taken, marks after it).

    `batch(mailbox, generation, fetch, fetched, uid, received, seen, ...)`, `marks(mailbox, generation, last_uid, fetch)`. A mail is taken that
    was received within `days` of the day it was fetched, or is unseen, or has a uid above the mark of its mailbox. A mark counts only
    for the generation it was set in. The new mark of a mailbox is the largest uid taken in its newest generation, and never falls while
    that stays. Rows without a mailbox are a mailbox of their own. Marks are one row per mailbox, by aggregates: no mailbox is gathered.
    """
    marked = marks.select("mailbox", F.col("generation").alias("_generation"), F.col("last_uid").alias("_uid"), F.col("fetch").alias("_fetch"))
    old = batch.join(marked, batch["mailbox"].eqNullSafe(marked["mailbox"]), "left").drop(marked["mailbox"])
    valid = F.col("generation").eqNullSafe(F.col("_generation")) & F.col("generation").isNotNull()
    fresh = F.col("received") >= F.date_sub("fetched", days)
    wanted = fresh | ~F.col("seen") | (valid & (F.col("uid") > F.col("_uid")))
    taken = old.filter(F.coalesce(wanted, F.lit(False))).drop("_generation", "_uid", "_fetch")
    tops = taken.filter("generation is not null").groupBy("mailbox", "generation").agg(F.max("uid").alias("last_uid"), F.max("fetch").alias("fetch"))
    # the newest generation of a mailbox wins; within it the largest uid
    every = tops.select("mailbox", "generation", "last_uid", "fetch").unionByName(marks)
    newest = every.groupBy("mailbox").agg(F.max_by("generation", "fetch").alias("_now"))
    same = every.join(newest, every["mailbox"].eqNullSafe(newest["mailbox"])).drop(newest["mailbox"]).filter(F.col("generation") == F.col("_now"))
    after = same.groupBy("mailbox", "generation").agg(F.max("last_uid").alias("last_uid"), F.max("fetch").alias("fetch"))
    return taken, after


def maintain_mailboxes(mail: DataFrame, path: str, checkpoint: str, days: int = 14):
    """A stream of fetched mails: each micro-batch writes what it takes under `taken` and the marks after it under `marks`.

    A batch starts from the marks that the batch before it wrote, under that batch's number: a batch that runs again reads the same marks
    and overwrites its own folders, so mails are taken once however often it is tried.
    """
    spark = mail.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        marks = spark.read.schema(MARKS).parquet(f"{path}/marks/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], MARKS)
        batch = durable(batch)
        taken, after = take(batch, marks, days)
        taken.write.mode("overwrite").parquet(f"{path}/taken/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return mail.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def new_mails(spark: SparkSession, path: str, schema, message_id: Column | str = "message_id", raw: Column | str = "raw") -> DataFrame:
    """The taken mails as a stream, each id once for ever: overlapping windows take a mail again and again. `source` is the id."""
    taken = spark.readStream.schema(schema).parquet(f"{path}/taken/*")
    return taken.withColumn("source", M.mail_id(message_id, raw)).dropDuplicates(["source"])
