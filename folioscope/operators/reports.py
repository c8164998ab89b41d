"""Daily reports over the wiki."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.captures import pending
from folioscope.operators.common import ordered_scan
from folioscope.operators.lint import orphans
from folioscope.operators.names import kind_ord


def catalogue(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages in catalogue order with their place in their kind, pages per kind).

    The order is a range-partitioned sort with numbered partitions, so a kind with most of the
    pages is not sorted by one task.
    """
    rows = pages.select(kind_ord("kind").alias("kind_ord"), "kind", T.fold("title").alias("sort_title"), "page_id", "title", "summary")
    placed = ordered_scan(rows, ["sort_title", "page_id"], ["kind_ord", "kind"])
    counts = pages.groupBy("kind").agg(F.count(F.lit(1)).alias("pages"))
    return placed.select("kind", F.col("rn").alias("place"), "page_id", "title", F.coalesce("summary", F.lit("")).alias("summary")), counts


def daily_stats(pages: DataFrame, links: DataFrame, today: date) -> DataFrame:
    """One row of totals. Orphans here ignore aliases, as the report always did."""
    day = F.lit(today)
    kind, page = F.col("kind"), F.col("page_id")
    is_source = kind == "sources"
    totals = pages.agg(
        F.count(page).alias("total"), F.count_if(is_source).alias("sources"), F.count_if(kind == "concepts").alias("concepts"),
        F.count_if(kind == "entities").alias("entities"),
        F.count_if(is_source & (F.col("processed") == day)).alias("processed_today"),
        F.count_if(kind.isin("concepts", "entities") & (F.col("updated") == day)).alias("touched_today"),
        F.count_if(is_source & (F.col("status") == "read")).alias("read"),
    )
    lonely = orphans(pages, links, use_aliases=False).agg(F.count(F.lit(1)).alias("orphans"))
    return totals.withColumn("orphans", lonely.scalar())


def read_on(pages: DataFrame, today: date, key: str = "read") -> DataFrame:
    """Source pages whose `read` (or `processed`) date is today."""
    return pages.filter((F.col("kind") == "sources") & (F.col(key) == F.lit(today))).select(
        "page_id", "title", T.fold("title").alias("sort_title"), "summary", "status"
    )


def revisit(pages: DataFrame, today: date, k: int = 3) -> DataFrame:
    """k older pages, rotating with the date: (page_id, kind, title, place)."""
    dated = pages.withColumn("_day", F.coalesce("processed", "updated"))
    older = dated.filter(F.coalesce(F.col("_day") < F.lit(today), F.lit(True)))
    rows = ordered_scan(
        older.select("kind", T.fold("title").alias("sort_title"), "page_id", "title"), ["kind", "sort_title", "page_id"]
    )
    total = rows.count()
    if not total:
        return rows.select("page_id", "kind", "title", F.col("rn").alias("place"))
    start = (today.toordinal() * k) % total
    places = [((start + i) % total + 1, i + 1) for i in range(min(k, total))]
    wanted = pages.sparkSession.createDataFrame(places, "rn long, place long")
    return rows.join(F.broadcast(wanted), "rn").select("page_id", "kind", "title", "place")  # k rows


def home_counts(pages: DataFrame, queue: DataFrame) -> DataFrame:
    sources = pages.filter(F.col("kind") == "sources")
    waiting = pending(queue, sources).agg(F.count(F.lit(1)).alias("queued"))
    return sources.agg(F.count_if(F.col("status") == "processed").alias("unread")).withColumn("queued", waiting.scalar())


def sync_read_state(pages: DataFrame, daily: DataFrame, today: date) -> DataFrame:
    """Source pages with `status` and `read` brought in line with the ticks of the daily notes.

    A ticked title in any note marks a processed source read; a read source goes back when it is
    unticked, and not ticked, in the note of its own day. `daily(day, body)`.
    """
    ticked = daily.select("day", F.explode(T.find_all("body", r"(?m)^\s*- \[[xX]\] \[\[([^\]|#]+)", 1)).alias("t"), F.lit(True).alias("tick"))
    blank = daily.select("day", F.explode(T.find_all("body", r"(?m)^\s*- \[ \] \[\[([^\]|#]+)", 1)).alias("t"), F.lit(False).alias("tick"))
    marks = ticked.unionByName(blank).withColumn("name", T.fold("t"))
    anywhere = marks.filter("tick").select("name").distinct().withColumn("_ticked", F.lit(True))
    own_day = marks.groupBy("name", F.col("day").alias("processed")).agg(F.bool_or("tick").alias("_own"))
    sources = pages.filter(F.col("kind") == "sources").withColumn("name", T.fold("title"))
    joined = sources.join(anywhere, "name", "left").join(own_day, ["name", "processed"], "left")
    now_read = (F.col("status") == "processed") & F.coalesce("_ticked", F.lit(False))
    status = F.when(now_read, "read").otherwise(F.col("status"))
    back = (status == "read") & ~F.coalesce("_own", F.lit(True))
    return joined.select(
        "page_id", "title", "processed",
        F.when(back, "processed").otherwise(status).alias("status"),
        F.when(back, F.lit(None).cast("date")).when(now_read, F.lit(today)).otherwise(F.col("read")).alias("read"),
    )
