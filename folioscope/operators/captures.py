"""The capture queue: dedup, what is known already, retries, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators.common import first_by, ordered_scan

MAX_ATTEMPTS = 3
EVENTS = ("claim", "done", "fail", "release", "recover", "reset", "drop")


def with_target(captures: DataFrame) -> DataFrame:
    return captures.withColumn("target_norm", U.normalize_url("target"))


def dedup_captures(captures: DataFrame, order: list[str]) -> DataFrame:
    """The first capture of each target in `order`, with how many later ones repeat it."""
    normed = with_target(captures)
    first = first_by(normed, ["target_norm"], order)
    counts = normed.groupBy("target_norm").agg((F.count(F.lit(1)) - 1).alias("duplicates"))
    return first.join(counts, "target_norm")


def links_from_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per address in a dropped link file: (key, pos, target)."""
    return docs.select(key, F.posexplode(U.urls_in(text)).alias("pos", "target"))


def import_link_lists(files: DataFrame) -> DataFrame:
    """Dated link lists `files(name, text)`: the first save date of each address wins.

    A `DD-MM-YYYY` name is a date; oddly named files come last. Adds the number of repeats.
    """
    day = F.try_to_timestamp(F.when(F.col("name").rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.col("name")), F.lit("d-M-yyyy"))
    listed = files.select(
        "name", day.cast("date").alias("captured"), F.posexplode(T.find_all("text", r"https?://[^\s\])>]+")).alias("pos", "target")
    )
    ranked = listed.withColumn("undated", F.col("captured").isNull().cast("int"))
    kept = dedup_captures(ranked, ["undated", "captured", "name", "pos"])
    return kept.select("target_norm", "target", "captured", F.lit("legacy").alias("origin"), "duplicates")


def known_docs(new: DataFrame, sources: DataFrame) -> DataFrame:
    """`new(doc_id, url, content_hash)` with the source that already holds it (url first), or NULL."""
    by_url = (
        sources.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min_by("title", "path").alias("title_by_url"))
    )
    by_hash = (
        sources.filter(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.min_by("title", "path").alias("title_by_hash"))
    )
    joined = new.join(by_url, "url", "left").join(by_hash, "content_hash", "left")
    return joined.select(
        *new.columns, F.coalesce("title_by_url", "title_by_hash").alias("existing_title")
    )


def exact_dups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document that has byte-identical copies: (key, content_hash, first, copies).

    Copies are counted before the shuffle, and a group is never gathered: each copy is one row.
    """
    hashed = docs.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    groups = hashed.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return hashed.join(groups, "digest").select(key, F.substring("digest", 1, 16).alias("content_hash"), "first", "copies")


def pending(queue: DataFrame, sources: DataFrame) -> DataFrame:
    """Queued items whose target is not already a source."""
    known = sources.filter(F.col("url").isNotNull()).select(U.normalize_url("url").alias("target_norm")).distinct()
    return queue.filter(F.col("status") == "queued").join(known, "target_norm", "left_anti")


def display_name(target: Column, label: Column) -> Column:
    file_name = F.regexp_extract(target, r"([^/\\]*)$", 1)
    return F.coalesce(F.when(label != "", label), F.when(U.is_url(target), target).otherwise(file_name))


def queue_preview(queue: DataFrame, sources: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the first n pending items by id, the total): a top-n report and one count."""
    waiting = pending(queue, sources)
    first = waiting.orderBy("id").limit(n).select("id", display_name(F.col("target"), F.col("label")).alias("name"))
    return first, waiting.agg(F.count(F.lit(1)).alias("total"))


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def next_batch(queue: DataFrame, n: int, exclude: DataFrame | None = None) -> DataFrame:
    """The n oldest queued items, minus the excluded ids."""
    waiting = queue.filter(F.col("status") == "queued")
    if exclude is not None:
        waiting = waiting.join(exclude.select("id"), "id", "left_anti")
    return waiting.orderBy("id").limit(n)


# ------------------------------------------------------------------------------ retry ledger

STATES = ("absent", "queued", "processing", "done", "failed")


def _transition(state: Column, event: Column, max_attempts: int) -> Column:
    """One event on struct<s, n>: status, and attempts as far as parking needs to know."""
    s, n = state["s"], state["n"]
    more = F.least(n + 1, F.lit(max_attempts))
    after_failure = F.when(n + 1 >= max_attempts, "failed").otherwise("queued")
    failed = (event == "fail") | ((event == "recover") & (s == "processing"))
    status = (
        F.when(event == "drop", "absent")
        .when(s == "absent", "absent")
        .when((event == "claim") & (s == "queued"), "processing")
        .when(event == "done", "done")
        .when(failed, after_failure)
        .when((event == "release") & (s == "processing"), "queued")
        .when((event == "reset") & (s == "failed"), "queued")
        .otherwise(s)
    )
    zero = (event == "drop") | (s == "absent") | ((event == "reset") & (s == "failed"))
    attempts = F.when(zero, F.lit(0)).when(failed, more).otherwise(n)
    return F.struct(status.alias("s"), attempts.alias("n"))


def queue_state(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, piece: int = 10_000) -> DataFrame:
    """The state of every target after its events: (target_norm, status, attempts).

    `attempts(target_norm, ts, seq, event)`; a target starts queued. Attempts stop counting at
    `max_attempts`, where an item is parked. Events of one target are cut into pieces of bounded
    size; each piece becomes a small map from every possible state before to the state after, and
    the pieces' maps are applied in order, so even a target with most of the events is spread out.
    """
    placed = ordered_scan(attempts.select("target_norm", "ts", "seq", "event"), ["ts", "seq"], ["target_norm"])
    cut = placed.withColumn("_piece", F.floor((F.col("rn") - 1) / piece))
    gathered = cut.groupBy("target_norm", "_piece").agg(F.sort_array(F.collect_list(F.struct("rn", "event"))).alias("e"))
    index = [(s, n) for s in STATES for n in range(max_attempts + 1)]
    before = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in index])
    maps = gathered.select(
        "target_norm", "_piece",
        F.transform(before, lambda b: F.aggregate("e", b, lambda st, ev: _transition(st, ev["event"], max_attempts))).alias("m"),
    )
    ordered = maps.groupBy("target_norm").agg(F.sort_array(F.collect_list(F.struct("_piece", "m"))).alias("maps"))

    def place(state):
        status = F.lit(0)
        for i, name in enumerate(STATES):
            status = F.when(state["s"] == name, F.lit(i)).otherwise(status)
        return status * (max_attempts + 1) + state["n"]

    start = F.struct(F.lit("queued").alias("s"), F.lit(0).alias("n"))
    final = ordered.select("target_norm", F.aggregate("maps", start, lambda st, p: F.get(p["m"], place(st))).alias("f"))
    return final.filter(F.col("f.s") != "absent").select(
        "target_norm", F.col("f.s").alias("status"), F.col("f.n").cast("long").alias("attempts")
    )


# ------------------------------------------------------------------------------------ budgets


def budget_cutoff(
    items: DataFrame, by: list[str], order: list[str], max_sources: int, max_tokens: int | None = None, max_usd: float | None = None
) -> DataFrame:
    """Which items a run reaches, and what stops it: `items` with `run` and `stopped_by`.

    Before each item, in `order`: the items tried, then the tokens, then the dollars spent so far
    are held against their limits. Running totals come from `ordered_scan`, so one run with most
    of the items still spreads over tasks.
    """
    scanned = ordered_scan(items, order, by, {"tokens_before": "tokens", "usd_before": "usd"})
    reason = F.when(F.col("rn") > max_sources, "max_sources")
    if max_tokens is not None:
        reason = reason.when(F.col("tokens_before") >= max_tokens, "token_budget")
    if max_usd is not None:
        reason = reason.when(F.col("usd_before") >= max_usd, "usd_budget")
    marked = scanned.withColumn("_why", reason)
    stops = marked.filter(F.col("_why").isNotNull()).groupBy(*by).agg(F.min(F.struct("rn", "_why")).alias("stop"))
    if by:
        joined = marked.join(stops, by, "left")
    else:  # one run: its stop is one row, or none
        stop = stops.first()
        where, why = (stop["stop"]["rn"], stop["stop"]["_why"]) if stop else (None, None)
        joined = marked.withColumn(
            "stop", F.struct(F.lit(where).cast("long").alias("rn"), F.lit(why).cast("string").alias("_why"))
        ).withColumn("stop", F.when(F.col("stop.rn").isNotNull(), F.col("stop")))
    reached = F.col("stop").isNull() | (F.col("rn") < F.col("stop.rn"))
    return joined.withColumn("run", reached).withColumn("stopped_by", F.col("stop._why")).drop("_why", "stop")
