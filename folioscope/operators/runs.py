"""Operational statistics: runs, tokens and money, model trials, question logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import ordered_scan

RELIABLE = 0.8
TASKS = ("ingest", "ask")
SUBSCRIPTION_PREFIXES = ("claude-cli", "codex-cli")  # fixed values: flat-rate plans
KEEP_RUNS = 500


def ops_day(ts, at: str = "03:00") -> Column:
    """The operational day of a moment: it begins at `at`, not at midnight."""
    hours, minutes = (int(p) for p in at.split(":"))
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes))).cast("date")


def runs_report(runs: DataFrame) -> DataFrame:
    """One row per run: its calendar day, clock time, whole minutes and why it stopped."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    minutes = F.floor((micros("finished") - micros("started")) / 60_000_000)
    return runs.select(
        F.to_date("started").alias("day"), F.date_format("started", "HH:mm").alias("at"), "ingested", "skipped", "failed",
        "tokens_used", minutes.cast("long").alias("minutes"), F.coalesce("stopped_by", F.lit("")).alias("stopped_by"),
        (F.col("trigger") == "manual").alias("manual"),
    )


def runs_by_day(runs: DataFrame, at: str = "00:00") -> DataFrame:
    return runs.groupBy(ops_day("started", at).alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("ingested").alias("ingested"), F.sum("skipped").alias("skipped"),
        F.sum("failed").alias("failed"), F.sum("tokens_used").alias("tokens_used"),
        F.count_if(F.col("stopped_by").isNotNull()).alias("stopped"),
    )


def newest_runs(runs: DataFrame, keep: int = KEEP_RUNS, tie: str | None = None) -> DataFrame:
    """The newest `keep` runs: what a trimmed log still holds (a distributed top-k)."""
    order = [F.col("started").desc()] + ([F.col(tie)] if tie else [])
    return runs.orderBy(*order).limit(keep)


def token_cost(tokens, price) -> Column:
    tokens, price = (F.col(c) if isinstance(c, str) else c for c in (tokens, price))
    return tokens / F.lit(1_000_000.0) * price


def spend(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars per run: `usage(run_id, model, fallback, tokens, sends_text_out)`, `prices(model, usd)`.

    A local model costs nothing, a flat-rate plan has no token price, and a model with a fallback
    is priced at the dearer of the two.
    """
    flat_rate = F.split_part("model", F.lit("/"), F.lit(1)).isin(*SUBSCRIPTION_PREFIXES)
    priced = prices.withColumn("usd", F.when(flat_rate, F.lit(0.0)).otherwise(F.col("usd_per_million")))
    main = priced.select("model", F.col("usd").alias("usd_main"))
    other = priced.select(F.col("model").alias("fallback"), F.col("usd").alias("usd_other"))
    joined = usage.join(main, "model", "left").join(other, "fallback", "left")
    price = F.greatest(F.coalesce("usd_main", F.lit(0.0)), F.coalesce("usd_other", F.lit(0.0)))
    cost = F.when(F.col("sends_text_out"), token_cost("tokens", price)).otherwise(0.0)
    return joined.groupBy("run_id").agg(F.sum(cost).alias("usd"), F.sum("tokens").alias("tokens"))


def summarize_trials(trials: DataFrame, prices: DataFrame) -> DataFrame:
    """Per (model, task): rates, exact median latency, tokens, cost and the task's quality rate.

    `trials(model, task, ok, first_try, latency_seconds, tokens, in_language, concepts, cites_expected)`.
    """
    ok = F.col("ok")
    good = lambda c: F.avg(F.when(ok, F.col(c).cast("double")))
    grouped = trials.groupBy("model", "task").agg(
        F.count(F.lit(1)).alias("trials"),
        F.avg(ok.cast("double")).alias("ok_rate"),
        F.avg(F.col("first_try").cast("double")).alias("first_try_rate"),
        F.avg("tokens").alias("tokens_per_case"),
        F.sum("tokens").alias("tokens"),
        good("in_language").alias("language_rate"),
        good("concepts").alias("avg_concepts"),
        good("cites_expected").alias("cites_rate"),
    )
    medians = exact_medians(trials, ["model", "task"], "latency_seconds", "median_latency_seconds")
    timed = _beside(grouped, medians, ["model", "task"])
    priced = timed.join(prices.select("model", "usd_per_million"), "model", "left")
    cost = token_cost("tokens", F.coalesce("usd_per_million", F.lit(0.0)))
    ingest, zero = F.col("task") == "ingest", F.lit(0.0)
    return priced.select(
        "model", "task", "trials", "ok_rate", "first_try_rate", "median_latency_seconds", "tokens_per_case",
        cost.alias("cost_usd"),
        F.when(ingest, F.coalesce("language_rate", zero)).alias("language_rate"),
        F.when(ingest, F.coalesce("avg_concepts", zero)).alias("avg_concepts"),
        F.when(~ingest, F.coalesce("cites_rate", zero)).alias("cites_rate"),
    )


def _beside(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns of their one row in `more`, where there is one; a NULL key meets a NULL key."""
    named = more.withColumnsRenamed({k: "_key_" + k for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_key_" + k))
    return rows.join(named, same, "left").drop(*["_key_" + k for k in keys])


def exact_medians(rows: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """(groups, name): the exact median of each group, NULL values left out; groups without a value have no row.

    A selection over all tasks: equal values are counted before the shuffle, so a value that a third of all rows share is one row; the
    distinct values are range-partitioned and each learns how many values stand before it, and only those with a middle rank go on.
    No task holds the values of a group.
    """
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered_scan(counted, [column], groups, {"_before": "_n"})
    total = placed.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    ranked = _beside(placed, total, groups)
    holds = lambda rank: ((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n"))).cast("int")
    hits = holds(F.floor((F.col("_all") + 1) / 2)) + holds(F.floor(F.col("_all") / 2) + 1)
    middle = ranked.withColumn("_hits", hits).filter("_hits > 0")
    return middle.groupBy(*groups).agg((F.sum(F.col(column).cast("double") * F.col("_hits")) / 2).alias(name))


def suggest_routing(summary: DataFrame, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Per task the best reliable model, or NULL: fewest retries, best quality, fastest, cheapest."""
    quality = F.coalesce("language_rate", "cites_rate", F.lit(0.0))
    rank = F.struct(
        (-F.col("first_try_rate")).alias("a"), (-quality).alias("b"), "median_latency_seconds", "cost_usd", "model"
    )
    best = summary.filter(F.col("ok_rate") >= RELIABLE).groupBy("task").agg(F.min_by("model", rank).alias("model"))
    wanted = summary.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    return wanted.join(best, "task", "left")


def ask_stats(asks: DataFrame, window: str = "1 day") -> DataFrame:
    """Question-log statistics per time window."""
    return (
        asks.groupBy(F.window("at", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.avg(F.col("grounded").cast("double")).alias("grounded_rate"),
            F.avg(F.size("cited")).alias("avg_cited"),
            F.sum("unsupported").alias("unsupported"),
            F.sum("tokens").alias("tokens"),
            F.avg("seconds").alias("avg_seconds"),
        )
        .select(F.col("w.start").alias("window_start"), "questions", "grounded_rate", "avg_cited", "unsupported", "tokens", "avg_seconds")
    )


def plan_metrics(plans: DataFrame, names: DataFrame, language: str = "en") -> DataFrame:
    """How usable a model's plans are: counts, language, and references to pages that do not exist."""
    from folioscope.functions.language import wrong_language
    from folioscope.operators.names import resolve_refs

    prose = F.concat_ws(
        " ", "one_liner", "summary", F.array_join("key_points", " "),
        F.array_join(F.transform("concepts", lambda e: e["description"]), " "),
        F.array_join(F.transform("entities", lambda e: e["description"]), " "),
    )
    base = plans.select(
        "doc_id", F.size("concepts").cast("long").alias("concepts"), F.size("entities").cast("long").alias("entities"),
        (~wrong_language(prose, language)).alias("in_language"),
    )
    refs = plans.select(
        "doc_id", F.explode(F.concat("related_pages", F.transform("contradictions", lambda c: c["page"]))).alias("ref")
    )
    bad = resolve_refs(refs, names).filter(F.col("found_id").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("bad_refs"))
    return base.join(bad, "doc_id", "left").withColumn("bad_refs", F.coalesce("bad_refs", F.lit(0).cast("long")))


def spread_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """n rows evenly spaced in `order`, the first and the last included (all rows when fewer)."""
    numbered = ordered_scan(df, order)
    total = numbered.count()
    if n >= total:
        return numbered.drop("rn")
    if n == 1:
        return numbered.filter("rn = 1").drop("rn")
    places = [round(i * (total - 1) / (n - 1)) + 1 for i in range(n)]
    wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "rn long")
    return numbered.join(F.broadcast(wanted), "rn", "left_semi").drop("rn")  # n rows, an argument


def benchmark_sources(docs: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Sources to compare models on: long enough, and never mail."""
    return spread_sample(docs.filter((F.length("text") >= 500) & (F.col("kind") != "email")), n, order)


