"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas; shard sizes stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.common import durable, ordered_scan

SHARDS, ROUNDS = 24, 8
#: How far linked rows may overfill a shard while they move; the last step takes the excess out again.
SLACK = 1.1


def _quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [n // shards + (j < n % shards) for j in range(shards)]


def _taken(linked: DataFrame, shards: int) -> list[int]:
    """Linked rows in each shard: one number per shard, whatever the size of the table."""
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [held.get(j, 0) for j in range(shards)]


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rows (r, g, shard) with new shards. A row's neighbours are the rows of its group g; no shard gets more linked rows than its quota.

    In each round every group counts its rows per shard and names as many of the fullest shards with room as it needs. Rows elsewhere
    propose to move to one of these, rows that gain most first; a shard accepts as many as it has room for. Counts per group and shard
    are partial aggregates of at most one row per shard, so a group of a third of all rows is never gathered.
    """
    shards = len(quotas)
    sizes = durable(linked.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
    now = linked
    for _ in range(rounds):
        taken = _taken(now, shards)
        room = F.element_at(F.array(*[F.lit(q - t) for q, t in zip(quotas, taken, strict=True)]), F.col("shard") + 1)
        quota = F.lit(max(1, min(quotas)))
        counts = now.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
        # a shard attracts a group as far as it can hold it: by the rows it has of it, and the room it has left
        pull = counts.join(sizes, "g").withColumn("reach", F.least("size", F.col("n") + F.greatest(room, F.lit(0))))
        order = W.partitionBy("g").orderBy(F.col("reach").desc(), F.col("n").desc(), F.xxhash64("g", "shard"))
        best = pull.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.ceil(F.col("size") / quota))
        targets = best.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(F.col("place"), F.col("shard"), F.col("n")))).alias("targets"))  # one entry per shard at most
        here = counts.withColumnRenamed("n", "here")
        pick = F.element_at("targets", (F.pmod(F.xxhash64("r"), F.size("targets")) + 1).cast("int"))
        asked = now.join(targets, "g").join(here, ["g", "shard"]).filter(~F.exists("targets", lambda t: t["shard"] == F.col("shard")))
        asked = asked.select("r", "g", "shard", pick["shard"].alias("target"), (F.col("here") - pick["n"]).alias("loss"))
        ranked = ordered_scan(asked, ["loss", "g", "r"], ["target"])
        open_ = F.element_at(F.array(*[F.lit(q - t) for q, t in zip(quotas, taken, strict=True)]), F.col("target") + 1)
        moves = durable(ranked.filter(F.col("rn") <= open_).select("r", "target"))
        if moves.isEmpty():
            break
        now = durable(now.join(moves, "r", "left").select("r", "g", F.coalesce("target", "shard").alias("shard")))
    return now


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group, group_size) per row of `docs`; the law is `rows`: counts at most one apart.

    Links join equal texts; a null text is an empty one (size 8, crc32 0). Rows start dealt evenly, linked rows then move by label
    propagation (those a shard then has too many of, of its smallest groups first, go), and the others fill each shard up to its quota. Rows that repeat an id or text are rows of their own. Slots
    number each shard in the order of ids, nulls first. An empty table gives none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g")
    )
    rows = durable(ordered_scan(base, ["doc_id", "g"]).withColumnRenamed("rn", "r"))
    quotas = _quotas(rows.count(), shards)
    groups = durable(rows.groupBy("g").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    start = rows.select("r", "g", F.pmod(F.col("r") - 1, F.lit(shards)).cast("int").alias("shard"))
    linked = durable(start.join(groups.select("g"), "g", "left_semi"))
    settled = propagate(linked, [max(1, int(q * SLACK)) for q in quotas], rounds)
    counts = settled.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_scan(settled.join(counts, ["g", "shard"]).select("r", "g", "shard", (-F.col("n")).alias("few")), ["few", "g", "r"], ["shard"])
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("shard") + 1)
    held = durable(ranked.withColumn("over", F.col("rn") > quota).select("r", "g", "shard", "over"))
    kept = held.filter("not over")
    left = [q - t for q, t in zip(quotas, _taken(kept, shards), strict=True)]
    ends = [sum(left[: j + 1]) for j in range(shards)]
    alone = start.join(groups.select("g"), "g", "left_anti").select("r", "g").union(held.filter("over").select("r", "g"))
    free = ordered_scan(alone.select("r", F.xxhash64("g").alias("h")), ["h", "r"])
    filled = free.select("r", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("rn"))).alias("shard"))
    placed = rows.join(kept.select("r", "shard").union(filled.select("r", "shard")), "r").join(groups, "g", "left")
    slots = ordered_scan(placed, ["r"], ["shard"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("g").alias("group"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )


def cut_links(assigned: DataFrame) -> DataFrame:
    """(links, cut): links between equal texts, counted as pairs, and those between different shards; sums of squares, no pairs are made."""
    pairs = lambda n: n.cast("double") * (n - 1) / 2
    counts = assigned.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("group").agg(pairs(F.sum("n")).alias("all"), F.sum(pairs(F.col("n"))).alias("kept"))
    return per.agg(F.sum("all").alias("links"), (F.sum("all") - F.sum("kept")).alias("cut"))
