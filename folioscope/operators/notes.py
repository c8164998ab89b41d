"""Notes of long sources: merging, hierarchical reduction, read coverage, packing."""

from __future__ import annotations

from functools import reduce as fold_left
from itertools import pairwise, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.operators.common import durable, ordered_scan, top_k

ITEM = "struct<a:string,b:string,c:string>"
SECTION_CAPS = {"points": 8, "terms": 6, "quotes": 3, "relations": 6}
SOURCE_CAPS = {"terms": 10, "quotes": 12, "relations": 10}


def note_items(notes: DataFrame) -> DataFrame:
    """`notes(doc_id, seq, points, terms, quotes, relations)` as rows (doc_id, seq, field, rank, a, b, c).

    One long table carries the four lists through every merge: a point or quote is `a`, a term is
    (term, definition), a relation is (a, relation, b).
    """

    def plain(column, field):
        return F.transform(
            column,
            lambda x, i: F.struct(
                F.lit(field).alias("field"), i.alias("rank"), x.alias("a"),
                F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"),
            ),
        )

    def row(column, field, a, b, c):
        return F.transform(
            column,
            lambda x, i: F.struct(
                F.lit(field).alias("field"), i.alias("rank"), x[a].alias("a"), x[b].alias("b"),
                (x[c] if c else F.lit(None).cast("string")).alias("c"),
            ),
        )

    every = F.concat(
        plain(F.col("points"), "points"), row(F.col("terms"), "terms", "term", "definition", None),
        plain(F.col("quotes"), "quotes"), row(F.col("relations"), "relations", "a", "relation", "b"),
    )
    return notes.select("doc_id", F.col("seq").cast("long").alias("seq"), F.inline(every))


def _item_key() -> Column:
    relation = F.concat(T.fold("a"), F.lit("\x1f"), T.fold("c"))
    return F.when(F.col("field") == "relations", relation).otherwise(T.fold("a"))


def spread(items: DataFrame, by: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """Round-robin merge: first items of every chunk before second ones, no repeats.

    Repeats fall to a partial aggregate. With `caps` only its fields are merged, and of each as many
    items as it says are kept, before the shuffle; without it every item stays. The new `rank` is the place.
    """
    wanted = items.filter(F.col("field").isin(*caps)) if caps else items
    keyed = wanted.withColumn("_key", _item_key())
    first = keyed.groupBy(*by, "field", "_key").agg(F.min(F.struct("rank", "seq", "a", "b", "c")).alias("m"))
    rows = first.select(*by, "field", F.col("m.rank").alias("_rank"), F.col("m.seq").alias("_seq"), "_key", "m.a", "m.b", "m.c")
    if not caps:
        placed = ordered_scan(rows, ["_rank", "_seq", "_key"], [*by, "field"]).withColumnRenamed("rn", "place")
        return placed.select(*by, "field", (F.col("place") - 1).alias("rank"), "a", "b", "c")
    cap = fold_left(lambda acc, kv: acc.when(F.col("field") == kv[0], kv[1]), caps.items(), F.when(F.lit(False), 0))
    placed = top_k(rows, [*by, "field"], [F.col("_rank"), F.col("_seq")], max(caps.values()), "place")
    return placed.filter(F.col("place") <= cap).select(*by, "field", (F.col("place") - 1).alias("rank"), "a", "b", "c")


def items_as_notes(items: DataFrame) -> DataFrame:
    """The notes that items belong to, their lists in the order of `rank`: the inverse of `note_items`. A merged note's lists are capped."""
    row = F.struct("rank", "a", "b", "c")
    listed = items.groupBy("doc_id", "seq").agg(*[F.sort_array(F.collect_list(F.when(F.col("field") == f, row))).alias(f) for f in ("points", "terms", "quotes", "relations")])
    return listed.select(
        "doc_id", "seq", F.transform("points", lambda x: x["a"]).alias("points"), F.transform("terms", lambda x: F.struct(x["a"].alias("term"), x["b"].alias("definition"))).alias("terms"),
        F.transform("quotes", lambda x: x["a"]).alias("quotes"), F.transform("relations", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("relation"), x["c"].alias("b"))).alias("relations"),
    )


def merge_notes(notes: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Terms, quotes and relations of a whole source, spread over its chunks; all of them, or as many as `caps` says."""
    return spread(note_items(notes), ["doc_id"], caps).filter("field <> 'points'")


def reduce_items(
    items: DataFrame, fan_in: int = V.FAN_IN, group: int = V.GROUP_SIZE, merge_points=None, caps: dict[str, int] | None = None
) -> DataFrame:
    """Merge groups of consecutive notes, level by level, until each source has at most `fan_in`.

    `items` are `note_items` rows numbered from 0 without gaps. Sources that fit are never merged;
    a group of one passes up. The longest source, counted once, gives the number of levels; each is
    one shuffle, written down before the next reads it. `merge_points(groups)` may rewrite the points
    of each merged group (see `model_map`) and is called once per group. `caps` limits what a merged
    note keeps of each field; None keeps all.
    """
    level = items.withColumn("level", F.lit(0))
    sizes = durable(items.groupBy("doc_id").agg((F.max("seq") + 1).alias("n_notes")))
    longest = sizes.agg(F.max("n_notes")).first()[0] or 0
    columns = ["doc_id", "seq", "field", "rank", "a", "b", "c"]
    for depth in range(1, len(level_sizes(int(longest), fan_in, group))):
        sized = level.join(sizes, "doc_id")
        done = sized.filter(F.col("n_notes") <= fan_in).select(level.columns)
        busy = sized.filter(F.col("n_notes") > fan_in).withColumn("_to", F.floor(F.col("seq") / group))
        last = F.col("n_notes") % group
        alone = (last == 1) & (F.col("seq") == F.col("n_notes") - 1)
        passed = busy.filter(alone).withColumn("seq", F.col("_to"))
        merged = spread(busy.filter(~alone), ["doc_id", "_to"], caps).withColumnRenamed("_to", "seq")
        if merge_points is not None:
            merged = durable(merge_points(merged))
        level = durable(
            done.select(*columns, "level")
            .unionByName(passed.select(*columns, "level"))
            .unionByName(merged.select(*columns, F.lit(depth).alias("level")))
        )
        shrunk = F.when(F.col("n_notes") > fan_in, F.ceil(F.col("n_notes") / group)).otherwise(F.col("n_notes"))
        sizes = sizes.select("doc_id", shrunk.alias("n_notes"))
    return level


def reduce_notes(
    notes: DataFrame, fan_in: int = V.FAN_IN, group: int = V.GROUP_SIZE, merge_points=None, caps: dict[str, int] | None = None
) -> DataFrame:
    return reduce_items(note_items(notes), fan_in, group, merge_points, caps)


def level_sizes(n_notes: int, fan_in: int = V.FAN_IN, group: int = V.GROUP_SIZE) -> list[int]:
    """How many notes each level of `reduce_items` has, from the first to the one that fits."""
    sizes = [n_notes]
    while sizes[-1] > max(fan_in, 1):
        sizes.append(-(-sizes[-1] // group))
    return sizes


def merge_calls(n_notes: int, fan_in: int = V.FAN_IN, group: int = V.GROUP_SIZE) -> int:
    """Groups of two or more over all levels: a note left alone at the end of a level passes up unmerged."""
    sizes = level_sizes(n_notes, fan_in, group)
    return sum(after - (before % group == 1) for before, after in pairwise(sizes))


def affordable_chunks(limit: int | None = None, fan_in: int = V.FAN_IN) -> int | None:
    """How many leading chunks a limit of calls can read and merge, the same for every source; None without a limit."""
    if limit is None:
        return None
    total = lambda n: n + merge_calls(n, fan_in) + V.FINALE_CALLS
    return sum(1 for _ in takewhile(lambda n: total(n) <= limit, range(1, limit + 1)))


def unread_chunks(chunks: DataFrame, limit: int | None = None, fan_in: int = V.FAN_IN) -> DataFrame:
    """The chunks that a limit leaves for a later run, as rows of `chunks`."""
    stop = affordable_chunks(limit, fan_in)
    return chunks.filter(F.lit(False)) if stop is None else chunks.filter(F.col("seq") >= stop)


def read_coverage(chunks: DataFrame, limit: int | None = None, fan_in: int = V.FAN_IN) -> DataFrame:
    """Per source: chunks, how many stay unread, their share of the text, where the unread part starts."""
    stop = affordable_chunks(limit, fan_in)
    n = F.length("chunk")
    unread = F.lit(False) if stop is None else F.col("seq") >= stop
    first_unread = F.lit(False) if stop is None else F.col("seq") == stop
    per_doc = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(unread).alias("unread"),
        F.sum(F.when(unread, n).otherwise(0)).alias("unread_chars"),
        F.sum(n).alias("chars"),
        F.max(F.when(first_unread, F.substring(T.flatten("chunk"), 1, 60))).alias("starts"),
    )
    percent = F.bround(100 * F.col("unread_chars") / F.col("chars"), 0).cast("long")
    return per_doc.select("doc_id", "total", "unread", percent.alias("percent"), F.coalesce("starts", F.lit("")).alias("starts"))


def coverage_of(chunks: DataFrame, unread: DataFrame) -> DataFrame:
    """`read_coverage` from the chunks that were in fact left unread."""
    marked = chunks.join(unread.select("doc_id", "seq", F.lit(True).alias("_u")), ["doc_id", "seq"], "left").withColumn("_u", F.coalesce("_u", F.lit(False)))
    n = F.length("chunk")
    per_doc = marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_u").alias("unread"), F.sum(F.when(F.col("_u"), n).otherwise(0)).alias("unread_chars"), F.sum(n).alias("chars"),
        F.min_by(F.when(F.col("_u"), F.substring(T.flatten("chunk"), 1, 60)), F.when(F.col("_u"), F.col("seq"))).alias("starts"),
    )
    percent = F.bround(100 * F.col("unread_chars") / F.col("chars"), 0).cast("long")
    return per_doc.select("doc_id", "total", "unread", percent.alias("percent"), F.coalesce("starts", F.lit("")).alias("starts"))


def pack_notes(notes: DataFrame, budget: int = V.NOTES_BUDGET_CHARS) -> DataFrame:
    """The notes of a source as one text within the budget, with fewer points per note if needed.

    Each note measures its text at the five levels in its own row; sums per source pick the level,
    and only that text is put together, at most `budget` characters of it per source. `whole` says
    whether all of it fitted, and `chars` how long it is.
    """

    def block(keep: int):
        lines = F.concat(
            F.array(F.concat(F.lit("[chunk "), (F.col("seq") + 1).cast("string"), F.lit("]"))),
            F.transform(F.slice("points", 1, keep), lambda p: F.concat(F.lit("- "), p)),
            F.transform("terms", lambda t: F.concat(F.lit("  term: "), t["term"], F.lit(": "), t["definition"])),
            F.transform("quotes", lambda q: F.concat(F.lit('  quote: "'), q, F.lit('"'))),
            F.transform("relations", lambda r: F.concat(F.lit("  relation: "), r["a"], F.lit(" --"), r["relation"], F.lit("--> "), r["b"])),
        )
        return F.array_join(lines, "\n")

    sized = notes.select("doc_id", "seq", *[block(k).alias(f"t{k}") for k in V.POINT_LEVELS])
    totals = sized.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[(F.sum(F.length(f"t{k}") + 1) - 1).alias(f"l{k}") for k in V.POINT_LEVELS]
    )
    keep = F.lit(V.POINT_LEVELS[-1])
    for k in reversed(V.POINT_LEVELS):
        keep = F.when(F.col(f"l{k}") <= budget, F.lit(k)).otherwise(keep)
    length = F.col(f"l{V.POINT_LEVELS[-1]}")
    for k in reversed(V.POINT_LEVELS):
        length = F.when(F.col(f"l{k}") <= budget, F.col(f"l{k}")).otherwise(length)
    chosen = sized.join(totals.select("doc_id", keep.alias("keep"), length.alias("chars")), "doc_id")
    text = F.lit(None).cast("string")
    for k in V.POINT_LEVELS:
        text = F.when(F.col("keep") == k, F.col(f"t{k}")).otherwise(text)
    # the n-th of notes numbered without gaps starts after n-1 blocks of 10 characters or more, so later ones never show
    shown = chosen.select("doc_id", "keep", "chars", "seq", text.alias("text")).filter(F.col("seq") * 10 <= budget)
    rows = shown.groupBy("doc_id", "keep", "chars").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("rows"))
    joined = F.substring(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), 1, budget)
    return rows.select("doc_id", "keep", joined.alias("text"), "chars", (F.col("chars") <= budget).alias("whole"))
