"""Bodies of pages put together from rows: sections, callouts and summaries in their order, in bounded steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.chunks import put_section
from folioscope.operators.common import ordered_scan

#: Pieces of one page that a step puts together.
FAN = 64


def joined_pieces(pieces: DataFrame, by: list[str], order: list[str], text: str = "text", separator: str = "\n\n", fan: int = FAN) -> DataFrame:
    """(*by, text): the pieces of each key in `order`, a total order, with `separator` between them. Null pieces are left out.

    Pieces are numbered by range partitions, so a key with a third of all rows is dealt over many tasks. Then `fan` neighbours at a time
    become one piece, level by level, until each key has one: no step gathers more than `fan` pieces, and a level moves the text once.
    """
    numbered = ordered_scan(pieces.filter(F.col(text).isNotNull()).select(*by, *[c for c in order if c not in (*by, text)], text), order, by)
    level = numbered.select(*by, (F.col("rn") - 1).alias("_at"), F.col(text).alias("_piece"))
    most = level.agg(F.max("_at")).first()[0]
    width = 1
    while most is not None and (width == 1 or width <= most):
        width *= fan
        run = F.sort_array(F.collect_list(F.struct("_at", "_piece")))
        grouped = level.groupBy(*by, F.floor(F.col("_at") / fan).alias("_next")).agg(run.alias("_run"))
        level = grouped.select(*by, F.col("_next").alias("_at"), F.array_join(F.transform("_run", lambda x: x["_piece"]), separator).alias("_piece"))
    return level.select(*by, F.col("_piece").alias(text))


def section_text(source, text, heading: str = "From") -> Column:
    """What one source adds to a page."""
    return F.concat(F.lit(f"## {heading} [["), source, F.lit("]]\n"), text)


def assemble(
    pages: DataFrame, sections: DataFrame, callouts: DataFrame | None = None, summaries: DataFrame | None = None, from_heading: str = "From", summary_heading: str = "Summary", fan: int = FAN
) -> DataFrame:
    """(page_id, body) of every page that sections, callouts or a summary change.

    `pages(page_id, title, body)`: a page without a body starts as its title. `sections(page_id, seq, pos, source, text)` and
    `callouts(page_id, seq, pos, text)` follow what the page has, source by source in the order of `seq`: first its sections, then its
    callouts. `summaries(page_id, summary)` stand under the title in place of an earlier summary; of several rows of a page the least
    counts. Rows of pages that don't exist change nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sections.schema.fields}
    none = F.lit(None)
    later = sections.select("page_id", F.col("seq"), F.lit(1).alias("phase"), F.col("pos"), section_text(F.col("source"), F.col("text"), from_heading).alias("text"))
    if callouts is not None:
        later = later.unionByName(callouts.select("page_id", "seq", F.lit(2).alias("phase"), "pos", "text"))
    changed = later.select("page_id").distinct()
    base = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.concat(F.lit("# "), F.col("title")))
    first = pages.join(changed, "page_id", "left_semi").select("page_id", none.cast(kinds["seq"]).alias("seq"), F.lit(0).alias("phase"), none.cast(kinds["pos"]).alias("pos"), base.alias("text"))
    rows = first.unionByName(later.join(pages.select("page_id"), "page_id", "left_semi")).withColumn("stage", F.least("phase", F.lit(1)))
    built = joined_pieces(rows, ["page_id"], ["stage", "seq", "phase", "pos", "text"], fan=fan).withColumnRenamed("text", "body")
    if summaries is None:
        return built
    short = summaries.groupBy("page_id").agg(F.min("summary").alias("_summary")).filter("_summary is not null")
    old = pages.join(short, "page_id", "left_semi").join(changed, "page_id", "left_anti").select("page_id", base.alias("body"))
    told = built.unionByName(old).join(short, "page_id", "left")
    return told.select("page_id", F.when(F.col("_summary").isNull(), F.col("body")).otherwise(put_section("body", summary_heading, F.col("_summary"))).alias("body"))


def with_bodies(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """`pages` with the new bodies in place of the old."""
    new = bodies.select("page_id", F.col("body").alias("_body"))
    return pages.join(new, "page_id", "left").withColumn("body", F.coalesce("_body", "body")).select(*pages.columns)
