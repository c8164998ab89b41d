"""Names of pages and how references resolve to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V


def kind_ord(kind):
    order = F.lit(len(V.PAGE_KINDS))
    for i, name in reversed(list(enumerate(V.PAGE_KINDS))):
        order = F.when(T.as_column(kind) == name, F.lit(i)).otherwise(order)
    return order


def page_names(pages: DataFrame) -> DataFrame:
    """One row per (folded name, page): the stem, the title and every alias."""
    every = F.array_distinct(
        F.transform(
            F.concat(F.array("stem", "title"), F.coalesce("aliases", F.array().cast("array<string>"))), T.fold
        )
    )
    return pages.select(
        F.explode(every).alias("name"), "page_id", "title", "kind", kind_ord("kind").alias("kind_ord"), "path"
    )


def best_names(names: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The page each name means: the lowest (kind, path). Aggregated before any shuffle."""
    if kinds:
        names = names.filter(F.col("kind").isin(*kinds))
    best = F.min(F.struct("kind_ord", "path", "page_id", "title", "kind"))
    return names.groupBy("name").agg(best.alias("b")).select("name", "b.page_id", "b.title", "b.kind", "b.path")


def resolve_names(refs: DataFrame, names: DataFrame, ref: str = "ref", kinds=None) -> DataFrame:
    """`refs` with the page its name means (NULL when there is none)."""
    best = best_names(names, kinds).select(
        F.col("name").alias("_name"), F.col("page_id").alias("found_id"), F.col("title").alias("found_title"),
        F.col("kind").alias("found_kind"),
    )
    return refs.withColumn("_name", T.fold(ref)).join(best, "_name", "left").drop("_name")


def reference_variants(ref):
    """The spellings tried for a reference, in order: as is, bare, without a note, cut at a separator."""
    ref = T.strip(ref)

    def bare(r):
        return F.regexp_replace(F.regexp_replace(r, r"^\[\[", ""), r"\]\]$", "")

    def spellings(r):
        first = bare(r)
        return T.let(
            F.regexp_replace(first, r"\s*\([^)]*\)\s*$", ""),
            lambda plain: T.let(
                F.split_part(plain, F.lit(":"), F.lit(1)),
                lambda a: T.let(
                    F.split_part(a, F.lit(" — "), F.lit(1)),
                    lambda b: F.array(r, first, plain, a, b, F.split_part(b, F.lit(" - "), F.lit(1))),
                ),
            ),
        )

    trimmed = F.transform(T.let(ref, spellings), lambda v: T.strip(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def resolve_refs(refs: DataFrame, names: DataFrame, ref: str = "ref", kinds=None) -> DataFrame:
    """Tolerant `resolve_names`: the first variant that names a page wins.

    Each distinct reference is resolved once, however many rows repeat it.
    """
    distinct = refs.select(F.col(ref).alias("_ref")).filter(F.col("_ref").isNotNull()).distinct()
    tries = distinct.select("_ref", F.posexplode(reference_variants("_ref")).alias("pos", "variant"))
    best = best_names(names, kinds)
    hits = tries.withColumn("name", T.fold("variant")).join(best, "name")
    found = (
        hits.groupBy("_ref")
        .agg(F.min(F.struct("pos", "page_id", "title", "kind")).alias("b"))
        .select(
            "_ref",
            F.col("b.page_id").alias("found_id"),
            F.col("b.title").alias("found_title"),
            F.col("b.kind").alias("found_kind"),
        )
    )
    return refs.join(found, F.col(ref) == F.col("_ref"), "left").drop("_ref")


def page_links(pages: DataFrame) -> DataFrame:
    """The edge list of the wiki: one row per link in a body, in order."""
    return pages.select(
        F.col("page_id").alias("src_page_id"),
        F.col("title").alias("src_title"),
        F.posexplode(T.link_targets("body")).alias("pos", "target"),
    ).withColumn("target_folded", T.fold("target"))


def page_sources(pages: DataFrame) -> DataFrame:
    """(page_id, source title) rows from the `sources` arrays of links."""
    return pages.select(
        "page_id",
        F.explode("sources").alias("link"),
    ).select("page_id", F.regexp_replace("link", r"^\[\[|\]\]$", "").alias("source"))
