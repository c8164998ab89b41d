"""Privacy taint: what private sources touched, and what may still be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators.chunks import from_source_heads, without_sections, without_summary


def private_sources(pages: DataFrame, mail_files: DataFrame | None = None, mail_links: DataFrame | None = None) -> DataFrame:
    """Source pages that are private: mail, or reached from mail.

    `mail_files(content_hash)` are attachments saved from mail, `mail_links(target_norm)` the
    addresses found in mail. Rows: (page_id, title).
    """
    sources = pages.filter(F.col("kind") == "sources")
    found = sources.filter(F.col("doc_kind") == "email").select("page_id", "title")
    if mail_files is not None:
        files = mail_files.select("content_hash").distinct()
        found = found.unionByName(sources.join(files, "content_hash", "left_semi").select("page_id", "title"))
    if mail_links is not None:
        links = mail_links.select("target_norm").distinct()
        reached = sources.filter(F.col("url").isNotNull()).withColumn("target_norm", U.normalize_url("url"))
        found = found.unionByName(reached.join(links, "target_norm", "left_semi").select("page_id", "title"))
    return found.distinct()


def _marked(pages: DataFrame, sources: DataFrame, private: DataFrame) -> DataFrame:
    """Per page with sources: are all, is any of them private? One partial aggregate."""
    names = private.select(F.col("title").alias("source")).distinct().withColumn("hit", F.lit(True))
    flags = sources.join(names, "source", "left").select("page_id", F.coalesce("hit", F.lit(False)).alias("hit"))
    per_page = flags.groupBy("page_id").agg(F.bool_and("hit").alias("all_private"), F.bool_or("hit").alias("any_private"))
    return pages.select("page_id", "title", "kind").join(per_page, "page_id")


def hidden_pages(pages: DataFrame, sources: DataFrame, private: DataFrame) -> DataFrame:
    """Private sources, pages built only from them, and syntheses that used any of them."""
    marked = _marked(pages, sources, private)
    built = marked.filter(
        (F.col("kind").isin("concepts", "entities") & F.col("all_private"))
        | ((F.col("kind") == "syntheses") & F.col("any_private"))
    )
    return built.select("page_id", "title").unionByName(private.select("page_id", "title")).distinct()


def touched_pages(pages: DataFrame, sources: DataFrame, private: DataFrame) -> DataFrame:
    """Pages some private source helped write: only their title may be shown."""
    marked = _marked(pages, sources, private)
    return marked.filter(F.col("any_private") & (F.col("kind") != "sources")).select("page_id", "title")


def public_body(pages: DataFrame, private: DataFrame) -> DataFrame:
    """Bodies without the sections of private sources, and without the summary if one was there.

    Each section meets the private titles in an equi-join; the titles a page must lose come back
    as one array per page, no longer than its own list of sections.
    """
    head = rf"(?m)^## (?:{from_source_heads()}) \[\[([^\n]*)\]\]$"
    named = pages.select("page_id", F.explode(F.array_distinct(T.find_all("body", head, 1))).alias("source"))
    secret = named.join(private.select(F.col("title").alias("source")).distinct(), "source", "left_semi")
    lost = secret.groupBy("page_id").agg(F.collect_set("source").alias("lost"))
    joined = pages.join(lost, "page_id", "left")
    cut = without_sections("body", F.col("lost"))
    return joined.select(
        "page_id",
        "title",
        T.strip(F.when(F.col("lost").isNull(), F.col("body")).otherwise(without_summary(cut))).alias("body"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("sections_removed"),
    )


def public_references(rows: DataFrame, hidden: DataFrame, page: str = "page_id") -> DataFrame:
    """References a public note may make: never to a private page."""
    return rows.join(hidden.select(F.col("page_id").alias(page)).distinct(), page, "left_anti")


def propagate_origin(captures: DataFrame) -> DataFrame:
    """A link followed from a post that came by mail is mail too (one level: such links are not
    followed further)."""
    parents = (
        captures.filter(F.col("origin").isin("mail", "mail-link"))
        .select(F.col("target_norm").alias("via"))
        .distinct()
        .withColumn("_mail", F.lit(True))
    )
    joined = captures.join(parents, "via", "left")
    return joined.withColumn(
        "origin", F.when(F.coalesce("_mail", F.lit(False)), F.lit("mail-link")).otherwise(F.col("origin"))
    ).drop("_mail")
