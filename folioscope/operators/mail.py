"""Mail rows: ids, dedup, attachments, and the intake window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.operators.common import first_by


def mail_id(message_id, raw) -> Column:
    """A stable source id: the cleaned Message-ID, or a hash of the whole mail."""
    clean = F.substring(F.regexp_replace(F.coalesce(T.as_column(message_id), F.lit("")), rf"[^{T.WORD}.@+=-]", ""), 1, 150)
    return F.concat(F.lit("mail:"), F.when(clean != "", clean).otherwise(T.content_hash(raw)))


def known_ids(*places: DataFrame) -> DataFrame:
    """The union of the mail ids of every place they are kept (columns: source)."""
    out = places[0].select("source")
    for place in places[1:]:
        out = out.union(place.select("source"))
    return out.filter(F.col("source").startswith("mail:")).distinct()


def dedup_mail(mail: DataFrame, known: DataFrame) -> DataFrame:
    """New mails, the first of each id by uid. `mail(uid, message_id, raw, ...)`, `known(source)`."""
    named = mail.withColumn("source", mail_id("message_id", "raw"))
    fresh = named.join(known.select("source"), "source", "left_anti")
    return first_by(fresh, ["source"], ["uid"])


def new_attachments(attachments: DataFrame, kept_files: DataFrame) -> DataFrame:
    """Attachments whose bytes are not kept yet: (size, digest) is compared, never the name."""
    known = kept_files.select("size", "digest").distinct()
    fresh = attachments.join(known, ["size", "digest"], "left_anti")
    return first_by(fresh, ["size", "digest"], ["uid", "pos"])


def keep_images(mail: DataFrame) -> DataFrame:
    """Image attachments worth keeping: (uid, name, declared, bytes) in order.

    `mail(uid, attachments array<struct<name,declared,format,width,height,bytes>>)`. The running
    total of a mail is capped; one that does not fit is skipped and later ones still tried.
    """
    formats = F.create_map(*[F.lit(x) for pair in V.IMAGE_FORMATS.items() for x in pair])

    def good(a):
        return (
            a["declared"].isin(*V.IMAGE_FORMATS)
            & a["bytes"].between(V.MIN_IMAGE_BYTES, V.MAX_IMAGE_BYTES)
            & (F.try_element_at(formats, a["declared"]) == a["format"])
            & (F.least(a["width"], a["height"]) >= V.MIN_IMAGE_SIDE)
            & (a["width"].cast("long") * a["height"] <= V.MAX_IMAGE_PIXELS)
        )

    indexed = F.transform("attachments", lambda a, i: F.struct(i.alias("pos"), a.alias("a")))
    usable = F.filter(indexed, lambda x: F.coalesce(good(x["a"]), F.lit(False)))
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).cast("long").alias("total"))

    def take(acc, x):
        fits = acc["total"] + x["a"]["bytes"] <= V.MAX_MAIL_IMAGE_BYTES
        return F.struct(
            F.when(fits, F.concat(acc["kept"], F.array(x["pos"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["total"] + x["a"]["bytes"]).otherwise(acc["total"]).alias("total"),
        )

    kept = F.aggregate(usable, start, take, lambda acc: acc["kept"])
    picked = T.let(kept, lambda ks: F.filter(usable, lambda x: F.array_contains(ks, x["pos"])))
    return mail.select("uid", F.explode(picked).alias("x")).select("uid", "x.pos", "x.a.name", "x.a.declared", "x.a.bytes")


def intake(mail: DataFrame, today, last_uid: int | None = None, generation: str | None = None, days: int = 14) -> DataFrame:
    """Mails to take: recent, unseen, or past the mark, which counts only in its own generation."""
    recent = F.to_date("received") >= F.date_sub(F.lit(today), days)
    wanted = recent | ~F.col("seen")
    if last_uid is not None and generation is not None:
        wanted = wanted | ((F.col("generation") == generation) & (F.col("uid") > last_uid))
    return mail.filter(wanted)
