"""Streaming jobs run to the end over the given tables, held against their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators.common import checkpoint_dir
from folioscope.plans.corpus import shared, table
from folioscope.plans.queries_operations import LEDGER_SQL
from folioscope.plans.queries_search import _BM25, _INDEX, K, question_terms
from folioscope.plans.queries_text import NORMED
from folioscope.plans.registry import query
from folioscope.streaming import delta_index as D
from folioscope.streaming import drops as P
from folioscope.streaming import jobs as J


def stream(spark, d, name):
    """A table as a file stream, be it one file or a folder of files: the last letter as a class makes the path a pattern, which both match."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def drained(spark, rows, mode: str):
    """Run a stream over what is there now and read what it wrote."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    started = (
        rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_dedup", f"WITH {NORMED} SELECT DISTINCT target_norm FROM normed WHERE variant < 2")
def stream_dedup(spark, d):
    pages = stream(spark, d, "pages").select("page_id", "url")
    joiner = F.when(F.col("url").contains("?"), "&").otherwise("?")
    tracked = F.when(~F.col("url").contains("#"), F.concat("url", joiner, F.lit("utm_campaign=z&FBCLID=1&a=b")))
    captures = pages.select("page_id", F.explode(F.array_compact(F.array("url", tracked))).alias("target"))
    return drained(spark, J.dedup_stream(captures), "append").select("target_norm")


@query("stream_retry_ledger", LEDGER_SQL)
def stream_retry_ledger(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    event = (
        F.when(kind == "error", F.when(value > 20, "fail").otherwise("recover")).when(kind == "purchase", "done")
        .when(kind == "signup", F.when(value > 120, "drop").otherwise("reset")).when(kind == "view", "release").otherwise("claim")
    )
    events = stream(spark, d, "events").select(
        F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")).alias("target_norm"), "ts", F.col("event_id").alias("seq"), event.alias("event")
    )
    updates = drained(spark, J.retry_ledger(events), "update")
    newest = updates.groupBy("target_norm").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("s"))
    return newest.select("target_norm", "s.status", "s.attempts")


@query(
    "stream_ops_day",
    """WITH d AS (SELECT (ts - INTERVAL 3 HOUR)::DATE AS day, count(*) AS runs, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens_used,
         count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
       SELECT CAST(day AS VARCHAR) AS day, runs, tokens_used, failed FROM d WHERE day + INTERVAL 27 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_ops_day(spark, d):
    """Days the watermark has passed; later ones stay open."""
    runs = stream(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("started"), F.round("value").cast("long").alias("tokens_used"), (F.col("event_type") == "error").cast("long").alias("failed")
    )
    days = drained(spark, J.ops_day_stats(runs), "append")
    return days.select(F.to_date("day_start").cast("string").alias("day"), "runs", "tokens_used", "failed")


@query(
    "stream_mail_intake",
    """SELECT DISTINCT substr(sha256(text), 1, 16) AS source FROM conversations""",
)
def stream_mail_intake(spark, d):
    from datetime import date

    mail = stream(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), F.lit(None).cast("string").alias("message_id"), F.col("text").alias("raw"),
        F.lit("2024-01-19").cast("timestamp").alias("received"), F.lit(True).alias("seen"), F.lit("7").alias("generation"),
    )
    taken = drained(spark, J.mail_intake(mail, date(2024, 1, 20)), "append")
    return taken.select(F.substring("source", 6, 16).alias("source"))


def _mailbox_sql(fetches: int = 4) -> str:
    steps = ["""m AS (SELECT 'm' || conv_id % 3 AS mailbox, CASE WHEN conv_id % 4 < 2 THEN 'g1' ELSE 'g2' END AS generation, conv_id % 4 AS "fetch", DATE '2024-01-15' + CAST(conv_id % 4 AS INT) AS fetched,
        conv_id * 1000 + turn AS uid, DATE '2024-01-01' + CAST(conv_id * 7 % 30 AS INT) - 20 AS received, (conv_id + turn) % 3 <> 0 AS seen FROM conversations)""", "k AS (SELECT NULL AS mailbox, NULL AS gen, NULL AS last WHERE false)"]  # fmt: skip
    before = "k"
    for f in range(fetches):
        steps.append(f"t{f} AS (SELECT m.* FROM m LEFT JOIN {before} k ON k.mailbox = m.mailbox AND k.gen = m.generation WHERE m.\"fetch\" = {f} AND (received >= fetched - 14 OR NOT seen OR coalesce(uid > last, false)))")
        steps.append(f"k{f} AS (SELECT mailbox, gen, max(last) AS last FROM (SELECT mailbox, generation AS gen, uid AS last FROM t{f} UNION ALL SELECT * FROM {before}) GROUP BY mailbox, gen QUALIFY gen = max(gen) OVER (PARTITION BY mailbox))")
        before = f"k{f}"
    return "WITH " + ",\n".join(steps) + "\n" + " UNION ALL ".join(f'SELECT mailbox, "fetch", uid FROM t{f}' for f in range(fetches))


@query("stream_mailboxes", _mailbox_sql())
def stream_mailboxes(spark, d):
    """Four fetches of three mailboxes, one micro-batch each, with marks as state; the mailboxes change their generation after two."""
    from folioscope.streaming import mailbox as B

    fetch = F.col("conv_id") % 4
    day = lambda start, n: F.date_add(F.to_date(F.lit(start)), n.cast("int"))
    mail = table(spark, d, "conversations").select(
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("mailbox"), F.when(fetch < 2, "g1").otherwise("g2").alias("generation"), fetch.alias("fetch"),
        day("2024-01-15", fetch).alias("fetched"), (F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), day("2023-12-12", F.col("conv_id") * 7 % 30).alias("received"),
        ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("seen"), F.lit(None).cast("string").alias("message_id"), F.col("text").alias("raw"),
    )
    folder = f"{checkpoint_dir(spark)}/mailboxes-{uuid.uuid4().hex}"
    for f in range(4):
        mail.filter(F.col("fetch") == f).write.parquet(f"{folder}/in/fetch_{f}")
        arrived = spark.readStream.schema(mail.schema).parquet(f"{folder}/in/*")
        B.maintain_mailboxes(arrived, f"{folder}/out", f"{folder}/state").start().awaitTermination()
    return spark.read.schema(mail.schema).parquet(f"{folder}/out/taken/*").select("mailbox", "fetch", "uid")


# -------------------------------------------------------------------------------- runs kept by level

_LIVE = "live AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'revised title' ELSE source END AS source, lang, text FROM documents WHERE doc_id % 5 <> 0)"
STEPS = 6


def arriving(spark, steps: list, follow) -> None:
    """Each of `steps` written as one more folder of files; `follow(stream)` is started anew after each and takes it as one batch."""
    folder = f"{checkpoint_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for n, rows in enumerate(steps):
        rows.write.parquet(f"{folder}/step_{n}")
        follow(spark.readStream.schema(rows.schema).parquet(f"{folder}/*")).start().awaitTermination()


def delta_index(spark, d):
    """Documents indexed by batches: each comes in one of four, a third is given another title in the next, a fifth is deleted in the one after that."""

    def build():
        folder = f"{checkpoint_dir(spark)}/delta-{uuid.uuid4().hex}"
        docs = table(spark, d, "documents")
        page = lambda title, deleted: docs.select(
            F.col("doc_id").alias("page_id"), title.alias("title"), F.array("lang").alias("aliases"), F.col("text").alias("body"), F.lit(1).alias("changed_at"), F.lit(deleted).alias("deleted")
        )
        home = lambda n: F.col("page_id") % 4 == n
        steps = [
            page(F.col("source"), False).filter(home(n))
            .unionByName(page(F.lit("revised title"), False).filter(home(n - 1) & (F.col("page_id") % 3 == 0)))
            .unionByName(page(F.col("source"), True).filter(home(n - 2) & (F.col("page_id") % 5 == 0)))
            for n in range(STEPS)
        ]
        arriving(spark, steps, lambda pages: D.follow_pages(pages, f"{folder}/index", f"{folder}/state", fanout=2))
        return spark.range(1).select(F.lit(f"{folder}/index").alias("path"))

    return D.DeltaIndex(spark, shared(spark, d, "delta_index", build).first()["path"], fanout=2)


@query(
    "stream_delta_index",
    f"""WITH {_LIVE}, {_INDEX.replace("FROM documents", "FROM live")}, total AS (SELECT count(*) AS pages, CAST(sum(coalesce(page_len, 0)) AS BIGINT) AS tokens FROM live LEFT JOIN lens ON page_id = doc_id)
    SELECT page_id, count(*) AS terms, CAST(sum(tf_title) AS BIGINT) AS in_title, CAST(sum(tf_alias) AS BIGINT) AS in_alias, CAST(sum(tf_body) AS BIGINT) AS in_body,
      CAST(any_value(page_len) AS BIGINT) AS page_len, CAST(sum(tf_body * (1 + length(term) * 31 + ascii(term))) AS BIGINT) AS said, any_value(pages) AS pages, any_value(tokens) AS tokens
    FROM postings JOIN lens USING (page_id), total GROUP BY page_id""",
)
def stream_delta_index(spark, d):
    """The postings of every live page after six batches, with the totals of the head."""
    index = delta_index(spark, d)
    said = F.col("tf_body") * (1 + F.length("term") * 31 + F.ascii("term"))
    rows = index.postings().groupBy("page_id").agg(
        F.count(F.lit(1)).alias("terms"), *[F.sum(f"tf_{c}").alias(f"in_{c}") for c in ("title", "alias", "body")],
        F.max("page_len").cast("long").alias("page_len"), F.sum(said).cast("long").alias("said"),
    )
    return rows.withColumns({"pages": F.lit(index.pages).cast("long"), "tokens": F.lit(index.tokens).cast("long")})


@query("stream_delta_search", f"WITH {_LIVE}, {_BM25.replace('FROM documents', 'FROM live')} SELECT query_id, page_id, rank, round(score, 6) AS score FROM keyword WHERE rank <= {K}")
def stream_delta_search(spark, d):
    """The best pages for every benchmark passage, from the runs and the totals of the head."""
    found = delta_index(spark, d).search(question_terms(spark, d), K)
    return found.select("query_id", "page_id", "rank", F.round("score", 6).alias("score"))


@query(
    "stream_file_drops",
    """WITH f AS (SELECT '/inbox/' || doc_id || CASE lang WHEN 'de' THEN '.exe' WHEN 'fr' THEN '.PDF' ELSE '.md' END AS path, CAST(strlen(text) AS BIGINT) AS length,
        sha256(text) AS digest, lang <> 'de' AND text IS NOT NULL AS usable, CAST(doc_id % 3 AS INT) AS batch FROM documents),
      r AS (SELECT *, CASE WHEN usable THEN row_number() OVER (PARTITION BY usable, digest ORDER BY batch, path) END AS n,
        CASE WHEN usable THEN first_value(path) OVER (PARTITION BY usable, digest ORDER BY batch, path) END AS first_path FROM f)
      SELECT path, length, digest, CASE WHEN NOT usable THEN 'unsupported' WHEN n = 1 THEN 'new' ELSE 'duplicate' END AS verdict, coalesce(first_path, '') AS first_path, batch FROM r""",
)
def stream_file_drops(spark, d):
    """Every document dropped as a file in one of three batches: what is new, what is there under another name, what is not read."""
    suffix = F.when(F.col("lang") == "de", ".exe").when(F.col("lang") == "fr", ".PDF").otherwise(".md")
    files = table(spark, d, "documents").select(
        F.col("doc_id"), F.concat(F.lit("/inbox/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"),
    )
    folder = f"{checkpoint_dir(spark)}/drops-{uuid.uuid4().hex}"
    steps = [files.filter(F.col("doc_id") % 3 == n).drop("doc_id") for n in range(3)]
    arriving(spark, steps, lambda rows: P.take_drops(rows, f"{folder}/out", f"{folder}/state", fanout=2))
    judged = P.verdicts(spark, f"{folder}/out")
    return judged.select("path", "length", "digest", "verdict", F.coalesce("first_path", F.lit("")).alias("first_path"), "batch")
