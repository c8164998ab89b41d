"""The capture queue, runs, model trials and other operational statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators import captures as Q
from folioscope.operators import mail as M
from folioscope.operators import privacy as S
from folioscope.operators import reports as R
from folioscope.operators import runs as O
from folioscope.plans.corpus import table, wiki_pages, with_wiki
from folioscope.plans.queries_text import NORMED, url_variants
from folioscope.plans.registry import query
from folioscope.sources import files as FS

_WITH = f"WITH {NORMED}"


def queue(spark, d):
    """Page addresses as queue items: an event with the page's number gives its state."""
    states = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    status = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "signup", "processing").otherwise("queued")
    )
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("target"))
    return pages.join(states, "id").select(
        "id", "target", U.normalize_url("target").alias("target_norm"), status.alias("status"), F.lit(None).cast("string").alias("label")
    )


_QUEUE = rf"""variants AS (SELECT page_id, url AS target, 0 AS variant FROM pages), {NORMED[NORMED.index("parts AS") :]},
queue AS (SELECT n.page_id AS id, n.target, n.target_norm, CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'processing' ELSE 'queued' END AS status
  FROM normed n JOIN events e ON e.event_id = n.page_id)"""
_KNOWN = "known AS (SELECT target_norm FROM normed JOIN documents ON doc_id = page_id WHERE lang <> 'en')"


def _known_sources(spark, d):
    """Sources that have an address already: the pages of documents not in English."""
    docs = table(spark, d, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("page_id"))
    return table(spark, d, "pages").join(docs, "page_id", "left_semi").select("url")


@query(
    "dedup_captures",
    _WITH
    + """ SELECT target_norm, arg_min(target, (variant, page_id)) AS target, arg_min(page_id, (variant, page_id)) AS page_id, count(*) - 1 AS duplicates FROM normed GROUP BY target_norm""",
)
def dedup_captures(spark, d):
    kept = Q.dedup_captures(url_variants(spark, d), ["variant", "page_id"])
    return kept.select("target_norm", "target", "page_id", "duplicates")


@query(
    "import_link_lists",
    _WITH
    + r""", listed AS (SELECT target_norm, target, variant, CASE WHEN variant = 2 THEN NULL ELSE DATE '2024-01-01' + CAST((page_id % 28 + variant) AS INTEGER) END AS day FROM normed WHERE regexp_matches(target, '^[^\])>]+$'))
    SELECT target_norm, coalesce(CAST(min(day) AS VARCHAR), '') AS captured FROM listed GROUP BY target_norm""",
)
def import_link_lists(spark, d):
    """One list per day and spelling; the third spelling sits in lists with odd names."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28 + F.col("variant")).cast("int"))
    name = F.when(F.col("variant") == 2, F.concat(F.lit("odd "), F.col("page_id").cast("string"))).otherwise(F.date_format(day, "dd-MM-yyyy"))
    rows = url_variants(spark, d).select(name.alias("name"), F.concat(F.lit("- ["), "target", F.lit("] saved")).alias("text"))
    kept = Q.import_link_lists(rows)
    return kept.select("target_norm", F.coalesce(F.col("captured").cast("string"), F.lit("")).alias("captured"))


@query(
    "known_docs",
    """WITH src AS (SELECT 'doc-' || doc_id AS title, doc_id, url, substr(sha256(text), 1, 16) AS h FROM documents LEFT JOIN pages ON page_id = doc_id WHERE lang = 'en'),
       by_url AS (SELECT url, arg_min(title, doc_id) AS t FROM src WHERE url IS NOT NULL GROUP BY url), by_hash AS (SELECT h, arg_min(title, doc_id) AS t FROM src GROUP BY h)
       SELECT d.doc_id, coalesce(u.t, b.t, '') AS existing FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
       LEFT JOIN by_url u ON u.url = p.url LEFT JOIN by_hash b ON b.h = substr(sha256(d.text), 1, 16)""",
)
def known_docs(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = table(spark, d, "documents").join(pages, "doc_id", "left").withColumn("content_hash", T.content_hash("text"))
    title = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    sources = docs.filter("lang = 'en'").select("url", "content_hash", title.alias("title"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    found = Q.known_docs(docs.select("doc_id", "url", "content_hash"), sources)
    return found.select("doc_id", F.coalesce("existing_title", F.lit("")).alias("existing"))


@query(
    "exact_dups",
    """WITH h AS (SELECT doc_id, sha256(text) AS g FROM documents), n AS (SELECT g, min(doc_id) AS first, count(*) AS copies FROM h GROUP BY g HAVING count(*) > 1)
       SELECT doc_id, substr(g, 1, 16) AS content_hash, first, copies FROM h JOIN n USING (g)""",
)
def exact_dups(spark, d):
    return Q.exact_dups(table(spark, d, "documents"))


@query("pending", f"WITH {_QUEUE}, {_KNOWN} SELECT id, target FROM queue WHERE status = 'queued' AND target_norm NOT IN (SELECT target_norm FROM known)")
def pending(spark, d):
    return Q.pending(queue(spark, d), _known_sources(spark, d)).select("id", "target")


@query("status_counts", f"WITH {_QUEUE} SELECT status, count(*) AS n FROM queue GROUP BY status")
def status_counts(spark, d):
    return Q.status_counts(queue(spark, d))


@query(
    "next_batch",
    f"WITH {_QUEUE} SELECT id, target FROM queue WHERE status = 'queued' AND id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es') ORDER BY id LIMIT 10",
)
def next_batch(spark, d):
    tried = table(spark, d, "documents").filter("lang = 'es'").select(F.col("doc_id").alias("id"))
    return Q.next_batch(queue(spark, d), 10, tried).select("id", "target")


@query(
    "queue_preview",
    f"""WITH {_QUEUE}, {_KNOWN}, p AS (SELECT * FROM queue WHERE status = 'queued' AND target_norm NOT IN (SELECT target_norm FROM known))
    SELECT id, target AS name FROM p ORDER BY id LIMIT 20""",
)
def queue_preview(spark, d):
    return Q.queue_preview(queue(spark, d), _known_sources(spark, d))[0]


@query(
    "queue_preview_total",
    f"WITH {_QUEUE}, {_KNOWN} SELECT count(*) AS total FROM queue WHERE status = 'queued' AND target_norm NOT IN (SELECT target_norm FROM known)",
)
def queue_preview_total(spark, d):
    return Q.queue_preview(queue(spark, d), _known_sources(spark, d))[1]


def attempt_events(spark, d):
    """Every event as a step of the retry ledger of its user's item."""
    kind = F.col("event_type")
    big = F.col("value") > 20
    event = (
        F.when(kind == "error", F.when(big, "fail").otherwise("recover")).when(kind == "purchase", "done")
        .when(kind == "signup", F.when(F.col("value") > 120, "drop").otherwise("reset")).when(kind == "view", "release").otherwise("claim")
    )
    return table(spark, d, "events").select(
        F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")).alias("target_norm"), "ts", F.col("event_id").alias("seq"), event.alias("event")
    )


_STEP = """{'s': CASE WHEN e.ev = 'drop' OR x.s = 'absent' THEN 'absent' WHEN e.ev = 'claim' AND x.s = 'queued' THEN 'processing' WHEN e.ev = 'done' THEN 'done'
  WHEN e.ev = 'fail' OR (e.ev = 'recover' AND x.s = 'processing') THEN (CASE WHEN x.n + 1 >= 3 THEN 'failed' ELSE 'queued' END)
  WHEN e.ev = 'release' AND x.s = 'processing' THEN 'queued' WHEN e.ev = 'reset' AND x.s = 'failed' THEN 'queued' ELSE x.s END,
  'n': CASE WHEN e.ev = 'drop' OR x.s = 'absent' OR (e.ev = 'reset' AND x.s = 'failed') THEN 0
  WHEN e.ev = 'fail' OR (e.ev = 'recover' AND x.s = 'processing') THEN least(x.n + 1, 3) ELSE x.n END, 'ev': ''}"""
LEDGER_SQL = f"""WITH ev AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN (CASE WHEN value > 20 THEN 'fail' ELSE 'recover' END) WHEN 'purchase' THEN 'done'
    WHEN 'signup' THEN (CASE WHEN value > 120 THEN 'drop' ELSE 'reset' END) WHEN 'view' THEN 'release' ELSE 'claim' END AS e FROM events),
  l AS (SELECT user_id, list({{'s': '', 'n': CAST(0 AS BIGINT), 'ev': e}} ORDER BY ts, event_id) AS es FROM ev GROUP BY user_id),
  z AS (SELECT user_id, list_reduce(list_prepend({{'s': 'queued', 'n': CAST(0 AS BIGINT), 'ev': ''}}, es), lambda x, e: {_STEP}) AS f FROM l)
  SELECT 'https://example.org/' || user_id AS target_norm, f.s AS status, f.n AS attempts FROM z"""


@query("queue_state", LEDGER_SQL + " WHERE f.s <> 'absent'")
def queue_state(spark, d):
    return Q.queue_state(attempt_events(spark, d), piece=50)


@query(
    "budget_cutoff",
    """WITH i AS (SELECT user_id, event_id, CAST(round(value * 10) AS BIGINT) AS tokens, round(value / 100, 4) AS usd FROM events),
    r AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tb,
      coalesce(sum(usd) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ub FROM i WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    y AS (SELECT *, CASE WHEN rn > 40 THEN 'max_sources' WHEN tb >= 6000 THEN 'token_budget' WHEN ub >= 5.00001 THEN 'usd_budget' END AS why FROM r),
    s AS (SELECT user_id, min(rn) AS rn, arg_min(why, rn) AS why FROM y WHERE why IS NOT NULL GROUP BY user_id)
    SELECT y.user_id, count(*) FILTER (s.rn IS NULL OR y.rn < s.rn) AS reached, coalesce(any_value(s.why), '') AS stopped_by FROM y LEFT JOIN s USING (user_id) GROUP BY y.user_id""",
)
def budget_cutoff(spark, d):
    items = table(spark, d, "events").select(
        "user_id", "event_id", F.round(F.col("value") * 10).cast("long").alias("tokens"), F.round(F.col("value") / 100, 4).alias("usd")
    )
    done = Q.budget_cutoff(items, ["user_id"], ["event_id"], 40, 6000, 5.00001)
    return done.groupBy("user_id").agg(F.count_if("run").alias("reached"), F.coalesce(F.max("stopped_by"), F.lit("")).alias("stopped_by"))


# ------------------------------------------------------------------------------------------- runs

_RUNS = """runs AS (SELECT user_id, min(ts) AS started, max(ts) AS finished, count(*) FILTER (event_type = 'purchase') AS ingested,
  count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(round(value)) AS BIGINT) AS tokens_used,
  CASE WHEN count(*) FILTER (event_type = 'error') >= 2 THEN 'llm_unavailable' END AS stopped_by,
  CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'manual' ELSE 'scheduled' END AS trigger
  FROM events GROUP BY user_id, date_trunc('day', ts))"""


def runs(spark, d):
    """The events of one user and day as one run."""
    kind = F.col("event_type")
    return (
        table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("_day"))
        .agg(
            F.min("ts").alias("started"), F.max("ts").alias("finished"), F.count_if(kind == "purchase").alias("ingested"),
            F.count_if(kind == "view").alias("skipped"), F.count_if(kind == "error").alias("failed"),
            F.sum(F.round("value")).cast("long").alias("tokens_used"),
            F.when(F.count_if(kind == "error") >= 2, "llm_unavailable").alias("stopped_by"),
            F.when(F.count_if(kind == "signup") > 0, "manual").otherwise("scheduled").alias("trigger"),
        ).drop("_day")
    )


@query(
    "runs_report",
    f"""WITH {_RUNS} SELECT CAST(started::DATE AS VARCHAR) AS day, strftime(started, '%H:%M') AS at, ingested, skipped, failed, tokens_used,
    CAST(floor((epoch_us(finished) - epoch_us(started)) / 60000000) AS BIGINT) AS minutes, coalesce(stopped_by, '') AS stopped_by, trigger = 'manual' AS manual FROM runs""",
)
def runs_report(spark, d):
    return O.runs_report(runs(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(
    "runs_by_ops_day",
    f"""WITH {_RUNS} SELECT CAST((started - INTERVAL 3 HOUR)::DATE AS VARCHAR) AS day, count(*) AS runs, CAST(sum(ingested) AS BIGINT) AS ingested, CAST(sum(skipped) AS BIGINT) AS skipped,
    CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(tokens_used) AS BIGINT) AS tokens_used, count(stopped_by) AS stopped FROM runs GROUP BY 1""",
)
def runs_by_ops_day(spark, d):
    return O.runs_by_day(runs(spark, d), "03:00").withColumn("day", F.col("day").cast("string"))


@query("newest_runs", f"WITH {_RUNS} SELECT user_id, CAST(started AS VARCHAR) AS started FROM (SELECT * FROM runs ORDER BY started DESC, user_id LIMIT 500)")
def newest_runs(spark, d):
    rows = O.newest_runs(runs(spark, d), 500, "user_id")
    return rows.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started")).withColumn(
        "started", F.regexp_replace("started", r"\.?0+$", "")
    )


# ----------------------------------------------------------------------------------------- models

_TRIALS = """trials AS (SELECT event_type AS model, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN 'ingest' ELSE 'ask' END AS task, value >= 5 AS ok,
  value >= 10 AS first_try, value AS latency_seconds, CAST(json_extract(props, '$.k') AS BIGINT) * 100 AS tokens, user_id > 20 AS in_language, user_id AS concepts, value >= 20 AS cites_expected FROM events),
prices AS (SELECT event_type AS model, round(avg(value), 2) AS usd_per_million FROM events WHERE event_type <> 'view' GROUP BY 1)"""
_SUMMARY = """summary AS (SELECT model, task, count(*) AS trials, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS ok_rate, avg(CASE WHEN first_try THEN 1.0 ELSE 0 END) AS first_try_rate,
  median(latency_seconds) AS median_latency_seconds, avg(tokens) AS tokens_per_case, sum(tokens) / 1000000.0 * coalesce(any_value(usd_per_million), 0) AS cost_usd,
  CASE WHEN task = 'ingest' THEN coalesce(avg(CASE WHEN in_language THEN 1.0 ELSE 0 END) FILTER (ok), 0) END AS language_rate,
  CASE WHEN task = 'ingest' THEN coalesce(avg(concepts) FILTER (ok), 0) END AS avg_concepts,
  CASE WHEN task = 'ask' THEN coalesce(avg(CASE WHEN cites_expected THEN 1.0 ELSE 0 END) FILTER (ok), 0) END AS cites_rate
  FROM trials LEFT JOIN prices USING (model) GROUP BY model, task)"""


def trials(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.when(k < 50, "ingest").otherwise("ask").alias("task"), (v >= 5).alias("ok"), (v >= 10).alias("first_try"),
        v.alias("latency_seconds"), (k * 100).alias("tokens"), (F.col("user_id") > 20).alias("in_language"), F.col("user_id").alias("concepts"), (v >= 20).alias("cites_expected"),
    )


def prices(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 2).alias("usd_per_million"))


@query(
    "model_summary",
    f"WITH {_TRIALS}, {_SUMMARY} SELECT model, task, trials, "
    + ", ".join(f"coalesce(round({c}, 6), -1) AS {c}" for c in ("ok_rate", "first_try_rate", "median_latency_seconds", "tokens_per_case", "cost_usd", "language_rate", "avg_concepts", "cites_rate"))
    + " FROM summary",
)
def model_summary(spark, d):
    rows = O.summarize_trials(trials(spark, d), prices(spark, d))
    return rows.select("model", "task", "trials", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in rows.columns[3:]])


@query(
    "suggest_routing",
    f"""WITH {_TRIALS}, {_SUMMARY} SELECT t.task, coalesce((SELECT arg_min(model, (-first_try_rate, -coalesce(language_rate, cites_rate, 0), median_latency_seconds, cost_usd, model))
    FROM summary s WHERE s.task = t.task AND ok_rate >= 0.8), '') AS model FROM (SELECT unnest(['ingest', 'ask']) AS task) t""",
)
def suggest_routing(spark, d):
    best = O.suggest_routing(O.summarize_trials(trials(spark, d), prices(spark, d)))
    return best.select("task", F.coalesce("model", F.lit("")).alias("model"))


@query(
    "spend",
    f"""WITH {_TRIALS}, u AS (SELECT user_id AS run_id, event_type AS model, CASE WHEN value > 30 THEN 'click' END AS fallback,
      CAST(json_extract(props, '$.k') AS BIGINT) * 100 AS tokens, value > 3 AS out FROM events)
    SELECT run_id, round(sum(CASE WHEN out THEN tokens / 1000000.0 * greatest(coalesce(p.usd_per_million, 0), coalesce(f.usd_per_million, 0)) ELSE 0 END), 6) AS usd,
      CAST(sum(tokens) AS BIGINT) AS tokens FROM u LEFT JOIN prices p ON p.model = u.model LEFT JOIN prices f ON f.model = u.fallback GROUP BY run_id""",
)
def spend(spark, d):
    v = F.col("value")
    usage = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("model"), F.when(v > 30, "click").alias("fallback"),
        (F.get_json_object("props", "$.k").cast("long") * 100).alias("tokens"), (v > 3).alias("sends_text_out"),
    )
    return O.spend(usage, prices(spark, d)).select("run_id", F.round("usd", 6).alias("usd"), "tokens")


@query(
    "ask_stats",
    """SELECT CAST(date_trunc('day', ts)::DATE AS VARCHAR) AS day, count(*) AS questions, round(avg(CASE WHEN value >= 5 THEN 1.0 ELSE 0 END), 6) AS grounded_rate,
       CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens, round(avg(value), 6) AS avg_seconds FROM events GROUP BY 1""",
)
def ask_stats(spark, d):
    v = F.col("value")
    asks = table(spark, d, "events").select(
        F.col("ts").alias("at"), (v >= 5).alias("grounded"), F.array("event_type").alias("cited"), F.lit(0).alias("unsupported"), F.round(v).cast("long").alias("tokens"), v.alias("seconds")
    )
    rows = O.ask_stats(asks)
    return rows.select(F.to_date("window_start").cast("string").alias("day"), "questions", F.round("grounded_rate", 6).alias("grounded_rate"), "tokens", F.round("avg_seconds", 6).alias("avg_seconds"))


@query(
    "home_counts",
    with_wiki(
        "SELECT (SELECT count(*) FROM wiki WHERE kind = 'sources' AND status = 'processed') AS unread, "
        "(SELECT count(*) FROM pages p JOIN events e ON e.event_id = p.page_id WHERE e.event_type IN ('view', 'click') AND p.page_id NOT IN (SELECT doc_id FROM documents)) AS queued"
    ),
)
def home_counts(spark, d):
    return R.home_counts(wiki_pages(spark, d), queue(spark, d))


# ------------------------------------------------------------------------------------------- mail


@query(
    "dedup_mail",
    r"""WITH m AS (SELECT conv_id * 1000 + turn AS uid, conv_id, role, 'mail:' || (CASE WHEN role = 'user' THEN conv_id || '.user@x' ELSE substr(sha256(text), 1, 16) END) AS source FROM conversations)
       SELECT source, min(uid) AS uid FROM m WHERE source NOT IN (SELECT 'mail:' || doc_id || '.user@x' FROM documents WHERE lang = 'es') GROUP BY source""",
)
def dedup_mail(spark, d):
    """User turns share one id per thread; answers have none and are known by their bytes."""
    message = F.when(F.col("role") == "user", F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit(".user@x>")))
    mail = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), message.alias("message_id"), F.col("text").alias("raw"))
    seen = table(spark, d, "documents").filter("lang = 'es'").select(F.concat(F.lit("mail:"), F.col("doc_id").cast("string"), F.lit(".user@x")).alias("source"))
    known = M.known_ids(seen, seen.filter("source like 'mail:1%'"))
    return M.dedup_mail(mail, known).select("source", "uid")


@query(
    "mail_intake",
    """SELECT event_id AS uid FROM events WHERE ts::DATE >= DATE '2024-01-06' OR event_type <> 'view' OR (user_id > 10 AND event_id > 500)""",
)
def mail_intake(spark, d):
    mail = table(spark, d, "events").select(
        F.col("event_id").alias("uid"), F.col("ts").alias("received"), (F.col("event_type") == "view").alias("seen"), F.when(F.col("user_id") > 10, "7").otherwise("6").alias("generation")
    )
    from datetime import date

    return M.intake(mail, date(2024, 1, 20), 500, "7").select("uid")


@query(
    "new_attachments",
    """SELECT min(conv_id * 1000 + turn) AS uid, substr(sha256(text), 1, 16) AS digest FROM conversations
       WHERE sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE role = 'assistant' AND turn > 2) GROUP BY 2""",
)
def new_attachments(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), F.lit(0).alias("pos"), "role", "turn", F.length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    kept = rows.filter("role = 'assistant' and turn > 2")
    fresh = M.new_attachments(rows.select("uid", "pos", "size", "digest"), kept)
    return fresh.select("uid", F.substring("digest", 1, 16).alias("digest"))


@query(
    "propagate_origin",
    _WITH
    + """, c AS (SELECT page_id, variant, target_norm, CASE WHEN starts_with(target_norm, 'https') THEN 'mail' ELSE 'web' END AS origin FROM normed WHERE variant = 0)
    SELECT page_id, 0 AS hop, origin FROM c UNION ALL SELECT page_id, 1, CASE WHEN origin = 'mail' THEN 'mail-link' ELSE 'post-link' END FROM c""",
)
def propagate_origin(spark, d):
    """Addresses that came by mail or from the web, and one link followed from each."""
    pages = table(spark, d, "pages").select("page_id", U.normalize_url("url").alias("target_norm"))
    origin = F.when(F.col("target_norm").startswith("https"), "mail").otherwise("web")
    posts = pages.select("page_id", F.lit(0).alias("hop"), "target_norm", F.lit(None).cast("string").alias("via"), origin.alias("origin"))
    links = pages.select("page_id", F.lit(1).alias("hop"), F.concat("target_norm", F.lit("/next")).alias("target_norm"), F.col("target_norm").alias("via"), F.lit("post-link").alias("origin"))
    return S.propagate_origin(posts.unionByName(links)).select("page_id", "hop", "origin")


@query(
    "changed_pages",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'changed' WHEN lang = 'es' THEN 'new' ELSE 'deleted' END AS change FROM documents WHERE lang IN ('en', 'es', 'de')""",
)
def changed_pages(spark, d):
    """Two manifests of the documents: English ones grew, Spanish ones are new, German ones gone."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.length("text").alias("size"))
    before = rows.filter("lang <> 'es'")
    now = rows.filter("lang <> 'de'").withColumn("size", F.col("size") + (F.col("lang") == "en").cast("int"))
    return FS.changed_pages(before, now).select(F.col("path").cast("long").alias("doc_id"), "change")


@query(
    "file_drops",
    """WITH u AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE lang <> 'de' GROUP BY text)
       SELECT 'new' AS verdict, count(*) AS files FROM u UNION ALL SELECT 'duplicates', (SELECT count(*) FROM documents WHERE lang <> 'de') - (SELECT count(*) FROM u)
       UNION ALL SELECT 'unsupported', count(*) FROM documents WHERE lang = 'de'""",
)
def file_drops(spark, d):
    suffix = F.when(F.col("lang") == "de", ".exe").otherwise(".md")
    drops = table(spark, d, "documents").select(
        F.concat(F.lit("/inbox/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.octet_length("text").alias("length"), F.encode("text", "UTF-8").alias("content")
    )
    none = spark.createDataFrame([], "length int, digest string")
    parts = FS.ingest_files(drops, none)
    out = [df.agg(F.lit(name).alias("verdict"), F.count(F.lit(1)).alias("files")) for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "parse_pages",
    r"""SELECT doc_id, 'Note ' || doc_id AS title, source || '|' || lang || ', too' AS aliases, CAST(2 AS BIGINT) AS n_sources, CASE WHEN lang = 'de' THEN '' ELSE '2024-01-05' END AS processed,
        md5(trim(text, E' \t\n\r')) AS body FROM documents""",
)
def parse_pages(spark, d):
    """Every document written as a Markdown page with a head, and read back."""
    number = F.col("doc_id").cast("string")
    day = F.when(F.col("lang") == "de", "null").otherwise("2024-01-05")
    page = F.concat(
        F.lit("---\ntype: source\ntitle: 'Note "), number, F.lit("'\naliases:\n- "), "source", F.lit('\n- "'), "lang", F.lit(', too"\nsources: ["[[A]]", "[[B, C]]"]\nprocessed: '),
        day, F.lit("\nread: null\n---\n\n"), "text", F.lit("\n"),
    )
    rows = table(spark, d, "documents").select(F.concat(F.lit("/vault/wiki/sources/"), number, F.lit(".md")).alias("path"), page.alias("content"))
    parsed = FS.parse_pages(rows)
    return parsed.select(
        F.col("stem").cast("long").alias("doc_id"), "title", F.array_join("aliases", "|").alias("aliases"), F.size("sources").cast("long").alias("n_sources"),
        F.coalesce(F.col("processed").cast("string"), F.lit("")).alias("processed"), F.md5("body").alias("body"),
    )


@query(
    "audit_rows",
    """SELECT CAST(ts::DATE AS VARCHAR) AS day, event_id AS op_id, CASE WHEN c.turn IS NULL THEN '' ELSE c.role || ': ' || c.turn END AS detail
       FROM events LEFT JOIN conversations c ON c.conv_id = event_id""",
)
def audit_rows(spark, d):
    operations = table(spark, d, "events").select(F.col("event_id").alias("op_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("operation"), F.col("event_type").alias("title"))
    touched = table(spark, d, "conversations").select(F.col("conv_id").alias("op_id"), F.col("role").alias("change"), F.col("turn").cast("string").alias("title"))
    return FS.audit_rows(operations, touched).select(F.col("day").cast("string").alias("day"), "op_id", "detail")
