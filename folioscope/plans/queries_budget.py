"""Reading under a limit of calls, and summaries judged between attempts, with stand-ins for the model that fail by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import ledger as L
from folioscope.operators import rounds as R
from folioscope.operators.notes import merge_calls
from folioscope.plans.corpus import fold, table
from folioscope.plans.registry import query

#: Calls per source, notes that need no merging, calls kept back.
LIMIT, FAN_IN, FINALE = 20, 4, 7


def _stand_in(prompts: list[str]) -> list[str]:
    """Too slow, good only when asked again, or never good, by the length of the text."""
    out = []
    for p in prompts:
        base = p.split("\n\nThis answer was refused")[0]
        rest = len(base) % 7
        if rest == 0:
            raise TimeoutError
        out.append("" if rest == 2 or (rest == 1 and base == p) else base[:10])
    return out


_RESERVES = [FINALE + merge_calls(n, FAN_IN) for n in range(1, LIMIT + 1)]


@query(
    "budgeted_reading",
    f"""WITH RECURSIVE c AS (SELECT doc_id, i, length(l) AS n, CASE length(l) % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN length(l) >= {L.MIN_SPLIT} THEN 4 ELSE 2 END ELSE 1 END AS cost
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
        run AS (SELECT DISTINCT doc_id, -1::BIGINT AS i, 0::BIGINT AS used, false AS stopped FROM c
          UNION ALL SELECT r.doc_id, c.i, r.used + least(greatest(a, 0), cost), a < cost FROM run r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1,
            LATERAL (SELECT {LIMIT} - r.used - CASE WHEN c.i < {LIMIT} THEN {_RESERVES}[c.i + 1] ELSE {LIMIT} END AS a) WHERE NOT r.stopped)
        SELECT doc_id, max(used)::BIGINT AS calls, min(i) FILTER (stopped) AS unread_from, ((SELECT count(*) FROM c WHERE c.doc_id = run.doc_id) - coalesce(min(i) FILTER (stopped), (SELECT count(*) FROM c WHERE c.doc_id = run.doc_id)))::BIGINT AS unread
        FROM run GROUP BY doc_id""",
)
def budgeted_reading(spark, d):
    """Every line of every document as a chunk: the calls charged to each document, and where reading stops."""
    docs = table(spark, d, "documents").filter("text is not null")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))
    done = L.read_within_budget(chunks, _stand_in, LIMIT, FAN_IN, lambda a: "" if a else "empty", FINALE, prompt=F.col("chunk"))
    left = done["unread"].groupBy("doc_id").agg(F.min("seq").alias("unread_from"), F.count(F.lit(1)).alias("unread"))
    out = done["used"].withColumnRenamed("used", "calls").join(left, "doc_id", "left")
    return out.select("doc_id", "calls", "unread_from", F.coalesce("unread", F.lit(0)).alias("unread"))


def _summaries(rows):
    """A stand-in in column expressions: one of four pages is answered well, one only when told which words are unknown, one never, and
    one not at all."""
    start = F.regexp_replace(F.regexp_replace(F.substring("text", 1, 300), r"\S*\z", ""), r"[ \t\n\r]+\z", "")
    kind = F.col("page_id") % 4
    told = F.col("prompt").contains("unknown: ")
    output = F.when(kind == 0, start).when(kind == 1, F.when(told, start).otherwise(F.concat(start, F.lit(" or Zorbla 4711")))).when(kind == 2, F.concat(start, F.lit(" [[Page]]")))
    return rows.withColumns({"output": output, "error": F.when(output.isNull(), "timed out").otherwise("")})


_EN = "'the','of','and','to','in','is','that','for','with','are','this','on','as','by','from','be','an'"
_ES = "'de','la','el','que','en','los','las','y','un','una','para','con','por','del','se','es','al','como','más','pero','sus'"


@query(
    "consolidated_pages",
    rf"""WITH d AS (SELECT doc_id AS page_id, text, regexp_replace(regexp_replace(left(text, 300), '\S*\z', ''), '[ \t\n\r]+\z', '') AS start FROM documents WHERE text IS NOT NULL),
    a AS (SELECT page_id, 1 AS attempt, CASE page_id % 4 WHEN 0 THEN start WHEN 1 THEN start || ' or Zorbla 4711' WHEN 2 THEN start || ' [[Page]]' END AS said FROM d
      UNION ALL SELECT page_id, 2, CASE page_id % 4 WHEN 0 THEN start WHEN 1 THEN start WHEN 2 THEN start || ' [[Page]]' END FROM d),
    s AS (SELECT page_id, attempt, trim(said, E' \t\n\r') AS said FROM a WHERE said IS NOT NULL),
    l AS (SELECT *, len(list_filter(t, lambda w: w IN ({_EN}))) AS en, len(list_filter(t, lambda w: w IN ({_ES}))) AS es FROM (SELECT *, regexp_extract_all(lower(said), '\p{{L}}+') AS t FROM s)),
    sen AS (SELECT page_id, attempt, unnest(string_split(regexp_replace(said, '([.!?])\s+', E'\\1\x1f', 'g'), E'\x1f')) AS q FROM s),
    w AS (SELECT page_id, attempt, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT page_id, attempt, regexp_extract_all(q, '[\p{{L}}\p{{N}}_-]+') AS t FROM sen)),
    known AS (SELECT DISTINCT page_id, unnest(regexp_extract_all({fold("text")}, '[\p{{L}}\p{{N}}_-]+')) AS k FROM d),
    odd AS (SELECT page_id, attempt, count(DISTINCT w) AS n FROM w WHERE (regexp_matches(w, '\p{{Nd}}') OR (i > 0 AND regexp_matches(w, '^\p{{Lu}}')))
      AND NOT EXISTS (SELECT 1 FROM known WHERE known.page_id = w.page_id AND known.k = {fold("w")}) GROUP BY 1, 2),
    p AS (SELECT page_id, attempt, said, NOT length(said) BETWEEN 80 AND 900 AS size, regexp_matches(said, '\[\[|\]\(|<|!\[|https?://') AS markup, es >= 4 AND es > 1.5 * en AS lang, coalesce(n, 0) AS unknown
      FROM l LEFT JOIN odd USING (page_id, attempt)),
    r AS (SELECT *, concat_ws(',', CASE WHEN lang THEN 'language' END, CASE WHEN size THEN 'length' END, CASE WHEN markup THEN 'markup' END, CASE WHEN unknown > 0 THEN 'unknown' END) AS reasons,
      size::INT + markup::INT + lang::INT + unknown AS problems FROM p),
    pairs AS (SELECT f.page_id, f.reasons AS first_reasons, f.problems AS first_problems, CASE WHEN f.problems = 0 THEN 1 ELSE 2 END AS tries,
      CASE WHEN f.page_id % 4 <> 1 OR f.unknown > 0 THEN t.said ELSE f.said END AS second, CASE WHEN f.page_id % 4 <> 1 OR f.unknown > 0 THEN t.reasons ELSE f.reasons END AS second_reasons, f.said AS said
      FROM r f JOIN r t ON t.page_id = f.page_id AND f.attempt = 1 AND t.attempt = 2)
    SELECT page_id, CAST(tries AS INT) AS tries, CASE WHEN tries = 1 OR second_reasons = '' THEN 'passed' ELSE 'review' END AS status, first_reasons, CAST(first_problems AS BIGINT) AS first_problems,
      CASE WHEN tries = 1 THEN '' ELSE second_reasons END AS last_reasons, md5(CASE WHEN tries = 1 THEN said ELSE second END) AS summary FROM pairs
    UNION ALL SELECT page_id, 1, 'unanswered', '', 0, '', '' FROM d WHERE page_id % 4 = 3""",
)
def consolidated_pages(spark, d):
    """A summary of every document, judged against its whole text between two attempts: what was wrong, how often it was asked, what stays."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("page_id"), "text")
    last, every = R.sound_summaries(docs.withColumn("prompt", F.lit("Sum up.")), _summaries, docs)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("problems", lambda p: F.split_part(p, F.lit(":"), F.lit(1))))), ",")
    first = every.filter("attempt = 1").select("page_id", kinds.alias("first_reasons"), F.size("problems").cast("long").alias("first_problems"))
    return last.join(first, "page_id").select(
        "page_id", F.col("attempt").alias("tries"), "status", "first_reasons", "first_problems", kinds.alias("last_reasons"), F.coalesce(F.md5("output"), F.lit("")).alias("summary")
    )
