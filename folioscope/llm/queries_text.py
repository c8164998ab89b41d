"""Queries over `documents`: quality rules, near copies, line dedup, toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, quality, simhash, toxicity
from .registry import query, table

_BROKEN = {">=": "<", "<=": ">", ">": "<=", "<": ">="}
_SQL_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SQL_MEASURES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS body, {_SQL_WORDS} AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
p AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
q AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS k FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_intersect(list_transform(ws, lambda x: lower(x)), {list(quality.STOP_WORDS)!r})) AS n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullets, length(regexp_replace(body, '\\P{{Lu}}', '', 'g')) AS n_upper
    FROM w LEFT JOIN q USING (doc_id)),
s AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
        CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_ratio, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
_SQL_RULES = " OR ".join(f"{measure} {_BROKEN[how]} {bound}" for _, measure, how, bound in quality.RULES)


@query("op4_quality_rules", f"{_SQL_MEASURES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {_SQL_RULES}) AS kept FROM s")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_simhash_near_copies")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    classes = simhash.near_copies(table(spark, folder, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_SQL_LINES = """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line, len(ls) AS all_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
n AS (SELECT doc_id, pos, line, least(len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 50) AS n FROM l),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM n WHERE n > 0),
f AS (SELECT doc_id, pos, list(line) OVER here AS run, max(pos) OVER here AS ends, sum(n) OVER here AS held, list(line) OVER later AS tail, list(pos) OVER later AS tail_pos
    FROM s WINDOW here AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), later AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 50 FOLLOWING AND 99 FOLLOWING)),
w AS (SELECT doc_id, pos, array_to_string(run, chr(10)) AS run, ends, coalesce(tail, []) AS tail, coalesce(tail_pos, []) AS tail_pos FROM f WHERE held >= 50),
t AS (SELECT doc_id, pos, ends, run, tail, tail_pos, unnest(range(0, len(tail) + 1)) AS k FROM w),
g AS (SELECT doc_id, pos, CASE WHEN k > 0 THEN tail_pos[k] ELSE ends END AS b, min({'d': doc_id, 'p': pos}) OVER (PARTITION BY run, tail[1:k]) AS first FROM t),
c AS (SELECT doc_id, pos AS a, max(b) AS b FROM g WHERE NOT (doc_id = first.d AND pos = first.p) GROUP BY doc_id, pos),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM c),
k AS (SELECT l.doc_id, count(x.pos) AS n_deleted, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL) AS body FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT doc_id, n_deleted::BIGINT AS n_deleted, coalesce(body, '') AS text FROM k
"""


@query("op8_line_dedup", _SQL_LINES)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_deleted", "text")


@query("op9_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")
