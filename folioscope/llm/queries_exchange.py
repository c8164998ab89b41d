"""Queries over `documents` of the exchange and search operators: manifest, ranked search, exact dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, lexical, merkle
from .registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: crc32 of a decimal number: bit by bit over its bytes, by the reflected polynomial.
_SQL_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))"
_SQL_MANIFEST = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce('+' || lang, '') AS g FROM
    (SELECT doc_id, lang, {_SQL_LEAF.format(text='text')} AS leaf,
        CASE WHEN xor({_SQL_CRC}, 4294967295::UBIGINT) % 3 = 0 THEN {_SQL_LEAF.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_SQL_LEAF.format(text='text')} END AS tried FROM documents)),
low AS (SELECT g, 0 AS level, pos, leaf AS h FROM d
    UNION ALL SELECT g, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM low) WHERE n > 1 GROUP BY g, pos // 8),
subs AS MATERIALIZED (SELECT g, arg_max(h, level) AS subroot, max(level) AS top, row_number() OVER (ORDER BY g) - 1 AS place FROM low GROUP BY g),
high AS (SELECT 0 AS level, place AS pos, subroot AS h FROM subs
    UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY pos // 8),
nodes AS MATERIALIZED (SELECT low.g, level, pos, h FROM low JOIN subs USING (g) WHERE level < top UNION ALL SELECT g, top + level, pos, h FROM subs, (SELECT * FROM high WHERE level < (SELECT max(level) FROM high))),
way AS (SELECT doc_id, leaf, d.g, d.pos AS first, 0 AS level, CASE WHEN top = 0 THEN place ELSE d.pos END AS here, tried AS h, '' AS proof FROM d JOIN subs USING (g)
    UNION ALL SELECT doc_id, leaf, g, first, level + 1, any_value(later), sha256(string_agg(CASE WHEN pos = here THEN h ELSE other END, '' ORDER BY pos)),
        any_value(proof) || coalesce(string_agg(other, '' ORDER BY pos) FILTER (WHERE pos <> here), '')
    FROM (SELECT w.*, n.pos, n.h AS other, CASE WHEN w.level + 1 = top THEN place ELSE here // 8 END AS later
        FROM way w JOIN nodes n ON n.g = w.g AND n.level = w.level AND n.pos // 8 = w.here // 8 JOIN subs s ON s.g = w.g) GROUP BY doc_id, leaf, g, first, level),
ends AS (SELECT * FROM way QUALIFY level = max(level) OVER (PARTITION BY g, first))
SELECT doc_id, leaf, subroot, (SELECT h FROM high ORDER BY level DESC LIMIT 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM high ORDER BY level DESC LIMIT 1) AS verified
FROM ends JOIN subs USING (g)
"""


@query("op11_merkle", _SQL_MANIFEST)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    made = merkle.document_manifest(table(spark, folder, "documents"), tampered={"text": lower})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_SQL_TERMS = f"list_filter(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_SQL_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS ts FROM documents), n AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, m, t, count(*) AS tf FROM (SELECT r, doc_id, 75 + (25 * len(ts)::HUGEINT * n) // l AS m, unnest(ts) AS t FROM d, n) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), n),
q AS (SELECT k, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest({_SQL_TERMS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT k, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) GROUP BY ALL HAVING sum(times * w) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20
"""


@query("op12_ranked_search", _SQL_RANKED)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


_SQL_EXACT = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256 FROM d
"""


@query("op13_exact_dedup", _SQL_EXACT)
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exactdedup.groups_of_equal_texts(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
