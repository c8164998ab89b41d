"""Queries over `pages` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import maxscore, warc
from .registry import query, table

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are twenty bits, four base-32 letters.
_LETTERS = " || ".join(f"'{_BASE32}'[1 + ((x >> {s}) & 31)]" for s in (15, 10, 5, 0))
_SQL_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body)::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda g: list_transform([('0x' || substr(sha1(body), 1 + 5 * g, 5))::BIGINT], lambda x: {_LETTERS})[1]), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS chosen FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = chosen THEN NULL ELSE chosen END AS refers_to FROM m
"""


@query("op1_warc_zstd", _SQL_WARC)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op10_maxscore", _SQL_TOP_K)
def top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = maxscore.integer_vectors(table(spark, folder, "embeddings"))
    return maxscore.search(vectors.filter("id % 100 = 0"), vectors)
