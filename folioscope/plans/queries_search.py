"""Retrieval: keyword search, dense search, fusion and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.values import SEARCH_STOPWORDS
from folioscope.operators import search as S
from folioscope.operators.common import top_k
from folioscope.plans.corpus import STOPWORDS, fold, shared, table
from folioscope.plans.registry import query

K = 6


def search_pages(spark, d):
    """Documents as searchable pages: the source group is the title, the language an alias."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.array("lang").alias("aliases"), F.col("text").alias("body")
    )


def question_terms(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return S.query_terms(asked)


def index(spark, d):
    return shared(spark, d, "postings", lambda: S.postings(search_pages(spark, d)))


def index_size(spark, d):
    """(pages, mean length) from the postings themselves, which carry every page's length."""
    lengths = index(spark, d).groupBy("page_id").agg(F.first("page_len").alias("n"))
    row = lengths.agg(F.count(F.lit(1)).alias("pages"), F.avg("n").alias("mean")).first()
    return row["pages"], row["mean"]


_INDEX = rf"""
words AS (SELECT page_id, field, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS term FROM (
  SELECT doc_id AS page_id, 0 AS field, {fold("source")} AS t FROM documents
  UNION ALL SELECT doc_id, 1, {fold("lang")} FROM documents UNION ALL SELECT doc_id, 2, {fold("text")} FROM documents)),
postings AS (SELECT term, page_id, count(*) FILTER (field = 0) AS tf_title, count(*) FILTER (field = 1) AS tf_alias,
  count(*) FILTER (field = 2) AS tf_body FROM words GROUP BY ALL),
lens AS (SELECT page_id, count(*) AS page_len FROM words GROUP BY page_id)"""

_QUERY_WORDS = f"""
qtok AS (SELECT item_id, unnest(l) AS term, unnest(range(len(l))) AS p FROM (
  SELECT item_id, regexp_extract_all({fold("text")}, '[a-z]{{4,}}') AS l FROM benchmark)),
qterms AS (SELECT item_id AS query_id, term, place FROM (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS place FROM (
    SELECT item_id, term, count(*) AS n, min(p) AS p FROM qtok WHERE term NOT IN ({STOPWORDS}) GROUP BY ALL)) WHERE place <= 20)"""

_BM25 = f"""{_INDEX}, {_QUERY_WORDS},
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
size AS (SELECT count(*) AS n, avg(page_len) AS mean FROM lens),
parts AS (SELECT q.query_id, p.page_id, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 0) AS idf,
    5.0 * tf_title + 3.0 * tf_alias + tf_body AS f, 1.2 * (0.25 + 0.75 * page_len / mean) AS norm
  FROM qterms q JOIN postings p USING (term) JOIN df USING (term) JOIN lens USING (page_id), size),
scores AS (SELECT query_id, page_id, sum(idf * f * 2.2 / (f + norm)) AS score FROM parts GROUP BY ALL),
keyword AS (SELECT query_id, page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM scores)"""


@query(
    "postings",
    f"WITH {_INDEX} SELECT page_id, count(*) AS terms, CAST(sum(tf_title) AS BIGINT) AS in_title, CAST(sum(tf_alias) AS BIGINT) AS in_alias,"
    " CAST(sum(tf_body) AS BIGINT) AS in_body, CAST(any_value(page_len) AS BIGINT) AS page_len,"
    " md5(string_agg(term || ':' || tf_body, ' ' ORDER BY term)) AS body_md5 FROM postings JOIN lens USING (page_id) GROUP BY page_id",
)
def postings(spark, d):
    rows = S.postings(search_pages(spark, d))
    entry = F.concat("term", F.lit(":"), F.col("tf_body").cast("string"))
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf_title").alias("in_title"), F.sum("tf_alias").alias("in_alias"), F.sum("tf_body").alias("in_body"),
        F.max("page_len").cast("long").alias("page_len"), F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("term", entry.alias("e"))))["e"], " ")).alias("body_md5"),
    )


@query("query_terms", f"WITH {_QUERY_WORDS} SELECT query_id, string_agg(term, ' ' ORDER BY place) AS words FROM qterms GROUP BY query_id")
def query_terms(spark, d):
    return question_terms(spark, d).select("query_id", F.array_join("words", " ").alias("words"))


@query("bm25", f"WITH {_BM25} SELECT query_id, page_id, rank, round(score, 6) AS score FROM keyword WHERE rank <= {K}")
def bm25(spark, d):
    found = S.bm25(question_terms(spark, d), index(spark, d), K, index_size(spark, d))
    return found.select("query_id", "page_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_from_text", f"WITH {_BM25} SELECT query_id, page_id, rank FROM keyword WHERE rank <= {K}")
def bm25_from_text(spark, d):
    """The same search with no stored index: pages are tokenized as they are read."""
    return S.bm25(question_terms(spark, d), None, K, pages=search_pages(spark, d)).select("query_id", "page_id", "rank")


# ------------------------------------------------------------------------------------------ dense


def chunk_vectors(spark, d):
    """Vectors in pages of chunks: the label and the sign of the first value make a page."""
    page = F.col("vec_id") - F.col("label") % 4
    return table(spark, d, "embeddings").select(
        page.alias("page_id"), F.when(F.get("embedding", F.lit(0)) > 0.2, -1).otherwise(F.col("label")).alias("chunk"), F.col("embedding").alias("vec")
    )


def query_vectors(spark, d):
    """One query per label: its first vector."""
    first = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"))
    return first.select(F.col("label").cast("long").alias("query_id"), "vec")


_DENSE = """
v AS (SELECT vec_id - label % 4 AS page_id, label, vec_id, embedding,
  list_transform(embedding, lambda x: CAST(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT)::DOUBLE) AS u FROM embeddings),
q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(u, vec_id) AS u FROM v GROUP BY label),
dense AS (SELECT query_id, page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM (
  SELECT q.query_id, v.page_id, max(list_dot_product(q.u, v.u)) AS score FROM q, v WHERE NOT v.embedding[1] > CAST(0.2 AS DOUBLE) GROUP BY ALL))"""


@query("dense_search", f"WITH {_DENSE} SELECT query_id, page_id, rank, round(score, 5) AS score FROM dense WHERE rank <= 50")
def dense_search(spark, d):
    found = S.dense_search(query_vectors(spark, d), chunk_vectors(spark, d), 50)
    return found.select("query_id", "page_id", "rank", F.round("score", 5).alias("score"))


@query("dense_search_blocks", f"WITH {_DENSE} SELECT query_id, page_id, rank FROM dense WHERE rank <= 10")
def dense_search_blocks(spark, d):
    """The way taken when the queries are too many to broadcast."""
    queries, vectors = query_vectors(spark, d), chunk_vectors(spark, d).filter("chunk >= 0").select("page_id", "vec")
    found = S._dense_by_blocks(queries, vectors, 10, queries.count(), "query_id long, page_id long, score double")
    best = found.groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.round("score", 9).desc(), F.col("page_id")], 10).select("query_id", "page_id", "rank")


# ---------------------------------------------------------------------------------- fused search

_TEXT_DENSE = f"""{_BM25}, {_DENSE},
kw50 AS (SELECT query_id, page_id, rank, 0 AS list FROM keyword WHERE rank <= 50),
both_lists AS (SELECT * FROM kw50 UNION ALL SELECT item_id, page_id, rank, 1 FROM dense JOIN benchmark ON query_id = item_id % 10 WHERE rank <= 50),
fused AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, min((list, rank))) AS rank,
  round(sum(1.0 / (60 + rank)), 9) AS score FROM both_lists GROUP BY query_id, page_id)"""


def question_vectors(spark, d):
    """A query vector per question: that of the label its number ends in."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("label"))
    return asked.join(query_vectors(spark, d).withColumnRenamed("query_id", "label"), "label").select("query_id", "vec")


@query("rank_fusion", f"WITH {_TEXT_DENSE} SELECT query_id, page_id, rank, score FROM fused")
def rank_fusion(spark, d):
    keyword = S.bm25(question_terms(spark, d), index(spark, d), 50, index_size(spark, d))
    dense = S.dense_search(question_vectors(spark, d), chunk_vectors(spark, d), 50)
    return S.rrf(keyword, dense).withColumn("score", F.round("score", 9))


@query(
    "hybrid_search",
    f"""WITH {_TEXT_DENSE}, ex AS (SELECT query_id, page_id FROM fused JOIN labels ON doc_id = page_id WHERE toxic = 1)
    SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
    FROM fused ANTI JOIN ex USING (query_id, page_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {K}""",
)
def hybrid_search(spark, d):
    """Fused search without the private (here: toxic) pages."""
    asked = question_terms(spark, d)
    secret = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    keyword = S.bm25(asked, index(spark, d), 50, index_size(spark, d)).select("query_id", "page_id")
    dense_side = (question_vectors(spark, d), chunk_vectors(spark, d))
    near = S.dense_search(*dense_side, 50).select("query_id", "page_id")
    exclude = keyword.unionByName(near).distinct().join(secret, "page_id", "left_semi")
    return S.search(asked, index(spark, d), K, index_size(spark, d), exclude, dense_side)


@query(
    "connection_candidates",
    f"""WITH {_INDEX}, q AS (SELECT doc_id AS query_id, source, trim(text) AS text FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    qtok AS (SELECT query_id, unnest(l) AS term, unnest(range(len(l))) AS p FROM (
      SELECT query_id, regexp_extract_all({fold("source || ' ' || text || ' ' || 'topic' || ' ' || 'term'")}, '[a-z]{{4,}}') AS l FROM q)),
    qterms AS (SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, p) AS place FROM (
      SELECT query_id, term, count(*) AS n, min(p) AS p FROM qtok WHERE term NOT IN ({STOPWORDS}) GROUP BY ALL)) WHERE place <= 20),
    df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), size AS (SELECT count(*) AS n, avg(page_len) AS mean FROM lens),
    scores AS (SELECT query_id, page_id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
      * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * page_len / mean))) AS score FROM (
        SELECT *, 5.0 * tf_title + 3.0 * tf_alias + tf_body AS f FROM postings) JOIN qterms USING (term) JOIN df USING (term) JOIN lens USING (page_id), size GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM scores)
    SELECT t.query_id, t.page_id FROM top t JOIN q USING (query_id) JOIN documents d ON d.doc_id = t.page_id WHERE rank <= 10 AND d.source <> q.source""",
)
def connection_candidates(spark, d):
    """Good documents looking for pages of other groups to connect to."""
    labels = table(spark, d, "labels").filter("quality = 1")
    plans = table(spark, d, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("query_id"), F.col("source").alias("title"), F.trim("text").alias("summary"),
        F.array(F.lit("topic")).alias("concepts"), F.array(F.lit("term")).alias("terms"),
    )
    none = spark.createDataFrame([], "page_id long, source string")
    found = S.connection_candidates(plans, index(spark, d), search_pages(spark, d), none, index_size(spark, d), 10)
    return found.select("query_id", "page_id")


# ------------------------------------------------------------------------------------- evaluation

@query(
    "evaluate_retrieval",
    f"""WITH {_BM25}, want AS (SELECT item_id AS query_id, 'src' || (length(text) // 60) AS e FROM benchmark),
    hit AS (SELECT k.query_id, min(rank) AS r FROM keyword k JOIN documents d ON d.doc_id = k.page_id JOIN want w ON w.query_id = k.query_id
      WHERE rank <= {K} AND starts_with(d.source, w.e) GROUP BY 1)
    SELECT count(*) AS cases, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr
    FROM want LEFT JOIN hit USING (query_id)""",
)
def evaluate_retrieval(spark, d):
    """Questions expect a group named after their length: enough hits and misses to count."""
    found = S.bm25(question_terms(spark, d), index(spark, d), K, index_size(spark, d))
    titled = found.join(search_pages(spark, d).select("page_id", "title"), "page_id").select("query_id", "title", "rank")
    number = F.floor(F.length("text") / 60).cast("string")
    expected = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("SRC"), number)).alias("expect"))
    totals = S.evaluate(expected, titled, K)[1]
    return totals.select("cases", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(
    "top_words_per_group",
    f"""SELECT source, word, n, rank FROM (SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM (
      SELECT d.source, w.word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all({fold("text")}, '[a-z]{{4,}}'))) AS word FROM documents) w
      JOIN documents d USING (doc_id) WHERE word NOT IN ({STOPWORDS}) GROUP BY ALL)) WHERE rank <= 10""",
)
def top_words_per_group(spark, d):
    words = F.array_distinct(F.filter(T.find_all(T.fold("text"), "[a-z]{4,}"), lambda w: ~w.isin(*SEARCH_STOPWORDS)))
    rows = table(spark, d, "documents").select("source", F.explode(words).alias("word"))
    counted = rows.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counted, ["source"], [F.col("n").desc(), F.col("word")], 10)


def flagship(spark, d):
    """BM25 over the whole corpus for every benchmark passage: the six best documents."""
    return bm25_from_text(spark, d)


