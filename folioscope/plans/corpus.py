"""A wiki derived from the given tables, as DataFrames and as the same thing in SQL.

Every document is a source page. Its three most said words are concept pages (entities when some
document says the word most), the fourth is a glossary term and a link that may lead nowhere.
`labels.toxic` stands for private sources, `events` gives dates and states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import names as N
from folioscope.operators.common import stored

_CACHE: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table. A file too small to fill the cores (one row group is one task, however many
    splits are planned) is dealt out to them; a table of many files is read as it lies."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages", "conversations") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def shared(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A derived table several checks read, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _CACHE:
        _CACHE[key] = stored(build(), name)
    return _CACHE[key]


def forget_shared() -> None:
    _CACHE.clear()


def doc_keywords(spark, d) -> DataFrame:
    """(doc_id, words): the four most said words of each document."""
    docs = table(spark, d, "documents").select("doc_id", T.keywords("text", 4).alias("words"))
    return shared(spark, d, "doc_keywords", lambda: docs)


def doc_words(spark, d) -> DataFrame:
    return doc_keywords(spark, d).select("doc_id", F.posexplode("words").alias("pos", "word")).select(
        "doc_id", "word", (F.col("pos") + 1).cast("long").alias("place")
    )


def source_pages(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    urls = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    labels = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("private"))
    events = table(spark, d, "events").select(
        F.col("event_id").alias("doc_id"), F.to_date("ts").alias("processed"), "event_type"
    )
    words = doc_keywords(spark, d)
    rows = (
        docs.join(words, "doc_id").join(urls, "doc_id", "left").join(labels, "doc_id", "left").join(events, "doc_id", "left")
    )
    title = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    links = F.array_join(F.transform("words", lambda w: F.concat(F.lit("[["), w, F.lit("]]"))), " ")
    term = F.get("words", F.lit(3))
    glossary = F.when(term.isNotNull(), F.concat(F.lit("\n\n- **"), term, F.lit("**: noted"))).otherwise("")
    read = F.col("event_type").isin("view", "purchase")
    return rows.select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("page_id"),
        F.concat(F.lit("sources/"), title, F.lit(".md")).alias("path"), title.alias("stem"), F.lit("sources").alias("kind"),
        title.alias("title"), F.array().cast("array<string>").alias("aliases"), T.first_sentence("text").alias("summary"),
        "url", T.content_hash("text").alias("content_hash"),
        F.when(F.coalesce("private", F.lit(False)), "email").otherwise("article").alias("doc_kind"),
        F.when(F.coalesce(read, F.lit(False)), "read").otherwise("processed").alias("status"),
        "processed", F.when(read, F.col("processed")).alias("read"), F.lit(None).cast("date").alias("updated"),
        F.concat("text", glossary, F.lit("\n\n"), links).alias("body"),
    )


def concept_pages(spark, d) -> DataFrame:
    used = doc_words(spark, d).filter("place <= 3")
    dates = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("day"))
    per_word = (
        used.join(dates, "doc_id", "left").groupBy("word")
        .agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("n"), F.max("day").alias("updated"))
    )
    kind = F.when(F.col("best") == 1, "entities").otherwise("concepts")
    stem = T.stem("word")
    none = F.lit(None).cast("string")
    return per_word.select(
        F.concat(F.lit("c:"), "word").alias("page_id"), F.concat(kind, F.lit("/"), "word", F.lit(".md")).alias("path"),
        F.col("word").alias("stem"), kind.alias("kind"), F.col("word").alias("title"),
        F.when(stem != F.col("word"), F.array(stem)).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("n") > 1, F.concat(F.lit("Said in "), F.col("n").cast("string"), F.lit(" notes"))).alias("summary"),
        none.alias("url"), none.alias("content_hash"), none.alias("doc_kind"), none.alias("status"),
        F.lit(None).cast("date").alias("processed"), F.lit(None).cast("date").alias("read"), "updated",
        F.concat(F.lit("# "), "word").alias("body"),
    )


def wiki_pages(spark, d) -> DataFrame:
    return shared(spark, d, "wiki", lambda: source_pages(spark, d).unionByName(concept_pages(spark, d)))


def wiki_sources(spark, d) -> DataFrame:
    """(page_id, source): which source pages a concept page was written from."""
    return doc_words(spark, d).filter("place <= 3").select(
        F.concat(F.lit("c:"), "word").alias("page_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source")
    )


def wiki_links(spark, d) -> DataFrame:
    """Links in bodies, and from each concept page to its sources."""
    written = N.page_links(wiki_pages(spark, d)).select("src_page_id", "src_title", "target", "target_folded")
    back = wiki_sources(spark, d).select(
        F.col("page_id").alias("src_page_id"), F.substring("page_id", F.lit(3), F.length("page_id")).alias("src_title"),
        F.col("source").alias("target"), F.col("source").alias("target_folded"),
    )
    return written.unionByName(back)


# -------------------------------------------------------------------------------- the same in SQL


def fold(x: str) -> str:
    return f"trim(replace(lower(strip_accents({x})), 'ß', 'ss'), E' \\t\\n\\r')"


def flat(x: str) -> str:
    return rf"trim(regexp_replace({fold(x)}, '\s+', ' ', 'g'))"


def flatten(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


STOPWORDS = (
    "'that','this','with','from','have','they','their','there','which','would','about','into','than','then','them',"
    "'these','those','were','will','been','being','also','more','most','other','some','such','only','over','very','when',"
    "'what','where','while','who','para','como','pero','esta','este','estos','estas','esto','entre','sobre','desde',"
    "'hasta','cuando','donde','porque','tambien','son','sus','los','las','del','una','uno','unos','unas','por','con',"
    "'que','mas','muy','sin','ser','han','hay','fue','era','sido','the','and','for','are','was','not','but','you','your',"
    "'can','has','had','its','our','out','all','any','how','why'"
)
ENDINGS = (
    "ations|ation|ciones|cion|ments|ment|mente|ings|ing|edly|ed|ies|es|s|ly|ions|ion|"
    "ado|ada|ados|adas|ido|ida|idos|idas|ando|iendo|aron|ieron|as|os|a|o|e"
)


def stem(x: str) -> str:
    return rf"regexp_replace({x}, '^(.{{4,}}?)(?:{ENDINGS})$', '\1')"


def first_sentence(x: str) -> str:
    f = flatten(x)
    s = f"coalesce(nullif(regexp_extract({f}, '^(.*?[.!?]) ', 1), ''), {f})"
    cut = f"rtrim(regexp_replace(substr({s}, 1, 159), ' [^ ]*$', ''), ' ,;:') || '…'"
    whole = f"CASE WHEN length({s}) > 160 THEN {cut} ELSE {s} END"
    return f"(SELECT CASE WHEN length(q) >= 10 AND contains(q, ' ') THEN q END FROM (SELECT {whole} AS q))"


KEYWORDS = f"""
toks AS (
  SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS p FROM (
    SELECT doc_id, regexp_extract_all({fold("text")}, '[a-z]{{4,}}') AS l FROM documents)),
ranked AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS place FROM (
    SELECT doc_id, word, count(*) AS n, min(p) AS p FROM toks WHERE word NOT IN ({STOPWORDS}) GROUP BY ALL)),
doc_words AS (SELECT * FROM ranked WHERE place <= 4)"""

WIKI = f"""{KEYWORDS},
kw AS (SELECT doc_id, list(word ORDER BY place) AS words FROM doc_words GROUP BY doc_id),
src AS (
  SELECT d.doc_id, d.text, coalesce(kw.words, []) AS words, p.url, coalesce(l.toxic = 1, false) AS private,
         e.ts::DATE AS processed, coalesce(e.event_type IN ('view', 'purchase'), false) AS is_read
  FROM documents d LEFT JOIN kw USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN labels l USING (doc_id) LEFT JOIN events e ON e.event_id = d.doc_id),
wiki_sources AS (SELECT 'c:' || word AS page_id, 'doc-' || doc_id AS source FROM doc_words WHERE place <= 3),
wiki AS (
  SELECT 'd:' || doc_id AS page_id, 'sources/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id AS title, 'sources' AS kind,
         0 AS kind_ord, []::VARCHAR[] AS aliases, {first_sentence("text")} AS summary, url,
         substr(sha256(text), 1, 16) AS content_hash, CASE WHEN private THEN 'email' ELSE 'article' END AS doc_kind,
         CASE WHEN is_read THEN 'read' ELSE 'processed' END AS status, processed,
         CASE WHEN is_read THEN processed END AS read_on, NULL::DATE AS updated,
         text || CASE WHEN len(words) >= 4 THEN E'\\n\\n- **' || words[4] || '**: noted' ELSE '' END || E'\\n\\n'
           || array_to_string(list_transform(words, lambda w: '[[' || w || ']]'), ' ') AS body
  FROM src
  UNION ALL
  SELECT 'c:' || word, (CASE WHEN best = 1 THEN 'entities/' ELSE 'concepts/' END) || word || '.md', word,
         CASE WHEN best = 1 THEN 'entities' ELSE 'concepts' END, CASE WHEN best = 1 THEN 2 ELSE 1 END,
         CASE WHEN {stem("word")} <> word THEN [{stem("word")}] ELSE []::VARCHAR[] END,
         CASE WHEN n > 1 THEN 'Said in ' || n || ' notes' END, NULL, NULL, NULL, NULL, NULL, NULL, updated, '# ' || word
  FROM (SELECT word, min(place) AS best, count(*) AS n, max(e.ts::DATE) AS updated FROM doc_words w
        LEFT JOIN events e ON e.event_id = w.doc_id WHERE place <= 3 GROUP BY word)),
wiki_names AS (
  SELECT DISTINCT page_id, title, kind, kind_ord, path, {fold("nm")} AS name
  FROM (SELECT *, unnest(list_concat([title], aliases)) AS nm FROM wiki)),
wiki_links AS (
  SELECT page_id AS src_page_id, title AS src_title, target, {fold("target")} AS target_folded FROM (
    SELECT page_id, title, trim(unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)', 1))) AS target FROM wiki)
  UNION ALL SELECT page_id, substr(page_id, 3), source, source FROM wiki_sources)"""


def with_wiki(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([WIKI, *more]) + "\n" + select


def with_keywords(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([KEYWORDS, *more]) + "\n" + select
