"""Queries over batches of edits: what page an edit is for, and the bodies of pages put together from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import assembly as A
from folioscope.operators import pages as P
from folioscope.plans.corpus import doc_words, table, wiki_pages, with_keywords, with_wiki
from folioscope.plans.queries_graph import TODAY
from folioscope.plans.registry import query

_TOXIC = "coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = {0}.doc_id) = 1, false)"


def private_docs(spark, d):
    """(doc_id, secret) of every labelled document."""
    return table(spark, d, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("secret"))


def doc_title():
    return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))


def word_sections(spark, d):
    """What each document adds: a section to the page of each of its words, and two to the page of the corpus."""
    words = doc_words(spark, d).select(
        F.concat(F.lit("c:"), "word").alias("page_id"), F.col("doc_id").alias("seq"), F.col("place").alias("pos"), doc_title().alias("source"),
        F.concat(F.lit("Word "), F.col("place").cast("string"), F.lit(" is "), "word", F.lit(".")).alias("text"),
    )
    docs = table(spark, d, "documents")
    whole = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(5).alias("pos"), F.coalesce("lang", F.lit("?")).alias("text")), F.struct(F.lit(6).alias("pos"), F.coalesce("source", F.lit("?")).alias("text")))).alias("x"))
    corpus = whole.select(F.lit("corpus").alias("page_id"), F.col("doc_id").alias("seq"), F.col("x.pos").cast("long").alias("pos"), doc_title().alias("source"), "x.text")
    return words.unionByName(corpus)


@query(
    "assembled_pages",
    with_wiki(
        f"""SELECT page_id, '# ' || title || CASE WHEN summary IS NULL THEN '' ELSE E'\\n\\n## Summary\\n' || summary END || coalesce(E'\\n\\n' || rest, '') AS body
        FROM (SELECT page_id, title, summary FROM wiki WHERE kind <> 'sources' UNION ALL SELECT 'corpus', 'Corpus', NULL) LEFT JOIN (
          SELECT page_id, string_agg(text, E'\\n\\n' ORDER BY seq, phase, pos, text) AS rest FROM (
            SELECT 'c:' || word AS page_id, doc_id AS seq, 1 AS phase, place AS pos, E'## From [[doc-' || doc_id || E']]\\nWord ' || place || ' is ' || word || '.' AS text FROM doc_words
            UNION ALL SELECT 'corpus', doc_id, 1, 5, E'## From [[doc-' || doc_id || E']]\\n' || coalesce(lang, '?') FROM documents
            UNION ALL SELECT 'corpus', doc_id, 1, 6, E'## From [[doc-' || doc_id || E']]\\n' || coalesce(source, '?') FROM documents
            UNION ALL SELECT 'c:' || word, doc_id, 2, place, '> [!warning] doc-' || doc_id || ' differs' FROM doc_words WHERE place = 1 AND {_TOXIC.format("doc_words")})
          GROUP BY page_id) USING (page_id)
        WHERE summary IS NOT NULL OR rest IS NOT NULL"""
    ),
)
def assembled_pages(spark, d):
    """The body of every page that documents write to; the page of the corpus holds a third of all sections."""
    wiki = wiki_pages(spark, d).filter("kind <> 'sources'").select("page_id", "title", "body", "summary")
    pages = wiki.unionByName(spark.range(1).select(F.lit("corpus").alias("page_id"), F.lit("Corpus").alias("title"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("summary")))
    differing = doc_words(spark, d).filter("place = 1").join(private_docs(spark, d).filter("secret"), "doc_id")
    callouts = differing.select(
        F.concat(F.lit("c:"), "word").alias("page_id"), F.col("doc_id").alias("seq"), F.col("place").alias("pos"), F.concat(F.lit("> [!warning] "), doc_title(), F.lit(" differs")).alias("text")
    )
    return A.assemble(pages, word_sections(spark, d), callouts, pages.filter("summary is not null").select("page_id", "summary"))


_BATCH = f"""
e AS (SELECT row_number() OVER (ORDER BY w.doc_id, w.place) AS no, w.doc_id, w.place, w.word, n.word AS alias, {_TOXIC.format("w")} AS secret,
        'What ' || w.word || ' adds in doc-' || w.doc_id || '.' AS text
    FROM doc_words w LEFT JOIN doc_words n ON n.doc_id = w.doc_id AND n.place = w.place + 1 WHERE w.word NOT IN ('home', 'index', 'log', 'lint', 'schema')),
offered AS (SELECT no, alias FROM e WHERE alias IS NOT NULL AND alias <> word AND alias NOT IN ('home', 'index', 'log', 'lint', 'schema')),
giver AS (SELECT name, min(no) AS giver FROM (SELECT word AS name, no FROM e UNION ALL SELECT alias, no FROM offered) GROUP BY name),
step AS (SELECT e.no, least(giver, e.no) AS nxt FROM e JOIN giver ON giver.name = e.word),
up AS (SELECT no, nxt AS below FROM step UNION ALL SELECT up.no, s.nxt FROM up JOIN step s ON s.no = up.below WHERE s.nxt <> up.below),
top AS (SELECT no, min(below) AS root FROM up GROUP BY no),
placed AS (SELECT e.*, r.word AS page, r.secret AS born FROM e JOIN top USING (no) JOIN e r ON r.no = root),
names AS (SELECT DISTINCT p.page, o.alias FROM offered o JOIN placed p USING (no) JOIN giver g ON g.name = o.alias JOIN placed q ON q.no = g.giver WHERE q.page = p.page AND o.alias <> p.page)"""


@query(
    "batch_edits",
    with_keywords(
        """SELECT 'new:' || page AS page_key, page AS title, count(DISTINCT doc_id) AS sections,
            CASE WHEN any_value(born) AND bool_or(NOT secret) THEN arg_min(text, no) FILTER (NOT secret) ELSE arg_min(text, no) END AS summary,
            coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM names n WHERE n.page = placed.page), '') AS aliases
        FROM placed GROUP BY page""",
        _BATCH,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def batch_edits(spark, d):
    """Edits for every word of every document in one batch; each brings the document's next word as an alias."""
    words = doc_words(spark, d)
    after = words.select("doc_id", (F.col("place") - 1).alias("place"), F.col("word").alias("alias"))
    rows = words.join(after, ["doc_id", "place"], "left").join(private_docs(spark, d), "doc_id", "left")
    edits = rows.select(
        F.col("doc_id").alias("seq"), F.col("place").alias("pos"), F.lit("concepts").alias("kind"), F.col("word").alias("title"), F.array_compact(F.array("alias")).alias("aliases"),
        F.concat(F.lit("What "), "word", F.lit(" adds in "), doc_title(), F.lit(".")).alias("description"), doc_title().alias("source_title"), F.coalesce("secret", F.lit(False)).alias("is_private"),
    )
    pages = wiki_pages(spark, d).filter("kind = 'sources'")
    none = spark.createDataFrame([], "page_id string, source string")
    done = P.merge_concepts(pages.filter("doc_kind = 'none'"), none, edits, none.select(F.col("source").alias("title")), TODAY)
    sections = done["sections"].groupBy("page_key").agg(F.count(F.lit(1)).alias("sections"))
    return done["upserts"].join(sections, "page_key", "left").select("page_key", "title", "sections", "summary", F.array_join("aliases", ",").alias("aliases"))
