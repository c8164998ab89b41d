"""Documents: web pages, clips, chunks, notes and laid-out lines over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunks as C
from folioscope.operators import extract as X
from folioscope.operators import layout as Y
from folioscope.operators import mail as M
from folioscope.operators import notes as N
from folioscope.operators import pages as P
from folioscope.operators.common import computed, ordered_scan
from folioscope.operators.runs import spread_sample
from folioscope.plans.corpus import (
    doc_words, first_sentence, flatten, fold, table, wiki_pages, wiki_sources, with_keywords, with_wiki,
)
from folioscope.plans.registry import query


def _docs(spark, d):
    return table(spark, d, "documents")


# ------------------------------------------------------------------------------------- web pages

_QUIET = "html"
for _tag in ("script", "style", "head", "nav", "header", "footer", "aside", "form"):
    _QUIET = rf"regexp_replace({_QUIET}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
_QUIET = rf"regexp_replace({_QUIET}, '(?s)<!--.*?-->', ' ', 'g')"
_QUIET = rf"""regexp_replace({_QUIET}, '(?is)<div[^>]*class="[^"]*\b(?:ad|ads|advert|cookie|banner)\b[^"]*"[^>]*>.*?</div\s*>', ' ', 'g')"""
_UNESCAPED = "{0}"
for _name, _sign in X.ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_sign if _sign != chr(39) else chr(39) * 2}')"
_BLOCKS = r"regexp_replace(region, '(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|blockquote|pre)\b[^>]*>', E'\n', 'g')"
_PLAIN = _UNESCAPED.format(f"regexp_replace({_BLOCKS}, '<[^>]*>', '', 'g')")
_LINES = rf"regexp_replace({_PLAIN}, '[ \t\r]+', ' ', 'g')"
_ARTICLE = rf"trim(regexp_replace(regexp_replace({_LINES}, ' ?\n ?', E'\n', 'g'), '\n{{2,}}', E'\n\n', 'g'), E' \n')"
_HTML_TITLE = flatten(_UNESCAPED.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)"))


@query(
    "extract_html",
    rf"""SELECT page_id, url, CASE WHEN t = '' THEN url ELSE t END AS title, md5(body) AS text_md5, CAST(length(body) AS BIGINT) AS n
    FROM (SELECT page_id, url, t, {_ARTICLE} AS body FROM (
      SELECT page_id, url, t, coalesce(nullif(regexp_extract(quiet, '(?is)<article\b[^>]*>(.*)</article\s*>', 1), ''), quiet) AS region
      FROM (SELECT page_id, url, {_HTML_TITLE} AS t, {_QUIET} AS quiet FROM pages))) WHERE length(body) >= 200""",
)
def extract_html(spark, d):
    rows = X.extract_html(table(spark, d, "pages"))
    return rows.select("page_id", "url", "title", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@query(
    "content_images",
    r"""SELECT page_id, alt, regexp_extract(url, '^(https?://[^/?#]*)', 1) || path AS url FROM (
        SELECT page_id, url, unnest(['A picture', 'Two & more']) AS alt, unnest(['/img/' || page_id || '.png', '/big.jpg']) AS path FROM pages)""",
)
def content_images(spark, d):
    tags = F.concat(
        F.lit('<article><img alt="A  picture" src="/img/'), F.col("page_id").cast("string"),
        F.lit('.png"><img src="x.svg"><img src="/site-logo.png"><img src="/pic.jpg" width="50"><img src="data:image/png;base64,AA">'
              '<img class="avatar big" src="/me.jpg"><img src="/big.jpg" alt=\'Two &amp; more\' width=640 height="480"><img src="/big.jpg">'),
    )
    pages = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<article>"), tags))
    return X.page_images(pages, X.MAX_IMAGES).select("page_id", "alt", "url")


_HEAD = r"regexp_extract(b, '^([^\n\r]*)', 1)"


@query(
    "social_posts",
    f"""SELECT doc_id AS page_id, source || ' on LinkedIn: ' || {_HEAD} AS title, md5('By ' || source || E'\\n\\n' || b) AS text_md5,
        'https://example.org/' || doc_id AS link FROM (
        SELECT doc_id, source, trim(text, E' \\t\\n\\r') || ' https://example.org/' || doc_id AS b FROM documents)""",
)
def social_posts(spark, d):
    docs = _docs(spark, d)
    body = F.concat(F.lit(" "), F.trim("text", F.lit(" \t\n\r")), F.lit(" https://example.org/"), F.col("doc_id").cast("string"), F.lit(". "))
    body = F.regexp_replace(body, r"\. $", "")
    post = F.to_json(
        F.struct(
            F.lit("SocialMediaPosting").alias("@type"), body.alias("articleBody"), F.struct(F.col("source").alias("name")).alias("author"),
            F.array(F.struct(F.lit("a comment").alias("text"))).alias("comment"),
        )
    )
    html = F.concat(
        F.lit('<html><script type="application/ld+json">{"@type":"WebPage"}</script><script type="application/ld+json">not json</script>'),
        F.lit('<script type="application/ld+json">'), F.replace(post, F.lit("</"), F.lit("<\\/")), F.lit("</script></html>"),
    )
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://www.linkedin.com/posts/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))
    return X.extract_posts(pages, 10).select("page_id", "title", F.md5("text").alias("text_md5"), F.get("links", F.lit(0)).alias("link"))


@query(
    "short_link_targets",
    "SELECT page_id, CASE WHEN contains(url, '?') THEN url ELSE '' END AS target FROM pages",
)
def short_link_targets(spark, d):
    shown = F.when(F.col("url").contains("?"), F.lit("external_url_click")).otherwise("other")
    html = F.concat(F.lit('<a href="/x">x</a><a data-tracking-control-name="'), shown, F.lit('" href=" '), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(' ">go</a>'))
    return table(spark, d, "pages").select("page_id", F.coalesce(X.outbound_url(html), F.lit("")).alias("target"))


@query(
    "strip_chrome",
    r"""SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 6 WHEN lang = 'es' THEN 4 ELSE 0 END AS BIGINT) AS removed,
        md5(CASE WHEN lang IN ('en', 'es') THEN trim(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), E' \t\n\r') ELSE text END) AS text_md5
        FROM documents""",
)
def strip_chrome(spark, d):
    """Known chrome put around every document: two sites lose it, an unknown host keeps its text."""
    host = F.when(F.col("lang") == "en", "https://github.com/a/b").when(F.col("lang") == "es", "https://m.youtube.com/watch").otherwise(
        "https://example.org/a"
    )
    before = F.when(F.col("lang") == "en", "Skip to content\n[Pull requests](/pulls) · [Issues](https://github.com/i)\n\n").when(
        F.col("lang") == "es", "Skip navigation\n1.2M views\n"
    ).otherwise("")
    after = F.when(F.col("lang") == "en", "\n\n## Languages\n\nPython 97.1%\nC 2.9%\n© 2024 GitHub, Inc.\n").when(
        F.col("lang") == "es", "\nUp next\nSubscribe\n"
    ).otherwise("")
    clips = _docs(spark, d).select("doc_id", host.alias("url"), F.concat(before, "text", after).alias("text"))
    return X.strip_chrome(clips).select("doc_id", F.col("stripped_lines").alias("removed"), F.md5("text").alias("text_md5"))


@query(
    "accept_clips",
    r"""SELECT doc_id, CASE WHEN lang = 'es' THEN 'video' WHEN lang = 'fr' THEN 'paper' ELSE 'article' END AS kind,
        md5(CASE WHEN lang = 'es' THEN text || E'\n\n**1:05** · x' ELSE text || E'\n**1:05** · x' END) AS text_md5
        FROM documents WHERE length(text) >= 27""",
)
def accept_clips(spark, d):
    kind = F.when(F.col("lang") == "es", "video").when(F.col("lang") == "fr", "paper").otherwise(F.col("lang"))
    clips = _docs(spark, d).select("doc_id", kind.alias("kind"), F.concat("text", F.lit("\n**1:05** · x")).alias("text"))
    return X.accept_clip(clips).select("doc_id", "kind", F.md5("text").alias("text_md5"))


# ----------------------------------------------------------------------------------------- chunks


@query(
    "cut_references",
    r"""SELECT doc_id, md5(CASE WHEN length(text) + 1 > 0.5 * (length(text) + 12 + least(length(text), 600) + 1) THEN rtrim(text, E' \t\n\r')
        ELSE text || E'\nReferences\n' || substr(text, 1, 600) || '.' END) AS text_md5 FROM documents""",
)
def cut_references(spark, d):
    listed = F.concat("text", F.lit("\nReferences\n"), F.substring("text", 1, 600), F.lit("."))
    return _docs(spark, d).select("doc_id", F.md5(C.cut_references(listed)).alias("text_md5"))


@query(
    "chunk_invariants",
    r"""SELECT doc_id, true AS fits, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS letters,
        md5(regexp_replace(text, '\s', '', 'g')) AS text_md5 FROM documents WHERE trim(text, E' \t\n\r') <> ''""",
)
def chunk_invariants(spark, d):
    """Every chunk fits, and together they hold every letter of the source."""
    pieces = computed(_docs(spark, d).select("doc_id", "text"), chunks=C.chunks_of("text", 1000, "\n")).filter(F.size("chunks") > 0)
    letters = F.regexp_replace(F.array_join("chunks", ""), r"\s", "")
    return pieces.select(
        "doc_id", F.forall("chunks", lambda c: F.length(c) <= 1000).alias("fits"),
        F.length(letters).cast("long").alias("letters"), F.md5(letters).alias("text_md5"),
    )


@query("split_chunks")
def split_chunks(spark, d):
    return C.split_chunks(_docs(spark, d), 1000, "\n").select("doc_id", "seq", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


@query(
    "embed_units",
    r"""SELECT doc_id AS page_id, CAST(n - 1 AS BIGINT) AS chunk, md5(source || E'\n' || substr(k[n], 1, 3000)) AS text_md5 FROM (
        SELECT doc_id, source, k, unnest(range(1, len(k) + 1)) AS n FROM (
          SELECT doc_id, source, list_filter(list_transform(string_split(text, E'\n'), lambda x, i:
            CASE WHEN i = 1 THEN trim(x, E' \t\n\r') ELSE '## ' || trim(x, E' \t\n\r') END), lambda x: x <> '') AS k FROM documents))""",
)
def embed_units(spark, d):
    from folioscope.operators.search import embed_units as units

    pages = _docs(spark, d).select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("body"))
    return units(pages, most=1).select("page_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("text_md5"))


@query(
    "halves",
    r"""SELECT doc_id, md5(regexp_replace(text, '\s', '', 'g')) AS letters, true AS balanced FROM documents
        WHERE length(text) > 400 AND regexp_matches(text, '\s')""",
)
def halves(spark, d):
    """A text cut in two keeps every letter, and the cut is near the middle."""
    docs = _docs(spark, d).filter((F.length("text") > 400) & F.col("text").rlike(r"\s"))
    cut = computed(docs.select("doc_id", F.length("text").alias("n"), "text"), h=C.halves("text"))
    return cut.select(
        "doc_id", F.md5(F.regexp_replace(F.array_join("h", ""), r"\s", "")).alias("letters"),
        (F.abs(F.length(F.get("h", F.lit(0))) - F.col("n") / 2) < F.col("n") / 2).alias("balanced"),
    )


_BODY = "'# ' || w1.word || list_aggregate(list(E'\\n\\n## From [[doc-' || doc_id || E']]\\n' || word), 'string_agg', '')"


def sectioned(spark, d):
    """Each document as a page with three sections, one of each of its top words."""
    words = doc_words(spark, d).filter("place <= 3").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    parts = F.transform("w", lambda x: F.concat(F.lit("\n\n## From [["), x["word"], F.lit("]]\nSays "), x["word"], F.lit(" often.")))
    rows = words.join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    body = F.concat(F.lit("# Page\n\n## Summary\nAll in all."), F.array_join(parts, ""), F.lit("\n\n## Notes\n"), F.regexp_replace("text", r"\n", " "))
    return rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("title"), body.alias("body"))


_SECTIONED = r"""sectioned AS (
  SELECT doc_id AS page_id, list(word ORDER BY place) AS words, any_value(replace(text, E'\n', ' ')) AS flat_text
  FROM doc_words JOIN documents USING (doc_id) WHERE place <= 3 GROUP BY doc_id)"""


@query(
    "page_sections",
    with_keywords(
        "SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, words[i] AS source, 'Says ' || words[i] || ' often.' AS text FROM ("
        "SELECT page_id, words, unnest(range(1, len(words) + 1)) AS i FROM sectioned)",
        _SECTIONED,
    ),
)
def page_sections(spark, d):
    return C.page_sections(sectioned(spark, d)).select("page_id", F.col("pos").cast("long").alias("pos"), "source", "text")


@query(
    "page_context",
    with_keywords(
        r"""SELECT page_id, md5(E'# Page\n\n## Summary\nAll in all.' || array_to_string(list_transform(words, lambda w:
            E'\n\n## From [[' || w || E']]\nSays ' || w || ' often.'), '')) AS context FROM sectioned""",
        _SECTIONED,
    ),
)
def page_context(spark, d):
    return sectioned(spark, d).select("page_id", F.md5(C.page_context("body", 1800)).alias("context"))


@query(
    "put_section",
    with_keywords(
        r"""SELECT page_id, md5(trim(E'# Page\n\n## Summary\nNew words.\n\n' || trim(array_to_string(list_transform(words, lambda w:
            E'## From [[' || w || E']]\nSays ' || w || ' often.'), E'\n\n') || E'\n\n## Notes\n' || flat_text, E' \t\n\r'), E' \t\n\r')) AS body FROM sectioned""",
        _SECTIONED,
    ),
)
def put_section(spark, d):
    return sectioned(spark, d).select("page_id", F.md5(C.put_section("body", "Summary", F.lit("New words."))).alias("body"))


@query(
    "due_pages",
    with_wiki(
        "SELECT s.page_id, w.title, w.kind, s.n AS n_sources FROM (SELECT page_id, count(*) AS n FROM wiki_sources GROUP BY page_id) s"
        " JOIN wiki w USING (page_id) WHERE s.n >= 3 AND w.kind IN ('concepts', 'entities')"
    ),
)
def due_pages(spark, d):
    pages = wiki_pages(spark, d).withColumn("summary_sources", F.lit(None).cast("int"))
    return P.due_pages(pages, wiki_sources(spark, d))


@query(
    "spread_sample",
    """WITH long AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents WHERE length(text) >= 500)
       SELECT doc_id FROM long WHERE rn IN (SELECT CAST(round_even(i * (n - 1) / 24.0, 0) AS BIGINT) FROM range(25) t(i))""",
)
def spread_docs(spark, d):
    docs = _docs(spark, d).filter(F.length("text") >= 500).select("doc_id")
    return spread_sample(docs, 25, ["doc_id"])


# ------------------------------------------------------------------------------------------ notes

_NOTES_SQL = rf"""
turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, text FROM conversations),
points AS (
  SELECT conv_id AS doc_id, seq, unnest(k) AS a, unnest(range(len(k))) AS rank FROM (
    SELECT conv_id, seq, list_filter(string_split(text, E'\n'), lambda l: l <> '') AS k FROM turns)),
words AS (
  SELECT conv_id AS doc_id, seq, unnest(k) AS a, unnest(range(len(k))) AS rank FROM (
    SELECT conv_id, seq, regexp_extract_all(text, '\p{{L}}{{6,}}') AS k FROM turns))"""


def conversation_notes(spark, d):
    """Each turn of a conversation as the note of one chunk: lines are points, long words are terms."""
    turns = table(spark, d, "conversations")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    words = T.find_all("text", r"\p{L}{6,}")
    placed = ordered_scan(turns.select("conv_id", "turn", "text"), ["turn"], ["conv_id"]).withColumn("seq", F.col("rn") - 1)
    return placed.select(
        F.col("conv_id").alias("doc_id"), "seq", lines.alias("points"),
        F.transform(words, lambda w: F.struct(w.alias("term"), F.concat(w, F.lit(" is said")).alias("definition"))).alias("terms"),
        F.slice(lines, 1, 3).alias("quotes"),
        F.transform(F.slice(words, 1, 3), lambda w: F.struct(w.alias("a"), F.lit("meets").alias("relation"), F.reverse(w).alias("b"))).alias("relations"),
    )


def _spread_sql(items: str, key: str, cap: int, field: str) -> str:
    return f"""SELECT doc_id, '{field}' AS field, place - 1 AS rank, a FROM (
      SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY rank, seq) AS place FROM (
        SELECT doc_id, a, rank, seq, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY rank, seq, a) AS first FROM {items})
      WHERE first = 1) WHERE place <= {cap}"""


@query(
    "merge_notes",
    "WITH "
    + _NOTES_SQL
    + ", quotes AS (SELECT * FROM points WHERE rank < 3), rels AS (SELECT * FROM words WHERE rank < 3) "
    + " UNION ALL ".join(
        [_spread_sql("words", fold("a"), 10, "terms"), _spread_sql("quotes", fold("a"), 12, "quotes"), _spread_sql("rels", fold("a"), 10, "relations")]
    ),
)
def merge_notes(spark, d):
    return N.merge_notes(conversation_notes(spark, d), N.SOURCE_CAPS).select("doc_id", "field", F.col("rank").cast("long").alias("rank"), "a")


@query(
    "reduce_notes",
    "WITH "
    + _NOTES_SQL
    + """, sizes AS (SELECT conv_id AS doc_id, count(*) AS n FROM turns GROUP BY 1),
    p AS (SELECT * FROM points JOIN sizes USING (doc_id)),
    small AS (SELECT doc_id, seq, rank, a FROM p WHERE n <= 4 OR (n % 5 = 1 AND seq = n - 1)),
    big AS (SELECT * FROM p WHERE n > 4 AND NOT (n % 5 = 1 AND seq = n - 1)),
    m AS (SELECT doc_id, g, place - 1 AS rank, a FROM (
      SELECT doc_id, g, a, row_number() OVER (PARTITION BY doc_id, g ORDER BY rank, seq) AS place FROM (
        SELECT doc_id, seq // 5 AS g, a, rank, seq, row_number() OVER (PARTITION BY doc_id, seq // 5, """
    + fold("a")
    + """ ORDER BY rank, seq, a) AS f FROM big) WHERE f = 1) WHERE place <= 8)
    SELECT doc_id, CAST(CASE WHEN n > 4 THEN s.seq // 5 ELSE s.seq END AS BIGINT) AS seq, CAST(rank AS BIGINT) AS rank, a FROM small s JOIN sizes USING (doc_id)
    UNION ALL SELECT doc_id, g, rank, a FROM m""",
)
def reduce_notes(spark, d):
    level = N.reduce_notes(conversation_notes(spark, d), fan_in=4, caps=N.SECTION_CAPS)
    points = level.filter("field = 'points'")
    return points.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("rank").cast("long").alias("rank"), "a")


_STOP = N.affordable_chunks(14, 3)


@query(
    "read_coverage",
    rf"""WITH chunks AS (SELECT doc_id, unnest(k) AS chunk, unnest(range(len(k))) AS seq FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda l: trim(l, E' \t\n\r')), lambda l: l <> '') AS k FROM documents))
    SELECT doc_id, count(*) AS total, count(*) FILTER (seq >= {_STOP}) AS unread,
      CAST(round_even(100 * coalesce(sum(length(chunk)) FILTER (seq >= {_STOP}), 0) / sum(length(chunk)), 0) AS BIGINT) AS percent,
      coalesce(max(substr({flatten("chunk")}, 1, 60)) FILTER (seq = {_STOP}), '') AS starts FROM chunks GROUP BY doc_id""",
)
def read_coverage(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: T.strip(x)), lambda x: x != "")
    chunks = _docs(spark, d).select("doc_id", F.posexplode(lines).alias("seq", "chunk"))
    return N.read_coverage(chunks, limit=14, fan_in=3)


@query(
    "pack_notes",
    "WITH "
    + _NOTES_SQL
    + """, blocks AS (SELECT conv_id AS doc_id, seq, unnest([8, 6, 4, 3, 2]) AS keep FROM turns),
    t AS (SELECT b.doc_id, b.seq, b.keep, '[chunk ' || (b.seq + 1) || ']'
      || coalesce((SELECT string_agg(E'\\n- ' || a, '' ORDER BY rank) FROM points p WHERE p.doc_id = b.doc_id AND p.seq = b.seq AND p.rank < b.keep), '')
      || coalesce((SELECT string_agg(E'\\n  term: ' || a || ': ' || a || ' is said', '' ORDER BY rank) FROM words w WHERE w.doc_id = b.doc_id AND w.seq = b.seq), '')
      || coalesce((SELECT string_agg(E'\\n  quote: "' || a || '"', '' ORDER BY rank) FROM points p WHERE p.doc_id = b.doc_id AND p.seq = b.seq AND p.rank < 3), '')
      || coalesce((SELECT string_agg(E'\\n  relation: ' || a || ' --meets--> ' || reverse(a), '' ORDER BY rank) FROM words w WHERE w.doc_id = b.doc_id AND w.seq = b.seq AND w.rank < 3), '') AS x
      FROM blocks b),
    full_text AS (SELECT doc_id, keep, string_agg(x, E'\\n' ORDER BY seq) AS y FROM t GROUP BY ALL)
    SELECT doc_id, CAST(coalesce(max(keep) FILTER (length(y) <= 1500), 2) AS BIGINT) AS keep,
      md5(substr(coalesce(arg_max(y, keep) FILTER (length(y) <= 1500), max(y) FILTER (keep = 2)), 1, 1500)) AS text_md5 FROM full_text GROUP BY doc_id""",
)
def pack_notes(spark, d):
    packed = N.pack_notes(conversation_notes(spark, d), 1500)
    return packed.select("doc_id", F.col("keep").cast("long").alias("keep"), F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------------------- lines and mail


@query(
    "repeated_group_lines",
    r"""SELECT source, key, count(DISTINCT doc_id) AS documents FROM (
        SELECT source, doc_id, regexp_replace(lower(unnest(string_split(text, E'\n'))), '\d+', '#', 'g') AS key FROM documents)
        GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""",
)
def repeated_group_lines(spark, d):
    lines = _docs(spark, d).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return Y.repeated_group_lines(lines, "source", "doc_id")


@query(
    "drop_group_lines",
    r"""WITH l AS (SELECT source, doc_id, text, regexp_replace(lower(text), '\d+', '#', 'g') AS key FROM (
          SELECT source, doc_id, unnest(string_split(text, E'\n')) AS text FROM documents)),
        said AS (SELECT source, key FROM l GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM l ANTI JOIN said USING (source, key) GROUP BY doc_id""",
)
def drop_group_lines(spark, d):
    lines = _docs(spark, d).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    kept = Y.drop_group_lines(lines, "source", "doc_id")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("text")).cast("long").alias("chars"))


def layout_tasks(spark, d):
    """Tasks for the lines: so many for each split of the documents, so that a task's share does not grow with the input."""
    splits = spark.read.parquet(f"{d}/documents.parquet").rdd.getNumPartitions()
    return max(spark.sparkContext.defaultParallelism, 8 * splits)


def layout_lines(spark, d):
    """Document words set as lines of six on pages of forty, with sizes and margins that follow the text.

    Texts are dealt out by document before they become lines; windows and groups of a document's lines need no shuffle after that.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n_lines = F.ceil(F.size("w") / 6).cast("int")
    dealt = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").repartition(layout_tasks(spark, d), "doc_id")
    docs = dealt.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    rows = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), n_lines - 1), lambda i: F.struct(
        i.alias("i"), F.array_join(F.slice("w", i * 6 + 1, F.lit(6)), " ").alias("t")))).alias("x"))
    place = F.col("x.i") % 40
    cut = (F.length("x.t") > 30) & F.col("x.t").rlike(r"\p{L}$")
    return rows.select(
        "doc_id", (F.floor(F.col("x.i") / 40) + 1).cast("int").alias("page"), F.col("x.i").alias("line_no"), F.col("x.t").alias("text"),
        F.when(F.length("x.t") < 12, 14.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(50.0).alias("left"),
        (F.lit(50.0) + F.length("x.t") * 5).alias("right"), (F.lit(780.0) - place * 19).cast("double").alias("baseline"),
        F.lit(800.0).alias("page_height"), cut.alias("hyphen"),
    )


_LAYOUT = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
li AS (SELECT doc_id, i, array_to_string(w[i * 6 + 1 : i * 6 + 6], ' ') AS text FROM (
  SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 6.0) AS BIGINT))) AS i FROM w WHERE len(w) > 0)),
lines AS (SELECT doc_id, i // 40 + 1 AS page, i AS line_no, text, CASE WHEN length(text) < 12 THEN 14.0 ELSE 10.0 END AS size,
  780.0 - (i % 40) * 19 AS baseline, 50.0 AS l, 50.0 + length(text) * 5 AS r, length(text) > 30 AND regexp_matches(text, '\p{L}$') AS hyphen FROM li)"""


@query(
    "layout_margins",
    "WITH "
    + _LAYOUT
    + r""", k AS (SELECT *, (baseline < 56 OR baseline > 744) AS m, regexp_replace(lower(text), '\d+', '#', 'g') AS key FROM lines),
    n AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM k WHERE m GROUP BY ALL)
    SELECT k.doc_id, count(*) AS kept FROM k LEFT JOIN n USING (doc_id, key)
    WHERE NOT (m AND (regexp_matches(text, '(?i)^(page\s+)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$') OR coalesce(pages, 0) >= 3)) GROUP BY k.doc_id""",
)
def layout_margins(spark, d):
    return Y.drop_repeated_lines(layout_lines(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "layout_label_runs",
    "WITH "
    + _LAYOUT
    + r""", k AS (SELECT *, length(text) <= 24 AND len(list_filter(string_split(text, ' '), lambda x: x <> '')) <= 3
        AND NOT regexp_matches(text, '[.:]$') AND (length(text) <= 3 OR regexp_matches(text, '\d')) AS lab FROM lines),
    s AS (SELECT *, sum(CASE WHEN lab AND NOT coalesce(pl AND pp = page, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (
      SELECT *, lag(lab) OVER (PARTITION BY doc_id ORDER BY line_no) AS pl, lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) AS pp FROM k)),
    z AS (SELECT doc_id, run, count(*) AS n FROM s WHERE lab GROUP BY ALL)
    SELECT s.doc_id, count(*) AS kept FROM s LEFT JOIN z ON z.doc_id = s.doc_id AND z.run = s.run AND s.lab
    WHERE coalesce(z.n, 0) < 12 GROUP BY s.doc_id""",
)
def layout_label_runs(spark, d):
    return Y.drop_label_runs(layout_lines(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "layout_repeated_labels",
    "WITH "
    + _LAYOUT
    + r""", c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(text)) AS n, length(text) <= 60
        AND len(list_filter(string_split(text, ' '), lambda x: x <> '')) <= 8 AND NOT regexp_matches(text, '[.:;,?!]$') AS frag FROM lines)
    SELECT doc_id, count(*) AS kept FROM c WHERE NOT (frag AND n >= 8) GROUP BY doc_id""",
)
def layout_repeated_labels(spark, d):
    """No two of these lines share a baseline, so a repeated fragment always goes."""
    return Y.drop_repeated_labels(layout_lines(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "layout_clusters",
    "WITH "
    + _LAYOUT
    + r""", g AS (SELECT *, floor((l + r) / 2 / 200) AS i, floor(baseline / 50) AS j, length(text) <= 30 AS short FROM (
        SELECT doc_id, page, line_no, text, l, r, baseline / 4 AS baseline FROM lines)),
    cells AS (SELECT doc_id, page, floor((l + r) / 2 / 50) AS i, j, count(*) AS n FROM g WHERE short GROUP BY ALL),
    crowd AS (SELECT a.doc_id, a.page, a.i, a.j FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.page = b.page
      AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL HAVING sum(b.n) >= 40)
    SELECT g.doc_id, count(*) AS kept FROM g WHERE NOT (short AND EXISTS (SELECT 1 FROM crowd c WHERE c.doc_id = g.doc_id AND c.page = g.page
      AND abs(c.i - floor((g.l + g.r) / 2 / 50)) <= 1 AND abs(c.j - g.j) <= 1)) GROUP BY g.doc_id""",
)
def layout_clusters(spark, d):
    packed = layout_lines(spark, d).withColumn("baseline", F.col("baseline") / 4)
    return Y.drop_clusters(packed).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "layout_vocabulary",
    "WITH "
    + _LAYOUT
    + r""", c AS (SELECT doc_id, CASE WHEN cut THEN regexp_replace(t, '^\p{L}+', '') ELSE t END AS t FROM (
      SELECT doc_id, CASE WHEN hyphen THEN regexp_replace(lower(text), '\p{L}+$', '') ELSE lower(text) END AS t,
        coalesce(lag(hyphen) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS cut FROM lines))
    SELECT doc_id, count(DISTINCT word) AS words FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\p{L}{2,}')) AS word FROM c) GROUP BY doc_id""",
)
def layout_vocabulary(spark, d):
    return Y.vocabulary(layout_lines(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))


@query("layout_hyphens")
def layout_hyphens(spark, d):
    return Y.heal_hyphens(layout_lines(spark, d), layout_tasks(spark, d))


@query("layout_headings")
def layout_headings(spark, d):
    return Y.headings(layout_lines(spark, d))


@query("document_text")
def document_text(spark, d):
    blocks = Y.document_text(layout_lines(spark, d), dealt=True)
    return blocks.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query(
    "keep_images",
    """WITH a AS (SELECT conv_id AS uid, turn, length(text) * 4000 AS bytes, 150 + length(text) AS w FROM conversations),
       good AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY turn) AS rn FROM a WHERE bytes BETWEEN 5000 AND 5000000 AND w >= 200),
       RECURSIVE_TOTAL AS (SELECT uid, list_reduce(list_prepend({'t': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}, list({'t': CAST(bytes AS BIGINT), 'n': CAST(1 AS BIGINT)} ORDER BY rn)),
         lambda x, y: {'t': CASE WHEN x.t + y.t <= 15000000 THEN x.t + y.t ELSE x.t END, 'n': CASE WHEN x.t + y.t <= 15000000 THEN x.n + 1 ELSE x.n END}) AS z FROM good GROUP BY uid)
       SELECT uid, z.n AS images, z.t AS total FROM RECURSIVE_TOTAL""",
)
def keep_images(spark, d):
    turns = table(spark, d, "conversations")
    size = F.length("text")
    image = F.struct(
        F.col("turn"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("name"), F.lit("image/png").alias("declared"), F.lit("PNG").alias("format"),
        (size + 150).alias("width"), F.lit(300).alias("height"), (size * 4000).cast("long").alias("bytes"),
    )
    mail = turns.groupBy(F.col("conv_id").alias("uid")).agg(F.sort_array(F.collect_list(image)).alias("attachments"))
    return M.keep_images(mail).groupBy("uid").agg(F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("total"))


TODAY = date(2024, 1, 20)
__all__ = ["TODAY", "conversation_notes", "first_sentence", "layout_lines", "sectioned"]
