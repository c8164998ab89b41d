"""Grounding of quotes, terms, relations, answers and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.operators import grounding as G
from folioscope.operators import model_map as MM
from folioscope.operators import names as N
from folioscope.operators.runs import plan_metrics
from folioscope.plans.corpus import (
    ENDINGS, STOPWORDS, doc_words, flat, flatten, fold, stem, table, wiki_pages, with_keywords, with_wiki,
)
from folioscope.plans.registry import query


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


# ----------------------------------------------------------------------------------------- quotes

_LINES = r"""lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (
  SELECT doc_id, string_split(text, E'\n') AS l FROM documents))"""


@query(
    "verified_quotes",
    rf"""WITH {_LINES}, q AS (SELECT doc_id, pos, trim(regexp_replace(trim(trim(lower(line), E' \t\n\r'), '"«»“”'), '\s+', ' ', 'g')) AS quote, {flat('line')} AS flat FROM lines),
    ok AS (SELECT doc_id, quote, min(pos) AS pos FROM q JOIN documents d USING (doc_id)
      WHERE length(quote) BETWEEN 25 AND 300 AND NOT regexp_matches(quote, '^[_*#]') AND contains({flat("d.text")}, {flat("quote")}) GROUP BY ALL)
    SELECT doc_id, md5(quote) AS quote, place FROM (SELECT doc_id, quote, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM ok) WHERE place <= 5""",
)
def verified_quotes(spark, d):
    """Every line of a document, in small letters and quotation marks, quoted back at it; and a wrong one."""
    docs = _docs(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    quotes = lines.select("doc_id", "pos", F.concat(F.lit("“"), "line", F.lit("”")).alias("quote"))
    wrong = docs.select("doc_id", F.lit(-1).alias("pos"), F.lit("a sentence that nobody ever wrote in here").alias("quote"))
    return G.verify_quotes(quotes.unionByName(wrong), docs, 5).select("doc_id", F.md5("quote").alias("quote"), "place")


@query(
    "supported_entities",
    with_keywords(
        f"SELECT w.doc_id, w.place, contains({fold('d.text')}, w.word) AS supported FROM (SELECT doc_id + 1 AS doc_id, place, word FROM doc_words) w JOIN documents d USING (doc_id)"
    ),
)
def supported_entities(spark, d):
    """The names of one document held against the next one."""
    rows = doc_words(spark, d).select((F.col("doc_id") + 1).alias("doc_id"), "place", F.upper("word").alias("title"), F.array(F.lit("")).alias("aliases"))
    return G.verify_entities(rows, _docs(spark, d)).select("doc_id", "place", "supported")


_TERMS = r"""
offered AS (SELECT doc_id, place * 2 AS pos, word AS term, 'A word that is said in the text by the author.' AS def FROM doc_words
  UNION ALL SELECT doc_id, place * 2 + 1, upper(word), CASE WHEN place = 1 THEN 'It is not defined in the text.' ELSE 'Again the same word.' END FROM doc_words
  UNION ALL SELECT doc_id, 100, 'zzqx unheard', 'Nobody said this one.' FROM documents
  UNION ALL SELECT doc_id, 101, word, 'La palabra que se usa en el texto de los autores.' FROM doc_words WHERE place = 2
  UNION ALL SELECT doc_id, 102, lang, 'The language of the text.' FROM documents)"""


@query(
    "verified_terms",
    with_wiki(
        f"""SELECT doc_id, pos, CASE WHEN pos = 100 OR pos = 101 OR NOT contains({fold('d.text')}, {fold('term')}) THEN 'unsupported'
          WHEN pos % 2 = 1 AND pos < 100 AND length({fold('term')}) > 5 THEN 'trivial' WHEN pos = 3 OR lower(term) IN ('data','information','system','process','technology','example','method','approach','result','problem') THEN 'trivial' ELSE 'kept' END AS verdict
          FROM offered JOIN documents d USING (doc_id) WHERE NOT (pos % 2 = 1 AND pos < 100 AND length(term) <= 5)""",
        _TERMS,
    ),
)
def verified_terms(spark, d):
    """Good terms, repeats in capitals, an invented one, one defined in Spanish, and the language code.

    Capitals of five letters or fewer are acronyms with a key of their own, so they are left out.
    """
    words = doc_words(spark, d)
    docs = table(spark, d, "documents")
    good = words.select("doc_id", (F.col("place") * 2).alias("pos"), F.concat(F.lit("*"), "word", F.lit("*")).alias("term"), F.lit("A word that is said in the text by the author.").alias("definition"))
    loud = words.filter(F.length("word") > 5).select("doc_id", (F.col("place") * 2 + 1).alias("pos"), F.upper("word").alias("term"),
        F.when(F.col("place") == 1, "It is not defined in the text.").otherwise("Again the same word.").alias("definition"))
    new = docs.select("doc_id", F.lit(100).cast("long").alias("pos"), F.lit("zzqx unheard").alias("term"), F.lit("Nobody said this one.").alias("definition"))
    spanish = words.filter("place = 2").select("doc_id", F.lit(101).cast("long").alias("pos"), F.col("word").alias("term"), F.lit("La palabra que se usa en el texto de los autores.").alias("definition"))
    code = docs.select("doc_id", F.lit(102).cast("long").alias("pos"), F.col("lang").alias("term"), F.lit("The language of the text.").alias("definition"))
    offered = good.unionByName(loud).unionByName(new).unionByName(spanish).unionByName(code)
    return G.verify_terms(offered, docs.select("doc_id", "text"), wiki_pages(spark, d)).select("doc_id", "pos", "verdict")


@query(
    "verified_relations",
    with_keywords(
        rf"""SELECT a.doc_id, a.place AS pos, CASE WHEN a.place = 4 THEN 'skipped' WHEN a.place = 3 THEN 'dropped' ELSE 'kept' END AS verdict
        FROM doc_words a JOIN doc_words b ON a.doc_id = b.doc_id AND b.place = 1"""
    ),
)
def verified_relations(spark, d):
    """Two true relations, one with an invented end, one from a word to itself."""
    words = doc_words(spark, d)
    first = words.filter("place = 1").select("doc_id", F.col("word").alias("b"))
    invented = F.when(F.col("place") == 3, F.lit("zzqx unheard")).when(F.col("place") == 4, F.col("b")).otherwise(
        F.when(F.col("place") == 2, F.concat(F.lit('"'), "word", F.lit('[] main'))).otherwise(F.concat("word", F.lit(" uno")))
    )
    rows = words.join(first, "doc_id").select("doc_id", F.col("place").alias("pos"), invented.alias("a"), F.lit("meets").alias("relation"), "b")
    names = words.select("doc_id", F.concat("word", F.lit(" main")).alias("name")).unionByName(
        words.select("doc_id", F.concat("word", F.lit(" uno de los otros")).alias("name"))
    )
    tokens = _docs(spark, d)
    return G.verify_relations(rows, names, tokens).select("doc_id", "pos", "verdict")


@query(
    "concept_graph",
    with_keywords(
        """SELECT doc_id, place AS pos, 'n1' AS node_a, 'n' || place AS node_b FROM doc_words WHERE place >= 2 AND doc_id IN (
           SELECT doc_id FROM doc_words WHERE place = 3)"""
    ),
)
def concept_graph(spark, d):
    words = doc_words(spark, d)
    first = words.filter("place = 1").select("doc_id", F.col("word").alias("a"))
    rows = words.filter("place >= 2").join(first, "doc_id").select("doc_id", F.col("place").alias("pos"), "a", F.lit("meets").alias("relation"), F.col("word").alias("b"))
    return G.concept_graph(rows).select("doc_id", "pos", "node_a", "node_b")


# ---------------------------------------------------------------------------------------- answers

_SENT = r"""string_split(regexp_replace(regexp_replace({0}, '([.!?])\s+([\["“¿¡(]*[A-ZÁÉÍÓÚÑ\d])', E'\\1\x1f\\2', 'g'), '\n+', E'\x1f', 'g'), E'\x1f')"""


@query(
    "sentences",
    "SELECT doc_id, unnest(k) AS sentence, unnest(range(len(k))) AS seq FROM (SELECT doc_id, " + _SENT.format("text") + " AS k FROM documents)",
)
def sentences(spark, d):
    """Sentences of every document. Separators inside one are kept, so the pieces are whole."""
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("seq", "sentence")).withColumn("seq", F.col("seq").cast("long"))


_FUNCTION = (
    "'embargo','after','before','between','during','through','however','because','although','according','while','there','their','sobre','ademas','aunque',"
    "'segun','durante','tiene','tienen','puede','pueden','tambien','cada','otro','otra','otros'"
)
_KEY = rf"CASE WHEN regexp_matches(w, '^\d') THEN (CASE WHEN regexp_matches(w, '^\d{{1,3}}([.,]\d{{3}})+$') THEN regexp_replace(w, '[.,]', '', 'g') ELSE replace(w, ',', '.') END) ELSE {stem(fold('w'))} END"
_TOKENS = r"regexp_extract_all({0}, '\d+(?:[.,]\d+)*|\p{{L}}+')"


def _claims(pieces: str) -> str:
    bare = r"regexp_replace(regexp_replace(sentence, '^\s*(?:[-*•]+|\d+[.)])\s+', ''), '\[\[[^\[\]]{0,200}\]\]', ' ', 'g')"
    return rf"""
tok AS (SELECT answer_id, seq, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT answer_id, seq, {_TOKENS.format(bare)} AS t FROM {pieces})),
claims AS (SELECT answer_id, seq, w, key, num OR (up AND length(p) >= 3) AS strong FROM (
  SELECT answer_id, seq, w, i, {_KEY} AS key, {fold('w')} AS p, regexp_matches(w, '^\d') AS num, i > 0 AND regexp_matches(w, '^\p{{Lu}}') AS up FROM tok)
  WHERE num OR (p NOT IN ({STOPWORDS}) AND p NOT IN ({_FUNCTION}) AND ((up AND length(p) >= 3) OR length(p) >= 5)))"""


_ANSWERS = rf"""
turns AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, role, text FROM conversations),
pieces AS (SELECT answer_id, unnest(k) AS sentence, unnest(range(len(k))) AS seq FROM (SELECT answer_id, {_SENT.format('text')} AS k FROM turns WHERE role = 'assistant')),
{_claims('pieces')},
evidence AS (SELECT DISTINCT a.answer_id, e.answer_id AS page_id FROM turns a JOIN turns e ON a.conv_id = e.conv_id AND e.role = 'user' WHERE a.role = 'assistant'),
vocab AS (SELECT answer_id AS page_id, {_KEY} AS key FROM (SELECT DISTINCT answer_id, unnest({_TOKENS.format('text')}) AS w FROM turns WHERE role = 'user')),
found AS (SELECT DISTINCT e.answer_id, v.key FROM evidence e JOIN vocab v USING (page_id)),
judged AS (SELECT c.answer_id, c.seq, count(*) AS n_claims, count(*) FILTER (f.key IS NULL) AS n_missing,
  count(*) FILTER (f.key IS NULL AND strong) > 0 OR (count(*) FILTER (f.key IS NULL AND NOT strong) >= 2
    AND count(*) FILTER (f.key IS NULL AND NOT strong) >= 0.5 * count(*) FILTER (NOT strong)) AS unsupported
  FROM claims c LEFT JOIN found f ON f.answer_id = c.answer_id AND f.key = c.key GROUP BY c.answer_id, c.seq)"""


def _turns(spark, d):
    return table(spark, d, "conversations").withColumn("answer_id", F.col("conv_id") * 1000 + F.col("turn"))


def _said(spark, d):
    """Assistant turns are answers, the user turns of their thread the evidence."""
    turns = _turns(spark, d)
    answers = turns.filter("role = 'assistant'").select("answer_id", "conv_id", "text")
    users = turns.filter("role = 'user'").select(F.col("answer_id").alias("page_id"), "conv_id", "text")
    evidence = answers.select("answer_id", "conv_id").join(users.select("page_id", "conv_id"), "conv_id").select("answer_id", "page_id")
    return answers.select("answer_id", "text"), evidence, users.select("page_id", "text")


@query(
    "answer_claims",
    f"WITH docs_text AS (SELECT doc_id AS answer_id, text FROM documents), pieces AS (SELECT answer_id, unnest(k) AS sentence, unnest(range(len(k))) AS seq FROM (SELECT answer_id, {_SENT.format('text')} AS k FROM docs_text)), {_claims('pieces')}"
    " SELECT answer_id, seq, count(*) AS claims, count(*) FILTER (strong) AS strong FROM claims GROUP BY ALL",
)
def answer_claims(spark, d):
    rows = G.answer_claims(_docs(spark, d).select(F.col("doc_id").alias("answer_id"), "text")).filter(F.size("claims") > 0)
    return rows.select("answer_id", F.col("seq").cast("long").alias("seq"), F.size("claims").cast("long").alias("claims"), F.size(F.filter("claims", lambda c: c["strong"])).cast("long").alias("strong"))


@query("answer_support", f"WITH {_ANSWERS} SELECT answer_id, seq, n_claims, n_missing, unsupported FROM judged")
def answer_support(spark, d):
    answers, evidence, users = _said(spark, d)
    rows = G.check_support(answers, evidence, users)
    return rows.select(
        "answer_id", F.col("seq").cast("long").alias("seq"), F.col("n_claims").cast("long").alias("n_claims"),
        F.size("missing").cast("long").alias("n_missing"), "unsupported",
    )


@query(
    "answer_verdicts",
    f"""WITH {_ANSWERS}, langs AS (SELECT answer_id AS page_id, conv_id, turn, text FROM turns WHERE role = 'user'),
    n AS (SELECT answer_id, count(*) AS checked, count(*) FILTER (unsupported) AS bad FROM judged GROUP BY 1),
    fl AS (SELECT page_id, es >= (CASE WHEN length(text) >= 300 THEN 4 ELSE 2 END) AND es > 1.5 * en AS fo FROM (
      SELECT page_id, text, len(list_filter(t, lambda w: w IN ('the','of','and','to','in','is','that','for','with','are','this','on','as','by','from','be','an'))) AS en,
        len(list_filter(t, lambda w: w IN ('de','la','el','que','en','los','las','y','un','una','para','con','por','del','se','es','al','como','más','pero','sus'))) AS es
      FROM (SELECT page_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS t FROM langs))),
    af AS (SELECT answer_id, bool_and(fo) AS all_f FROM evidence JOIN fl USING (page_id) GROUP BY 1),
    first_user AS (SELECT conv_id, min(turn) AS turn FROM turns WHERE role = 'user' GROUP BY 1),
    base AS (SELECT a.answer_id, CASE WHEN u.turn IS NULL THEN 0 ELSE 1 END AS c, coalesce(all_f, false) AS skip, coalesce(checked, 0) AS ck, coalesce(bad, 0) AS b
      FROM turns a LEFT JOIN first_user u ON u.conv_id = a.conv_id AND u.turn < a.turn LEFT JOIN n USING (answer_id) LEFT JOIN af USING (answer_id) WHERE a.role = 'assistant')
    SELECT answer_id, CAST(c AS BIGINT) AS citations, CASE WHEN skip THEN 0 ELSE ck END AS checked, CASE WHEN skip THEN 0 ELSE b END AS unsupported,
      c > 0 AND (skip OR b * 2 <= ck) AS grounded FROM base""",
)
def answer_verdicts(spark, d):
    """Answers cite the first user turn of their thread when it came before; evidence is all of them."""
    answers, evidence, users = _said(spark, d)
    turns = _turns(spark, d)
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first"))
    marked = turns.filter("role = 'assistant'").join(first, "conv_id", "left")
    cite = F.when(F.col("first") < F.col("turn"), F.array(F.concat(F.lit("[[turn "), (F.col("conv_id") * 1000 + F.col("first")).cast("string"), F.lit("]]"))))
    answers = marked.select("answer_id", "text", F.coalesce(cite, F.array(F.lit("http://nowhere"))).alias("cited_pages"))
    pages = users.select(
        "page_id", F.concat(F.lit("turn "), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("turn "), F.col("page_id").cast("string")).alias("stem"),
        F.lit("sources").alias("kind"), F.col("page_id").cast("string").alias("path"), F.array().cast("array<string>").alias("aliases"), F.col("text").alias("body"),
    )
    shown = G.answer_verdict(answers, pages.withColumn("title", F.col("title")), evidence)
    return shown.select("answer_id", "citations", "checked", "unsupported", "grounded")


# -------------------------------------------------------------------------------- summaries, plans


@query(
    "summary_problems",
    rf"""WITH s AS (SELECT item_id AS page_id, text AS summary FROM benchmark),
    ev AS (SELECT b.item_id AS page_id, d.text AS evidence FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    x AS (SELECT page_id, summary, evidence, len(list_filter(t, lambda w: w IN ('the','of','and','to','in','is','that','for','with','are','this','on','as','by','from','be','an'))) AS en,
        len(list_filter(t, lambda w: w IN ('de','la','el','que','en','los','las','y','un','una','para','con','por','del','se','es','al','como','más','pero','sus'))) AS es
      FROM (SELECT page_id, summary, coalesce(evidence, '') AS evidence, regexp_extract_all(lower(summary), '\p{{L}}+') AS t FROM s LEFT JOIN ev USING (page_id))),
    sen AS (SELECT page_id, unnest(string_split(regexp_replace(summary, '([.!?])\s+', E'\\1\x1f', 'g'), E'\x1f')) AS q FROM s),
    w AS (SELECT page_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT page_id, regexp_extract_all(q, '[\p{{L}}\p{{N}}_-]+') AS t FROM sen)),
    known AS (SELECT DISTINCT page_id, unnest(regexp_extract_all({fold('evidence')}, '[\p{{L}}\p{{N}}_-]+')) AS k FROM x),
    odd AS (SELECT page_id, count(DISTINCT w) AS n FROM w WHERE (regexp_matches(w, '\d') OR (i > 0 AND regexp_matches(w, '^\p{{Lu}}')))
      AND NOT EXISTS (SELECT 1 FROM known WHERE known.page_id = w.page_id AND known.k = {fold('w')}) GROUP BY 1)
    SELECT page_id, CAST((CASE WHEN length(summary) BETWEEN 80 AND 900 THEN 0 ELSE 1 END) + (CASE WHEN es >= 4 AND es > 1.5 * en THEN 1 ELSE 0 END) + coalesce(n, 0) AS BIGINT) AS problems
    FROM x LEFT JOIN odd USING (page_id)""",
)
def summary_problems(spark, d):
    """Benchmark passages as summaries of the documents with their number."""
    summaries = table(spark, d, "benchmark").select(F.col("item_id").alias("page_id"), F.col("text").alias("summary"))
    evidence = _docs(spark, d).select(F.col("doc_id").alias("page_id"), "text")
    return G.summary_problems(summaries, evidence).select("page_id", F.size("problems").cast("long").alias("problems"))


def raw_plans(spark, d):
    """A model's answer per document, as JSON: some without a one-line summary, some too short."""
    docs = table(spark, d, "documents")
    words = doc_words(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    rows = docs.join(words, "doc_id")
    names = F.transform("w", lambda x: x["word"])
    line = F.regexp_replace("text", r"\s+", " ")
    one = F.when(F.col("lang") == "en", F.lit("https://example.org/x")).when(F.col("lang") == "fr", F.col("source")).otherwise(F.lit("A line that says what it is."))
    plan = F.struct(
        F.concat("source", F.lit(" note")).alias("title"), one.alias("one_liner"), line.alias("summary"), F.array_repeat(line, 12).alias("key_points"),
        F.array_repeat(F.lit("tag"), 9).alias("tags"),
        F.transform(names, lambda n: F.struct(n.alias("title"), F.array().cast("array<string>").alias("aliases"), F.concat(F.lit("It says "), n, F.lit(" a lot.")).alias("description"))).alias("concepts"),
        F.concat(names, F.array(F.lit("nowhere at all"))).alias("related_pages"),
    )
    return rows.select("doc_id", F.to_json(plan).alias("raw_json"))


_PLANS = rf"""
base AS (SELECT doc_id, lang, source, regexp_replace(text, '\s+', ' ', 'g') AS s, (SELECT count(*) FROM doc_words w WHERE w.doc_id = d.doc_id) AS n FROM documents d),
sent AS (SELECT *, coalesce(nullif(regexp_extract(trim(s), '^(.*?[.!?]) ', 1), ''), trim(s)) AS f FROM base WHERE n > 0),
line AS (SELECT *, CASE WHEN length(f) > 160 THEN rtrim(regexp_replace(substr(f, 1, 159), ' [^ ]*$', ''), ' ,;:') || '…' ELSE f END AS g FROM sent),
judged AS (SELECT *, lang IN ('en', 'fr') AND length(s) >= 30 AND length(g) >= 10 AND contains(g, ' ') AS repaired FROM line)"""


@query(
    "validated_plans",
    with_keywords(
        """SELECT doc_id, repaired, (lang NOT IN ('en', 'fr') OR repaired) AND length(s) >= 30 AS valid, CAST(8 AS BIGINT) AS points, CAST(6 AS BIGINT) AS tags, CAST(n AS BIGINT) AS concepts,
        CASE WHEN repaired THEN g WHEN lang = 'en' THEN 'https://example.org/x' WHEN lang = 'fr' THEN source ELSE 'A line that says what it is.' END AS one_liner FROM judged""",
        _PLANS,
    ),
)
def validated_plans(spark, d):
    rows = MM.validate_plans(raw_plans(spark, d))
    return rows.select(
        "doc_id", "repaired", "valid", F.size("plan.key_points").cast("long").alias("points"), F.size("plan.tags").cast("long").alias("tags"),
        F.size("plan.concepts").cast("long").alias("concepts"), F.col("plan.one_liner").alias("one_liner"),
    )


def _hits(code: str) -> str:
    """Stopwords of a language among the `words` of a row, in SQL."""
    listed = ", ".join(f"'{w}'" for w in V.LANGUAGES[code]["stopwords"])
    return f"len(list_filter(words, lambda w: w IN ({listed})))"


_PROSE = rf"""
prose AS (SELECT doc_id, regexp_extract_all(lower(concat_ws(' ', CASE WHEN repaired THEN g WHEN lang = 'en' THEN 'https://example.org/x' WHEN lang = 'fr' THEN source ELSE 'A line that says what it is.' END,
  s, repeat(s || ' ', 8), (SELECT string_agg('It says ' || word || ' a lot.', ' ') FROM doc_words w WHERE w.doc_id = j.doc_id))), '\p{{L}}+') AS words FROM judged j),
tongues AS (SELECT doc_id, NOT ({_hits("es")} >= 4 AND {_hits("es")} > 1.5 * {_hits("en")}) AS in_language FROM prose)"""


@query(
    "plan_metrics",
    with_wiki(
        """SELECT doc_id, count(*) AS concepts, CAST(0 AS BIGINT) AS entities, any_value(in_language) AS in_language,
           1 + count(*) FILTER (word NOT IN (SELECT name FROM wiki_names)) AS bad_refs
           FROM doc_words JOIN tongues USING (doc_id) GROUP BY doc_id""",
        _PLANS,
        _PROSE,
    ),
)
def plan_metrics_of_plans(spark, d):
    plans = MM.validate_plans(raw_plans(spark, d)).select("doc_id", "plan.*")
    rows = plan_metrics(plans, N.page_names(wiki_pages(spark, d)))
    return rows.select("doc_id", "concepts", "entities", "in_language", "bad_refs")


@query(
    "links_to_follow",
    """SELECT page_id, url, CAST(1 AS BIGINT) AS place FROM pages WHERE NOT contains(url, '#')
       UNION ALL SELECT page_id, 'https://other.example/' || page_id, CASE WHEN contains(url, '#') THEN 1 ELSE 2 END FROM pages""",
)
def links_to_follow(spark, d):
    """Plans that choose a post's link in another spelling, twice, one of its own, and a foreign one."""
    pages = table(spark, d, "pages")
    other = F.concat(F.lit("https://other.example/"), F.col("page_id").cast("string"))
    tail = F.when(F.col("url").contains("?"), "&utm_medium=x#y").otherwise("?utm_medium=x#y")
    asked = F.when(F.col("url").contains("#"), F.array(F.lit("not an address"), F.lit("https://foreign.example/"), other)).otherwise(
        F.array(F.concat("url", tail), F.lit("https://foreign.example/"), F.col("url"), F.concat(other, F.lit("/")))
    )
    plans = pages.select(F.col("page_id").alias("doc_id"), asked.alias("follow"))
    docs = pages.select(F.col("page_id").alias("doc_id"), F.array("url", other).alias("links"))
    return MM.links_to_follow(plans, docs, 3).select(F.col("doc_id").alias("page_id"), "url", "place")


@query(
    "model_calls",
    "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'invalid' ELSE 'ok' END AS status, CAST(CASE WHEN length(text) > 1000 THEN 2 ELSE 1 END AS BIGINT) AS tries FROM documents",
)
def model_calls(spark, d):
    """A stand-in model over every document: it answers with the length, and long ones are refused."""

    def answer(prompts):
        return [str(len(p.split("\n\nYour previous answer")[0])) for p in prompts]

    def check(text):
        return "too long" if int(text) > 1000 else ""

    rows = MM.map_model(_docs(spark, d).withColumnRenamed("text", "prompt"), answer, check=check)
    return rows.select("doc_id", "status", F.col("tries").cast("long").alias("tries"))


__all__ = ["ENDINGS", "flatten"]
