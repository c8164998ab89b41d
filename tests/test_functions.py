import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import language as L
from folioscope.functions import text as T
from folioscope.functions import urls as U


@pytest.mark.parametrize(
    "raw, folded",
    [("  Atención ", "atencion"), ("STRASSE Straße", "strasse strasse"), ("ﬁn…", "fin..."), ("Œuvre", "œuvre"), ("İx", "ix"), ("", "")],
)
def test_fold(value, raw, folded):
    assert value(T.fold, raw) == folded


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20), min_size=1, max_size=40))
def test_native_fold_equals_the_unicode_definition(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold("t").alias("n"), T.fold_any_script("t").alias("x"))
    for r in rows.collect():
        plain = "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c)).casefold().strip()
        assert r.n == plain == r.x


def test_keywords_order_by_count_then_first_place(spark):
    text = "zebra apple apple tiger zebra Mango with with with ab"
    row = spark.createDataFrame([(text,)], "t string").select(T.keywords("t", 3).alias("k")).first()
    assert row.k == ["zebra", "apple", "tiger"]


@pytest.mark.parametrize(
    "raw, norm",
    [
        ("https://X.org/a/?utm_source=m&b=2&a=1#top", "https://x.org/a?a=1&b=2"),
        ("http://x.org", "http://x.org/"),
        ("HTTPS://x.org/a;p=1?gclid=3&q=%20z", "https://x.org/a?q=+z"),
        ("https://www.linkedin.com/posts/me_a-share-77-x", "https://www.linkedin.com/feed/update/urn:li:share:77"),
        ("https://linkedin.com/feed/update/urn:li:activity:5/", "https://www.linkedin.com/feed/update/urn:li:activity:5"),
        ("https://notlinkedin.com/posts/me_a-share-77-x", "https://notlinkedin.com/posts/me_a-share-77-x"),
        ("docs/a.pdf", "docs/a.pdf"),
    ],
)
def test_normalize_url(value, raw, norm):
    assert value(U.normalize_url, raw) == norm


def test_urls_and_article_links(value):
    text = "a (https://a.b/c). https://click.mail.test/z http://list-manage.com/u https://a.b/unsubscribe https://a.b/x.png https://a.b/c"
    assert value(U.urls_in, text)[0] == "https://a.b/c"
    assert value(U.article_links, text) == ["https://a.b/c"]


def test_addresses(value):
    assert value(U.plain_address, "https://a.b/(x)") == "https://a.b/%28x%29"
    assert value(U.plain_address, 'https://a.b/"x') is None
    assert value(U.with_scheme, "site.org/a") == "https://site.org/a"
    assert value(U.with_scheme, "notes.md/a") == "notes.md/a"


def test_titles_and_slugs(value):
    assert value(T.safe_title, ' A/b: "c"\x07.') == "A b c"
    assert len(value(T.safe_title, "日" * 100).encode()) <= 240
    assert value(T.slugify, "Atención, ¡ya!") == "atencion-ya"
    assert value(T.slugify, "").startswith("untitled")
    assert value(T.slugify, "Привет").startswith("x-")
    assert value(T.file_title, "my-deck_v1.pptx") == "my deck v1"


def test_sentences_keep_numbered_items_whole(value):
    assert value(T.sentences, "Intro here. 1. First one. 2. Second one.\nLast") == ["Intro here.", "1. First one.", "2. Second one.", "Last"]


def test_short_forms(value):
    assert value(T.first_sentence, "One two three. Four.") == "One two three."
    assert value(T.first_sentence, "word") is None
    assert value(T.complete, "A whole long one. And half") == "A whole long one."
    assert value(T.one_line, "x " * 200).endswith("…")


def test_word_forms(value):
    assert value(T.stem, "investigaciones") == value(T.stem, "investigacion") == "investiga"
    assert value(T.stem, "casa") == "casa"
    assert value(T.number_norm, "1,200") == value(T.number_norm, "1.200") == "1200"
    assert value(T.number_norm, "3,5") == "3.5"
    assert value(T.term_key, "IA") == value(T.term_key, "AI")


def test_language(value):
    spanish = "de la casa y el perro que en los campos"
    assert value(lambda c: L.wrong_language(c, "en"), spanish) is True
    assert value(lambda c: L.wrong_language(c, "es"), spanish) is False
    silent = {**{k: dict(v) for k, v in __import__("folioscope.functions.values", fromlist=["LANGUAGES"]).LANGUAGES.items()}}
    silent["xx"] = {**silent["en"], "stopwords": []}
    assert value(lambda c: L.wrong_language(c, "xx", languages=silent), spanish) is False


def test_hostile_text_is_made_inert(value):
    assert value(T.fence_safe, "</source> <<SYS>> a < b [INST]") == "‹/source> ‹‹SYS>> a < b (INST)"
    assert value(T.sanitize_text, "<b>\x1b![x](y)") == "&lt;b>[x](y)"


def test_transcript_moment(value):
    script = "**0:10** · Hello\n**1:02:03** · The DOG runs"
    got = value(lambda t, u, n: T.quote_timestamp(t, u, F.lit("video"), n), script, "https://v.io/w?v=1", "dog runs")
    assert got == "https://v.io/w?v=1&t=3723s"


def test_native_functions_run_no_python(spark):
    rows = spark.createDataFrame([("a",)], "t string").select(T.keywords("t"), U.normalize_url("t"), T.sentences("t"), L.wrong_language("t", "en"))
    assert "EvalPython" not in rows._jdf.queryExecution().toString()


def test_first_sentence_reads_the_text_once(spark):
    texts = ["A first one is  here. Then more.", "x" * 40 + " b " + "y" * 200, "short", "word", "", None, "No end at all but words"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(T.first_sentence("t").alias("s"))
    assert [r.s for r in found.collect()] == ["A first one is here.", "x" * 40 + " b…", None, None, None, None, "No end at all but words"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
