"""Documents out of web pages, clips and structured data."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import site_rules as R
from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators.common import computed

MIN_ARTICLE_CHARS = 200
MIN_CLIP_CHARS = 40
CLIP_KINDS = ("article", "paper", "email", "video")
MAX_IMAGES = 5
NOT_CONTENT = r"(?i)logo|icon|avatar|sprite|pixel|tracking|badge|button"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def unescape(c) -> Column:
    c = T.as_column(c)
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def main_region(html) -> Column:
    """The `<article>` or `<main>` part of a page, else its body; no scripts, styles or navigation."""
    html = T.as_column(html)
    quiet = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav|header|footer|aside|form)\b.*?</\1\s*>", " ")
    quiet = F.regexp_replace(quiet, r'(?is)<div[^>]*class="[^"]*\b(?:ad|ads|advert|cookie|banner)\b[^"]*"[^>]*>.*?</div\s*>', " ")
    article = F.regexp_extract(quiet, r"(?is)<article\b[^>]*>(.*)</article\s*>", 1)
    main = F.regexp_extract(quiet, r"(?is)<main\b[^>]*>(.*)</main\s*>", 1)
    return F.when(article != "", article).when(main != "", main).otherwise(quiet)


def html_text(html) -> Column:
    """Readable text: block tags break lines, other tags vanish, entities are spelled out."""
    blocks = F.regexp_replace(
        main_region(html), r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|blockquote|pre)\b[^>]*>", "\n"
    )
    plain = unescape(F.regexp_replace(blocks, r"<[^>]*>", ""))
    lines = F.regexp_replace(plain, r"[ \t\r\x0b\x0c]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r" ?\n ?", "\n"), r"\n{2,}", "\n\n"), F.lit(" \n"))


def html_title(html) -> Column:
    return T.flatten(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))


def extract_html(pages: DataFrame) -> DataFrame:
    """Articles of web pages: (page_id, url, title, text, kind); under 200 characters is no article."""
    read = computed(pages.select("page_id", "url", "html"), t=html_title("html"), text=html_text("html"))
    return read.filter(F.length("text") >= MIN_ARTICLE_CHARS).select(
        "page_id", "url", F.when(F.col("t") == "", F.col("url")).otherwise(F.col("t")).alias("title"), "text",
        F.lit("article").alias("kind"),
    )


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    value = F.regexp_replace(quoted, rf"(?is)^\s{name}\s*=\s*", "")
    return unescape(F.regexp_replace(value, r"""^["']|["']$""", ""))


def image_links(html, url, most: int | None = None) -> Column:
    """At most five content images of the article: array<struct<alt, url>>, linked, never fetched."""

    def described(tag):
        return F.struct(
            T.strip(_attribute(tag, "src")).alias("src"), T.flatten(_attribute(tag, "alt")).alias("alt"),
            _attribute(tag, "class").alias("css"),
            F.coalesce(F.try_to_number(F.regexp_extract(_attribute(tag, "width"), r"^(\d+)$", 1), F.lit("999999999")), F.lit(0)).alias("w"),
            F.coalesce(F.try_to_number(F.regexp_extract(_attribute(tag, "height"), r"^(\d+)$", 1), F.lit("999999999")), F.lit(0)).alias("h"),
        )

    def content(i):
        path = F.lower(F.regexp_replace(i["src"], r"[?#].*$", ""))
        tiny = ((i["w"] > 0) & (i["w"] < 100)) | ((i["h"] > 0) & (i["h"] < 100))
        return (
            (i["src"] != "") & ~i["src"].startswith("data:") & ~path.endswith(".svg") & ~path.endswith(".gif") & ~tiny
            & ~i["src"].rlike(NOT_CONTENT) & ~i["css"].rlike(NOT_CONTENT)
        )

    tags = F.transform(T.find_all(main_region(html), r"(?is)<img\b[^>]*>"), described)
    linked = F.transform(
        F.filter(tags, content), lambda i: F.struct(i["alt"].alias("alt"), U.absolute_url(url, i["src"]).alias("url"))
    )
    web = F.filter(linked, lambda i: i["url"].rlike("(?i)^https?://"))
    first = T.let(
        web,
        lambda v: F.filter(
            F.transform(v, lambda i, n: F.struct(i["alt"].alias("alt"), i["url"].alias("url"), n.alias("n"))),
            lambda i: F.array_position(F.transform(v, lambda o: o["url"]), i["url"]) == i["n"] + 1,
        ),
    )
    return first if most is None else F.slice(first, 1, most)


def page_images(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Content images of each page, all of them or the first `most`."""
    return pages.select("page_id", F.inline(image_links("html", F.col("url"), most))).select("page_id", "n", "alt", "url")


POST_SCHEMA = "`@type` string, articleBody string, headline string, author struct<name:string>"


def extract_posts(pages: DataFrame, max_links: int | None = None) -> DataFrame:
    """Social posts from a page's structured data; comments sit in other fields and are left out."""
    blocks = T.find_all("html", r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", 1)
    posts = F.filter(
        F.transform(blocks, lambda b: F.from_json(b, POST_SCHEMA)),
        lambda p: (p["@type"] == "SocialMediaPosting") & (F.trim(F.coalesce(p["articleBody"], F.lit(""))) != ""),
    )
    first = pages.select("page_id", "url", F.get(posts, F.lit(0)).alias("p")).filter(F.col("p").isNotNull())
    body = T.strip(F.col("p.articleBody"))
    author = T.strip(F.coalesce(F.col("p.author.name"), F.lit("")))
    stated = T.strip(F.coalesce(F.col("p.headline"), F.lit("")))
    named = first.select("page_id", "url", body.alias("body"), author.alias("author"), stated.alias("stated"))
    headline = F.when(F.col("stated") != "", F.col("stated")).otherwise(F.regexp_extract("body", r"^([^\n\r]*)", 1))
    return named.select(
        "page_id", "url",
        F.when(F.col("author") != "", F.concat("author", F.lit(" on LinkedIn: "), headline)).otherwise(headline).alias("title"),
        F.when(F.col("author") != "", F.concat(F.lit("By "), "author", F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("text"),
        F.lit("article").alias("kind"),
        (U.urls_in("body") if max_links is None else F.slice(U.urls_in("body"), 1, max_links)).alias("links"),
    )


def outbound_url(html) -> Column:
    """Where a short link's interstitial page points; NULL when it shows no such link."""
    tag = T.find_all(html, r"(?is)<a\b[^>]*data-tracking-control-name=[\"']external_url_click[\"'][^>]*>")
    links = F.filter(F.transform(tag, lambda t: T.strip(_attribute(t, "href"))), lambda h: U.is_url(h))
    return F.get(links, F.lit(0))


# -------------------------------------------------------------------------------- site chrome


RULES = (
    ("site", "string"), ("ord", "int"), ("hosts", "string"), ("signature", "string"), ("plain", "array<string>"),
    ("words", "array<string>"), ("heads", "array<string>"), ("lines", "string"), ("any_head", "string"),
    ("block_heads", "array<string>"), ("block_bodies", "array<string>"),
)


def _rule_rows(rules: dict) -> list[tuple]:
    def anchored(patterns):
        return "(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$" if patterns else "(?!)"

    rows = []
    for order, (site, r) in enumerate(rules.items()):
        hosts = "(?:^|\\.)(?:" + "|".join(re.escape(d) for d in r["domains"]) + ")$"
        rows.append((
            site, order, hosts, "(?i)" + r["signature"], r["plain"], list(dict.fromkeys(r["link_words"] + r["plain"])), r["heads"],
            anchored(r["lines"]), anchored([h for h, _ in r["blocks"]]), [f"(?i)^(?:{h})$" for h, _ in r["blocks"]],
            [None if b is None else f"(?i)^(?:{b})$" for _, b in r["blocks"]],
        ))
    return rows


def _rule_literals(rules: dict) -> Column:
    """The rules as one constant array<struct>, read from JSON so the plan holds it once."""
    text = json.dumps([dict(zip([n for n, _ in RULES], row)) for row in _rule_rows(rules)], ensure_ascii=False)
    return F.from_json(F.lit(text), "array<struct<" + ",".join(f"{n}:{t}" for n, t in RULES) + ">>")


_LINK = r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)"
_HEADING = r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$"
_TRANSCRIPT = r"^\s*\*\*\d+(?::\d{2}){1,2}\*\* ·"
MAX_BLOCK_LINE, MAX_CHROME_LINE = 160, 400


def _plain_line(c) -> Column:
    c = F.replace(F.regexp_replace(c, _LINK, "$1"), F.lit("’"), F.lit("'"))
    c = T.flatten(F.regexp_replace(c, r"[*_`]", ""))
    return F.lower(F.trim(F.rtrim(F.ltrim(c, F.lit("…")), F.lit(".:!…"))))


def _line_facts(line: Column, rule: Column) -> Column:
    """What one line is: struct<line, long, fence, short, chrome, block>; `block` is the section it heads."""
    heading = F.regexp_extract(line, _HEADING, 1)
    is_heading = line.rlike(_HEADING)
    bare = F.regexp_replace(line, r"^\s*(?:[-*+]\s+)?", "")
    links = T.find_all(bare, _LINK)
    only_links = line.contains("](") & (F.size(links) > 0) & (
        F.regexp_replace(F.regexp_replace(bare, _LINK, ""), r"[\s|·•-]+", "") == ""
    )

    def known(link):
        target = F.regexp_extract(link, _LINK, 2)
        here = ~target.rlike("^https?://") | F.regexp_like(U.host(target), rule["hosts"])
        return F.array_contains(rule["words"], _plain_line(link)) & here

    def judged(plain):
        """`plain`: the cleaned heading, or the whole cleaned line."""
        chrome = (
            F.when(is_heading, F.array_contains(rule["heads"], plain))
            .when(only_links, F.forall(links, known))
            .otherwise((plain != "") & (F.array_contains(rule["plain"], plain) | F.regexp_like(plain, rule["lines"])))
        )
        which = F.array_position(F.transform(rule["block_heads"], lambda h: F.regexp_like(plain, h)), True) - 1
        block = F.when(F.regexp_like(plain, rule["any_head"]), which).otherwise(F.lit(-1).cast("long"))
        trimmed = T.strip(line)
        fence = trimmed.rlike(r"^(?:```|~~~)")
        short = (F.length(trimmed) <= MAX_BLOCK_LINE) & ~is_heading & ~fence & ~trimmed.rlike(_TRANSCRIPT)
        long = F.length(line) > MAX_CHROME_LINE  # also keeps the patterns off hostile huge lines
        return F.struct(
            trimmed.alias("line"), long.alias("long"), fence.alias("fence"), (short & ~long).alias("short"),
            F.when(long, F.lit(False)).otherwise(chrome).alias("chrome"), F.when(long, F.lit(-1).cast("long")).otherwise(block).alias("block"),
        )

    return T.let(_plain_line(F.when(is_heading, heading).otherwise(line)), judged)


def _stripped(text: Column, rule: Column) -> Column:
    """struct<text, removed>: a fold over the lines of one row.

    A line and the blank lines after it are one item, so an item only needs to look at the next.
    A block's head goes when its block needs no set shape, or when the next item has that shape.
    """
    items = T.find_all(text, r"(?:\A\s*\n)?[^\n]*\S[^\n]*(?:\n(?:[^\S\n]*(?:\n|\z))*)?")
    facts = F.transform(
        items,
        lambda it: F.struct(it.alias("raw"), _line_facts(F.regexp_extract(it, r"([^\n]*\S[^\n]*)", 1), rule).alias("f")),
    )

    def fold_lines(rows):
        start = F.struct(
            F.lit(False).alias("fenced"), F.lit(-1).cast("long").alias("block"), F.lit("").alias("kept"), F.lit(0).alias("removed")
        )

        def fits(i, block):
            """Has item i the shape of the lines of `block`?"""
            f = F.get(rows, i)["f"]
            shape = F.get(rule["block_bodies"], block.cast("int"))
            return (block >= 0) & F.coalesce(f["short"] & (shape.isNull() | F.regexp_like(f["line"], shape)), F.lit(False))

        def step(acc, i):
            f, raw = F.get(rows, i)["f"], F.get(rows, i)["raw"]
            inside = fits(i, acc["block"])
            fenced = F.when(f["fence"] & ~f["long"] & ~inside, ~acc["fenced"]).otherwise(acc["fenced"])
            shapeless = F.get(rule["block_bodies"], f["block"].cast("int")).isNull()
            opens = ~inside & ~fenced & (f["block"] >= 0) & (shapeless | fits(i + 1, f["block"]))
            block = F.when(inside, acc["block"]).when(opens, f["block"]).otherwise(F.lit(-1).cast("long"))
            gone = inside | opens | (~fenced & f["chrome"])
            blanks = F.regexp_extract(raw, r"\n((?:[^\S\n]*(?:\n|\z))*)\z", 1)
            rest = F.when(gone, F.when(fits(i + 1, block), F.lit("")).otherwise(blanks)).otherwise(raw)
            return F.struct(
                fenced.alias("fenced"), block.alias("block"), F.concat(acc["kept"], rest).alias("kept"),
                (acc["removed"] + gone.cast("int")).alias("removed"),
            )

        folded = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0))), start, step)
        return F.when(F.size(rows) > 0, folded)

    def tidy(done):
        clean = T.strip(F.regexp_replace(done["kept"], r"\n{3,}", "\n\n"))
        return F.when(done["removed"] > 0, F.struct(clean.alias("text"), done["removed"].alias("removed")))

    return T.let(T.let(facts, fold_lines), tidy)


def strip_chrome(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """`docs` with the page chrome of the known sites removed and `stripped_lines` counted.

    Conservative: a line goes only when all of it is known chrome. Unknown sites stay untouched,
    fenced code is never read. The rules are one constant of a few rows that Spark folds once, and
    each row looks its site up in it, so the documents are never shuffled.
    """
    known = rules or R.SITE_RULES
    every = _rule_literals(known)
    has_url = F.coalesce("url", F.lit("")) != ""
    by_host = F.filter(every, lambda x: F.col("url").rlike("^https?://") & F.regexp_like(U.host("url"), x["hosts"]))
    by_footer = F.filter(every, lambda x: F.regexp_like("text", x["signature"]))
    rule = F.get(F.when(has_url, by_host).otherwise(by_footer), F.lit(0))
    sited = computed(docs, _rule=rule)
    done = computed(sited, _c=F.when(F.col("_rule").isNotNull(), _stripped(F.col("text"), F.col("_rule"))))
    return done.withColumn("stripped_lines", F.coalesce(F.col("_c.removed"), F.lit(0)).cast("long")).withColumn(
        "text", F.coalesce(F.col("_c.text"), F.col("text"))
    ).drop("_c", "_rule")


def accept_clip(docs: DataFrame) -> DataFrame:
    """Clips worth reading: 40 characters or more, a known kind, transcript rows as paragraphs."""
    kind = F.when(F.col("kind").isin(*CLIP_KINDS), F.col("kind")).otherwise("article")
    rows = F.regexp_replace("text", r"\n(?=\*\*\d+(?::\d{2}){1,2}\*\* · )", "\n\n")
    return (
        docs.filter(F.length("text") >= MIN_CLIP_CHARS)
        .withColumn("text", F.when(F.col("kind") == "video", rows).otherwise(F.col("text")))
        .withColumn("kind", kind)
    )
