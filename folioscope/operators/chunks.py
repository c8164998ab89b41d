"""Cutting text: chunks, halves, sections, context windows. All folds run inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.functions.language import every_label
from folioscope.operators.common import computed

REFERENCES = r"(?im)^[#*\s]*(?:references|referencias|bibliography|bibliografía)[\s*:]*$"
STRINGS = "array<string>"


def cut_references(c) -> Column:
    """Text without its trailing bibliography (the last such heading past the middle)."""
    c = T.as_column(c)
    parts = F.split(c, REFERENCES)
    tail = T.let(parts, lambda p: F.length(F.element_at(p, -1)))
    heading = F.length(F.element_at(T.find_all(c, REFERENCES), -1))
    start = F.length(c) - tail - heading
    late = (F.size(parts) > 1) & (start > F.length(c) * 0.5)
    return F.when(late, T.rstrip(F.substring(c, F.lit(1), start))).otherwise(c)


def pack_paragraphs(paragraphs: Column, size: int) -> Column:
    """Greedy chunks of at most `size` characters; a longer paragraph is cut hard."""
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit("").alias("open"))

    def step(acc, para):
        n = F.length(para)
        whole = F.floor((n - 1) / size).cast("int")
        flushed = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: F.substring(para, (i - 1) * size + 1, F.lit(size)))
        too_long = n > size
        done = F.when(too_long, F.concat(flushed, pieces)).otherwise(acc["done"])
        rest = F.when(too_long, F.substring(para, whole * size + 1, F.lit(size))).otherwise(para)
        open_ = F.when(too_long, F.lit("")).otherwise(acc["open"])
        full = (open_ != "") & (F.length(open_) + F.length(rest) + 2 > size)
        return F.struct(
            F.when(full, F.concat(done, F.array(open_))).otherwise(done).alias("done"),
            F.when(full | (open_ == ""), rest).otherwise(F.concat(open_, F.lit("\n\n"), rest)).alias("open"),
        )

    def finish(acc):
        return F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    return F.aggregate(paragraphs, start, step, finish)


def chunks_of(c, size: int = V.CHUNK_CHARS, para_sep: str = r"\n\s*\n") -> Column:
    paragraphs = F.transform(F.split(cut_references(c), para_sep), lambda p: T.strip(p))
    return pack_paragraphs(F.filter(paragraphs, lambda p: p != ""), size)


def split_chunks(docs: DataFrame, size: int = V.CHUNK_CHARS, para_sep: str = r"\n\s*\n") -> DataFrame:
    """One row per chunk: (doc_id, seq from 0, chunk). No shuffle."""
    return docs.select("doc_id", F.posexplode(chunks_of("text", size, para_sep)).alias("seq", "chunk"))


def halves(c) -> Column:
    """The text cut in two: at the paragraph break nearest the middle if close, else at a blank."""
    c = T.as_column(c)
    middle = F.floor(F.length(c) / 2).cast("int")

    def starts(pattern):
        """Offsets where `pattern` matches: running lengths of the pieces and the matches."""
        pieces = F.split(c, pattern)
        found = T.find_all(c, pattern)
        zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos"))

        def walk(ps, ms):
            def step(acc, i):
                at = acc["pos"] + F.length(F.get(ps, i))
                return F.struct(
                    F.concat(acc["at"], F.array(at)).alias("at"), (at + F.length(F.get(ms, i))).alias("pos")
                )

            order = F.sequence(F.lit(0), F.greatest(F.size(ms) - 1, F.lit(0)))
            return F.when(F.size(ms) > 0, F.aggregate(order, zero, step, lambda a: a["at"])).otherwise(
                F.array().cast("array<int>")
            )

        return T.let(pieces, lambda ps: T.let(found, lambda ms: walk(ps, ms)))

    def nearest(offsets):
        ranked = F.transform(offsets, lambda o: F.struct(F.abs(o - middle).alias("d"), o.alias("o")))
        return F.array_min(ranked)["o"]

    def nearest_blank():
        left, right = F.substring(c, F.lit(1), middle + 1), F.substring(c, middle + 2, F.length(c))
        before = F.when(left.rlike(T.BLANK), F.length(F.regexp_extract(left, "(?s)^(.*)" + T.BLANK, 1)))
        after = F.when(right.rlike(T.BLANK), middle + 1 + F.length(F.regexp_extract(right, "(?s)^(.*?)" + T.BLANK, 1)))
        return F.when(before.isNull() | (after - middle < middle - before), after).otherwise(before)

    near = F.filter(starts(r"\n\s*\n"), lambda o: F.abs(o - middle) < F.floor(F.length(c) / 4))
    close = F.when(c.rlike(r"\n\s*\n"), nearest(near))
    cut = F.coalesce(close, nearest_blank())
    return F.array(T.strip(F.substring(c, F.lit(1), cut)), T.strip(F.substring(c, cut + 1, F.length(c))))


# ------------------------------------------------------------------------------ page sections


def from_source_heads() -> str:
    return T.any_literal(every_label("from_source"))


def sections_of(c) -> Column:
    """The `## From [[source]]` sections of a body, in order: array<struct<source, text>>."""
    pattern = rf"(?ms)^## (?:{from_source_heads()}) \[\[(.+?)\]\]\n(.*?)(?=^## |\z)"
    return F.transform(
        F.arrays_zip(T.find_all(c, pattern, 1).alias("source"), T.find_all(c, pattern, 2).alias("text")),
        lambda s: F.struct(s["source"].alias("source"), T.strip(s["text"]).alias("text")),
    )


def page_sections(pages: DataFrame, keep: int = 12, evidence_chars: int = 6000) -> DataFrame:
    """The last `keep` sections of each page, with the share of the evidence each may show."""
    kept = F.slice(F.col("s"), F.greatest(F.size("s") - keep + 1, F.lit(1)), keep)
    found = computed(pages.select("page_id", "title", "body"), s=sections_of("body")).filter(F.size("s") > 0)
    rows = found.select("page_id", "title", F.size(kept).alias("n"), F.posexplode(kept).alias("pos", "x"))
    share = F.floor(F.lit(evidence_chars) / F.col("n")).cast("int")
    return rows.select(
        "page_id", "title", "pos", F.col("x.source").alias("source"), F.col("x.text").alias("text"),
        F.substring(F.col("x.text"), F.lit(1), share).alias("shown"),
    )


def heading_key(heading: Column) -> Column:
    """The catalogue key of a section heading, in whatever language; else the heading itself."""

    def named(folded):
        key = heading
        for entry in reversed(list(V.LANGUAGES.values())):
            labels = {**entry["sections"], "concept_summary": entry["concept_summary"], "from_source": entry["from_source"]}
            for name, label in labels.items():
                key = F.when(folded == T.fold_char(label), F.lit(name)).otherwise(key)
        return key

    return T.let(T.flat(heading), named)


def page_context(c, budget: int = 1800) -> Column:
    """The page text within `budget` characters: whole sections by usefulness, in page order."""
    return T.let(T.as_column(c), lambda body: T.let(F.split(body, r"(?m)^## "), lambda parts: _context_of(body, parts, budget)))


def _context_of(c: Column, parts: Column, budget: int) -> Column:
    head = F.get(parts, F.lit(0))
    raw = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))

    def parsed(chunk, i):
        heading = T.strip(F.regexp_extract(chunk, r"^([^\n]*)", 1))
        text = T.strip(F.regexp_extract(chunk, r"(?s)^[^\n]*\n(.*)", 1))
        shown = F.concat(F.lit("## "), heading, F.lit("\n"), text)
        return T.let(
            heading,
            lambda h: F.struct(
                i.alias("i"), heading_key(h).alias("key"), shown.alias("text"),
                (heading_key(F.regexp_replace(h, r" \[\[.*$", "")) == "from_source").alias("evidence"),
            ),
        )

    def pack(sections):
        priority = F.lit(len(V.SECTION_PRIORITY) + 1)
        fresh = F.filter(
            sections, lambda s: F.size(F.filter(sections, lambda o: (o["key"] == s["key"]) & (o["i"] < s["i"]))) == 0
        )

        def rank(s):
            place = F.when(s["evidence"], F.lit(len(V.SECTION_PRIORITY))).otherwise(priority)
            for n, name in reversed(list(enumerate(V.SECTION_PRIORITY))):
                place = F.when(s["key"] == name, F.lit(n)).otherwise(place)
            return place

        ranked = F.sort_array(F.transform(fresh, lambda s: F.struct(rank(s).alias("r"), s["i"].alias("i"), s["text"].alias("text"))))
        useful = F.filter(ranked, lambda s: s["r"] <= len(V.SECTION_PRIORITY))
        start = F.struct(F.lit("").alias("picked"), F.length(head).alias("used"))

        def take(acc, s):
            fits = acc["used"] + F.length(s["text"]) + 2 <= budget
            mark = F.concat(F.lit("|"), s["i"].cast("string"), F.lit("|"))
            return F.struct(
                F.when(fits, F.concat(acc["picked"], mark)).otherwise(acc["picked"]).alias("picked"),
                F.when(fits, acc["used"] + F.length(s["text"]) + 2).otherwise(acc["used"]).alias("used"),
            )

        picked = F.aggregate(useful, start, take, lambda a: a["picked"])
        return T.let(
            picked,
            lambda marks: F.when(marks == "", F.substring(c, 1, budget)).otherwise(
                F.substring(
                    F.array_join(
                        F.concat(
                            F.array(T.strip(head)),
                            F.transform(
                                F.filter(
                                    fresh, lambda s: marks.contains(F.concat(F.lit("|"), s["i"].cast("string"), F.lit("|")))
                                ),
                                lambda s: s["text"],
                            ),
                        ),
                        "\n\n",
                    ),
                    1,
                    budget,
                )
            ),
        )

    return T.let(F.transform(raw, parsed), pack)


def put_section(c, heading: str, text) -> Column:
    """The body with `## heading` right under its `# Title`, replacing an earlier summary."""
    rest = T.strip(without_summary(c))
    block = F.concat(F.lit(f"## {heading}\n"), T.as_column(text))
    first = F.regexp_extract(rest, r"^([^\n]*)", 1)
    others = T.strip(F.regexp_extract(rest, r"(?s)^[^\n]*\n(.*)", 1))
    titled = T.strip(F.concat(first, F.lit("\n\n"), block, F.lit("\n\n"), others))
    return F.when(first.startswith("# "), titled).otherwise(T.strip(F.concat(block, F.lit("\n\n"), rest)))


def without_summary(c) -> Column:
    heads = T.any_literal(every_label("concept_summary"))
    return F.regexp_replace(T.as_column(c), rf"(?ms)^## (?:{heads})\n.*?(?=^## |\z)", "")


def without_sections(c, titles: Column) -> Column:
    """The body without the sections of the given source titles, in one pass over its sections.

    A removed section takes the blank lines before it along; the next one keeps its line break.
    """
    c = T.as_column(c)
    head = rf"\A## (?:{from_source_heads()}) \[\[([^\n]*)\]\]\n"

    def gone(block):
        name = F.regexp_extract(block, head, 1)
        return (name != "") & F.coalesce(F.array_contains(titles, name), F.lit(False))

    def rebuild(blocks):
        def shown(block, i):
            before = F.when(F.coalesce(gone(F.get(blocks, i - 1)), F.lit(False)), F.lit("\n")).otherwise(F.lit(""))
            after = F.when(
                F.coalesce(gone(F.get(blocks, i + 1)), F.lit(False)), F.regexp_replace(block, r"\n+\z", "")
            ).otherwise(block)
            return F.when(gone(block), F.lit("")).otherwise(F.concat(before, after))

        return F.array_join(F.transform(blocks, shown), "")

    return T.let(F.split(c, r"(?m)^(?=## )"), rebuild)
