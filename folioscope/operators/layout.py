"""Text of laid-out documents from `layout_lines`: (doc_id, page, line_no, text, size, bold, left,
right, baseline, page_height, hyphen). `line_no` orders the lines of a document.

Windows here run over one document's lines: where these lie in one partition (dealt out by `doc_id`), no step shuffles them,
and the steps of a document's text follow each other in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V

# fixed values: the shapes of headings, captions, rows and page numbers
NUMBERED = r"^(\d{1,2}(\.\d{1,2}){0,3}\.?|[A-Z]\.|Abstract|Appendix)(\s|$)"
CAPTION = r"(?i)^(figure|fig\.|table|figura|tabla)\s*\d+[.:]"
DEPTH = r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s"
REFERENCES = r"(?i)^(references|referencias|bibliography|bibliografía)$"
NUMBER = r"(?<![\p{L}\p{N}_.])[-+(]?\d+(?:[.,]\d+)?%?\)?(?![\p{L}\p{N}_.])"
PAGE_NUMBER = r"(?i)^(page\s+)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$"
LINE = ["doc_id", "page", "line_no", "text", "size", "bold", "left", "right", "baseline", "page_height", "hyphen"]


def _doc():
    return W.partitionBy("doc_id").orderBy("line_no")


def _of(*keys):
    return W.partitionBy("doc_id", *keys)


def _known(*columns):
    """Whether none of these is null: rows with a null key are in no group."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def line_key(text) -> Column:
    return F.regexp_replace(F.lower(T.as_column(text)), r"\d+", "#")


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """Drop page numbers in the margins, and margin lines said on three pages or more."""
    height = F.col("page_height")
    margin = (F.col("baseline") < height * V.MARGIN_FRACTION) | (F.col("baseline") > height * (1 - V.MARGIN_FRACTION))
    keyed = lines.withColumn("_m", margin).withColumn("_k", line_key("text"))
    pages = F.size(F.collect_set(F.when(F.col("_m") & _known("doc_id", "_k"), F.col("page"))).over(_of("_k")))
    marked = keyed.withColumn("_n", pages)
    gone = F.col("_m") & (F.col("text").rlike(PAGE_NUMBER) | (F.col("_n") >= V.MIN_REPEATS))
    return marked.filter(~gone).select(lines.columns)


def repeated_group_lines(lines: DataFrame, group: str, document: str, min_repeats: int = V.MIN_REPEATS) -> DataFrame:
    """The same rule without geometry: lines (digits as `#`) said in many documents of a group.

    Distinct (group, key, document) rows are counted after a partial aggregate; returns
    (group, key, documents).
    """
    keyed = lines.select(group, document, line_key("text").alias("key"))
    per_doc = keyed.distinct().groupBy(group, "key").agg(F.count(F.lit(1)).alias("documents"))
    return per_doc.filter(F.col("documents") >= min_repeats)


def drop_group_lines(lines: DataFrame, group: str, document: str, min_repeats: int = V.MIN_REPEATS) -> DataFrame:
    said = repeated_group_lines(lines, group, document, min_repeats).select(group, "key")
    return lines.withColumn("key", line_key("text")).join(said, [group, "key"], "left_anti").select(lines.columns)


def _n_words(text="text") -> Column:
    return F.size(T.words_of(text))


def is_fragment(text="text") -> Column:
    text = T.as_column(text)
    short = (F.length(text) <= V.MAX_LABEL_CHARS) & (_n_words(text) <= V.MAX_LABEL_WORDS)
    return short & ~text.rlike(r"[.:;,?!]$")


def drop_repeated_labels(lines: DataFrame) -> DataFrame:
    """Drop fragments a document says eight times or more, unless they sit in a row of prose: a
    line of text within two places, on the same page and baseline."""
    marked = lines.filter(_known("doc_id", "text")).withColumn("_low", F.lower("text"))
    marked = marked.withColumn("_n", F.count(F.lit(1)).over(_of("_low")))
    marked = marked.withColumn("_prose", ~is_fragment() & (F.col("_n") < V.MIN_LABEL_REPEATS))
    near = F.lit(False)
    for shift in (-2, -1, 0, 1, 2):
        here = lambda c, s=shift: F.lag(c, -s).over(_doc())
        same_row = F.abs(here("baseline") - F.col("baseline")) <= F.greatest(here("size"), F.col("size")) * 0.6
        near = near | F.coalesce(here("_prose") & (here("page") == F.col("page")) & same_row, F.lit(False))
    placed = marked.withColumn("_row", near)
    gone = is_fragment() & (F.col("_n") >= V.MIN_LABEL_REPEATS) & ~F.col("_row")
    return placed.filter(~gone).select(lines.columns)


def drop_clusters(lines: DataFrame) -> DataFrame:
    """Drop short lines packed into a small region of a page, and those of the cells around."""
    cell = V.CLUSTER_CELL_POINTS
    gridded = lines.withColumn("_i", F.floor((F.col("left") + F.col("right")) / 2 / cell)).withColumn(
        "_j", F.floor(F.col("baseline") / cell)
    )
    short = F.length("text") <= V.MAX_CLUSTER_CHARS
    placed = gridded.withColumn("_s", F.coalesce(short & _known("doc_id", "page", "_i", "_j"), F.lit(False)))
    here = _of("page", "_i", "_j", "_s")
    counted = placed.withColumn("_n", F.count(F.lit(1)).over(here)).withColumn("_r", F.row_number().over(here.orderBy("line_no")))
    cell = F.when(F.col("_s") & (F.col("_r") == 1), F.struct("_i", "_j", "_n"))  # each cell once, so a page's list follows its area
    of_page = counted.withColumn("_cells", F.collect_list(cell).over(_of("page"))).withColumn("_most", F.sum(F.col("_s").cast("int")).over(_of("page")))

    def beside(c, i, j, far=1):
        return (F.abs(c["_i"] - i) <= far) & (F.abs(c["_j"] - j) <= far)

    def chart(near):
        def crowded(c):
            around = F.filter(near, lambda o: beside(o, c["_i"], c["_j"]))
            return F.aggregate(around, F.lit(0).cast("long"), lambda n, o: n + o["_n"]) >= V.MIN_CLUSTER_LINES

        return F.exists(near, lambda c: beside(c, F.col("_i"), F.col("_j")) & crowded(c))

    near = F.filter("_cells", lambda c: beside(c, F.col("_i"), F.col("_j"), 2))
    marked = F.when(F.col("_s") & (F.col("_most") >= V.MIN_CLUSTER_LINES), T.let(near, chart)).otherwise(F.lit(False))
    return of_page.filter(~(short & marked)).select(lines.columns)


def is_label(text="text") -> Column:
    text = T.as_column(text)
    return (
        (F.length(text) <= 24) & (_n_words(text) <= 3) & ~text.rlike(r"[.:]$")
        & ((F.length(text) <= 3) | text.rlike(r"\p{Nd}"))
    )


def drop_label_runs(lines: DataFrame) -> DataFrame:
    """Drop runs of twelve or more label-like lines in a row on one page."""
    marked = lines.withColumn("_l", is_label())
    starts = ~F.lag("_l", 1, False).over(_doc()) | (F.lag("page").over(_doc()) != F.col("page"))
    island = F.sum((F.col("_l") & F.coalesce(starts, F.lit(True))).cast("int")).over(_doc())
    runs = marked.withColumn("_run", F.when(F.col("_l"), island))
    size = F.count(F.lit(1)).over(W.partitionBy("doc_id", "_run"))
    sized = runs.withColumn("_size", F.when(F.col("_run").isNotNull(), size))
    return sized.filter(F.coalesce(F.col("_size") < V.MIN_CHART_RUN, F.lit(True))).select(lines.columns)


def vocabulary(lines: DataFrame) -> DataFrame:
    """Distinct words of each document, without the halves a line end cut: (doc_id, word)."""
    return _whole_words(lines).select("doc_id", F.explode("_words").alias("word")).distinct()


def _whole_words(lines: DataFrame) -> DataFrame:
    """`lines` with `_words`, the distinct words of each that no line end cut."""
    text = F.lower("text")
    text = F.when(F.col("hyphen"), F.regexp_replace(text, r"\p{L}+$", "")).otherwise(text)
    cut = F.coalesce(F.lag("hyphen").over(_doc()), F.lit(False))
    whole = lines.withColumn("_t", F.when(cut, F.regexp_replace(text, r"^\p{L}+", "")).otherwise(text))
    return whole.withColumn("_words", F.array_distinct(T.find_all("_t", r"\p{L}{2,}"))).drop("_t")


def _halves(below) -> tuple[Column, Column]:
    """What the line ends with and what the next one begins with, in small letters."""
    return F.lower(F.regexp_extract("text", r"(\p{L}+)$", 1)), F.lower(F.regexp_extract(below, r"^(\p{L}+)", 1))


def _asked(head, tail) -> Column:
    """The words that tell whether a hyphen stays, with their roles: the joined word, its stems, both halves."""
    word = F.concat(head, tail)

    def stems(word):
        def at(i):
            stem, ending = F.substring(word, F.lit(1), i), F.substring(word, i + 1, F.length(word))
            doubled = F.substring(ending, 1, 1) == F.substring(stem, -1, 1)
            fits = ending.isin(*V.WORD_ENDINGS) | (doubled & F.substring(ending, F.lit(2), F.length(word)).isin(*V.WORD_ENDINGS))
            return F.when(fits, F.array(stem, F.concat(stem, F.lit("e"))))

        cuts = F.when(F.length(word) > 4, F.sequence(F.lit(4), F.length(word) - 1))
        return F.coalesce(F.flatten(F.array_compact(F.transform(cuts, at))), F.array().cast("array<string>"))

    def role(name, words):
        return F.transform(words, lambda w: F.struct(F.lit(name).alias("role"), w.alias("word")))

    return F.concat(role("joined", F.array(word)), role("joined", stems(word)), role("head", F.array(head)), role("tail", F.array(tail)))


def _stays() -> Column:
    """Whether the hyphen stays, from `head`, `tail` and which of the words are known (`_j`, `_h`, `_t`)."""
    joined, head, tail = (F.coalesce(c, F.lit(False)) for c in ("_j", "_h", "_t"))
    compound = F.col("head").isin(*V.COMPOUND_HEADS) | (head & (tail | (F.length("head") >= 4)))
    return (F.col("head") != "") & (F.col("tail") != "") & ~joined & compound


def _healed(lines: DataFrame) -> DataFrame:
    """`lines` with `head`, `tail` and `keep` of `heal_hyphens`, in place: lines and words lie with their document."""
    below = F.lead("text").over(_doc())
    cut = _whole_words(lines).withColumn("_below", below)
    head, tail = _halves("_below")
    cut = cut.withColumn("_pair", F.when(F.col("hyphen") & F.col("_below").isNotNull(), F.struct(head.alias("head"), tail.alias("tail"))))
    rest = [c for c in lines.columns if c not in ("doc_id", "line_no")]
    line = F.struct(*rest, "_pair")
    none = F.lit(None).cast(cut.select(line.alias("x")).schema["x"].dataType)

    def item(role, word, row=none):
        return F.struct(role.alias("role"), word.alias("word"), row.alias("_line"))

    items = F.concat(
        F.array(item(F.lit("line"), F.lit(None).cast("string"), line)), F.transform("_words", lambda w: item(F.lit("known"), w)),
        F.coalesce(F.when(F.col("_pair").isNotNull(), F.transform(_asked(F.col("_pair")["head"], F.col("_pair")["tail"]), lambda a: item(a["role"], a["word"]))), F.array()),
    )
    said = cut.select("doc_id", "line_no", F.inline(items))
    known = said.withColumn("_known", F.bool_or(F.col("role") == "known").over(_of("word")))
    hit = lambda role: F.bool_or((F.col("role") == role) & F.col("_known")).over(_of("line_no"))
    found = known.select("doc_id", "line_no", "role", "_line", hit("joined").alias("_j"), hit("head").alias("_h"), hit("tail").alias("_t")).filter("role = 'line'")
    found = found.select("doc_id", "line_no", "_line.*", "_j", "_h", "_t").select(*lines.columns, "_pair.*", "_j", "_h", "_t")
    return found.withColumn("keep", F.when(F.col("head").isNotNull(), _stays())).drop("_j", "_h", "_t")


def heal_hyphens(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """For each line that ends in a marked hyphen: does the hyphen stay? (doc_id, line_no, keep).

    The words a decision needs (the joined word, its stems, both halves) are looked up in the
    document's vocabulary by one equi-join, in `tasks` parts or as many as shuffles have.
    """
    deal = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    below = F.lead("text").over(_doc())
    pairs = lines.withColumn("_below", below).filter(F.col("hyphen") & F.col("_below").isNotNull())
    head, tail = _halves("_below")
    pairs = pairs.select("doc_id", "line_no", head.alias("head"), tail.alias("tail"))
    asked = pairs.select("doc_id", "line_no", F.inline(_asked(F.col("head"), F.col("tail"))))
    known = deal(vocabulary(lines), "doc_id", "word")
    hits = deal(asked, "doc_id", "word").join(known, ["doc_id", "word"]).groupBy("doc_id", "line_no").agg(
        *[F.bool_or(F.col("role") == r).alias(r) for r in ("joined", "head", "tail")]
    )
    hits = deal(hits, "doc_id", "line_no").withColumnsRenamed({"joined": "_j", "head": "_h", "tail": "_t"})
    found = deal(pairs, "doc_id", "line_no").join(hits, ["doc_id", "line_no"], "left")
    return found.select("doc_id", "line_no", "head", "tail", _stays().alias("keep"))


def _sized(lines: DataFrame) -> DataFrame:
    """`lines` with `body`, the size most characters of the document are set in; the one met first wins a tie."""
    per_size = lines.filter(_known("doc_id")).withColumn("_n", F.sum(F.length("text")).over(_of("size"))).withColumn("_at", F.min("line_no").over(_of("size")))
    best = F.max_by("size", F.struct("_n", (-F.col("_at")).alias("at")))
    return per_size.withColumn("body", best.over(_of())).drop("_n", "_at")


def body_sizes(lines: DataFrame) -> DataFrame:
    """The body size of each document: (doc_id, body)."""
    return _sized(lines).select("doc_id", "body").distinct()


def headings(lines: DataFrame) -> DataFrame:
    """Heading lines with their level: (doc_id, line_no, text, level), capped per document."""
    return _leveled(_sized(lines)).filter("level is not null").select("doc_id", "line_no", "text", "level")


def _leveled(sized: DataFrame) -> DataFrame:
    """`sized` lines with `level`, null for what is no heading."""
    big = F.col("size") >= F.col("body") * V.HEADING_SIZE_RATIO
    refs = F.col("text").rlike(REFERENCES)
    numbered = F.col("text").rlike(NUMBERED)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    plain = (F.length("text") <= V.MAX_HEADING_CHARS) & ~F.col("text").rlike(r"[,.;]$") & ~F.col("hyphen") & (letters >= 3)
    found = sized.withColumn("_found", F.coalesce(refs | (plain & (big | (F.col("bold") & numbered))), F.lit(False)))
    first = _of("_found").orderBy((numbered | refs).desc(), F.col("size").desc(), "line_no")
    cap = F.greatest(F.lit(V.MIN_HEADING_CAP), F.max("page").over(_of()) * V.HEADINGS_PER_PAGE)
    ranked = found.withColumn("_r", F.row_number().over(first)).withColumn("_cap", cap)
    best = ranked.withColumn("_best", F.col("_found") & (F.col("_r") <= F.col("_cap"))).withColumn("_big", big)
    leveled = best.withColumn("_place", F.dense_rank().over(_of("_best", "_big").orderBy(F.col("size").desc())))
    number = F.regexp_extract("text", DEPTH, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    level = (
        F.when(number != "", F.least(F.lit(4), 2 + dots))
        .when(F.col("_big"), F.least(F.lit(3), F.col("_place")))
        .otherwise(2)
    )
    return leveled.withColumn("level", F.when(F.col("_best"), level.cast("int"))).select(*sized.columns, "level")


def is_row(text="text") -> Column:
    """A table row: two numbers or more, mostly numbers, and not a sentence."""
    text = T.as_column(text)
    numbers = F.size(T.find_all(text, NUMBER))
    sentence = text.rlike(r"(^|[^\p{Nd}])\.$")
    return ~sentence & (numbers >= V.MIN_ROW_NUMBERS) & (numbers >= _n_words(text) * V.ROW_NUMBER_SHARE)


def reflow(lines: DataFrame) -> DataFrame:
    """Blocks of a document in order: (doc_id, block, kind, text); kind is heading, rows or text."""
    prev = lambda c: F.lag(c).over(_doc())
    sized = _leveled(_sized(_healed(lines)))
    pitch = prev("baseline") - F.col("baseline")
    usual = (prev("page") == F.col("page")) & (prev("size") == F.col("size")) & (F.col("size") == F.col("body"))
    pitched = sized.withColumn("_p", F.when(usual & (pitch > 0) & (pitch < F.col("body") * 3), pitch))
    pitched = pitched.withColumn("pitch", F.coalesce(F.median("_p").over(_of()), F.lit(0.0)))
    wide = pitched.filter(_known("page")).withColumn("_w", F.col("right") - F.col("left"))
    wide = wide.withColumn("_r", F.row_number().over(_of("page").orderBy("_w"))).withColumn("_n", F.count(F.lit(1)).over(_of("page")))
    wide = wide.withColumn("full", F.max(F.when(F.col("_r") == F.floor(F.col("_n") * 0.8) + 1, F.col("_w"))).over(_of("page")))
    # lines of one number share what was found for any of them
    place = lambda c: F.when(F.col("line_no").isNotNull(), F.collect_list(c).over(_of("line_no")))
    found = wide.withColumn("_levels", place("level")).withColumn("_keeps", place("keep"))
    rows = found.select(*lines.columns, "body", "pitch", "full", F.col("_keeps"), F.explode_outer("_levels").alias("level"))
    rows = rows.select(*lines.columns, "body", "pitch", "full", "level", F.explode_outer("_keeps").alias("keep"))
    kind = F.when(F.col("level").isNotNull(), "heading").when(is_row(), "rows").otherwise("text")
    rows = rows.withColumn("kind", kind)
    drop = prev("baseline") - F.col("baseline")
    wraps = (prev("size") == F.col("size")) & (prev("page") == F.col("page")) & (drop > 0) & (drop < F.col("size") * 2)
    ends = prev("text").rlike(r"[.?!:]$")
    elsewhere = (prev("page") != F.col("page")) | (F.col("baseline") > prev("baseline"))
    gap = (F.col("pitch") > 0) & (drop > F.col("pitch") * V.PARAGRAPH_GAP)
    indent = (F.col("left") > prev("left") + prev("size") * 0.8) | ((prev("right") - prev("left")) < F.col("full") * 0.6)
    new_paragraph = (
        F.when(F.col("text").rlike(CAPTION), True)
        .when(elsewhere, ends | prev("text").rlike(CAPTION))
        .when(gap, True)
        .when(~ends, False)
        .otherwise(indent)
    )
    joins_heading = wraps & (F.length(prev("text")) + F.length("text") <= V.MAX_HEADING_CHARS)
    starts = (
        F.when(prev("kind").isNull() | (prev("kind") != F.col("kind")), True)
        .when(F.col("kind") == "heading", ~F.coalesce(joins_heading, F.lit(False)))
        .when(F.col("kind") == "rows", False)
        .otherwise(F.coalesce(new_paragraph, F.lit(True)))
    )
    marked = rows.withColumn("_s", starts.cast("int"))
    blocks = marked.withColumn("block", F.sum("_s").over(_doc())).withColumn("_glue", F.coalesce(
        F.when(F.lag("hyphen").over(_doc()), F.when(F.lag("keep").over(_doc()), "-").otherwise("")), F.lit(" ")))
    piece = (
        F.when(F.col("_s") == 1, F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text")))
        .when(F.col("kind") == "rows", F.concat(F.lit("\n"), "text"))
        .when(F.col("kind") == "heading", F.concat(F.lit(" "), "text"))
        .otherwise(F.concat("_glue", "text"))
    )
    return (
        blocks.withColumn("_piece", piece)
        .groupBy("doc_id", "block", "kind")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "_piece"))).alias("p"))
        .select("doc_id", "block", "kind", F.array_join(F.transform("p", lambda x: x["_piece"]), "").alias("text"))
    )


def document_text(lines: DataFrame, dealt: bool = False) -> DataFrame:
    """All the steps: margins, chart labels, then blocks in reading order.

    Lines that are not `dealt` out by document yet are dealt out once; all else happens where a document's lines lie.
    """
    lines = lines if dealt else lines.repartition("doc_id")
    for step in (drop_repeated_lines, drop_repeated_labels, drop_clusters, drop_label_runs):
        lines = step(lines)
    return reflow(lines)
