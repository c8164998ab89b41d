"""Changing the wiki: upserts, cascading deletes, titles and slugs. Pages are copied on write.

A page's per-source sections live in a table of their own, `sections(page_id, source, seq, text)`,
and its sources in `page_sources(page_id, source)`: a page with very many sources is many rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.operators.chunks import without_sections, without_summary
from folioscope.operators.common import durable, first_by, ordered_scan
from folioscope.operators.names import best_names, page_names, resolve_refs


def is_reserved(title) -> Column:
    """Names of special pages and of daily notes: a page called so would shadow them."""
    return T.fold(title).isin(*V.RESERVED_TITLES) | T.strip(title).rlike(r"^\d{4}-\d{2}-\d{2}$")


def model_text(c) -> Column:
    return T.sanitize_text(c, drop_control=False)


# ---------------------------------------------------------------------------------- upsert


def edit_targets(pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What page each edit is for, as if the edits were applied one after the other: (edits, dropped, owners).

    Edits get their number `no` in the order (seq, pos) and `page_key` (`id:` and a page's id, or `new:` and a folded name). A name that
    no page has belongs to the first edit that gives it, as title or as alias; a later edit of that name is for the same page. So an
    edit without a page points to the edit that gave its name, this one perhaps to an earlier one, and so on: pointers are doubled,
    round by round, until all point to edits whose page is known or new. `owners(name, owner, taken)` says whose page a name means.
    Dropped are edits whose name is empty, reserved, or that of a source: their own, one that has a page, or one earlier in the batch.
    """
    names = page_names(pages)
    plain = edits.withColumn("name", T.safe_title("title")).withColumn("key", T.fold("name")).withColumn("folded", T.fold("title"))
    numbered = ordered_scan(plain.withColumn("own", T.fold("source_title")), ["seq", "pos", "title", "source_title"]).withColumnRenamed("rn", "no")
    arrivals = numbered.groupBy(F.col("own").alias("name")).agg(F.min("seq").alias("arrives"))
    meaning = best_names(names).select("name", F.col("page_id").alias("owner_id"))
    targets = best_names(names, ("concepts", "entities", "syntheses"))
    noted = best_names(names, ("sources",)).select(F.col("name").alias("key")).withColumn("_source", F.lit(True))
    at_key = arrivals.select(F.col("name").alias("key"), F.col("arrives").alias("_arrives"))
    judged = numbered.join(noted, "key", "left").join(at_key, "key", "left").join(
        targets.select(F.col("name").alias("folded"), F.col("page_id").alias("found_id")), "folded", "left"
    )
    bad = (
        (F.col("name") == "") | (F.col("key") == F.col("own")) | F.coalesce("_source", F.lit(False)) | is_reserved("name")
        | F.coalesce(F.col("_arrives") < F.col("seq"), F.lit(False))
    )
    judged = durable(judged.withColumn("_bad", bad).drop("_source", "_arrives", "own"))
    good = judged.filter("not _bad").drop("_bad")
    titles = good.filter("found_id is null").select(F.col("key").alias("name"), "no", "seq", F.lit(0).alias("rank"))
    mentions = titles.unionByName(_offered(good).select("name", "no", "seq", F.lit(1).alias("rank")))
    free = mentions.join(meaning, "name", "left_anti").join(arrivals, "name", "left").filter(~F.coalesce(F.col("arrives") < F.col("seq"), F.lit(False)))
    givers = durable(free.groupBy("name").agg(F.min("no").alias("giver")))
    by_title, by_key = (givers.select(F.col("name").alias(c), F.col("giver").alias(g)) for c, g in (("folded", "_g1"), ("key", "_g2")))
    open_ = good.select("no", "folded", "key", "found_id").join(by_title, "folded", "left").join(by_key, "key", "left")
    earlier = lambda g: F.when(F.col(g) < F.col("no"), F.col(g))
    to = F.when(F.col("found_id").isNotNull(), F.col("no")).otherwise(F.coalesce(earlier("_g1"), earlier("_g2"), F.col("no")))
    links = durable(open_.select("no", to.alias("to")))
    total = lambda df: df.agg(F.sum("to")).first()[0]
    before, now = None, total(links)
    while before != now:  # pointers only go down: equal sums are equal pointers
        links = durable(links.join(links.select(F.col("no").alias("to"), F.col("to").alias("_next")), "to").select("no", F.col("_next").alias("to")))
        before, now = now, total(links)
    page = F.when(F.col("found_id").isNotNull(), F.concat(F.lit("id:"), F.col("found_id").cast("string"))).otherwise(F.concat(F.lit("new:"), "key"))
    roots = good.select(F.col("no").alias("to"), page.alias("page_key"), F.col("found_id").alias("_found"))
    placed = durable(good.drop("found_id").join(links, "no").join(roots, "to").withColumnRenamed("_found", "found_id").drop("to"))
    given = givers.join(placed.select(F.col("no").alias("giver"), F.col("page_key").alias("owner")), "giver").select("name", "owner", F.lit(False).alias("taken"))
    owners = given.unionByName(meaning.select("name", F.concat(F.lit("id:"), F.col("owner_id").cast("string")).alias("owner"), F.lit(True).alias("taken")))
    return placed, judged.filter("_bad").select("seq", "pos", "title", "source_title"), owners


def _offered(edits: DataFrame) -> DataFrame:
    """The aliases of edits as rows, with the folded `name` of each; reserved ones and an edit's own name are none."""
    rows = edits.withColumn("alias", F.explode("aliases")).filter((F.col("alias") != "") & ~is_reserved("alias") & (F.col("alias") != F.col("name")))
    return rows.withColumn("name", T.fold("alias"))


def merge_concepts(
    pages: DataFrame, sources: DataFrame, edits: DataFrame, private: DataFrame, today: date
) -> dict[str, DataFrame]:
    """Apply concept and entity edits: new pages, added sections, sources and aliases.

    `pages` as in the data model, `sources(page_id, source)`, `private(title)` private source titles,
    `edits(seq, pos, kind, title, aliases, description, source_title, is_private)`; (seq, pos) is
    the order of application, and results are those of applying one edit after the other: a name or
    alias an edit brings is known to the edits after it. Returns `upserts` (page heads to write),
    `aliases` (page_key, alias), `sections`, `sources` (rows to add) and `dropped` (edits skipped).
    """
    good, dropped, owners = edit_targets(pages, edits)
    public = F.struct(F.col("is_private").alias("p"), "no")
    heads = good.groupBy("page_key").agg(
        F.first("found_id").alias("found_id"),
        F.min_by(F.struct("kind", "name", "description", "is_private"), "no").alias("first"),
        F.min_by("description", public).alias("public_description"),
        F.bool_or(~F.col("is_private")).alias("has_public"),
    )
    # born private: every source of the existing page is a private one
    secret = private.select(F.col("title").alias("source")).distinct().withColumn("_p", F.lit(True))
    born = (
        sources.join(secret, "source", "left").groupBy(F.col("page_id").alias("found_id"))
        .agg(F.bool_and(F.coalesce("_p", F.lit(False))).alias("all_private"))
    )
    old = pages.select(
        F.col("page_id").alias("found_id"), F.col("kind").alias("old_kind"), F.col("title").alias("old_title"), F.col("summary").alias("old_summary"),
    )
    joined = heads.join(old, "found_id", "left").join(born, "found_id", "left").withColumn("title", F.coalesce("old_title", F.col("first.name")))
    aliases = durable(_page_aliases(pages, joined, good, owners))
    listed = aliases.groupBy("page_key").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))  # the page's own column of them
    line = model_text(T.one_line(F.col("public_description")))
    first_line = model_text(T.one_line(F.col("first.description")))
    created = F.col("found_id").isNull()
    reborn = F.col("has_public") & F.when(created, F.col("first.is_private")).otherwise(F.coalesce("all_private", F.lit(False)))
    summary = F.when(reborn, line).when(created, first_line).otherwise(F.coalesce("old_summary", first_line))
    upserts = joined.join(listed, "page_key", "left").select(
        "page_key", F.col("found_id").alias("page_id"), F.coalesce("old_kind", F.col("first.kind")).alias("kind"), "title",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), summary.alias("summary"), F.lit(today).alias("updated"), created.alias("created"),
    )
    mine = sources.select(F.concat(F.lit("id:"), F.col("page_id").cast("string")).alias("page_key"), F.col("source").alias("source_title"))
    fresh = first_by(
        good.select("page_key", "source_title", "no", "seq", "pos", model_text(T.strip("description")).alias("text")),
        ["page_key", "source_title"], ["no"],
    ).join(mine, ["page_key", "source_title"], "left_anti")
    return {
        "upserts": upserts,
        "aliases": aliases,
        "sections": fresh.select("page_key", F.col("source_title").alias("source"), "seq", "pos", "text"),
        "sources": fresh.select("page_key", F.col("source_title").alias("source")),
        "dropped": dropped,
    }


def _page_aliases(pages: DataFrame, heads: DataFrame, edits: DataFrame, owners: DataFrame) -> DataFrame:
    """(page_key, alias): the old and offered aliases of the written pages that mean no other page, are not reserved and not the title."""
    own = heads.select("page_key", "found_id", "title")
    held = pages.select(F.col("page_id").alias("found_id"), F.explode("aliases").alias("alias")).join(own.select("page_key", "found_id"), "found_id")
    offered = edits.select("page_key", F.explode("aliases").alias("alias"))
    every = held.select("page_key", "alias").unionByName(offered).filter((F.col("alias") != "") & ~is_reserved("alias")).distinct()
    meant = every.withColumn("name", T.fold("alias")).join(owners.select("name", "owner"), "name")
    return meant.filter(F.col("owner") == F.col("page_key")).join(own.select("page_key", "title"), "page_key").filter("alias <> title").select("page_key", "alias")


def page_ids(upserts: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, page_id): the ids of the written pages; a new page has one made from its key."""
    made = F.abs(F.xxhash64("page_key")).cast(pages.schema["page_id"].dataType)
    return upserts.select("page_key", F.coalesce("page_id", made).alias("page_id"))


def apply_upserts(pages: DataFrame, upserts: DataFrame) -> DataFrame:
    """`pages` heads after an upsert: a full outer join, the written columns taking over. New pages get the ids of `page_ids`."""
    written = upserts.drop("page_id").join(page_ids(upserts, pages), "page_key")
    new = written.select("page_id", *[F.col(c).alias("_" + c) for c in ("kind", "title", "aliases", "summary", "updated")])
    joined = pages.join(new, "page_id", "full_outer")
    took = [c for c in ("kind", "title", "aliases", "summary", "updated") if c in pages.columns]
    out = joined
    for c in took:
        out = out.withColumn(c, F.coalesce("_" + c, c))
    if "stem" in pages.columns:
        out = out.withColumn("stem", F.coalesce("stem", "title"))
    if "path" in pages.columns:
        out = out.withColumn("path", F.coalesce("path", F.concat("kind", F.lit("/"), "title", F.lit(".md"))))
    return out.select(pages.columns)


# ---------------------------------------------------------------------------------- forget


def forget(pages: DataFrame, sources: DataFrame, titles: DataFrame) -> dict[str, DataFrame]:
    """Remove sources (`titles(title)`) and what they added elsewhere.

    Their rows leave `sources`; a concept or entity left with none goes; the others lose the
    sections of those sources, their summary and its mark. Source notes themselves go too.
    """
    gone = titles.select(F.col("title").alias("source")).distinct()
    kept_sources = sources.join(gone, "source", "left_anti")
    hit = sources.join(gone, "source", "left_semi")
    lost = hit.groupBy("page_id").agg(F.count(F.lit(1)).alias("lost"))
    left = kept_sources.groupBy("page_id").agg(F.count(F.lit(1)).alias("left"))
    marked = pages.join(lost, "page_id", "left").join(left, "page_id", "left")
    orphaned = F.col("kind").isin("concepts", "entities") & F.col("lost").isNotNull() & F.col("left").isNull()
    note = marked.join(gone.withColumnRenamed("source", "title"), "title", "left_semi").filter("kind = 'sources'")
    deleted = marked.filter(orphaned).select("page_id", "title").unionByName(note.select("page_id", "title"))
    stale = marked.filter(F.col("lost").isNotNull() & ~orphaned & (F.col("kind") != "sources"))
    # a body only lists the sources it has sections for: the titles to cut are those of its own
    cut = hit.join(stale.select("page_id"), "page_id", "left_semi")
    own = stale.select("page_id", F.explode(F.array_distinct(T.find_all("body", r"(?m)^## [^\n]*? \[\[([^\n]*)\]\]$", 1))).alias("source"))
    listed = own.join(cut, ["page_id", "source"], "left_semi").groupBy("page_id").agg(F.collect_set("source").alias("cut"))
    body = T.strip(without_summary(without_sections("body", F.coalesce("cut", F.array().cast("array<string>")))))
    updated = stale.join(listed, "page_id", "left").withColumn("body", body)
    if "summary_sources" in pages.columns:
        updated = updated.withColumn("summary_sources", F.lit(None).cast("int"))
    updated = updated.select(pages.columns)
    rest = pages.join(deleted.select("page_id"), "page_id", "left_anti").join(updated.select("page_id"), "page_id", "left_anti")
    sources_left = kept_sources.join(deleted.select("page_id"), "page_id", "left_anti")
    return {"pages": rest.unionByName(updated), "sources": sources_left, "deleted": deleted, "updated": updated}


def rebuild_selection(sources: DataFrame, current_format: int = 2, every: bool = False, words: list[str] | None = None) -> DataFrame:
    """The notes a rebuild works on: those named by a word, or all, or the ones in an older format."""
    if words:
        wanted = F.lit(False)
        for w in words:
            wanted = wanted | T.fold("title").contains(T.fold(F.lit(w)))
        return sources.filter(wanted)
    return sources if every else sources.filter(F.coalesce("format", F.lit(0)) != current_format)


def rebuild_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rebuilt notes keep what the user owns: status, read, content_hash, captured; tags are united."""
    kept = old.select(
        "title", *[F.col(c).alias("_" + c) for c in ("status", "read", "content_hash", "captured", "tags")]
    )
    joined = new.join(kept, "title", "left")
    empty = F.array().cast("array<string>")
    for c in ("status", "read", "content_hash"):
        joined = joined.withColumn(c, F.when(F.col("_tags").isNotNull() | F.col("_status").isNotNull(), F.col("_" + c)).otherwise(F.col(c)))
    joined = joined.withColumn("captured", F.coalesce("_captured", "captured"))
    joined = joined.withColumn("tags", F.sort_array(F.array_union(F.coalesce("_tags", empty), F.coalesce("tags", empty))))
    return joined.select(new.columns)


# ------------------------------------------------------------------------- titles and slugs


def assign_titles(new: DataFrame, pages: DataFrame, suffix: str = "(source)") -> DataFrame:
    """File titles for new sources (doc_id, title, url, seq): never one that means another page.

    A title a concept, entity or synthesis has, or a reserved one, takes the suffix; then ` (2)`,
    ` (3)`... past the source notes that hold the name, unless one of them has the same address.
    """
    names = page_names(pages)
    clash = best_names(names, ("concepts", "entities", "syntheses")).select(F.col("name").alias("_n")).withColumn("_c", F.lit(True))
    based = new.withColumn("_n", T.fold("title")).join(clash, "_n", "left")
    suffixed = F.coalesce("_c", F.lit(False)) | is_reserved("title")
    based = based.withColumn(
        "base", T.safe_title(F.when(suffixed, F.concat("title", F.lit(f" {suffix}"))).otherwise(F.col("title")))
    ).drop("_n", "_c")
    holders = pages.filter(F.col("kind") == "sources").select(F.col("stem").alias("s"), "url")
    number = F.regexp_extract("s", r" \((\d+)\)$", 1)
    held = holders.select(
        T.fold(F.when(number == "", F.col("s")).otherwise(F.regexp_replace("s", r" \(\d+\)$", ""))).alias("base_key"),
        F.when(number == "", F.lit(1)).otherwise(number.cast("int")).alias("n"), "url", "s",
    ).unionByName(holders.select(T.fold("s").alias("base_key"), F.lit(1).alias("n"), "url", "s")).distinct()
    keyed = based.withColumn("base_key", T.fold("base"))
    same = held.filter(F.col("url").isNotNull()).groupBy("base_key", "url").agg(F.min_by("s", "n").alias("own"))
    known = keyed.join(same, ["base_key", "url"], "left")
    highest = held.groupBy("base_key").agg(F.max("n").alias("top"))
    fresh = known.filter(F.col("own").isNull()).join(highest, "base_key", "left")
    placed = ordered_scan(fresh.select("doc_id", "base_key", "base", "top", "seq"), ["seq", "doc_id"], ["base_key"])
    n = F.coalesce("top", F.lit(0)) + F.col("rn")
    titled = placed.select(
        "doc_id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), n.cast("string"), F.lit(")"))).alias("file_title")
    )
    return titled.unionByName(known.filter(F.col("own").isNotNull()).select("doc_id", F.col("own").alias("file_title")))


def assign_slugs(pages: DataFrame) -> DataFrame:
    """A slug per page, unique in its kind: repeats get `-2`, `-3`... in page order.

    Numbering is `ordered_scan`, so one slug most pages share is spread over tasks. A numbered
    slug that meets a natural one moves on past the highest natural number.
    """
    slugged = pages.select("page_id", "kind", "path", T.slugify("title").alias("natural"))
    placed = ordered_scan(slugged, ["path", "page_id"], ["kind", "natural"])
    first = placed.filter("rn = 1").select("page_id", "kind", F.col("natural").alias("slug"))
    again = placed.filter("rn > 1").select(
        "page_id", "kind", "path", "natural", F.concat("natural", F.lit("-"), F.col("rn").cast("string")).alias("slug")
    )
    hit = again.join(first.select("kind", "slug"), ["kind", "slug"], "left_semi").select("kind", "natural").distinct()
    fine = again.join(hit, ["kind", "natural"], "left_anti").select("page_id", "kind", "slug")
    numbered = first.select(
        "kind", F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 1).alias("natural"),
        F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 2).alias("no"),
    )
    top = numbered.filter("no <> ''").groupBy("kind", "natural").agg(F.max(F.col("no").cast("long")).alias("top"))
    bumped = (
        placed.filter("rn > 1").join(hit, ["kind", "natural"], "left_semi").join(top, ["kind", "natural"])
        .select("page_id", "kind", F.concat("natural", F.lit("-"), (F.col("top") + F.col("rn") - 1).cast("string")).alias("slug"))
    )
    return first.unionByName(fine).unionByName(bumped)


# ------------------------------------------------------------------ contradictions and answers


def annotate_contradictions(
    pages: DataFrame, plans: DataFrame, hidden: DataFrame, today: date, label: str = "Possible contradiction"
) -> dict[str, DataFrame]:
    """Callouts to append to contradicted pages, only within one side of the privacy line.

    `plans(source_title, is_private, pos, page, note)`. Returns `callouts` (page_id, source_title,
    pos, text) and `dropped` references.
    """
    found = resolve_refs(plans, page_names(pages), "page")
    secret = hidden.select(F.col("page_id").alias("found_id")).distinct().withColumn("_secret", F.lit(True))
    marked = found.join(secret, "found_id", "left").withColumn("_secret", F.coalesce("_secret", F.lit(False)))
    ok = F.col("found_id").isNotNull() & (F.col("_secret") == F.col("is_private"))
    text = F.concat(
        F.lit(f"> [!warning] {label} ({today.isoformat()}) with [["), "source_title", F.lit("]]: "), T.strip("note")
    )
    return {
        "callouts": marked.filter(ok).select(
            F.col("found_id").alias("page_id"), F.col("found_title").alias("title"), "source_title", "pos", text.alias("text")
        ),
        "dropped": marked.filter(~ok).select("source_title", "pos", "page"),
    }


def question_title(c, max_chars: int = 80) -> Column:
    title = T.safe_title(F.trim(T.as_column(c), F.lit(" ¿?¡!\n\t")), 200)

    def cut(t):
        shorter = F.regexp_replace(F.substring(t, 1, max_chars), r" [^ ]*$", "")
        return F.trim(F.when(F.length(t) > max_chars, shorter).otherwise(t), F.lit(" .,;:"))

    return T.let(title, cut)


def file_answers(answers: DataFrame, pages: DataFrame, today: date, suffix: str = "(synthesis)") -> DataFrame:
    """Grounded answers as synthesis pages. `answers(answer_id, question, title, one_liner, text,
    citations, grounded)`; a taken name gets the suffix, then ` (2)`, ` (3)`..."""
    good = answers.filter("grounded")
    asked = question_title("question")
    base = F.when(asked != "", asked).when(T.safe_title("title") != "", T.safe_title("title")).otherwise("Answer")
    based = good.withColumn("base", base).withColumn("_n", T.fold("base"))
    clash = best_names(page_names(pages)).select(F.col("name").alias("_n")).withColumn("_c", F.lit(True))
    based = based.join(clash, "_n", "left").withColumn(
        "base", F.when(F.coalesce("_c", F.lit(False)), F.concat("base", F.lit(f" {suffix}"))).otherwise(F.col("base"))
    )
    stems = pages.filter(F.col("kind") == "syntheses").select("stem")
    number = F.regexp_extract("stem", r" \((\d+)\)$", 1)
    held = stems.select(
        T.fold(F.regexp_replace("stem", r" \(\d+\)$", "")).alias("key"),
        F.when(number == "", F.lit(1)).otherwise(number.cast("int")).alias("n"),
    ).groupBy("key").agg(F.max("n").alias("top"))
    keyed = based.withColumn("key", T.fold("base")).join(held, "key", "left")
    placed = ordered_scan(keyed.select("answer_id", "key", "base", "top"), ["answer_id"], ["key"])
    n = F.coalesce("top", F.lit(0)) + F.col("rn")
    named = placed.select(
        "answer_id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), n.cast("string"), F.lit(")"))).alias("stem")
    )
    links = F.transform("citations", lambda t: F.concat(F.lit("[["), t, F.lit("]]")))
    body = F.concat(
        F.lit("# "), "stem", F.lit("\n\n> Question: "), "question", F.lit("\n\n"), "text", F.lit("\n\n## Sources\n"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n"),
    )
    return good.join(named, "answer_id").select(
        "answer_id", F.lit("syntheses").alias("kind"), "stem", F.col("stem").alias("title"), "question",
        links.alias("sources"), body.alias("body"), F.col("one_liner").alias("summary"), F.lit(today).alias("updated"),
    )


def due_pages(pages: DataFrame, sources: DataFrame | None = None, manual: bool = False, words: list[str] | None = None) -> DataFrame:
    """Concept and entity pages whose summary is due: three sources, then every two more.

    Counts the `sources` rows of each page, or its `sources` array when no table is given.
    """
    if sources is not None:
        counts = sources.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sources"))
        counted = pages.join(counts, "page_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("long")))
    else:
        counted = pages.withColumn("n_sources", F.size("sources").cast("long"))
    several = counted.filter(F.col("kind").isin("concepts", "entities") & (F.col("n_sources") >= 2))
    if words:
        wanted = F.lit(False)
        for w in words:
            wanted = wanted | T.fold("title").contains(T.fold(F.lit(w)))
        several = several.filter(wanted)
    elif not manual:
        last = F.coalesce("summary_sources", F.lit(0))
        several = several.filter(F.when(last > 0, F.col("n_sources") - last >= 2).otherwise(F.col("n_sources") >= 3))
    return several.select("page_id", "title", "kind", "n_sources")
