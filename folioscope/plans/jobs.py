"""Composite jobs: each takes tables by name and returns tables by name."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import language as LA
from folioscope.functions import text as T
from folioscope.operators import assembly as A
from folioscope.operators import captures as Q
from folioscope.operators import chunks as C
from folioscope.operators import extract as X
from folioscope.operators import grounding as G
from folioscope.operators import ledger as LE
from folioscope.operators import lint as H
from folioscope.operators import model_map as MM
from folioscope.operators import names as N
from folioscope.operators import notes as NO
from folioscope.operators import pages as P
from folioscope.operators import privacy as S
from folioscope.operators import reports as R
from folioscope.operators import rounds as RO
from folioscope.operators import runs as O
from folioscope.operators import search as SE
from folioscope.operators import similar as Z
from folioscope.operators.common import durable, ordered_scan

Tables = dict[str, DataFrame]

NOTES_JSON = """points array<string>, terms array<struct<term:string,definition:string>>, quotes array<string>,
relations array<struct<a:string,relation:string,b:string>>"""


def checked_plans(prompts: DataFrame, plan_fn: Callable, language: str) -> tuple[DataFrame, DataFrame]:
    """Plans of `prompts(doc_id, prompt)`: (plans of `validate_plans`, warnings), each asked for again once with what was wrong.

    A plan that does not hold is asked for again with its errors, one in another language with the fields that are. The second answer
    counts, also in the wrong language, which is then a warning.
    """
    retry = "{prompt}\n\nThis answer was refused ({reason}). Answer again."

    def asked(rows: DataFrame) -> DataFrame:
        return durable(MM.validate_plans(MM.map_model(rows.select("doc_id", "prompt"), plan_fn, attempts=1).select("doc_id", F.col("output").alias("raw_json"))))

    def leaking(plans: DataFrame) -> DataFrame:
        good = plans.filter("valid").select("doc_id", "plan.*")
        fields = {n: F.col(n) for n in ("one_liner", "summary", "abstract")} | {
            "key_points": F.coalesce("key_points", F.array().cast("array<string>")), "concepts": F.transform("concepts", lambda c: c["description"]), "terms": F.transform("terms", lambda t: t["definition"])
        }
        rows = LA.leaking_fields(good, "doc_id", fields, language).groupBy("doc_id")
        return rows.agg(F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("fields"))  # at most one of each name

    first = asked(prompts)
    wrong = first.filter("not valid").select("doc_id", F.array_join("errors", "; ").alias("reason"))
    wrong = durable(wrong.unionByName(leaking(first).select("doc_id", F.concat(F.lit(f"not written in {language}: "), "fields").alias("reason"))))
    said = [F.col("prompt") if w == "{prompt}" else F.col("reason") if w == "{reason}" else F.lit(w) for w in re.split(r"(\{prompt\}|\{reason\})", retry)]
    again = asked(prompts.join(wrong, "doc_id").select("doc_id", F.concat(*said).alias("prompt")))
    plans = durable(first.join(wrong.select("doc_id"), "doc_id", "left_anti").unionByName(again))
    return plans, leaking(again).select("doc_id", F.lit(None).cast("long").alias("seq"), F.concat(F.lit("wrong language: "), "fields").alias("warning"))


def read_long_documents(
    long: DataFrame, notes_fn: Callable | None, merge_fn: Callable | None, *, max_chars: int, max_calls: int | None, fan_in: int, check: Callable | None = None
) -> Tables:
    """Documents too long for one prompt as notes: `notes`, `reduced` (at most `fan_in` a document), `unread`, `coverage`, `used`, `warnings`.

    Chunks are read under the limit of calls, then notes of documents of more than `fan_in` chunks are merged level by level, by
    `merge_fn` while calls are left, else by code.
    """
    spark = long.sparkSession
    chunks = durable(C.split_chunks(long, max_chars).withColumn("seq", F.col("seq").cast("long")))
    schema = "doc_id long, seq long, " + NOTES_JSON.replace("\n", " ")
    warned = spark.createDataFrame([], "doc_id long, seq long, warning string")
    if notes_fn is None:
        none = spark.createDataFrame([], schema)
        used = none.select("doc_id", F.lit(0).cast("long").alias("used"))
        return {"notes": none, "reduced": none, "unread": NO.unread_chunks(chunks, max_calls, fan_in), "coverage": NO.read_coverage(chunks, max_calls, fan_in), "used": used, "warnings": warned}
    read = LE.read_within_budget(chunks, notes_fn, max_calls, fan_in, check)
    parsed = read["answers"].withColumn("n", F.from_json("output", NOTES_JSON)).filter(F.col("n").isNotNull())
    empty = {k: F.coalesce(F.col(f"n.{k}"), F.from_json(F.lit("[]"), parsed.schema["n"].dataType[k].dataType.simpleString())).alias(k) for k in ("points", "terms", "quotes", "relations")}
    in_order = ordered_scan(parsed.select("doc_id", F.col("seq").alias("_chunk"), "half", *empty.values()), ["_chunk", "half"], ["doc_id"])
    notes = durable(in_order.select("doc_id", (F.col("rn") - 1).alias("seq"), "points", "terms", "quotes", "relations"))
    unread = durable(read["unread"])
    many = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fan_in).select("doc_id")
    busy, small = notes.join(many, "doc_id", "left_semi"), notes.join(many, "doc_id", "left_anti")
    warned = read["warnings"].select("doc_id", F.col("seq").cast("long").alias("seq"), "warning")
    used = read["used"]
    if merge_fn is None:
        items = NO.reduce_notes(busy, fan_in, caps=NO.SECTION_CAPS)
    else:
        merged = LE.reduce_within_budget(busy, merge_fn, used, max_calls, fan_in, caps=NO.SECTION_CAPS)
        items, used = merged["items"], merged["used"]
        warned = warned.unionByName(merged["warnings"].select("doc_id", "seq", "warning"))
    reduced = durable(small.unionByName(NO.items_as_notes(items)))
    return {"notes": notes, "reduced": reduced, "unread": unread, "coverage": NO.coverage_of(chunks, unread), "used": durable(used), "warnings": durable(warned)}


def ingest_corpus(
    spark: SparkSession,
    inputs: Tables,
    *,
    plan_fn: Callable,
    notes_fn: Callable | None = None,
    merge_fn: Callable | None = None,
    today: date,
    language: str = "en",
    max_chars: int = 8000,
    max_calls: int | None = None,
    fan_in: int = 16,
    extractor: Callable[[DataFrame], DataFrame] | None = None,
    remote: bool = False,
    flag_contradictions: bool = True,
) -> Tables:
    """Captured documents to a changed wiki.

    `inputs`: `captures(doc_id, target, url, text, kind, title, added_at[, links])`, `pages`, `sources`. The
    model functions are the caller's: `plan_fn(prompts) -> JSON plans`, `notes_fn` -> JSON notes for
    documents longer than `max_chars`, read chunk by chunk, `merge_fn` -> JSON points of merged notes. Every call of a long document
    counts towards `max_calls`; what that leaves is the table `unread`, for a later run. A document is planned from its whole text, or
    from notes that fit whole; else it is in `failed`, with those whose plan was wrong twice. With `remote` models, private documents
    (mail) reach no prompt and are in `failed` too. Every stage is a table; the model stages are written down before they are
    read again, so no call is paid twice.

    `pages_after` and `sources_after` are the wiki with everything in place: heads, bodies with the sections of the new sources and
    callouts of contradictions, and the notes of the sources themselves; `catalogue` lists it. `connections` are pages that a new
    source may be connected to, `follow` the links of a post that its plan chose.
    """
    pages, sources = inputs["pages"], inputs["sources"]
    first = Q.dedup_captures(inputs["captures"], ["added_at", "doc_id"])
    docs = first.transform(extractor) if extractor else X.accept_clip(X.strip_chrome(first))
    docs = docs.withColumn("content_hash", T.content_hash("text"))
    known = Q.known_docs(docs.select("doc_id", "url", "content_hash"), pages.filter("kind = 'sources'"))
    fresh = docs.join(known.filter(F.col("existing_title").isNull()).select("doc_id"), "doc_id", "left_semi")
    every = durable(fresh)
    withheld = every.filter("kind = 'email'") if remote else every.filter(F.lit(False))
    fresh = durable(every.join(withheld.select("doc_id"), "doc_id", "left_anti")) if remote else every

    reading = read_long_documents(fresh.filter(F.length("text") > max_chars), notes_fn, merge_fn, max_chars=max_chars, max_calls=max_calls, fan_in=fan_in)
    packed = NO.pack_notes(reading["reduced"])
    merged = NO.merge_notes(reading["notes"])

    offered = fresh.join(packed.select("doc_id", F.col("text").alias("_notes"), "whole"), "doc_id", "left").withColumn(
        "prompt", T.fence_safe(F.coalesce(F.when(F.col("whole"), F.col("_notes")), F.when(F.length("text") <= max_chars, F.col("text"))))
    )
    prompts = durable(offered.filter(F.col("prompt").isNotNull()).select("doc_id", "prompt"))
    reason = F.when(~F.col("whole"), "notes longer than the budget").when(F.col("prompt").isNull(), "too long, and not read")
    failed = offered.select("doc_id", reason.alias("reason")).filter(F.col("reason").isNotNull()).unionByName(
        withheld.select("doc_id", F.lit("private, and the model is remote").alias("reason"))
    )
    plans, strange = checked_plans(prompts, plan_fn, language)
    failed = failed.unionByName(plans.filter("not valid").select("doc_id", F.concat(F.lit("no valid plan: "), F.array_join("errors", "; ")).alias("reason")))
    warnings = reading["warnings"].unionByName(strange)
    good = durable(plans.filter("valid").select("doc_id", "plan.*").join(fresh.select("doc_id", "url", "kind", "text", F.col("title").alias("doc_title")), "doc_id"))
    texts = fresh.select("doc_id", "text")

    quotes = G.verify_quotes(good.select("doc_id", F.posexplode("quotes").alias("pos", "quote")), texts)
    terms = G.verify_terms(
        good.select("doc_id", F.posexplode("terms").alias("pos", "t")).select("doc_id", "pos", "t.term", "t.definition"), texts, pages, language
    )
    titles = P.assign_titles(
        good.select("doc_id", F.coalesce(F.when(T.safe_title("title") != "", T.safe_title("title")), "doc_title").alias("title"), "url", F.col("doc_id").alias("seq")), pages
    )
    titled = durable(good.join(titles, "doc_id"))
    entities = titled.select("doc_id", "file_title", "kind", F.posexplode("entities").alias("pos", "e")).select(
        "doc_id", "file_title", F.col("kind").alias("doc_kind"), "pos", "e.title", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), "e.description"
    )
    backed = G.verify_entities(entities, texts).filter("supported").withColumn("kind", F.lit("entities")).withColumn("pos", F.col("pos") + 1000)
    concepts = titled.select("doc_id", "file_title", F.col("kind").alias("doc_kind"), F.posexplode("concepts").alias("pos", "e")).select(
        "doc_id", "file_title", "doc_kind", "pos", "e.title", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), "e.description", F.lit("concepts").alias("kind")
    )
    columns = ["doc_id", "file_title", "doc_kind", "pos", "title", "aliases", "description", "kind"]
    edits = concepts.select(columns).unionByName(backed.select(columns)).select(
        F.col("doc_id").alias("seq"), "pos", "kind", "title", "aliases", "description", F.col("file_title").alias("source_title"), (F.col("doc_kind") == "email").alias("is_private")
    )
    upsert = P.merge_concepts(pages, sources, edits, S.private_sources(pages), today)
    upsert = {k: durable(v) for k, v in upsert.items()}
    names = edits.select(F.col("seq").alias("doc_id"), F.explode(F.concat(F.array("title"), "aliases")).alias("name"))
    relations = G.verify_relations(
        good.select("doc_id", F.posexplode("relations").alias("pos", "r")).select("doc_id", "pos", "r.a", "r.relation", "r.b"), names, texts
    )
    notes_out = durable(titled.select(
        "doc_id", F.col("file_title").alias("title"), "url", F.col("kind").alias("doc_kind"), T.one_line("one_liner").alias("summary"),
        P.model_text("summary").alias("executive_summary"), P.model_text(T.complete("abstract")).alias("abstract"), "tags",
        T.content_hash("text").alias("content_hash"), F.lit(today).alias("processed"),
    ))
    after = apply_batch(pages, sources, upsert, notes_out, titled if flag_contradictions else titled.filter(F.lit(False)), today)
    asked = titled.select(
        F.col("doc_id").alias("query_id"), F.col("file_title").alias("title"), "summary", F.transform("concepts", lambda c: c["title"]).alias("concepts"), F.transform("terms", lambda t: t["term"]).alias("terms")
    )
    index = durable(SE.postings(pages))
    connections = SE.connection_candidates(asked, index, pages, sources, SE.corpus_size(pages))
    chosen = titled.select("doc_id", F.coalesce("follow", F.array().cast("array<string>")).alias("follow"))
    links = every.select("doc_id", (F.col("links") if "links" in every.columns else F.array().cast("array<string>")).alias("links"))
    return {
        "known": known.filter(F.col("existing_title").isNotNull()), "coverage": reading["coverage"], "unread": reading["unread"], "calls": reading["used"], "failed": failed,
        "warnings": warnings, "merged_notes": merged, "plans": plans, "notes": notes_out, "quotes": quotes, "terms": terms, "relations": relations,
        "graph": G.concept_graph(relations.filter("verdict = 'kept'").drop("verdict")), "connections": connections, "follow": MM.links_to_follow(chosen, links), **upsert, **after,
    }


def apply_batch(pages: DataFrame, sources: DataFrame, upsert: Tables, notes: DataFrame, contradicting: DataFrame, today: date) -> Tables:
    """The wiki after a batch: `pages_after`, `sources_after`, `callouts`, `dropped_references`, `catalogue`, `catalogue_counts`.

    Contradictions refer to the pages of before and of this batch, and stay on their side of the privacy line.
    """
    ids = durable(P.page_ids(upsert["upserts"], pages))
    heads = durable(P.apply_upserts(pages, upsert["upserts"]))
    rows = sources.unionByName(upsert["sources"].join(ids, "page_key").select("page_id", "source").select(*sources.columns)).distinct()
    said = contradicting.select(
        F.col("doc_id").alias("seq"), F.col("file_title").alias("source_title"), (F.col("kind") == "email").alias("is_private"), F.posexplode("contradictions").alias("pos", "c")
    ).select("seq", "source_title", "is_private", "pos", "c.page", "c.note")
    coming = contradicting.filter("kind = 'email'").select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.col("file_title").alias("title"))
    private = S.private_sources(heads).unionByName(coming)
    found = P.annotate_contradictions(heads, said.drop("seq"), S.hidden_pages(heads, rows, private), today)
    order = contradicting.select(F.col("file_title").alias("source_title"), F.col("doc_id").alias("seq"))
    callouts = durable(found["callouts"].join(order, "source_title"))
    sections = upsert["sections"].join(ids, "page_key").select("page_id", "seq", "pos", "source", "text")
    bodies = A.assemble(heads.select("page_id", "title", "body"), sections, callouts.select("page_id", "seq", "pos", "text"))
    written = A.with_bodies(heads, bodies)
    page_id = F.abs(F.xxhash64(F.concat(F.lit("source:"), F.col("title")))).cast(pages.schema["page_id"].dataType)
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("> "), "url"), F.concat(F.lit("## Summary\n"), "executive_summary"), F.when(F.col("abstract") != "", F.concat(F.lit("## Abstract\n"), "abstract")))
    made = {
        "page_id": page_id, "path": F.concat(F.lit("sources/"), "title", F.lit(".md")), "stem": F.col("title"), "kind": F.lit("sources"), "aliases": F.array().cast("array<string>"), "status": F.lit("processed"),
        "sources": F.array().cast("array<string>"), "body": text,
    }
    columns = {f.name: f.dataType for f in pages.schema.fields}
    new = notes.select(*[(made[c] if c in made else F.col(c) if c in notes.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    pages_after = durable(written.join(new.select("path"), "path", "left_anti").select(*columns).unionByName(new))
    listed, counts = R.catalogue(pages_after)
    return {"pages_after": pages_after, "sources_after": rows, "callouts": callouts, "dropped_references": found["dropped"], "catalogue": listed, "catalogue_counts": counts}


def ask_batch(
    spark: SparkSession, inputs: Tables, *, answer_fn: Callable, language: str = "en", k: int = 6, budget: int = 1800, remote: bool = False,
    tokens: Callable[[str, str], int] | None = None, clock: Callable[[], float] | None = None,
) -> Tables:
    """Questions to verified answers. `inputs`: `questions(query_id, question[, extra])`, `pages`,
    `sources`; `answer_fn(prompts) -> JSON {title, one_liner, answer, cited_pages}`.

    `calls` has the tries and tokens of each question, with a `clock` also its seconds. A question without pages, or whose answer is none, is a row of `refused` with the reason. With a `remote` model, hidden pages are never retrieved, shown or cited, and pages that private
    sources touched lose those sections.
    """
    pages = inputs["pages"]
    private = S.private_sources(pages)
    hidden = S.hidden_pages(pages, inputs["sources"], private)
    shown = pages
    if remote:
        public = S.public_body(pages, private).select("page_id", F.col("body").alias("_public"))
        shown = pages.join(hidden.select("page_id"), "page_id", "left_anti").join(public, "page_id", "left").withColumn("body", F.coalesce("_public", "body")).drop("_public")
    asked = SE.query_terms(inputs["questions"], extra="extra" if "extra" in inputs["questions"].columns else None)
    found = durable(SE.bm25(asked, None, k, pages=shown).select("query_id", "page_id", "rank"))
    context = shown.select("page_id", "title", C.page_context("body", budget).alias("context"))
    blocks = found.join(context, "page_id").groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title", "context"))), lambda x: F.concat(F.lit("<page title=\""), x["title"], F.lit("\">\n"), T.fence_safe(x["context"]), F.lit("\n</page>"))), "\n").alias("user")
    )  # at most k short texts per question
    prompts = inputs["questions"].join(blocks, "query_id").withColumn("prompt", F.concat("user", F.lit("\n\n"), T.fence_safe("question")))
    answered = durable(MM.map_model(prompts.select("query_id", "question", "user", "prompt"), answer_fn, tokens=tokens, clock=clock))
    calls = answered.select("query_id", "status", "tries", "tokens", *(["seconds"] if clock else []))
    schema = "title string, one_liner string, answer string, cited_pages array<string>"
    read = answered.withColumn("a", F.from_json("output", schema))
    parsed = read.filter(F.length("a.answer") >= 20)
    why = F.when(F.col("output").isNull(), F.col("status")).when(F.col("a.answer").isNull(), "no answer in it").otherwise("answer too short")
    lost = inputs["questions"].join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("nothing found").alias("reason"))
    refused = lost.unionByName(read.filter(~F.coalesce(F.length("a.answer") >= 20, F.lit(False))).select("query_id", why.alias("reason")))
    answers = parsed.select(F.col("query_id").alias("answer_id"), "question", "user", "a.title", "a.one_liner", F.col("a.answer").alias("text"), F.coalesce("a.cited_pages", F.array().cast("array<string>")).alias("cited_pages"))
    clean = MM.scrub(answers.withColumnRenamed("answer_id", "row_id"), N.page_names(shown), hidden if remote else None, "text", "user").withColumnRenamed("row_id", "answer_id")
    clean = durable(clean)
    evidence = found.select(F.col("query_id").alias("answer_id"), "page_id")
    verdict = G.answer_verdict(clean, shown, evidence, hidden if remote else None, language)
    cited = G.citations(clean, N.page_names(shown), hidden if remote else None)
    return {"retrieved": found, "answers": clean.join(verdict, "answer_id"), "citations": cited, "refused": refused, "calls": calls}


def lint_corpus(spark: SparkSession, inputs: Tables, *, shown: int = 50) -> Tables:
    """All findings, the first of each kind, and how many more there are."""
    links = inputs.get("links", N.page_links(inputs["pages"]))
    findings = durable(H.lint(inputs["pages"], links))
    first, more = H.lint_report(findings, shown)
    return {"findings": findings, "shown": first, "totals": more}


def daily_report(spark: SparkSession, inputs: Tables, *, today: date) -> Tables:
    """The tables a daily note is written from. `inputs`: pages, links, queue, daily, runs."""
    pages = inputs["pages"]
    synced = R.sync_read_state(pages, inputs["daily"], today)
    state = synced.select("page_id", F.col("status").alias("_s"), F.col("read").alias("_r"))
    current = durable(
        pages.join(state, "page_id", "left").withColumn("status", F.coalesce("_s", "status"))
        .withColumn("read", F.when(F.col("_s").isNotNull(), F.col("_r")).otherwise(F.col("read"))).drop("_s", "_r")
    )
    sources = current.filter("kind = 'sources'")
    first, total = Q.queue_preview(inputs["queue"], sources)
    return {
        "pages": current, "read": R.read_on(current, today), "processed": R.read_on(current, today, "processed"),
        "queue": first, "queue_total": total, "revisit": R.revisit(current, today),
        "stats": R.daily_stats(current, inputs["links"], today), "runs": O.runs_report(inputs["runs"]).filter(F.col("day") == F.lit(today)),
        "home": R.home_counts(current, inputs["queue"]),
    }


def evaluate_retrieval(spark: SparkSession, inputs: Tables, *, k: int = 6) -> Tables:
    """`inputs`: golden(query_id, question, expect), pages."""
    pages = inputs["pages"]
    asked = SE.query_terms(inputs["golden"])
    found = SE.bm25(asked, None, k, pages=pages)
    titled = found.join(pages.select("page_id", "title"), "page_id").select("query_id", "title", "rank")
    cases, totals = SE.evaluate(inputs["golden"], titled, k)
    return {"cases": cases, "totals": totals}


def _steady(fn: Callable) -> Callable:
    """A model that breaks is a trial that failed, not a job that did."""

    def call(prompts: list[str]) -> list[str]:
        try:
            return fn(prompts)
        except Exception as error:
            raise MM.ModelTimeout(str(error)) from error

    return call


def _said(prompt: str, answer: str) -> int:
    return (len(prompt) + len(answer)) // 4


def ask_trials(spark: SparkSession, inputs: Tables, model: str, fn: Callable, language: str, clock: Callable[[], float]) -> DataFrame:
    """One trial per question of `golden(query_id, question, expect)`: it holds if the answer is grounded, and is the better if it cites a page
    that was expected (by title, folded)."""
    golden = inputs["golden"]
    asked = {"questions": golden.select("query_id", "question"), "pages": inputs["pages"], "sources": inputs.get("sources", N.page_sources(inputs["pages"]))}
    done = ask_batch(spark, asked, answer_fn=_steady(fn), language=language, tokens=_said, clock=clock)
    wanted = golden.select(F.col("query_id").alias("answer_id"), F.explode("expect").alias("t")).select("answer_id", T.fold("t").alias("t")).distinct()
    cited = done["citations"].select("answer_id", T.fold("title").alias("t")).join(wanted, ["answer_id", "t"], "left_semi").select("answer_id").distinct()
    judged = done["answers"].select("answer_id", "grounded").join(cited.withColumn("cites_expected", F.lit(True)), "answer_id", "left").withColumnRenamed("answer_id", "query_id")
    rows = golden.select("query_id").join(done["calls"], "query_id", "left").join(judged, "query_id", "left")
    ok = F.coalesce("grounded", F.lit(False))
    return rows.select(
        F.lit(model).alias("model"), F.lit("ask").alias("task"), ok.alias("ok"), (ok & (F.col("tries") == 1)).alias("first_try"),
        F.coalesce("seconds", F.lit(0.0)).alias("latency_seconds"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), F.lit(False).alias("in_language"),
        F.lit(0).cast("long").alias("concepts"), F.coalesce("cites_expected", F.lit(False)).alias("cites_expected"),
    )


def compare_models(
    spark: SparkSession, inputs: Tables, *, models: dict[str, Callable], n: int = 10, language: str = "en", ask: dict[str, Callable] | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> Tables:
    """Plans of several models for the same evenly spaced sources, and with `ask` their answers to the same questions. `inputs`: docs(doc_id,
    text, kind), pages, prices, for `ask` also golden(query_id, question, expect) and, if there is one, sources. Returns trials with the
    seconds each took by `clock`, their summary and the routing they suggest."""
    docs = durable(O.benchmark_sources(inputs["docs"], n, ["doc_id"]))
    trials = None
    for model, fn in models.items():  # one pass per model under test
        answered = durable(MM.map_model(docs.select("doc_id", T.fence_safe("text").alias("prompt")), _steady(fn), tokens=_said, clock=clock))
        plans = durable(MM.validate_plans(answered.select("doc_id", F.col("output").alias("raw_json"))))
        metrics = O.plan_metrics(plans.filter("valid").select("doc_id", "plan.*"), N.page_names(inputs["pages"]), language)
        rows = answered.join(plans.select("doc_id", "valid"), "doc_id").join(metrics, "doc_id", "left").select(
            F.lit(model).alias("model"), F.lit("ingest").alias("task"), F.col("valid").alias("ok"), (F.col("valid") & (F.col("tries") == 1)).alias("first_try"),
            F.col("seconds").alias("latency_seconds"), "tokens", F.coalesce("in_language", F.lit(False)).alias("in_language"),
            F.coalesce("concepts", F.lit(0).cast("long")).alias("concepts"), F.lit(False).alias("cites_expected"),
        )
        trials = rows if trials is None else trials.unionByName(rows)
    for model, fn in (ask or {}).items():
        rows = durable(ask_trials(spark, inputs, model, fn, language, clock))
        trials = rows if trials is None else trials.unionByName(rows)
    summary = O.summarize_trials(trials, inputs["prices"])
    return {"trials": trials, "summary": summary, "routing": O.suggest_routing(summary)}


def consolidate(
    spark: SparkSession, inputs: Tables, *, summary_fn: Callable, language: str = "en", heading: str = "Summary", manual: bool = False, remote: bool = False,
    attempts: int = 2,
) -> Tables:
    """Summaries of the concept pages that are due. `inputs`: pages, sources. A summary that fails the checks against its page is asked for
    again with the problems, up to `attempts` times; then it goes to `reviews`. The others are put into their page. `attempts` lists
    every answer with its problems. Due pages without sections or an
    answer are in `skipped`, and with a `remote` model also those that private sources touched."""
    pages = inputs["pages"]
    wanted = durable(P.due_pages(pages, inputs["sources"], manual))
    touched = S.touched_pages(pages, inputs["sources"], S.private_sources(pages)) if remote else wanted.filter(F.lit(False))
    withheld = wanted.join(touched.select("page_id").distinct(), "page_id", "left_semi")
    due = wanted.join(withheld.select("page_id"), "page_id", "left_anti")
    mine = pages.join(due.select("page_id", "n_sources"), "page_id")
    shown = C.page_sections(mine).groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source", "shown"))), lambda s: F.concat(s["source"], F.lit(": "), T.fence_safe(s["shown"]))), "\n").alias("prompt"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("_evidence"),
    )  # at most twelve sections a page
    named = mine.select("page_id", "title", "aliases", "n_sources").join(shown, "page_id")
    evidence = durable(named.select("page_id", F.concat_ws("\n", F.concat_ws(", ", "title", F.array_join("aliases", ", ")), "_evidence").alias("text")))
    last, tried = RO.sound_summaries(shown.select("page_id", "prompt"), RO.by_model(summary_fn), evidence, language, attempts)
    answered = last.join(mine.select("page_id", "n_sources"), "page_id").withColumnRenamed("output", "summary")
    judged = answered.filter("status <> 'unanswered'").select("page_id", "summary", "n_sources", "problems", F.col("attempt").alias("tries"))
    passed = judged.filter(F.size("problems") == 0)
    written = mine.drop("n_sources").join(passed.select("page_id", F.col("summary").alias("_s"), F.col("n_sources").cast("int").alias("_n")), "page_id")
    updated = written.withColumn("body", C.put_section("body", heading, F.col("_s"))).withColumn("summary_sources", F.col("_n")).drop("_s", "_n")
    unanswered = answered.filter("status = 'unanswered'").select("page_id", F.when(F.col("error") == "timed out", "timeout").otherwise("no answer").alias("reason"))
    skipped = due.join(shown.select("page_id"), "page_id", "left_anti").select("page_id", F.lit("no sections").alias("reason")).unionByName(unanswered)
    skipped = skipped.unionByName(withheld.select("page_id", F.lit("private, and the model is remote").alias("reason")))
    return {"due": due, "updated": updated, "skipped": skipped, "reviews": judged.filter(F.size("problems") > 0), "attempts": tried, "merge_suggestions": Z.merge_suggestions(pages, due)}


def rebuild(spark: SparkSession, inputs: Tables, *, every: bool = False, words: list[str] | None = None, **ingest_options) -> Tables:
    """Selected notes ingested again from their saved text; what the user owns is kept.

    `inputs`: pages, sources, raw(title, doc_id, target, url, text, kind, added_at). An old note is
    forgotten only where its new plan is valid: the others stay as they are and are listed in `kept`.
    The new notes keep their title, so that links to them hold, and status, read date, captured date
    and tags.
    """
    pages, sources = inputs["pages"], inputs["sources"]
    chosen = durable(P.rebuild_selection(pages.filter("kind = 'sources'"), every=every, words=words))
    cleared = P.forget(pages, sources, chosen.select("title"))
    captures = inputs["raw"].join(chosen.select("title"), "title", "left_semi")
    left = {"pages": durable(cleared["pages"]), "sources": durable(cleared["sources"]), "captures": captures}
    done = ingest_corpus(spark, left, **ingest_options)
    titles = inputs["raw"].select("doc_id", F.col("title").alias("_title"))
    new = durable(done["notes"].join(titles, "doc_id").withColumn("title", F.col("_title")).drop("_title"))
    replaced = new.select("title").distinct()
    after = P.forget(pages, sources, replaced)
    merged = P.rebuild_merge(_with_user_fields(pages.filter("kind = 'sources'")), _with_user_fields(new))
    kept = chosen.select("title").join(replaced, "title", "left_anti")
    return {**done, "notes": merged, "chosen": chosen, "kept": kept, "pages_left": durable(after["pages"]), "sources_left": durable(after["sources"])}


def _with_user_fields(notes: DataFrame) -> DataFrame:
    """`notes` with the columns that belong to the user, null where they are missing."""
    types = {"status": "string", "read": "date", "content_hash": "string", "captured": "date", "tags": "array<string>"}
    return notes.select("*", *[F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in notes.columns])


JOBS = {f.__name__: f for f in (ingest_corpus, ask_batch, lint_corpus, daily_report, evaluate_retrieval, compare_models, consolidate, rebuild)}

