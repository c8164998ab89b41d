import json
from datetime import date

import pytest
from conftest import page
from pyspark.sql import functions as F

from folioscope.operators import captures as Q
from folioscope.operators import chunks as C
from folioscope.operators import extract as X
from folioscope.operators import grounding as G
from folioscope.operators import layout as Y
from folioscope.operators import mail as M
from folioscope.operators import model_map as MM
from folioscope.operators import names as N
from folioscope.operators import notes as NO
from folioscope.operators import runs as O
from folioscope.operators import search as S
from folioscope.operators.common import ordered_scan
from folioscope.plans import jobs
from folioscope.sources import files as FS
from folioscope.streaming import jobs as J

TODAY = date(2024, 5, 1)


def test_ordered_scan_spreads_one_big_group(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("g"), (1000 - F.col("id")).alias("k"), F.lit(2).cast("long").alias("v"))
    got = ordered_scan(rows.repartition(7), ["k"], ["g"], {"before": "v"})
    assert all(r.rn == r.k and r.before == 2 * (r.k - 1) for r in got.collect())


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\n" + "c" * 25 + "\n\ndd")], "doc_id long, text string")
    got = [r.chunk for r in C.split_chunks(docs, 10).orderBy("seq").collect()]
    assert got == ["aaaa\n\nbbbb", "c" * 10, "c" * 10, "ccccc\n\ndd"]


def test_references_are_cut_only_at_the_end(value):
    body = "x" * 100
    assert value(C.cut_references, body + "\n## References\n[1] a") == body
    early = "a\nReferences\n" + body
    assert value(C.cut_references, early) == early


def test_page_context_reads_its_page_once(spark):
    """A costly body is worked out and split once, and each heading is folded once for all the labels it may be."""
    rows = spark.createDataFrame([("# T",)], "b string").select(C.page_context(F.concat(F.lit("x"), F.reverse("b")), 60).alias("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1 and plan.count("split(") == 1


def test_page_context_takes_whole_sections(value):
    body = "# T\n\n## Notes\nlong " + "x" * 50 + "\n\n## Key terms\nfoo\n\n## From [[s]]\nbar"
    assert value(lambda c: C.page_context(c, 60), body) == "# T\n\n## Key terms\nfoo\n\n## From [[s]]\nbar"
    assert value(lambda c: C.page_context(c, 5), "plain text") == "plain"


@pytest.mark.parametrize(
    "url, text, kept, removed",
    [
        ("https://github.com/a/b", "Skip to content\nReal text.\n## Languages\nPython 97.1%\nC 2%\nMore text here.", "Real text.\nMore text here.", 4),
        ("https://github.com/a/b", "[Issues](/i) | [Wiki](https://github.com/w)\nThe issues [Issues](https://else.org) stay.", "The issues [Issues](https://else.org) stay.", 1),
        ("https://github.com/a/b", "```\nSkip to content\n```\nx", "```\nSkip to content\n```\nx", 0),
        ("https://github.com/a/b", "He said sign in please.", "He said sign in please.", 0),
        ("https://m.youtube.com/x", "Talk.\nUp next\nA video\n\n" + "p" * 200, "Talk.\n\n" + "p" * 200, 2),
        ("https://example.org/", "Skip to content\nx", "Skip to content\nx", 0),
        (None, "Text.\nSort by: best\nReddit, Inc. © 2024", "Text.", 2),
        ("mail:1", "Skip navigation\nx", "Skip navigation\nx", 0),
        ("https://reddit.com/r", "Related posts\nA post\nAnother\n# Head\nBody", "# Head\nBody", 3),
        ("https://linkedin.com/p", "Languages\nEnglish\nLike Comment Share\n12 reactions", "Languages\nEnglish", 2),
    ],
)
def test_chrome(spark, url, text, kept, removed):
    docs = spark.createDataFrame([(1, url, text)], "doc_id long, url string, text string")
    row = X.strip_chrome(docs).first()
    assert (row.text, row.stripped_lines) == (kept, removed)


def test_post_without_its_comments(spark):
    html = '<script type="application/ld+json">' + json.dumps(
        {"@type": "SocialMediaPosting", "articleBody": "Hello https://a.b/c.", "author": {"name": "Ann"}, "comment": [{"text": "spam"}]}
    ) + "</script>"
    row = X.extract_posts(spark.createDataFrame([(1, "https://l/p", html)], "page_id long, url string, html string")).first()
    assert row.title == "Ann on LinkedIn: Hello https://a.b/c." and row.text.startswith("By Ann") and "spam" not in row.text and row.links == ["https://a.b/c"]


LEDGER = "target_norm string, ts timestamp, seq long, event string"


@pytest.mark.parametrize(
    "events, status, attempts",
    [
        (["fail"] * 3, "failed", 3), (["claim", "recover"], "queued", 1), (["claim", "release"], "queued", 0), (["recover"], "queued", 0),
        (["fail", "fail", "fail", "reset"], "queued", 0), (["claim", "done"], "done", 0), (["claim", "done", "claim"], "done", 0),
    ],
)
def test_retry_ledger(spark, events, status, attempts):
    rows = [("t", None, i, e) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, LEDGER).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    row = Q.queue_state(df, piece=2).first()
    assert (row.status, row.attempts) == (status, attempts)


def test_dropped_items_are_gone(spark):
    df = spark.createDataFrame([("t", None, 0, "fail"), ("t", None, 1, "drop")], LEDGER).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    assert Q.queue_state(df).count() == 0


def test_retrieval_scores_and_evaluation(spark, wiki):
    pages = wiki(page(1, "Graph", body="nodes and edges graph"), page(2, "Cooking", body="pasta with tomato"), page(3, "Music", body="guitar and piano"))
    golden = spark.createDataFrame([(1, "what is a graph", ["Graph"]), (2, "pasta recipe", ["cook"]), (3, "violin", ["Music"])], "query_id long, question string, expect array<string>")
    done = jobs.evaluate_retrieval(spark, {"golden": golden, "pages": pages}, k=3)
    totals = done["totals"].first()
    assert totals.cases == 3 and abs(totals.recall - 2 / 3) < 1e-9 and abs(totals.mrr - 2 / 3) < 1e-9


def test_fusion_prefers_the_keyword_list_on_ties(spark):
    schema = "query_id long, page_id long, rank long"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], schema)
    assert [r.page_id for r in S.rrf(a, b).orderBy("rank").collect()] == [11, 10, 12]


def test_only_new_pages_are_embedded(spark, wiki):
    pages = wiki(page(1, "A", body="intro\n## One\nx"), page(2, "B", body="y"))
    fake = lambda texts: [[float(len(t)), 1.0] for t in texts]
    none = spark.createDataFrame([], S.VECTORS)
    first = S.embed_pending(pages, none, fake, "m1")
    assert first.count() == 3
    stored = spark.createDataFrame(first.collect(), S.VECTORS)
    assert S.embed_pending(pages, stored, fake, "m1").count() == 0
    assert S.embed_pending(pages, stored, fake, "m2").count() == 3
    hidden = pages.filter("page_id = 1")
    remote = S.embed_pending(pages, none, fake, "m3", True, hidden).collect()
    assert sorted((r.page_id, r.chunk) for r in remote) == [(1, -1), (2, 0)]


def test_answer_support(spark):
    schema = "answer_id long, text string"
    answers = spark.createDataFrame(
        [(1, "It beat Marvin."), (2, "It grew by 1,200 units."), (3, "The unusual method works."), (4, "Totally strange sentences appear nowhere.")], schema
    )
    pages = spark.createDataFrame([(7, "the method grew 1200 units and it works")], "page_id long, text string")
    evidence = answers.select("answer_id", F.lit(7).cast("long").alias("page_id"))
    got = {r.answer_id: r.unsupported for r in G.check_support(answers, evidence, pages).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_summary_checks(spark):
    evidence = spark.createDataFrame([(i, "Anna found 42 graphs in the old library of Madrid. The graphs are good.") for i in range(1, 5)], "page_id long, text string")
    pad = "The graphs that were found in the library are good and old, and so on and on and on."
    rows = [(1, pad), (2, pad + " Bob saw 43."), (3, "short"), (4, pad + ' He said "never ever this" [[x]].')]
    got = {r.page_id: r.problems for r in G.summary_problems(spark.createDataFrame(rows, "page_id long, summary string"), evidence).collect()}
    assert got[1] == [] and got[2] == ["unknown: 43"] and got[3][0] == "length: 5" and len(got[4]) == 2


def test_merge_and_reduce_notes(spark):
    none = "array<struct<term:string,definition:string>>"
    rel = "array<struct<a:string,relation:string,b:string>>"
    rows = [(1, i, [f"p{i}", "Same"], [], [], []) for i in range(11)]
    notes = spark.createDataFrame(rows, f"doc_id long, seq long, points array<string>, terms {none}, quotes array<string>, relations {rel}")
    level = NO.reduce_notes(notes, fan_in=3).filter("field = 'points'").orderBy("seq", "rank").collect()
    assert [r.a for r in level if r.seq == 0] == ["p0", "p1", "p2", "p3", "p4", "Same"]
    assert [r.a for r in level if r.seq == 2] == ["p10", "Same"]
    assert NO.merge_calls(17, 16) == 4 and NO.merge_calls(16, 16) == 0


def test_plans_are_clamped_and_repaired(spark):
    edit = {"title": "Graph", "aliases": [], "description": "Nodes joined by edges."}
    good = {"title": "A title", "one_liner": "https://x.org", "summary": "This is what the source says in a whole sentence. More.", "key_points": ["k"] * 20, "concepts": [edit] * 9}
    bad = {**good, "concepts": []}
    raw = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "nonsense")], "doc_id long, raw_json string")
    got = {r.doc_id: r for r in MM.validate_plans(raw).collect()}
    assert got[1].valid and got[1].repaired and got[1].plan.one_liner == "This is what the source says in a whole sentence."
    assert len(got[1].plan.key_points) == 8 and len(got[1].plan.concepts) == 6
    assert not got[2].valid and "concepts: at least one" in got[2].errors
    assert not got[3].valid and "invalid JSON" in got[3].errors


def test_a_plan_derives_its_one_liner_once(spark):
    raw = spark.createDataFrame([(1, "{}")], "doc_id long, raw_json string")
    plan = MM.validate_plans(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_model_text_is_scrubbed(spark, wiki):
    pages = wiki(page(1, "Open"), page(2, "Secret"))
    text = "See [ok](https://a.b/c) [no](https://evil/x) www.evil.com. [[Open|it]] [[Secret]] [[Gone|words]] <b>"
    rows = spark.createDataFrame([(1, text, "known https://a.b/c")], "row_id long, text string, known string")
    row = MM.scrub(rows, N.page_names(pages), pages.filter("page_id = 2")).first()
    assert row.text == "See [ok](https://a.b/c) no  [[Open|it]] Secret words &lt;b>" and row.cut == 2


def test_unreadable_chunks_are_read_as_halves(spark):
    chunks = spark.createDataFrame([(1, 0, "good " * 60), (1, 1, "bad " * 100), (2, 0, "bad")], "doc_id long, seq int, chunk string")
    fn = lambda prompts: ["no" if len(p) > 350 or p.startswith("bad\n") or p == "bad" else "yes" for p in prompts]
    answers, warnings = MM.read_chunks(chunks, fn, check=lambda a: "" if a == "yes" else "invalid")
    assert sorted((r.doc_id, r.seq, r.half) for r in answers.collect()) == [(1, 0, -1), (1, 1, 0), (1, 1, 1)]
    assert [(r.doc_id, r.warning.split(":")[0]) for r in warnings.collect()] == [(2, "skipped")]


def test_mail(spark):
    att = "array<struct<name:string,declared:string,format:string,width:int,height:int,bytes:long>>"
    images = [("a", "image/png", "PNG", 300, 300, 5_000_000), ("b", "image/png", "PNG", 300, 300, 5_000_000), ("c", "image/png", "GIF", 300, 300, 9_000),
              ("d", "image/png", "PNG", 300, 300, 4_990_000), ("e", "image/png", "PNG", 300, 300, 20_000), ("f", "image/png", "PNG", 100, 300, 9_000), ("g", "image/png", "PNG", 300, 300, 9_000)]
    mail = spark.createDataFrame([(1, images)], f"uid long, attachments {att}")
    assert [r.name for r in M.keep_images(mail).orderBy("pos").collect()] == ["a", "b", "d", "g"]
    rows = spark.createDataFrame([(2, "<a@b>", "x"), (1, "<a@b>", "y"), (3, None, "z"), (4, "<k>", "k")], "uid long, message_id string, raw string")
    known = spark.createDataFrame([("mail:k",)], "source string")
    assert sorted(r.uid for r in M.dedup_mail(rows, known).collect()) == [1, 3]


def test_layout(spark):
    schema = "doc_id long, page int, line_no int, text string, size double, bold boolean, left double, right double, baseline double, page_height double, hyphen boolean"
    lines, n = [], 0

    def add(p, text, y, size=10.0, bold=False, hyphen=False, left=50.0):
        nonlocal n
        lines.append((1, p, n, text, size, bold, left, left + 5.0 * len(text), y, 800.0, hyphen))
        n += 1

    for p in (1, 2, 3):
        add(p, f"Journal of Things {p}", 780.0)
        add(p, "1 Introduction" if p == 1 else f"{p} Part", 700.0, size=14.0)
        add(p, "The approach is an ap", 680.0, hyphen=True)
        add(p, "plicative method that uses feed", 666.0, hyphen=True)
        add(p, "forward networks and feed the forward application.", 652.0)
        add(p, "A 1.0 2.0 3.0", 620.0)
        add(p, "B 4.0 5.0 6.0", 606.0)
        add(p, str(p), 20.0)
    df = spark.createDataFrame(lines, schema)
    assert Y.drop_repeated_lines(df).count() == len(lines) - 6
    blocks = [(r.kind, r.text) for r in Y.document_text(df).orderBy("block").collect()]
    assert blocks[0] == ("heading", "## 1 Introduction")
    assert blocks[1] == ("text", "The approach is an applicative method that uses feed-forward networks and feed the forward application.")
    assert blocks[2] == ("rows", "A 1.0 2.0 3.0\nB 4.0 5.0 6.0")


def test_trials(spark):
    trials = spark.createDataFrame(
        [("m", "ingest", True, True, s, 2000, True, 2, False) for s in (4.0, 6.0, 100.0)] + [("bad", "ingest", False, False, 1.0, 1, False, 0, False)],
        "model string, task string, ok boolean, first_try boolean, latency_seconds double, tokens long, in_language boolean, concepts int, cites_expected boolean",
    )
    prices = spark.createDataFrame([("m", 3.0)], "model string, usd_per_million double")
    summary = O.summarize_trials(trials, prices)
    row = summary.filter("model = 'm'").first()
    assert row.median_latency_seconds == 6.0 and abs(row.cost_usd - 0.018) < 1e-12
    assert {r.task: r.model for r in O.suggest_routing(summary).collect()} == {"ingest": "m", "ask": None}


def test_pages_and_jsonl_from_files(spark, tmp_path):
    folder = tmp_path / "wiki" / "concepts"
    folder.mkdir(parents=True)
    (folder / "Graph.md").write_text("---\ntitle: \"A: graph\"\naliases: [Grafo, 'G, h']\nsources:\n- '[[a]]'\n- '[[b]]'\nupdated: 2024-01-02\n---\n\n# Graph\nbody\n")
    (folder / "Plain.md").write_text("no head")
    got = {r.stem: r for r in FS.read_pages(spark, str(tmp_path / "wiki")).collect()}
    assert got["Graph"].title == "A: graph" and got["Graph"].aliases == ["Grafo", "G, h"] and got["Graph"].sources == ["[[a]]", "[[b]]"]
    assert got["Graph"].body == "# Graph\nbody" and got["Graph"].updated == date(2024, 1, 2) and got["Plain"].title == "Plain"
    now = FS.file_manifest(spark, str(tmp_path / "wiki"))
    assert FS.changed_pages(now, now).count() == 0 and FS.changed_pages(now.limit(0), now).count() == 2
    (tmp_path / "g.jsonl").write_text('{"question": "q", "expect": ["a"]}\n{"question": \n')
    with pytest.raises(ValueError, match="bad line"):
        FS.read_golden(spark, str(tmp_path / "g.jsonl"))


def test_index_follows_changed_pages(spark, tmp_path):
    schema = "page_id long, title string, aliases array<string>, body string, changed_at long, deleted boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "A", [], "old words", 1, False), (2, "B", [], "two", 1, False)], schema).write.parquet(source + "/b=1")
    run = lambda: J.maintain_index(spark.readStream.schema(schema).parquet(source + "/*"), out, str(tmp_path / "ck")).start().awaitTermination()
    run()
    spark.createDataFrame([(1, "A", [], "new words", 2, False), (2, "B", [], "", 2, True)], schema).write.parquet(source + "/b=2")
    run()
    terms = {(r.page_id, r.term) for r in J.current_index(spark, out).collect()}
    assert terms == {(1, "a"), (1, "new"), (1, "words")}


def test_ingest_job(spark, wiki):
    pages = wiki(page(1, "paper", "sources", url="https://x.org/known"), page(2, "Graph", sources=["paper"]))
    text = "Graphs join nodes by edges. Graph databases keep them, and Neo is one of those in wide use today."
    caps = spark.createDataFrame(
        [(1, "https://x.org/a", "https://x.org/a", text, "article", "Doc", 1), (2, "https://x.org/a?utm_source=m", "https://x.org/a", text, "article", "Doc", 2), (3, "https://x.org/known", "https://x.org/known", text + "!", "article", "K", 3)],
        "doc_id long, target string, url string, text string, kind string, title string, added_at long",
    )
    plan = {
        "title": "Graph", "one_liner": "What a graph is made of.", "summary": "A graph is made of nodes joined by edges. It is used a lot.", "key_points": ["a"],
        "concepts": [{"title": "graph", "aliases": ["network of nodes"], "description": "Says what joins nodes."}],
        "entities": [{"title": "Neo", "aliases": [], "description": "A graph database."}, {"title": "Marvin", "aliases": [], "description": "Never mentioned here."}],
        "quotes": ["Graphs join nodes by edges."], "terms": [{"term": "edges", "definition": "What joins two nodes of a graph."}],
    }
    done = jobs.ingest_corpus(spark, {"captures": caps, "pages": pages, "sources": N.page_sources(pages)}, plan_fn=lambda ps: [json.dumps(plan)] * len(ps), today=TODAY)
    assert [r.doc_id for r in done["known"].collect()] == [3]
    assert [r.title for r in done["notes"].collect()] == ["Graph (source)"]
    ups = {r.title: r for r in done["upserts"].collect()}
    assert set(ups) == {"Graph", "Neo"} and ups["Graph"].aliases == ["network of nodes"] and ups["Neo"].created
    assert done["quotes"].count() == 1 and done["terms"].first().verdict == "kept"
    after = {r.title: r for r in done["pages_after"].collect()}
    assert set(after) == {"paper", "Graph", "Neo", "Graph (source)"}
    assert after["Graph"].body.endswith("\n\n## From [[Graph (source)]]\nSays what joins nodes.") and after["Graph"].aliases == ["network of nodes"]
    assert after["Neo"].body == "# Neo\n\n## From [[Graph (source)]]\nA graph database." and after["Graph (source)"].kind == "sources"
    assert {(r.source) for r in done["sources_after"].collect()} == {"paper", "Graph (source)"}
    assert {r.kind: r.pages for r in done["catalogue_counts"].collect()} == {"sources": 2, "concepts": 1, "entities": 1}


def test_ingest_asks_again_and_marks_contradictions(spark, wiki):
    """One plan is good at the second try, one never; a contradiction is a callout in the page it names, also one of this batch."""
    pages = wiki(page(1, "paper", "sources"), page(2, "Graph", sources=["paper"], body="# Graph"))
    text = "Graphs join nodes by edges. Number {} of the texts about them says a little more than the others do."
    caps = spark.createDataFrame(
        [(i, f"https://x.org/{i}", f"https://x.org/{i}", text.format(i), "article", f"Doc {i}", i, [f"https://y.org/{i}"]) for i in (1, 2, 3)],
        "doc_id long, target string, url string, text string, kind string, title string, added_at long, links array<string>",
    )

    def plan(prompts):
        out = []
        for p in prompts:
            n = next(i for i in (1, 2, 3) if f"Number {i} " in p)
            good = {
                "title": f"Source {n}", "one_liner": "What a graph is made of.", "summary": "A graph is made of nodes joined by edges. It is used a lot.", "key_points": ["a"],
                "concepts": [{"title": "Mesh" if n == 1 else "net", "aliases": ["net"], "description": f"Said in {n} of what joins nodes."}], "follow": [f"https://y.org/{n}?utm_source=a", "https://z.org"],
                "contradictions": [{"page": "[[Graph]]" if n == 1 else "net", "note": "It says otherwise."}, {"page": "Nowhere", "note": "It says otherwise."}],
            }
            out.append("not json" if n == 3 or (n == 2 and "refused" not in p) else json.dumps(good))
        return out

    done = jobs.ingest_corpus(spark, {"captures": caps, "pages": pages, "sources": N.page_sources(pages)}, plan_fn=plan, today=TODAY)
    print(done["failed"].collect())
    assert [r.doc_id for r in done["failed"].collect()] == [3] and sorted(r.doc_id for r in done["notes"].collect()) == [1, 2]
    after = {r.title: r for r in done["pages_after"].collect()}
    day = TODAY.isoformat()
    assert after["Graph"].body == f"# Graph\n\n> [!warning] Possible contradiction ({day}) with [[Source 1]]: It says otherwise."
    assert after["Mesh"].body == (
        f"# Mesh\n\n## From [[Source 1]]\nSaid in 1 of what joins nodes.\n\n## From [[Source 2]]\nSaid in 2 of what joins nodes.\n\n> [!warning] Possible contradiction ({day}) with [[Source 2]]: It says otherwise."
    )
    assert "net" not in after and done["dropped_references"].count() == 2
    assert sorted(r.url for r in done["follow"].collect()) == ["https://y.org/1", "https://y.org/2"]


def test_long_documents_are_merged_and_charged(spark, wiki):
    """A document of more chunks than notes fit is merged level by level; calls of both kinds are charged."""
    caps = _captured(spark, (1, "Long", "article", "\n\n".join(f"{i}. " + "Graphs join nodes by edges. " * 12 for i in range(24))))
    pages = wiki(page(9, "Other"))
    note = lambda ps: [json.dumps({"points": ["Point " + p[:12].strip()], "terms": [], "quotes": [], "relations": []}) for p in ps]
    both = lambda ps: [json.dumps({"points": ["Merged."]})] * len(ps)
    done = jobs.ingest_corpus(
        spark, {"captures": caps, "pages": pages, "sources": N.page_sources(pages)}, plan_fn=lambda ps: [json.dumps(PLAN)] * len(ps), notes_fn=note, merge_fn=both, today=date(2024, 2, 1), max_chars=800, fan_in=4
    )
    calls, cover = done["calls"].first(), done["coverage"].first()
    assert cover["unread"] == 0 and cover["total"] > 5 and done["plans"].count() == 1 and done["failed"].count() == 0
    read = cover["total"] - cover["unread"]
    assert calls["used"] == read + NO.merge_calls(read, 4)


def test_ask_job(spark, wiki):
    pages = wiki(page(1, "Graph", body="A graph has nodes and edges."), page(2, "Mail", "sources", body="secret graph of Anna", doc_kind="email"))
    questions = spark.createDataFrame([(1, "What is a graph?"), (2, "What about graph fish?")], "query_id long, question string")

    def answer(prompts):
        good = {"title": "t", "one_liner": "x", "answer": "A graph has nodes and edges [[Graph]].", "cited_pages": ["Graph"]}
        bad = {**good, "answer": "Marvin discovered 99 graphs in Paris [[Graph]]."}
        return [json.dumps(bad if "fish" in p else good) for p in prompts]

    done = jobs.ask_batch(spark, {"questions": questions, "pages": pages, "sources": N.page_sources(pages)}, answer_fn=answer, remote=True)
    got = {r.answer_id: (r.grounded, r.reason) for r in done["answers"].collect()}
    assert got == {1: (True, ""), 2: (False, "mostly unsupported")}
    assert {r.page_id for r in done["retrieved"].collect()} == {1}


def test_consolidate_job(spark, wiki):
    section = lambda s: f"\n\n## From [[{s}]]\nGraphs are good for finding a way in the city, says {s}."
    pages = wiki(page(1, "Graph", sources=["a", "b", "c"], body="# Graph" + section("a") + section("b") + section("c")), page(2, "Graphs", sources=["a"]))
    good = "Graphs are good for finding a way in the city, as all of these sections say in the same words."
    done = jobs.consolidate(spark, {"pages": pages, "sources": N.page_sources(pages)}, summary_fn=lambda ps: [good] * len(ps))
    row = done["updated"].first()
    assert row.body.startswith(f"# Graph\n\n## Summary\n{good}\n\n## From [[a]]") and row.summary_sources == 3
    assert [(r.title, r.other) for r in done["merge_suggestions"].collect()] == [("Graph", "Graphs")]


def test_compare_models_job(spark, wiki):
    docs = spark.createDataFrame([(i, "word " * 200, "article") for i in range(6)], "doc_id long, text string, kind string")
    plan = {"title": "Title", "one_liner": "What a graph is made of.", "summary": "A graph is made of nodes joined by edges.", "key_points": ["a"], "concepts": [{"title": "graph", "aliases": [], "description": "Says what joins nodes."}]}
    models = {"good": lambda ps: [json.dumps(plan)] * len(ps), "bad": lambda ps: ["{}"] * len(ps)}
    prices = spark.createDataFrame([("good", 1.0)], "model string, usd_per_million double")
    done = jobs.compare_models(spark, {"docs": docs, "pages": wiki(page(1, "Graph")), "prices": prices}, models=models, n=3)
    assert {r.model: r.ok_rate for r in done["summary"].collect()} == {"good": 1.0, "bad": 0.0}
    assert {r.task: r.model for r in done["routing"].collect()}["ingest"] == "good"


def test_null_groups_are_numbered(spark):
    from folioscope.operators.common import ordered_scan

    rows = [(None, 1), (None, 2), ("a", 3), ("a", 1), (None, 5)]
    got = ordered_scan(spark.createDataFrame(rows, "g string, v int"), ["v"], ["g"], {"before": "v"}).collect()
    assert sorted((r.g or "", r.v, r.rn, r.before) for r in got) == [("", 1, 1, 0), ("", 2, 2, 1), ("", 5, 3, 3), ("a", 1, 1, 0), ("a", 3, 2, 1)]


def test_timeouts_fail_alone(spark):
    def answer(prompts):
        if "slow" in prompts[0]:
            raise TimeoutError
        return [p.upper() for p in prompts]

    asked = spark.createDataFrame([(i, "slow" if i == 7 else f"p{i}") for i in range(50)], "id long, prompt string").coalesce(1)
    got = {r.id: (r.status, r.output) for r in MM.map_model(asked, answer).collect()}
    assert got.pop(7) == ("timeout", None) and all(s == "ok" and o == f"P{i}" for i, (s, o) in got.items())


def test_retry_wording_is_a_parameter(spark):
    def answer(prompts):
        return ["good" if p.endswith("because: bad") else "x" for p in prompts]

    asked = spark.createDataFrame([("p",)], "prompt string")
    row = MM.map_model(asked, answer, check=lambda a: "" if a == "good" else "bad", retry="{prompt} because: {reason}").first()
    assert (row.status, row.output, row.tries) == ("ok", "good", 2)


def test_points_are_merged_once_per_group(spark, tmp_path):
    none = "array<struct<term:string,definition:string>>"
    rel = "array<struct<a:string,relation:string,b:string>>"
    rows = [(1, i, [f"p{i}"], [], [], []) for i in range(31)]
    notes = spark.createDataFrame(rows, f"doc_id long, seq long, points array<string>, terms {none}, quotes array<string>, relations {rel}")
    calls = spark.sparkContext.accumulator(0)

    def merge(groups):
        def count(batches):
            for b in batches:
                calls.add(len(b.drop_duplicates(["doc_id", "seq"])))
                yield b

        return groups.repartition(1).mapInPandas(count, groups.schema)

    left = NO.reduce_notes(notes, fan_in=2, merge_points=merge)
    assert {r.a for r in left.collect()} == {f"p{i}" for i in range(31)}
    assert calls.value == NO.merge_calls(31, 2) == 6 + 2


def test_unread_chunks_are_rows(spark):
    chunks = spark.createDataFrame([(1, i, f"chunk {i}") for i in range(30)], "doc_id long, seq int, chunk string")
    stop = NO.affordable_chunks(14, 3)
    assert sorted(r.seq for r in NO.unread_chunks(chunks, 14, 3).collect()) == list(range(stop, 30))
    assert NO.unread_chunks(chunks).count() == 0 and NO.read_coverage(chunks).first().unread == 0


def test_names_without_aliases_count(spark, wiki):
    from folioscope.operators import lint as H
    from folioscope.operators import names as N

    pages = wiki(page(1, "Graph", body="x"), page(2, "Tree", body="see [[Graph]] and a Graph"))
    bare = pages.withColumn("aliases", F.lit(None).cast("array<string>"))
    assert H.broken_links(bare, N.page_links(bare)).count() == 0


def test_due_pages_carry_over(spark, tmp_path):
    from folioscope.streaming.jobs import due_stream

    schema = "page_id long"
    for i, ids in enumerate([(1, 2, 3), (4,), (4,)]):
        spark.createDataFrame([(x,) for x in ids], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    import folioscope.streaming.jobs as J

    known, J.due_pages = J.due_pages, lambda mine, rows: mine.select("page_id")
    try:
        pages = spark.createDataFrame([(i,) for i in range(1, 6)], schema)
        due_stream(files, lambda: pages, lambda: pages, f"{tmp_path}/out", f"{tmp_path}/cp", 2).start().awaitTermination()
    finally:
        J.due_pages = known
    got = [r.page_id for r in spark.read.parquet(f"{tmp_path}/out/due").collect()]
    assert set(got) == {1, 2, 3, 4}


PLAN = {
    "title": "Graphs anew", "one_liner": "What a graph is made of.", "summary": "A graph is made of nodes joined by edges.", "key_points": ["a"],
    "concepts": [{"title": "Graph", "aliases": [], "description": "Says what joins nodes."}],
}


def _captured(spark, *rows):
    return spark.createDataFrame(
        [(i, f"https://x.org/{i}", f"https://x.org/{i}", text, kind, title, f"2024-01-0{i}") for i, title, kind, text in rows],
        "doc_id long, target string, url string, text string, kind string, title string, added_at string",
    )


def test_rebuild_keeps_what_the_user_owns(spark, wiki):
    pages = wiki(
        page(1, "Old one", "sources", url="https://x.org/1", status="read", read=date(2024, 1, 5)), page(2, "Old two", "sources", url="https://x.org/2", status="new"),
        page(3, "Graph", sources=["Old one", "Old two"], body="# Graph\n\n## From [[Old one]]\nx\n\n## From [[Old two]]\ny"),
    )
    raw = _captured(spark, (1, "Old one", "article", "Graphs join nodes by edges. " * 20), (2, "Old two", "article", "Nothing works here at all. " * 20))
    done = jobs.rebuild(
        spark, {"pages": pages, "sources": N.page_sources(pages), "raw": raw}, every=True, today=date(2024, 2, 1),
        plan_fn=lambda ps: [json.dumps(PLAN) if "Graphs" in p else "{}" for p in ps],
    )
    assert [(r.title, r.status, r.read) for r in done["notes"].collect()] == [("Old one", "read", date(2024, 1, 5))]
    assert [r.title for r in done["kept"].collect()] == ["Old two"]
    assert {r.title for r in done["pages_left"].collect()} == {"Old two", "Graph"}


def test_remote_models_see_nothing_private(spark, wiki):
    seen = []

    def plan(prompts):
        assert not any("secret" in p for p in prompts)
        return [json.dumps(PLAN)] * len(prompts)

    caps = _captured(spark, (1, "Public", "article", "Graphs join nodes by edges. " * 20), (2, "Mail", "email", "secret words of Anna. " * 20))
    pages = wiki(page(9, "Other"))
    done = jobs.ingest_corpus(spark, {"captures": caps, "pages": pages, "sources": N.page_sources(pages)}, plan_fn=plan, today=date(2024, 2, 1), remote=True)
    assert [r.doc_id for r in done["failed"].collect()] == [2] and [r.doc_id for r in done["notes"].collect()] == [1] and not seen

    section = lambda s: f"\n\n## From [[{s}]]\nGraphs are good for finding a way, says {s}."
    body = "# Graph" + section("a") + section("b") + section("m")
    pages = wiki(page(1, "Graph", sources=["a", "b", "m"], body=body), page(2, "m", "sources", doc_kind="email"), page(3, "Tree", sources=["a", "b", "c"], body="# Tree"))

    def summary(prompts):
        raise AssertionError("no page may be shown")

    done = jobs.consolidate(spark, {"pages": pages, "sources": N.page_sources(pages)}, summary_fn=summary, remote=True)
    assert {r.page_id: r.reason for r in done["skipped"].collect()} == {1: "private, and the model is remote", 3: "no sections"}


def test_long_documents_are_read_or_refused(spark, wiki):
    pages = wiki(page(9, "Other"))
    caps = _captured(spark, (1, "Long", "article", "\n\n".join("Graphs join nodes by edges. " * 30 for _ in range(20))))
    inputs = {"captures": caps, "pages": pages, "sources": N.page_sources(pages)}
    done = jobs.ingest_corpus(spark, inputs, plan_fn=lambda ps: [json.dumps(PLAN)] * len(ps), today=date(2024, 2, 1), max_chars=2000)
    assert [r.reason for r in done["failed"].collect()] == ["too long, and not read"] and done["plans"].count() == 0
    note = json.dumps({"points": ["Graphs join nodes."], "terms": [], "quotes": [], "relations": []})
    done = jobs.ingest_corpus(
        spark, inputs, plan_fn=lambda ps: [json.dumps(PLAN)] * len(ps), notes_fn=lambda ps: [note] * len(ps), today=date(2024, 2, 1), max_chars=2000, max_calls=8, fan_in=3
    )
    assert done["failed"].count() == 0 and done["plans"].count() == 1 and done["unread"].count() > 0


def test_refused_answers_are_rows(spark, wiki):
    pages = wiki(page(1, "Graph", body="A graph has nodes and edges."))
    asked = spark.createDataFrame([(1, "What is a graph?"), (2, "zzqx unheard"), (3, "graph nodes please"), (4, "edges of a graph")], "query_id long, question string")

    def answer(prompts):
        good = json.dumps({"title": "t", "one_liner": "x", "answer": "A graph has nodes and edges [[Graph]].", "cited_pages": ["Graph"]})
        return ["not json" if "please" in p else json.dumps({"answer": "short"}) if "edges of" in p else good for p in prompts]

    done = jobs.ask_batch(spark, {"questions": asked, "pages": pages, "sources": N.page_sources(pages)}, answer_fn=answer)
    assert {r.query_id: r.reason for r in done["refused"].collect()} == {2: "nothing found", 3: "no answer in it", 4: "answer too short"}
    assert {r.answer_id for r in done["answers"].collect()} == {1}


def test_layout_tasks_follow_the_input(spark, tmp_path):
    """The lines of a larger input lie in more tasks, whatever the number of shuffle partitions; their words and hyphens need no fewer."""
    from folioscope.plans.queries_documents import layout_lines, layout_tasks

    rows = [(i, f"transcendental expectations word{i} notwithstanding everything here and there " * (i % 4)) for i in range(40)] + [(None, "well known")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        n, d = layout_tasks(spark, str(tmp_path)), str(tmp_path)
        lines = layout_lines(spark, d)
        assert n >= 24 and lines.rdd.getNumPartitions() == n and Y.vocabulary(lines).rdd.getNumPartitions() == n
        plain = Y.heal_hyphens(lines).collect()
        assert Y.heal_hyphens(lines, n).rdd.getNumPartitions() == n and plain
        assert sorted(map(str, Y.heal_hyphens(lines, n).collect())) == sorted(map(str, plain))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


LAYOUT = "doc_id long, page int, line_no int, text string, size double, bold boolean, left double, right double, baseline double, page_height double, hyphen boolean"


def test_a_document_is_laid_out_where_its_lines_lie(spark):
    """Lines that are dealt out by document are not shuffled again, nor written down between the steps."""
    rows = [
        (d, 1 + i // 20, i, f"word{i % 7} some lines of docu" if i % 3 else f"ment {i} grow", 10.0 + 4 * (i % 9 == 0), i % 5 == 0, 50.0, 200.0, 780.0 - 19 * (i % 20), 800.0, i % 3 > 0)
        for d in range(5) for i in range(60)
    ]
    dealt = spark.createDataFrame(rows, LAYOUT).repartition(6, "doc_id")
    found = Y.document_text(dealt, dealt=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan and "Scan ExistingRDD" in plan
    got = sorted((r.doc_id, r.block, r.kind, r.text) for r in found.collect())
    assert got == sorted((r.doc_id, r.block, r.kind, r.text) for r in Y.document_text(spark.createDataFrame(rows, LAYOUT)).collect())
    assert {x[0] for x in got} == set(range(5)) and {x[2] for x in got} >= {"heading", "text"}


def test_short_lines_of_crowded_cells_go(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(2400):
        page, left, y = rng.choice([1, 1, 2, None]), rng.choice([50.0, 90.0, 140.0, 400.0, None]), rng.uniform(0, 790)
        text = rng.choice(["ab", "cd 1", "a line that is long enough to be prose", None])
        rows.append((i % 2, page, i, text, 10.0, False, left, None if left is None else left + 20, y if i % 3 else 300.0 + y / 20, 800.0, False))
    cell = lambda r: None if r[1] is None or r[6] is None else (r[0], r[1], int((r[6] + r[7]) / 2 // 50), int(r[8] // 50))
    count = {}
    for r in rows:
        if r[3] is not None and len(r[3]) <= 30 and cell(r):
            count[cell(r)] = count.get(cell(r), 0) + 1
    around = lambda c: [(c[0], c[1], c[2] + a, c[3] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    chart = {x for c in count if sum(count.get(x, 0) for x in around(c)) >= 40 for x in around(c)}
    want = {r[2] for r in rows if r[3] is not None and not (len(r[3]) <= 30 and cell(r) in chart)}
    got = {r.line_no for r in Y.drop_clusters(spark.createDataFrame(rows, LAYOUT)).filter("text is not null").collect()}
    assert got == want and 0 < len(want) < sum(r[3] is not None for r in rows) - 100
