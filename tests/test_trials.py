"""Medians by selection, and models compared by measured times and judged answers."""

import json
import random
import statistics
import time

from conftest import page
from folioscope.operators import model_map as MM
from folioscope.operators import runs as O
from folioscope.plans import jobs


def test_exact_medians_of_hot_groups(spark):
    rng = random.Random(4)
    rows = [("hot", 1.5) for _ in range(500)] + [("hot", rng.random()) for _ in range(301)] + [("even", float(i)) for i in (4, 1, 3, 2)] + [(None, 7.0), (None, 9.0), ("one", 3.0), ("one", None), ("none", None)]
    rows += [("low", 0.0)] * 400 + [("low", 5.0)] * 400
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.m for r in O.exact_medians(df, ["g"], "v", "m").collect()}
    want = {g: statistics.median([v for k, v in rows if k == g and v is not None]) for g in ("hot", "even", None, "one", "low")}
    assert got == want
    assert O.exact_medians(df.limit(0), ["g"], "v", "m").count() == 0
    plan = O.exact_medians(df, ["g"], "v", "m")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan and "collect_list" not in plan


def test_calls_are_timed(spark):
    def slow(prompts):
        time.sleep(0.05)
        if prompts[0].startswith("late"):
            raise MM.ModelTimeout
        return ["" if "refused" not in p and p.startswith("twice") else p for p in prompts]

    rows = spark.createDataFrame([("once",), ("twice",), ("late",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.tries, r.seconds) for r in MM.map_model(rows, slow, check=lambda a: "" if a else "empty", clock=time.monotonic).collect()}
    assert {p: t for p, (t, _) in got.items()} == {"once": 1, "twice": 2, "late": 1}
    assert got["once"][1] >= 0.05 and got["twice"][1] >= 0.1 and got["late"][1] >= 0.05
    assert "seconds" not in MM.map_model(rows, slow).columns


def test_models_compared_on_questions(spark, wiki):
    pages = wiki(page(1, "Graph", body="A graph has nodes and edges between nodes."), page(2, "Tree", body="A tree is a graph without cycles."))
    golden = spark.createDataFrame([(1, "What is a graph?", ["graph"]), (2, "zzqx unheard", ["Tree"])], "query_id long, question string, expect array<string>")
    docs = spark.createDataFrame([(i, "word " * 200, "article") for i in range(3)], "doc_id long, text string, kind string")

    def good(prompts):
        time.sleep(0.02)
        return [json.dumps({"title": "t", "one_liner": "x", "answer": "A graph has nodes and edges [[Graph]].", "cited_pages": ["Graph"]})] * len(prompts)

    def broken(prompts):
        raise ValueError("no key")

    inputs = {"docs": docs, "pages": pages, "golden": golden, "prices": spark.createDataFrame([("good", 2.0)], "model string, usd_per_million double")}
    done = jobs.compare_models(spark, inputs, models={"broken": broken}, ask={"good": good, "broken": broken})
    trials = sorted((r.model, r.task, r.ok, r.first_try, r.cites_expected, r.latency_seconds >= 0.02) for r in done["trials"].filter("task = 'ask'").collect())
    assert trials == [("broken", "ask", False, False, False, False)] * 2 + [("good", "ask", False, False, False, False), ("good", "ask", True, True, True, True)]
    summary = {(r.model, r.task): r for r in done["summary"].collect()}
    assert summary["good", "ask"].ok_rate == 0.5 and summary["good", "ask"].cites_rate == 1.0 and summary["good", "ask"].median_latency_seconds > 0
    assert summary["broken", "ingest"].ok_rate == 0.0 and {r.task: r.model for r in done["routing"].collect()} == {"ingest": None, "ask": None}


def test_the_query_of_plan_metrics_keeps_the_language(spark, tmp_path):
    """A plan in another language than asked for is told apart by the query, not only worked out."""
    from folioscope.plans import registry

    spanish = "La casa de los libros es un lugar para leer con calma y por las tardes se llena de gente que busca silencio."
    english = "The house of the books is a place for reading, and in the evening it is full of people that look for silence."
    docs = [(1, english, "en", "src"), (2, spanish, "es", "src"), (3, spanish + " " + english, "en", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://a.example/")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "2024-01-02 00:00:00", "view")], "event_id long, ts string, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    registry.load_all()
    rows = registry.QUERIES["plan_metrics"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.in_language for r in rows} == {1: True, 2: False, 3: True}
    assert "in_language" in registry.ORACLES["plan_metrics"]
