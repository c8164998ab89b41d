"""Answers judged against other rows between attempts."""

from pyspark.sql import functions as F

from conftest import page
from folioscope.operators import names as N
from folioscope.operators import rounds as R
from folioscope.operators.model_map import ModelTimeout
from folioscope.plans import jobs

GOOD = "Graphs are good for finding a way in the city, as all of these sections say in the same words."
ODD = GOOD + " So does Marvin, who is not named anywhere."


def test_rounds_ask_only_for_what_failed(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, "dddd"), (None, "e")], "id long, prompt string")
    limits = spark.createDataFrame([(1, 100), (2, 100), (3, 1), (4, 100)], "id long, most int")

    def answer(prompts):
        out = []
        for p in prompts:
            if p.startswith("dddd"):
                raise ModelTimeout
            out.append(p if p.startswith(("a", "ccc")) else "bad" if "refused" not in p else "told: " + p.split("(")[1].split(")")[0])
        return out

    def judge(answers):
        known = answers.join(limits, "id")
        wrong = F.array_compact(F.array(F.when(F.col("output") == "bad", "bad word"), F.when(F.length("output") > F.col("most"), "too long")))
        return known.select("id", wrong.alias("problems"))

    last, every = R.ask_until_sound(asked, "id", R.by_model(answer), judge, attempts=3)
    got = {r.id: (r.output and r.output[:14], r.attempt, r.problems, r.status) for r in last.collect()}
    assert got[1] == ("a", 1, [], "passed") and got[2] == ("told: bad word", 2, [], "passed")
    assert got[3][1:] == (3, ["too long"], "review") and got[4] == (None, 1, [], "unanswered") and len(got) == 5
    assert sorted((r.id or 0, r.attempt) for r in every.collect()) == [(0, 1), (1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1)]
    nothing, none = R.ask_until_sound(asked.limit(0), "id", R.by_model(answer), judge)
    assert nothing.count() == 0 and none.count() == 0


def test_consolidate_asks_again_with_the_problems(spark, wiki):
    body = lambda t: f"# {t}" + "".join(f"\n\n## From [[{s}]]\nGraphs are good for finding a way in the city, says {s}." for s in "abc")
    titles = ["Graph", "Tree", "Wood", "Path"]
    pages = wiki(*[page(i + 1, t, sources=["a", "b", "c"], body=body(t) + f"\n\nAbout {t.lower()}.") for i, t in enumerate(titles)])

    def summary(prompts):
        out = []
        for p in prompts:
            told = "unknown: Marvin" in p
            if "About path" in p:
                raise ModelTimeout
            out.append(GOOD if "About graph" in p or ("About tree" in p and told) else ODD)
        return out

    done = jobs.consolidate(spark, {"pages": pages, "sources": N.page_sources(pages)}, summary_fn=summary)
    assert {r.page_id for r in done["updated"].collect()} == {1, 2} and all(GOOD in r.body for r in done["updated"].collect())
    assert [(r.page_id, r.tries, r.problems) for r in done["reviews"].collect()] == [(3, 2, ["unknown: Marvin"])]
    assert [(r.page_id, r.reason) for r in done["skipped"].collect()] == [(4, "timeout")]
    assert sorted((r.page_id, r.attempt) for r in done["attempts"].collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)]
