"""Asking in rounds: answers are judged against other rows between the attempts, and what fails is asked again with the reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import model_map as MM
from folioscope.operators.common import durable

ANSWERED = ["output", "error", "attempt", "problems"]


def by_model(fn: Callable, tokens: Callable | None = None) -> Callable[[DataFrame], DataFrame]:
    """One call of `fn` per row, as a step for `ask_until_sound`."""
    return lambda rows: MM.map_model(rows, fn, attempts=1, tokens=tokens)


def ask_until_sound(
    asked: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], attempts: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(last answers, all attempts) of `asked(key, prompt, ...)`, one row per key.

    `ask(rows)` adds `output` and `error` to the rows it is given; `judge(answers)` takes (key, output) and returns (key, problems) by whatever
    tables it joins. An answer without problems has passed. One with problems is asked for again, its problems added to the first prompt,
    until `attempts` are used up; then it waits for review. A row without an output (a timeout) is not asked again and is `unanswered`,
    also where an earlier answer had problems. Answers that `judge` leaves out have no problems; a row without a key meets none and is asked once. Rounds are written down one by one, so a model
    is asked once a round however often a later step is computed, and only rows that failed go into the next.

    last: (key, output, error, attempt, problems, status), status `passed`, `review` or `unanswered`; all: the same rows of every attempt
    without the status.
    """
    todo, rounds = asked, []
    for n in range(1, attempts + 1):
        got = durable(ask(todo).select(key, "output", "error", F.lit(n).alias("attempt")))
        said = judge(got.filter("output is not null").select(key, "output")).select(key, "problems")
        none = F.array().cast("array<string>")
        judged = durable(got.join(said, key, "left").withColumn("problems", F.coalesce("problems", none)))
        rounds.append(judged)
        failed = judged.filter(F.col("output").isNotNull() & (F.size("problems") > 0))
        if n == attempts or failed.isEmpty():
            break
        reason = failed.select(key, F.array_join("problems", "; ").alias("_reason"))
        prompt = F.concat("prompt", F.lit("\n\nThis answer was refused ("), "_reason", F.lit("). Answer again."))
        todo = asked.join(reason, key).withColumn("prompt", prompt).drop("_reason")
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    last = every.groupBy(key).agg(F.max_by(F.struct(*ANSWERED), "attempt").alias("_a")).select(key, "_a.*")
    status = F.when(F.col("output").isNull(), "unanswered").when(F.size("problems") > 0, "review").otherwise("passed")
    return last.withColumn("status", status), every


def sound_summaries(asked: DataFrame, ask: Callable[[DataFrame], DataFrame], evidence: DataFrame, language: str = "en", attempts: int = 2):
    """Summaries of pages `asked(page_id, prompt)`, each held against `evidence(page_id, text)` between the attempts."""
    from folioscope.functions import text as T
    from folioscope.operators.grounding import summary_problems

    def judge(answers: DataFrame) -> DataFrame:
        return summary_problems(answers.select("page_id", F.col("output").alias("summary")), evidence, language)

    def stripped(rows: DataFrame) -> DataFrame:
        return ask(rows).withColumn("output", T.strip("output"))

    return ask_until_sound(asked, "page_id", stripped, judge, attempts)
