"""Model calls as a DataFrame step, plan validation, and scrubbing of model text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.functions import values as V
from folioscope.operators.common import computed, first_by, ordered_scan, top_k
from folioscope.operators.names import resolve_refs


class ModelTimeout(TimeoutError):
    """A call that took too long; it is not tried again."""


def map_model(
    df: DataFrame,
    fn: Callable[[list[str]], list[str]],
    prompt: str = "prompt",
    attempts: int = 2,
    check: Callable[[str], str] | None = None,
    tokens: Callable[[str, str], int] | None = None,
    calls_per_batch: int = 1,
    retry: str = "{prompt}\n\nThis answer was refused ({reason}). Answer again.",
    clock: Callable[[], float] | None = None,
) -> DataFrame:
    """`df` with `output`, `status` (ok, invalid, timeout), `error`, `tries` and `tokens`.

    `fn` answers a list of prompts; `check(output)` returns what is wrong with one, or an empty
    string. An invalid answer is tried again with the reason, worded by `retry`; a timeout (any
    `TimeoutError`) is not. `fn` gets `calls_per_batch` prompts at a time, and a timeout concerns
    these only. With a `clock` (`time.monotonic`) a column `seconds` is added: the time of all calls of a row, those that timed out included;
    prompts that go out in one call share its time. Runs in Arrow batches where the rows are, so calls spread with the partitions.
    """
    out = "output string, status string, error string, tries int, tokens long" + (", seconds double" if clock else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            prompts = list(batch[prompt])
            output, status, error, tries, used = [None] * n, [""] * n, [""] * n, [0] * n, [0] * n
            spent = [0.0] * n
            todo = list(range(n))
            for _ in range(attempts):
                if not todo:
                    break
                again = []
                for at in range(0, len(todo), calls_per_batch):
                    some = todo[at : at + calls_per_batch]
                    asked = [retry.format(prompt=prompts[i], reason=error[i]) if error[i] else prompts[i] for i in some]
                    began, late = clock() if clock else 0.0, False
                    try:
                        answers = fn(asked)
                    except TimeoutError:
                        late = True
                    if clock:
                        share = (clock() - began) / len(some)
                        for i in some:
                            spent[i] += share
                    if late:
                        for i in some:
                            status[i], error[i], tries[i] = "timeout", "timed out", tries[i] + 1
                        continue
                    for i, text, answer in zip(some, asked, answers):
                        tries[i] += 1
                        used[i] += tokens(text, answer) if tokens else 0
                        problem = check(answer) if check else ""
                        output[i], status[i], error[i] = (answer, "ok", "") if not problem else (None, "invalid", problem)
                        if problem:
                            again.append(i)
                todo = again
            timed = {"seconds": spent} if clock else {}
            yield batch.assign(output=output, status=status, error=error, tries=tries, tokens=used, **timed)

    return df.mapInPandas(run, schema)


def read_chunks(chunks: DataFrame, fn, check=None, min_split: int = 200) -> tuple[DataFrame, DataFrame]:
    """Notes per chunk, unreadable chunks tried again as halves: (answers, warnings)."""
    from folioscope.operators.chunks import halves
    from folioscope.operators.common import durable

    whole = durable(map_model(chunks.withColumn("prompt", T.fence_safe("chunk")), fn, check=check))
    bad = whole.filter(F.col("status") != "ok")
    split = bad.filter((F.col("status") == "invalid") & (F.length("chunk") >= min_split))
    parts = split.select("doc_id", "seq", F.posexplode(halves("chunk")).alias("half", "chunk"))
    read = durable(map_model(parts.withColumn("prompt", T.fence_safe("chunk")), fn, attempts=1, check=check))
    answers = whole.filter("status = 'ok'").select("doc_id", "seq", F.lit(-1).alias("half"), "output").unionByName(
        read.filter("status = 'ok'").select("doc_id", "seq", "half", "output")
    )
    good = read.groupBy("doc_id", "seq").agg(F.count_if(F.col("status") == "ok").alias("good"))
    warned = bad.select("doc_id", "seq", "error").join(good, ["doc_id", "seq"], "left")
    text = F.when(F.coalesce("good", F.lit(0)) == 0, F.concat(F.lit("skipped: "), "error")).when(
        F.col("good") == 1, F.lit("only half could be read")
    )
    return answers, warned.select("doc_id", "seq", text.alias("warning")).filter("warning is not null")


# ----------------------------------------------------------------------------- plan validation

EDIT = "array<struct<title:string,aliases:array<string>,description:string>>"
PLAN_SCHEMA = f"""
    title string, one_liner string, summary string, abstract string,
    insights array<struct<idea:string,why:string>>,
    terms array<struct<term:string,definition:string>>,
    quotes array<string>,
    relations array<struct<a:string,relation:string,b:string>>,
    open_questions array<string>, key_points array<string>, tags array<string>,
    concepts {EDIT}, entities {EDIT},
    related_pages array<string>,
    contradictions array<struct<page:string,note:string>>,
    follow array<string>
"""
# fixed values: the most items each list of a plan keeps
CLAMPS = {
    "insights": 8, "terms": 10, "quotes": 6, "relations": 10, "open_questions": 5, "key_points": 8, "tags": 6,
    "concepts": 6, "entities": 5, "related_pages": 6, "contradictions": 4, "follow": 3,
}


def _derived_one_liner(one: Column, title: Column, summary: Column) -> Column:
    """A one-line summary in place of an unusable one (an address, a title or a label is none); null where `one` stays."""
    trimmed = T.strip(F.coalesce(one, F.lit("")))
    heading = T.fold(F.coalesce(title, F.lit("")))

    def labelled(said):
        starts = F.lit(False)
        for entry in V.LANGUAGES.values():
            for words in entry["placeholders"]:
                starts = starts | said.startswith(words)
        return (F.length(trimmed) <= 45) & starts

    def echoes(said):
        return T.let(heading, lambda t: (t != "") & said.startswith(t) & (F.length(said) <= F.length(t) + 20))

    unusable = (
        one.isNull() | (F.length(trimmed) < 10) | F.lower(trimmed).rlike("^https?://") | ~trimmed.contains(" ")
        | T.let(T.fold(trimmed), lambda said: echoes(said) | labelled(said)) | (F.size(T.words_of(trimmed)) < 4)
    )
    return F.when(unusable & (F.length(summary) >= 30), T.first_sentence(summary))


def validate_plans(raw: DataFrame) -> DataFrame:
    """`raw(doc_id, raw_json)` parsed, clamped and checked: (doc_id, plan, repaired, errors, valid).

    Over-long lists are cut, never refused; what a list item or a field lacks is an error.
    """
    parsed = computed(raw.select("doc_id", "raw_json"), p=F.from_json("raw_json", PLAN_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    parsed = computed(parsed.drop("raw_json"), _derived=_derived_one_liner(F.col("p.one_liner"), F.col("p.title"), F.col("p.summary")))
    empty = F.lit("[]")
    fields = {}
    for name in ("title", "summary", "abstract"):
        fields[name] = F.col(f"p.{name}")
    fields["abstract"] = F.coalesce(fields["abstract"], F.lit(""))
    fields["one_liner"] = F.coalesce("_derived", "p.one_liner")
    types = {f.name: f.dataType.simpleString() for f in parsed.schema["p"].dataType.fields if f.name != "_bad"}
    for name, most in CLAMPS.items():
        fields[name] = F.slice(F.coalesce(F.col(f"p.{name}"), F.from_json(empty, types[name])), 1, most)
    plan = F.struct(*[fields[f].alias(f) for f in types])
    built = computed(
        parsed, _json=F.col("p").isNotNull() & F.col("p._bad").isNull(), _points=F.col("p.key_points").isNotNull(), plan=plan, repaired=F.col("_derived").isNotNull()
    ).select("doc_id", "_json", "_points", "plan", "repaired")

    def short(name, least):
        return F.when(F.coalesce(F.length(F.col(f"plan.{name}")), F.lit(0)) < least, F.lit(f"{name}: too short"))

    def items(name, test, what):
        return F.when(F.exists(f"plan.{name}", lambda x: ~F.coalesce(test(x), F.lit(False))), F.lit(f"{name}: {what}"))

    def between(c, lo, hi):
        return F.length(c).between(lo, hi)

    one_text = T.strip(F.coalesce(F.col("plan.one_liner"), F.lit("")))
    checks = [
        F.when(~F.col("_json"), F.lit("invalid JSON")),
        short("title", 3), short("one_liner", 10), short("summary", 30),
        F.when(F.lower(one_text).rlike("^https?://") | ~one_text.contains(" "), F.lit("one_liner: must be a sentence")),
        F.when(~F.col("_points"), F.lit("key_points: missing")),
        F.when(F.size("plan.concepts") == 0, F.lit("concepts: at least one")),
        items("concepts", lambda c: between(c["title"], 2, 60) & (F.length(c["description"]) >= 10), "bad item"),
        items("entities", lambda c: between(c["title"], 2, 60) & (F.length(c["description"]) >= 10), "bad item"),
        items("terms", lambda t: between(t["term"], 2, 60) & (F.length(t["definition"]) >= 10), "bad item"),
        items("relations", lambda r: between(r["a"], 2, 50) & between(r["b"], 2, 50) & between(r["relation"], 2, 40), "bad item"),
        items("insights", lambda i: (F.length(i["idea"]) >= 10) & (F.length(i["why"]) >= 10), "bad item"),
        items("contradictions", lambda c: F.length(c["note"]) >= 5, "bad item"),
    ]
    errors = F.array_compact(F.array(*checks))
    checked = computed(built, errors=errors)
    return checked.select("doc_id", "plan", "repaired", "errors", (F.size("errors") == 0).alias("valid"))


def links_to_follow(plans: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """The post's own links a plan chose: (doc_id, place, url) in the plan's order and the post's
    spelling, all or the first `most`. `plans(doc_id, follow)`, `docs(doc_id, links)`."""
    own = docs.select("doc_id", F.posexplode("links").alias("at", "url")).withColumn("n", U.normalize_url("url"))
    spelled = own.groupBy("doc_id", "n").agg(F.max_by("url", "at").alias("url"))
    chosen = plans.select("doc_id", F.posexplode("follow").alias("pos", "asked")).filter(U.is_url("asked"))
    hit = chosen.withColumn("n", U.normalize_url("asked")).join(spelled, ["doc_id", "n"])
    once = first_by(hit.select("doc_id", "url", "pos"), ["doc_id", "url"], ["pos"])
    if most is None:
        return ordered_scan(once, ["pos", "url"], ["doc_id"]).select("doc_id", F.col("rn").alias("place"), "url")
    return top_k(once, ["doc_id"], [F.col("pos")], most, "place").select("doc_id", "place", "url")


# --------------------------------------------------------------------------------------- scrub


def _rebuilt(c: Column, pattern: str, replaced) -> Column:
    """`c` with every match i of `pattern` replaced by `replaced(i)`: gaps and matches in order."""
    gaps = F.split(c, pattern)
    return F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(replaced(i), F.lit("")))), ""
    )


MD_LINK = r"\[([^\]\n]*)\]\(([^)\n]*)\)"
WIKILINK = r"\[\[([^\]]+?)(?:\|([^\]]+))?\]\]"
ADDRESS = r"(?i)(?:https?://|www\.)[^\s<>\"')\]]+"


def scrub(texts: DataFrame, names: DataFrame, hidden: DataFrame | None = None, text: str = "text", known: str = "known") -> DataFrame:
    """`texts` (with a key column `row_id`) with `text` as plain prose and `cut`, the addresses removed.

    A Markdown link or bare address stays only if the `known` text has it; a `[[link]]` only if it
    names a page that is not hidden, else its words stay.
    """

    def links(c, k):
        def parts(ms):
            def one(i):
                whole = F.get(ms, i)["m"]
                shown = F.regexp_extract(whole, MD_LINK, 1)
                target = F.regexp_extract(F.regexp_extract(whole, MD_LINK, 2), "^([^ ]*)", 1)
                return F.struct(whole.alias("m"), shown.alias("w"), ((target != "") & k.contains(target)).alias("ok"))

            return F.transform(ms, lambda m, i: one(i))

        return T.let(F.transform(T.find_all(c, MD_LINK), lambda m: F.struct(m.alias("m"))), parts)

    clean = texts.withColumn("_t", T.sanitize_text(text)).withColumn("_k", F.coalesce(known, F.lit("")))
    clean = computed(clean, _md=links(F.col("_t"), F.col("_k")))
    swapped = _rebuilt(F.col("_t"), MD_LINK, lambda i: F.when(F.get("_md", i)["ok"], F.get("_md", i)["m"]).otherwise(F.get("_md", i)["w"]))
    clean = computed(clean, _t2=swapped, _cut1=F.size(F.filter("_md", lambda m: ~m["ok"])))

    target = lambda m: T.strip(F.regexp_extract(F.regexp_extract(m, WIKILINK, 1), r"^([^#|]*)", 1))
    wanted = clean.select("row_id", F.explode(F.array_distinct(F.transform(T.find_all("_t2", WIKILINK), target))).alias("ref"))
    found = resolve_refs(wanted, names).filter(F.col("found_id").isNotNull())
    if hidden is not None:
        found = found.join(hidden.select(F.col("title").alias("found_title")).distinct(), "found_title", "left_anti")
    visible = found.groupBy("row_id").agg(F.collect_set("ref").alias("_ok"))  # no larger than the text
    joined = clean.join(visible, "row_id", "left").withColumn("_w", T.find_all("_t2", WIKILINK))

    def wikilink(i):
        m = F.get("_w", i)
        words = F.regexp_extract(m, WIKILINK, 2)
        ok = F.coalesce(F.array_contains("_ok", target(m)), F.lit(False))
        return F.when(ok, m).otherwise(F.when(words != "", words).otherwise(target(m)))

    joined = computed(joined, _t3=_rebuilt(F.col("_t2"), WIKILINK, wikilink))
    joined = computed(joined, _a=T.find_all("_t3", ADDRESS))
    stays = lambda a: F.col("_k").contains(F.rtrim(a, F.lit(".,;:!?")))
    final = _rebuilt(F.col("_t3"), ADDRESS, lambda i: F.when(stays(F.get("_a", i)), F.get("_a", i)).otherwise(F.lit("")))
    cut2 = F.size(F.filter("_a", lambda a: ~stays(a)))
    return joined.withColumn(text, final).withColumn("cut", (F.col("_cut1") + cut2).cast("long")).select(*texts.columns, "cut")
