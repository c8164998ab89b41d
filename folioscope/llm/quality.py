"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import computed

from .common import SPACE_RUN, fresh

#: (rule, measure, comparison that a good text meets, bound). Measures are columns or ratios made by `measures`.
RULES = (
    ("few_words", "n_words", ">=", 50),
    ("word_too_short", "mean_word_chars", ">=", 2.0),
    ("word_too_long", "mean_word_chars", "<=", 14.0),
    ("symbols", "symbol_ratio", "<=", 0.05),
    ("repeated_lines", "dup_line_ratio", "<=", 0.5),
    ("repeated_words", "repeat_ratio", "<=", 0.5),
    ("stop_words", "n_stop_words", ">=", 2),
    ("bullets", "bullet_ratio", "<=", 0.9),
    ("shouting", "upper_ratio", "<=", 0.6),
)

#: Frequent words of the languages of the corpus; a prose text has some of them.
STOP_WORDS = (
    "the of and to a in that is was for it with as on be at by this "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la que el en y los se del las un por con no una su al es "
    "le les et des une du dans qui que pour est sur au par il ne pas plus"
).split()


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more: windows sorted by hash, equal neighbours marked, places united."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("p"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    return F.sort_array(windows)


def _union_of_threes(places: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
    return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["n"])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counts the rules read, each costly array worked out once per row.

    Null and empty texts have no words and all counts zero. Words of a text of any length are counted whole. Columns of `docs` with
    the names added here are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines, windows = fresh(docs, "_words", "_lines", "_windows")
    with_word = lambda s: s.rlike("[^\\x20\\x09-\\x0D]")
    one = computed(docs, **{words: F.filter(F.split(body, SPACE_RUN), lambda w: w != ""), lines: F.filter(F.split(body, "\n"), with_word)})
    two = computed(one, **{windows: _repeated_words(F.col(words))})
    w, h = F.col(words), F.col(windows)
    same = lambda x, i, j: F.coalesce(F.get(h, j)["h"] == x["h"], F.lit(False))
    repeated = F.filter(F.transform(h, lambda x, i: F.when(same(x, i, i - 1) | same(x, i, i + 1), x["p"])), lambda p: p.isNotNull())
    counted = dict(
        n_words=F.size(w).cast("long"),
        word_chars=F.length(F.regexp_replace(body, SPACE_RUN, "")).cast("long"),
        n_symbols=F.length(F.regexp_replace(body, "[^#*$%&|<>]", "")).cast("long"),
        n_lines=F.size(lines).cast("long"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_repeat_words=_union_of_threes(repeated),
        n_stop_words=F.size(F.array_intersect(F.transform(w, F.lower), F.array(*[F.lit(s) for s in dict.fromkeys(STOP_WORDS)]))).cast("long"),
        n_bullets=F.size(F.filter(lines, lambda s: s.rlike("^\\s*[-*•]"))).cast("long"),
        n_upper=F.length(F.regexp_replace(body, "\\P{Lu}", "")).cast("long"),
    )
    out = computed(two, **counted).drop(words, lines, windows)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        *[c for c in out.columns if c not in ("mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "bullet_ratio", "upper_ratio")],
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("n_bullets", "n_lines").alias("bullet_ratio"), share("n_upper", "word_chars").alias("upper_ratio"),
    )


def compile_rules(rules=RULES) -> Column:
    """The table as one column: the names of the rules a row breaks, in table order."""
    meets = {">=": lambda c, b: c >= b, "<=": lambda c, b: c <= b, ">": lambda c, b: c > b, "<": lambda c, b: c < b}
    broken = [F.when(~F.coalesce(meets[how](F.col(measure), F.lit(bound)), F.lit(False)), F.lit(name)) for name, measure, how, bound in rules]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`docs` with the measures, `broken` (the rules that a text breaks), `base_failed` and `kept` (no rule broken).

    An empty or null text breaks the rule of few words. Equal rows get equal verdicts; the work is row-local, so no key is hot.
    """
    out = measures(docs, text)
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    judged = out.withColumn("base_failed", base).withColumn("broken", compile_rules(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
