"""Line dedup by winnowing: runs of lines that occurred before are deleted, the first occurrence stays. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_RUN, fresh, stored

WORD = "[^\\x20\\x09-\\x0D]"
#: Parts over which the copies of one window are spread when they learn where it stands first.
SALT = 16


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that has a word: document, place, two 64-bit hashes and number of words. Documents that are equal in id and text count once."""
    key = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    rows = key.select("d", "th", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(WORD))
    n_words = F.size(F.filter(F.split("line", SPACE_RUN), lambda w: w != ""))
    rows = rows.select("d", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), n_words.cast("long").alias("n"))
    return rows.repartition("d", "th").dropDuplicates(["d", "th", "pos"])


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Every window of lines with its winnowing fingerprint.

    The window of a line is the shortest run from it that holds `min_words` words. Its minimum is the least line hash in it, the leftmost
    of equal ones; `selected` marks the first of the windows that choose the same line, so that each chosen line counts once. `window` and
    `tie` hash the whole window (128 bits in all). `tail` has the lines after the window, as far as a run could go on without holding a
    further window.
    """
    place = W.partitionBy("d", "th").orderBy("pos")
    weight = F.least("n", F.lit(min_words))
    placed = lines.withColumn("s", F.sum(weight).over(place.rowsBetween(W.unboundedPreceding, -1)))
    placed = placed.withColumn("s", F.coalesce("s", F.lit(0))).withColumn("line", F.struct("h", "g", "pos"))
    by_words = W.partitionBy("d", "th").orderBy("s")
    here, after = by_words.rangeBetween(0, min_words - 1), by_words.rangeBetween(min_words, 2 * min_words - 1)
    framed = placed.select(
        "d", "th", "pos", "s", F.collect_list("line").over(here).alias("run"), F.collect_list("line").over(after).alias("tail"),
        F.sum(weight).over(here).alias("held"),
    ).filter(F.col("held") >= min_words)
    hashes = F.transform("run", lambda x: x["h"])
    least = F.array_min(hashes)
    marked = framed.select("d", "th", "pos", "run", "tail", least.alias("minimum"), F.array_position(hashes, least).cast("int").alias("place"))
    marked = marked.withColumn("at", F.element_at("run", F.col("place"))["pos"])
    chosen = ~F.col("at").eqNullSafe(F.lag("at").over(place))
    return marked.select(
        "d", "th", "pos", "tail", F.element_at("run", -1)["pos"].alias("end"), "minimum", "place", chosen.alias("selected"),
        F.xxhash64(F.transform("run", lambda x: x["h"]), F.size("run")).alias("window"), F.xxhash64(F.size("run"), F.transform("run", lambda x: x["g"])).alias("tie"),
    )


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Runs of lines (d, th, start, end; 0-based, both included) that repeat earlier lines, overlapping ones united.

    1. The lines that windows chose as their minima are counted: a repeated run of `min_words` words or more holds the window of its
       first line, and equal windows choose equal minima at equal places. Windows whose minimum is a line chosen once go.
    2. The others meet where minimum, place and the lines themselves agree (by 128 bits of hashes); windows that stand once go.
    3. Matches are extended. Forwards: each window is told for every prefix of its tail whether the window and the prefix stand earlier
       anywhere, in the order of (document id, nulls first; text hash; place), and ends with the longest that does. Backwards: the lines
       before a match start windows of their own, as far as the run reaches.
    """
    found = stored(windows(line_table(docs, doc_id, text), min_words), "line-windows")
    minima = found.filter("selected").groupBy("minimum").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("minimum")
    live = found.drop("selected").join(minima, "minimum", "left_semi")
    key = ["minimum", "place", "window", "tie"]
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    often = live.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    salted = live.withColumn("salt", F.pmod(F.xxhash64("d", "th", "pos"), F.lit(SALT)).cast("int"))
    ends = F.transform(
        F.sequence(F.lit(0), F.size("tail")),
        lambda k: F.struct(
            F.xxhash64(F.transform(F.slice("tail", F.lit(1), k), lambda x: x["h"]), k).alias("prefix"), F.xxhash64(k, F.transform(F.slice("tail", F.lit(1), k), lambda x: x["g"])).alias("more"),
            F.when(k == 0, F.col("end")).otherwise(F.get(F.col("tail"), k - 1)["pos"]).alias("end"),
        ),
    )
    runs = stored(salted.join(spread(often), [*key, "salt"]).select("d", "th", "pos", "salt", "window", "tie", F.inline(ends)), "line-runs")
    order = F.struct("d", "th", "pos")
    same = ["window", "tie", "prefix", "more"]
    firsts = runs.groupBy(*same).agg(F.min(order).alias("first"))
    later = runs.join(spread(firsts), [*same, "salt"]).filter(~order.eqNullSafe(F.col("first")))
    spans = later.groupBy("d", "th", F.col("pos").alias("start")).agg(F.max("end").alias("end"))
    place = W.partitionBy("d", "th").orderBy("start")
    seen = spans.withColumn("upto", F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1)))
    fresh = F.when(F.col("upto").isNull() | (F.col("start") > F.col("upto") + 1), 1).otherwise(0)
    united = seen.withColumn("island", F.sum(fresh).over(place.rowsBetween(W.unboundedPreceding, 0)))
    return united.groupBy("d", "th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """`docs` without later repeats of line runs of `min_words` words or more; adds `n_deleted` (lines taken out).

    A run is a sequence of neighbouring lines (blank ones don't count, and go where they lie inside a deleted run). It goes where an equal
    run stands earlier: in a document of lower id (null is lowest), or above in the same one. Of a run that overlaps its own repeat,
    the first period stays. Rows equal in id and text are one document and keep their lines alike. Null and empty texts stay as they are;
    a document whose lines all go stays with an empty text.
    """
    runs = repeated_runs(docs, doc_id, text, min_words)
    per_doc = runs.groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    of_id, of_text, cut, here = fresh(docs, "_d", "_th", "_cuts", "_h")
    cuts = per_doc.select(F.col("d").alias(of_id), F.col("th").alias(of_text), F.col("cuts").alias(cut))
    both = docs.withColumn(here, F.xxhash64(text)).join(cuts, F.col(doc_id).eqNullSafe(F.col(of_id)) & (F.col(here) == F.col(of_text)), "left")
    lines = F.split(F.col(text), "\n")
    from_line = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col(cut), i - 1)["end"] + 1)
    pieces = F.transform(cut, lambda c, i: F.slice(lines, from_line(i) + 1, c["start"] - from_line(i)))
    last = F.slice(lines, F.element_at(cut, -1)["end"] + 2, F.lit(2**31 - 1))
    kept = F.array_join(F.concat(F.flatten(pieces), last), "\n")
    gone = F.aggregate(cut, F.lit(0).cast("long"), lambda n, c: n + c["end"] - c["start"] + 1)
    same = F.col(cut).isNull()
    out = both.withColumn("n_deleted", F.when(same, F.lit(0)).otherwise(gone).cast("long")).withColumn(text, F.when(same, F.col(text)).otherwise(kept))
    return out.select(*[c for c in docs.columns if c != "n_deleted"], "n_deleted")
