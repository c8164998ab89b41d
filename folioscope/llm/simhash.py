"""SimHash near copies by deletion-variant signatures: few segments, one wildcard bit in each, equality joins, then a check of the distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import durable

from .common import components, fresh, stored

BITS = 64


def fingerprint_column(text, words: int = 4):
    """The fingerprint of a text column as a signed long: bit by bit the majority of the XXH64 (seed 42) of all its word shingles.

    A-Z is lower-cased; texts of fewer words are one shingle; a text without a word, null included, has fingerprint zero.
    """

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        import numpy as np
        from xxhash import xxh64_digest

        def one(raw: bytes | None) -> int:
            w = raw.lower().split() if raw else []
            if not w:
                return 0
            n = max(1, len(w) - words + 1)
            ones = np.zeros(BITS, np.int64)
            for i in range(0, n, 1 << 16):  # bounded memory for texts of any length
                part = w[i : i + (1 << 16) + words - 1]
                grams = map(b" ".join, zip(*[part[k:] for k in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
                digests = b"".join([xxh64_digest(g, 42) for g in grams])
                ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
            return int(np.packbits(2 * ones > n).view(">i8")[0])

        return pd.Series([one(t) for t in texts], dtype="int64")

    return fingerprint(text.cast("binary"))


def _bounds(distance: int) -> list[tuple[int, int]]:
    """Segments so few that of `distance` differing bits one segment has one at most."""
    m = (distance + 2) // 2
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segments(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, s, x, low, high): each fingerprint once per segment s, with the segment's value x and bounds."""
    cut = [
        F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed((1 << high) - (1 << low)))).alias("x"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        for s, (low, high) in enumerate(_bounds(distance))
    ]
    return prints.select("fp", F.inline(F.array(*cut)))


def variants(values: DataFrame) -> DataFrame:
    """(p, masked, ...): for every bit p of a segment value, the value with that bit deleted. Two values share such a row if they differ in bit p alone."""
    spread = values.withColumn("p", F.explode(F.sequence("low", F.col("high") - 1)))
    return spread.withColumn("masked", F.expr("x & ~shiftleft(1L, p)"))


def _far(a, b):
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.bit_count(column(a).bitwiseXOR(column(b)))


BUCKET = ["s", "x", "y"]


def _centres(shared: DataFrame) -> DataFrame:
    """(s, x, y, pivot): of each bucket the member nearest to the bucket's majority, bit by bit."""
    ones = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    counted = shared.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"), *ones)
    centre = F.lit(0).cast("long")
    for b in range(BITS):
        centre = centre.bitwiseOR(F.shiftleft((2 * F.col(f"b{b}") > F.col("n")).cast("long"), b))
    middle = counted.select(*BUCKET, centre.alias("centre"))
    return shared.join(middle, BUCKET).groupBy(*BUCKET).agg(F.min_by("fp", F.struct(_far("fp", "centre"), "fp")).alias("pivot"))


def _print_links(prints: DataFrame, distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(direct, first, across): links (a, b) that buckets and their centres give, components (node, root) of these, and the links
    (f, g) between members of two such components (r, q) that share a bucket. All links are of `distance` bits or fewer.

    Prints are grouped by segment value, and values that differ in one bit meet in a row of `variants`, which at most two values share.
    Where a value has one print, or two of its own, the aggregate decides. The other values and pairs of values are buckets: every member
    is first linked to the most central member where it is near enough, and components are taken; this joins nearly all of a dense group
    by one row per member and bucket. What is left is decided exactly: where a bucket holds members of several components, those outside
    its largest component meet all members of another component, and each pair is verified. So links are lost nowhere, yet a group of n
    copies never makes n^2 pairs, and a hot bucket is one side of a join that Spark splits.
    """
    parts = segments(prints.select("fp"), distance)
    values = durable(parts.groupBy("s", "x", "low", "high").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("m")))
    side = F.struct("x", "lo", "m")
    met = variants(values).groupBy("p", "masked").agg(F.min("s").alias("s"), F.min(side).alias("a"), F.max(side).alias("b"), F.count(F.lit(1)).alias("n"))
    met = stored(met.filter("n = 2").filter((F.col("a.m") > 1) | (F.col("b.m") > 1) | (_far("a.lo", "b.lo") <= distance)), "simhash-values")
    single = (F.col("a.m") == 1) & (F.col("b.m") == 1)
    few = met.filter(single).select(F.col("a.lo").alias("a"), F.col("b.lo").alias("b"))
    few = few.union(values.filter((F.col("m") == 2) & (_far("lo", "hi") <= distance)).select("lo", "hi"))
    buckets = met.filter(~single).select("s", F.col("a.x").alias("x"), F.col("b.x").alias("y")).union(values.filter("m > 2").select("s", "x", F.col("x").alias("y")))
    of = buckets.select(*BUCKET, F.explode(F.array_distinct(F.array("x", "y"))).alias("v"))
    shared = stored(parts.select("fp", F.col("s").alias("_s"), F.col("x").alias("_x")).join(of, (F.col("_s") == F.col("s")) & (F.col("_x") == F.col("v"))).select(*BUCKET, "fp"), "simhash-members")
    starred = shared.join(_centres(shared), BUCKET)
    near = starred.filter((F.col("fp") != F.col("pivot")) & (_far("fp", "pivot") <= distance)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    direct = durable(few.union(near))
    first = components(direct)
    members = shared.join(first.select(F.col("node").alias("fp"), "root"), "fp", "left")
    members = members.withColumn("root", F.coalesce("root", "fp"))
    sizes = members.groupBy(*BUCKET, "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy(*BUCKET).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    open_ = durable(members.join(mixed, BUCKET))
    left = open_.select(*BUCKET, "main", F.col("fp").alias("f"), F.col("root").alias("r"))
    right = open_.filter("root <> main").select(*BUCKET, F.col("fp").alias("g"), F.col("root").alias("q"))
    apart = (F.col("r") != F.col("q")) & ((F.col("r") == F.col("main")) | (F.col("r") < F.col("q")))
    return direct, first, left.join(right, BUCKET).filter(apart & (_far("f", "g") <= distance)).select("f", "g", "r", "q")


def print_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links of `distance` bits or fewer between fingerprints `fp`, so many that they connect each class of `print_classes`."""
    direct, _, across = _print_links(prints, distance)
    one = across.groupBy("r", "q").agg(F.min(F.struct("f", "g")).alias("x")).select("x.f", "x.g")
    return direct.union(one)


def print_classes(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, class): classes of the distinct fingerprints `fp` that links of `distance` bits or fewer connect; class is their least print."""
    _, first, across = _print_links(prints, distance)
    second = components(across.select(F.col("r").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    joined = first.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("class"))
    alone = second.join(first, second["root"] == first["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("class"))
    classes = joined.union(alone).select(F.col("node").alias("fp"), "class")
    return prints.select("fp").join(classes, "fp", "left").select("fp", F.coalesce("class", "fp").alias("class"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`: component_id is the least id among the documents that links of `distance` bits reach.

    Equal texts share a fingerprint and are one point from the start. Null, empty and blank texts have fingerprint zero and link like any
    other. Rows with a null id are rows like others; a component that has only such rows has a null id. Other columns don't matter.
    """
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words).alias("fp")), "simhash-prints")
    prints = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = durable(print_classes(prints, distance))
    least = classes.join(prints, "fp").groupBy("class").agg(F.min("least").alias("component_id"))
    by_print = classes.join(least, "class").select("fp", "component_id")
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")


def later_rows(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (n, doc_id, th, fp) of `marked` that are not the first of their class: that of least (id, text hash, number), null ids last.

    `classes` (fp, class) need not name fingerprints that are alone in their class. Rows are told apart by their number `n`, never by id.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th", "n")
    prints = marked.groupBy("fp").agg(F.min(rank).alias("least"))
    prints = durable(prints.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp")))
    first = prints.groupBy("class").agg(F.min("least")["n"].alias("first"))
    return marked.join(prints.join(first, "class").select("fp", "first"), "fp").filter("n <> first").drop("first")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, unnamed_stay: bool = True) -> DataFrame:
    """`docs` with one row of each component of near copies: that of least id, also where rows repeat an id or an id has several texts.

    Rows without an id stay, or with `unnamed_stay` false are rows like others, after those with an id.
    """
    (number,) = fresh(docs, "_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    print_ = fingerprint_column(F.col(text), words).alias("fp")
    marked = stored(rows.select(F.col(number).alias("n"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), print_), "simhash-marked")
    gone = later_rows(marked, print_classes(durable(marked.select("fp").distinct()), distance))
    gone = gone.filter("doc_id is not null") if unnamed_stay else gone
    return rows.join(gone.select(F.col("n").alias(number)), number, "left_anti").select(*docs.columns)
