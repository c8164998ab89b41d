"""Near copies by similarity: SimHash links and, beyond their distance, MinHash bands propose pairs, the Jaccard similarity of the shingle sets decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import durable

from .common import components, forget_workers, fresh, stored
from .simhash import fingerprint_column, later_rows, print_links

#: Bands and minima in a band: a pair of similarity 0.8 meets in a band with a probability of 0.9996, one of 0.5 with 0.47.
BANDS, WIDTH = 20, 5
#: Members of a bucket that all others are compared with first: a bucket of n members gives 4n pairs, not n(n-1)/2.
#: Where that leaves a bucket with several components, the rest is settled pair by pair, see `left_open`.
PIVOTS = (0x0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D, 0x3C79AC492BA7B653)
#: Numbers of 64 bits that hold the parities of a shingle set.
PARITIES = 8


def _hashes(words: int):
    """Function from a text's bytes to the sorted distinct XXH64 (seed 42) of its shingles; words as in `simhash.fingerprint_column`."""

    def shingle_hashes(raw: bytes | None):
        import numpy as np
        from xxhash import xxh64_digest

        w = raw.lower().split() if raw else []
        grams = map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
        return np.unique(np.frombuffer(b"".join([xxh64_digest(g, 42) for g in grams]), ">u8").astype(np.uint64))

    return shingle_hashes


def sketch_column(text, words: int = 5):
    """(fp, size, bands, parity) of a text column: a hash of its shingle set, the number of shingles, a hash per band, and for each of 512 bins
    whether an odd number of shingles falls in it. Texts without a word are alike."""
    hashes_of = _hashes(words)

    @F.pandas_udf("fp long, size long, bands array<long>, parity array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        import numpy as np
        from xxhash import xxh64_intdigest

        draw = np.random.default_rng(7)
        a, b = (draw.integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        mix = draw.integers(0, 1 << 63, (BANDS, WIDTH), np.uint64) * np.uint64(2) + np.uint64(1)
        fps, sizes, bands, parity = [], [], [], []
        forget_workers()
        for raw in texts:
            h = hashes_of(raw)
            least = np.full(BANDS * WIDTH, ~np.uint64(0))
            for i in range(0, len(h), 1024):  # bounded memory for texts of any length
                least = np.minimum(least, (h[None, i : i + 1024] * a + b).min(axis=1))
            fps.append(int(np.uint64(xxh64_intdigest(h.tobytes(), 42)).view(np.int64)))
            sizes.append(len(h))
            bands.append((least.reshape(BANDS, WIDTH) * mix).sum(axis=1, dtype=np.uint64).view(np.int64))
            odd = np.bincount((h & np.uint64(64 * PARITIES - 1)).astype(np.intp), minlength=64 * PARITIES) & 1
            parity.append(np.packbits(odd).view(np.int64))
        series = {"bands": pd.Series(bands, dtype=object), "parity": pd.Series(parity, dtype=object)}
        return pd.DataFrame({"fp": pd.Series(fps, dtype="int64"), "size": pd.Series(sizes, dtype="int64"), **series})

    return sketch(text.cast("binary"))


def set_column(text, words: int = 5):
    """The distinct shingle hashes of a text column as longs."""
    hashes_of = _hashes(words)

    @F.pandas_udf("array<long>")
    def shingle_set(texts: pd.Series) -> pd.Series:
        return pd.Series([hashes_of(t).view("int64") for t in texts], dtype=object)

    return shingle_set(text.cast("binary"))


def candidates(points: DataFrame, similarity: float) -> DataFrame:
    """(a, b): fingerprints that share a band's bucket, each member of a bucket with its pivots. `points` is (fp, size, bands).

    Pairs whose sizes alone rule out the similarity are left out: it is at most the smaller size by the larger.
    """
    members = points.select("fp", "size", F.explode("bands").alias("v"))
    # xor with a mask is its own inverse: the least masked value names its member
    pick = lambda m: F.min(F.struct(F.col("fp").bitwiseXOR(F.lit(m)).alias("masked"), "size"))
    buckets = members.groupBy("v").agg(F.count(F.lit(1)).alias("n"), *[pick(m).alias(f"p{i}") for i, m in enumerate(PIVOTS)]).filter("n > 1")
    pivots = F.array(*[F.struct(F.col(f"p{i}.masked").bitwiseXOR(F.lit(m)).alias("fp"), F.col(f"p{i}.size").alias("size")) for i, m in enumerate(PIVOTS)])
    met = members.join(buckets.select("v", F.array_distinct(pivots).alias("pivots")), "v").select("fp", "size", F.explode("pivots").alias("p"))
    near = met.filter((F.col("fp") != F.col("p.fp")) & (F.least("size", "p.size") >= similarity * F.greatest("size", "p.size") - 1e-9))
    return near.select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b")).distinct()


def print_pairs(marked: DataFrame, distance: int) -> DataFrame:
    """(a, b): shingle sets `fp` of rows whose fingerprints `print` link at `distance` bits or fewer, by the joins of `simhash`.

    The least set of a fingerprint stands for it in links to others; the other sets of that fingerprint are paired with it.
    """
    prints = durable(marked.groupBy("print").agg(F.min("fp").alias("head")))
    equal = marked.select("print", "fp").distinct().join(prints, "print").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    linked = print_links(prints.select(F.col("print").alias("fp")), distance)
    head_of = lambda c: prints.select(F.col("print").alias(c), F.col("head").alias(f"{c}_head"))
    met = linked.join(head_of("a"), "a").join(head_of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return equal.union(met).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def left_open(points: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): fingerprints of different components (`roots`: node, root) that share a bucket and may have the similarity.

    In each bucket of several components the members outside the largest meet all members of other components. A pair leaves the join
    only if its sizes and parities allow the similarity: two sets that differ in d shingles differ in d parities at most, and d is at most
    (1 - s) / (1 + s) of the sum of the sizes. No pair of the similarity is lost by that.
    """
    members = points.select("fp", F.explode("bands").alias("v")).join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    members = durable(members.withColumn("root", F.coalesce("root", "fp")))
    sizes = members.groupBy("v", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("v").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    sketch = points.select("fp", "size", *[F.get("parity", F.lit(i)).alias(f"b{i}") for i in range(PARITIES)])
    open_ = durable(members.join(mixed, "v").join(sketch, "fp"))
    other = open_.filter("root <> main").select("v", *[F.col(c).alias(f"o_{c}") for c in ("fp", "size", "root", *[f"b{i}" for i in range(PARITIES)])])
    once = (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("main")) | (F.col("root") < F.col("o_root")))
    sized = F.least("size", "o_size") >= similarity * F.greatest("size", "o_size") - 1e-9
    differ = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(PARITIES)), F.lit(0))
    near = differ <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("o_size")) + 1e-9
    met = open_.join(other, (open_["v"] == other["v"]) & once & sized & near)
    return met.select(F.least("fp", "o_fp").alias("a"), F.greatest("fp", "o_fp").alias("b")).distinct()


def links(rows: DataFrame, points: DataFrame, pairs: DataFrame, number: str, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b): `pairs` whose shingle sets have a Jaccard similarity of `similarity` or more. Sets are worked out for these only."""
    asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = points.join(asked, "fp").select("fp", F.col("n").alias(number))
    sets = stored(rows.select(number, text).join(wanted, number).select("fp", set_column(F.col(text), words).alias("x")), "shingle-sets")
    both = pairs.join(sets.withColumnRenamed("fp", "a"), "a").join(sets.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def set_classes(rows: DataFrame, points: DataFrame, near: DataFrame, number: str, text: str, words: int, similarity: float) -> DataFrame:
    """(fp, class): classes of shingle sets that links connect. First by the pairs `near` (a, b) and the pivots of buckets, then what these
    left open between components."""
    pairs = durable(near.union(candidates(points, similarity)).distinct())
    first = components(links(rows, points, pairs, number, text, words, similarity))
    rest = durable(left_open(points, first, similarity))
    if rest.isEmpty():
        return first.select(F.col("node").alias("fp"), F.col("root").alias("class"))
    more = links(rows, points, rest, number, text, words, similarity)
    root_of = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joined = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    second = components(joined.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    known = first.join(second.withColumnRenamed("root", "top").withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("class"))
    alone = second.join(first, second["node"] == first["node"], "left_anti").select("node", F.col("root").alias("class"))
    return known.union(alone).select(F.col("node").alias("fp"), "class")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, print_words: int = 4, distance: int = 4) -> DataFrame:
    """`docs` with one row of each component of near copies: texts whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more.

    The row of least id stays (nulls last), also where rows repeat an id or an id has several texts. Every link is checked on the sets
    themselves; which pairs are checked is up to SimHash (`print_words`, `distance` bits, as in `simhash`) and, for pairs beyond that
    distance, MinHash: only a pair that neither links nor shares a band is missed, and no link is wrong. Equal
    sets, and texts without a word, are copies. Whole texts are read, of any length; columns of `docs` stay as they are, whatever their
    names. An empty table gives none.
    """
    (number,) = fresh(docs, "_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "shingle-rows")
    said = [fingerprint_column(F.col(text), print_words).alias("print"), sketch_column(F.col(text), words).alias("s")]
    sketched = rows.select(F.col(number).alias("n"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), *said)
    marked = stored(sketched.select("n", "doc_id", "th", "print", "s.*"), "shingle-marked")
    points = marked.groupBy("fp").agg(F.min("n").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    classes = set_classes(rows, points, print_pairs(marked, distance), number, text, words, similarity)
    gone = later_rows(marked.drop("print", "size", "bands", "parity"), classes)
    return rows.join(gone.select(F.col("n").alias(number)), number, "left_anti").select(*docs.columns)
