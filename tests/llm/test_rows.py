"""Stages that drop rows decide row by row: null, repeated and reused ids. Near copies by similarity, class counts of all labels."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import shingles, simhash, toxicity

from test_texts import table, toxic_table, words

A, B, C = (" ".join(words(120, s, 5000)) for s in (71, 72, 73))


def test_keep_first_decides_per_row(spark):
    rows = [(3, B), (5, A), (5, B), (6, A), (7, C), (7, C), (None, C), (None, A)]
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(table(spark, rows), unnamed_stay=False).collect())
    assert got == sorted([(3, B), (5, A), (7, C)])
    stay = simhash.keep_first(table(spark, rows)).collect()
    assert sorted(r["text"] for r in stay if r["doc_id"] is None) == sorted([A, C]) and len(stay) == 5
    alone = simhash.keep_first(table(spark, [(None, A), (None, A)]), unnamed_stay=False)
    assert alone.count() == 1 and alone.columns == table(spark, []).columns


def test_drop_toxic_decides_per_row(spark):
    rows, labels = toxic_table(400)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bad, good = rows[4][1], rows[5][1]
    odd = [(9001, bad), (9001, good), (None, bad), (None, good), (9002, bad), (9002, bad), (9003, None)]
    left = toxicity.drop_toxic(table(spark, rows + odd), marks)
    assert left.columns == table(spark, []).columns
    got = [(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] is None or r["doc_id"] > 9000]
    assert sorted(got, key=str) == sorted([(9001, good), (None, good), (9003, None)], key=str)


def near_pairs(n, seed):
    """Texts of 225 distinct words and copies with some replaced; (text, copy, similarity of their 5-word shingle sets), similarity from 0.8 to 0.96."""
    r, out = random.Random(seed), []
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    while len(out) < n:
        ws = [f"w{r.randrange(10**9)}" for _ in range(225)]
        other = list(ws)
        for _ in range(r.randrange(1, 6)):
            other[r.randrange(225)] = f"v{r.randrange(10**9)}"
        a, b = grams(ws), grams(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.96:
            out.append((" ".join(ws), " ".join(other), len(a & b) / len(a | b)))
    return out


def test_near_copies_from_the_asked_similarity_on(spark):
    pairs = near_pairs(300, 1)
    base = words(225, 9, 10**6)
    far = base[:150] + words(75, 10, 10**6)  # about 0.49
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)] + [(9000, " ".join(base)), (9001, " ".join(far))]
    rows += [(9100, None), (9101, " \n"), (9102, ""), (None, ""), (9103, "one two"), (9103, "ONE  two"), (None, None)]
    docs = table(spark, rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in shingles.keep_first(docs).collect()), key=str)
    copies = [i for i, _ in kept if i is not None and i < 9000 and i % 2]
    print("recall", 1 - len(copies) / len(pairs), "of", len(pairs))
    assert len(copies) <= 3 and {2 * i for i in range(300)} <= {i for i, _ in kept}
    assert [i for i, _ in kept if i is None or i >= 9000] == [9000, 9001, 9100, 9103] and shingles.keep_first(docs.filter("doc_id = -1")).count() == 0


def passage_pairs(n, seed=5, words_each=225, shared=180):
    """Pairs of similarity 0.82 or so whose texts all share a passage of `shared` words; texts of different pairs are at about 0.65."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        own = [f"o{r.randrange(10**9)}" for _ in range(words_each - shared)]
        other = list(own)
        for k in (5, 16, 27, 38):
            other[k] = f"x{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    return rows


@pytest.mark.parametrize("n", [50, 300])
def test_near_copies_in_one_large_bucket(spark, n):
    """A passage puts very many texts in the same buckets; each still finds its own copy."""
    kept = [r["doc_id"] for r in shingles.keep_first(table(spark, passage_pairs(n))).collect()]
    copies = sum(i % 2 for i in kept)
    print("left", copies, "of", n)
    assert {2 * i for i in range(n)} <= set(kept) and copies <= n // 100


def test_near_copies_with_clashing_columns(spark):
    rows = table(spark, passage_pairs(3))
    rows = rows.select("*", *[F.lit(1).alias(c) for c in ("fp", "class", "_number", "bands", "parity", "size", "n", "th") if c not in rows.columns])
    left = shingles.keep_first(rows)
    assert left.columns == rows.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2, 4]
    long = [(1, "a b c d e " * 40_000), (2, "a b c d e " * 40_001), (3, "q " + "a b c d e " * 40_000)]
    assert sorted(r["doc_id"] for r in shingles.keep_first(table(spark, long)).collect()) == [1]


def test_toxicity_counts_every_label(spark):
    rows = [(i, f"ab{i} cd") for i in range(60)]
    docs = table(spark, rows + [(70, "plain"), (None, "none")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole, sliced = toxicity.count(docs, labels, (-1, 0, 1)), toxicity.count(docs, labels, (-1, 0, 1), slice_rows=7)
    assert key(sliced.filter("grp >= 0")) == key(whole.filter("grp >= 0")) and key(sliced.filter("grp < 0")) == key(whole.filter("grp < 0"))
    letters = lambda odd: sum(len(w) + 1 for i, t in rows if i % 2 == odd for w in t.split())
    assert {r["grp"]: r["n"] for r in sliced.filter("grp >= 0").groupBy("grp").agg(F.sum("n").alias("n")).collect()} == {0: letters(0), 1: letters(1)}
    assert not hasattr(toxicity, "TRAIN_ROWS")


def test_toxicity_tables_follow_the_grams(spark, monkeypatch):
    docs = table(spark, [(i, " ".join(f"{x}{i}" for x in ("ax", "by", "cz"))) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, label int")
    counted = toxicity.count(docs, labels, (-1, 0, 1))
    assert toxicity.table_slots(counted) == (toxicity.CLASS_SLOTS, toxicity.SHARED_SLOTS)
    monkeypatch.setattr(toxicity, "CLASS_SLOTS", 8)
    monkeypatch.setattr(toxicity, "SHARED_SLOTS", 8)
    wide, shared = toxicity.table_slots(counted)
    assert wide >= 2 * counted.filter("grp = 0").select("slot").distinct().count() * 0.9 and shared > 8
    model = toxicity.build(counted)
    assert len(model.labels[1][0]) == wide and len(model.shared[2][0]) == shared


def test_simhash_links_reach_the_near_copy_stage(spark, monkeypatch):
    """With no pair from the bands, copies within 4 bits still go, each link decided by the sets; prints link texts whose sets differ too much."""
    r = random.Random(5)
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    near = [" ".join(words), " ".join([*words[:399], "other"]), " ".join(["first", *words[1:]])]
    loud = "so "
    shouted = [loud * 3000 + " ".join(words[:150]), loud * 3000 + " ".join(reversed(words[:150]))]
    rows = spark.createDataFrame(list(enumerate(near + shouted + [None, ""], 1)), "doc_id long, text string")
    prints = [x["p"] for x in rows.select(simhash.fingerprint_column(F.col("text")).alias("p")).collect()]
    far = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()
    assert far(0, 1) <= 4 and far(0, 2) <= 4 and far(3, 4) <= 4
    monkeypatch.setattr(shingles, "candidates", lambda points, similarity: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(shingles, "left_open", lambda points, roots, similarity: spark.createDataFrame([], "a long, b long"))
    assert sorted(x["doc_id"] for x in shingles.keep_first(rows).collect()) == [1, 4, 5, 6]
