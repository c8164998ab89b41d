"""Manifest, ranked search and exact dedup against plain versions, on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import exactdedup, lexical, merkle
from folioscope.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, position long, kept string, root string"


def documents(spark, rows, parts=3):
    """Rows (doc_id, text, lang, source, n_chars) with columns whose names the operators use too."""
    return spark.createDataFrame([(*r, 7, "k", "r") for r in rows], DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(leaves, fanout=8):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout=8):
    """(place, run) of each level below the last."""
    out = []
    for level in levels[:-1]:
        start = i // fanout * fanout
        out.append((i - start, level[start : start + fanout]))
        i //= fanout
    return out


def plain_manifest(rows, fanout=8):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf, tried = (sha("".join(field(v) for v in (i, source, lang, n, t))) for t in (text, text.translate(lower) if hit and text is not None else text))
        by[lang].append((i, leaf, tried))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (rows := sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1])), grow([r[1] for r in rows], fanout)) for g in langs}
    top = grow([trees[g][1][-1][0] for g in langs], fanout) if langs else []
    out = []
    for k, g in enumerate(langs):
        ranked, levels = trees[g]
        for j, (i, leaf, tried) in enumerate(ranked):
            steps, now, siblings = way(levels, j, fanout) + way(top, k, fanout), tried, ""
            for at, run in steps:
                siblings += "".join(run[:at] + run[at + 1 :])
                now = sha("".join([*run[:at], now, *run[at + 1 :]]))
            out.append((i, leaf, levels[-1][0], top[-1][0], sha(siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


ODD = [
    (5, "Text One", "en", "web", 8), (5, "Text One", "en", "web", 8), (5, "another", "en", "web", None), (None, "no id", "en", None, 5), (None, "no id", "en", None, 5), (6, None, "en", "web", None),
    (7, "", "en", "web", 0), (8, "é" * 50_000, "é", "ü", 1), (9, "lone", None, None, None), (10, "x", "", "", 0), (-3, "negative", "en", "-", -1),
]


def proofs(made):
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def tampered():
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))}


def many(n, langs, seed=3):
    r = random.Random(seed)
    return [(i, f"Text {r.randrange(10**6)}", r.choice(langs), "s", i) for i in range(n)]


@pytest.mark.parametrize("rows", [ODD, [(1, "A", "en", "s", 1)], many(700, ["en", "de"]), many(90, [f"l{i:03}" for i in range(70)])])
def test_manifest_equals_the_plain_one(spark, rows):
    assert proofs(merkle.document_manifest(documents(spark, rows), tampered=tampered())) == plain_manifest(rows)


@pytest.mark.parametrize("fanout, leaves, n, langs", [(2, 2, 61, ["a"]), (3, 3, 200, ["a", "b", None]), (8, 8, 1100, ["a", "a", "a", "b"] + [f"c{i}" for i in range(11)]), (4, 1, 70, ["x", "y", "z", "u", "v"])])
def test_partitions_of_any_size_agree(spark, fanout, leaves, n, langs):
    rows = many(n, langs)
    base = documents(spark, rows).select("doc_id", F.col("lang").alias("g"), merkle.leaf(["doc_id", "source", "lang", "n_chars", "text"]).alias("leaf"))
    made = merkle.manifest(base, ["doc_id"], fanout=fanout, leaves=leaves)
    want = plain_manifest(rows, fanout)
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got) == n and all(r["verified"] for r in got.values())
    assert {(i, leaf, sub, root, proof) for i, leaf, sub, root, proof, _, _ in want} == {(i, r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for i, r in got.items()}


def test_manifest_of_an_empty_table(spark):
    assert merkle.document_manifest(documents(spark, [])).count() == 0


def test_crc_of_the_tampered_rows(spark):
    rows = many(60, ["en"])
    got = {r["doc_id"]: r["verified"] for r in merkle.document_manifest(documents(spark, rows), tampered=tampered()).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 0}


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    held = [(i, Counter(ts), len(ts)) for i, text in docs if (ts := terms(text))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, length in held:
            m = 75 + (25 * length * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(n, seed=11, vocabulary=400, most=120):
    r = random.Random(seed)
    return [" ".join(f"W{int(vocabulary * r.random() ** 3)}" for _ in range(r.randrange(1, most))) for _ in range(n)]


@pytest.mark.parametrize("shard_docs, shard_terms, rows", [(10, 10**6, 3), (4096, 700, 256), (65536, 10**7, 1)])
def test_search_equals_brute_force(spark, monkeypatch, shard_docs, shard_terms, rows):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    docs = list(enumerate(texts(500)))
    docs += [(900, None), (901, ""), (902, " .,!"), (None, "W1 w1 W2"), (None, "w1 W1 w2"), (903, docs[3][1]), (903, docs[3][1]), (904, "É é straße ss_W5-W6"), (905, "w7 " * 30_000)]
    items = [(1, "w1 W2 w1, w3"), (2, None), (3, "..."), (4, "nothing here"), (5, docs[40][1] + " " + docs[41][1]), (6, "É straße"), (6, "w5"), (None, "w7"), (8, docs[3][1])]
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, term int").repartition(2)
    index = lexical.build_index(documents(spark, [(i, t, "en", "s", 0) for i, t in docs]), shard_docs=shard_docs, shard_terms=shard_terms)
    assert found(lexical.search(index, queries, rows=rows)) == plain_search(docs, items)


def test_search_reads_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    docs = [(1, "alpha beta-gamma " * 50 + "Ωmega"), (2, "beta"), (3, "x" * 500)]
    index = lexical.build_index(documents(spark, [(i, t, "en", "s", 0) for i, t in docs]))
    items = [(1, "beta alpha ωmega Ωmega"), (2, "x" * 500)]
    assert found(lexical.search(index, spark.createDataFrame(items, "item_id int, text string"))) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert lexical.search(lexical.build_index(documents(spark, [])), items).count() == 0
    assert lexical.search(lexical.build_index(documents(spark, [(1, "a", "en", "s", 1)])), items.filter("item_id = 2")).count() == 0


def test_block_maxima_reject_before_decoding():
    """A block of a frequent term that cannot lift a document into the heap stays packed."""
    rare, often = np.arange(0, 4000, 50), np.arange(4000)
    ids, names = list(range(4000)), {b"often": 0, b"rare": 1, b"pad": 2}
    held = [np.array([0] + [1] * (3 if i < 1000 else 1) * (i % 50 == 0) + [2] * (4 if i < 1000 else 400), np.int32) for i in ids]
    raw = lexical._raw_shard(0, ids, held, names)
    import types

    shard = lexical.Shard(types.SimpleNamespace(**lexical._sealed(types.SimpleNamespace(**raw), raw["n_docs"], raw["n_terms"])))
    asked = [(b"often", 1, shard.facts(b"often")[1]), (b"rare", 4000, 4000 * shard.facts(b"rare")[1])]
    old, lexical.WINDOW = lexical.WINDOW, 500
    try:
        top, best = shard.search(asked, 5)
    finally:
        lexical.WINDOW = old
    assert top.tolist() == rare[:5].tolist() and len(often) == 4000
    span = shard.blocks(b"often")
    assert sum(b in shard.read for b in range(*span)) < (span[1] - span[0]) // 2


def plain_copies(rows):
    by = defaultdict(list)
    for r, (i, text) in enumerate(rows):
        by[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((i is None, i or 0, r, i))
    out = []
    for body, members in by.items():
        best = min(members)
        out += [(i, best[3], len(members), sha(body)) for _, _, _, i in members]
    return sorted(out, key=str)


COPIES = [
    (3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a b"), (4, None), (5, ""), (6, " "), (7, "\n\t"), (8, "x" * 300_000), (9, "x" * 300_000), (None, "solo"), (None, "twin"), (None, "twin"), (10, "once"),
    (11, "same"), (11, "same"), (12, "same"), (13, "é x"), (14, "é x"),
]


@pytest.mark.parametrize("key", [None, lambda body: F.unhex((F.length(body) % 3).cast("string"))])
@pytest.mark.parametrize("spare, owner_rows", [(12, 1 << 20), (0, 3)])
def test_exact_copies(spark, monkeypatch, key, spare, owner_rows):
    """Also with keys that many texts share, hashes so short that they meet by chance, and several owners."""
    monkeypatch.setattr(exactdedup, "OWNER_HASHES", owner_rows)
    rows = COPIES + [(100 + i, f"t{i % 40}") for i in range(90)]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows], 5)
    made = exactdedup.groups_of_equal_texts(docs, key=key, spare_bits=spare)
    got = made.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain_copies(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert set(made.columns) == {*docs.columns, "keep_id", "group_size", "kept", "text_sha256"}


def test_exact_copies_of_one_text_and_of_none(spark):
    rows = [(i, "copy" if i % 3 else f"t{i}") for i in range(3000)]
    made = exactdedup.groups_of_equal_texts(documents(spark, [(i, t, "en", "s", 0) for i, t in rows], 20))
    assert made.filter("kept").count() == 1001 and made.filter("group_size = 2000 and keep_id = 1").count() == 2000
    assert exactdedup.groups_of_equal_texts(documents(spark, [])).count() == 0


def test_golomb_codes_round_trip():
    rng = np.random.default_rng(5)
    for values in ([], [0], [0, 0, 0], [5], list(range(1000)), sorted(rng.integers(0, 1 << 40, 5000).tolist()), [0, 1 << 36]):
        k, code = exactdedup.golomb_encode(np.array(values, np.int64))
        assert exactdedup.golomb_decode(k, len(values), code).tolist() == values
    spread = np.unique(rng.integers(0, 1 << 34, 20_000))
    assert len(exactdedup.golomb_encode(spread)[1]) * 8 < 22.5 * len(spread)  # against 64 bits of a plain hash
    for owners in (1, 3, 7):
        base = [exactdedup._base(o, 10, owners) for o in range(owners)]
        assert [next(o for o in reversed(range(owners)) if h >= base[o]) for h in range(1024)] == [(h * owners) >> 10 for h in range(1024)]


@pytest.mark.parametrize("name", ["op11_merkle", "op12_ranked_search", "op13_exact_dedup"])
def test_queries_are_registered(name):
    assert name in QUERIES
