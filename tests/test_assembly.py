"""Edits of one batch against applying them one after the other, and page bodies against plain concatenation."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from folioscope.operators import assembly as A
from folioscope.operators import names as N
from folioscope.operators import pages as P

from conftest import page

TODAY = date(2024, 5, 1)
EDITS = "seq long, pos int, kind string, title string, aliases array<string>, description string, source_title string, is_private boolean"
RESERVED = {"home", "index", "log", "lint", "schema"}
ORDER = {"sources": 0, "concepts": 1, "entities": 2, "syntheses": 3}


def one_by_one(pages, edits, private):
    """State after the edits, by page title: (kind, aliases, summary, sources, section sources), and the dropped (seq, pos)."""
    state = {p["page_id"]: dict(p, sources=[s[2:-2] for s in p["sources"]], added=[]) for p in pages}
    new, dropped, arrived = 0, [], {}

    by_name = {}

    def enter(p):
        for name in (p["stem"], p["title"], *p["aliases"]):
            by_name.setdefault(name.lower(), {})[p["page_id"]] = p

    def find(name, kinds=tuple(ORDER)):
        hits = [p for p in by_name.get(name.lower(), {}).values() if p["kind"] in kinds and name.lower() in map(str.lower, (p["stem"], p["title"], *p["aliases"]))]
        return min(hits, key=lambda p: (ORDER[p["kind"]], p["path"])) if hits else None

    for p in state.values():
        enter(p)

    def aliases(names, own):
        return sorted({n for n in names if n and n != own and n.lower() not in RESERVED and ((o := find(n)) is None or o["title"] == own)})

    last = None
    for seq, pos, kind, title, offered, text, source, secret in sorted(edits, key=lambda e: e[:2]):
        if last is not None and last[0] != seq:  # the note of the source before is a page now
            enter(state.setdefault("s:" + last[1], dict(page("s:" + last[1], last[1], "sources"), sources=[], added=[])))
        last = (seq, source)
        if secret:
            private = private | {source}
        if not title or title.lower() == source.lower() or find(title, ("sources",)) or title.lower() in RESERVED:
            dropped.append((seq, pos))
            continue
        p = find(title, ("concepts", "entities", "syntheses"))
        if p is None:
            new += 1
            made = page(f"n:{new}", title, kind, summary=text)
            state[made["page_id"]] = dict(made, aliases=aliases(offered, title), sources=[source], added=[source], touched=True)
            enter(state[made["page_id"]])
            continue
        if not secret and p["sources"] and all(s in private for s in p["sources"]):
            p["summary"] = text
        if source not in p["sources"]:
            p["added"].append(source)
            p["sources"].append(source)
        p["aliases"], p["touched"] = aliases([*p["aliases"], *offered], p["title"]), True
        enter(p)
    touched = {p["title"]: (p["kind"], p["aliases"], p["summary"], sorted(p["added"])) for p in state.values() if p.get("touched")}
    return touched, sorted(dropped)


def random_edits(n, seed, words):
    r = random.Random(seed)
    rows, seq = [], 0
    while len(rows) < n:
        seq += 1
        source, secret = r.choice([f"src {seq}", f"src {seq}", r.choice(words)]) + ("" if r.random() < 0.5 else " note"), r.random() < 0.3
        for pos in range(r.randrange(1, 5)):
            title = r.choice(["Home", "", source, *[r.choice(words)] * 20])
            offered = [r.choice([*words, "index", title]) for _ in range(r.randrange(0, 4))]
            rows.append((seq, pos, r.choice(["concepts", "entities"]), title, offered, f"text {seq} {pos}", f"{source} {seq}", secret))
    return rows[:n]


def merged(spark, wiki, pages, rows, private):
    held = wiki(*pages)
    secret = spark.createDataFrame([(t,) for t in private], "title string")
    return P.merge_concepts(held, N.page_sources(held), spark.createDataFrame(rows, EDITS).repartition(3), secret, TODAY)


@pytest.mark.parametrize("n, seed, vocabulary", [(400, 1, 40), (400, 2, 150), (10_000, 3, 9_000)])
def test_a_batch_equals_its_edits_one_by_one(spark, wiki, n, seed, vocabulary):
    words = [f"w{i}" for i in range(vocabulary)]
    pages = [
        page(1, "w1", aliases=["w2", "w3"], sources=["mail 1"]), page(2, "w3", "entities", aliases=["w4"], sources=["mail 1", "open"]), page(3, "w5", "sources", aliases=["w6"]),
        page(4, "Asked", "syntheses", aliases=["w7", "w1"], sources=[]), page(5, "w8", aliases=["w9"], sources=["mail 2"], summary=None),
    ]
    pages[1]["aliases"] = ["w4", "home"]
    rows = random_edits(n, seed, words)
    secret = {f[6] for f in rows if f[7]} | {"mail 1", "mail 2"}
    want, dropped = one_by_one(pages, rows, {"mail 1", "mail 2"})
    done = merged(spark, wiki, pages, rows, ["mail 1", "mail 2"])
    added = {}
    for r in done["sections"].collect():
        added.setdefault(r["page_key"], []).append(r["source"])
    got = {r["title"]: (r["kind"], r["aliases"], r["summary"], sorted(added.get(r["page_key"], []))) for r in done["upserts"].collect()}
    if want != {k: got.get(k) for k in want}:
        print([(k, want[k], got.get(k)) for k in want if want[k] != got.get(k)][:3])
    assert set(got) == set(want) and secret
    assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
    assert {k: v[2] for k, v in got.items() if v[2] is not None} == {k: v[2] for k, v in want.items() if v[2] is not None}
    assert sorted((r["seq"], r["pos"]) for r in done["dropped"].collect()) == dropped


def test_a_chain_of_aliases_is_followed_to_its_end(spark, wiki):
    """Edit i names a page by the alias of edit i - 1 and brings the next alias."""
    rows = [(i, 0, "concepts", f"a{i}", [f"a{i + 1}"], "t", f"s{i}", False) for i in range(70)]
    done = merged(spark, wiki, [page(1, "other")], rows, [])
    assert [r["title"] for r in done["upserts"].collect()] == ["a0"] and done["sections"].count() == 70
    assert done["aliases"].count() == 70


def test_joined_pieces(spark):
    r = random.Random(4)
    rows = [(k, i, f"{k}{i}" + "é" * r.randrange(3)) for k, n in (("a", 1), ("b", 64), ("c", 65), ("d", 700), (None, 3)) for i in range(n)]
    rows += [("e", 1, None), ("e", 2, ""), ("e", 3, "x"), ("f", 1, None)]
    want = {}
    for k, _, t in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        if t is not None:
            want.setdefault(k, []).append(t)
    df = spark.createDataFrame(rows, "k string, i int, text string").repartition(5)
    for fan in (2, 64):
        got = {x["k"]: x["text"] for x in A.joined_pieces(df, ["k"], ["i", "text"], fan=fan).collect()}
        assert got == {k: "\n\n".join(v) for k, v in want.items()}
    assert A.joined_pieces(df.filter("k = 'none'"), ["k"], ["i"]).count() == 0


def test_assembled_bodies(spark):
    pages = spark.createDataFrame([(1, "Old", "# Old\n\nText", 0), (2, "New", None, 0), (3, "Other", "# Other", 0), (4, "Still", "# Still\n\n## Summary\nOld one.\n\n## Rest\nx", 0)], "page_id long, title string, body string, seq int")
    sections = spark.createDataFrame([(1, 7, 0, "S7", "later"), (1, 2, 1, "S2", "b"), (1, 2, 0, "S1", "a"), (2, 2, 3, "S1", "new"), (9, 1, 1, "S", "nobody")], "page_id long, seq long, pos int, source string, text string")
    callouts = spark.createDataFrame([(1, 2, 0, "> [!warning] differs"), (3, 1, 0, "> [!warning] alone")], "page_id long, seq long, pos int, text string")
    summaries = spark.createDataFrame([(2, "Short."), (4, "Newer."), (4, "Other"), (3, None)], "page_id long, summary string")
    bodies = A.assemble(pages, sections, callouts, summaries)
    got = {r["page_id"]: r["body"] for r in A.with_bodies(pages, bodies).collect()}
    assert got == {
        1: "# Old\n\nText\n\n## From [[S1]]\na\n\n## From [[S2]]\nb\n\n> [!warning] differs\n\n## From [[S7]]\nlater",
        2: "# New\n\n## Summary\nShort.\n\n## From [[S1]]\nnew", 3: "# Other\n\n> [!warning] alone", 4: "# Still\n\n## Summary\nNewer.\n\n## Rest\nx",
    }
    assert bodies.count() == 4 and A.with_bodies(pages, bodies).columns == pages.columns


def test_a_page_with_very_many_sections(spark):
    n = 6000
    pages = spark.createDataFrame([(i, f"P{i}", None) for i in range(50)], "page_id long, title string, body string")
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("page_id"), F.col("id").alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("S"), "id").alias("source"), F.lit("t").alias("text"))
    body = A.assemble(pages, rows).filter("page_id = 0").first()["body"]
    assert body.split("\n\n") == ["# P0", *[f"## From [[S{i}]]\nt" for i in range(n) if i % 3 == 0 or i % 50 == 0]]
