"""Keyword scores summed within shards of pages give what rows of (query, page) give."""

import pytest

from folioscope.operators import search as S


def page(i, words):
    return (f"p{i:03d}" if i is not None else None, "one", [], " ".join(words))


@pytest.mark.parametrize("twice", [False, True])
def test_blocks_equal_rows(spark, monkeypatch, twice):
    words = [f"w{chr(97 + i)}{chr(97 + j)}rd" for i in range(6) for j in range(6)]
    rows = [page(i, [words[(i * i + j * (i % 5 + 1)) % 36] for j in range(12)]) for i in range(60)]
    rows += [page(100 + i, words[:4]) for i in range(20)]
    if twice:
        rows = rows * 2 + [page(None, words[:3])]  # ids repeat, one is null: some words are in more rows than there are pages
    pages = spark.createDataFrame(rows, "page_id string, title string, aliases array<string>, body string")
    asked = spark.createDataFrame([(i, [words[(i + 7 * j) % 36] for j in range(4)] + ["never"]) for i in range(40)] + [(None, words[:2])], "query_id long, words array<string>")
    index, size = S.postings(pages), (81 if twice else 80, 13.0)
    key = lambda r: (r["query_id"] is None, r["query_id"], r["rank"])
    want = sorted(S.bm25(asked, index, 5, size).collect(), key=key)
    for name, n in (("MANY_QUERIES", 1), ("KEYWORD_QUERY_BLOCK", 15), ("PAGE_SHARD", 30), ("FULL_ROW_CELLS", 200)):
        monkeypatch.setattr(S, name, n)
    found = S.bm25(asked, index, 5, size)
    got = sorted(found.collect(), key=key)
    assert [(r["query_id"], r["page_id"], r["rank"]) for r in got] == [(r["query_id"], r["page_id"], r["rank"]) for r in want] and len(got) == 205
    assert [r["score"] for r in got] == [None if r["score"] is None else pytest.approx(r["score"]) for r in want]
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_many_pairs_are_summed_in_shards(spark, monkeypatch):
    pages = spark.createDataFrame([page(i, ["alpha", f"word{i % 3}"]) for i in range(30)], "page_id string, title string, aliases array<string>, body string")
    asked = spark.createDataFrame([(i, [f"word{i % 3}", "alpha"]) for i in range(4)], "query_id long, words array<string>")
    want = [tuple(r) for r in S.bm25(asked, S.postings(pages), 3, (30, 3.0)).orderBy("query_id", "rank").select("query_id", "page_id", "rank").collect()]
    monkeypatch.setattr(S, "MANY_SCORES", 120)
    found = S.bm25(asked, S.postings(pages), 3, (30, 3.0))
    assert [tuple(r) for r in found.orderBy("query_id", "rank").select("query_id", "page_id", "rank").collect()] == want and len(want) == 12
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
