"""Runs of a stream kept by level: the delta index and the dropped files, batch by batch, against plain versions of the same."""

import hashlib
import random

import pytest

from folioscope.operators import search as S
from folioscope.streaming import delta_index as D
from folioscope.streaming import drops as P
from folioscope.streaming import levels as L

PAGES = "page_id long, title string, aliases array<string>, body string, changed_at long, deleted boolean"


def test_runs_cover_every_batch_once():
    for fanout in (2, 3, 8):
        for n in range(200):
            runs = L.runs_before(n, fanout)
            held = [b for level, number in runs for b in range(number * fanout**level, (number + 1) * fanout**level)]
            assert held == list(range(n))
            assert all(sum(level == at for level, _ in runs) < fanout for at in range(10))
        written = set()
        for b in range(200):  # what is read was written by then, and every fold takes whole runs
            assert set(L.runs_before(b, fanout)) <= written
            written.add((0, b))
            for new, old in L.folds_after(b, fanout):
                assert set(old) <= written and len(old) == fanout
                written.add(new)


def changes(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for b in range(n):
        rows = []
        for _ in range(r.randrange(0, 7)):
            page = r.choice([None, *range(12)]) if r.random() < 0.1 else r.randrange(12)
            body = None if r.random() < 0.05 else " ".join(r.choices(words, k=r.randrange(0, 12)))
            rows.append((page, r.choice(words), [r.choice(words)], body, b * 10 + r.randrange(3), r.choice([None, False, False, True])))
        out.append(rows)
    return out


def newest(rows):
    best = {}
    for row in rows:
        page, title, aliases, body, at, deleted = row
        key = (at, bool(deleted), title, aliases, body is not None, body or "")
        if page is not None and (page not in best or key > best[page][0]):
            best[page] = (key, row)
    return {page: row for page, (_, row) in best.items()}


def test_index_of_fifty_batches_equals_a_rebuild(spark, tmp_path):
    path, batches, now = str(tmp_path / "index"), changes(50, 5), {}
    questions = spark.createDataFrame([(q, [f"w{q}", f"w{q + 7}", "absent"]) for q in range(6)], "query_id long, words array<string>")
    for b, rows in enumerate(batches):
        D.index_batch(spark, path, spark.createDataFrame(rows, PAGES), b, fanout=4)
        now.update(newest(rows))
        now = {page: row for page, row in now.items() if not row[5]}
        if b == 30:  # a batch tried again changes nothing
            D.index_batch(spark, path, spark.createDataFrame(rows, PAGES), b, fanout=4)
        if b in (17, 49):
            index = D.DeltaIndex(spark, path, fanout=4)
            assert len(index.runs) <= 3 * 4
            pages = spark.createDataFrame(list(now.values()), PAGES).fillna("", ["body"])
            rebuilt = S.postings(pages)
            assert sorted(map(tuple, index.postings().select(*rebuilt.columns).collect())) == sorted(map(tuple, rebuilt.collect()))
            n, mean = S.corpus_size(pages)
            assert index.pages == n == len(now) and abs(index.tokens - n * mean) < 1e-6
            assert {r.page_id for r in index.live_pages().collect()} == set(now)
            found = lambda df: sorted((r.query_id, r.rank, r.page_id, round(r.score, 9)) for r in df.collect())
            assert found(index.search(questions, 5)) == found(S.bm25(questions, rebuilt, 5, (n, mean)))


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    D.index_batch(spark, path, spark.createDataFrame([], PAGES), 0)
    D.index_batch(spark, path, spark.createDataFrame([(None, "a", [], "b", 1, False)], PAGES), 1)
    index = D.DeltaIndex(spark, path)
    assert (index.pages, index.tokens, index.postings().count()) == (0, 0, 0)
    assert index.search(spark.createDataFrame([(1, ["a"])], "query_id long, words array<string>"), 3).count() == 0


def test_dropped_files_in_batches(spark, tmp_path):
    inbox, out, rng = tmp_path / "inbox", str(tmp_path / "out"), random.Random(1)
    inbox.mkdir()
    kept, want = {}, set()
    for b in range(5):
        arrived = []
        for i in range(9):
            suffix = rng.choice([".md", ".PDF", ".txt", ".exe", ""])
            content = rng.choice([b"", b"same", b"see https://x.org/a", b"other %d" % rng.randrange(4), bytes([255, 254])])
            name = inbox / f"{rng.randrange(1000):03d}-{b}-{i}{suffix}"
            name.write_bytes(content)
            arrived.append((str(name), content))
        for name, content in sorted(arrived):
            if not content:
                continue  # Spark lists no empty files
            digest, suffix = hashlib.sha256(content).hexdigest(), name[len(str(inbox)) :].lower().rpartition(".")[2]
            usable = suffix in ("md", "pdf") or (suffix == "txt" and b"https" in content)
            verdict = "unsupported" if not usable else "duplicate" if digest in kept else "new"
            if usable:
                kept.setdefault(digest, name)
            want.add((name, len(content), digest, verdict, kept[digest] if usable else None, b))
        stream = P.drop_stream(spark, str(inbox))
        P.take_drops(stream, out, str(tmp_path / "ck"), fanout=2).start().awaitTermination()
    got = P.verdicts(spark, out)
    assert {tuple(r) for r in got.select("path", "length", "digest", "verdict", "first_path", "batch").collect()} == want and got.count() == len(want)
    assert {r.verdict for r in got.collect()} == {"new", "duplicate", "unsupported"}


def test_a_batch_of_drops_with_odd_rows(spark):
    schema = "path string, length long, content binary"
    rows = [("/b.md", 1, b"x"), ("/a.md", 1, b"x"), ("/a.md", 1, b"x"), ("/n.md", None, None), (None, 1, b"y"), ("/z.md", 0, b"")]
    judged, fresh = P.judge_files(spark.createDataFrame(rows, schema), spark.createDataFrame([], P.KEPT))
    got = sorted(((r.path or "", r.verdict, r.first_path or "") for r in judged.collect()))
    assert got == [("", "unsupported", ""), ("/a.md", "duplicate", "/a.md"), ("/a.md", "new", "/a.md"), ("/b.md", "duplicate", "/a.md"), ("/n.md", "unsupported", ""), ("/z.md", "new", "/z.md")]
    assert sorted(r.path for r in fresh.collect()) == ["/a.md", "/z.md"]
    none = P.judge_files(spark.createDataFrame([], schema), fresh)
    assert none[0].count() == 0 and none[1].count() == 0


def test_texts_of_single_rows_are_not_shuffled(spark):
    rows = [(1, "a", [], "one", 1, False), (2, "b", [], "two", 1, None)]
    alone = D.newest_rows(spark.createDataFrame(rows, PAGES))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_id, r.body, r.deleted) for r in alone.collect()) == [(1, "one", False), (2, "two", False)]
    more = D.newest_rows(spark.createDataFrame(rows + [(2, "b", [], "later", 2, False), (2, "b", [], "gone", 2, True), (None, "x", [], "y", 9, False)], PAGES))
    assert sorted((r.page_id, r.body, r.deleted) for r in more.collect()) == [(1, "one", False), (2, "gone", True)]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_folds_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(D, "DEAD_BROADCAST", most)
    monkeypatch.setattr(D, "TWICE_BROADCAST", most)
    path = str(tmp_path / "index")
    batches = [[(1, "a", [], "cat dog", 1, False), (2, "b", [], "dog", 1, False)], [(1, "a", [], "owl", 2, False), (1, "a", [], "cow", 3, False)], [(2, "b", [], "", 4, True), (3, "c", [], None, 4, False)]]
    for n, rows in enumerate(batches):
        D.index_batch(spark, path, spark.createDataFrame(rows, PAGES), n, fanout=2)
        index = D.DeltaIndex(spark, path, fanout=2)
        live = {0: {1: {"a", "cat", "dog"}, 2: {"b", "dog"}}, 1: {1: {"a", "cow"}, 2: {"b", "dog"}}, 2: {1: {"a", "cow"}, 3: {"c"}}}[n]
        got = {}
        for r in index.postings().collect():
            got.setdefault(r.page_id, set()).add(r.term)
        assert got == live and index.pages == len(live) and index.tokens == sum(map(len, live.values()))
    folded = spark.read.parquet(f"{path}/postings/level=1/run=0")
    assert {(r.term, r.page_id) for r in folded.collect()} == {("a", 1), ("cow", 1), ("b", 2), ("dog", 2)}
