"""WARC archives and exact top-k search on odd tables, against plain versions."""

import base64
import hashlib
import struct

import numpy as np
import pytest
import zstandard

from folioscope.llm import maxscore, warc

PAGES = "page_id long, url string, html string, payload string, uri string, chosen int, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], PAGES)


ROWS = [
    (1, "http://a/x", "<p>one</p>"), (2, "http://a/y z\r\nEvil: 1", "<p>one</p>"), (3, None, None), (4, "http://b", ""), (5, "é", "é" * 200_000), (6, "http://c", "two\r\n\r\nthree"),
    (7, "http://c", "two\r\n\r\nthree"), (7, "http://c", "two\r\n\r\nthree"), (None, "http://d", "<p>one</p>"), (None, "http://e", "no id"), (8, "http://f", "x" * 70),
]


def plain(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        best = max((j for j, _, h in rows if (h or "").encode() == body and j is not None), default=None)
        refers = None if best == i else best
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    got = [tuple(r) for r in warc.round_trip(pages(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == plain(ROWS)
    assert warc.round_trip(pages(spark, []).filter("page_id = 1")).count() == 0


def test_small_payloads_stay_responses(spark):
    got = {r["page_id"]: r["record_type"] for r in warc.mark_revisits(pages(spark, ROWS), least=11).collect()}
    assert got[1] == "response" and got[3] == "response" and got[6] == "revisit"


def test_many_archives_with_dictionary(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body><p>the same frame around {i * 7919}</p></body></html>" * 5) for i in range(300)]
    dictionary = warc.train_dictionary(warc.mark_revisits(pages(spark, rows)))
    assert dictionary
    made = warc.write_archives(warc.mark_revisits(pages(spark, rows)), f"file://{tmp_path}/warc", dictionary, archive_bytes=4 + len(dictionary) + 2000)
    assert made.count() > 4 and sum(r["records"] for r in made.collect()) == 300
    assert {r["page_id"] for r in warc.read_archives(made).collect()} == set(range(300))


def record(**more):
    a = dict(page_id=1, url="http://a", payload=b"hello", size=5, digest=warc.digest_of(b"hello"), kind="response", refers_to=None, date="2020-01-01T00:00:00Z") | more
    return warc.record_bytes(*a.values())


def archive(raw, dictionary=b"", **how):
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + zstandard.ZstdCompressor(dict_data=kept, write_checksum=True, **how).compress(raw)


def test_reader_validates():
    good = record()
    assert [r[:4] for r in warc.read_archive(archive(good) + archive(record(page_id=2, kind="revisit", refers_to=1)))] == [(1, "http://a", "response", 5), (2, "http://a", "revisit", 5)]
    held = zstandard.train_dictionary(2048, [record(page_id=i, payload=b"body %d" % i, size=len(b"body %d" % i), digest=warc.digest_of(b"body %d" % i)) for i in range(400)]).as_bytes()
    squeezed = zstandard.ZstdCompressor().compress(held)
    with_dict = archive(good, held)
    assert [r[0] for r in warc.read_archive(with_dict)] == [1]
    assert [r[0] for r in warc.read_archive(struct.pack("<II", warc.DICTIONARY_MAGIC, len(squeezed)) + squeezed + with_dict[8 + len(held) :])] == [1]
    bad = [
        good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"hello", b"hallo"), good[:-1], good + b"x",
        good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"response", b"strange1"), record(size=4), record(digest="A" * 32),
    ]
    for raw in bad:
        with pytest.raises(warc.InvalidArchive):
            list(warc.read_archive(archive(raw)))
    whole = archive(good)
    for broken in (whole[:-1], whole[:20], b"\0" * 9, whole + b"junk", with_dict[:50], whole[:30] + bytes([whole[30] ^ 255]) + whole[31:], with_dict[8 + len(held) :]):
        with pytest.raises(warc.InvalidArchive):
            list(warc.read_archive(broken))


@pytest.mark.parametrize("size", [1, 131_072 * 3 + 5])
def test_frame_ends(size):
    rng = np.random.default_rng(1)
    for raw in (b"a" * size, rng.integers(0, 256, size).astype(np.uint8).tobytes()):
        for how in ({}, {"write_checksum": True}, {"write_content_size": False}):
            frame = zstandard.ZstdCompressor(**how).compress(raw)
            assert warc.frame_end(memoryview(frame + b"rest"), 0) == len(frame)


VECTORS = "vec_id long, embedding array<float>, id long, v string, part int, block int, shard string"


def plain_top(rows, k, scale=1024):
    import math

    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = min(x for i, x in ok if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shape", [(300, 64), (50, 3), (5, 2)])
def test_top_k_is_exact(spark, shape):
    rng = np.random.default_rng(shape[0])
    base = rng.normal(size=shape) / 8
    rows = [(int(10 * i), [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(3, None), (13, [None] + [0.5] * (shape[1] - 1)), (23, [float("nan")] * shape[1]), (33, [float("inf")] * shape[1]), (None, [9.0] * shape[1]), (43, rows[1][1]), (41, rows[1][1]), (44, rows[1][1]), (44, rows[1][1]), (53, [0.0] * shape[1]), (63, []), (900, [-0.1] * shape[1])]
    df = spark.createDataFrame([(i, v, 1, "a", 2, 3, "b") for i, v in rows], VECTORS).repartition(3)
    vectors = maxscore.integer_vectors(df)
    for block, size in ((1024, 8192), (2, 40)):
        got = sorted(tuple(r) for r in maxscore.search(vectors.filter("id % 100 = 0"), vectors, 10, block, size).collect())
        assert got == plain_top(rows, 10)


def test_non_essential_terms_are_probed():
    rng = np.random.default_rng(3)
    data = rng.integers(-500, 500, (6000, 12)) * np.array([40, 20, 10, 5, 3, 2, 1, 1, 1, 1, 1, 1])
    shard = maxscore.Shard(np.arange(6000), data, 12)
    for own in range(0, 6000, 500):
        rows, score = shard.search(own, data[own], 10)
        every = data @ data[own]
        every[own] = -(2**60)
        want = np.lexsort((np.arange(6000), -every))[:10]
        assert rows.tolist() == want.tolist() and score.tolist() == every[want].tolist()


def test_large_components_and_empty_tables(spark):
    rows = [(0, [4000.0, -3000.5]), (1, [3999.0, 1.0]), (2, [-4000.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "a", 2, 3, "b") for i, v in rows], VECTORS)
    v = maxscore.integer_vectors(df)
    assert [tuple(r) for r in maxscore.search(v.filter("id = 0"), v).collect()] == plain_top(rows, 10)
    assert maxscore.search(v.filter("id = 77"), v).count() == 0 and maxscore.search(v.filter("id = 77"), v.filter("id = 78")).count() == 0
