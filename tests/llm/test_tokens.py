"""Token files, packing, BPE by prefixes and sharding against the library and plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import bpe, packing, rangecoder, sharding, token_ids

SCHEMA = "doc_id long, text string, ids string, part int, start int, r long, g long, shard string, _text string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, 2, 3, 4, "b", "c", 5) for i, t in rows], SCHEMA)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnlé") for _ in range(r.randrange(1, 9))) + r.choice(["", "", ".", ",", "\n", "  "]) for _ in range(n))


ROWS = [(5, prose(300, 1)), (1, None), (2, ""), (9, prose(9000, 2)), (3, "a <|endoftext|> b"), (7, "  lead and trail  \n\n"), (8, "x"), (8, "x"), (None, "no id"), (4, "tab\tand odd  spaces\n \n  é中😀 it's 123,456")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = {n: Tokenizer.from_file(token_ids.tokenizer_path(n)) for n in (token_ids.TOKENIZER, bpe.TOKENIZER)}
    return lambda name, text: made[name].encode(text or "", add_special_tokens=False).ids, made


def test_chunks_encode_as_whole_texts(library):
    encode, _ = library
    coder = token_ids.ChunkEncoder(token_ids.tokenizer_path())
    r = random.Random(3)
    letters = "abcdefABC  \n\t.,'!?019é中😀  'sll"
    texts = [t or "" for _, t in ROWS] + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == encode(token_ids.TOKENIZER, text), text


def test_chunks_forgotten(library, monkeypatch):
    encode, _ = library
    coder = token_ids.ChunkEncoder(token_ids.tokenizer_path())
    monkeypatch.setattr(token_ids, "REMEMBERED", 50)
    for i in range(40):
        text = prose(30, i % 7)
        assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == encode(token_ids.TOKENIZER, text)


@pytest.mark.parametrize("kind", ["empty", "one", "zeros", "random", "top", "repeats"])
def test_blocks_round_trip(kind):
    r = np.random.default_rng(4)
    ids = {"empty": [], "one": [7], "zeros": [0] * 700, "random": r.integers(0, 65536, 900), "top": [65535] * 300, "repeats": list(range(100)) * 9}[kind]
    ids = np.array(ids, np.uint16)
    blocks = rangecoder.encode_blocks(ids, 128)
    assert np.array_equal(rangecoder.decode_blocks(blocks), ids)
    for i in range(len(blocks)):  # each block stands for itself
        assert np.array_equal(rangecoder.decode_blocks([blocks[i]]), ids[128 * i : 128 * i + 128])
    if kind == "repeats":
        assert sum(len(c) for *_, c in rangecoder.encode_blocks(ids, 1024)) < 900


def test_damaged_files_are_refused():
    data = rangecoder.file_bytes([(1, np.arange(500, dtype="<u2").tobytes()), (None, b""), (-3, b"\1\0")], 64)
    docs = rangecoder.parse_file(data)
    assert [(d, x.tolist()) for d, x in docs] == [(1, list(range(500))), (None, []), (-3, [1])]
    for bad in (data[:10], b"X" + data[1:], data[:-1], data[:60] + bytes([data[60] ^ 1]) + data[61:], data[:-40] + bytes([data[-40] ^ 255]) + data[-39:]):
        with pytest.raises((ValueError, zlib.error)):
            rangecoder.parse_file(bad)


def test_token_files(spark, library):
    encode, _ = library
    got = [tuple(r) for r in rangecoder.round_trip(table(spark, ROWS)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    at, want = 0, []
    for doc, text in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = encode(token_ids.TOKENIZER, text) + [0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert rangecoder.round_trip(table(spark, []).filter("doc_id = 1")).count() == 0


def test_small_files(spark, tmp_path, library):
    encode, _ = library
    files = rangecoder.write_files(table(spark, ROWS), f"file://{tmp_path}/ids", block=64, lanes=4)
    assert files.count() > 3
    assert sum(r["n_tokens"] for r in rangecoder.read_files(files).collect()) == sum(len(encode(token_ids.TOKENIZER, t)) + 1 for _, t in ROWS)


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_packing(spark, library, windows):
    encode, _ = library
    rows = ROWS + [(100 + i, prose(20 + 37 * i % 400, i)) for i in range(60)]
    pieces = packing.pack(table(spark, rows).repartition(7), length=256, windows=windows).collect()
    ids = defaultdict(list)
    for doc, text in rows:
        ids[doc].append(encode(token_ids.TOKENIZER, text) + [1])
    sizes, offsets = Counter(), defaultdict(list)
    for p in pieces:
        assert any(zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] and len(x) == p["doc_tokens"] for x in ids[p["doc_id"]])
        sizes[p["sequence_id"]] += p["length"]
        offsets[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(sizes.values()) == sum(len(x) for v in ids.values() for x in v)
    for found in offsets.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes.values()) and sum(n < 256 for n in sizes.values()) < 9
    covered = defaultdict(int)
    for p in pieces:
        covered[p["doc_id"]] += p["length"]
    assert covered == {d: sum(map(len, v)) for d, v in ids.items()}


def test_packing_nothing(spark):
    assert packing.pack(table(spark, []).filter("doc_id = 1")).count() == 0


def test_open_windows_stay_few():
    packer, r = packing.Packer(64, 5), random.Random(2)
    total = full = 0
    for i in range(500):
        n = r.randrange(1, 200)
        total += n
        for window in packer.add((i, 0, n, bytes(4 * n))):
            assert sum(len(p[3]) // 4 for p in window) == 64
            full += 64
        assert len(packer.held) <= 5
    assert total - full == sum(len(p[3]) // 4 for w in packer.leftovers() for p in w)


def test_prefix_encoder_equals_library(library):
    encode, made = library
    coder = bpe.PrefixEncoder(bpe.tokenizer_path())
    r = random.Random(5)
    names = list(coder.names.values())
    texts = [t or "" for _, t in ROWS] + ["<|startoftext|>Hi<|endoftext|>", "ΣΑΣ İstanbul ﬁ", "a" * 300, "hahaha" * 50, "it's WE'LL 'tis", "é é"]
    texts += ["".join(r.choice(names).replace("</w>", r.choice(["", " "])) for _ in range(12)) for _ in range(2000)]
    texts += ["".join(r.choice("etaoinsé中 '.!0123ABC\n") for _ in range(40)) for _ in range(2000)]
    for text in texts:
        ids, shown = coder.encode(text)
        want = encode(bpe.TOKENIZER, text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert shown.decode() == made[bpe.TOKENIZER].decode(want, skip_special_tokens=False)


def test_bpe_columns(spark, library):
    encode, made = library
    got = bpe.encode(table(spark, ROWS), ["doc_id", "label"]).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(encode(bpe.TOKENIZER, t))) for d, t in ROWS)
    for r in bpe.encode(table(spark, ROWS), ["doc_id", "text"], digests=True).collect():
        want = encode(bpe.TOKENIZER, r["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(made[bpe.TOKENIZER].decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(table(spark, []).filter("doc_id = 1"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("case", ["mixed", "one_group", "all_linked", "few", "none"])
def test_sharding(spark, case):
    r = random.Random(6)
    rows = {
        "mixed": [(i, f"t{i}") for i in range(200)] + [(300 + i, "hot") for i in range(120)] + [(500 + i, f"p{i // 3}") for i in range(90)] + [(None, None), (None, ""), (7, "t7")],
        "one_group": [(i, "same") for i in range(101)], "all_linked": [(i, f"g{r.randrange(30)}") for i in range(144)], "few": [(1, "a"), (2, "a"), (3, None)], "none": [],
    }[case]
    made = sharding.assign(table(spark, rows).filter("doc_id is null or doc_id >= 0"), shards=24)
    out = made.collect()
    assert Counter(x["doc_id"] for x in out) == Counter(d for d, _ in rows)
    counts = Counter(x["shard"] for x in out)
    assert all(0 <= s < 24 for s in counts)
    per = [counts[s] for s in range(24)]
    assert max(per) - min(per) <= 1
    for s in counts:
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(counts[s]))
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append((t or "").encode())
    assert all(any(x["text_crc32"] == zlib.crc32(t) and x["size"] == len(t) + 8 for t in texts[x["doc_id"]]) and x["law"] == "rows" and x["grown_shard"] is None for x in out)
    if case == "mixed":
        shards = defaultdict(Counter)
        for x in out:
            shards[x["group"]][x["shard"]] += 1
        small = [c for c in shards.values() if sum(c.values()) == 3]
        assert sum(len(c) == 1 for c in small) >= 0.8 * len(small)
        hot = next(c for c in shards.values() if sum(c.values()) == 120)
        assert len(hot) <= 14 and sum(sorted(hot.values())[-8:]) > 100  # 120 rows in shards of 17 need eight
        links = sharding.cut_links(made).first()
        assert links["cut"] < 0.9 * links["links"]
