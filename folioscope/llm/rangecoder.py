"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Every block of a file starts from a fresh model, so all blocks of a file are coded in step with each other: one numpy operation works on
the same place of every block ("lane"). A block's result does not depend on the other lanes.

The model of a lane. Order 2 and order 1 each keep, in a hashed table, the id that last followed the context and how often it did so in a
row. Two binary decisions ask whether the next id is the order-2 and else the order-1 prediction; their probability is a logistic mixture
(integer arithmetic, so every machine gets the same) of adaptive hit rates by the confidence of order 2, that of order 1, and the
order-0 frequency of the predicted id, with weights learnt as it goes. An id that neither predicts is coded by the order-0 model: four
nibbles, each with adaptive frequencies in the context of the nibbles before it.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import ordered_scan

from .common import read_file, shared_folder, stored, write_file
from .token_ids import encoded

BLOCK, LANES, END_ID = 4096, 2048, 0
MAGIC, HEAD = b"FSTC0001", "<8sIIQQ"
MANIFEST = "path string, part int, seq int, n_docs long, n_ids long"

_BITS, _ONE = 15, 1 << 15  # of probabilities
_LOW, _WORD = np.int64((1 << 32) - 1), np.int64(1 << 32)
_SLOTS, _COUNTS, _ROWS = 1 << 12, 1 << 11, (1, 16, 256, 512)
_SQUASH = np.array([round(_ONE / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int64).clip(32, _ONE - 32)
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4096 - p - 0.5))) for p in range(4096)], np.int64).clip(-2047, 2047)
_FREQUENT = np.array([min(7, n.bit_length()) for n in range(256)], np.intp)
_MIXIN = np.array([[i * 32 if i <= s else _ONE - (16 - i) * 32 for i in range(16)] for s in range(16)], np.int16)
_EVEN = (np.arange(16) * (_ONE // 16)).astype(np.int16)


class _Mix:
    """Adaptive rates of several kinds and the weights that mix them into one probability per lane."""

    def __init__(self, lanes: int, sizes: tuple[int, ...]):
        self.rates = [np.full(lanes * n, _ONE // 4, np.int32) for n in sizes]
        self.weights = [np.full(lanes, (1 << 16) // len(sizes) + (1 << 13), np.int64) for _ in sizes]
        self.base = [np.arange(lanes, dtype=np.intp) * n for n in sizes]

    def predict(self, lane: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        self.lane = lane
        self.at = [b[lane] + s for b, s in zip(self.base, states, strict=True)]
        self.p = [r[a] for r, a in zip(self.rates, self.at, strict=True)]
        self.st = [_STRETCH[p >> 3] for p in self.p]
        self.w = [w[lane] for w in self.weights]
        dot = self.w[0] * self.st[0]
        for w, s in zip(self.w[1:], self.st[1:], strict=True):
            dot += w * s
        dot >>= 16
        self.mixed = _SQUASH[np.clip(dot, -2047, 2047, out=dot) + 2047]
        return self.mixed

    def update(self, hit: np.ndarray) -> None:
        aim = hit.astype(np.int64) << _BITS
        step = (aim - self.mixed) * 6
        for r, a, p, w, now, s in zip(self.rates, self.at, self.p, self.weights, self.w, self.st, strict=True):
            r[a] = p + ((aim - p) >> 5)
            w[self.lane] = now + ((s * step) >> 14)


class _Model:
    def __init__(self, lanes: int):
        self.ids = [np.zeros(lanes * _SLOTS, np.uint16) for _ in range(2)]
        self.sure = [np.zeros(lanes * _SLOTS, np.uint8) for _ in range(2)]
        self.counts = np.zeros(lanes * _COUNTS, np.uint8)
        self.slot0, self.count0 = np.arange(lanes, dtype=np.intp) * _SLOTS, np.arange(lanes, dtype=np.intp) * _COUNTS
        self.rows = [np.tile(_EVEN, (lanes * n, 1)) for n in _ROWS]
        self.first, self.second = _Mix(lanes, (8, 16, 8)), _Mix(lanes, (8, 8))
        self.prev1 = self.prev2 = np.zeros(lanes, np.intp)


def _run(coder, n_ids: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Drive `coder` over all lanes; `ids` (lane, place) are given to an encoder, and returned from a decoder. Lanes come longest first.

    Each decision is taken for the lanes it concerns only.
    """
    lanes, longest = len(n_ids), int(n_ids.max(initial=0))
    model = _Model(lanes)
    out = np.zeros((longest, lanes), np.uint16)
    if ids is not None:
        out[:] = ids[:, :longest].T
    live = lanes - np.searchsorted(n_ids[::-1], np.arange(longest), side="right")
    frequent = lambda lane, c: _FREQUENT[model.counts[model.count0[lane] + (c & (_COUNTS - 1))]]
    for t in range(longest):
        n = int(live[t])
        p1, p2 = model.prev1[:n], model.prev2[:n]
        mixed = p1 * 40503
        at1 = model.slot0[:n] + ((mixed >> 4) & (_SLOTS - 1))
        at2 = model.slot0[:n] + (((mixed ^ (p2 * 30011)) >> 3) & (_SLOTS - 1))
        c1, c2 = model.ids[0][at1].astype(np.intp), model.ids[1][at2].astype(np.intp)
        s1, s2 = model.sure[0][at1], model.sure[1][at2]
        same = c1 == c2
        want = None if ids is None else out[t, :n].astype(np.intp)
        got = np.zeros(n, np.intp)
        open_ = np.ones(n, bool)
        # is it what followed these two ids?
        lane = np.flatnonzero(s2)
        if lane.size:
            c = c2[lane]
            p = model.first.predict(lane, [s2[lane].astype(np.intp), s1[lane].astype(np.intp) * 2 + same[lane], frequent(lane, c)])
            hit = coder.bit(lane, p, None if want is None else want[lane] == c)
            model.first.update(hit)
            got[lane[hit]] = c[hit]
            open_[lane[hit]] = False
        # or what followed the last one?
        lane = np.flatnonzero(open_ & (s1 > 0) & ~(same & (s2 > 0)))
        if lane.size:
            c = c1[lane]
            p = model.second.predict(lane, [s1[lane].astype(np.intp), frequent(lane, c)])
            hit = coder.bit(lane, p, None if want is None else want[lane] == c)
            model.second.update(hit)
            got[lane[hit]] = c[hit]
            open_[lane[hit]] = False
        # else the order-0 model names it
        lane = np.flatnonzero(open_)
        if lane.size:
            got[lane] = coder.id(lane, model.rows, None if want is None else want[lane])
        if ids is None:
            out[t, :n] = got
        for table, sure, at, c, s in ((model.ids[0], model.sure[0], at1, c1, s1), (model.ids[1], model.sure[1], at2, c2, s2)):
            table[at] = got
            sure[at] = np.where((c == got) & (s > 0), np.minimum(s + 1, 7), 1)
        spot = model.count0[:n] + (got & (_COUNTS - 1))
        seen = model.counts[spot]
        model.counts[spot] = seen + (seen < 255)
        model.prev2, model.prev1 = p1, got
    return out.T


def _learn(table: np.ndarray, row: np.ndarray, cdf: np.ndarray, nibble: np.ndarray) -> None:
    step = _MIXIN[nibble]
    step -= cdf
    step >>= 4
    step += cdf
    table[row] = step


class _Encoder:
    def __init__(self, lanes: int, longest: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.words, self.at = np.zeros((lanes, longest + 16), np.uint32), np.zeros(lanes, np.intp)

    def _emit(self, lane: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Hand out the top word of `low` (with a carry, perhaps, in bit 16); returns what stays of it."""
        at = self.at[lane]
        if int(at.max(initial=0)) + 1 >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[lane, at] = low >> 32
        self.at[lane] = at + 1
        return (low & _LOW) << 16

    def _narrow(self, lane: np.ndarray, low: np.ndarray, r: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        low += r * start
        r *= width
        which = np.flatnonzero(r < _WORD)
        if which.size:
            low[which] = self._emit(lane[which], low[which])
            r[which] <<= 16
        return r

    def bit(self, lane, p, hit):
        low = self.low[lane]
        self.range[lane] = self._narrow(lane, low, self.range[lane] >> _BITS, np.where(hit, 0, p), np.where(hit, p, _ONE - p))
        self.low[lane] = low
        return hit

    def id(self, lane, rows, want):
        low, size = self.low[lane], self.range[lane]
        for k, (table, n) in enumerate(zip(rows, _ROWS, strict=True)):
            nibble = (want >> (12 - 4 * k)) & 15
            row = lane * n + ((want >> (16 - 4 * k)) & (n - 1)) if k else lane
            cdf = table[row]
            flat = cdf.reshape(-1)
            at = np.arange(0, 16 * len(lane), 16) + nibble
            start = flat[at].astype(np.int64)
            end = flat[np.minimum(at + 1, 16 * len(lane) - 1)].astype(np.int64)
            end[nibble == 15] = _ONE
            size = self._narrow(lane, low, size >> _BITS, start, end - start)
            _learn(table, row, cdf, nibble)
        self.low[lane], self.range[lane] = low, size
        return want

    def finish(self) -> list[bytes]:
        everyone = np.arange(len(self.low))
        for _ in range(3):
            self.low = self._emit(everyone, self.low)
        words = self.words
        for j in range(int(self.at.max(initial=0)) - 1, 0, -1):
            words[:, j - 1] += words[:, j] >> 16
            words[:, j] &= 0xFFFF
        return [words[i, : self.at[i]].astype("<u2").tobytes() for i in range(len(words))]


class _Decoder:
    def __init__(self, words: list[np.ndarray]):
        longest = max(map(len, words), default=0)
        self.words = np.zeros((len(words), longest + 8), np.uint16)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
        self.at, self.range = np.full(len(words), 3, np.intp), np.full(len(words), 1 << 48, np.int64)
        first = self.words[:, :3].astype(np.int64)
        self.code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
        self.last = self.words.shape[1] - 1

    def _narrow(self, lane: np.ndarray, code: np.ndarray, r: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        code -= r * start
        r *= width
        which = np.flatnonzero(r < _WORD)
        if which.size:
            who = lane[which]
            at = self.at[who]
            code[which] = (code[which] << 16) | self.words[who, np.minimum(at, self.last)]
            self.at[who] = at + 1
            r[which] <<= 16
        return r

    def bit(self, lane, p, _):
        code, r = self.code[lane], self.range[lane] >> _BITS
        hit = code < r * p
        self.range[lane] = self._narrow(lane, code, r, np.where(hit, 0, p), np.where(hit, p, _ONE - p))
        self.code[lane] = code
        return hit

    def id(self, lane, rows, _):
        code, size = self.code[lane], self.range[lane]
        value = np.zeros(len(lane), np.intp)
        for k, (table, n) in enumerate(zip(rows, _ROWS, strict=True)):
            row = lane * n + (value & (n - 1)) if k else lane
            cdf = table[row]
            r = size >> _BITS
            aim = np.minimum(code // r, _ONE - 1).astype(np.int16)
            nibble = np.bitwise_count((cdf <= aim[:, None]).view(np.uint64)).sum(axis=1, dtype=np.intp) - 1
            flat = cdf.reshape(-1)
            at = np.arange(0, 16 * len(lane), 16) + nibble
            start = flat[at].astype(np.int64)
            end = flat[np.minimum(at + 1, 16 * len(lane) - 1)].astype(np.int64)
            end[nibble == 15] = _ONE
            size = self._narrow(lane, code, r, start, end - start)
            _learn(table, row, cdf, nibble)
            value = value * 16 + nibble
        self.code[lane], self.range[lane] = code, size
        return value


def _lanes(n_ids: int, block: int) -> np.ndarray:
    """Sizes of the blocks of a stream; only the last is shorter, so they come longest first."""
    sizes = [block] * (n_ids // block) + ([n_ids % block] if n_ids % block else [])
    return np.array(sizes, np.int64)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of them as unsigned 32-bit numbers, code) of each block."""
    sizes = _lanes(len(ids), block)
    if not len(sizes):
        return []
    grid = np.zeros((len(sizes), block), np.uint16)
    grid.reshape(-1)[: len(ids)] = ids
    coder = _Encoder(len(sizes), block)
    _run(coder, sizes, grid)
    crc = [zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(len(sizes))]
    return list(zip(sizes.tolist(), crc, coder.finish(), strict=True))


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of all blocks (any subset, the longest first); raises ValueError where a block's checksum differs."""
    if not blocks:
        return np.zeros(0, np.uint16)
    sizes = np.array([b[0] for b in blocks], np.int64)
    grid = _run(_Decoder([np.frombuffer(b[2], "<u2") for b in blocks]), sizes, None)
    rows = [np.ascontiguousarray(grid[i, :n]) for i, n in enumerate(sizes.tolist())]
    for i, (row, b) in enumerate(zip(rows, blocks, strict=True)):
        if zlib.crc32(row.astype("<u4").tobytes()) != b[1]:
            raise ValueError(f"block {i}: checksum differs")
    return np.concatenate(rows)


def file_bytes(docs: list[tuple[int | None, bytes]], block: int = BLOCK) -> bytes:
    """One file: head, index of documents (id, null flag, number of ids) and blocks (ids, code bytes, checksum), its checksum, the code."""
    ids = np.frombuffer(b"".join(raw for _, raw in docs), "<u2")
    blocks = encode_blocks(ids, block)
    index = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes()
    index += np.array([len(raw) // 2 for _, raw in docs], "<u4").tobytes() + np.array([(n, len(code), crc) for n, crc, code in blocks], "<u4").tobytes()
    packed = zlib.compress(index, 6)
    head = struct.pack(HEAD, MAGIC, len(docs), len(blocks), len(packed), zlib.crc32(packed))
    return b"".join([head, packed, *[code for _, _, code in blocks]])


def parse_file(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a file with their ids, in file order; raises ValueError where the format or a checksum is broken."""
    if len(data) < struct.calcsize(HEAD):
        raise ValueError("not a token file")
    magic, n_docs, n_blocks, size, crc = struct.unpack_from(HEAD, data)
    packed = data[struct.calcsize(HEAD) : struct.calcsize(HEAD) + size]
    if magic != MAGIC or zlib.crc32(packed) != crc:
        raise ValueError("not a token file, or its index is damaged")
    index = zlib.decompress(packed)
    names = np.frombuffer(index, "<i8", n_docs)
    empty = np.frombuffer(index, "u1", n_docs, 8 * n_docs)
    lengths = np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
    table = np.frombuffer(index, "<u4", 3 * n_blocks, 13 * n_docs).reshape(-1, 3)
    at, blocks = struct.calcsize(HEAD) + size, []
    for n, nbytes, check in table.tolist():
        blocks.append((n, check, data[at : at + nbytes]))
        at += nbytes
    if at != len(data):
        raise ValueError("the file has another length than its index says")
    ids = decode_blocks(blocks)
    ends = np.cumsum(lengths, dtype=np.int64)
    return [(None if none else int(d), ids[e - n : e]) for d, none, n, e in zip(names.tolist(), empty.tolist(), lengths.tolist(), ends.tolist(), strict=True)]


def write_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, path: str | None = None, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """Encode whole texts, append `end_id`, and write the ids in ascending order of ids to files in `folder`; returns the manifest.

    Ranges of ids go to tasks, which write files of at most `block` x `lanes` ids, or one document where it has more. A task that runs
    again writes under new names, and the manifest has the names of the attempt that ended. Ids that repeat are ordered by text, nulls
    come first.
    """
    end = end_id.to_bytes(2, "little")

    def run(batches):
        from pyspark import TaskContext

        part, held, size, seq = TaskContext.get().partitionId(), [], 0, 0

        def close():
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            write_file(name, file_bytes(held, block))
            return pd.DataFrame({"path": [name], "part": [part], "seq": [seq], "n_docs": [len(held)], "n_ids": [size]})

        for pdf in batches:
            for doc, raw in zip(pdf["doc_id"], encoded(pdf["text"], path), strict=True):
                n = len(raw) // 2 + 1
                if held and size + n > block * lanes:
                    yield close()
                    held, size, seq = [], 0, seq + 1
                held.append((None if pd.isna(doc) else int(doc), raw + end))
                size += n
        if held:
            yield close()

    ranged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInPandas(run, MANIFEST), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest; `start` counts the ids of all documents before."""
    n = max(1, manifest.count())
    based = ordered_scan(manifest, ["part", "seq"], sums={"base": "n_ids"}).select("path", "base").repartition(n)

    def run(batches):
        for pdf in batches:
            for name, base in zip(pdf["path"], pdf["base"], strict=True):
                docs = parse_file(read_file(name))
                sizes = np.array([len(ids) for _, ids in docs], np.int64)
                out = pd.DataFrame({"doc_id": [d for d, _ in docs], "start": int(base) + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in docs]})
                yield out.astype({"doc_id": "Int64"})

    return based.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the token files of `docs` and read them back: one row per row of `docs`. A null or empty text is its end id alone."""
    return read_files(write_files(docs, shared_folder(docs.sparkSession, "token-files"), doc_id, text, end_id, path))
