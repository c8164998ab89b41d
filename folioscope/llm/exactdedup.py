"""Exact dedup by exchanged fingerprints: partitions send sorted, Golomb-coded hashes to their owners and get bitmaps of repeats back.

Only rows that a bitmap marks (suspects) move their text, and texts alone decide. What travels for all other rows is a hash of some
twenty bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, file_system, fresh, per_worker, shared_folder, stored

#: Hashes that one owner compares (mean), rows of a sender's message round, bits of a hash beyond the logarithm of the number of rows.
OWNER_HASHES, SENDER_ROWS, SPARE_BITS = 1 << 20, 1 << 20, 12


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(k, code) of ascending integers from 0 on: differences by a Golomb code with the power of two 2^k as parameter.

    The quotients stand first, each as that many zeros and a one, then the remainders of k bits each.
    """
    gaps = np.diff(values, prepend=0).astype(np.int64)
    mean = float(gaps.mean()) if len(gaps) else 0.0
    k = max(0, int(math.log2(mean * math.log(2)))) if mean * math.log(2) >= 1 else 0
    high = gaps >> k
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(k: int, n: int, code: bytes) -> np.ndarray:
    """The n values of a code."""
    if not n:
        return np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    high = np.diff(ends, prepend=-1) - 1
    start = (int(ends[-1]) // 8 + 1) * 8
    low = bits[start : start + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((high.astype(np.int64) << k) + low)


def _sender(bits: int, owners: int):
    """Task of a sender: hashes of its rows, part by part, in messages (part, owner, n, k, code, repeated)."""
    columns = ["part", "owner", "n", "k", "code", "repeated"]

    def messages(part: int, hashes: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        owner = (values * owners) >> bits
        for o in np.unique(owner):
            a, b = np.searchsorted(owner, [o, o + 1])
            k, code = golomb_encode(values[a:b] - _base(int(o), bits, owners))
            yield part, int(o), b - a, k, code, np.packbits(counts[a:b] > 1).tobytes()

    def send(batches):
        held, part, size = [], None, 0
        for pdf in batches:
            parts, hashes = pdf["part"].to_numpy(), pdf["h"].to_numpy()
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for p, h in zip(parts[np.r_[0, cuts]] if len(parts) else [], np.split(hashes, cuts), strict=False):
                if held and (p != part or size + len(h) > SENDER_ROWS):
                    yield pd.DataFrame(messages(part, held), columns=columns)
                    held, size = [], 0
                held, part, size = [*held, h], int(p), size + len(h)
        if held:
            yield pd.DataFrame(messages(part, held), columns=columns)

    return send


def _base(owner: int, bits: int, owners: int) -> int:
    """The least hash of an owner."""
    return -((-owner << bits) // owners)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Task of an owner: a bitmap for each message, set where the hash stands in another message too or is repeated in its own."""
    lists = [golomb_decode(k, n, code) for k, n, code in zip(pdf["k"], pdf["n"], pdf["code"], strict=True)]
    _, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    own = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8))[:n] for r, n in zip(pdf["repeated"], pdf["n"], strict=True)])
    twice = (counts[place] > 1) | (own == 1)
    ends = np.cumsum(pdf["n"].to_numpy())
    maps = [np.packbits(m).tobytes() for m in np.split(twice, ends[:-1])]
    return pdf[["part", "owner", "n", "k", "code"]].assign(bitmap=maps)


def _marked(folder: str, part: int, bits: int, owners: int) -> np.ndarray:
    """The hashes of one part that the owners marked: its own lists and the bitmaps that came back."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = file_system(f"{folder}/part={part}")
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    out = [np.empty(0, np.int64)]
    for info in found:
        if info.is_file and info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                for r in pq.ParquetFile(source).read().to_pylist():
                    mine = golomb_decode(r["k"], r["n"], r["code"]) + _base(r["owner"], bits, owners)
                    out.append(mine[np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: r["n"]] == 1])
    return np.unique(np.concatenate(out))


def suspects(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    """Those of the stored `rows` (part, h, ...) whose hash stands at least twice among all; others too, but one in some thousands only."""
    messages = rows.select("part", "h").mapInPandas(_sender(bits, owners), "part long, owner long, n long, k int, code binary, repeated binary")
    answers = messages.groupBy("owner").applyInPandas(_answer, "part long, owner long, n long, k int, code binary, bitmap binary")
    folder = shared_folder(rows.sparkSession, "exact-answers")
    answers.repartition("part").write.partitionBy("part").parquet(folder)

    def keep(batches):
        def marked(part):
            return per_worker("exact-dedup-marks", f"{folder}/{part}", lambda: _marked(folder, part, bits, owners))

        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            hashes = batch.column("h").to_numpy(zero_copy_only=False)
            hit = np.zeros(len(parts), bool)
            for part in np.unique(parts):
                marks, here = marked(int(part)), np.flatnonzero(parts == part)
                at = np.minimum(np.searchsorted(marks, hashes[here]), max(len(marks) - 1, 0))
                hit[here] = marks[at] == hashes[here] if len(marks) else False
            if hit.any():
                yield batch.filter(pa.array(hit))

    return rows.mapInArrow(keep, rows.schema)


def groups_of_equal_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normal: Column | None = None, key: Column | None = None, spare_bits: int = SPARE_BITS
) -> DataFrame:
    """The rows of `docs`, all columns kept, with (keep_id, group_size, kept, text_sha256).

    Texts are equal when `normal` (white-space runs as one space) of them is identical byte by byte; a null text is an empty one. Of equal
    texts the row with the smallest id is kept, rows without an id last; of repeated rows one is kept. `keep_id` is the id of that row,
    null where no row of the group has one. A text of any length is one row; an empty table gives none. Columns of `docs` that bear a
    name of the result are left out.

    1. Rows are written once with a hash of their text and the number of their part (the task that wrote them).
    2. Each sender sorts the distinct hashes of a part and sends each owner its range, Golomb-coded, with a bitmap of those it holds twice.
    3. An owner compares the lists of all parts and sends a bitmap back per list. A hash of very many rows is one entry of a list.
    4. Rows that a bitmap marks are grouped by their text (map-side first); the others stay alone.
    5. What a group decided goes to its rows by (part, key), so that the copies of one text are spread over the parts they lie in.
       `key` (SHA-256) only names a text here: keys that two texts share are joined with the text itself.
    """
    found = ["keep_id", "group_size", "kept", "text_sha256"]
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ") if normal is None else normal
    rest = [c for c in docs.columns if c not in found]
    base = docs.select(*rest)
    n_row, n_part, n_hash, n_body, n_key, n_sha, n_found = fresh(base, "_row", "_part", "_h", "_body", "_key", "_sha", "_found")
    spark = docs.sparkSession
    plain = base.select(F.monotonically_increasing_id().alias(n_row), body.alias(n_body), *rest)
    keyed = plain.withColumn(n_sha, F.sha2(n_body, 256))
    keyed = keyed.withColumn(n_key, F.unhex(n_sha) if key is None else key(F.col(n_body)))
    written = stored(keyed.withColumn(n_part, F.shiftright(n_row, 33)).withColumn(n_hash, F.xxhash64(n_body)), "exact-rows")
    n = written.count()
    bits = min(52, max(1, n).bit_length() + spare_bits)
    owners = max(1, math.ceil(n / OWNER_HASHES))
    narrow = written.select(
        F.col(n_part).alias("part"), F.shiftrightunsigned(n_hash, 64 - bits).alias("h"), F.col(n_key).alias("key"), F.col(n_row).alias("row"),
        F.col(doc_id).alias("id"), F.col(n_body).alias("body"),
    )
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    moved = stored(suspects(narrow, bits, owners).select("part", "key", "body", place.alias("place")), "exact-suspects")
    texts = moved.groupBy("body").agg(F.first("key").alias("key"), F.min("place").alias("best"), F.count(F.lit(1)).alias("size"))
    named = stored(texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("best").alias("best"), F.sum("size").alias("size")), "exact-groups")
    where = moved.select("part", "key").distinct()
    told = where.join(named.filter("texts = 1"), "key").select(F.col("part").alias(n_part), F.col("key").alias(n_key), "best", "size")
    lean = written.select(*rest, n_row, n_part, n_key, n_sha)
    out = lean.join(told.select(n_part, n_key, F.struct("best", "size").alias(n_found)), [n_part, n_key], "left")
    shared = named.filter("texts > 1").select(F.col("key").alias(n_key))
    if not shared.isEmpty():  # one key, several texts: the text decides
        exact = texts.select(F.col("body").alias(n_body), F.struct("best", "size").alias(n_found))
        apart = written.join(shared, n_key, "left_semi").join(exact, n_body, "left").select(*rest, n_row, n_part, n_key, n_sha, n_found)
        out = out.join(shared, n_key, "left_anti").select(*apart.columns).union(apart)
    best = F.col(n_found)["best"]
    return out.select(
        *rest, F.when(F.col(n_found).isNull(), F.col(doc_id)).otherwise(best["id"]).alias("keep_id"),
        F.coalesce(F.col(n_found)["size"], F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(best["row"] == F.col(n_row), F.lit(True)).alias("kept"), F.col(n_sha).alias("text_sha256"),
    )
