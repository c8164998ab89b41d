"""Bounded-space online packing of token ids into sequences: a fixed number of open windows per partition, best fit, leftovers merged."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .token_ids import encoded

LENGTH, OPEN_WINDOWS, END_ID = 2048, 64, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, ids binary, closed boolean"


class Packer:
    """The open windows of one partition. A piece goes whole where it leaves least room; where none has room, the fullest is filled and emitted."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.length, self.windows = length, windows
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted: best fit is the first that is large enough
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def _place(self, window: int, room: int, piece: tuple) -> tuple[int, list[tuple]]:
        """Put `piece` (doc, start, tokens of the document, ids) into the window; returns the room then left and its pieces."""
        doc, start, total, ids = piece
        self.held[window].append((doc, start, total, ids, self.length - room))
        return room - len(ids) // 4, self.held[window]

    def add(self, piece: tuple):
        """Yields the windows that become full: lists of (doc, start, tokens, ids, offset)."""
        while piece[3]:
            doc, start, total, ids = piece
            n = len(ids) // 4
            if n >= self.length:  # a window of its own, cut from the front
                yield [(doc, start, total, ids[: 4 * self.length], 0)]
                piece = (doc, start + self.length, total, ids[4 * self.length :])
                continue
            at = bisect_left(self.room, (n, -1))
            if at == len(self.room) and len(self.room) < self.windows:
                window, room = self.next, self.length
                self.next += 1
                self.held[window] = []
            elif at < len(self.room):
                room, window = self.room.pop(at)
            else:  # none fits: the head of the piece fills the fullest, which is emitted; the rest looks again
                room, window = self.room.pop(0)
                self._place(window, room, (doc, start, total, ids[: 4 * room]))
                yield self.held.pop(window)
                piece = (doc, start + room, total, ids[4 * room :])
                continue
            left, pieces = self._place(window, room, piece)
            if left:
                insort(self.room, (left, window))
            else:
                yield self.held.pop(window)
            return

    def leftovers(self):
        for _, window in self.room:
            yield self.held.pop(window)
        self.room = []


def cut_to_powers(pieces: list[tuple], length: int):
    """Split what no window can take any more into sequences whose sizes are powers of two, the largest first: they need no padding."""
    queue = [(d, s, t, i) for d, s, t, i, _ in pieces]
    left = sum(len(p[3]) // 4 for p in queue)
    while left:
        size = min(length, 1 << (left.bit_length() - 1))
        out, offset = [], 0
        while offset < size:
            doc, start, total, ids = queue.pop(0)
            n = min(len(ids) // 4, size - offset)
            out.append((doc, start, total, ids[: 4 * n], offset))
            if 4 * n < len(ids):
                queue.insert(0, (doc, start + n, total, ids[4 * n :]))
            offset += n
        left -= size
        yield out


def _frame(windows, first: int, closed: bool) -> pd.DataFrame:
    rows = [
        (doc, start, len(ids) // 4, zlib.crc32(ids) if closed else 0, total, first + k, offset, None if closed else ids, closed)
        for k, pieces in enumerate(windows) for doc, start, total, ids, offset in pieces
    ]
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids", "closed"])
    return out.astype({"doc_id": "Int64"})


def _pack_partition(read, length: int, windows: int, last: bool, level: int):
    """mapInPandas over one partition: full windows with their final place; leftovers as pieces, with ids, for the next level."""
    def run(batches):
        from pyspark import TaskContext

        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        packer, done, n = Packer(length, windows), [], 0
        for pdf in batches:
            for piece in read(pdf):
                done += packer.add(piece)
                if len(done) >= 1024:
                    yield _frame(done, first + n, True)
                    n, done = n + len(done), []
        rest = list(packer.leftovers())
        if last:
            pieces = sorted((p for w in rest for p in w), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
            done += cut_to_powers(pieces, length)
            rest = []
        yield _frame(done, first + n, True)
        yield _frame(rest, 0, False)

    return run


def pack_rows(rows: DataFrame, read, length: int = LENGTH, windows: int = OPEN_WINDOWS, merge: int = 32) -> DataFrame:
    """Pack the pieces that `read` makes of each batch of `rows`: (document, 0, number of its ids, its ids as unsigned 32-bit bytes).

    Every partition keeps `windows` open windows, whatever its size. What is left open at the end of `merge` partitions is packed by one
    task of the next level, until one task has the rest, which it cuts into powers of two. A level hands on at most `windows` windows a
    task, so no task gathers more than `merge` x `windows` of them.
    """

    def again(pdf):
        for doc, start, total, ids in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["ids"], strict=True):
            yield (None if pd.isna(doc) else int(doc), int(start), int(total), bytes(ids))

    level, last = 0, False
    now = rows.mapInPandas(_pack_partition(read, length, windows, last, level), PIECE)
    now = stored(now.withColumn("part", F.spark_partition_id()), "packing-0")
    full = [now.filter("closed")]
    while not last:
        open_ = now.filter("not closed").withColumn("part", F.floor(F.col("part") / merge).cast("int"))
        parts, level = (open_.agg(F.max("part")).first()[0] or 0) + 1, level + 1
        last = parts == 1
        dealt = open_.repartition(1) if last else open_.repartitionByRange(parts, "part")
        packed = dealt.sortWithinPartitions("part", "doc_id", "start").mapInPandas(_pack_partition(again, length, windows, last, level), PIECE)
        now = stored(packed.withColumn("part", F.spark_partition_id()), f"packing-{level}")
        full.append(now.filter("closed"))
    out = full[0]
    for more in full[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = OPEN_WINDOWS, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of the sequences that the documents fill: each id of each document, and the end id after it, lies in exactly one piece.

    A null or empty text is its end id alone. Rows that repeat an id or a text are documents of their own. All sequences are full but the
    last few of the last level, whose sizes are powers of two, so nothing is padded. Other columns don't matter.
    """
    end = end_id.to_bytes(2, "little")

    def read(pdf):
        import numpy as np

        for doc, ids in zip(pdf["doc_id"], encoded(pdf["text"], path), strict=True):
            wide = np.frombuffer(ids + end, "<u2").astype("<u4").tobytes()
            yield (None if pd.isna(doc) else int(doc), 0, len(wide) // 4, wide)

    return pack_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), read, length, windows)
