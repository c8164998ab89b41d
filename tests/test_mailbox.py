"""Fetches of mailboxes one file after the other, against a plain fold over them."""

import random
from datetime import date, timedelta

from folioscope.streaming import mailbox as B

MAIL = "mailbox string, generation string, fetch long, fetched date, uid long, received date, seen boolean, message_id string, raw string"
START = date(2024, 3, 1)


def fetches(n, seed):
    r, out = random.Random(seed), []
    for f in range(n):
        rows = []
        for box in ("a", "b", None):
            generation = "g1" if f < n // 2 or box == "b" else "g2"
            for _ in range(12):
                uid, day = r.randrange(1, 40 + 10 * f), START + timedelta(days=f)
                rows.append((box, generation if r.random() < 0.95 else None, f, day, uid, day - timedelta(days=r.randrange(0, 40)), r.random() < 0.8, f"<{r.randrange(60)}@x>", "text"))
        out.append(rows)
    return out


def fold(batches):
    marks, taken = {}, []
    for rows in batches:
        got = []
        for row in rows:
            box, generation, _, fetched, uid, received, seen, *_ = row
            mark = marks.get(box)
            above = mark is not None and generation is not None and mark[0] == generation and uid > mark[1]
            if received >= fetched - timedelta(days=14) or not seen or above:
                got.append(row)
        for box in {r[0] for r in got if r[1] is not None}:
            tops = {}
            for r in got:
                if r[0] == box and r[1] is not None:
                    tops[r[1]] = max(tops.get(r[1], 0), r[4])
            (generation,) = tops
            held = marks[box][1] if box in marks and marks[box][0] == generation else 0
            marks[box] = (generation, max(held, tops[generation]))
        taken += got
    return taken, marks


def test_marks_are_state_and_fall_with_the_generation(spark, tmp_path):
    batches = fetches(6, 3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):  # a file at a time, the stream started anew for each two
        spark.createDataFrame(rows, MAIL).coalesce(1).write.mode("append").parquet(source)
        if i % 2:
            stream = spark.readStream.schema(MAIL).option("maxFilesPerTrigger", 1).parquet(source)
            B.maintain_mailboxes(stream, out, str(tmp_path / "ck")).start().awaitTermination()
    taken, marks = fold(batches)
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    names = [c.strip().split(" ")[0] for c in MAIL.split(",")]
    assert key(spark.read.schema(MAIL).parquet(f"{out}/taken/*").select(*names).collect()) == key(taken)
    last = spark.read.schema(B.MARKS).parquet(f"{out}/marks/batch=5").collect()
    assert {r["mailbox"]: (r["generation"], r["last_uid"]) for r in last} == marks and {m[0] for m in marks.values()} == {"g1", "g2"}
    again = B.new_mails(spark, out, MAIL).writeStream.format("parquet").option("path", str(tmp_path / "new")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "new")).count() == len({r[7] for r in taken})
