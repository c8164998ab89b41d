"""Quality rules, line dedup, near copies and toxicity on small and odd tables, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import linededup, quality, simhash, toxicity
from folioscope.llm.common import components

SCHEMA = "doc_id long, text string, lang string, d string, th long, pos int, fp long, label int, _words string, _gone long, _h long, n_deleted string, n_words string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3, 4, "w", 5, 6, "n", "m", "s") for i, t in rows], SCHEMA)


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


LONG = "\n".join(" ".join(words(30, s, 4000)) for s in range(1500))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d"), (5, "a b c d"), (6, "a b c d"), (None, "a b c d"), (None, None), (7, LONG), (8, LONG), (9, "x y " * 60), (10, "é ñ ß 中 文 " * 20)]


def plain_measures(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(ws) - 2):
        where.setdefault(tuple(ws[i : i + 3]), []).append(i)
    hit = {p + k for v in where.values() if len(v) > 1 for p in v for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rows = ODD + [(20 + i, " ".join(words(80, i, 12)) + "\n#a# |\n#a# |") for i in range(20)]
    got = quality.judge(table(spark, rows)).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "_words").collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_measures(r["text"])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["_words"] == "w" and not (r["kept"] and r["base_failed"])


def test_quality_rules_are_one_projection(spark):
    plan = quality.judge(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality.judge(table(spark, []).filter("doc_id = 1")).count() == 0
    prose = " ".join(["the cat of a house was in that garden and it had"] + words(60, 3, 5000))
    shout = " ".join(w.upper() + "!" for w in ["the", "of", *[f"{a}word" for a in "abcdefghijklmnopqrstuvwxyz" * 3]])
    got = {r["doc_id"]: (r["kept"], r["broken"]) for r in quality.judge(table(spark, [(1, prose), (2, shout), (3, prose + " ## ** $$ || <> &&" * 20)])).collect()}
    assert got[1] == (True, []) and "shouting" in got[2][1] and "symbols" in got[3][1]


def plain_line_dedup(rows, least):
    """By the definition: from every line the longest run of `least` words or more that stands earlier, anywhere, goes."""
    first, out = {}, {}
    full = re.compile(r"[^\x20\x09-\x0D]")
    for doc, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if full.search(x)]
        n = [min(least, len(lines[i].split())) for i in at]
        cut = set()
        for i in range(len(at)):
            for j in range(i, len(at)):
                run = tuple(lines[k] for k in at[i : j + 1])
                if run not in first:
                    first[run] = (doc, text, i)
                elif sum(n[i : j + 1]) >= least:
                    cut.update(range(at[i], at[j] + 1))
        out[doc, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_plain_version(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(words(r.choice([1, 3, 8, 20, 60]), 100 * seed + k)) for k in range(30)] + [""]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 25)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    got = {(x["doc_id"], x["old"]): x["text"] for x in linededup.dedup_lines(table(spark, rows).withColumn("old", F.col("text"))).collect()}
    assert got == plain_line_dedup(rows, 50)


def test_line_dedup_extends_to_any_earlier_occurrence(spark):
    """The opening L first stands before other text; M after it goes where L and M stand together earlier."""
    opening, after, other = (" ".join(words(n, s, 10**6)) for n, s in ((60, 501), (30, 502), (20, 503)))
    rows = [(1, f"{opening}\n{other}"), (2, f"{opening}\n{after}\nsecond"), (3, f"{opening}\n{after}\nthird"), (4, f"{after}\nfourth")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: f"{after}\nsecond", 3: "third", 4: rows[3][1]}


def test_line_dedup_odd_rows(spark):
    passage = "\n".join(" ".join(words(30, s, 9000)) for s in (900, 901))
    rows = ODD + [(30, "head\n" + passage + "\nend"), (31, passage), (32, "other\n\n" + passage.replace("\n", "\n\n") + "\n\nlast")]
    got = linededup.dedup_lines(table(spark, rows))
    assert got.columns == [c for c in SCHEMA_NAMES if c != "n_deleted"] + ["n_deleted"]
    out = [(r["doc_id"], r["text"], r["n_deleted"], r["_h"]) for r in got.collect()]
    assert len(out) == len(rows) and all(h == 6 for *_, h in out)
    by = {(i, t): n for i, t, n, _ in out}
    assert (30, "head\n" + passage + "\nend") in by and by[31, ""] == 2 and by[8, ""] == 1500 and by[7, LONG] == 0
    assert by[32, "other\n\n\nlast"] == 3
    assert sum(t == "a b c d" for _, t, *_ in out) == 4 and (1, None) in by and (2, "") in by
    assert linededup.dedup_lines(table(spark, []).filter("doc_id = 1")).count() == 0


SCHEMA_NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def test_line_dedup_is_native(spark):
    plan = linededup.dedup_lines(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_print(text, k=4):
    import xxhash

    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split(" ") if text else []
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", " ".join(ws)) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(len(ws) - k + 1)] or [xxhash.xxh64_intdigest(" ".join(ws).encode(), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(prints, distance):
    names = list(prints)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in names}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [4, 3])
def test_print_classes_lose_no_link(spark, distance):
    r = random.Random(distance)
    prints = set()
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 6, 12])):
            prints.add(x)
            for _ in range(r.choice([1, 3, 4, 5])):
                x ^= 1 << r.randrange(64)
    base = r.getrandbits(64)
    prints |= {base ^ (1 << i) ^ (1 << j) for i in range(0, 40, 3) for j in range(i)}  # a dense group
    prints = {signed(x) for x in prints}
    bits = {x: x & (2**64 - 1) for x in prints}
    unsigned = plain_classes(sorted(bits.values()), distance)
    got = {row["fp"]: row["class"] for row in simhash.print_classes(spark.createDataFrame([(x,) for x in prints], "fp long"), distance).collect()}
    assert set(got) == prints
    groups = lambda m: sorted(map(sorted, __import__("functools").reduce(lambda acc, kv: (acc.setdefault(kv[1], []).append(kv[0]), acc)[1], m.items(), {}).values()))
    assert groups({bits[a]: b for a, b in got.items()}) == groups(unsigned)


def test_near_copies(spark):
    base = words(300, 5, 9000)
    near = list(base)
    near[150] = "changed"
    rows = ODD + [(40, " ".join(base)), (41, " ".join(near).upper()), (42, " ".join(words(300, 6, 9000)))]
    docs = table(spark, rows)
    got = simhash.near_copies(docs).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        assert (i, signed(plain_print(t))) in {(r["doc_id"], r["fp"]) for r in got}
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    near_enough = (plain_print(rows[-3][1]) ^ plain_print(rows[-2][1])).bit_count() <= 4
    assert by[1] == by[2] == by[3] == 1 and by[8] == 7 and by[6] == 5 and (by[41] == 40) == near_enough and by[42] == 42
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 7, 9, 10, 40, 42, None} and not {2, 3, 6, 8} & {r["doc_id"] for r in kept.collect()}
    assert simhash.near_copies(docs.filter("doc_id = 99")).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def toxic_table(n):
    rows, labels = [], []
    for i in range(n):
        ws = words(60 + i % 50, i, 3000)
        if i % 4 == 0:
            for k in range(3):
                ws[7 * k + i % 5] = ["vilk" + x for x in "abcdefghij"][(i + k) % 10]
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, i % 4 == 0))
    return rows, [(i, 1, int(x)) for i, _, x in labels]


def test_toxicity_learns_stems(spark):
    rows, labels = toxic_table(400)
    docs = table(spark, rows + ODD[:3] + [(None, "vilka"), (7000, LONG)])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] > 3]
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert len(held) > 40 and right / len(held) > 0.95
    assert toxicity.score(docs.filter("doc_id = 99999"), marks).count() == 0


def test_toxicity_never_reads_held_out_labels(spark):
    rows, labels = toxic_table(200)
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wrong = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: round(r["score"], 9) for r in toxicity.score(docs, marks).collect()}
    assert one == {r["doc_id"]: round(r["score"], 9) for r in toxicity.score(docs, wrong).collect()}


def test_toxicity_without_labels(spark):
    docs = table(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, none).count() == len(ODD)
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def test_components_of_few_rows_take_few_tasks(spark):
    """Rounds over few rows leave few partitions (and files), however many the shuffles have; the result is that of any number."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)], "a long, b long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components(edges)
        assert got.rdd.getNumPartitions() <= 64 + 8
        assert {x["node"]: x["root"] for x in got.collect()} == {i: 0 for i in range(31)} | {40: 40, 41: 40, 50: 40}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
