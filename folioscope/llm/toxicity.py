"""Toxicity by class-conditional Kneser-Ney models over the characters of words, with backoff counts shared by the whole corpus."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_worker, stored

#: Characters in a gram of the class models (the last one is predicted from the others), and in the longest gram of the shared one.
TOP, SHARED = 5, 4
#: Least slots of each count table; a table with more than half as many distinct grams or contexts gets more.
CLASS_SLOTS, SHARED_SLOTS = 1 << 21, 1 << 18
DISCOUNT = 0.75
#: Labelled ids that go to every task at once: all of them are counted, slice by slice, so no text is shuffled.
SLICE_ROWS = 500_000
#: Labelled documents of each label, at most, that fit the last step: a sample by the hash of the id.
FIT_ROWS = 10_000
FEATURES = ("mean_llr", "top_llr", "top3_llr", "log_words")
SCHEMA = "grp int, k int, slot long, suf long, mid long, ctx long, n long"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends; a null text has none."""
    return [w for w in (x.strip(".,;:!?\"'()[]") for x in text.lower().split()) if w] if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(words: list[str]):
    """Hashes of the character grams that end at each place of `words` (each between a start and an end mark).

    Returns (word number, place in the word, [hash of the 1-gram, 2-gram, ...]) for all places; grams never reach over a start mark:
    where they would, the value is of no use and must be masked by the place.
    """
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = codes == 2
    word = np.cumsum(starts) - 1
    place = np.arange(len(codes)) - np.flatnonzero(starts)[word]
    hashes, last = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(max(TOP, SHARED)):
            before = np.concatenate([np.zeros(1, np.uint64), last[:-1]])
            last = _mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + codes + np.uint64(1))
            hashes.append(last)
    return word, place, hashes


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(16)).astype(np.int64) % slots


def slot_column(h, slots: int):
    """`_slot` of a column of hashes as signed longs."""
    return F.shiftrightunsigned(h, 16) % slots


def _top(place: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The class gram at each predicted place (TOP characters, or from the start mark on) and its context."""
    size = np.minimum(place, TOP - 1)
    table = np.stack(hashes[:TOP])
    at = np.arange(len(place))
    return table[size, at], table[np.maximum(size - 1, 0), at - 1]


def gram_rows(batches, groups: tuple[int, ...]):
    """mapInPandas: the grams of a partition with their counts. Group -1 is the shared model; group 0 or 1 that of a label."""
    counts: dict[int, dict[str, int]] = {g: {} for g in groups}
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            for g in groups:
                if g == -1 or label == g:
                    held = counts[g]
                    for w in words_of(text):
                        held[w] = held.get(w, 0) + 1
            if sum(map(len, counts.values())) > 50_000:  # bounded memory: hand out what there is; sums follow in Spark
                yield from _gram_frames(counts)
                counts = {g: {} for g in groups}
    yield from _gram_frames(counts)


def _gram_frames(counts: dict[int, dict[str, int]]):
    for g, held in counts.items():
        if not held:
            continue
        names, times = list(held), np.fromiter(held.values(), np.int64, len(held))
        word, place, hashes = grams(names)
        ask = place > 0
        if g >= 0:
            gram, ctx = _top(place, hashes)
            one = pd.DataFrame({"slot": gram.view(np.int64)[ask], "suf": 0, "mid": 0, "ctx": ctx.view(np.int64)[ask], "n": times[word][ask]})
            yield one.groupby(["slot", "ctx"], as_index=False).agg({"suf": "first", "mid": "first", "n": "sum"}).assign(grp=g, k=TOP)[["grp", "k", "slot", "suf", "mid", "ctx", "n"]]
            continue
        for k in range(2, SHARED + 1):  # distinct k-grams tell how many characters stand before each shorter gram
            whole = place >= k - 1
            suffix, middle = hashes[k - 2], np.concatenate([np.zeros(1, np.uint64), hashes[k - 3][:-1]]) if k > 2 else np.zeros(len(place), np.uint64)
            one = pd.DataFrame({"slot": hashes[k - 1].view(np.int64)[whole], "suf": suffix.view(np.int64)[whole], "mid": middle.view(np.int64)[whole]})
            yield one.drop_duplicates().assign(grp=g, k=k, ctx=0, n=1)[["grp", "k", "slot", "suf", "mid", "ctx", "n"]]


@dataclass
class Model:
    """Count tables: of each label (gram, context, distinct followers) and of each shared order (the same, by continuation)."""

    labels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    shared: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def pack(self) -> dict:
        shut = lambda tables: {k: [zlib.compress(x.tobytes(), 1) for x in v] for k, v in tables.items()}
        return {"labels": shut(self.labels), "shared": shut(self.shared)}

    @staticmethod
    def unpack(packed: dict) -> Model:
        opened = lambda tables: {k: tuple(np.frombuffer(zlib.decompress(x), np.float32) for x in v) for k, v in tables.items()}
        return Model(opened(packed["labels"]), opened(packed["shared"]))


def count(docs: DataFrame, labels: DataFrame | None, groups: tuple[int, ...], id_col: str = "doc_id", text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Gram counts (hashes of grams and contexts) of all rows of `docs` (group -1) and of all rows that `labels` (doc_id, label; one row per id) marks.

    Labels go to every task, `slice_rows` ids at a time by hash; each further slice reads `docs` again and counts its own rows only.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def tagged(part: DataFrame | None, of: tuple[int, ...]) -> DataFrame:
        found = rows.withColumn("label", F.lit(None).cast("int")) if part is None else rows.join(F.broadcast(part), "doc_id", "left" if -1 in of else "inner")
        return found.select("text", "label").mapInPandas(lambda batches: gram_rows(batches, of), SCHEMA)

    slices = 1 if labels is None else -(-labels.count() // slice_rows) or 1
    part = lambda i: labels if slices == 1 else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == i)
    found = tagged(part(0), groups)
    for i in range(1, slices):
        found = found.union(tagged(part(i), tuple(g for g in groups if g >= 0)))
    return found.groupBy("grp", "k", "slot", "ctx").agg(F.min("suf").alias("suf"), F.min("mid").alias("mid"), F.sum("n").alias("n"))


def _dense(rows: pd.DataFrame, slots: int) -> np.ndarray:
    out = np.zeros(slots, np.float32)
    out[rows["s"].to_numpy(np.int64)] = rows["v"].to_numpy(np.float32)
    return out


def table_slots(counted: DataFrame) -> tuple[int, int]:
    """Slots of the class tables and of the shared ones: a power of two, at least twice the distinct grams of any one table."""
    distinct = counted.groupBy("grp", "k").agg(*[F.approx_count_distinct(c).alias(c) for c in ("slot", "ctx", "suf", "mid")]).collect()
    most = lambda rows, *cols: max((r[c] for r in rows for c in cols), default=0)
    wide = lambda n, least: max(least, 1 << (2 * n - 1).bit_length()) if n else least
    return wide(most([r for r in distinct if r["grp"] >= 0], "slot", "ctx"), CLASS_SLOTS), wide(most([r for r in distinct if r["grp"] < 0], "suf", "mid"), SHARED_SLOTS)


def build(counted: DataFrame) -> Model:
    """The tables of a model. What reaches the driver is one row per slot in use; the number of slots follows the distinct grams."""
    class_slots, shared_slots = table_slots(counted)
    labels = counted.filter("grp >= 0").select("grp", slot_column("slot", class_slots).alias("slot"), slot_column("ctx", class_slots).alias("ctx"), "n")
    labels = labels.groupBy("grp", "slot", "ctx").agg(F.sum("n").alias("n"))
    shared = counted.filter("grp = -1").select("k", slot_column("suf", shared_slots).alias("suf"), slot_column("mid", shared_slots).alias("mid"))
    take = lambda df: df.toPandas()
    gram = take(labels.groupBy("grp", F.col("slot").alias("s")).agg(F.sum("n").alias("v")))
    ctx = take(labels.groupBy("grp", F.col("ctx").alias("s")).agg(F.sum("n").alias("v"), F.count(F.lit(1)).alias("t")))
    before = take(shared.groupBy("k", F.col("suf").alias("s")).agg(F.count(F.lit(1)).alias("v")))
    around = take(shared.groupBy("k", F.col("mid").alias("s"), F.col("suf")).agg(F.count(F.lit(1)).alias("n")).groupBy("k", "s").agg(F.sum("n").alias("v"), F.count(F.lit(1)).alias("t")))
    dense = lambda rows, c="v": _dense(rows.assign(v=rows[c]), class_slots)
    by_label = {g: (dense(gram[gram.grp == g]), dense(ctx[ctx.grp == g]), dense(ctx[ctx.grp == g], "t")) for g in (0, 1)}
    by_order = {}
    for k in range(2, SHARED + 1):
        c = around[around.k == k]
        by_order[k - 1] = (_dense(before[before.k == k], shared_slots), _dense(c, shared_slots), _dense(c.drop(columns="v").rename(columns={"t": "v"}), shared_slots))
    return Model(by_label, by_order)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log-likelihood of each word under the toxic model less that under the ordinary one, both backing off to the shared counts."""
    word, place, hashes = grams(words)
    p = np.full(len(place), 1 / 512)
    for k, (gram, around, kinds) in sorted(model.shared.items()):
        ctx = np.concatenate([np.zeros(1, np.uint64), hashes[k - 2][:-1]]) if k > 1 else np.zeros(len(place), np.uint64)
        s, c = _slot(hashes[k - 1], len(gram)), _slot(ctx, len(gram))
        n = np.where(place >= k - 1, around[c], 0)
        p = np.where(n > 0, (np.maximum(gram[s] - DISCOUNT, 0) + DISCOUNT * np.minimum(kinds[c], n) * p) / np.maximum(n, 1), p)
    p = np.maximum(p, 1e-7)
    gram_h, ctx_h = _top(place, hashes)
    log = {}
    for g, (gram, around, kinds) in model.labels.items():
        s, c = _slot(gram_h, len(gram)), _slot(ctx_h, len(gram))
        n = around[c]
        log[g] = np.log(np.where(n > 0, (np.maximum(gram[s] - DISCOUNT, 0) + DISCOUNT * kinds[c] * p) / np.maximum(n, 1), p))
    return np.bincount(word, np.where(place > 0, log[1] - log[0], 0.0), len(words))


def _features(texts: pd.Series, model: Model, cache: dict[str, float]) -> pd.DataFrame:
    split = [words_of(t) for t in texts]
    new = list({w for ws in split for w in ws if w not in cache})
    if len(cache) + len(new) > 200_000:  # bounded memory: forgetting only costs time
        cache.clear()
        new = list({w for ws in split for w in ws})
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        cache.update(zip(part, word_scores(part, model).tolist(), strict=True))
    rows = []
    for ws in split:
        x = np.fromiter(map(cache.__getitem__, ws), np.float64, len(ws))
        best = np.sort(x)[-3:] if len(x) > 3 else x
        letters = sum(map(len, ws))
        rows.append((x.sum() / letters, best.max(), best.sum() / 3, np.log1p(len(x))) if len(x) else (0.0, 0.0, 0.0, 0.0))
    return pd.DataFrame(rows, columns=list(FEATURES), dtype="float64")


def features(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Four length-normalised differences per document: per letter of the whole text, of its strongest word, of its three strongest, and its length."""
    spark = docs.sparkSession
    packed, key = spark.sparkContext.broadcast(model.pack()), uuid.uuid4().hex

    def score(batches):
        held = per_worker("toxicity", key, lambda: Model.unpack(packed.value)), {}
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500].reset_index(drop=True)
                yield pd.concat([part[keep], _features(part["_text"], *held)], axis=1)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{f} double" for f in FEATURES])
    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(score, schema)


def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression (Newton steps, a little shrinkage, classes weighted evenly); intercept first. Without both labels: the rule `top3 > 1`."""
    if len(y) == 0 or y.min() == y.max():
        return [-1.0, 0.0, 0.0, 1.0, 0.0]
    a = np.column_stack([np.ones(len(x)), x])
    scale = np.maximum(np.abs(a).max(axis=0), 1e-9)
    a = a / scale
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.02 * np.eye(len(b)), a.T @ (weight * (y - p)) - 0.02 * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return (b / scale).tolist()


def _sample(known: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows of each label, those of least hash: few enough to broadcast."""
    first = lambda label: known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return first(0).union(first(1))


def held_out(doc_id) -> object:
    """True for the fifth of the ids whose labels are never learnt from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row of `docs`.

    `corpus` (or `docs`) gives the shared backoff counts, all its texts taken whole; `labels` (doc_id, toxic) marks rows of it. Labels of
    held-out ids are never read. Of the others, those of remainder 1 to 3 give the class counts, all of them; those of remainder 4 (of FIT_ROWS at most) fit the last step.
    Null and empty texts have no words: all four features are zero, so they get the score of the intercept. Labels that are null are
    ignored; of several labels of one id the largest counts. Rows equal in text get equal scores.
    """
    judged = _judge(docs, labels, docs if corpus is None else corpus, id_col, text, [], corpus is None)
    return judged.select(F.col(id_col), "held_out", "score", "predicted")


def _judge(docs: DataFrame, labels: DataFrame, corpus: DataFrame, id_col: str, text: str, keep: list[str], own: bool) -> DataFrame:
    """What `score` says of each row, with its columns `keep`. `own`: the corpus has the rows of `docs`."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).filter(fold != 0)
    train, check = stored(known.filter(fold != 4), "toxicity-labels"), F.broadcast(_sample(known.filter(fold == 4), FIT_ROWS))
    model = build(stored(count(corpus, train, (-1, 0, 1), id_col, text), "toxicity-grams"))
    scored = stored(features(docs, model, [id_col, *keep], text), "toxicity-features")
    if own:
        rows = scored.join(check.withColumnRenamed("doc_id", id_col), id_col)
    else:
        rows = features(corpus.join(check.withColumnRenamed("doc_id", id_col), id_col), model, ["label"], text)
    sample = rows.select("label", *FEATURES).toPandas()
    weights = fit(sample[list(FEATURES)].to_numpy(), sample["label"].to_numpy())
    logit = sum((F.lit(w) * F.col(f) for w, f in zip(weights[1:], FEATURES, strict=True)), F.lit(weights[0]))
    out = scored.select(F.col(id_col), *keep, held_out(F.col(id_col)).alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that are predicted toxic. The verdict is that of the row's own text, whatever its id; a null id is one like others."""
    of_id, *names = fresh(docs, "_id", "_h", "_k")
    prints = [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]
    marked = docs.select(*docs.columns, *prints)
    judged = _judge(marked, labels, docs if corpus is None else corpus, id_col, text, names, corpus is None).filter("predicted = 1")
    judged = judged.select(F.col(id_col).alias(of_id), *[F.col(n).alias("_of" + n) for n in names]).distinct()
    same = F.col(id_col).eqNullSafe(F.col(of_id))
    for n in names:
        same = same & (F.col(n) == F.col("_of" + n))
    return marked.join(judged, same, "left_anti").select(*docs.columns)
