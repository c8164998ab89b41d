"""Retrieval as batch joins: postings, BM25, dense scores, rank fusion, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.operators.common import durable, top_k

MAX_BROADCAST_QUERY_CELLS = 4_000_000  # query vectors x dimensions sent to every task (16 MB)
QUERY_BLOCK = 2048
SCORED_AT_ONCE = 256
MANY_QUERIES = 1000  # from here on keyword scores are summed within shards of pages, not as rows of (query, page)
MANY_SCORES = 2_000_000  # or from so many pairs of queries and pages on
KEYWORD_QUERY_BLOCK = 8192
PAGE_SHARD = 8192
FULL_ROW_CELLS = 4_000_000  # scores of frequent terms a shard keeps as full rows (32 MB)


# ----------------------------------------------------------------------------------- keywords


def postings(pages: DataFrame, mark_pages: bool = False) -> DataFrame:
    """(term, page_id, tf_title, tf_alias, tf_body, page_len): counted inside each page's row.

    `mark_pages` adds one row with an empty term per page, so that pages and lengths can be counted
    from the same pass over the text.
    """

    def tagged(column, field):
        return F.transform(T.index_tokens(column), lambda t: F.struct(t.alias("t"), F.lit(field).alias("f")))

    everything = F.concat(
        tagged(F.col("title"), 0),
        tagged(F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), 1),
        tagged(F.col("body"), 2),
    )

    def said_in(run, field):
        return F.size(F.filter(run, lambda x: x["f"] == field))

    def runs(rows):
        heads = T.let(
            F.transform(rows, lambda x, i: F.struct(x["t"].alias("t"), i.alias("at"))),
            lambda at: F.filter(at, lambda x: ~x["t"].eqNullSafe(F.get(rows, x["at"] - 1)["t"])),
        )

        def entry(h, end):
            return T.let(
                F.slice(rows, h["at"] + 1, end - h["at"]),
                lambda run: F.struct(
                    h["t"].alias("term"),
                    *[said_in(run, n).alias(name) for n, name in enumerate(("tf_title", "tf_alias", "tf_body"))],
                ),
            )

        counted = T.let(
            heads, lambda hs: F.transform(hs, lambda h, i: entry(h, F.coalesce(F.get(hs, i + 1)["at"], F.size(rows))))
        )
        mark = F.struct(F.lit("").alias("term"), *[F.lit(0).alias(n) for n in ("tf_title", "tf_alias", "tf_body")])
        return F.concat(counted, F.array(mark)) if mark_pages else counted

    rows = pages.select(
        "page_id",
        T.let(
            F.sort_array(everything), lambda r: F.struct(F.size(r).alias("page_len"), runs(r).alias("terms"))
        ).alias("x"),
    )
    return rows.select("page_id", F.col("x.page_len"), F.inline("x.terms")).select(
        "term", "page_id", "tf_title", "tf_alias", "tf_body", "page_len"
    )


def query_terms(queries: DataFrame, text: str = "question", extra: str | None = None, n: int = 20) -> DataFrame:
    """`queries` with `words`: keywords of the text, then the cleaned extra search words."""
    words = T.keywords(text, n)
    if extra:
        cleaned = F.transform(F.col(extra), lambda w: F.regexp_replace(T.fold(w), "[^a-z0-9]", ""))
        words = F.concat(words, F.coalesce(F.filter(cleaned, lambda w: F.length(w) >= 3), F.array().cast("array<string>")))
    return queries.withColumn("words", F.array_distinct(words))


def corpus_size(pages: DataFrame) -> tuple[int, float]:
    """(pages, mean tokens per page): two numbers, computed with the postings' tokenizer."""
    parts = [F.col("title"), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), F.col("body")]
    length = sum((F.size(T.index_tokens(p)) for p in parts), F.lit(0))
    row = pages.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean")).first()
    return row["n"], row["mean"] or 0.0


def bm25(
    queries: DataFrame, index: DataFrame | None, k: int, size: tuple[int, float] | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """Top k pages per query by BM25: (query_id, page_id, score, rank); ties go to the lower page.

    With a stored `index` and its `size` (pages, mean length), only postings of query words are
    read on. With `pages` instead, the text is tokenized once: what the query words hit is written
    down, and the counts and the scores both read that.
    """
    asked = durable(queries.select("query_id", F.explode("words").alias("term")).distinct())
    if size is None:
        mark = asked.sparkSession.createDataFrame([("",)], "term string")
        words = asked.select("term").unionByName(mark).distinct()
        kept = durable(postings(pages, mark_pages=True).join(words, "term", "left_semi"))
        whole = kept.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("page_len").alias("mean")).first()
        n_pages, mean_len = whole["n"], whole["mean"] or 0.0
        hits = kept.filter("term <> ''")
    else:
        n_pages, mean_len = size
        hits = index.join(asked.select("term").distinct(), "term", "left_semi")
    spread = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n_pages)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = spread.select("term", F.when(idf <= 0, F.lit(V.BM25_MIN_IDF)).otherwise(idf).alias("idf"))
    w = V.BM25_WEIGHTS
    freq = w["title"] * F.col("tf_title") + w["alias"] * F.col("tf_alias") + w["body"] * F.col("tf_body")
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("page_len") / F.lit(mean_len or 1.0))
    part = F.col("idf") * freq * (V.BM25_K1 + 1) / (freq + norm)
    n_queries = asked.select("query_id").distinct().count()
    if n_queries >= MANY_QUERIES or n_queries * n_pages >= MANY_SCORES:
        scored = _bm25_by_blocks(asked, hits, weighted, part, k, n_queries, n_pages)
    else:
        scored = (
            hits.join(weighted, "term").join(asked, "term").groupBy("query_id", "page_id").agg(F.sum(part).alias("score"))
        )
    return top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("page_id")], k)


def _bm25_by_blocks(asked: DataFrame, hits: DataFrame, weighted: DataFrame, part, k: int, n_queries: int, n_pages: int) -> DataFrame:
    """The best k pages of each shard of pages for each query: (query_id, page_id, score).

    Query blocks meet shards in a cogroup. A page's score is summed where its postings lie, so no row per (query, page) is ever made.
    """
    blocks, shards = -(-n_queries // KEYWORD_QUERY_BLOCK), max(1, -(-n_pages // PAGE_SHARD))
    numbered = durable(weighted.withColumn("t", F.monotonically_increasing_id()))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.join(numbered, "term").select("query_id", "t", of("query_id", blocks).alias("b"), every(shards).alias("s"))
    right = hits.join(numbered, "term").select("page_id", "t", part.alias("part"), of("page_id", shards).alias("s"), every(blocks).alias("b"))
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("page_id", hits.schema["page_id"].dataType), StructField("score", DoubleType())])

    def score(qs: pa.Table, ps: pa.Table) -> pa.Table:
        return _best_of_shard(qs, ps, k)

    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(score, schema)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(places, values): each value's place among the distinct ones in ascending order, null first."""
    whole = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(whole.dictionary, null_placement="at_start")
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[whole.indices.to_numpy()], whole.dictionary.take(order)


def _best_of_shard(asked: pa.Table, parts: pa.Table, k: int) -> pa.Table:
    """The first k pages by (score to 9 places, page) for each query. `asked` (query_id, t), `parts` (page_id, t, part); a page whose parts
    are all null has a null score and comes last."""
    names = ["query_id", "page_id", "score"]
    if not asked.num_rows or not parts.num_rows:
        return pa.table([asked["query_id"].slice(0, 0), parts["page_id"].slice(0, 0), pa.array([], pa.float64())], names)
    (q, queries), (p, pages) = _coded(asked["query_id"]), _coded(parts["page_id"])
    n, part = len(pages), parts["part"].to_numpy()
    gaps = bool(np.isnan(part).any())
    terms, t = np.unique(parts["t"].to_numpy(), return_inverse=True)
    cells, place = np.unique(t * n + p, return_inverse=True)
    value, page = np.bincount(place, weights=np.nan_to_num(part)), cells % n
    start = np.searchsorted(cells, np.arange(len(terms) + 1) * n)
    length = np.diff(start)
    often = np.argsort(-length, kind="stable")[: FULL_ROW_CELLS // n]
    full = {}
    for i in often[length[often] * 8 > n]:
        full[i] = np.zeros(n)
        full[i][page[start[i] : start[i + 1]]] = value[start[i] : start[i + 1]]
    wanted = asked["t"].to_numpy()
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    known = terms[at] == wanted
    q, at = q[known], at[known]
    order = np.lexsort((at, q))
    q, at = q[order], at[order]
    found: list[tuple[np.ndarray, ...]] = []
    for own in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
        if not len(own):
            continue
        total = np.zeros(n)
        for i in at[own]:
            if i in full:
                total += full[i]
            else:
                total[page[start[i] : start[i + 1]]] += value[start[i] : start[i + 1]]
        rounded = np.round(total, 9)
        kth = np.partition(rounded, n - k)[n - k] if n > k else 0.0
        if kth > 0:
            above = np.flatnonzero(rounded > kth)
            best = np.concatenate([above, np.flatnonzero(rounded == kth)[: k - len(above)]])
        else:
            met = np.unique(np.concatenate([page[start[i] : start[i + 1]] for i in at[own]])) if gaps else np.flatnonzero(total > 0)
            best = met[np.argsort(-rounded[met], kind="stable")][:k]
        found.append((np.full(len(best), q[own[0]]), best, total[best]))
    rows = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ()))]
    score = pa.array(rows[2].astype(np.float64), mask=rows[2] == 0)
    return pa.table([queries.take(pa.array(rows[0])), pages.take(pa.array(rows[1])), score], names)


# -------------------------------------------------------------------------------------- dense


def _unit(rows: list) -> np.ndarray:
    matrix = np.asarray(rows, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return (matrix / norms).astype(np.float32).astype(np.float64)


def _best_pages(query_ids, queries, page_ids, matrix, pool) -> pd.DataFrame:
    """The best `pool` pages of one batch for each query. A page in the overall top is in the top of
    the batch that holds its best chunk, so nothing is lost by cutting here. Queries are taken in
    blocks, so the score matrix has a fixed size."""
    out = []
    for at in range(0, len(query_ids), SCORED_AT_ONCE):
        frame = pd.DataFrame(matrix @ queries[at : at + SCORED_AT_ONCE].T, columns=query_ids[at : at + SCORED_AT_ONCE])
        best = frame.groupby(np.asarray(page_ids), sort=True).max()
        for q in best.columns:
            top = best[q].round(9).sort_values(ascending=False, kind="stable").head(pool)
            out.append(pd.DataFrame({"query_id": q, "page_id": top.index, "score": best[q].loc[top.index].to_numpy()}))
    return pd.concat(out, ignore_index=True)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = V.DENSE_POOL) -> DataFrame:
    """Top k pages per query by the best dot product over the page's chunks.

    `queries(query_id, vec)`, `vectors(page_id, chunk, vec)`; chunk -1 was withheld and is skipped.
    The query matrix is broadcast while its counted size is small; beyond that, query blocks meet
    slices of the vectors in a cogroup, so neither side is ever held whole.
    """
    usable = vectors.filter(F.col("chunk") >= 0).select("page_id", "vec")
    counted = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    schema = "query_id long, page_id long, score double"
    if (counted["n"] or 0) * (counted["dims"] or 1) <= MAX_BROADCAST_QUERY_CELLS:
        rows = queries.select("query_id", "vec").orderBy("query_id").collect()
        if not rows:
            return queries.sparkSession.createDataFrame([], schema + ", rank long")
        shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], _unit([r[1] for r in rows])))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                if len(batch):
                    yield _best_pages(ids, matrix, batch["page_id"], _unit(list(batch["vec"])), k)

        found = usable.mapInPandas(score, schema)
    else:
        found = _dense_by_blocks(queries, usable, k, counted["n"], schema)
    best = found.groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.round("score", 9).desc(), F.col("page_id")], k)


def _dense_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, n_queries: int, schema: str) -> DataFrame:
    blocks = -(-n_queries // QUERY_BLOCK)
    slices = max(1, -(-vectors.count() // 50_000))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("page_id", "vec"), F.lit(slices)).cast("int")
    left = queries.select("query_id", F.col("vec").alias("qvec"), block.alias("b"),
                          F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    right = vectors.select("page_id", "vec", part.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def score(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or vs.empty:
            return pd.DataFrame({"query_id": [], "page_id": [], "score": []})
        return _best_pages(list(qs["query_id"]), _unit(list(qs["qvec"])), vs["page_id"], _unit(list(vs["vec"])), k)

    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(score, schema)


def embed_units(pages: DataFrame, most: int | None = None) -> DataFrame:
    """The texts a page is embedded as: its introduction and each `## ` section, led by the title.

    A section is cut into as many units of EMBED_UNIT_CHARS characters as it needs, or its first `most` only.
    """
    parts = F.split("body", r"(?m)^## ")
    marked = F.transform(parts, lambda p, i: F.when(i == 0, T.strip(p)).otherwise(F.concat(F.lit("## "), T.strip(p))))
    size = F.lit(V.EMBED_UNIT_CHARS)

    def cut(p):
        n = F.ceil(F.length(p) / size).cast("int")
        places = F.sequence(F.lit(0), (n if most is None else F.least(n, F.lit(most))) - 1)
        return F.transform(places, lambda k: F.concat(F.col("title"), F.lit("\n"), F.substring(p, k * size + 1, size)))

    units = F.flatten(F.transform(F.filter(marked, lambda p: p != ""), cut))
    some = F.when(F.size(units) > 0, units).otherwise(F.array("title"))
    return pages.select("page_id", F.posexplode(some).alias("chunk", "text"))


VECTORS = "page_id long, chunk int, vec array<float>, embedder string, content_hash string"


def embed_pending(
    pages: DataFrame,
    vectors: DataFrame,
    embed_fn: Callable[[list[str]], list[list[float]]],
    identity: str,
    sends_text_out: bool = False,
    hidden: DataFrame | None = None,
    public_bodies: DataFrame | None = None,
) -> DataFrame:
    """Rows to append for pages without vectors of this embedder and content.

    Another embedder's vectors do not count. With a remote embedder, `hidden` pages (page_id) get
    a marker row (chunk -1) and the others are embedded from `public_bodies(page_id, body)`.
    """
    have = vectors.filter(F.col("embedder") == identity).select("page_id", "content_hash").distinct()
    stamped = pages.withColumn("content_hash", T.content_hash(F.concat_ws("\n", "title", "body")))
    todo = stamped.join(have, ["page_id", "content_hash"], "left_anti")
    markers = None
    if sends_text_out and hidden is not None:
        kept_back = todo.join(hidden.select("page_id"), "page_id", "left_semi")
        markers = kept_back.select(
            "page_id", F.lit(-1).alias("chunk"), F.array().cast("array<float>").alias("vec"),
            F.lit(identity).alias("embedder"), "content_hash",
        )
        todo = todo.join(hidden.select("page_id"), "page_id", "left_anti")
        if public_bodies is not None:
            shown = public_bodies.select("page_id", F.col("body").alias("_public"))
            todo = todo.join(shown, "page_id", "left").withColumn("body", F.coalesce("_public", "body")).drop("_public")
    units = embed_units(todo).join(todo.select("page_id", "content_hash"), "page_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _unit(embed_fn(list(batch["text"]))).astype(np.float32)
                yield pd.DataFrame(
                    {"page_id": batch["page_id"], "chunk": batch["chunk"], "vec": [list(v) for v in unit],
                     "embedder": identity, "content_hash": batch["content_hash"]}
                )

    fresh = units.mapInPandas(run, VECTORS)
    return fresh if markers is None else fresh.unionByName(markers)


# --------------------------------------------------------------------------------- fused search


def rrf(*rankings: DataFrame, k: int = V.RRF_K) -> DataFrame:
    """Fuse ranked lists (query_id, page_id, rank from 1): sum of 1/(k+rank). Ties keep the order of
    the first list, then of the next."""
    tagged = [r.select("query_id", "page_id", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    fused = every.groupBy("query_id", "page_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    total = every.agg(F.max("rank")).first()[0] or 1
    ranked = top_k(fused, ["query_id"], [F.round("score", 12).desc(), F.col("seen")], total * max(1, len(rankings)))
    return ranked.select("query_id", "page_id", "score", "rank")


def search(
    queries: DataFrame, index: DataFrame, k: int, size: tuple[int, float],
    exclude: DataFrame | None = None, dense: tuple[DataFrame, DataFrame] | None = None, max_excluded: int = 0,
) -> DataFrame:
    """Hybrid search: (query_id, page_id, rank). `exclude(query_id, page_id)` rows are taken out after
    fusing; `max_excluded` is the most any query excludes, and widens the pool as much."""
    pool = k + max_excluded
    if dense is not None:
        pool = max(pool, V.DENSE_POOL)
    ranked = bm25(queries, index, pool, size).select("query_id", "page_id", "rank")
    if dense is not None:
        ranked = rrf(ranked, dense_search(dense[0], dense[1], V.DENSE_POOL)).select("query_id", "page_id", "rank")
    if exclude is not None:
        ranked = ranked.join(exclude.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    return top_k(ranked.withColumnRenamed("rank", "_r"), ["query_id"], [F.col("_r")], k).drop("_r")


def connection_candidates(
    plans: DataFrame, index: DataFrame, pages: DataFrame, sources: DataFrame, size, k: int = 10, rebuilding: bool = False,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Pages a new source may connect to. `plans(query_id, title, summary, concepts, terms)`; a plan is
    never connected to itself nor, on a rebuild, to the pages it created."""
    text = F.concat_ws(" ", "title", "summary", F.array_join("concepts", " "), F.array_join("terms", " "))
    queries = query_terms(plans.withColumn("question", text))
    found = search(queries, index, k, size, exclude=exclude)
    titled = found.join(pages.select("page_id", F.col("title").alias("page_title")), "page_id").join(
        plans.select("query_id", "title"), "query_id"
    )
    kept = titled.filter(F.col("page_title") != F.col("title"))
    if rebuilding:
        made = sources.select("page_id", F.col("source").alias("title"))
        kept = kept.join(made, ["page_id", "title"], "left_anti")
    return kept.select("query_id", "page_id", "page_title", "rank")


def evaluate(golden: DataFrame, retrieved: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(one row per question with the rank of its first expected title, the totals).

    `golden(query_id, expect)`, `retrieved(query_id, title, rank)`; a title counts when it starts
    with an expected one. Optional `grounded`/`cited` columns of `golden` become rates.
    """
    wanted = golden.select("query_id", F.explode("expect").alias("e")).withColumn("e", T.fold("e"))
    hits = (
        retrieved.filter(F.col("rank") <= k)
        .withColumn("t", T.fold("title"))
        .join(wanted, "query_id")
        .filter(F.col("t").startswith(F.col("e")))
        .groupBy("query_id")
        .agg(F.min("rank").alias("hit_rank"))
    )
    cases = golden.join(hits, "query_id", "left")
    rates = [
        F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in ("grounded", "cited") if c in golden.columns
    ]
    totals = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.avg(F.col("hit_rank").isNotNull().cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        *rates,
    )
    return cases, totals
