"""A keyword index that follows a stream of changed pages by signed changes.

Per micro-batch two tables are written: the postings of the new versions of its pages, and for each page a row with sign 1 for the version
that comes and a row with sign -1 for the version that goes. A version is live while its signs add up to 1. Runs are folded by level
(`levels`): versions that came and went inside a fold cancel, and their postings go. The head holds the number of pages and their tokens,
so a search reads these totals, the postings of a bounded number of runs and the signs of the pages that it hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.common import durable
from folioscope.operators.search import bm25, postings
from folioscope.streaming import levels as L

FANOUT = 8
DEAD_BROADCAST = 1_000_000  # versions that went (page and number) sent to every task; more of them are joined by a shuffle
TWICE_BROADCAST = 1_000_000  # ids of pages that a batch brings more than once, likewise
TOTALS = "pages long, tokens long"
COUNTS = "tf_title int, tf_alias int, tf_body int, page_len int"


def _schemas(id_type: str) -> dict[str, str]:
    return {
        "signs": f"page_id {id_type}, version long, page_len int, sign int",
        "postings": f"term string, page_id {id_type}, {COUNTS}, version long",
    }


def _summed(signs: DataFrame) -> DataFrame:
    """Signs of each version added up; what cancels is gone."""
    total = signs.groupBy("page_id", "version", "page_len").agg(F.sum("sign").cast("int").alias("sign"))
    return total.filter("sign <> 0")


def newest_rows(batch: DataFrame) -> DataFrame:
    """One row per page of a batch: the one changed last, among equals the deletion, then the greatest in its other columns. Rows without
    a `page_id` are left out: nothing could find their page again."""
    rest = [c for c in batch.columns if c not in ("page_id", "changed_at", "deleted")]
    rows = batch.filter("page_id is not null").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    rows = rows.select("page_id", "changed_at", "deleted", *rest)
    # only ids are shuffled to see which pages come more than once; the texts of the others stay where they are
    twice = durable(rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("page_id"))
    n = twice.count()
    if not n:
        return rows
    twice = F.broadcast(twice) if n <= TWICE_BROADCAST else twice
    order = F.struct(*rows.columns[1:])
    newest = rows.join(twice, "page_id", "left_semi").groupBy("page_id").agg(F.max(order).alias("_p")).select("page_id", "_p.*")
    return rows.join(twice, "page_id", "left_anti").unionByName(durable(newest))


def _without(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """Postings without those of versions that went by `signs`. These are few against the postings, which need no shuffle for that."""
    dead = signs.filter("sign < 0").select("page_id", "version")
    few = dead.count() <= DEAD_BROADCAST
    return rows.join(F.broadcast(dead) if few else dead, ["page_id", "version"], "left_anti")


def index_batch(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, fanout: int = FANOUT) -> None:
    """Take one batch `(page_id, title, aliases, body, changed_at, deleted)` into the index under `path`.

    Batches count in the order of their numbers. Only the changed pages are tokenized; of the others nothing but ids and signs is read.
    """
    schema = _schemas(batch.schema["page_id"].dataType.simpleString())
    said = {c: F.coalesce(c, F.lit("")) for c in ("title", "body")}  # a page without a body still has its title and its aliases
    changed = newest_rows(batch).withColumns(said)
    before = L.read_runs(spark, path, "signs", L.runs_before(batch_id, fanout), schema["signs"])
    gone = _summed(before.join(changed.select("page_id"), "page_id", "left_semi")).withColumn("sign", F.lit(-1))
    # written once, as the run itself; its rows with an empty term carry the length of a page, also of one without words
    own = (0, batch_id)
    new = postings(changed.filter("not deleted"), mark_pages=True).withColumn("version", F.lit(batch_id).cast("long"))
    L.write_run(new.select(*_names(schema["postings"])), path, "postings", own)
    come = L.read_runs(spark, path, "postings", [own], schema["postings"]).filter("term = ''").withColumn("sign", F.lit(1))
    names = ["page_id", "version", "page_len", "sign"]
    signs = durable(come.select(*names).unionByName(gone.select(*names)))
    L.write_run(signs, path, "signs", own)

    def merge(run: L.Run, old: list[L.Run]) -> None:
        signs_of = L.read_runs(spark, path, "signs", old, schema["signs"])
        L.write_run(_summed(signs_of), path, "signs", run)
        # a version whose postings lie in these runs came in them, so one that went in them as well cancels
        kept = _without(_said(L.read_runs(spark, path, "postings", old, schema["postings"])), signs_of)
        # no order: nothing reads by it, and to sort the postings would shuffle all of them once more in every fold
        L.write_run(kept.select(*_names(schema["postings"])), path, "postings", run)

    L.fold(spark, path, batch_id, fanout, merge)
    change = signs.agg(F.sum("sign").alias("pages"), F.sum(F.col("sign") * F.col("page_len")).alias("tokens")).first()
    head = L.read_head(spark, path, TOTALS, batch_id) or {"pages": 0, "tokens": 0}
    L.write_head(spark, path, batch_id, TOTALS, (head["pages"] + (change["pages"] or 0), head["tokens"] + (change["tokens"] or 0)))


def _said(postings_of_runs: DataFrame) -> DataFrame:
    """Without the rows that only carry the length of a page."""
    return postings_of_runs.filter("term <> ''")


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def follow_pages(pages: DataFrame, path: str, checkpoint: str, fanout: int = FANOUT):
    """A stream of changed pages kept as an index under `path`. A batch that runs again overwrites its own runs."""
    spark = pages.sparkSession
    return (
        pages.writeStream.foreachBatch(lambda batch, batch_id: index_batch(spark, path, batch, batch_id, fanout))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


class DeltaIndex:
    """The index as of its newest whole batch; `id_type` is the type of `page_id`."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", fanout: int = FANOUT):
        self.spark, self.path, self.schema = spark, path, _schemas(id_type)
        head = L.read_head(spark, path, TOTALS)
        self.pages, self.tokens = head["pages"], head["tokens"]
        self.runs = L.runs_before(head["batch"] + 1, fanout)

    def live_pages(self) -> DataFrame:
        """(page_id, version, page_len) of the pages that are there."""
        signs = L.read_runs(self.spark, self.path, "signs", self.runs, self.schema["signs"])
        return _summed(signs).filter("sign > 0").drop("sign")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """The postings of live pages, of the given `terms(term)` only if there are some. Versions that went are named by the signs of
        the pages that the terms hit."""
        rows = _said(L.read_runs(self.spark, self.path, "postings", self.runs, self.schema["postings"]))
        if terms is not None:
            rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
        signs = L.read_runs(self.spark, self.path, "signs", self.runs, self.schema["signs"])
        return _without(rows, signs).drop("version")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Top k pages per query `(query_id, words)` by BM25, with the current totals."""
        asked = queries.select(F.explode("words").alias("term"))
        mean = self.tokens / self.pages if self.pages else 0.0
        return bm25(queries, self.postings(asked), k, (self.pages, mean))
