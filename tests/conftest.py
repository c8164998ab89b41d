import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("folioscope-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """value(fn, text, ...) -> fn of literal columns, for one-row checks."""
    from pyspark.sql import functions as F

    def run(fn, *args):
        names = [f"a{i}" for i in range(len(args))]
        row = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
        return row.select(fn(*[F.col(n) for n in names]).alias("r")).first()["r"]

    return run


def page(page_id, title, kind="concepts", body="", aliases=(), sources=(), **more):
    return {
        "page_id": page_id, "path": f"{kind}/{title}.md", "stem": title, "kind": kind, "title": title, "aliases": list(aliases),
        "sources": [f"[[{s}]]" for s in sources], "summary": more.pop("summary", "s"), "url": more.pop("url", None),
        "content_hash": more.pop("content_hash", None), "doc_kind": more.pop("doc_kind", None), "status": more.pop("status", None),
        "processed": more.pop("processed", None), "read": more.pop("read", None), "updated": more.pop("updated", None),
        "summary_sources": more.pop("summary_sources", None), "body": body,
    }


PAGE = (
    "page_id long, path string, stem string, kind string, title string, aliases array<string>, sources array<string>, summary string, url string,"
    "content_hash string, doc_kind string, status string, processed date, read date, updated date, summary_sources int, body string"
)


@pytest.fixture(scope="session")
def wiki(spark):
    def build(*rows):
        names = [c.strip().split(" ")[0] for c in PAGE.split(",")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAGE)

    return build
