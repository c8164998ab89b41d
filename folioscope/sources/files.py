"""Reading and writing: Markdown pages, JSON lines, incremental scans, table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions import text as T
from folioscope.functions import values as V
from folioscope.operators.names import kind_ord

CORRUPT = "_corrupt_record"


# --------------------------------------------------------------------------------- Markdown pages


def front_matter(content) -> tuple[Column, Column]:
    """(raw head, body) of a page: a text that does not open with `---` is all body."""
    content = T.as_column(content)
    shape = r"\A---\n(?s:(.*?))\n---\n?(?s:(.*))\z"
    has = content.rlike(r"\A---\n(?s:.*?)\n---")
    head = F.when(has, F.regexp_extract(content, shape, 1)).otherwise("")
    body = F.when(has, T.strip(F.regexp_extract(content, shape, 2))).otherwise(content)
    return head, body


def meta_map(head: Column) -> Column:
    """Flat `key: value` and list entries of a head as MAP<STRING,STRING> (raw values)."""
    entry = r"(?m)^([A-Za-z_][\w-]*):[ \t]*([^\n]*(?:\n(?:[ \t]*- |[ \t]+\S)[^\n]*)*)$"
    keys, raw = T.find_all(head, entry, 1), T.find_all(head, entry, 2)
    # a key said twice keeps its last value, as a YAML reader does
    return F.map_from_entries(
        T.let(
            F.arrays_zip(keys.alias("k"), raw.alias("v")),
            lambda es: F.transform(
                F.array_distinct(F.transform(es, lambda e: e["k"])),
                lambda k: F.struct(k.alias("k"), F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"].alias("v")),
            ),
        )
    )


def meta_text(value: Column) -> Column:
    """A scalar entry: quotes off, `null` and empty are NULL."""
    plain = T.strip(value)
    bare = F.regexp_replace(plain, r"""^(["'])(.*)\1$""", "$2")
    return F.when(~plain.isin("", "null", "~"), bare)


def meta_list(value: Column) -> Column:
    """A list entry, block or inline style, as ARRAY<STRING>."""
    block = F.transform(T.find_all(value, r"(?m)^[ \t]*- (.*)$", 1), meta_text)
    inline = F.transform(
        T.find_all(F.regexp_extract(value, r"(?s)^\s*\[(.*)\]\s*$", 1), r"""\s*("[^"]*"|'[^']*'|\[\[[^\]]*\]\]|[^,\s][^,]*)""", 1), meta_text
    )
    listed = F.when(T.strip(value).startswith("["), inline).otherwise(block)
    return F.coalesce(F.array_compact(listed), F.array().cast("array<string>"))


def parse_pages(files: DataFrame) -> DataFrame:
    """`files(path, content)` as wiki pages; `kind` is the folder, `stem` the file name."""
    head, body = front_matter("content")
    split = files.select("path", head.alias("head"), body.alias("body")).withColumn("meta", meta_map(F.col("head")))
    text = lambda k: meta_text(F.try_element_at("meta", F.lit(k)))
    many = lambda k: meta_list(F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit("")))
    day = lambda k: F.try_to_date(text(k))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    kind = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return split.select(
        F.abs(F.xxhash64("path")).alias("page_id"), "path", stem.alias("stem"), kind.alias("kind"),
        kind_ord(kind).alias("kind_ord"), F.coalesce(text("title"), stem).alias("title"), text("title").alias("meta_title"),
        many("aliases").alias("aliases"), many("sources").alias("sources"), text("summary").alias("summary"),
        text("url").alias("url"), text("content_hash").alias("content_hash"), many("tags").alias("tags"),
        text("status").alias("status"), text("kind").alias("doc_kind"), day("captured").alias("captured"),
        day("processed").alias("processed"), day("read").alias("read"), day("updated").alias("updated"),
        F.try_to_number(text("summary_sources"), F.lit("999999")).cast("int").alias("summary_sources"),
        F.try_to_number(text("format"), F.lit("999999")).cast("int").alias("format"), "body", "meta",
    )


def read_pages(spark: SparkSession, path: str, kinds: tuple[str, ...] = V.PAGE_KINDS) -> DataFrame:
    """The Markdown pages under `path/<kind>/*.md`, one row per file."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    files = raw.select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.col("value").alias("content"))
    return parse_pages(files).filter(F.col("kind").isin(*kinds))


# ------------------------------------------------------------------------------------ JSON lines


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per line. Strict: any bad line is an error that names it."""
    plain = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    typed = StructType(plain.fields).add(CORRUPT, "string")
    rows = spark.read.schema(typed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    if not strict:
        return rows
    needed = F.lit(False)
    for f in plain.fields:
        if not f.nullable:
            needed = needed | F.col(f.name).isNull()
    bad = rows.filter(F.col(CORRUPT).isNotNull() | needed).select(F.to_json(F.struct("*")).alias("line")).limit(1).collect()
    if bad:
        raise ValueError(f"bad line in {path}: {bad[0]['line']}")
    return rows.drop(CORRUPT)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "question string not null, expect array<string> not null")


RUNS_SCHEMA = (
    "started timestamp, finished timestamp, ingested int, skipped int, failed int, tokens_used bigint, "
    "stopped_by string, trigger string"
)


# ----------------------------------------------------------------------------- incremental scans


def file_manifest(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, modified, size) of the files under `path`; their bytes are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changed_pages(previous: DataFrame, now: DataFrame, same_layout: bool = True) -> DataFrame:
    """(path, change): new, changed, deleted against the previous manifest. Another layout version
    makes every page new."""
    if not same_layout:
        return now.select("path", F.lit("new").alias("change"))
    before = previous.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_b"))
    after = now.select("path", "modified", "size", F.lit(True).alias("_a"))
    joined = before.join(after, "path", "full_outer")
    change = (
        F.when(F.col("_b").isNull(), "new")
        .when(F.col("_a").isNull(), "deleted")
        .when((F.col("_m") != F.col("modified")) | (F.col("_s") != F.col("size")), "changed")
    )
    return joined.select("path", change.alias("change")).filter(F.col("change").isNotNull())


# ------------------------------------------------------------------------------------ file drops



def classify_drops(files: DataFrame, images: bool = False) -> DataFrame:
    """Dropped files `files(path, length, content)` with digest and `verdict`: take, links or unsupported."""
    from folioscope.functions.urls import urls_in

    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    takes = [".md", ".pdf"] + ([".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff"] if images else [])
    # only lists are read as text; bytes that are no UTF-8 become replacement characters
    listed = F.when(suffix == ".txt", F.make_valid_utf8(F.col("content").cast("string")))
    has_links = F.size(urls_in(listed)) > 0
    verdict = F.when(suffix.isin(*takes), "take").when((suffix == ".txt") & has_links, "links").otherwise("unsupported")
    return files.select("path", "length", F.sha2("content", 256).alias("digest"), verdict.alias("verdict"), "content")


def ingest_files(files: DataFrame, kept: DataFrame, images: bool = False) -> dict[str, DataFrame]:
    """New files once each: `new`, `duplicates` (same bytes under any name) and `unsupported`."""
    from folioscope.operators.common import first_by

    seen = classify_drops(files, images)
    unsupported = seen.filter("verdict = 'unsupported'").select("path")
    usable = seen.filter("verdict <> 'unsupported'").drop("content")
    known = kept.select("length", "digest").distinct()
    fresh = first_by(usable.join(known, ["length", "digest"], "left_anti"), ["length", "digest"], ["path"])
    return {
        "new": fresh,
        "duplicates": usable.join(fresh.select("path"), "path", "left_anti").select("path", "digest"),
        "unsupported": unsupported,
    }


# ----------------------------------------------------------------------------------------- sinks


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pages as parquet, one folder per kind."""
    pages.write.mode(mode).partitionBy("kind").parquet(path)


def append_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, keep: int = 500) -> DataFrame:
    """The newest `keep` runs of the log."""
    from folioscope.operators.runs import newest_runs

    return newest_runs(spark.read.parquet(path), keep)


def audit_rows(operations: DataFrame, touched: DataFrame) -> DataFrame:
    """One row per operation with what it touched: `operations(op_id, day, operation, title)`,
    `touched(op_id, change, title)`; details stay rows of their own, so none grows without bound."""
    details = F.concat("change", F.lit(": "), F.col("touched_title"))
    rows = operations.join(touched.withColumnRenamed("title", "touched_title"), "op_id", "left")
    return rows.select("day", "op_id", "operation", "title", F.coalesce(details, F.lit("")).alias("detail"))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("day").parquet(path)
