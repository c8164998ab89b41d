"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINES = [
    "keywords", "fold_and_flat", "normalize_urls", "extract_html", "strip_chrome", "chunk_invariants", "drop_group_lines", "exact_dups",
    "dedup_captures", "bm25_from_text", "dense_search", "resolve_refs", "orphans", "broken_links", "unlinked_mentions",
    "similar_title_pairs", "hidden_pages", "forget_sources", "merge_concepts", "answer_support", "merge_notes", "catalogue",
    "queue_state", "budget_cutoff", "model_summary", "stream_dedup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("folioscope-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from folioscope.plans import registry

    registry.load_all()
    wanted = sys.argv[1:] or HEADLINES
    names = list(registry.QUERIES) if wanted == ["all"] else wanted
    registry.QUERIES["content_hash"](spark, folder).count()  # start the executors before the clock
    seconds = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).replace("sf", "")}))


if __name__ == "__main__":
    main()
