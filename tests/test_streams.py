"""Registered streams over tables that lie as one file or as a folder of files."""

import glob
import shutil

import pytest

from folioscope.plans import queries_streams as Q


def lay(rows, path, as_file):
    """Write `rows` to `path`: a folder of two files, or one file."""
    if not as_file:
        return rows.repartition(2).write.parquet(path)
    rows.coalesce(1).write.parquet(f"{path}-parts")
    shutil.copy(glob.glob(f"{path}-parts/part-*.parquet")[0], path)


@pytest.mark.parametrize("as_file", [True, False])
def test_tables_as_file_and_as_folder(spark, tmp_path, as_file):
    pages = [(1, "https://a.example/x"), (2, "https://a.example/x?utm_source=y"), (3, "https://b.example/"), (4, None)]
    lay(spark.createDataFrame(pages, "page_id long, url string"), f"{tmp_path}/pages.parquet", as_file)
    talk = [(1, 0, "user", "hello"), (1, 1, "assistant", "again"), (2, 0, "user", "hello")]
    lay(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), f"{tmp_path}/conversations.parquet", as_file)
    taken = [r["target_norm"] for r in Q.stream_dedup(spark, str(tmp_path)).collect()]
    assert sorted(taken) == ["https://a.example/x", "https://a.example/x?a=b", "https://b.example/", "https://b.example/?a=b"]
    assert Q.stream_mail_intake(spark, str(tmp_path)).count() == 2
