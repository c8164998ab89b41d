"""The pipeline: each stage on all its predecessor kept, against what the operators' plain versions say."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import token_ids


def prose(seed, n=90):
    r = random.Random(seed)
    return " ".join(["the", "of", "and"] + ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 5))) for _ in range(n)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(i)) for i in range(200)]
    for i in range(0, 200, 5):
        ws = rows[i][1].split(" ")
        for k in range(4):
            ws[10 * k + i % 7] = "zwixx" + "abcdefgh"[(i + k) % 8]
        rows[i] = (i, " ".join(ws))
    passage = prose(999, 60)
    rows += [(301, prose(301) + "\n" + passage), (302, prose(302) + "\n" + passage), (303, prose(303)), (304, prose(303)), (305, "#### $$$$ " * 60), (306, None), (307, ""), (308, "short")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == first.columns and docs.dtypes == first.dtypes, name
        docs = spark.createDataFrame(docs.collect(), first.schema)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_copies", "packing"]
    toxic = set(range(0, 200, 5))
    assert len(toxic & set(seen["toxicity"])) <= 2 and len(seen["toxicity"]) >= 160
    assert not {305, 306, 307, 308} & set(seen["quality"]) and len(seen["quality"]) >= 155
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["quality"]) and lines[302]["text"] == prose(302) and "\n" in lines[301]["text"] and lines[304]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert set(seen["near_copies"]) == set(lines)


def test_run_packs_what_is_kept(spark, folder):
    library = Tokenizer.from_file(token_ids.tokenizer_path())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and np.sum(list(got.values())) > 0


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
