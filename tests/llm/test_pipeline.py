from __future__ import annotations

import random

import pytest

import corpus_pipeline
from parley.llm import queries

from .conftest import syllables


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rng = random.Random(12)
    clean = [syllables(rng, 120) for _ in range(60)]
    item = syllables(rng, 30)
    passage = "\n".join(syllables(rng, 20) for _ in range(4))
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, "%%% ".join(clean[1].split())), (102, "too short"), (103, item + " " + syllables(rng, 60)), (104, None)]
    rows += [(110 + k, f"{syllables(rng, 60)}\n{passage}") for k in range(3)]
    labels = [(k, 1, 0) for k in range(60)] + [(101, 0, 0)]
    d = tmp_path_factory.mktemp("sf")
    make_docs(rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), passage


def test_stages(spark, folder, tmp_path):
    d, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
    clean = set(range(60))
    assert clean | {100, 103, 110, 111, 112} <= kept[0].keys() and not kept[0].keys() & {102, 104}
    assert passage in kept[1][110].text and passage not in kept[1][111].text and kept[1][111].n_chars == len(kept[1][111].text)
    assert clean <= kept[2].keys() and 100 not in kept[2]
    assert clean <= kept[3].keys() and 103 not in kept[3]
    assert kept[4].keys() == kept[3].keys()
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
