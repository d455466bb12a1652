from __future__ import annotations

from types import SimpleNamespace

import pytest

from parley.llm import common


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_shared_folder():
    assert common.shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    own = common.shared_dir(session("local[4]"))
    assert own == common.shared_dir(session("local[4]"))
    with pytest.raises(ValueError):
        common.shared_dir(session("yarn"))


def test_stored_and_forgotten(spark):
    df, path = common.store(spark.range(5), "t")
    assert df.count() == 5 and path.startswith("file:") and common.shared_dir(spark) in path
    common.forget(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_majority(spark):
    rows = [(1, 0), (1, 1), (2, 0), (2, None), (None, 1)]
    got = common.majority_labels(spark.createDataFrame(rows, "doc_id long, y int"), "doc_id", "y")
    assert sorted((r.key, r.label) for r in got.collect()) == [(1, 1), (2, 0)]


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Row int, _row int")
    assert common.fresh(df, "row") == "__row"


def test_folds_are_crc32(spark):
    import zlib

    got = spark.range(50).select("id", common.held_out(common.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_row_numbers_stay(spark, make_docs):
    scan = make_docs([(k, str(k)) for k in range(50)])
    own, row = common.numbered(scan, "t")
    assert row == "row" and "Scan" in own._jdf.queryExecution().executedPlan().toString() and common.shared_dir(spark) not in str(own.inputFiles())
    shuffled, row = common.numbered(scan.repartition(7).withColumn("row", common.F.rand()), "t")
    both = [dict(shuffled.select("doc_id", row).collect()) for _ in range(2)]
    assert row == "_row" and both[0] == both[1] and len(set(both[0].values())) == 50


def test_draws(spark):
    df = spark.range(4000)
    assert df.where(common.drawn(1.0, "id")).count() == 4000
    assert 300 < df.where(common.drawn(0.1, "id")).count() < 500
    assert ", 1)" in str(common.drawn(1e-30, "id"))  # never an empty range of hashes
