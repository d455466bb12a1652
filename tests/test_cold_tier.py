from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.operators import cold
from parley.sources import cold_tier

DAY = 86_400_000
KIND = "message_id long, conversation_id long, sender_id string, created_at_ms long, kind string, text string"


@pytest.fixture
def tier(spark, tmp_path):
    rows = [(k, k % 4, "ann", 1_704_067_200_000 + k * 10 * DAY, "text", None if k == 3 else f"body {k}") for k in range(30)]
    df = spark.createDataFrame(rows, KIND)
    cold.write(df, f"file:{tmp_path}/cold")
    return df, tmp_path / "cold"


def months(path: Path) -> list[Path]:
    return sorted(path.glob("time_bucket=*/*.parquet"))


def test_it_reads_what_was_written(spark, tier):
    df, path = tier
    rows = cold_tier.load(spark, f"file:{path}", df.schema)
    assert sorted(cold_tier.messages(rows).drop("time_bucket").collect()) == sorted(df.collect())
    assert not cold_tier.failures(rows).collect()
    some = rows.where((F.col("time_bucket") >= "2024-03") & (F.col("conversation_id") == 2) & (F.col("created_at_ms") < 1_704_067_200_000 + 200 * DAY))
    assert sorted(r.message_id for r in some.collect()) == [k for k in range(30) if k % 4 == 2 and 6 <= k < 20]


def test_a_broken_file_is_told_and_the_others_go_on(spark, tier):
    df, path = tier
    broken, gone = months(path)[1], months(path)[3]
    broken.write_bytes(b"no parquet")
    whole = gone.read_bytes()
    gone.write_bytes(whole[: len(whole) // 2])
    rows = cold_tier.load(spark, f"file:{path}", df.schema)
    told = {(r.time_bucket, Path(r.file).name) for r in cold_tier.failures(rows).collect()}
    assert told == {(p.parent.name.split("=")[1], p.name) for p in (broken, gone)}
    left = {r.message_id for r in cold_tier.messages(rows).collect()}
    lost = {m for m, _ in told}
    assert left == {r.message_id for r in df.collect() if cold_month(r) not in lost}
    early = rows.where(F.col("time_bucket") < min(lost))
    assert not cold_tier.failures(early).collect() and early.count() > 0


def cold_month(row) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(row.created_at_ms / 1000, timezone.utc).strftime("%Y-%m")


def test_pruned_months_are_no_partitions(spark, tier):
    df, path = tier
    reader = cold_tier._Reader(cold_tier.load(spark, f"file:{path}", df.schema).schema, {"path": f"file:{path}"})
    every = len(reader.partitions())
    left = list(reader.pushFilters([cold_tier.GreaterThanOrEqual(("time_bucket",), "2024-05"), cold_tier.EqualTo(("conversation_id",), 1)]))
    assert [f.attribute for f in left] == [("conversation_id",)]
    assert 0 < len(reader.partitions()) < every


def test_an_empty_folder_and_other_columns(spark, tier, tmp_path):
    df, path = tier
    (tmp_path / "none").mkdir()
    assert cold_tier.load(spark, f"file:{tmp_path}/none", df.schema).count() == 0
    from pyspark.sql.types import LongType, StructField, StructType

    wider = StructType([*df.schema, StructField("added", LongType())])
    rows = cold_tier.load(spark, f"file:{path}", wider)
    assert rows.where("added is null").count() == 30
