"""One hot key: the join that meets it is split between tasks in the plan that ran."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parley.llm import line_dedup, warc

SMALL = {
    "spark.sql.shuffle.partitions": "40",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def split(df) -> bool:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_lines(skewed, make_docs):
    docs = make_docs([(k, "\n" * 200 + f"own {k}") for k in range(1500)])
    own = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    gone = line_dedup.covered_lines(own, "row")
    assert split(gone)
    assert gone.count() == 1500


def test_payloads(skewed):
    rng = random.Random(1)
    rows = [(k, "%0200x" % rng.getrandbits(800), "p" * 1200 if k % 3 else f"{k} " + "q" * 1200) for k in range(6000)]
    pages = skewed.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    judged = warc.plan_records(pages)
    assert judged.where("record_type = 'revisit'").count() == 3999
    assert split(judged.select("page_id", "url", "record_type", "refers_to", "payload"))
