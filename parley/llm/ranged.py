"""Running aggregates within groups of any size: a group may span many tasks.

Rows are range-sorted by group and order, and stored.  A group's rows in one range are
aggregated in order there; what its earlier ranges come to is added from a table of at
most two rows a range.  So no group, however large, is a single task's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored


def ranged(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` range-sorted by ``group`` and ``order`` and stored, with ``part`` (the range) and ``spot`` (the order in it)."""
    tie = fresh(rows, "tie")
    keys = [*group, *order, tie]
    parts = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return stored(parts.withColumns({"part": F.spark_partition_id(), "spot": F.monotonically_increasing_id()}), name)


#: Aggregates that are aggregates of their own results, and how two of these become one.
JOINED: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def running(rows: DataFrame, group: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows``, which :func:`ranged` gave, with running totals up to and with each row.

    ``totals`` has by name a key of JOINED and the column, without nulls, that it goes over.
    """
    key = ["part", *group]
    so_far = Window.partitionBy(*key).orderBy("spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumns({name: JOINED[kind][0](column).over(so_far) for name, (kind, column) in totals.items()})
    ends = rows.groupBy(*key).agg(*(JOINED[kind][0](column).alias(f"before_{name}") for name, (kind, column) in totals.items()))
    # only groups in more than one range have rows before: at most two groups a range
    several = ends.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    summed = (JOINED[kind][0](F.col(f"before_{name}")).over(earlier).alias(f"before_{name}") for name, (kind, _) in totals.items())
    before = ends.join(several, group).select(*key, *summed)
    joined = within.join(F.broadcast(before), key, "left")
    for name, (kind, _) in totals.items():
        old = F.col(f"before_{name}")
        joined = joined.withColumn(name, F.when(old.isNull(), F.col(name)).otherwise(JOINED[kind][1](F.col(name), old)))
    return joined.drop(*(f"before_{name}" for name in totals))
