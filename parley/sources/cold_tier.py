"""The cold tier as a data source of its own: months are partitions, filters prune them, and what can't be read is told.

    cold_tier.register(spark)
    spark.read.format("cold_tier").schema(...).option("path", folder).load()

A folder has a folder ``time_bucket=YYYY-MM`` of Parquet files for each month, as
:func:`parley.operators.cold.write` makes them.  A file that can't be read gives one row:
its month, ``file`` and ``error``, all else null.  The other files go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

MONTH, FILE, ERROR = "time_bucket", "file", "error"
#: Columns that every row has, after those of the files.
TOLD = StructType([StructField(MONTH, StringType()), StructField(FILE, StringType()), StructField(ERROR, StringType())])
_COMPARED = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, EqualTo: pc.equal}


def _folder(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def whole(file: str) -> bool:
    """Whether a file can be opened and has a Parquet footer."""
    files, at = _folder(file)
    try:
        with files.open_input_file(at) as source:
            pq.ParquetFile(source)
    except (OSError, pa.ArrowException):
        return False
    return True


@dataclass
class Month(InputPartition):
    """One file of a month; a partition of its own, so that a large month is several tasks'."""

    month: str
    file: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.filters = schema, options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value are made here; the others are Spark's.

        A told file must come out whatever is asked of its messages, so only filters on
        the month decide about files.
        """
        for f in filters:
            known = len(f.attribute) == 1 and f.attribute[0] in self.schema.names if isinstance(f, (*_COMPARED, In)) else False
            if known and f.attribute[0] not in (FILE, ERROR):
                self.filters.append(f)
            if not known or f.attribute[0] != MONTH:
                yield f  # messages are compared again, so that no row is taken for another

    def _wanted(self, month: str) -> bool:
        for f in self.filters:
            if f.attribute[0] == MONTH:
                value = pa.scalar(month)
                ok = month in f.value if isinstance(f, In) else _COMPARED[type(f)](value, pa.scalar(f.value)).as_py()
                if not ok:
                    return False
        return True

    def partitions(self) -> list[Month]:
        files, at = _folder(self.path)
        found = []
        for info in files.get_file_info(pfs.FileSelector(at, recursive=True, allow_not_found=True)):
            month = re.search(rf"/{MONTH}=([^/]*)/[^/]*\.parquet$", info.path)
            if info.type == pfs.FileType.File and month and self._wanted(month[1]):
                found.append(Month(month[1], info.path))
        return sorted(found, key=lambda p: (p.month, p.file))

    def read(self, partition: Month | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without files Spark asks once
            return
        files, _ = _folder(self.path)
        whole = to_arrow_schema(self.schema)
        own = [f for f in whole if f.name not in (MONTH, FILE, ERROR)]
        try:
            with files.open_input_file(partition.file) as source:
                stored = pq.ParquetFile(source)
                names = [f.name for f in own if f.name in stored.schema_arrow.names]
                for batch in stored.iter_batches(columns=names):
                    yield self._batch(batch, whole, partition, None)
        except (OSError, pa.ArrowException) as error:
            none = pa.RecordBatch.from_pylist([{}], schema=pa.schema(own))
            yield self._batch(none, whole, partition, f"{type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}")

    def _batch(self, batch: pa.RecordBatch, whole: pa.Schema, partition: Month, error: str | None) -> pa.RecordBatch:
        told = {MONTH: partition.month, FILE: partition.file, ERROR: error}
        columns = []
        for field in whole:
            if field.name in told:
                columns.append(pa.array([told[field.name]] * batch.num_rows, field.type))
            elif field.name in batch.schema.names:
                columns.append(batch[field.name].cast(field.type))
            else:
                columns.append(pa.nulls(batch.num_rows, field.type))
        made = pa.RecordBatch.from_arrays(columns, schema=whole)
        if error is None:
            for f in self.filters:
                if f.attribute[0] != MONTH:
                    column = made[f.attribute[0]]
                    keep = pc.is_in(column, pa.array(list(f.value), column.type)) if isinstance(f, In) else _COMPARED[type(f)](column, pa.scalar(f.value, column.type))
                    made = made.filter(keep)
        return made


class ColdTier(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cold_tier"

    def schema(self) -> str:
        raise ValueError("the cold tier takes a schema: an unreadable file can't give it")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ColdTier)


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the tier in ``path``, of files of ``schema``; with those that tell what can't be read."""
    register(spark)
    own = [StructField(f.name, f.dataType) for f in schema if f.name not in (MONTH, FILE, ERROR)]  # null where a file is told
    return spark.read.format("cold_tier").schema(StructType([*own, *TOLD])).option("path", path).load()


def messages(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(ERROR).isNull()).drop(FILE, ERROR)


def failures(rows: DataFrame) -> DataFrame:
    """(time_bucket, file, error) of what couldn't be read."""
    return rows.where(F.col(ERROR).isNotNull()).select(MONTH, FILE, ERROR)
