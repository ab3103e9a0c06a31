"""Shared helpers of the training-data operators: sessions, folders, text access."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quernel.plans.lineage import remove, scratch, shared_dir, stored
from quernel.sources.tables import table

__all__ = ["as_bytes", "giving_way", "in_small_batches", "remove", "scratch", "shared_dir", "slices", "stored", "table"]


#: Rows of an Arrow batch. Texts are long: with Spark's 10,000 rows a batch takes tens of megabytes on either side.
BATCH_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame in a copy of its session that hands texts to Python in batches of BATCH_ROWS, unless the session was set
    otherwise. The session itself, and all that runs in it, stay as they are."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) != "10000":
        return df
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(name, str(BATCH_ROWS))
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own)


def giving_way(df: DataFrame, names: list[str], *needed: str) -> DataFrame:
    """The frame without columns that have the names of an operator's outputs: those give way to the outputs. A column that
    the operator needs can't."""
    taken = {n.lower() for n in names}
    if clash := [c for c in needed if c.lower() in taken]:
        raise ValueError(f"{clash} is needed and can't be an output's name too; give other output names")
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, budget: int = 4 << 20):
    """Parts of a batch of at most about `budget` bytes of the named texts or lists each, so that long ones don't pile up in a
    worker; a list's entry counts as much as the Python number that is made of it."""
    column = batch.column(name)
    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.fill_null(pc.multiply(pc.list_value_length(column), 36) if lists else pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
