"""Helpers for whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of rows that go to a worker at once, where the session sets no bound of its own.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_BYTES, so that large contents fill neither the worker nor the executor's buffers."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that take long each, dealt over all tasks of a shuffle: a small file, or one of few row groups, is read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """To be broadcast if it has at most so many rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the same one in every run."""
    columns = df.columns
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
