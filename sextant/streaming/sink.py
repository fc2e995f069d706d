"""Idempotent upserts of streams into versioned tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sextant.operators.diff import upsert

#: Keys are dealt over so many buckets; a batch rewrites those that it touches.
BUCKETS = 64


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, path: str, batch: int | None) -> dict[int, int]:
    """The last version of each bucket, up to a batch."""
    try:
        known = spark.read.schema("bucket int, version long").parquet(f"{path}/manifest")
    except AnalysisException:  # before the first batch
        return {}
    known = known if batch is None else known.where(F.col("version") <= batch)
    return {r.bucket: r.version for r in known.groupBy("bucket").agg(F.max("version").alias("version")).collect()}  # at most BUCKETS rows


def snapshot(spark: SparkSession, path: str, schema: str, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table after a batch (the last one by default), or some buckets of it; empty before the first."""
    found = [f"{path}/data/version={v}/bucket={b}" for b, v in _versions(spark, path, batch).items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def upsert_stream(changes: DataFrame, path: str, keys: list[str], order: str) -> DataStreamWriter:
    """Each micro-batch makes a new version of the buckets that it touches: its last row per key replaces the table's.

    The manifest, one file a batch, is written last.  A batch that runs again
    writes the same version again, so nothing is applied twice.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        touched = [r[0] for r in last.select(_bucket(keys)).distinct().collect()]  # at most BUCKETS rows
        if not touched:
            return
        before = snapshot(spark, path, schema, number - 1, touched)
        after = upsert(before, last.select(before.columns), keys).withColumn("bucket", _bucket(keys))
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")

    return changes.writeStream.foreachBatch(write)
