"""Intermediate tables in the folder that the cluster shares.

An intermediate result that is read more than once, or that cuts a long
lineage, is written as Parquet below ``spark.checkpoint.dir`` and read again.
The files outlive executors, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where the setting is absent (tests), a folder of this process."""
    path = spark.conf.get(SETTING, None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sextant/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has at most so many rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than this many rows, and more than this share of all, is dealt over parts.
HEAVY_ROWS, HEAVY_SHARE = 10_000, 1 / 10_000


def heavy_keys(counts: DataFrame, keys: list[str], times: str) -> DataFrame:
    """``keys, parts`` of the keys in ``counts`` with so many rows that they are dealt out; 1 / HEAVY_SHARE keys at most."""
    total = counts.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    rows = max(int(total * HEAVY_SHARE), HEAVY_ROWS)
    return stage(counts.where(F.col(times) > rows).select(*keys, F.ceil(F.col(times) / rows).alias("parts")), "heavy")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, salt: list[Column], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, none of which is null; both are shuffled at any size.

    The rows of ``left`` with a heavy key are dealt over its parts by ``salt``,
    and the rows of ``right`` with that key go to each part.
    """
    if heavy.isEmpty():
        return left.join(right.hint("merge"), keys, how)
    heavy = F.broadcast(heavy.withColumnRenamed("parts", "_parts"))  # bounded by HEAVY_SHARE
    dealt = left.join(heavy, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")
    each = right.join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - 1))).drop("_parts")
    return dealt.join(each.hint("merge"), [*keys, "_part"], how).drop("_part")


#: Hash values of keys that a filter tells apart.
BUCKETS = 1 << 20


def split_by(df: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of ``keys``, rows that have none), by the keys' hash values: BUCKETS at most are broadcast."""
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).alias("_bucket")
    known = F.broadcast(stage(keys.select(bucket).distinct(), "buckets"))
    marked = df.select("*", bucket)
    return tuple(marked.join(known, "_bucket", how).drop("_bucket") for how in ("left_semi", "left_anti"))


def text_hash(text: Column) -> Column:
    """With the id it tells rows apart; unlike a row number it is the same however often a table is computed."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_texts(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame, repeated: DataFrame | None = None, rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows in ``gone``, and with one row of each kind in ``repeated`` (both: doc_id, text_hash)."""
    mark, one, other = (f"_{k}_{uuid.uuid4().hex}" for k in ("hash", "id", "text"))
    marked = docs.withColumn(mark, text_hash(F.col(text_col)))

    def split(keys: DataFrame, how: str) -> DataFrame:
        keys = small(stage(keys.select(F.col("doc_id").alias(one), F.col("text_hash").alias(other)).distinct(), "keys"), rows)
        return marked.join(keys, marked[id_col].eqNullSafe(keys[one]) & (marked[mark] == keys[other]), how)

    if repeated is None or repeated.isEmpty():
        return split(gone, "left_anti").select(*docs.columns)
    once = split(repeated, "left_semi").dropDuplicates([id_col, text_col]).select(*docs.columns)
    return split(gone.unionByName(repeated), "left_anti").select(*docs.columns).unionByName(once)


def without_unkept(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``groups`` (doc_id, text_hash, kept), one row of it for each of theirs."""
    keys = stage(groups.groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "kept")
    keys_of = lambda which: keys.where(which).select("doc_id", "text_hash")
    return without_texts(docs, id_col, text_col, keys_of("NOT kept"), keys_of("kept AND n > 1"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that stage() or a writer made, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
