"""The driver's tables seen as a content index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.model import CLASSES, GRAPHS, MIMES

# Event types of the driver's stream and the change events they stand for.
KINDS = {"signup": "CREATED", "click": "UPDATED", "view": "UPDATED", "purchase": "MOVED", "error": "DELETED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("sn") % len(values) + 1)


def _urn(c: Column) -> Column:
    return F.concat(F.lit("urn:fileid:"), c.cast("string"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.substring("source", 4, 9).cast("int").alias("sn"))
    folder = F.concat(F.lit("file:///"), F.col("source"))
    return base.select(
        "doc_id", "sn", F.col("source").alias("data_source"), _urn(F.col("doc_id")).alias("ie"), folder.alias("container"),
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("url"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        _pick(GRAPHS).alias("graph"), _pick(CLASSES).alias("class"), _pick(MIMES).alias("mime"), F.substring("text", 1, 24).alias("title"), "text",
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("source").distinct().withColumn("sn", F.substring("source", 4, 9).cast("int"))
    there = F.col("sn") % 4 != 3
    return v.select(
        F.col("source").alias("urn"), F.concat(F.lit("file:///"), F.col("source")).alias("root_uri"), there.alias("available"), (F.col("sn") % 3 == 0).alias("is_removable"), (F.col("sn") % 5 == 0).alias("is_optical"),
        F.when(~there, F.timestamp_add("DAY", F.col("sn"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("unmount_date"),
    )


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(_urn(F.col("doc_id")).alias("ie")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    both = F.array(*[F.concat(F.lit(f"urn:tag:{c}:"), F.col(c).cast("string")) for c in ("quality", "toxic")])
    return labels.select(_urn(F.col("doc_id")).alias("subject"), F.explode(both).alias("tag_urn")).where("tag_urn IS NOT NULL").distinct()


def tags(spark: SparkSession) -> DataFrame:
    names = ["quality:0", "quality:1", "toxic:0", "toxic:1", "unused"]
    return spark.createDataFrame([(f"urn:tag:{n}", n, f"about {n}") for n in names], "urn string, label string, description string")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select(F.col("ie").alias("subject"), F.col("url").alias("stored_as"), F.col("url").alias("uri"), "file_name", "data_source", "class")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    return c.select(F.concat(F.lit("urn:channel:"), F.col("conv_id").cast("string")).alias("urn"), F.concat(F.lit("http://feeds/"), F.col("conv_id").cast("string")).alias("url"), F.concat(F.lit("Channel "), F.col("conv_id").cast("string")).alias("title"), (F.col("n") - 2).alias("update_interval"), F.col("conv_id"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return m.select(
        F.concat(F.lit("urn:message:"), key).alias("urn"), F.concat(F.lit("http://feeds/"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") % 3).cast("string")).alias("url"),
        F.concat(F.lit("urn:channel:"), F.col("conv_id").cast("string")).alias("channel"), F.substring("text", 1, 20).alias("title"), (F.col("turn") * 60).alias("published"), "text", "role", "conv_id", "turn",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: key, seq, kind, source, destination, attributes_only."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    at = F.concat(F.lit("/u/"), F.col("user_id").cast("string"))
    return e.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), at.alias("source"),
        F.when(kind == "MOVED", F.concat(at, F.lit("/"), F.col("event_id").cast("string"))).alias("destination"), (F.col("event_type") == "view").alias("attributes_only"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths /region/nation/customer."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    both = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.select("c_custkey", F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name").alias("path"), "n_name", "r_name", "n_nationkey")


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files on disk; a tenth of them is not there."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 != 3")
    return o.select(F.concat(F.lit("file:///o/"), F.col("o_orderkey").cast("string")).alias("uri"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.when(F.col("o_orderkey") % 7 == 0, 5).otherwise(0)).alias("mtime"), F.concat(F.lit("h"), F.col("o_orderpriority")).alias("hash"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the store knows them; a tenth of them is unknown."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 != 6")
    return o.select(
        F.concat(F.lit("file:///o/"), F.col("o_orderkey").cast("string")).alias("uri"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("mime"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("old")).otherwise(F.concat(F.lit("h"), F.col("o_orderpriority"))).alias("hash"),
    )
