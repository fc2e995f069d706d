"""Tags and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_tags(tags: DataFrame, edges: DataFrame, labels: list[str] | None = None, limit: int = 512) -> DataFrame:
    """Every tag with the number of its resources, 0 included."""
    some = tags.where(F.col("label").isin(labels)) if labels else tags
    counted = some.join(edges.withColumnRenamed("tag_urn", "urn"), "urn", "left").groupBy("urn", "label", "description").agg(F.count("subject").alias("n"))
    return counted.orderBy("label").limit(limit)


def with_all_tags(tags: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """Resources that have all of the labels that exist; none if no label does."""
    known = tags.where(F.col("label").isin(labels)).select(F.col("urn").alias("tag_urn"))
    wanted = known.agg(F.countDistinct("tag_urn").alias("wanted"))
    held = edges.join(known, "tag_urn").groupBy("subject").agg(F.countDistinct("tag_urn").alias("held"))
    return held.join(F.broadcast(wanted), F.col("held") == F.col("wanted")).select("subject").orderBy("subject")


def files_of(tags: DataFrame, edges: DataFrame, files: DataFrame, label: str) -> DataFrame:
    """What a tag is on: the file where there is one, else the resource itself."""
    on = edges.join(tags.where(F.col("label") == label).select(F.col("urn").alias("tag_urn")), "tag_urn", "left_semi")
    return on.join(files.select("subject", "stored_as"), "subject", "left").select(F.coalesce("stored_as", "subject").alias("uri")).distinct().orderBy("uri")


def tags_of(tags: DataFrame, edges: DataFrame, files: DataFrame, uri: str) -> DataFrame:
    one = files.where(F.col("stored_as") == uri).select("subject")
    return edges.join(one, "subject", "left_semi").join(tags.withColumnRenamed("urn", "tag_urn"), "tag_urn").select("label").orderBy("label")


def urns_of(files: DataFrame, uris: list[str], edges: DataFrame | None = None, tag_urn: str | None = None) -> DataFrame:
    found = files.where(F.col("stored_as").isin(uris))
    if edges is not None:
        found = found.join(edges.where(F.col("tag_urn") == tag_urn), "subject", "left_semi")
    return found.select("subject", F.col("stored_as").alias("uri")).orderBy("subject")


def add_tag(tags: DataFrame, urn: str, label: str, description: str) -> DataFrame:
    """Inserted unless there is a tag of that label."""
    new = tags.sparkSession.createDataFrame([(urn, label, description)], "urn string, label string, description string")
    return tags.unionByName(new.join(tags.select("label"), "label", "left_anti").select(tags.columns))


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Many at once, all columns as they are: of new tags with one label the first by urn, unless there is a tag of that label."""
    first = new.groupBy("label").agg(F.min_by(F.struct(*tags.columns), "urn").alias("t")).select("t.*")
    return tags.unionByName(first.join(tags.select("label"), "label", "left_anti").select(tags.columns))


def tag_resources(edges: DataFrame, resources: DataFrame, tag_urn: str) -> DataFrame:
    return edges.unionByName(resources.select("subject", F.lit(tag_urn).alias("tag_urn"))).distinct()


def untag_resources(edges: DataFrame, resources: DataFrame, tag_urn: str) -> DataFrame:
    gone = resources.select("subject", F.lit(tag_urn).alias("tag_urn"))
    return edges.join(gone, ["subject", "tag_urn"], "left_anti")


def remove_tag(tags: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    urns = tags.where(F.col("label") == label).select(F.col("urn").alias("tag_urn"))
    return tags.where(F.col("label") != label), edges.join(urns, "tag_urn", "left_anti").select(edges.columns)


def limit_reached(listed: DataFrame, limit: int = 512) -> DataFrame:
    """``shown, reached``: how many tags a list has, and whether there may be more than its limit let through."""
    return listed.agg(F.count("*").alias("shown")).select("shown", (F.col("shown") >= limit).alias("reached"))
