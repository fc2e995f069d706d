"""Feeds: latest messages, reconciliation, orphans, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(items: DataFrame, key: str, time: str, position: str) -> DataFrame:
    """The last published item per key; of equal times the first in the feed."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(position))
    return items.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reconcile(items: DataFrame, stored: DataFrame, key: str = "url", time: str = "published") -> DataFrame:
    """``key, action``: INSERT unknown items, UPDATE newer ones, REFRESH the others (their channel only), KEEP what a feed no longer has."""
    both = items.select(key, F.col(time).alias("new"), F.lit(True).alias("here")).join(stored.select(key, F.col(time).alias("old"), F.lit(True).alias("known")), key, "full_outer")
    action = F.when(F.col("here").isNull(), "KEEP").when(F.col("known").isNull(), "INSERT").when(F.col("new") > F.col("old"), "UPDATE").otherwise("REFRESH")
    return both.select(key, action.alias("action"))


def without_orphans(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages whose channel there is."""
    return messages.join(channels.select(F.col("urn").alias("channel")), "channel", "left_semi").select(messages.columns)


def orphans(messages: DataFrame, channels: DataFrame) -> DataFrame:
    return messages.join(channels.select(F.col("urn").alias("channel")), "channel", "left_anti")


def scan_channels(channels: DataFrame, settings: DataFrame, ids: list[str] | None = None) -> DataFrame:
    both = channels.join(settings, "urn")
    return both.where(F.col("urn").isin(ids)) if ids else both


def refresh_interval(minutes: Column) -> Column:
    """At least a minute."""
    return F.greatest(minutes, F.lit(1))


def distinct_enclosures(enclosures: DataFrame) -> DataFrame:
    """One enclosure per message and url: the first."""
    return enclosures.groupBy("message", "url").agg(F.min("position").alias("position"))


def keep_predicates(quads: DataFrame, subjects: DataFrame, kept: list[str]) -> DataFrame:
    """Of some subjects only the quads with the kept predicates."""
    marked = quads.join(subjects.select("s", F.lit(True).alias("_hit")).distinct(), "s", "left")
    return marked.where(F.col("_hit").isNull() | F.col("p").isin(kept)).select(quads.columns)


def debounce(updates: DataFrame, key: str, time: str, gap: str = "2 seconds") -> DataFrame:
    """One notice per key for updates that follow each other within ``gap``."""
    session = F.session_window(time, gap)
    return updates.groupBy(key, session.alias("w")).agg(F.count("*").alias("updates")).select(key, F.col("w.end").alias("notified"), "updates")


def add_feeds(channels: DataFrame, new: DataFrame) -> DataFrame:
    """Channels with those of ``new`` whose url isn't known; of new ones with one url the first by urn."""
    first = new.groupBy("url").agg(F.min_by(F.struct(*channels.columns), "urn").alias("c")).select("c.*")
    return channels.unionByName(first.join(channels.select("url"), "url", "left_anti").select(channels.columns))


def delete_feeds(channels: DataFrame, messages: DataFrame, enclosures: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Channels, messages and enclosures without the feeds of some urls; what belongs to a feed goes with it."""
    left = channels.join(urls.select("url"), "url", "left_anti").select(channels.columns)
    kept = without_orphans(messages, left)
    return left, kept, without_orphan_enclosures(enclosures, kept)


def without_orphan_enclosures(enclosures: DataFrame, messages: DataFrame) -> DataFrame:
    """Enclosures whose message there is."""
    return enclosures.join(messages.select(F.col("urn").alias("message")), "message", "left_semi").select(enclosures.columns)


def insert_or_replace(quads: DataFrame, new: DataFrame) -> DataFrame:
    """What ``new`` says of a graph, subject and predicate takes the place of all that was said before; repeated quads are one."""
    said = new.select("g", "s", "p").distinct()
    return quads.join(said, ["g", "s", "p"], "left_anti").select(quads.columns).unionByName(new.select(quads.columns)).distinct()
