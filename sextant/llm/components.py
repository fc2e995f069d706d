"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of every node of ``edges`` (a, b): the label is the least id of its component.

    Every round each node takes the least label among its neighbours, then the
    label of its label, so that chains shorten to half.  Labels are written
    after every round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a != b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        jumped = lower.join(far, "label").select("id", F.least("label", "far").alias("label"), F.col("old"))
        rows = stage(jumped, "labels")
        labels = rows.select("id", "label")
        if rows.where("label != old").isEmpty():
            return labels


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label`` after ``links`` (a, b) between the ids: only the graph of the labels so far is searched."""
    one, other = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    between = links.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b").distinct()
    found = components(between).select(F.col("id").alias("label"), F.col("label").alias("merged"))
    return stage(labels.join(found, "label", "left").select("id", F.coalesce("merged", "label").alias("label")), "labels")
