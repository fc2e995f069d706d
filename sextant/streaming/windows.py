"""Windows over change events as they arrive, with a bound on how late they may be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.feeds import debounce


def updates_per_window(events: DataFrame, key: str, time: str, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """``key, start, updates``: one row for each window that is over.

    A window is over when an event ``late`` after its end was seen in an
    earlier batch; the batch that gives it still counts its events, those of
    later batches are dropped and left to the next comparison of tree and store.
    """
    counted = events.withWatermark(time, late).groupBy(key, F.window(time, window).alias("w")).agg(F.count("*").alias("updates"))
    return counted.select(key, F.col("w.start").alias("start"), "updates")


def notices(events: DataFrame, key: str, time: str, gap: str = "2 seconds", late: str = "2 seconds") -> DataFrame:
    """debounce() of a stream: a notice is given once no event can join its session any more."""
    return debounce(events.withWatermark(time, late), key, time, gap)
