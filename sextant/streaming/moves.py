"""Moves between watched places, and what monitor events mean for the index.

A monitor tells a move as two halves that share a cookie: moved out of one
place, moved into another.  One half may never come, as its place is not
watched.  ``paired`` joins halves that are at most ``patience`` apart in event
time into a move; a lone half is a deletion or a creation.  In batch the halves
of a cookie are replayed in order; as a stream a half waits in keyed state
under an event-time timer, with the same rule.

``notified`` then turns events into what the index has to do.  It knows which
places are indexable and which file names spoil their whole folder, and may
reach other paths than the event's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sextant.functions.paths import base_name, glob_regex, parent
from sextant.functions.strings import extension_changed
from sextant.streaming.events import _sorted_runs

HALVES = ("MOVED_OUT", "MOVED_IN")
#: seq, milliseconds, path, kind, whether it is a folder
Half = tuple[int, int, str, str, bool]
#: seq, kind, source, destination, whether it is a folder
Event = tuple[int, str, str, str | None, bool]
OUT = "seq long, kind string, source string, destination string, is_dir boolean"
TOLD = Row("seq", "kind", "source", "destination", "is_dir")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def alone(half: Half) -> Event:
    seq, _, path, kind, is_dir = half
    return seq, "DELETED" if kind == "MOVED_OUT" else "CREATED", path, None, is_dir


def pair(waiting: Half | None, half: Half, patience_ms: int) -> tuple[Half | None, list[Event]]:
    """(half that waits, events) of a cookie after another half; it meets the one before, in either order, if that is of the other kind and near enough."""
    if waiting is None:
        return half, []
    if waiting[3] == half[3] or abs(half[1] - waiting[1]) > patience_ms:
        return half, [alone(waiting)]
    out, into = (waiting, half) if waiting[3] == "MOVED_OUT" else (half, waiting)
    return None, [(max(out[0], into[0]), "MOVED", out[2], into[2], out[4])]


def _is_half() -> Column:
    """It looks at the time too, so that the filter stays above a watermark and all events move that on."""
    return F.when(F.col("ts").isNotNull(), F.col("kind").isin(*HALVES) & F.col("cookie").isNotNull()).otherwise(False)


def _others(events: DataFrame) -> DataFrame:
    """Events that are no halves; halves without a cookie or a time are alone."""
    rest = events.where(~F.coalesce(_is_half(), F.lit(False)))
    kind = F.when(F.col("kind") == "MOVED_OUT", "DELETED").when(F.col("kind") == "MOVED_IN", "CREATED").otherwise(F.col("kind"))
    return rest.select("seq", kind.alias("kind"), F.col("path").alias("source"), F.lit(None).cast("string").alias("destination"), "is_dir")


def _halves(events: DataFrame) -> DataFrame:
    return events.where(_is_half())


def paired(events: DataFrame, patience_ms: int = 2000) -> DataFrame:
    """``seq, kind, source, destination, is_dir`` of monitor events (seq, ts, path, kind, cookie, is_dir).

    A move has the seq of its later half.  Order within a cookie is by seq.
    """

    def step(state: list[Half], e: tuple) -> tuple[list[Half], list[Event]]:
        seq, ms, path, kind, is_dir = e
        waiting, found = pair(state[0] if state else None, (seq, ms, path, kind, is_dir), patience_ms)
        return [waiting] if waiting else [], found

    rows = _halves(events).select("cookie", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "path", "kind", "is_dir", "seq", F.col("seq").alias("own"))
    schema = "cookie string, pos int, seq long, kind string, source string, destination string, is_dir boolean"
    moves = _sorted_runs(rows, "cookie", ["own", "ms", "path", "kind", "is_dir"], schema, step, lambda state: [alone(h) for h in state])
    return moves.select("seq", "kind", "source", "destination", "is_dir").unionByName(_others(events))


class Pairing(StatefulProcessor):
    """The half of a cookie that waits, with a timer for the mate that never comes."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.half = handle.getValueState("half", "seq long, ms long, path string, kind string, is_dir boolean")

    def _due(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = tuple(self.half.get()) if self.half.exists() else None
        # The halves of a cookie in one batch are few: a cookie is one move.
        for r in sorted(rows, key=lambda r: r.seq):
            waiting, found = pair(waiting, (r.seq, r.ms, r.path, r.kind, r.is_dir), self.patience_ms)
            for e in found:
                yield TOLD(*e)
        self._due()
        if waiting is None:
            self.half.clear()
        else:
            self.half.update(waiting)
            # A mate at the very end of the patience is still one.
            self.handle.registerTimer(waiting[1] + self.patience_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.half.exists():
            yield TOLD(*alone(tuple(self.half.get())))
            self.half.clear()

    def close(self) -> None:
        pass


def paired_stream(events: DataFrame, patience_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """The same over a stream whose events are at most ``late`` behind; the session keeps its state in ROCKSDB.

    A lone half comes out when the watermark has passed its patience.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"timers need {PROVIDER} = {ROCKSDB}")
    rows = _halves(events.withWatermark("ts", late)).select("cookie", "seq", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "path", "kind", "is_dir")
    moves = rows.groupBy("cookie").transformWithState(Pairing(patience_ms), OUT, "Append", "EventTime")
    return moves.unionByName(_others(events))


def notified(events: DataFrame, indexable: Callable[[Column, Column], Column], spoiling: list[str], recursive: Callable[[Column], Column] | None = None) -> DataFrame:
    """``seq, pos, kind, source, destination, is_dir``: what the index has to do after events of ``paired``.

    ``indexable``: of a path and whether it is a folder; ``spoiling``: globs of
    file names that keep their folder out of the index; ``recursive``: whether
    a place is indexed with what is below it (all are, by default).  A created
    file that spoils deletes its folder; if one is deleted, the folder is
    crawled.  Of moves, what leaves the index is deleted, what comes into it
    created (a folder crawled), and a file whose extension changes is read again.
    """
    deep = recursive or (lambda path: F.lit(True))
    source, destination, is_dir, kind = F.col("source"), F.col("destination"), F.coalesce("is_dir", F.lit(False)), F.col("kind")
    spoils = F.lit(False)
    for g in spoiling:
        spoils = spoils | base_name(source).rlike(glob_regex(g))
    spoils = spoils & ~is_dir
    there, then = F.coalesce(indexable(source, is_dir), F.lit(False)), F.coalesce(indexable(destination, is_dir), F.lit(False))

    def told(what: str, path: Column, to: Column | None = None, folder: Column | None = None) -> Column:
        return F.struct(F.lit(what).alias("kind"), path.alias("source"), (to if to is not None else F.lit(None).cast("string")).alias("destination"), (folder if folder is not None else is_dir).alias("is_dir"))

    none = F.slice(F.array(told("", source)), 1, 0)
    crawl_too = lambda path, e: F.when(is_dir & deep(path), F.array(told("CRAWL", path), e)).otherwise(F.array(e))
    created = F.when(spoils, F.array(told("DELETED", parent(source), None, F.lit(True)))).when(there, crawl_too(source, told("CREATED", source))).otherwise(none)
    deleted = F.when(spoils, F.array(told("CRAWL", parent(source), None, F.lit(True)))).when(there, F.array(told("DELETED", source))).otherwise(none)
    as_new = F.when(is_dir & deep(destination), F.array(told("CRAWL", destination))).otherwise(F.array(told("CREATED", destination)))
    move = told("MOVED", source, destination)
    move = F.when(is_dir & ~deep(source) & deep(destination), F.array(told("CRAWL", destination), move)).otherwise(F.array(move))
    again = F.when(extension_changed(base_name(source), base_name(destination)), F.array(told("UPDATED", destination))).otherwise(none)
    moved = F.when(there & then, F.concat(move, again)).when(there, F.array(told("DELETED", source))).when(then, as_new).otherwise(none)
    updated = F.when(there, F.array(told("UPDATED", source))).otherwise(none)
    attributes = F.when(there, F.array(told("ATTRIBUTES", source))).otherwise(none)
    tells = F.when(kind == "CREATED", created).when(kind == "DELETED", deleted).when(kind == "MOVED", moved).when(kind == "CHANGED", updated).when(kind == "ATTRIBUTE_CHANGED", attributes).otherwise(none)
    return events.select("seq", F.posexplode(tells).alias("pos", "e")).select("seq", "pos", "e.*")
