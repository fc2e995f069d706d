"""Change events: collapsing, coalescing, in batch and as streams.

The rules are data and plain functions of one key's state, shared by the batch
form (sorted partitions, read once, with the state of one key) and the
streaming form (state kept per key).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sextant.functions.paths import ancestors, parent

# What becomes of a queued event and the next one of the same file.
# both: both stay; first, second: that one stays; merge: one event of the first's start and the second's end.
RULES = {
    ("CREATED", "CREATED"): "first", ("CREATED", "UPDATED"): "first", ("CREATED", "MOVED"): "created_at", ("CREATED", "DELETED"): "second",
    ("UPDATED", "CREATED"): "both", ("UPDATED", "UPDATED"): "fuller", ("UPDATED", "MOVED"): "both", ("UPDATED", "DELETED"): "second",
    ("MOVED", "CREATED"): "both", ("MOVED", "UPDATED"): "both", ("MOVED", "MOVED"): "merge", ("MOVED", "DELETED"): "deleted_from",
    ("DELETED", "CREATED"): "both", ("DELETED", "UPDATED"): "both", ("DELETED", "MOVED"): "both", ("DELETED", "DELETED"): "first",
}

Event = tuple[str, str, str, bool]  # kind, source, destination ("" if none), attributes only


def coalesce(queue: list[Event], event: Event) -> list[Event]:
    """The queue of one file after another event."""
    if not queue:
        return [event]
    first, rest = queue[-1], queue[:-1]
    rule = RULES[first[0], event[0]]
    if rule == "both":
        return [*queue, event]
    if rule == "first":
        return queue
    if rule == "second":
        return [*rest, event]
    if rule == "fuller":
        return [*rest, event] if first[3] and not event[3] else queue
    if rule == "created_at":
        return [*rest, ("CREATED", event[2], "", False)]
    if rule == "deleted_from":
        return [*rest, ("DELETED", first[1], "", False)]
    # Moved twice: from where it was to where it is, nothing if that is the same.
    return rest if first[1] == event[2] else [*rest, ("MOVED", first[1], event[2], False)]


OUT = "key string, pos int, kind string, source string, destination string"


def _sorted_runs(events: DataFrame, key: str, columns: list[str], schema: str, step: Callable[[list, tuple], tuple[list, list]], last: Callable[[list], list]) -> DataFrame:
    """Replays each key's events in order of ``seq``; only the state of one key is held at a time.

    step: (state, event) to (state, rows that are final); last: what is left in a state at the end.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, pos, out = object(), [], 0, []

        def emit(rows: list[tuple]) -> None:
            nonlocal pos
            for row in rows:
                out.append((current, pos, *row))
                pos += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(arrow), arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for own, *event in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != current:
                    emit(last(state))
                    current, state, pos = own, [], 0
                state, final = step(state, tuple(event))
                emit(final)
            yield flush()
        emit(last(state))
        yield flush()

    return events.select(key, *columns, "seq").repartition(key).sortWithinPartitions(key, "seq").select(key, *columns).mapInArrow(run, schema)


def coalesce_batch(events: DataFrame) -> DataFrame:
    """``key, pos, kind, source, destination`` of events (key, seq, kind, source, destination, attributes_only).

    A later event changes the last entry of a queue, and only two moves that
    undo each other uncover the one before, so entries before these are final.
    """

    def step(queue: list[Event], e: tuple) -> tuple[list[Event], list[tuple]]:
        kind, source, destination, attributes_only = e
        queue = coalesce(queue, (kind, source, destination or "", bool(attributes_only)))
        return queue[-2:], [x[:3] for x in queue[:-2]]

    return _sorted_runs(events, "key", ["kind", "source", "destination", "attributes_only"], OUT, step, lambda queue: [x[:3] for x in queue])


def coalesce_stream(events: DataFrame, idle_ms: int = 2000) -> DataFrame:
    """The same over a stream: a key's queue is emitted when no event came for ``idle_ms``."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue = [tuple(e) for e in json.loads(state.get[0])] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(keys[0], i, *e[:3]) for i, e in enumerate(queue)], columns=["key", "pos", "kind", "source", "destination"])
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        for e in rows.itertuples(index=False):
            queue = coalesce(queue, (e.kind, e.source, e.destination or "", bool(e.attributes_only)))
        state.update((json.dumps(queue),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(columns=["key", "pos", "kind", "source", "destination"])

    return events.groupBy("key").applyInPandasWithState(run, OUT, "queue string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def collapse(pending: str | None, kind: str) -> tuple[str | None, list[str]]:
    """(pending kind, kinds emitted) of one path after a monitor's event.

    A change is held until the monitor says it is done; created and deleted
    before that is nothing; attribute changes pass.
    """
    if kind == "ATTRIBUTE_CHANGED":
        return pending, [kind]
    if kind == "CREATED":
        return "CREATED", [pending] if pending == "DELETED" else []
    if kind == "CHANGED":
        return pending or "CHANGED", []
    if kind == "CHANGES_DONE":
        return None, [pending] if pending else []
    if kind == "DELETED":
        return (None, []) if pending == "CREATED" else ("DELETED", [])
    return None, ([pending] if pending else []) + [kind]


def collapse_batch(events: DataFrame) -> DataFrame:
    """``path, pos, kind`` of monitor events (path, seq, kind), what is held at the end included."""

    def step(state: list[str], e: tuple) -> tuple[list[str], list[tuple]]:
        pending, emitted = collapse(state[0] if state else None, e[0])
        return [pending] if pending else [], [(k,) for k in emitted]

    return _sorted_runs(events, "path", ["kind"], "path string, pos int, kind string", step, lambda state: [(k,) for k in state])


def collapse_stream(events: DataFrame, idle_ms: int = 2000) -> DataFrame:
    """The same over a stream; what is held is emitted when the path is idle."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, pos = state.get if state.exists else (None, 0)
        out: list[str] = []
        if state.hasTimedOut:
            out = [pending] if pending else []
            state.remove()
        else:
            for kind in pd.concat(list(parts)).sort_values("seq")["kind"]:
                pending, emitted = collapse(pending, kind)
                out += emitted
            state.update((pending, pos + len(out)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"path": [keys[0]] * len(out), "pos": range(pos, pos + len(out)), "kind": out})

    return events.groupBy("path").applyInPandasWithState(run, "path string, pos int, kind string", "pending string, pos int", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Parts that the events of one folder are dealt over.
SALTS = 16


def without_purged(events: DataFrame) -> DataFrame:
    """Queued events without those below a folder that a later event deletes or moves."""
    purges = events.where(F.col("kind").isin("DELETED", "MOVED")).groupBy(F.col("source").alias("folder")).agg(F.max("seq").alias("purged"))
    folders = events.select(parent(F.col("source")).alias("at")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    above = folders.select("at", F.explode(ancestors(F.col("at"))).alias("folder")).join(purges, "folder").groupBy("at").agg(F.max("purged").alias("purged")).select("at", "purged", salts)
    own = events.withColumns({"at": parent(F.col("source")), "salt": F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")})
    kept = own.join(above, ["at", "salt"], "left").where(~F.coalesce(F.col("seq") < F.col("purged"), F.lit(False)))
    return kept.select(*events.columns)


def emitted_moves(source_ok, destination_ok):
    """Kind of event of a move between indexable and other places."""
    return F.when(source_ok & destination_ok, "MOVED").when(source_ok, "DELETED").when(destination_ok, "CREATED")
