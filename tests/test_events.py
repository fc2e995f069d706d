import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sextant.streaming import events

C, U, A, D = ("CREATED", "/f", "", False), ("UPDATED", "/f", "", False), ("UPDATED", "/f", "", True), ("DELETED", "/f", "", False)
M, M2 = ("MOVED", "/f", "/g", False), ("MOVED", "/g", "/h", False)


@pytest.mark.parametrize(
    ("first", "second", "queue"),
    [
        (C, C, [C]), (C, U, [C]), (C, M, [("CREATED", "/g", "", False)]), (C, D, [D]), (U, C, [U, C]), (U, U, [U]), (A, U, [U]), (U, A, [U]), (U, M, [U, M]), (U, D, [D]),
        (M, C, [M, C]), (M, U, [M, U]), (M, M2, [("MOVED", "/f", "/h", False)]), (M, ("MOVED", "/g", "/f", False), []), (M, D, [D]), (D, C, [D, C]), (D, U, [D, U]), (D, M, [D, M]), (D, D, [D]),
    ],
)
def test_coalesce(first, second, queue):
    assert events.coalesce(events.coalesce([], first), second) == queue


def run(kinds):
    pending, out = None, []
    for k in kinds:
        pending, emitted = events.collapse(pending, k)
        out += emitted
    return out, pending


def test_collapse():
    assert run(["CREATED", "CHANGED", "CHANGES_DONE"]) == (["CREATED"], None)
    assert run(["CREATED", "DELETED"]) == ([], None)
    assert run(["CHANGED", "CHANGED", "CHANGES_DONE"]) == (["CHANGED"], None)
    assert run(["CHANGED", "ATTRIBUTE_CHANGED"]) == (["ATTRIBUTE_CHANGED"], "CHANGED")
    assert run(["DELETED"]) == ([], "DELETED")
    assert run(["CHANGED", "MOVED_OUT"]) == (["CHANGED", "MOVED_OUT"], None)


def test_replay_of_a_hot_key(spark):
    """Against whole queues and lists kept in memory, with one key that holds most events."""
    rng = random.Random(8)
    places = ["/a", "/b", "/c"]
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice(["CREATED", "UPDATED", "MOVED", "DELETED"]), rng.choice(places), rng.choice(places), rng.random() < 0.5) for i in range(3000)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, seq long, kind string, source string, destination string, attributes_only boolean")
    expected = []
    for key in ("hot", "x", None):
        queue = []
        for r in rows:
            if r[0] == key:
                queue = events.coalesce(queue, (*r[2:5], r[5]))
        expected += [(key, i, *e[:3]) for i, e in enumerate(queue)]
    assert sorted(map(tuple, events.coalesce_batch(frame).collect()), key=str) == sorted(expected, key=str)
    kinds = ["CREATED", "CHANGED", "ATTRIBUTE_CHANGED", "CHANGES_DONE", "DELETED", "MOVED_OUT"]
    monitor = [(r[0], r[1], rng.choice(kinds)) for r in rows]
    expected = []
    for key in ("hot", "x", None):
        out, pending = run([k for p, _, k in monitor if p == key])
        expected += [(key, i, k) for i, k in enumerate(out + ([pending] if pending else []))]
    got = events.collapse_batch(spark.createDataFrame(monitor, "path string, seq long, kind string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert events.coalesce_batch(frame.limit(0)).count() == 0


def stream(spark, tmp_path, frame, rows, schema, name):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(rows):
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(folder / f"{i}.json", (10**9 + i, 10**9 + i))  # files are taken by age
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = frame(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(240):
            if query.exception():
                raise query.exception()
            if spark.table(name).count():
                break
            time.sleep(0.25)
        return [r.asDict() for r in spark.table(name).collect()]
    finally:
        query.stop()


def test_coalesce_stream(spark, tmp_path):
    event = lambda seq, kind, to="": {"key": "f", "seq": seq, "kind": kind, "source": "/f", "destination": to, "attributes_only": False}
    rows = [[event(1, "CREATED"), event(2, "UPDATED")], [event(3, "MOVED", "/g")]]
    out = stream(spark, tmp_path, lambda s: events.coalesce_stream(s, 12_000), rows, "key string, seq long, kind string, source string, destination string, attributes_only boolean", "coalesced")
    assert [(r["kind"], r["source"]) for r in out] == [("CREATED", "/g")]


def test_collapse_stream(spark, tmp_path):
    rows = [[{"path": "p", "seq": i, "kind": k} for i, k in enumerate(("CREATED", "CHANGED", "CHANGES_DONE"))]]
    out = stream(spark, tmp_path, lambda s: events.collapse_stream(s, 1000), rows, "path string, seq long, kind string", "collapsed")
    assert [r["kind"] for r in out] == ["CREATED"]


def test_purge(spark):
    e = spark.createDataFrame([(1, "UPDATED", "/a/b/c"), (2, "DELETED", "/a/b"), (3, "CREATED", "/a/b/c"), (4, "UPDATED", "/a/bc")], "seq long, kind string, source string")
    assert sorted(r.seq for r in events.without_purged(e).collect()) == [2, 3, 4]
    assert spark.range(1).select(events.emitted_moves(F.lit(True), F.lit(False)).alias("k")).first().k == "DELETED"
