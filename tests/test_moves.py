"""Halves of moves in batch and as a stream, and what they mean for the index."""

import json
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.streaming import moves

RAW = "seq long, ts timestamp, path string, kind string, cookie string, is_dir boolean"


def at(ms):
    return f"2024-01-01 00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


@pytest.mark.parametrize(
    ("halves", "events"),
    [
        ([(1, 0, "/a", "MOVED_OUT"), (2, 500, "/b", "MOVED_IN")], [(2, "MOVED", "/a", "/b")]),
        ([(1, 0, "/b", "MOVED_IN"), (2, 2000, "/a", "MOVED_OUT")], [(2, "MOVED", "/a", "/b")]),
        ([(1, 0, "/a", "MOVED_OUT"), (2, 2001, "/b", "MOVED_IN")], [(1, "DELETED", "/a", None), (2, "CREATED", "/b", None)]),
        ([(1, 0, "/a", "MOVED_OUT")], [(1, "DELETED", "/a", None)]),
        ([(1, 0, "/b", "MOVED_IN")], [(1, "CREATED", "/b", None)]),
        ([(1, 0, "/a", "MOVED_OUT"), (2, 1, "/c", "MOVED_OUT"), (3, 2, "/b", "MOVED_IN"), (4, 3, "/d", "MOVED_IN")], [(1, "DELETED", "/a", None), (3, "MOVED", "/c", "/b"), (4, "CREATED", "/d", None)]),
    ],
)
def test_pair(halves, events):
    waiting, out = None, []
    for h in halves:
        waiting, found = moves.pair(waiting, (*h, False), 2000)
        out += found
    assert [e[:4] for e in out + ([moves.alone(waiting)] if waiting else [])] == events


def rows_of(df):
    return Counter((r.seq, r.kind, r.source, r.destination, r.is_dir) for r in df.collect())


def some_events(rng):
    rows, seq, ms = [], 0, 0
    for cookie in range(40):
        for _ in range(rng.choice((1, 1, 2, 2, 2, 3))):
            seq, ms = seq + 1, ms + rng.choice((100, 900, 2100))
            rows.append((seq, at(ms), f"/p{seq}", rng.choice(moves.HALVES), rng.choice((str(cookie), str(cookie), None)), rng.random() < 0.2))
        seq, ms = seq + 1, ms + 300
        rows.append((seq, at(ms), f"/q{seq}", rng.choice(("CREATED", "CHANGED", "DELETED")), None, False))
    return rows, ms


def test_batch_and_stream_agree(spark, tmp_path):
    rows, last = some_events(random.Random(4))
    batch = spark.createDataFrame(rows, RAW.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    expected = rows_of(moves.paired(batch))
    assert {k for _, k, *_ in expected} == {"MOVED", "CREATED", "DELETED", "CHANGED"}
    # Files of some events each; the last ones only move the watermark on.
    rows = rows + [(10**6 + k, at(last + 60_000 * (k + 1)), "/end", "CHANGED", None, False) for k in range(3)]
    folder = tmp_path / "in"
    folder.mkdir()
    names = [c.split()[0] for c in RAW.split(", ")]
    for i, k in enumerate(range(0, len(rows), 60)):
        (folder / f"{i}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows[k : k + 60]))
        os.utime(folder / f"{i}.json", (10**9 + i, 10**9 + i))
    before = spark.conf.get(moves.PROVIDER)
    with pytest.raises(ValueError, match="RocksDB"):
        moves.paired_stream(spark.readStream.schema(RAW).json(str(folder)))
    spark.conf.set(moves.PROVIDER, moves.ROCKSDB)
    try:
        source = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(folder))
        out = moves.paired_stream(source, late="1 seconds")
        query = out.writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
        found, until = None, time.monotonic() + 150
        while time.monotonic() < until and query.exception() is None:
            found = Counter({e: n for e, n in rows_of(spark.table("moves")).items() if e[0] < 10**6})
            if sum(found.values()) >= sum(expected.values()):
                break
            time.sleep(0.5)
        assert query.exception() is None
        query.stop()
        assert found == expected
    finally:
        spark.conf.set(moves.PROVIDER, before)


def test_notified(spark):
    rows = [
        (1, "CREATED", "/a/.nomedia", None, False), (2, "DELETED", "/a/.nomedia", None, False), (3, "CREATED", "/a/f", None, False), (4, "CREATED", "/no/f", None, False), (5, "CREATED", "/a/d", None, True),
        (6, "CHANGED", "/a/f", None, False), (7, "CHANGED", "/no/f", None, False), (8, "ATTRIBUTE_CHANGED", "/a/f", None, False), (9, "DELETED", "/a/d", None, True), (10, "DELETED", "/no/d", None, True),
        (11, "MOVED", "/a/f.txt", "/a/g.txt", False), (12, "MOVED", "/a/f.txt", "/a/g.md", False), (13, "MOVED", "/a/f", "/no/f", False), (14, "MOVED", "/no/f", "/a/f", False), (15, "MOVED", "/no/d", "/a/d", True), (16, "MOVED", "/no/f", "/no/g", False), (17, "MOVED", "/a/f", "/a/f.x", False),
        (18, "MOVED", "/flat/d", "/a/d", True), (19, "MOVED", "/a/d", "/flat/d", True), (20, "MOVED", "/no/d", "/flat/d", True),
    ]
    events = spark.createDataFrame(rows, moves.OUT)
    found = moves.notified(events, lambda path, is_dir: ~path.startswith("/no/"), [".nomedia"], lambda path: ~path.startswith("/flat/")).orderBy("seq", "pos")
    got = {}
    for r in found.collect():
        got.setdefault(r.seq, []).append((r.kind, r.source, r.destination))
    assert got == {
        1: [("DELETED", "/a", None)], 2: [("CRAWL", "/a", None)], 3: [("CREATED", "/a/f", None)], 5: [("CRAWL", "/a/d", None), ("CREATED", "/a/d", None)],
        6: [("UPDATED", "/a/f", None)], 8: [("ATTRIBUTES", "/a/f", None)], 9: [("DELETED", "/a/d", None)],
        11: [("MOVED", "/a/f.txt", "/a/g.txt")], 12: [("MOVED", "/a/f.txt", "/a/g.md"), ("UPDATED", "/a/g.md", None)], 13: [("DELETED", "/a/f", None)], 14: [("CREATED", "/a/f", None)], 15: [("CRAWL", "/a/d", None)],
        17: [("MOVED", "/a/f", "/a/f.x"), ("UPDATED", "/a/f.x", None)], 18: [("CRAWL", "/a/d", None), ("MOVED", "/flat/d", "/a/d")], 19: [("MOVED", "/a/d", "/flat/d")], 20: [("CREATED", "/flat/d", None)],
    }
