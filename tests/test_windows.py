"""Windows of a stream: what is late is dropped, what is over is given once."""

import json
import os

from sextant.streaming import windows

SCHEMA = "path string, at timestamp"


def _batches(folder, *batches):
    for k, rows in enumerate(batches):
        file = folder / f"{k}.json"
        file.write_text("\n".join(json.dumps({"path": p, "at": f"2024-01-01T{t}Z"}) for p, t in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))


def _run(spark, tmp_path, form, *batches):
    source = tmp_path / "in"
    source.mkdir()
    _batches(source, *batches)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    query = form(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_late_events_are_dropped(spark, tmp_path):
    found = _run(
        spark,
        tmp_path,
        lambda e: windows.updates_per_window(e, "path", "at").selectExpr("path", "date_format(start, 'HH:mm') AS start", "updates"),
        [("/a", "10:00:10"), ("/a", "10:00:50"), ("/b", "10:01:05")],
        [("/a", "10:00:20"), ("/b", "10:09:00")],  # within the bound, as the watermark is 09:59:05
        [("/b", "10:20:00")],  # the watermark is 10:07:00 now, so the first windows are given
        [("/a", "10:00:30"), ("/b", "10:40:00")],  # /a's window was given: dropped
    )
    assert sorted(found) == [("/a", "10:00", 3), ("/b", "10:01", 1), ("/b", "10:09", 1), ("/b", "10:20", 1)]


def test_one_notice_a_session(spark, tmp_path):
    found = _run(
        spark,
        tmp_path,
        lambda e: windows.notices(e, "path", "at").selectExpr("path", "updates"),
        [("/a", "10:00:00"), ("/a", "10:00:01"), ("/b", "10:00:01")],
        [("/a", "10:00:02"), ("/b", "10:05:00")],
        [("/b", "10:10:00")],
    )
    assert sorted(found) == [("/a", 3), ("/b", 1), ("/b", 1)]
