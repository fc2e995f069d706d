from sextant.streaming import sink

SCHEMA = "uri string, mtime long, seq long"


def test_upsert_stream(spark, tmp_path):
    rows, out = tmp_path / "in", str(tmp_path / "table")
    rows.mkdir()

    def run():
        changes = spark.readStream.schema(SCHEMA).json(str(rows))
        sink.upsert_stream(changes, out, ["uri"], "seq").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(tuple(r) for r in sink.snapshot(spark, out, SCHEMA).select("uri", "mtime").collect())

    (rows / "a.json").write_text('{"uri":"x","mtime":1,"seq":1}\n{"uri":"x","mtime":2,"seq":2}\n{"uri":"y","mtime":1,"seq":3}\n')
    assert run() == [("x", 2), ("y", 1)]
    (rows / "b.json").write_text('{"uri":"y","mtime":9,"seq":4}\n')
    assert run() == [("x", 2), ("y", 9)]
    assert run() == [("x", 2), ("y", 9)]
    assert sink.snapshot(spark, out, SCHEMA, batch=-1).count() == 0
