"""The stream of a tree's changes: nothing lost, nothing told twice, batches of bounded size."""

import os
import random
from collections import Counter

import pytest

from sextant.sources.monitor import MonitorSource, Snapshots, changes, scan, told


def test_changes_and_bounds():
    rng = random.Random(3)
    for _ in range(200):
        a = sorted((f"/{k}", rng.randrange(3), 1, rng.random() < 0.1) for k in rng.sample(range(20), rng.randrange(15)))
        b = sorted((f"/{k}", rng.randrange(3), 1, rng.random() < 0.1) for k in rng.sample(range(20), rng.randrange(15)))
        old, new = {e[0]: e for e in a}, {e[0]: e for e in b}
        expected = Counter()
        for path in old | new:
            if path in old and path in new and old[path][3] == new[path][3]:
                expected["CHANGED", new[path]] += old[path] != new[path]
            else:
                expected["DELETED", old.get(path)] += path in old
                expected["CREATED", new.get(path)] += path in new
        assert Counter(changes(iter(a), iter(b))) == +expected
        # Step by step, so many changes at a time, all are told once.
        state, seen, steps = a, Counter(), 0
        while state != b:
            after = list(told(iter(state), iter(b), 3))
            seen.update(changes(iter(state), iter(after)))
            state, steps = after, steps + 1
            assert steps < 40
        assert seen.total() >= expected.total() and set(seen) >= set(+expected)


def test_snapshot_parts(tmp_path):
    kept = Snapshots(str(tmp_path), 1)
    entries = sorted([("/a\tb", 1, 2, False), ("/c\nd\\n", 3, 4, True), ("/\udcff", 5, 6, False), ("/ü", 1, 1, False)])
    kept.write(1, 0, iter(entries))
    kept.write(1, 0, iter([]))  # a second attempt changes nothing
    assert list(kept.read(1, 0)) == entries and list(kept.read(0, 0)) == []


def test_parts_share_a_folder(tmp_path):
    for k in range(300):
        (tmp_path / f"{k}").write_text("x")
    parts = [scan(str(tmp_path), p, 4) for p in range(4)]
    assert sum(map(len, parts)) == 300 and all(len(p) > 40 for p in parts)


@pytest.mark.parametrize("per_batch", [8, 1000])
def test_monitor_stream(spark, tmp_path, per_batch):
    spark.dataSource.register(MonitorSource)
    tree, out = tmp_path / "tree", tmp_path / "out"
    (tree / "a" / "b").mkdir(parents=True)
    for k in range(30):
        (tree / "a" / f"{k}.txt").write_text(str(k))
    name = f"monitor{per_batch}"

    def run(batches):
        """A new query from the same checkpoint, for so many batches more."""
        source = spark.readStream.format("sextant_monitor").option("path", str(tree)).option("snapshots", str(tmp_path / "snapshots")).option("partitions", 2).option("changesPerBatch", per_batch).load()
        sizes = []

        def keep(df, number):
            rows = df.collect()
            sizes.append(len(rows))
            seen.setdefault(number, [(r.seq, r.kind, os.path.relpath(r.path, tree)) for r in rows])

        query = source.writeStream.foreachBatch(keep).option("checkpointLocation", str(out)).trigger(processingTime="100 milliseconds").start()
        try:
            while len(sizes) < batches and query.exception() is None:
                query.awaitTermination(0.2)
            assert query.exception() is None
        finally:
            query.stop()
        return sizes

    seen: dict = {}
    first = run(2)
    assert max(first) <= per_batch
    (tree / "a" / "3.txt").write_text("longer than before")
    (tree / "a" / "4.txt").unlink()
    (tree / "new").mkdir()
    sizes = run(10 if per_batch == 8 else 3)  # after a restart
    assert max(sizes) <= per_batch
    kinds = Counter((kind, path) for rows in seen.values() for _, kind, path in rows)
    seqs = [s for rows in seen.values() for s, _, _ in rows]
    assert len(seqs) == len(set(seqs)) and all(n == 1 for n in kinds.values())
    state = set()
    for number in sorted(seen):
        for _, kind, path in sorted(seen[number]):
            state = state - {path} if kind == "DELETED" else state | {path}
    assert state == {"a", "a/b", "new", *(f"a/{k}.txt" for k in range(30) if k != 4)}
    assert per_batch == 8 or kinds["CHANGED", "a/3.txt"] == kinds["DELETED", "a/4.txt"] == 1
    assert len({p.name[:12] for p in (tmp_path / "snapshots").iterdir()}) <= 3
