"""Changes of a directory tree as a stream.

``spark.readStream.format("sextant_monitor")`` compares the tree with what the
stream has told so far.  A micro-batch is one comparison: its offset is the
number of the snapshot it leaves.  The entries of the tree are dealt over
partitions by their paths, so a folder of any size is shared by all of them;
each partition merges its sorted part of the tree with its part of the last
snapshot and writes its part of the next.

A partition tells at most so many changes; the next snapshot then holds just
what was told, and the rest is found by the next comparison.  So a first crawl
of a large tree comes in batches of bounded size.  A snapshot part is written
once: a batch that runs again, after a lost task or a restart, tells the same
changes from the two parts that are there, whatever has happened to the tree.
The folder of the snapshots is the stream's memory; like the tree it must be one
that all executors see.
"""

from __future__ import annotations

import datetime
import heapq
import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: path, modification time in nanoseconds, size, whether it is a folder
Entry = tuple[str, int, int, bool]
#: seq, milliseconds, path, kind, whether it is a folder
Change = tuple[int, int, str, str, bool]
SCHEMA = "seq long, ts timestamp, path string, kind string, is_dir boolean"


def scan(root: str, part: int, parts: int) -> list[Entry]:
    """The entries below a root that belong to a part, sorted; only these are looked at closely."""
    found, todo = [], [root]
    while todo:
        folder = todo.pop()
        try:
            entries = os.scandir(folder)
        except OSError:  # gone, or not to be read: as if it were empty
            continue
        with entries:
            for e in entries:
                try:
                    is_dir = e.is_dir(follow_symlinks=False)
                    if is_dir:
                        todo.append(e.path)
                    if zlib.crc32(os.fsencode(e.path)) % parts == part:
                        stat = e.stat(follow_symlinks=False)
                        # A folder's own time and size change with its entries, which are told themselves.
                        found.append((e.path, 0 if is_dir else stat.st_mtime_ns, 0 if is_dir else stat.st_size, is_dir))
                except OSError:  # gone between listing and look
                    continue
    return sorted(found)


def changes(before: Iterator[Entry], after: Iterator[Entry]) -> Iterator[tuple[str, Entry]]:
    """(kind, entry) of two sorted listings, by one pass over both."""
    old: Entry | None = None
    for path, _, entry, new in heapq.merge(((e[0], 0, e, False) for e in before), ((e[0], 1, e, True) for e in after), key=lambda x: x[:2]):
        if not new:
            if old:
                yield "DELETED", old
            old = entry
        elif old and old[0] == path:
            if old[3] != entry[3]:  # a folder in place of a file, or the other way round
                yield "DELETED", old
                yield "CREATED", entry
            elif old != entry:
                yield "CHANGED", entry
            old = None
        else:
            if old:
                yield "DELETED", old
                old = None
            yield "CREATED", entry
    if old:
        yield "DELETED", old


class Snapshots:
    """Parts of snapshots as sorted files; a part that is there is never written again."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts = folder, parts

    def path(self, number: int, part: int) -> str:
        return f"{self.folder}/{number:012d}-{part:05d}"

    def taken(self, number: int, part: int) -> float:
        with open(self.path(number, part), encoding="ascii") as f:
            return float(f.readline())

    def read(self, number: int, part: int) -> Iterator[Entry]:
        if number == 0:  # nothing was told yet
            return
        with open(self.path(number, part), encoding="ascii") as f:
            f.readline()
            for line in f:
                mtime, size, is_dir, path = line[:-1].split("\t", 3)
                yield json.loads(path), int(mtime), int(size), is_dir == "d"

    def write(self, number: int, part: int, entries: Iterator[Entry]) -> None:
        own = f"{self.path(number, part)}.{uuid.uuid4().hex}"
        with open(own, "w", encoding="ascii") as f:
            f.write(f"{time.time():.3f}\n")
            for path, mtime, size, is_dir in entries:
                f.write(f"{mtime}\t{size}\t{'d' if is_dir else 'f'}\t{json.dumps(path)}\n")
        try:
            os.link(own, self.path(number, part))  # fails if another attempt was first
        except FileExistsError:
            pass
        finally:
            os.unlink(own)


def told(before: Iterator[Entry], after: Iterator[Entry], most: int) -> Iterator[Entry]:
    """The listing before with the first ``most`` changes to the listing after: what is kept of a comparison that goes no further."""
    first: dict[str, Entry | None] = {}
    for _, (kind, entry) in zip(range(most), changes(iter(kept := list(before)), after), strict=False):
        first[entry[0]] = None if kind == "DELETED" else entry
    new = sorted(e for e in first.values() if e)
    yield from heapq.merge((e for e in kept if e[0] not in first), new, key=lambda e: e[0])


class Step(InputPartition):
    def __init__(self, start: int, end: int, part: int):
        self.start, self.end, self.part = start, end, part


class MonitorReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.parts = int(options.get("partitions", 8))
        self.most = max(1, int(options.get("changesPerBatch", 100_000)) // self.parts)
        self.snapshots = Snapshots(options["snapshots"].removeprefix("file://"), self.parts)
        os.makedirs(self.snapshots.folder, exist_ok=True)
        self.last = 0

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """One more than the last complete snapshot: each trigger is a comparison."""
        there: dict[int, int] = {}
        for name in os.listdir(self.snapshots.folder):
            number, _, part = name.partition("-")
            if part.isdigit():
                there[int(number)] = there.get(int(number), 0) + 1
        self.last = max([self.last, *(n for n, k in there.items() if k == self.parts)])
        return {"snapshot": self.last + 1}

    def partitions(self, start: dict, end: dict) -> list[Step]:
        return [Step(start["snapshot"], end["snapshot"], part) for part in range(self.parts)]

    def read(self, step: Step) -> Iterator[tuple]:
        for number in range(step.start + 1, step.end + 1):
            if not os.path.exists(self.snapshots.path(number, step.part)):
                now = iter(scan(self.root, step.part, self.parts))
                self.snapshots.write(number, step.part, told(self.snapshots.read(number - 1, step.part), now, self.most))
            at = datetime.datetime.fromtimestamp(self.snapshots.taken(number, step.part), datetime.UTC)
            pairs = changes(self.snapshots.read(number - 1, step.part), self.snapshots.read(number, step.part))
            for k, (kind, entry) in enumerate(pairs):
                yield (number << 42) + (step.part << 24) + k, at, entry[0], kind, entry[3]

    def commit(self, end: dict) -> None:
        """Snapshots before the last committed one are not needed again."""
        for name in os.listdir(self.snapshots.folder):
            if name[:12].isdigit() and int(name[:12]) < end["snapshot"] - 1:
                os.unlink(f"{self.snapshots.folder}/{name}")


class MonitorSource(DataSource):
    """Options: ``path``; ``snapshots``, a folder of this stream's own; ``partitions`` (8); ``changesPerBatch`` (100,000).

    The number of partitions belongs to the snapshots and can't change later.
    ``ts`` is when the snapshot was taken.  Entries that can't be read are as if
    they were not there.
    """

    @classmethod
    def name(cls) -> str:
        return "sextant_monitor"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MonitorReader:
        return MonitorReader(self.options)
