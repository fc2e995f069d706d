"""Removal of repeated substrings by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed.  Such strings are found in four steps.

1. Each window of ``length`` bytes has an anchor: of the short grams in it the
   one with the least hash.  Equal windows have equal anchors at the same
   offset, so only windows whose anchor's gram occurs at least twice in the
   corpus can repeat; nothing else needs to be sorted.  Consecutive windows
   with one anchor are a span.
2. Equal spans are counted; all windows of a span that occurs twice repeat.
   One copy of each span, of those anchors that have several different spans,
   goes to a shard by its anchor.
3. Each shard builds a suffix array of its spans by Larsson-Sadakane
   refinement and the common prefixes of neighbours as Kasai does; windows
   with a common prefix of ``length`` repeat.
4. An anchor with very many spans is dealt out over several shards.  Their
   sorted windows meet once more, dealt by value, and each is looked up by
   binary search in the merged run.

A text is known by two hashes, so what is found for one copy of it holds for
all.  All joins are shuffles of both sides, with frequent keys dealt out; only
those keys' list and filters of a fixed size are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import map_batches
from .hashing import BATCH, Prefixes, batches, joined
from .staging import heavy_keys, load, split_by, spread_join, stage

GRAM = 32
#: Suffix arrays are built over about this many bytes at a time, spans of one anchor together.
BLOCK = 1 << 20
#: An anchor with more different spans than this is dealt out over several shards.
PART = 16384


def anchored_spans(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, lo, n, offset, anchor, s1, s2) of each span.

    The span's windows start at lo to lo + n - 1; its anchor is at lo + offset.
    """
    raw, starts = joined(texts)
    gram = min(GRAM, length)
    width = length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    sizes = np.diff(starts) - 1
    if not (sizes >= length).any():
        return none
    hashes = Prefixes(raw)
    grams = hashes.runs(gram)
    # Least gram of each window: the rest of one block and the beginning of the next.  The low bits are places in
    # the block, so of equal grams the first one counts, and as many bits of the hash are compared in any text.
    low = np.uint64((1 << (width - 1).bit_length()) - 1)
    keys = np.full(-(-(len(grams) + width) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[: len(grams)] = grams
    keys = keys & ~low | np.resize(np.arange(width, dtype=np.uint64), len(keys))
    for end in starts[1:]:  # grams that run beyond their text
        keys[max(end - gram, 0) : end] = np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(raw) - length + 1
    here, there = rest[:count], ahead[width - 1 : width - 1 + count]
    own = (here & ~low) <= (there & ~low)
    block = np.arange(count) // width * width
    later = np.arange(width - 1, width - 1 + count) // width * width
    least = np.where(own, block + (here & low).astype(np.int64), later + (there & low).astype(np.int64))
    whole = np.flatnonzero(sizes >= length)
    valid = np.zeros(count, bool)
    for i in whole:
        valid[starts[i] : starts[i] + sizes[i] - length + 1] = True
    at = np.flatnonzero(valid)
    anchor = least[at]
    head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, n = at[head], np.diff(np.concatenate((head, [len(at)])))
    first = anchor[head]
    end = lo + n - 1 + length
    text = np.searchsorted(starts, lo, "right") - 1
    return text, lo - starts[text], n, first - lo, grams[first].view(np.int64), hashes.of(lo, end).view(np.int64), Prefixes(raw, 1).of(lo, end).view(np.int64)


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes at least (Larsson-Sadakane)."""
    n = len(raw)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : n + j]
    order = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.full(n + 1, -1, np.int32)
    places = np.arange(n, dtype=np.int32)

    def heads(fresh: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(fresh, places, np.int32(0)))

    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.zeros(0, bool)
    del key
    group = heads(fresh)  # a group's number is where it begins
    rank[order] = group
    done = 8
    while done < depth:
        single = fresh & np.concatenate((fresh[1:], [True]))
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        some = order[open_]
        pair = group[open_].astype(np.int64) * (n + 1) + rank[np.minimum(some + done, n)] + 1
        by = np.argsort(pair, kind="stable")
        some, pair = some[by], pair[by]
        order[open_] = some
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        fresh[open_] = new
        group = heads(fresh)
        rank[some] = group[open_]
        done *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each window in ``order`` the bytes it has in common with the one before it, up to ``length``.

    Kasai's walk in text order: from one window to the next at most one common
    byte is lost.  All spans (windows lo to lo + n - 1) are walked side by side.
    """
    before = np.full(len(raw) + 1, -1, np.int32)
    before[order[1:]] = order[:-1]
    place = np.full(len(raw) + 1, len(raw), np.int32)  # no window: last
    place[order] = np.arange(len(order))
    found = np.zeros(len(raw) + 1, np.int32)
    padded = np.concatenate((raw, np.zeros(length + 8, np.uint8)))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64)[:, 0]
    common = np.zeros(len(lo), np.int64)
    by_size = np.argsort(-n, kind="stable")
    lo, n = lo[by_size], n[by_size]
    for step in range(int(n.max()) if len(n) else 0):
        here = lo[: np.searchsorted(-n, -step, "left")] + step
        other = before[here]
        have = np.where(other >= 0, np.maximum(common[: len(here)] - 1, 0), 0)
        if step:
            # The walk goes on if the window after the last neighbour sorts before this one.
            # (Windows equal in all bytes that were sorted by may stand either way.)
            last = before[here - 1]
            have = np.where((last >= 0) & (place[last + 1] < place[here]), have, 0)
        for bytes_, views in ((8, eights), (1, padded)):
            grow = np.flatnonzero((other >= 0) & (have + bytes_ <= length))
            while len(grow):
                grow = grow[views[here[grow] + have[grow]] == views[other[grow] + have[grow]]]
                have[grow] += bytes_
                grow = grow[have[grow] + bytes_ <= length]
        common = have
        found[here] = have
    return found[order]


def repeated_windows(raw: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each byte whether it starts a window that another window equals."""
    out = np.zeros(len(raw), bool)
    window = np.zeros(len(raw), bool)
    for a, c in zip(lo, n, strict=True):
        window[a : a + c] = True
    order = suffix_array(raw, length)
    order = order[window[order]]
    equal = common_prefixes(raw, order, lo, n, length) >= length
    out[order[equal]] = True
    out[order[:-1][equal[1:]]] = True
    return out


SPAN = ["anchor", "s1", "s2"]
WINDOW = [*SPAN, "start", "stop"]
SHARD = "anchor long, s1 long, s2 long, start int, stop int, w1 long, w2 long"


def search_shards(spans: DataFrame, length: int) -> DataFrame:
    """Repeated windows (start to stop - 1 of each span) of ``spans`` (anchor, s1, s2, n, parts, part, bytes).

    Of an anchor with several parts each window comes as a row of its own with
    its digest w1, w2, for the other parts to compare with.
    """

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        block, size, last = [], 0, None
        for batch in rows:
            for *row, part, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= BLOCK and (row[0], part) != last:
                    yield block
                    block, size = [], 0
                last = row[0], part
                block.append((*row, data))
                size += len(data)
        if block:
            yield block

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
        for block in blocks(rows):
            raw = np.frombuffer(b"".join(r[-1] for r in block), np.uint8)
            lo = np.cumsum([0, *[len(r[-1]) for r in block]])[:-1]
            n = np.array([r[3] for r in block])
            repeated = repeated_windows(raw, lo, n, length)
            out: list[tuple] = []
            digests = None
            for row, a, c in zip(block, lo, n, strict=True):
                change = np.flatnonzero(np.diff(np.concatenate(([False], repeated[a : a + c], [False])).astype(np.int8)))
                out += [(*row[:3], int(x), int(y), None, None) for x, y in zip(change[::2], change[1::2], strict=True)]
                if row[4] > 1:
                    digests = digests or [Prefixes(raw, b).runs(length).view(np.int64) for b in (0, 1)]
                    out += [(*row[:3], x, x + 1, int(digests[0][a + x]), int(digests[1][a + x])) for x in range(int(c))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return map_batches(spans.select(*SPAN, "n", "parts", "part", "bytes"), run, SHARD)


def twice(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by w1 and w2, whose digest occurs more than once; of a digest one row at most is held back."""
    last, held = None, None
    for batch in rows:
        run = np.empty(batch.num_rows, dtype=[("w1", np.int64), ("w2", np.int64)])
        run["w1"], run["w2"] = batch["w1"].to_numpy(), batch["w2"].to_numpy()
        often = np.searchsorted(run, run, "right") - np.searchsorted(run, run, "left") > 1
        if last is not None and run[0] == last:
            often[: np.searchsorted(run, run[0], "right")] = True
            if held is not None:
                yield held
        last, held = run[-1], None if often[-1] else batch.slice(batch.num_rows - 1)
        if often.any():
            yield batch.filter(pa.array(often))


def merge_shards(windows: DataFrame) -> DataFrame:
    """The ``windows`` (SHARD) whose digest occurs more than once."""
    digest = ["w1", "w2"]
    heavy = heavy_keys(windows.groupBy(*digest).agg(F.count("*").alias("times")), digest, "times")
    known = F.broadcast(heavy.select(*digest))  # bounded: heavy digests need no search
    others = windows.join(known, digest, "left_anti").select(windows.columns).repartition(*digest).sortWithinPartitions(*digest)
    return windows.join(known, digest, "left_semi").select(*WINDOW).unionByName(map_batches(others, lambda rows: twice(b for b in rows if b.num_rows), SHARD).select(*WINDOW))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``t1, t2, spans``: for each text of ``docs`` (t1, t2, text) that has any, the bytes to remove (they may overlap)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(rows):
            # Windows of a long text are taken slice by slice.
            slices = [(i, a, t[a : a + BATCH + length - 1]) for i, t in enumerate(texts) for a in range(0, max(len(t) - length + 1, 1), BATCH)]
            hashes = pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32())
            while slices:
                size, some = 0, []
                while slices and size < BATCH:
                    some.append(slices.pop())
                    size += len(some[-1][2])
                text, lo, n, _, anchor, s1, s2 = anchored_spans([x[2] for x in some], length)
                owner, begin = np.array([x[0] for x in some])[text], np.array([x[1] for x in some])[text]
                yield pa.RecordBatch.from_arrays(
                    [*[h.take(pa.array(owner)) for h in hashes], pa.array(begin + lo, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor), pa.array(s1), pa.array(s2)],
                    names=["t1", "t2", "lo", "n", "anchor", "s1", "s2"],
                )

    spans = stage(map_batches(docs.select("t1", "t2", "text"), run, "t1 long, t2 int, lo int, n int, anchor long, s1 long, s2 long"), "spans")
    anchors = stage(spans.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"), "anchors")
    # Copies of a text have equal rows, so the partition tells them apart.
    shared = spread_join(spans, anchors.select("anchor"), ["anchor"], heavy_keys(anchors, ["anchor"], "times"), [F.spark_partition_id(), F.col("lo")])
    spans = stage(shared.groupBy("t1", "t2", "lo", "n", *SPAN).agg(F.count("*").alias("times")), "shared_spans")

    place = F.struct("t1", "t2", "lo")
    kinds = spans.groupBy(*SPAN, "n").agg(F.sum("times").alias("times"), F.count("*").alias("texts"), F.min(place).alias("place"))
    kinds = stage(kinds, "span_kinds")
    several = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "contested")
    parts = several.select("anchor", F.ceil(F.col("kinds") / PART).cast("int").alias("parts"))
    contested = spread_join(kinds, parts, ["anchor"], heavy_keys(several, ["anchor"], "kinds"), [F.col("s1")])
    wanted = stage(contested.select(*SPAN, "n", "parts", "place.*"), "wanted")
    per_text = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct(*SPAN, "n", "parts", "lo")).alias("wanted"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in rows:
            for start in range(0, batch.num_rows, 64):
                out = []
                for wanted_, text in zip(*[c.to_pylist() for c in batch.slice(start, 64).columns], strict=True):
                    data = text.encode("utf-8", "replace")
                    out += [(w["anchor"], w["s1"], w["s2"], w["n"], w["parts"], data[w["lo"] : w["lo"] + w["n"] - 1 + length]) for w in wanted_]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[*SPAN, "n", "parts", "bytes"])

    # One copy of each text; they are first thrown together where they are.
    holders = split_by(docs.select("t1", "t2", "text"), wanted.select("t1", "t2"), ["t1", "t2"])[0].groupBy("t1", "t2").agg(F.first("text").alias("text"))
    source = holders.join(per_text.hint("merge"), ["t1", "t2"]).select("wanted", "text")
    pieces = map_batches(source, cut, "anchor long, s1 long, s2 long, n int, parts int, bytes binary")
    pieces = pieces.withColumn("part", F.pmod(F.col("s1"), F.col("parts").cast("long")))
    sharded = pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    in_shards = stage(search_shards(sharded, length), "repeated_in_shards")
    across = merge_shards(in_shards.where("w1 IS NOT NULL"))
    again = kinds.where("times > 1").select(*SPAN, F.lit(0).alias("start"), F.col("n").alias("stop"))
    repeats = stage(in_shards.where("w1 IS NULL").select(*WINDOW).unionByName(across).unionByName(again), "repeats")
    found = spread_join(spans.select("t1", "t2", "lo", *SPAN), repeats, SPAN, heavy_keys(kinds, SPAN, "texts"), [F.col("t1"), F.col("lo")])
    run_ = F.struct((F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop") - 1 + length).alias("stop"))
    return stage(found.groupBy("t1", "t2").agg(F.collect_set(run_).alias("spans")), "runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, removed, kept``: the removed runs [start, stop) and the bytes that remain.

    Strings never cross documents and are judged on the input.  A null text
    counts as empty; repeated rows are documents that repeat each other; an
    empty table gives an empty result; other columns are ignored.  ``kept`` is
    binary, as a cut may fall inside a character.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("t1"), F.hash(body).alias("t2"), body.alias("text"))
    runs = repeated_spans(docs, length)
    some, others = split_by(docs, runs.select("t1", "t2"), ["t1", "t2"])
    copies = docs.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    both = spread_join(some, runs, ["t1", "t2"], heavy_keys(copies, ["t1", "t2"], "copies"), [F.col("doc_id")], "left")
    removed = "array<struct<start:long,stop:long>>"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = map_batches(both.select("doc_id", "spans", "text"), _cutter(), f"doc_id {id_type}, n_bytes long, removed {removed}, kept binary")
    whole = others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(removed).alias("removed"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole)


def _cutter():
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, removed, kept = [], [], []
                for spans, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = text.encode("utf-8", "replace")
                    merged: list[dict] = []
                    for s in sorted(spans or [], key=lambda x: (x["start"], x["stop"])):
                        if merged and s["start"] <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                        else:
                            merged.append({"start": s["start"], "stop": s["stop"]})
                    ends = [0, *[x for m in merged for x in (m["start"], m["stop"])], len(data)]
                    sizes.append(len(data))
                    removed.append(merged)
                    kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if merged else data)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return run


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(load(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE: dict[str, str] = {}
