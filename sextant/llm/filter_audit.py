"""Audit of quality filters: what each removes alone, first, and in any order.

Every document gets a mask, one bit for each filter that it fails.  Four
filters look at the text alone.  The fifth, copies of an earlier document, is
decided by sorting: documents are range-partitioned by text fingerprint and
doc_id and sorted by fingerprint, full text and doc_id, so a text's copies
follow each other and each row is compared with its predecessor as the rows
stream by.  Range bounds hold fingerprints and ids only, never texts, and a
group of copies of any size is cut by doc_id into as many partitions as it
fills.  A group that meets a partition's edge may go on in the next one: the
least doc_id of its texts is found over all edges, of which there are two a
partition, and its rows are compared with that.

Masks are then merged into counters by part and mask, at most 32 for each
part.  All orders of the filters are derived from these: which filter removes
a document depends on nothing but its mask and the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_batches
from .staging import load, small, stage

#: Letters of the filters; the bit of each is its place.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Edges of partitions that are sent to all tasks: two a partition, so this is half as many partitions.
EDGES = 100_000

WHITE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> Column:
    """Bits of the filters A to D that a text, null being empty, fails."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, WHITE), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(body).cast("long") - F.length(F.translate(body, CAPITALS, ""))
    fails = [
        n < least_words,
        100 * distinct < distinct_percent * n,
        100 * capitals > capital_percent * F.length(body).cast("long"),
        body.rlike(r"[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask.cast("int")


def _mark_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the sorted rows (fp, text, doc_id, part, mask) of a partition with their predecessors.

    Yields (doc_id, part, mask, fp, digest); the digest is given to rows of
    edge groups that have no smaller doc_id here, as another partition may.
    """
    first_fp = None
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []  # of the last fingerprint's rows, only what has no smaller doc_id so far
    run: tuple[int, str, int] | None = None  # fingerprint, text and least doc_id of the run that a batch ended in

    def out(batch: pa.RecordBatch, fails: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        texts = batch.column(1)
        digests, known = [None] * batch.num_rows, {}
        for i in np.flatnonzero(edge & ~fails):
            text = texts[i].as_py()
            if text not in known:
                known = {text: sha256(text.encode("utf-8", "replace")).digest()}  # copies follow each other
            digests[i] = known[text]
        mask = batch.column(4).to_numpy() | np.where(fails, DUPLICATE, 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(mask, pa.int32()), batch.column(0), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "fp", "digest"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp, texts, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
        if first_fp is None:
            first_fp = fp[0]
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = (fp[1:] != fp[:-1]) | pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        goes_on = run is not None and run[0] == fp[0] and run[1] == texts[0].as_py()
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        least = ids[start]
        if goes_on:
            least[start == 0] = run[2]
        fails = ids > least
        run = (int(fp[-1]), texts[n - 1].as_py(), int(least[-1]))
        # Rows of the last fingerprint wait until a further one shows that they are no edge.
        if held and held[-1][0].column(0)[0].as_py() != fp[0]:
            for rows, bad, edge in held:
                yield out(rows, bad, edge)
            held = []
        cut = int(np.searchsorted(fp, fp[-1]))
        if cut:
            for rows, bad, edge in held:
                yield out(rows, bad, edge)
            held = []
            yield out(batch.slice(0, cut), fails[:cut], fp[:cut] == first_fp)
        rest, bad = batch.slice(cut), fails[cut:]
        sure = rest.filter(pa.array(bad))
        if sure.num_rows:  # copies of a row here need not wait
            yield out(sure, np.ones(sure.num_rows, bool), np.zeros(sure.num_rows, bool))
        waits = rest.filter(pa.array(~bad))
        if waits.num_rows:
            held.append((waits, np.zeros(waits.num_rows, bool), np.full(waits.num_rows, fp[-1] == first_fp)))
    for rows, bad, _ in held:
        yield out(rows, bad, np.ones(rows.num_rows, bool))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", partitions: int | None = None) -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs``.

    Bit E is set where a row with a smaller doc_id has the same text; equal
    doc_ids are not smaller than each other, and a null doc_id is neither
    smaller nor greater than any, so its row never has bit E nor gives it.
    """
    body, part = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), body.alias("text"))
    known = rows.where("doc_id IS NOT NULL").withColumns({"fp": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # The row number deals out even one doc_id with very many rows.  Masks are taken after the shuffle, whose bounds are sampled from what stands before.
    keys = ["fp", "doc_id", "row"]
    dealt = known.repartitionByRange(partitions, *keys) if partitions else known.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions("fp", "text", "doc_id")
    marked = map_batches(dealt.select("fp", "text", "doc_id", "part", text_mask(F.col("text")).alias("mask")), _mark_copies, "doc_id long, part string, mask int, fp long, digest binary")
    marked = stage(marked, "masks")
    edges = marked.where("digest IS NOT NULL").groupBy("fp", "digest").agg(F.min("doc_id").alias("least"))
    edges = small(stage(edges, "edges"), EDGES)
    inner = marked.where("digest IS NULL").select("doc_id", "part", "mask")
    # Rows at edges are few: those of a text's least doc_id in a partition's first and last group.
    outer = marked.where("digest IS NOT NULL").join(edges, ["fp", "digest"])
    outer = outer.select("doc_id", "part", F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    without = rows.where("doc_id IS NULL").select("doc_id", "part", text_mask(F.col("text")).alias("mask"))
    return inner.unionByName(outer).unionByName(without)


def part_counters(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: additive counters of rows; a row is good or toxic if any label of its doc_id says so."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    # Rows of one doc_id are merged first, so a repeated id is one row of the join.
    by_id = marked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0).cast("long")))
    return by_id.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), flag("good").alias("good"), flag("toxic").alias("toxic"))


def effects(letters: str = FILTERS) -> list[tuple[int, str, int, int, int, int, int, int]]:
    """(mask, filter_order, step, kept, removed, redundant, unique_fails, shapley) of one document of each mask."""
    bit = {x: 1 << k for k, x in enumerate(letters)}
    orders = ["".join(p) for p in permutations(letters)]
    out = []
    for mask in range(1 << len(letters)):
        for order in orders:
            earlier = False
            for step, letter in enumerate(order, 1):
                fails = bool(mask & bit[letter])
                # Each of the filters that a document fails comes first of them in the same number of orders.
                share = len(orders) // mask.bit_count() if fails else 0
                out.append((mask, order, step, int(not earlier and not fails), int(fails and not earlier), int(fails and earlier), int(mask == bit[letter]), share))
                earlier = earlier or fails
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step.

    Filters (failing): A under 200 words, B under 50 % distinct words, C over
    3 % capitals, D any of ``#$%&*|``, E a copy of a smaller doc_id's text.
    Null texts are empty, null parts "".  Empty tables give an empty result;
    columns beside those named are ignored; documents without a label count as
    neither good nor toxic; a repeated row counts as often as it occurs.
    """
    counters = stage(part_counters(masks(docs, id_col, text_col, part_col), labels), "counters")
    steps = docs.sparkSession.createDataFrame(effects(), "mask int, filter_order string, step int, keeps long, removes long, repeats long, alone long, share long")
    total = lambda c, of="n": F.sum(F.col(c) * F.col(of))
    found = counters.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step")  # 32 masks of 600 steps
    return found.agg(
        total("keeps").alias("kept"),
        total("removes").alias("removed"),
        total("repeats").alias("redundant"),
        total("alone").alias("unique_fails"),
        total("removes", "good").alias("good_lost"),
        total("removes", "toxic").alias("toxic_lost"),
        total("share").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE = {
    "op12_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
        split AS (
            SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                   min(doc_id) OVER (PARTITION BY body) AS first_id FROM texts),
        fails AS (
            SELECT doc_id, part, len(words) < 200 AS a, 100 * list_unique(words) < 50 * len(words) AS b,
                   100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS c,
                   regexp_matches(body, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM split),
        marks AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        rows AS (
            SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
                   coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM fails LEFT JOIN marks USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
        told AS (
            SELECT part, filter_order, step, f[substr(filter_order, step, 1)] AS fails, n_fails, good, toxic,
                   step > 1 AND list_bool_or([f[substr(filter_order, k::INT, 1)] FOR k IN range(1, step)]) AS gone
            FROM rows, steps)
        SELECT part, filter_order, step,
               count(*) FILTER (NOT fails AND NOT coalesce(gone, false)) AS kept,
               count(*) FILTER (fails AND NOT coalesce(gone, false)) AS removed,
               count(*) FILTER (fails AND gone) AS redundant,
               count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
               count(*) FILTER (fails AND NOT coalesce(gone, false) AND good = 1) AS good_lost,
               count(*) FILTER (fails AND NOT coalesce(gone, false) AND toxic = 1) AS toxic_lost,
               coalesce(sum(120 // nullif(n_fails, 0)) FILTER (fails), 0)::BIGINT AS shapley
        FROM told GROUP BY part, filter_order, step"""
}
